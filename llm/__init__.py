"""Operators of a training-data pipeline: search, cleaning, de-duplication, tokenising and packing of documents."""
