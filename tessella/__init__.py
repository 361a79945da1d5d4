"""tessella: document-knowledge analytics as plain PySpark DataFrame transforms."""

__version__ = "0.1.0"
