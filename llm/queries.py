"""Queries of the subpackage by name, and their DuckDB statements where SQL expresses them."""

from __future__ import annotations

from llm.alignment import op13_alignment
from llm.hmm import op12_language_model
from llm.licenses import ORACLE as LICENSES_SQL
from llm.licenses import op5_licenses
from llm.lines import op3_lines
from llm.packing import op10_packing
from llm.passages import op9_passages
from llm.pii import op2_surrogates
from llm.pieces import op6_pieces
from llm.search import ORACLE as SEARCH_SQL
from llm.search import op11_search
from llm.shingles import op8_near_documents
from llm.toxicity import op4_toxicity
from llm.vectors import op1_nearest, op7_near_vectors

QUERIES = {q.__name__: q for q in (op1_nearest, op2_surrogates, op3_lines, op4_toxicity, op5_licenses, op6_pieces, op7_near_vectors, op8_near_documents, op9_passages, op10_packing, op11_search, op12_language_model, op13_alignment)}
ORACLES: dict[str, str] = {"op5_licenses": LICENSES_SQL, "op11_search": SEARCH_SQL}
