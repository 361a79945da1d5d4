"""Sections written as JSON lines and read back, next to their statement."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_section_lines_match_their_statement(spark):
    state, n, _, _, note = compare(spark, connect(SF_DIR), "s04_section_jsonl", SF_DIR, entry.oracle_sql())
    assert state == "ok" and n > 0, note
