"""Registered corpus queries: those with SQL against DuckDB, the others for their columns and row counts."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_check import check  # noqa: E402

from breathline.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
ROWS = {"op2_repeats": "documents", "op3_language_id": "documents", "op4_byte_bpe": "documents", "op6_url_filter": "pages", "op7_quality_model": "documents", "op10_html_text": "pages", "op11_sentence_piece": "documents", "op13_periodic_runs": "documents"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    problem, rows, _ = check(spark, SF, name, QUERIES[name], SQL[name])
    assert not problem and rows


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_returns_a_row_each(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/{ROWS[name]}.parquet").count()
