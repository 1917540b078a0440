import pytest

import __spark_entry__ as entry
from paperloom.plans.queries import ORACLES, QUERIES, _properties

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), ORACLES[name], sf) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_in_order_of_a_line_that_repeats_itself(spark):
    texts = spark.createDataFrame([(0, "b a c a d")], "doc_id long, text string")
    for chunks, ordered in ((["b", "a", "c", "a", "d"], True), (["b", "c", "a", "d", "a"], False), (["b", "x"], False)):
        rows = spark.createDataFrame([(0, i, c) for i, c in enumerate(chunks)], "doc_id long, chunk_index int, page_content string")
        assert _properties(rows, texts, 10).first().in_order == ordered, chunks
