import pytest

from compare import both
from parley.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    mine, theirs = both(spark, queries.QUERIES[name], queries.SQL[name], small)
    assert mine == theirs


FOUND = {
    "p1_found": ["id", "field", "pii_type"], "p2_found": ["id", "kind"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["id", "field", "lang"], "p5_found": ["session_id", "defect"], "p6_found": ["state_id", "defect"],
    "p7_found": ["chunk_id", "kind"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert name not in FOUND or df.columns == FOUND[name]
    assert df.count() > 0
    if name in FOUND:
        assert df.count() == df.distinct().count()
