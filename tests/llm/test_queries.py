import oracle
import pytest

from millrace.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, tiny, name):
    columns, got = oracle.spark_rows(Q.queries()[name](spark, tiny))
    sql = Q.oracle_sql().get(name)
    if sql:
        assert (columns, got) == oracle.sql_rows(oracle.connect(tiny), sql)
    elif not name.endswith("_found"):
        assert got


def test_columns(spark, tiny):
    want = {"p1_found": ["answer_id", "defect"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["record_kind", "record_id", "issue", "language"], "p5_found": ["chunk_id", "noise"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"]}
    for name, columns in want.items():
        assert Q.queries()[name](spark, tiny).columns == columns
