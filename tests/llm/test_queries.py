import pytest

from frameflow.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


def test_columns(spark):
    q = queries.QUERIES
    want = {
        "p1_found": [("field", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
        "p2_found": [("stream_id", "string"), ("request_id", "bigint"), ("first_seq", "bigint"), ("last_seq", "bigint")],
        "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint"), ("span_start", "bigint"), ("span_end", "bigint")],
    }
    for name, columns in want.items():
        assert q[name](spark, DATA).dtypes == columns
