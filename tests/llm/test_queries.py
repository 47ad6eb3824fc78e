from chainsieve.llm import queries as Q

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"gen_id": "bigint"},
    "p2_found": {"gen_id": "bigint", "defect": "string"},
    "p4_found": {"tbl": "string", "id_a": "string", "id_b": "string"},
    "p5_found": {"tid": "string"},
    "p6_found": {"eval_qid": "string", "train_qid": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "string"},
    "p10_found": {"doc_id": "bigint"},
}


def test_every_problem_has_a_query():
    assert {int(n[1:].split("_")[0]) for n in Q.queries()} == set(range(1, 11))
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_columns_and_distinct_rows(spark):
    for name, want in COLUMNS.items():
        df = Q.queries()[name](spark, ROOT)
        assert dict(df.dtypes) == want
        rows = [str(r) for r in df.collect()]
        assert len(rows) == len(set(rows)), name
