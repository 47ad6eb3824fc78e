import datetime
import json

import pytest

from chainsieve.sources import files
from chainsieve.streaming import logs

SCHEMA = "tid string, n int"


def test_unfinished_last_line_is_dropped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"tid": "x", "n": 1}\n\n{"tid": "y", "n": 2}\n{"tid": "z", ')
    assert sorted(r.tid for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA).collect()) == ["x", "y"]


def test_broken_line_elsewhere_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"tid": "x", \n{"tid": "y", "n": 2}\n')
    with pytest.raises(Exception, match="unreadable line"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA).collect()


def test_a_broken_line_is_told_by_its_place_not_by_what_it_says(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"tid": "x", "n": 1}\n{"tid": \n{"tid": "y", "n": 2}\n{"tid": \n\n')
    with pytest.raises(Exception, match="unreadable line"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA).collect()


def test_broken_last_lines_of_several_files_and_blocks(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"tid": "{name}{i}", "n": {i}}}\n' for i in range(3000)) + '{"tid"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert files.read_jsonl(spark, str(tmp_path / "*.jsonl"), SCHEMA).count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vectors_documents_and_pins(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "v.npz", tids=np.array(["a", "b"]), vectors=np.eye(2, 3, dtype=np.float32))
    found = files.unpack_npz(spark.read.format("binaryFile").load(str(tmp_path / "v.npz")))
    assert {r.tid: list(r.vec) for r in found.collect()} == {"a": [1, 0, 0], "b": [0, 1, 0]}
    path = str(tmp_path / "d.json")
    for value in ({"a": 1, "b": "long" * 900}, {"a": 2}):
        files.write_document(spark, path, value)
    assert files.read_document(spark, path, "a int, b string").collect() == [(2, None)]
    assert [f.name for f in tmp_path.glob("*.part")] == []
    with pytest.raises(OSError):
        files.fetch(lambda: (tmp_path / "none").read_bytes(), tries=2, wait=0)
    with pytest.raises(ValueError):
        files.fetch(lambda: b"x", "0" * 32)


def test_missing_file_is_empty(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none*.jsonl"), SCHEMA).count() == 0


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 else i) for i in range(20)], SCHEMA)
    a, b = files.fingerprint(df).first(), files.fingerprint(df.repartition(3).orderBy("n")).first()
    assert a == b and a != files.fingerprint(df.limit(19)).first()
    assert files.fingerprint(df.limit(0)).first().n == 0


def test_manifest(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, digest string")
    want, have = make([("a", "1"), ("b", "2"), ("c", "3")]), make([("a", "1"), ("b", "x")])
    assert {tuple(r) for r in files.check_manifest(have, want).collect()} == {("b", "changed"), ("c", "missing")}
    assert {tuple(r) for r in files.upsert_manifest(want, have).collect()} == {("a", "1"), ("b", "x"), ("c", "3")}


def test_skip_done(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    assert [r.tid for r in files.skip_done(df, df.where("n = 1"), "tid").collect()] == ["b"]


def test_compaction_keeps_last_row(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], SCHEMA).write.parquet(path)
    spark.createDataFrame([("a", 2), ("b", 5)], SCHEMA).write.mode("append").parquet(path)
    rows = logs.compacted(spark, path, ["tid"], ["n"]).collect()
    assert {(r.tid, r.n) for r in rows} == {("a", 3), ("b", 5)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    path, folder = str(tmp_path / "log.parquet"), str(tmp_path / "state")
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).write.parquet(path)
    assert logs.compacted(spark, path, ["tid"], ["n"], folder).count() == 2
    spark.createDataFrame([("a", 0), ("b", 5), ("c", 1)], SCHEMA).write.mode("append").parquet(path)
    assert {tuple(r) for r in logs.compacted(spark, path, ["tid"], ["n"], folder).collect()} == {("a", 1), ("b", 5), ("c", 1)}


def test_windows_take_late_rows_up_to_the_bound(spark, tmp_path):
    path, folder = str(tmp_path / "ev.parquet"), str(tmp_path / "state")
    kind = "ts timestamp, k string, value double"
    at = lambda h, m=0: datetime.datetime(2024, 5, 1, h, m)
    spark.createDataFrame([(at(8), "x", 1.0), (at(12), "x", 2.0)], kind).write.parquet(path)
    logs.windowed_counts(spark, path, "ts", "k", "1 hour", folder)
    spark.createDataFrame([(at(8, 30), "x", 4.0), (at(11, 30), "x", 8.0), (at(12, 5), "x", 16.0)], kind).write.mode("append").parquet(path)
    got = {r.start.hour: (r.n, r.total) for r in logs.windowed_counts(spark, path, "ts", "k", "1 hour", folder).collect()}
    assert got == {8: (1, 1.0), 11: (1, 8.0), 12: (2, 18.0)}


def test_registry_columns_match_sql():
    from chainsieve.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert json.dumps(sorted(registry.queries()))
