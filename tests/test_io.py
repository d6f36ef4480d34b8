"""Readers, writers and watched folders."""

import bz2
import gzip
import json
import lzma

import pytest
import zstandard

from corpusloom.sources import io
from corpusloom.streaming import incremental

LINES = "\n".join(json.dumps({"id": i, "t": f"é{i}"}) for i in range(5)) + "\n\n"


@pytest.mark.parametrize("suffix,pack", [("", bytes), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".zst", lambda b: zstandard.ZstdCompressor().compress(b))])
def test_jsonl_codecs(spark, tmp_path, suffix, pack):
    (tmp_path / f"a.jsonl{suffix}").write_bytes(pack(LINES.encode()))
    rows = io.read_jsonl(spark, f"{tmp_path}/a.jsonl{suffix}", "id long, t string").collect()
    assert sorted(map(tuple, rows)) == [(i, f"é{i}") for i in range(5)]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n[2]\n{"id": \n')
    path = f"{tmp_path}/a.jsonl"
    assert io.read_jsonl(spark, path, "id long", "drop").count() == 1
    assert io.read_jsonl(spark, path, "id long", "keep").filter("_raw IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        io.read_jsonl(spark, path, "id long").collect()
    with pytest.raises(ValueError, match="codec"):
        io.read_jsonl(spark, f"{tmp_path}/a.jsonl.br", "id long")


def test_publish_is_all_or_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    manifest = io.publish(spark.range(120_000), out, {"seed": 1})
    assert manifest["rows"] == 120_000 and spark.read.parquet(out).count() == 120_000
    assert io.prepared(spark, out, {"seed": 1})
    with pytest.raises(ValueError):
        io.prepared(spark, out, {"seed": 2})
    with pytest.raises(FileExistsError):
        io.publish(spark.range(1), out)
    with pytest.raises(Exception):
        io.publish(spark.range(3).selectExpr("assert_true(id < 2) AS x"), f"{tmp_path}/bad")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_schema_union_rejects_other_types(spark):
    a, b = spark.range(1), spark.range(1).selectExpr("id AS other")
    assert io.union_by_name([a, b]).columns == ["id", "other"]
    with pytest.raises(ValueError):
        io.union_by_name([a, spark.range(1).selectExpr("string(id) AS id")])


def test_files_order_and_csv(spark, tmp_path):
    for p in ("b/x.csv", "a/y.csv", "logs/z.csv", ".h/w.csv"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text('ID,Topic\n1,"a ""b""\nc"\n')
    found = io.files(spark, str(tmp_path), (".csv",))
    assert [f.rsplit("/", 2)[-2:] for f in found] == [["a", "y.csv"], ["b", "x.csv"]]
    assert io.read_csv(spark, found, required=("ID",)).first()["Topic"] == 'a "b"\nc'
    with pytest.raises(ValueError):
        io.read_csv(spark, found, required=("Nope",))


def test_watch_runs_each_key_once_over_restarts(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for ids in ("1, 2, 2", "2, 3"):
        spark.sql(f"SELECT explode(array({ids})) AS k").write.mode("append").parquet(source)
        incremental.watch(spark, source, "k int", ["k"], out, state, lambda b: b).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
