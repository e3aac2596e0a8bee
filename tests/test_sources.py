import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.sources import files
from rankloom.sources.registry import Registry, RegistryError, lookup
from rankloom.streaming import live


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{broken\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).count() == 1
    assert [r["value"] for r in files.broken_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()] == ["{broken"]


def test_json_arrays_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "b.json").write_text('{"details": [{"a": 3}]}')
    assert sorted(r["a"] for r in files.read_json_array(spark, str(tmp_path / "a.json"), "a int").collect()) == [1, 2]
    assert [r["a"] for r in files.read_json_array(spark, str(tmp_path / "b.json"), "a int", "details").collect()] == [3]
    df = spark.createDataFrame([(1, None)], "b int, a string")
    files.write_canonical(df, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()["value"] == '{"a":null,"b":1}'
    files.write_new(df, f"{tmp_path}/new", by=("b",))
    with pytest.raises(Exception):
        files.write_new(df, f"{tmp_path}/new")


def test_inventory_and_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"a\0b")
    (tmp_path / "z.bin").write_bytes(b"\xff\xfe")
    found = {r["path"].rpartition("/")[2]: (r["bytes"], r["sha256"]) for r in files.inventory(spark, [f"{tmp_path}/{{x,y}}.bin"]).collect()}
    assert found == {"x.bin": (3, hashlib.sha256(b"abc").hexdigest()), "y.bin": (3, hashlib.sha256(b"a\0b").hexdigest())}
    texts = files.text_files(spark.read.format("binaryFile").load(f"{tmp_path}/*.bin"))
    assert [r["text"] for r in texts.collect()] == ["abc"]
    paths = spark.createDataFrame([(p,) for p in ("a/b", "../a", "/a", "a/../b", "C:\\x", "", None, "a..b/c")], "path string")
    assert sorted(r["path"] for r in files.safe_paths(paths).collect()) == ["a..b/c", "a/b"]


def test_chunk_table_prunes(spark, tmp_path):
    chunks = spark.createDataFrame([("r1", "ABC", "x"), ("r2", "def", "y")], "repo string, revision string, text string")
    files.chunk_table(chunks, f"{tmp_path}/chunks")
    files.chunk_table(chunks.where("repo = 'r1'"), f"{tmp_path}/chunks")
    assert spark.read.parquet(f"{tmp_path}/chunks").where("repo = 'r1' and revision = 'abc'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 2


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    run = lambda i, created, status: (i, created, None, "t", "s", "{}", "dev", status, None)
    schema = "run_id string, created_at double, finished_at double, track string, system string, config string, split string, status string, notes string"
    reg.write_runs(spark.createDataFrame([run("a", 1.0, "running"), run("b", 1.0, "done"), run("c", 1.0, "done"), run("e", 1.0, "done")], schema))
    reg.write_runs(spark.createDataFrame([run("a", 2.0, "done")], schema))
    case = lambda r, c, at, ok, m: (r, c, at, "w", "repo", ok, 1.0, {"MRR": m}, ["x"], ["x"])
    cases = "run_id string, case_id string, written_at double, workflow string, repo string, ok boolean, latency_ms double, metrics map<string,double>, ranked array<string>, gold array<string>"
    reg.write_cases(spark.createDataFrame([case("a", "1", 1.0, False, 0.0), case("a", "1", 2.0, True, 0.5), case("a", "2", 1.0, True, 1.0), case("b", "1", 1.0, False, 0.0)], cases))
    assert {r["run_id"]: (r["status"], r["n_cases"]) for r in reg.runs().collect()} == {"a": ("done", 2), "b": ("done", 1), "c": ("done", 0), "e": ("done", 0)}
    assert sorted((r["case_id"], r["value"]) for r in reg.long_metrics("a").collect()) == [("1", 0.5), ("2", 1.0)]
    for bad in ("b", "c", "zzz"):
        with pytest.raises(RegistryError):
            reg.valid_run(bad)


def test_lookup(spark):
    store = spark.createDataFrame([("a", 1)], "key string, v int")
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    assert sorted(map(tuple, lookup(keys, store).collect())) == [("a", 1), ("b", None)]


SCHEMA = "run long, case_id long, ts timestamp, status string, latency double"


def test_streams(spark, tmp_path):
    rows = [(1, k % 3, f"2024-01-01 00:{k:02d}:00", "error" if k == 4 else "ok", float(k)) for k in range(20)] + [(1, 9, "2024-01-01 05:00:00", "ok", 1.0)]
    df = spark.createDataFrame(rows, "run long, case_id long, t string, status string, latency double").select("run", "case_id", F.to_timestamp("t").alias("ts"), "status", "latency")
    df.where("ts < '2024-01-01 04:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("ts >= '2024-01-01 04:00:00'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, make, want in (("rates", live.windowed_rates, [10, 10]), ("sessions", live.sessions, [20]), ("first", live.first_of_each, None)):
        stream = make(live.case_stream(spark, f"{tmp_path}/in", SCHEMA, 1))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        out = spark.table(name).collect()
        assert sorted(r["n"] for r in out) == want if want else len(out) == 4
    q = live.append_latest(live.case_stream(spark, f"{tmp_path}/in", SCHEMA, 1), f"{tmp_path}/latest", f"{tmp_path}/ck-latest")
    q.awaitTermination(120)
    assert sorted((r["case_id"], r["latency"]) for r in spark.read.parquet(f"{tmp_path}/latest").collect()) == [(0, 18.0), (1, 19.0), (2, 17.0), (9, 1.0)]
