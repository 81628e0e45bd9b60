import pytest
from pyspark.sql import functions as F

from thicket.functions import scalars, sqlgate
from thicket.operators import ops, retrieval
from thicket.sources import artifacts, files, publication
from thicket.streaming import flows


@pytest.mark.parametrize(
    ("text", "ok"),
    [("select 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("select 'insert into x'", True), ("select 1; delete from t", False), ("-- select\ninsert into t values (1)", False), ("select * into x from y", False),
     ("select * from t for update", True), ("select * from t for no key update", True), ("", False), ("explain select 1", True), ("/* x */ create table t(a int)", False), ('select "update" from t', True), ("set a=1", False)],
)
def test_guard(text, ok):
    assert sqlgate.is_read_only(text) is ok


def test_parameters(spark):
    assert sqlgate.run(spark, "select :a + 1 as x", {"a": 2}).first()["x"] == 3
    assert sqlgate.run(spark, "select ? as x, '?' as y", ["v"]).first()["x"] == "v"
    with pytest.raises(ValueError):
        sqlgate.run(spark, "select ? as x", [])
    with pytest.raises(TypeError):
        sqlgate.run(spark, "select ? as x", [[1]])
    with pytest.raises(PermissionError):
        sqlgate.run(spark, "drop table x")


def test_shape(spark):
    df = spark.createDataFrame([("SELECT a1 FROM t  WHERE b = 'x' AND c=12.5",), ("select a1 from t where b = 'yy' and c=7",)], "q string")
    assert {r[0] for r in df.select(sqlgate.shape(F.col("q"))).collect()} == {"select a1 from t where b = ? and c=?"}


def test_exclusion_and_purge(spark):
    f = spark.createDataFrame([("a/x.py", 10, 5), ("node_modules/y.js", 10, 1), ("b.bin", 1, 1), ("c.py", 0, 9), (None, 1, 1)], "path string, size_bytes long, last_seen_ms long")
    assert {r["reason"]: r["files"] for r in files.reasons(f).collect()} == {"eligible": 2, "excluded_path": 1, "unsupported": 1, "empty": 1}
    gone = spark.createDataFrame([("a/x.py",)], "path string")
    left = files.purge(
        gone, f, spark.createDataFrame([("k1", "a/x.py"), ("k2", "c.py")], "id string, file_path string"), spark.createDataFrame([("k1",), ("k2",)], "chunk_id string"),
        spark.createDataFrame([("P::a/x.py::f",), ("P::c.py::g",)], "id string"), spark.createDataFrame([("P::a/x.py::f", "P::c.py::g"), ("P::c.py::g", "z")], "source string, target string"),
    )
    assert [left[k].count() for k in ("files", "chunks", "embeddings", "symbols", "edges")] == [4, 1, 1, 1, 1]


def test_upsert_and_difference(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    mk = lambda rows: spark.createDataFrame(rows, "id string, at long, v string")
    publication.upsert(spark, t, mk([("a", 1, "x"), ("b", 1, "y"), ("a", 1, "x")]), ["id"], "at")
    first = publication.current(spark, t).collect()
    publication.upsert(spark, t, mk([("a", 2, "z"), ("b", 0, "old"), ("c", 1, None)]), ["id"], "at")
    now = publication.current(spark, t)
    assert {r["id"]: r["v"] for r in now.collect()} == {"a": "z", "b": "y", "c": None}
    d = publication.difference(spark.createDataFrame(first), now, ["id"])
    assert {r["id"]: r["state"] for r in d.collect()} == {"a": "changed", "b": "skipped", "c": "new"}


def test_publish_and_catalogue(spark, tmp_path):
    publication.publish(spark.createDataFrame([("a", "Symbol")], "id string, label string"), spark.createDataFrame([("a", "a", "CALLS")], "from_id string, to_id string, relation_type string"), f"file://{tmp_path}/p")
    assert spark.read.json(f"file://{tmp_path}/p/manifest").count() == 2
    (tmp_path / "c.json").write_text('{"m": {"name": "m.csv", "kind": "csv", "bytes": 3, "rows": 2, "n_cols": 3, "source": "s"}}')
    a = artifacts.catalogue(spark, f"file://{tmp_path}/c.json")
    assert artifacts.summary(a).first()["without_manifest"] == 1
    chunks = spark.createDataFrame([("s1", "open m.csv now"), ("s2", "nothing"), (None, "m.csv")], "source_id string, content string")
    for most in (10, 0):
        assert [r["source"] for r in artifacts.reads_artifact(chunks, a, most).collect()] == ["s1"]


def test_debounce_events():
    e = [(0.0, "modify"), (0.1, "modify"), (0.2, "delete"), (0.3, "modify"), (2.0, "create")]
    assert flows.debounce_events(e, 0.5) == [(0.0, "modify"), (0.5, "delete"), (2.0, "create")]
    assert flows.debounce_events([], 1.0) == []


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("t", "P", "ok", "2024-01-01 00:10:00", 5.0), ("t", "P", "ok", "2024-01-01 00:20:00", 7.0), ("t", "P", "error", "2024-01-01 09:00:00", 1.0)]
    df = spark.createDataFrame(rows, "tool string, project_code string, status string, ts string, latency_ms double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    q = flows.hourly(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("roll").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["call_count"], r["latency_sum_ms"]) for r in spark.sql("select * from roll").collect()] == [(2, 12.0)]
    t = f"file://{tmp_path}/up"
    u = flows.upsert_stream(spark.readStream.schema(df.schema).parquet(src), t, ["status"], "ts", f"{tmp_path}/cp")
    u.awaitTermination(120)
    assert {r["status"]: r["latency_ms"] for r in publication.current(spark, t).collect()} == {"ok": 7.0, "error": 1.0}


def test_retrieval_parts(spark):
    assert retrieval.route("what breaks if I change x") == "impact" and retrieval.route("parse_file") == "exact_lookup" and retrieval.route("tell me more of this") == "hybrid"
    assert retrieval.split_question("What is a? Who calls b?") == ["What is a", "Who calls b"] and len(retrieval.split_question("what is a et comment marche b")) == 2
    assert retrieval.select_within_budget([("a", 5), ("b", 50), ("c", 4)], 10) == ["a", "c"]
    assert retrieval.confidence(True, True, True, True) == 0.95 and retrieval.confidence(False, False, False, False) == 0.2
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(scalars.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]


def test_ewma_first_never_alerts(spark):
    s = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 1.0), ("k", 3, 20.0)], "key string, w int, v double")
    out = [(r["ewma"], r["alert"]) for r in ops.ewma(s, "key", "w", "v").orderBy("w").collect()]
    assert [a for _, a in out] == [False, False, True] and abs(out[1][0] - 7.3) < 1e-9
