import pytest
from pyspark.sql import functions as F

from thicket.operators import health
from thicket.plans import code_queries


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([(f"P:{i}", f"fn_{i}", "A", "function", False, True, False, False, False, 3) for i in range(4)], "id string, name string, project_code string, kind string, tested boolean, is_public boolean, is_nif boolean, is_unsafe boolean, is_entry_point boolean, complexity int")
    e = spark.createDataFrame([("P:0", "P:1", "CALLS"), ("P:1", "P:2", "CALLS")], "source string, target string, rel string")
    return n, e


def test_axes_follow_their_evidence(spark, small, tmp_path):
    n, e = small
    traced = n.where(F.col("id") == "P:1").select("id")
    got = {r["axis"]: r["value"] for r in health.axes(n, e, traced, 1).collect()}
    assert got["duplication"] == 0.75 and got["intent_alignment"] == 0.25
    without = {r["axis"]: r["value"] for r in health.axes(n, e).collect()}
    assert without["duplication"] is None and without["intent_alignment"] is None


def test_the_query_measures_both(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (3, [0.0, 1.0], "x"), (201, [1.0, 0.0], "x")], "vec_id int, embedding array<float>, label string").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(7, 3, 5, 1, "F", "N"), (7, 4, 6, 1, "O", "N"), (7, 1, 9, 1, "F", "N")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    got = code_queries.evidence(spark, d)
    assert got["duplicates"] == 1 and [r["id"] for r in got["traced"].collect()] == ["P:5"]


def test_the_work_list_searches_once(spark, small, monkeypatch):
    n, e = small
    seen = []
    for name in ("strong_components", "cut_points", "covered"):
        f = getattr(health.graph, name)
        monkeypatch.setattr(health.graph, name, lambda *a, _n=name, _f=f: (seen.append(_n), _f(*a))[1])
    rows = health.worklist(n, e, duplicates=0).collect()
    assert sorted(seen) == ["covered", "cut_points", "strong_components"]
    assert ("articulation", "P:1") in {(r["kind"], r["id"]) for r in rows}


def test_the_audit_reads_the_graph_once(spark, small, monkeypatch):
    n, e = small
    made = []
    monkeypatch.setattr(health, "cut", lambda df: (made.append(df), df)[1])
    row = health.audit(n, e).first()
    assert len(made) == 2 and row["cycles"] == row["nif"] == 0
