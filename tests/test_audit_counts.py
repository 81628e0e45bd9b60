import random

import pytest

from thicket.operators import graph, health, smells


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(4)
    kinds, names = ("function", "method", "class", "interface"), ("unwrap", "eval", "plain", "other", None)
    nodes = [(f"n{i}", r.choice(names), r.choice(kinds), r.random() < 0.5, r.random() < 0.1) for i in range(200)] + [("n1", "unwrap", "function", True, True), ("alone", "eval", "function", True, True), (None, "eval", "method", True, True)]
    rels = ("CALLS", "CALLS", "CALLS", "calls", "CALLS_NIF", "IMPORTS", "CONTAINS", "OTHER")
    edges = [(f"n{k * 50 + r.randrange(50)}", f"n{k * 50 + r.randrange(50)}", r.choice(rels)) for k in range(4) for _ in range(70)]
    edges += [(f"n{i}", f"n{i + 1}", "CALLS") for i in range(100, 109)] + [("n100", "n101", "CALLS_NIF"), ("n3", None, "CALLS"), (None, "n4", "CALLS"), ("n5", "n5", "CALLS"), ("n6", None, "CALLS_NIF")]
    return spark.createDataFrame(nodes, "id string, name string, kind string, is_public boolean, is_unsafe boolean"), spark.createDataFrame(edges, "source string, target string, rel string")


def test_counts_are_those_of_the_detectors(made, monkeypatch):
    n, e = made
    want = (smells.circular_dependencies(e).count(), smells.unsafe_exposure(n, e).count(), smells.nif_blocking(n, e).count(), smells.injection_risk(n, e).count())
    assert min(want) > 0
    assert smells.audit_counts(n, e) == want
    monkeypatch.setattr(graph, "TASK_EDGES", 60)
    assert smells.audit_counts(n, e) == want


def test_the_audit_makes_no_rounds_for_small_components(spark, made, monkeypatch):
    n, e = made
    n = n.selectExpr("*", "false AS tested", "1 AS complexity", "false AS is_entry_point")
    monkeypatch.setattr(graph, "strong_components", lambda _: pytest.fail("rounds over the whole graph"))
    monkeypatch.setattr(smells, "_spread", lambda *_: pytest.fail("rounds over the whole graph"))
    assert health.audit(n, e).first()["cycles"] > 0


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_labels_do_not_depend_on_the_way(spark, made, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    n, e = made
    got = {r["id"]: r["component"] for r in graph.components(n.select("id").where("id is not null").distinct(), e).collect()}
    near: dict = {}
    for r in e.collect():
        if r["source"] and r["target"]:
            near.setdefault(r["source"], set()).add(r["target"])
            near.setdefault(r["target"], set()).add(r["source"])
    for i, c in got.items():
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert c == min(seen)
