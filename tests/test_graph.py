import pytest

from thicket.operators import graph, smells

EDGES = [("a", "b", "CALLS"), ("b", "c", "USES"), ("a", "c", "CALLS"), ("c", "d", "CALLS"), ("d", "b", "CALLS"), ("e", "e", "CALLS"), (None, "a", "CALLS"), ("d", "f", "IMPLEMENTS")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, target string, rel string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_impact_keeps_shortest(edges):
    assert rows(graph.impact(edges, "a"), "target_id", "distance", "relation_type") == [("b", 1, "CALLS"), ("c", 1, "CALLS"), ("d", 2, "CALLS"), ("f", 3, "IMPLEMENTS")]
    assert rows(graph.impact(edges, "e"), "target_id", "distance") == [("e", 1)]
    assert rows(graph.impact(edges, "nobody"), "target_id") == []


def test_callers_and_chain(edges):
    assert rows(graph.callers_of(edges, "c"), "caller_id") == [("a",), ("b",)]
    chain = {r["ancestor_id"]: (r["distance"], r["chain"]) for r in graph.why_chain(edges, "d").collect()}
    assert chain == {"c": (1, "CALLS"), "a": (2, "CALLS->CALLS"), "b": (2, "CALLS->USES")}


def test_paths(edges):
    assert [(r["node_id"], r["relation_type"]) for r in graph.shortest_path(edges, "a", "f").orderBy("hop").collect()] == [("a", "CALLS"), ("c", "CALLS"), ("d", "IMPLEMENTS"), ("f", None)]
    assert graph.shortest_path(edges, "f", "a").collect() == []
    assert {r["path_no"] for r in graph.disjoint_paths(edges, "a", "d").collect()} == {1}
    assert graph.reaches(edges, "a", "f") and graph.reaches(edges, "f", "f") and not graph.reaches(edges, "f", "a")


def test_strong_components_and_loops(edges):
    assert rows(graph.strong_components(edges), "id", "component") == [("b", "d"), ("c", "d"), ("d", "d")]
    assert rows(graph.cycles_with_loops(edges, ["calls", "uses"]), "id") == [("b",), ("c",), ("d",), ("e",)]


def test_components_and_cut_points(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), ("d", "e", "x"), ("x", "y", "x")], "source string, target string, rel string")
    nodes = spark.createDataFrame([(c,) for c in "abcdexyz"], "id string")
    assert rows(graph.components(nodes, e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    cut = graph.cut_points(nodes, e).collect()
    assert sorted((r["a"], r["b"]) for r in cut if r["kind"] == "bridge") == [("c", "d"), ("d", "e"), ("x", "y")]
    assert sorted(r["a"] for r in cut if r["kind"] == "articulation") == ["c", "d"]


def test_pagerank_mass(spark, edges):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, iterations=5).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] > ranks["a"]


def test_waves_stop_at_cycles(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("p", "q", "x"), ("q", "p", "x")], "source string, target string, rel string")
    nodes = spark.createDataFrame([(c,) for c in "abcpq"], "id string")
    assert rows(graph.waves(nodes, e), "id", "wave") == [("a", 1), ("b", 2), ("c", 3)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "source string, target string, rel string")
    nodes = spark.createDataFrame([("a",)], "id string")
    assert graph.strong_components(none).count() == 0 and graph.reciprocal(none).count() == 0 and graph.cut_points(nodes, none).count() == 0
    assert rows(graph.components(nodes, none), "id", "component") == [("a", "a")]


NODE = "id string, name string, project_code string, kind string, tested boolean, is_public boolean, is_nif boolean, is_unsafe boolean, is_entry_point boolean, complexity int"


def test_wiring_orphans_worked_case(spark):
    def n(name, public, tested=False):
        return (f"PRJ::app.rs::{name}", name, "PRJ", "function", tested, public, False, False, False, None)

    nodes = spark.createDataFrame([n("run_main", True), n("prod_fn", True), n("opv_case", True), n("isolated_pub", True), n("test_helper", False), n("declared_hook", True), n("a_test", False, True)], NODE)
    i = "PRJ::app.rs::"
    edges = spark.createDataFrame([(i + "run_main", i + "prod_fn", "CALLS"), (i + "a_test", i + "opv_case", "CALLS"), (i + "a_test", i + "test_helper", "CALLS")], "source string, target string, rel string")
    declared = spark.createDataFrame([(i + "declared_hook",)], "id string")
    out = smells.wiring_orphans(nodes, edges, declared).orderBy("state", ascending=False).collect()
    assert [(r["id"], r["state"], r["test_callers"]) for r in out] == [(i + "opv_case", "test_only", 1), (i + "isolated_pub", "isolated", 0)]


def test_phantoms(spark):
    def n(id_, kind="function", nif=False):
        return (id_, id_.split("::")[-1], "P", kind, False, False, nif, False, False, None)

    nodes = spark.createDataFrame([n("P::a::f"), n("P::b::g"), n("P::c::g"), n("P::d::h", "class", True)], NODE)
    e = spark.createDataFrame([("P::a::f", "x::f", "CALLS"), ("P::a::f", "x::g", "CALLS"), ("P::a::f", "x::h", "CALLS_NIF"), ("P::b::g", "P::a::f", "CALLS")], "source string, target string, rel string")
    got = {(r["source"], r["target"], r["resolved"]) for r in graph.resolve_phantoms(nodes, e).collect()}
    assert got == {("P::a::f", "P::a::f", True), ("P::a::f", "x::g", False), ("P::a::f", "P::d::h", True), ("P::b::g", "P::a::f", True)}


def test_call_depths_of_many_components(spark, monkeypatch):
    from thicket.operators import smells

    monkeypatch.setattr(smells, "SEEDS", 3)
    monkeypatch.setattr(smells, "STEP_BYTES", 8)
    # 40 chains of 9 calls with a native call to each of their nodes, a ring of 30, and a call to nobody
    rows = [(f"c{k}-{i}", f"c{k}-{i + 1}", "CALLS") for k in range(40) for i in range(9)] + [("x", f"c{k}-{i}", "CALLS_NIF") for k in range(40) for i in range(10)]
    rows += [(f"r{i}", f"r{(i + 1) % 30}", "CALLS") for i in range(30)] + [("x", "r4", "CALLS_NIF"), ("x", "none", "CALLS_NIF"), ("c0-9", None, "CALLS"), (None, "c0-0", "CALLS")]
    got = {r["id"]: r["depth"] for r in smells.nif_blocking(None, spark.createDataFrame(rows, "source string, target string, rel string")).collect()}
    want = {f"c{k}-{i}": 9 - i + (k == 0) for k in range(40) for i in range(4 + (k == 0))} | {"r4": 20}
    assert got == want
    assert max(got.values()) == 20 and smells.nif_blocking(None, spark.createDataFrame(rows[:1], "source string, target string, rel string")).isEmpty()


def test_sets_of_seeds_are_not_shuffled(spark, monkeypatch):
    # a join of the seeds with the calls would hold every pair of a seed and a node it reaches
    from thicket.operators import smells

    rows = [("x", f"s{i}", "CALLS_NIF") for i in range(200)] + [(f"s{i}", "m0", "CALLS") for i in range(200)] + [(f"m{i}", f"m{i + 1}", "CALLS") for i in range(6)]
    sizes, cut = [], smells.cut
    monkeypatch.setattr(smells, "cut", lambda df: (sizes.append(df.count()), cut(df))[1])
    got = smells.nif_blocking(None, spark.createDataFrame(rows, "source string, target string, rel string")).collect()
    assert len(got) == 200 and {r["depth"] for r in got} == {7} and sizes == [206]
