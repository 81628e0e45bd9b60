"""Small fixtures with nulls, ties, empty tables and hostile texts for the newer operators."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thicket.functions import fts, sqlgate, tables
from thicket.operators import context, governance, graph, ops, relational, smells
from thicket.sources import ingest, publication
from thicket.streaming import flows


class State:
    """The part of a group state the debouncer uses, with a clock of its own."""

    def __init__(self):
        self.value, self.hasTimedOut, self.now, self.timeout = None, False, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = self.now + ms


def test_debounce_state_agrees_with_the_pure_form():
    events = [(0, "modify"), (100, "modify"), (200, "delete"), (300, "modify"), (700, "modify"), (2000, "create")]
    state, out, todo = State(), [], list(events)
    while todo or state.timeout is not None:
        if state.timeout is not None and (not todo or state.timeout <= todo[0][0]):
            state.now, state.hasTimedOut, state.timeout = state.timeout, True, None
            rows = flows.debounce_step(("p",), [], state, 500)
        else:
            t, kind = todo.pop(0)
            state.now, state.hasTimedOut = t, False
            rows = flows.debounce_step(("p",), [pd.DataFrame({"kind": [kind], "ts": [t]})], state, 500)
        for frame in rows:
            out += [(state.now / 1000, k) for k in frame["kind"].tolist()]
    assert out == flows.debounce_events([(t / 1000, k) for t, k in events], 0.5)


def test_upsert_adds_up_and_never_loses_the_pointer(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    mk = lambda rows: spark.createDataFrame(rows, "id string, at long, n long")
    publication.upsert(spark, t, mk([("a", 1, 5), ("a", 2, 7)]), ["id"], "at", add=("n",))
    publication.upsert(spark, t, mk([("a", 1, 1), ("b", 1, None)]), ["id"], "at", add=("n",))
    assert {r["id"]: (r["at"], r["n"]) for r in publication.current(spark, t).collect()} == {"a": (2, 13), "b": (1, None)}


def test_bisect_leaves_only_what_fails():
    written = []

    def write(rows):
        if any(r % 7 == 0 for r in rows):
            raise ValueError
        written.extend(rows)

    assert publication.bisect_bad(list(range(1, 30)), write) == [7, 14, 21, 28] and sorted(written) == [r for r in range(1, 30) if r % 7]


def test_chunks_are_of_least_cost():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 9)
        sizes, clean = [r.randrange(110, 300) for _ in range(n)], [r.random() < 0.5 for _ in range(n)]

        def cost(cuts):
            edges = [0, *cuts, n]
            total = 0
            for a, b in itertools.pairwise(edges):
                size = sum(sizes[a:b])
                if size > 512 and b - a > 1:
                    return float("inf")
                total += 0 if b == n else max(0, 512 - size) ** 2 + (0 if clean[b] else 512 * 512 / 4)
            return total

        best = min(cost(c) for k in range(n) for c in itertools.combinations(range(1, n), k))
        got = ingest.break_lines(sizes, clean, 512)
        assert got[0][0] == 0 and got[-1][1] == n and cost([a for a, _ in got[1:]]) == best
    for text in ("", "x", "\n\n", "a\r\nb\r\n", "y" * 5000 + "\nz", "é\u2028b\n" * 3):
        assert "".join(t for *_, t in ingest.chunk_text(text, 64)) == text


def test_ingest_edges(spark):
    f = spark.createDataFrame([("a.py", "def f(x):\n    pass\nclass B:\n"), ("b.py", None), ("c.txt", "def no():"), ("d.rs", ""), (None, "x"), ("e.js", "var a;" * 500), ("g.go", "// Code generated by x. DO NOT EDIT.\nfunc F() {}\n"), ("z.py", "a\x00b")], "path string, content string")
    assert {r["path"]: r["state"] for r in ingest.prepare(f).collect()} == {"a.py": "ready", "b.py": "missing", "c.txt": "ready", "d.rs": "empty", None: "ready", "e.js": "minified", "g.go": "generated", "z.py": "binary"}
    assert {(r["path"], r["line"], r["name"], r["kind"]) for r in ingest.symbols(f).collect()} == {("a.py", 1, "f", "function"), ("a.py", 3, "B", "class"), ("g.go", 2, "F", "function")}
    assert ingest.chunk_files(f.limit(0)).count() == 0 and ingest.embed(f, "path", "content", 8).where("embedding is null").count() == 1
    with pytest.raises(Exception, match="vectors of 8"):
        ingest.embed(f, "path", "content", 8, lambda texts: [[0.0]] * len(texts)).collect()


def test_index_batches_are_idempotent(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "id string, text string")
    df.write.parquet(src)
    stream = ingest.admitted(spark, src, "id string, text string", 1 << 30)
    ingest.index_batches(stream, f"{tmp_path}/out", "id", {"text": "B"}, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["id"], r["lexeme"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "one"), ("a", "two")}


def test_full_text(spark):
    d = spark.createDataFrame([(1, "a b a", "t"), (2, None, "a"), (3, "b x x a", None), (4, "", "")], "id int, body string, title string")
    v = fts.vectors(d, "id", {"title": "A", "body": "B"}, "simple")
    assert {r["id"] for r in fts.matches(v, ["a", "b"]).collect()} == {1, 3} and {r["id"] for r in fts.matches(v, ["a", "b"], every=False).collect()} == {1, 2, 3}
    got = {r["id"]: r["score"] for r in fts.cover_rank(v, ["a", "b"]).collect()}
    assert got[1] == pytest.approx(0.8) and got[3] == pytest.approx(0.4 / 3)
    rank = {r["id"]: r["score"] for r in fts.rank(v, ["a"]).collect()}
    assert rank[2] == pytest.approx(1 / fts.LIMIT) and rank[1] == pytest.approx((0.4 + 0.1) / fts.LIMIT)
    assert fts.query_terms(spark, "Snapshots of the quotas", stop=("of", "the")) == ["quota", "snapshot"]


def test_table_functions(spark):
    tables.register(spark, spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "it's", "USES")], "source string, target string, rel string"))
    assert tables.arguments("'it''s', 3, null, -1.5") == ["it's", 3, None, -1.5] and tables.arguments(" ") == []
    assert {r[0] for r in tables.run(spark, "select target_id from impact('a', 2) where distance > :d", {"d": 0}).collect()} == {"b", "c"}
    assert tables.run(spark, "select count(*) from ist.callers_of('it''s') c join impact('a', 5) i on i.target_id = c.caller_id").first()[0] == 1
    assert [r["node_id"] for r in tables.run(spark, "select * from path('a', 'c') order by hop").collect()] == ["a", "b", "c"]
    with pytest.raises(PermissionError):
        tables.run(spark, "delete from impact('a')")
    assert sqlgate.named("select $a, '$b', x$c") == "select :a, '$b', x$c"


def test_pages_and_prefixes(spark):
    d = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert [(r["id"], r["has_more"]) for r in relational.page(d, [F.col("id")], 3, 2).collect()] == [(3, False), (4, False)]
    assert [(r["id"], r["has_more"]) for r in relational.page(d, [F.col("id")], 0, 2).collect()] == [(0, True), (1, True)]
    assert relational.page(d, [F.col("id")], 9, 2).count() == 0
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 3, 1)], "k string, o int, n int")
    assert [r["o"] for r in context.fits(rows, ["k"], [F.col("o")], "n", F.lit(11)).collect()] == [1, 2]


def test_as_of_edges(spark):
    a = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), (None, 5, "z"), ("q", 1, "w")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 5, 1.0), ("k", 5, 2.0), ("k", 3, 7.0), (None, 1, 9.0)], "k string, s int, price double")
    assert {r["v"]: r["price"] for r in relational.as_of(a, b, "k", "t", "s", "price").collect()} == {"x": 2.0, "y": None, "z": None, "w": None}


def test_percentiles_against_sorting(spark):
    r = random.Random(1)
    rows = [("hot", float(r.randrange(50))) for _ in range(500)] + [("one", 3.0), ("none", None)]
    got = {x["tool"]: (x["p50"], x["p95"]) for x in ops.nearest_rank_latency(spark.createDataFrame(rows, "tool string, latency_ms double"), ["tool"], [50, 95]).collect()}
    s = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (s[249], s[474]), "one": (3.0, 3.0)}


def test_exposure_bits_over_a_word(spark):
    """More than 64 sinks, ways through other sinks, a cycle and the depth."""
    n = [(f"s{i}", "x", "function", False, True) for i in range(130)] + [(f"p{i}", "x", "function", True, False) for i in range(4)]
    e = [("p0", f"s{i}", "CALLS") for i in range(130)] + [("p1", "p0", "CALLS"), ("p0", "p1", "CALLS"), ("p2", "p1", "CALLS"), ("p3", "p2", "USES")]
    nodes = spark.createDataFrame(n, "id string, name string, kind string, is_public boolean, is_unsafe boolean")
    edges = spark.createDataFrame(e, "source string, target string, rel string")
    got = {k: c for k, c in smells.unsafe_exposure(nodes, edges, 2).groupBy("source").count().collect()}
    assert got == {"p0": 130, "p1": 130}
    assert smells.unsafe_exposure(nodes.limit(0), edges.limit(0)).count() == 0


def test_patterns_must_be_connected_and_bridges_are_cut(spark):
    e = spark.createDataFrame([(f"i{k:02d}", "t", "IMPLEMENTS") for k in range(40)] + [("a", "b", "CALLS")], "source string, target string, rel string")
    with pytest.raises(ValueError, match="connected"):
        graph.subgraph_matches([("a", "b"), ("c", "d")], e)
    got = graph.with_contract_bridge(e).where("source = 't'").select("target").collect()
    assert sorted(r[0] for r in got) == [f"i{k:02d}" for k in range(32)]


def test_governance_edges(spark):
    assert governance.diff_paths("--- a/x\n+++ /dev/null\n+++ b/y\n+++ b/y\n--- /dev/null\n") == ["x", "y"]
    chunks = spark.createDataFrame([("s", "symbol", "r/x.py"), (None, "symbol", "r/x.py"), ("t", "file", "r/x.py"), ("u", "symbol", None)], "source_id string, source_type string, file_path string")
    assert [tuple(r) for r in governance.symbols_of_diff("+++ b/x.py", chunks).collect()] == [("x.py", "s")] and governance.symbols_of_diff("", chunks).count() == 0
    s = spark.createDataFrame([("P::a::f", "f"), ("P::b::f", "f"), ("f2", "g"), ("f2", "g")], "id string, name string")
    assert [(r["id"], r["homonym"]) for r in governance.resolve(s, "f").orderBy("homonym").collect()] == [("P::a::f", False), ("P::b::f", True)]
    assert [tuple(r) for r in governance.resolve(s, "f2").collect()] == [("f2", False, False)] and governance.resolve(s, "none").count() == 0
    t = spark.createDataFrame([("m", "# x\n- **REQ-1** [current] do it\r\n* **DEC-2** plain\n- **bad** no\n"), ("n", None)], "path string, text string")
    assert {(r["id"], r["status"], r["title"], r["line"]) for r in governance.parse_intents(t).collect()} == {("REQ-1", "current", "do it", 2), ("DEC-2", None, "plain", 3)}
    tree = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    ids = spark.createDataFrame([(i,) for i in "abcxy"], "id string")
    seal = {r["id"]: r["seal"] for r in governance.seals(ids, tree, F.col("id")).collect()}
    assert set(seal) == {"a", "b", "c"} and len({*seal.values()}) == 3
    assert context.ann_plan(10, 10)["exact"] and context.ann_plan(10**6, 10, 5000) == {"exact": False, "ef": 1000, "candidates": 30}
    assert context.negation_judge("the quota is rebuilt", ["the quota is not rebuilt", "the quota is rebuilt", ""]) == [1.0, -1.0, 0.0]
