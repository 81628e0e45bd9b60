"""Structural detectors over nodes and edges of the code graph.

Every detector returns plain rows; listings keep a total order by their columns. A symbol's file is the least source of its
inbound CONTAINS edges; nodes without a file, null flags (false) and empty graphs need no special care.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.operators import graph
from thicket.session import cut

CALLABLE = ("function", "method")
TEST_PATH = r"(^|/)(tests?|scripts)/|_test\.|\.test\.|_spec\.|\.spec\."
VENDOR_PATH = r"node_modules|webpack|\.min\.|/dist/|_build|priv/static|vendor/"
#: Names that end a chain of unsafe or injected input, and calls that write to a console: fixed values.
INJECTION_SINKS = ("eval", "exec", "system", "raw_sql", "query_raw", "popen", "shell")
CONSOLE = ("println!", "dbg!", "console.log", "io.puts", "print", "printf")
DEBT_WORDS = ("todo", "fixme", "secret", "hardcoded credential", "password", "token")


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE)


def files_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, file_id, path of every contained symbol."""
    f = edges.where("rel = 'CONTAINS'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("file_id"))
    return f.join(nodes.select(F.col("id").alias("file_id"), F.col("name").alias("path")), "file_id", "left")


def _calls(edges: DataFrame, *rels: str) -> DataFrame:
    return edges.where(F.col("rel").isin(*(rels or ("CALLS",))))


def _fan(edges: DataFrame, side: str, name: str, *rels: str) -> DataFrame:
    return _calls(edges, *rels).groupBy(F.col(side).alias("id")).agg(F.count("*").alias(name))


def wrappers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Private callables outside tests with exactly one CALLS edge: src, tgt, callers of the callee."""
    out = _calls(edges).groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    own = nodes.where(is_callable(F.col("kind")) & ~F.col("is_public")).join(files_of(nodes, edges), "id", "left").where(~F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)))
    hit = own.select(F.col("id").alias("source"), F.col("name").alias("src")).join(out, "source")
    hit = hit.join(nodes.select(F.col("id").alias("target"), F.col("name").alias("tgt")), "target").join(_fan(edges, "target", "callers").withColumnRenamed("id", "target"), "target", "left")
    return hit.select(F.col("source").alias("id"), "src", "tgt", F.coalesce("callers", F.lit(0)).alias("callers"))


def feature_envy(nodes: DataFrame, edges: DataFrame, least_total: int = 3, least_foreign: int = 2) -> DataFrame:
    """Callables with more calls into other files than into their own: id, dominant (file), foreign, total."""
    f = files_of(nodes, edges).select("id", "file_id")
    c = _calls(edges).join(f.select(F.col("id").alias("target"), F.col("file_id").alias("tf")), "target").join(f.select(F.col("id").alias("source"), F.col("file_id").alias("sf")), "source", "left")
    c = c.join(nodes.where(is_callable(F.col("kind"))).select(F.col("id").alias("source")), "source", "left_semi")
    away = ~F.col("tf").eqNullSafe(F.col("sf"))
    per = c.groupBy("source", "tf").agg(F.count("*").alias("n"), F.max(away).alias("away"))
    return per.groupBy(F.col("source").alias("id")).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("away"), F.col("n"))), F.lit(0)).alias("foreign"), F.max(F.when(F.col("away"), F.struct("n", "tf")))["tf"].alias("dominant")
    ).where((F.col("total") >= least_total) & (F.col("foreign") >= least_foreign) & (F.col("foreign") > F.col("total") - F.col("foreign")))


def god_names(nodes: DataFrame, edges: DataFrame, least: int = 20) -> DataFrame:
    """Any node that calls at least so many distinct targets: id, name, fan_out."""
    out = _calls(edges).groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("fan_out")).where(F.col("fan_out") >= least)
    return nodes.where((F.length("name") >= 3) & ~F.col("name").rlike(VENDOR_PATH)).join(out, "id").select("id", "name", "fan_out")


def god_objects(nodes: DataFrame, edges: DataFrame, complexity: int = 10, fan_out: int = 10) -> DataFrame:
    """Complex nodes that call much, natively or not; unknown complexity is never one."""
    out = _fan(edges, "source", "fan_out", "CALLS", "CALLS_NIF").where(F.col("fan_out") > fan_out)
    return nodes.where(F.col("complexity") > complexity).join(out, "id").select("id", "complexity", "fan_out")


def orphan_code(nodes: DataFrame, edges: DataFrame, traced: DataFrame | None = None) -> DataFrame:
    """Distinct names of private untested callables outside tests that nothing calls (and, if given, nothing traces)."""
    own = nodes.where(is_callable(F.col("kind")) & ~F.col("is_public") & ~F.col("tested")).join(files_of(nodes, edges), "id", "left")
    own = own.where(~F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False))).join(_calls(edges).select(F.col("target").alias("id")), "id", "left_anti")
    return (own if traced is None else own.join(traced, "id", "left_anti")).select("name").distinct()


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As orphan_code, but nothing calls natively either and the symbol has a file: id."""
    own = nodes.where(is_callable(F.col("kind")) & ~F.col("is_public") & ~F.col("tested")).join(files_of(nodes, edges), "id")
    return own.where(~F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False))).join(_calls(edges, "CALLS", "CALLS_NIF").select(F.col("target").alias("id")), "id", "left_anti").select("id")


def _spread(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Which seeds reach each node over steps(at, next) within a depth: at, word, bits. seeds: id.

    Seeds are numbered and held as bits, 64 to a row, so a round joins and aggregates one row for 64 pairs; a round carries only bits that are new to
    their node.
    """
    word = seeds.select("at", F.expr("int(n div 64)").alias("word"), F.expr("shiftleft(1L, int(n % 64))").alias("bits"))
    seen = frontier = cut(word.groupBy("at", "word").agg(F.bit_or("bits").alias("bits")))
    for _ in range(depth):
        step = frontier.join(steps, "at").groupBy(F.col("next").alias("at"), "word").agg(F.bit_or("bits").alias("got"))
        both = cut(seen.join(step, ["at", "word"], "full").select("at", "word", F.coalesce("bits", F.lit(0).cast("long")).alias("old"), F.coalesce("got", F.lit(0).cast("long")).alias("got")))
        seen = both.select("at", "word", F.col("old").bitwiseOR(F.col("got")).alias("bits"))
        frontier = both.select("at", "word", F.expr("got & ~old").alias("bits")).where("bits <> 0")
        if frontier.isEmpty():
            break
    return seen


def _numbered(ids: DataFrame) -> DataFrame:
    """id, n: numbers from 0 without gaps per bucket; buckets of hashes keep the numbering parallel."""
    b = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("b"))
    w = Window.partitionBy("b").orderBy("id")
    # the number within its bucket times 64 and the bucket: rows of one word then belong to one rank
    return b.select("id", ((F.row_number().over(w) - 1) * 64 + F.col("b")).cast("long").alias("n"))


def exposure(nodes: DataFrame, edges: DataFrame, sinks: DataFrame, depth: int = 10) -> DataFrame:
    """Pairs of a public callable and a sink it reaches over CALLS within a depth: source, sink. Sets of sinks go backward as bits."""
    back = _calls(edges).select(F.col("target").alias("at"), F.col("source").alias("next")).distinct()
    numbers = cut(_numbered(sinks.select("id").distinct()))
    seen = _spread(back, numbers.select(F.col("id").alias("at"), "n"), depth)
    public = nodes.where(is_callable(F.col("kind")) & F.col("is_public")).select(F.col("id").alias("at"))
    held = seen.join(public, "at", "left_semi").select(F.col("at").alias("source"), "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("bits"), k) == 1)).alias("k"))
    return held.withColumn("n", (F.col("word") * 64 + F.col("k")).cast("long")).join(numbers.withColumnRenamed("id", "sink"), "n").where("source <> sink").select("source", "sink")


def unsafe_exposure(nodes: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    return exposure(nodes, edges, nodes.where(F.col("is_unsafe") | (F.col("name") == "unwrap")), depth)


def injection_risk(nodes: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    return exposure(nodes, edges, nodes.where(F.lower("name").isin(*INJECTION_SINKS)), depth)


#: Seeds searched with one copy of a component's edges, and bytes of the words that one step of a search gathers.
SEEDS, STEP_BYTES = 16_384, 1 << 26


def depths(at: np.ndarray, to: np.ndarray, n: int, seeds: np.ndarray, depth: int) -> np.ndarray:
    """The hop, at most depth, at which the last node is first reached from each seed, over edges of nodes 0 to n - 1. A word holds 64 seeds."""
    order = np.argsort(to, kind="stable")
    at, to = at[order], to[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
    ends, out = to[first], np.zeros(len(seeds), dtype=np.int32)
    words = max(1, STEP_BYTES // 8 // max(1, len(at)))
    for begin in range(0, len(seeds) if len(to) else 0, 64 * words):
        own = seeds[begin : begin + 64 * words]
        k = np.arange(len(own))
        new = np.zeros((n, -(-len(own) // 64)), dtype=np.uint64)
        np.bitwise_or.at(new, (own, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        seen = new.copy()
        for hop in range(1, depth + 1):
            got = np.bitwise_or.reduceat(new[at], first, axis=0) & ~seen[ends]
            some = np.bitwise_or.reduce(got, axis=0)
            if not some.any():
                break
            out[begin + np.flatnonzero((some[k // 64] >> (k % 64).astype(np.uint64)) & np.uint64(1))] = hop
            seen[ends] |= got
            new[:] = 0
            new[ends] = got
    return out


def nif_blocking(nodes: DataFrame, edges: DataFrame, report: int = 5, depth: int = 20) -> DataFrame:
    """Targets of native calls whose call chains go deeper than report: id, depth (the hop at which the last node is first reached).

    No chain leaves its weak component, so each component's edges go to one task, or to one for each SEEDS targets, which searches from 64 targets
    at a time: nothing but edges is shuffled. A task holds the edges of its component.
    """
    e = cut(_calls(edges).where("source is not null").select("source", "target").distinct())
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).where("id is not null").distinct()
    part = graph.components(ends, e)
    seeds = edges.where("rel = 'CALLS_NIF'").select(F.col("target").alias("id")).distinct().join(part, "id")
    parts = seeds.groupBy("component").agg(F.ceil(F.count("*") / SEEDS).cast("int").alias("parts"))
    own = e.join(part.withColumnRenamed("id", "source"), "source").join(parts, "component")
    own = own.select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "source", "target", F.lit(False).alias("seed"))
    seeds = seeds.join(parts, "component").select("component", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("seed"))

    def search(t: pa.Table) -> pa.Table:
        seed = t["seed"].combine_chunks()
        calls, first = t.filter(pc.invert(seed)), t.filter(seed)["source"].combine_chunks()
        # a null target is a node without calls
        ids = pa.chunked_array([*calls["source"].chunks, *calls["target"].chunks, first], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, n = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), calls.num_rows
        deep = depths(codes[:n], codes[n : 2 * n], len(ids.dictionary), codes[2 * n :], depth)
        keep = np.flatnonzero(deep > report)
        return pa.table({"id": first.take(pa.array(keep)), "depth": pa.array(deep[keep], pa.int32())})

    return own.unionByName(seeds).groupBy("component", "part").applyInArrow(search, "id string, depth int")


def exposed(at: np.ndarray, to: np.ndarray, n: int, sinks: np.ndarray, public: np.ndarray, depth: int) -> int:
    """The number of pairs of exposure, sinks searched backward over edges of nodes 0 to n - 1. public: the nodes that count."""
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    ends, total = at[first], 0
    words = max(1, STEP_BYTES // 8 // max(1, len(at)))
    for begin in range(0, len(sinks) if len(at) else 0, 64 * words):
        own = sinks[begin : begin + 64 * words]
        k = np.arange(len(own))
        new = np.zeros((n, -(-len(own) // 64)), dtype=np.uint64)
        np.bitwise_or.at(new, (own, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        seen = new.copy()
        for _ in range(depth):
            got = np.bitwise_or.reduceat(new[to], first, axis=0) & ~seen[ends]
            if not got.any():
                break
            seen[ends] |= got
            new[:] = 0
            new[ends] = got
        total += int(np.bitwise_count(seen[public]).sum()) - int(np.isin(own, public).sum())
    return total


def audit_counts(nodes: DataFrame, edges: DataFrame, depth: int = 10, report: int = 5, nif_depth: int = 20) -> tuple[int, int, int, int]:
    """The numbers of rows of circular_dependencies, unsafe_exposure, nif_blocking and injection_risk.

    No cycle or chain leaves its weak component, so one pass takes each component to a task; components of more than TASK_EDGES edges or SEEDS
    sinks, targets and public callables are left to the four detectors.
    """
    bit = lambda c, k: F.when(c, F.lit(k)).otherwise(F.lit(0))
    unsafe, injected = F.col("is_unsafe") | (F.col("name") == "unwrap"), F.lower("name").isin(*INJECTION_SINKS)
    flags = nodes.select("id", (bit(is_callable(F.col("kind")) & F.col("is_public"), 1) + bit(unsafe, 2) + bit(injected, 4)).alias("flag")).where("flag <> 0")
    flags = flags.unionByName(edges.where("rel = 'CALLS_NIF'").select(F.col("target").alias("id"), F.lit(8).alias("flag")).distinct()).where("id is not null")
    flags = flags.groupBy("id").agg(F.bit_or("flag").alias("flag"))
    e = graph.of_relations(edges, graph.CYCLE_RELATIONS).where("source is not null")
    e = cut(e.groupBy("source", "target").agg(F.max(F.col("rel") == "CALLS").cast("int").alias("flag")))
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).where("id is not null").distinct()
    part = cut(graph.components(ends, e))
    rows = e.join(part.withColumnRenamed("id", "source"), "source").select("component", "source", "target", "flag", F.lit(True).alias("edge"))
    rows = rows.unionByName(flags.join(part, "id").select("component", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), "flag", F.lit(False).alias("edge")))
    big = rows.groupBy("component").agg(F.count_if("edge").alias("e"), F.count_if(~F.col("edge") & (F.col("flag") > 1)).alias("s")).where((F.col("e") > graph.TASK_EDGES) | (F.col("s") > SEEDS)).select("component")
    big = cut(big)

    def count(t: pa.Table) -> pa.Table:
        edge, flag = t["edge"].to_numpy(zero_copy_only=False), t["flag"].to_numpy()
        # a null target is a node without calls
        ids = pa.chunked_array([*t["source"].chunks, *t["target"].chunks], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, n = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(ids.dictionary)
        at, to = codes[: len(t)], codes[len(t) :]
        real = edge & t["target"].is_valid().to_numpy(zero_copy_only=False)
        calls = edge & (flag == 1)
        cycles = sum(s > 1 for s in graph.strong_sizes(at[real & (at != to)], to[real & (at != to)], n))
        of = lambda k: at[~edge & (flag & k > 0)]
        risk = [exposed(at[calls & real], to[calls & real], n, of(k), of(1), depth) for k in (2, 4)]
        nif = int((depths(at[calls], to[calls], n, of(8), nif_depth) > report).sum())
        return pa.table({k: pa.array([v], pa.int64()) for k, v in (("cycles", cycles), ("unsafe", risk[0]), ("nif", nif), ("injection", risk[1]))})

    small = rows if big.isEmpty() else rows.join(big, "component", "left_anti")
    got = small.groupBy("component").applyInArrow(count, "cycles long, unsafe long, nif long, injection long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("cycles", "unsafe", "nif", "injection")]).first()
    if big.isEmpty():
        return tuple(got)
    rest = cut(edges.join(part.join(big, "component", "left_semi").select(F.col("id").alias("source")), "source", "left_semi"))
    more = (circular_dependencies(rest), unsafe_exposure(nodes, rest, depth), nif_blocking(nodes, rest, report, nif_depth), injection_risk(nodes, rest, depth))
    return tuple(a + b.count() for a, b in zip(got, more, strict=True))


def security_audit(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Callers within two hops of unsafe, eval or unwrap: findings (at most `most` count) and the score max(0, 100 - 20 n)."""
    seeds = nodes.where(F.col("is_unsafe") | F.lower("name").isin("eval", "unwrap")).select("id")
    back = graph.reversed_edges(_calls(edges, "CALLS", "CALLS_NIF"))
    n = graph.two_hops(back, seeds).where("distance > 0").agg(F.least(F.count("*"), F.lit(most)).alias("findings"))
    return n.select("findings", F.greatest(F.lit(0), 100 - 20 * F.col("findings")).alias("score"))


def technical_debt(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with a file whose name tells of debt or that call unwrap or eval: id, reason."""
    word = F.lit(None).cast("string")
    for w in reversed(DEBT_WORDS):
        word = F.when(F.lower("name").contains(w), F.lit(w)).otherwise(word)
    named = nodes.select("id", word.alias("reason")).where("reason is not null")
    bad = nodes.where(F.col("name").isin("unwrap", "eval")).select(F.col("id").alias("target"), F.col("name").alias("reason"))
    calling = _calls(edges).join(bad, "target").select(F.col("source").alias("id"), F.concat(F.lit("calls "), "reason").alias("reason"))
    return named.unionByName(calling).distinct().join(files_of(nodes, edges), "id", "left_semi")


def telemetry_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls to the console and the score max(0, 100 - 5 n)."""
    talk = nodes.where(F.lower("name").isin(*CONSOLE)).select(F.col("id").alias("target"))
    n = _calls(edges).join(talk, "target", "left_semi").agg(F.count("*").alias("calls"))
    return n.select("calls", F.greatest(F.lit(0), 100 - 5 * F.col("calls")).alias("score"))


def coverage_score(nodes: DataFrame) -> DataFrame:
    """By project: symbols, tested ones and the whole-number share of 100."""
    s = nodes.where("kind <> 'file'").groupBy("project_code").agg(F.count("*").alias("total"), F.count_if("tested").alias("tested"))
    return s.withColumn("score", F.floor(100 * F.col("tested") / F.col("total")).cast("int"))


def detours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Private callables with one caller and one callee, all in one file outside tests, the ends distinct: src, mid, dst."""
    c = _calls(edges)
    one_in = c.groupBy(F.col("target").alias("mid")).agg(F.count("*").alias("n"), F.min("source").alias("src")).where("n = 1").drop("n")
    one_out = c.groupBy(F.col("source").alias("mid")).agg(F.count("*").alias("n"), F.min("target").alias("dst")).where("n = 1").drop("n")
    f = files_of(nodes, edges).where(~F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False))).select("id", "file_id")
    mid = nodes.where(is_callable(F.col("kind")) & ~F.col("is_public")).select(F.col("id").alias("mid"))
    hit = mid.join(one_in, "mid").join(one_out, "mid").where("src <> dst")
    for name in ("src", "mid", "dst"):
        hit = hit.join(f.select(F.col("id").alias(name), F.col("file_id").alias("f_" + name)), name)
    return hit.where("f_src = f_mid and f_mid = f_dst").select("src", "mid", "dst")


def abstraction_detours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces with exactly one implementing type by name in the same file: interface, implementation."""
    f = files_of(nodes, edges).select("id", "file_id")
    i = nodes.where("kind = 'interface'").join(f, "id").select("file_id", F.col("id").alias("interface"), F.lower("name").alias("i"))
    c = nodes.where(F.col("kind").isin("class", "struct", "module")).join(f, "id").select("file_id", F.col("id").alias("implementation"), F.lower("name").alias("c"))
    hit = i.join(c, "file_id").where((F.col("c") == F.concat("i", F.lit("impl"))) | (F.col("c") == F.concat("i", F.lit("_impl"))) | (F.col("c").startswith(F.col("i")) & F.col("c").contains("adapter")))
    return hit.groupBy("interface").agg(F.count("*").alias("n"), F.min("implementation").alias("implementation")).where("n = 1").drop("n")


def _with_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    f = files_of(nodes, edges)
    c = _calls(edges).select("source", "target")
    return c.join(f.select(F.col("id").alias("source"), F.col("path").alias("sp"), F.col("file_id").alias("sf")), "source").join(f.select(F.col("id").alias("target"), F.col("path").alias("tp"), F.col("file_id").alias("tf")), "target")


def domain_leakage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls from a file of the domain into one of the infrastructure."""
    return _with_paths(nodes, edges).where(F.lower("sp").contains("domain") & F.lower("tp").contains("infra")).select("source", "target", F.col("sp").alias("source_path"), F.col("tp").alias("target_path"))


def cross_file_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between different files, by pair of files: source_path, target_path, calls."""
    return _with_paths(nodes, edges).where("sf <> tf").groupBy(F.col("sp").alias("source_path"), F.col("tp").alias("target_path")).agg(F.count("*").alias("calls"))


def phantom_data(edges: DataFrame) -> DataFrame:
    """Phantom targets read but never declared (dead), or declared by more than one source (multi): id, issue."""
    p = edges.where(F.col("target").contains("::phantom::"))
    g = p.groupBy(F.col("target").alias("id")).agg(F.count_if(F.col("rel") == "READS").alias("r"), F.countDistinct(F.when(F.col("rel") == "DECLARES", F.col("source"))).alias("d"))
    return g.select("id", F.when((F.col("r") > 0) & (F.col("d") == 0), "dead").when(F.col("d") > 1, "multi").alias("issue")).where("issue is not null")


def symbols_in_files(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """Symbols contained in files whose name holds the %-separated parts of a pattern in their order."""
    like = "%" + pattern.strip("%") + "%"
    return files_of(nodes, edges).where(F.col("path").like(like)).select("id", "path")


def bare_name(c: str) -> Column:
    """The last part of an id."""
    return F.element_at(F.split(F.col(c), "::"), -1)


def phantom_calls(edges: DataFrame) -> DataFrame:
    """Distinct calls whose target no file contains: source, target. They stand for calls whose receiver is only known when they run."""
    held = edges.where("rel = 'CONTAINS'").select("target").distinct()
    return _calls(edges, "CALLS", "CALLS_NIF").select("source", "target").distinct().join(held, "target", "left_anti").select("source", "target")


def in_trait_files(edges: DataFrame) -> DataFrame:
    """Symbols of a file that also contains one which implements something: id."""
    f = edges.where("rel = 'CONTAINS'").select("source", "target").distinct()
    traits = f.join(edges.where("rel = 'IMPLEMENTS'").select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source").distinct()
    return f.join(traits, "source", "left_semi").select(F.col("target").alias("id")).distinct()


def wiring_orphans(nodes: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Public callables outside tests that production code never calls: id, state (test_only before isolated), test_callers.

    One that nobody calls by itself, in a file with an implementation, also has the callers of phantoms of its bare name.
    """
    own = nodes.where(is_callable(F.col("kind")) & F.col("is_public") & ~F.col("tested") & ~F.col("is_entry_point") & ~F.col("name").isin("main", "run_main"))
    if declared is not None:
        own = own.join(declared, "id", "left_anti")
    own = own.join(files_of(nodes, edges), "id", "left").where(~F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)))
    from_node = nodes.select(F.col("id").alias("source"), "tested")
    count = (F.count_if(~F.col("tested")), F.count_if("tested"))
    c = _calls(edges, "CALLS", "CALLS_NIF").select("source", "target").distinct().join(from_node, "source")
    fan = c.groupBy(F.col("target").alias("id")).agg(count[0].alias("prod"), count[1].alias("test_callers"))
    hit = own.join(fan, "id", "left").where(F.coalesce("prod", F.lit(0)) == 0).withColumn("bare", bare_name("id"))
    lost = phantom_calls(edges).join(from_node, "source").groupBy(bare_name("target").alias("bare")).agg(count[0].alias("phantom_prod"), count[1].alias("phantom_tests"))
    named = hit.select("id", "bare").join(lost, "bare").join(in_trait_files(edges), "id", "left_semi").drop("bare")
    hit = hit.join(named, "id", "left").where(F.coalesce("phantom_prod", F.lit(0)) == 0)
    n = F.coalesce("test_callers", F.lit(0)) + F.coalesce("phantom_tests", F.lit(0))
    return hit.select("id", F.when(n > 0, "test_only").otherwise("isolated").alias("state"), n.alias("test_callers"))


def circular_dependencies(edges: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """Strong components over dependency relations (strong, where they are known): component, size, and the least member."""
    strong = graph.strong_components(graph.of_relations(edges, graph.CYCLE_RELATIONS)) if strong is None else strong
    return strong.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("least_member"))


def invariants(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Violations of declared invariants: rule, source, target.

    A rule has id, mode (forbidden: every matching edge; required: every source without one), source and target matchers
    ({"prefix": ...} of the name, {"kind": ...} or {} for any) and relations (empty for any).
    """
    out = None
    for r in rules:
        match = lambda m: (F.col("name").startswith(m["prefix"]) if "prefix" in m else F.col("kind") == m["kind"] if "kind" in m else F.lit(True))
        s = nodes.where(match(r.get("source", {}))).select(F.col("id").alias("source"))
        t = nodes.where(match(r.get("target", {}))).select(F.col("id").alias("target"))
        hit = graph.of_relations(edges, r.get("relations") or None).select("source", "target").join(s, "source", "left_semi").join(t, "target", "left_semi")
        rows = hit.select("source", "target") if r["mode"] == "forbidden" else s.join(hit, "source", "left_anti").select("source", F.lit(None).cast("string").alias("target"))
        rows = rows.select(F.lit(r["id"]).alias("rule"), "source", "target")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no rules")
    return out


def dead_clusters(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of candidates no root reaches; and roots, candidates, reached, wiring coverage (0 when empty).

    Ways go over calls, from a contract to its implementors (the first BRIDGE_FANOUT of each), and from a reached phantom to the candidates of its bare
    name in files with an implementation.
    """
    calls = _calls(edges, "CALLS", "CALLS_NIF").select("source", "target", "rel")
    implements = edges.where("rel = 'IMPLEMENTS'")
    bridge = graph.with_contract_bridge(implements).join(implements.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", "rel")
    lost = phantom_calls(edges).select("target", bare_name("target").alias("bare")).distinct()
    named = candidates.select("id", bare_name("id").alias("bare")).join(in_trait_files(edges), "id", "left_semi")
    by_name = lost.join(named, "bare").select(F.col("target").alias("source"), F.col("id").alias("target"), F.lit("NAME").alias("rel"))
    got = graph.reach(calls.unionByName(bridge).unionByName(by_name), roots, None, keep_seeds=True).select("id")
    dead = candidates.select("id").join(got, "id", "left_anti")
    total, reached = candidates.count(), candidates.select("id").join(got, "id", "left_semi").count()
    summary = candidates.sparkSession.createDataFrame([(roots.count(), total, reached, reached / total if total else 0.0)], "roots long, candidates long, reached long, wiring_coverage double")
    return graph.clusters(dead, edges), summary


def change_safety(nodes: DataFrame, traced: DataFrame) -> DataFrame:
    """id, safety: tested is safe, traced is caution, else unsafe."""
    t = traced.select("id").distinct().withColumn("t", F.lit(True))
    return nodes.join(t, "id", "left").select("id", F.when(F.col("tested"), "safe").when(F.col("t"), "caution").otherwise("unsafe").alias("safety"))


def first_rows(df: DataFrame, by: list[Column], key: list[str]) -> DataFrame:
    """One row per key, the first by a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_k = 1").drop("_k")
