"""Graph operators over edges(source, target, rel) and nodes(id, ...).

Traversals keep one row per reached node, never paths: a hop joins the frontier with the edges, drops what was
reached before by an anti join and keeps the best row of each target. Every hop is cut with a reliable checkpoint, so
the lineage stays short and a lost executor costs one hop. Null endpoints never match; self-loops never reach
anything new; parallel edges count once unless said otherwise; an empty graph gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from thicket.session import cut

#: Relations that make a dependency for cycles, and those that couple modules: fixed values.
CYCLE_RELATIONS = ("CALLS", "CALLS_NIF", "IMPORTS", "IMPLEMENTS", "USES", "READS")
COUPLING_RELATIONS = (*CYCLE_RELATIONS, "READS_ARTIFACT")
BRIDGE_FANOUT = 32


def of_relations(edges: DataFrame, rels: Iterable[str] | None) -> DataFrame:
    """Edges of the given relations, whatever their case; all of them for None."""
    return edges if rels is None else edges.where(F.upper("rel").isin([r.upper() for r in rels]))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "rel")


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, keep_seeds: bool = False) -> DataFrame:
    """Nodes reachable from seeds(id) with their least distance and, of that hop, the least relation and predecessor.

    id, distance, rel, pred. Seeds are left out unless keep_seeds (distance 0); depth None goes to the end.
    """
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("rel").alias("r")).where("s is not null and t is not null")
    start = seeds.select("id").where("id is not null").distinct()
    seen = start.select("id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("pred"))
    frontier, hop = cut(seen), 0
    seen = frontier
    while depth is None or hop < depth:
        hop += 1
        step = frontier.select(F.col("id").alias("s")).join(e, "s").groupBy("t").agg(F.min(F.struct("r", "s")).alias("m"))
        step = step.select(F.col("t").alias("id"), F.lit(hop).alias("distance"), F.col("m.r").alias("rel"), F.col("m.s").alias("pred"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if keep_seeds else seen.where("distance > 0")


def impact(edges: DataFrame, start: str, depth: int = 5, project: str = "") -> DataFrame:
    """Forward walk: target_id, distance, relation_type of the shortest way; a self-edge returns the start itself at hop 1."""
    spark = edges.sparkSession
    own = _scoped(edges, project)
    hit = reach(own, spark.createDataFrame([(start,)], "id string"), depth)
    loop = own.where((F.col("source") == start) & (F.col("target") == start)).groupBy("target").agg(F.min("rel").alias("rel"))
    return hit.select(F.col("id").alias("target_id"), "distance", F.col("rel").alias("relation_type")).unionByName(
        loop.select(F.col("target").alias("target_id"), F.lit(1).alias("distance"), F.col("rel").alias("relation_type"))
    )


def callers_of(edges: DataFrame, target: str, depth: int = 1, project: str = "") -> DataFrame:
    """Reverse walk: caller_id, distance, relation_type."""
    return impact(reversed_edges(_scoped(edges, project)), target, depth).withColumnRenamed("target_id", "caller_id")


def _scoped(edges: DataFrame, project: str) -> DataFrame:
    if project in ("", "*"):
        return edges
    return edges.where(F.col("project_code") == project)


def why_chain(edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    """Reverse walk with the relations of the shortest way from each ancestor: ancestor_id, distance, chain (r1->r2, the least one)."""
    spark = edges.sparkSession
    e = edges.select(F.col("target").alias("s"), F.col("source").alias("t"), F.col("rel").alias("r")).where("s is not null and t is not null")
    frontier = cut(spark.createDataFrame([(target, 0, "")], "id string, distance int, chain string"))
    seen = frontier
    for hop in range(1, depth + 1):
        joined = frontier.select(F.col("id").alias("s"), "chain").join(e, "s")
        chain = F.when(F.col("chain") == "", F.col("r")).otherwise(F.concat("chain", F.lit("->"), "r"))
        step = joined.select(F.col("t").alias("id"), F.lit(hop).alias("distance"), chain.alias("chain")).groupBy("id", "distance").agg(F.min("chain").alias("chain"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", "distance", "chain"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0").select(F.col("id").alias("ancestor_id"), "distance", "chain")


def blast_radius(edges: DataFrame, start: str, depth: int = 5) -> DataFrame:
    return impact(edges, start, depth).agg(F.countDistinct("target_id").alias("blast_radius"))


def layers(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Nodes first reached at each hop: layer, nodes."""
    hit = reach(edges, edges.sparkSession.createDataFrame([(start,)], "id string"), depth, keep_seeds=True)
    return hit.groupBy(F.col("distance").alias("layer")).agg(F.count("*").alias("nodes"))


def neighbours(edges: DataFrame, start: str, radius: int, most: int, rels: Iterable[str] | None = None) -> DataFrame:
    """The first nodes by (distance, id) within a radius, the seed left out."""
    hit = reach(of_relations(edges, rels), edges.sparkSession.createDataFrame([(start,)], "id string"), radius)
    return hit.select("id", "distance").orderBy("distance", "id").limit(most)


def with_contract_bridge(edges: DataFrame, fanout: int = BRIDGE_FANOUT) -> DataFrame:
    """Edges and, for at most fanout implementors of each trait by id, IMPLEMENTS against its direction."""
    back = of_relations(edges, ["IMPLEMENTS"]).select(F.col("target").alias("source"), F.col("source").alias("target"), "rel").distinct()
    return edges.select("source", "target", "rel").unionByName(at_most(back, "source", "target", fanout))


def at_most(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """The first rows of each key by value, ranked in buckets of a hash first, so that no task sorts all rows of a hot key."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(value), F.lit(32)))
    b = b.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_b").orderBy(value))).where(F.col("_k") <= most)
    return b.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("_k") <= most).drop("_b", "_k")


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 10, rels: Iterable[str] | None = None) -> DataFrame:
    """One shortest way, the least predecessor at each hop: hop (from 0), node_id, relation_type of the edge to the next node (null at the end)."""
    spark = edges.sparkSession
    own = of_relations(edges, rels)
    hit = reach(own, spark.createDataFrame([(start,)], "id string"), depth, keep_seeds=True)
    # the walk back takes one row per hop, at most depth of them
    path, at = [], end
    schema = "hop int, node_id string, relation_type string"
    while True:
        row = hit.where(F.col("id") == at).select("distance", "rel", "pred").take(1)
        if not row:
            return spark.createDataFrame([], schema)
        path.append((row[0]["distance"], at, row[0]["rel"]))
        if row[0]["distance"] == 0:
            break
        at = row[0]["pred"]
    path.reverse()
    rows = [(d, n, path[k + 1][2] if k + 1 < len(path) else None) for k, (d, n, _) in enumerate(path)]
    return spark.createDataFrame(rows, schema)


def disjoint_paths(edges: DataFrame, start: str, end: str, most: int = 3, depth: int = 10) -> DataFrame:
    """Greedy node-disjoint ways: path_no, hop, node_id. Ends after a direct edge."""
    spark, out, left = edges.sparkSession, [], edges
    for k in range(1, most + 1):
        found = [(r["hop"], r["node_id"]) for r in shortest_path(left, start, end, depth).collect()]
        if not found:
            break
        out += [(k, h, n) for h, n in found]
        inner = [n for _, n in found[1:-1]]
        if not inner:
            break
        left = left.where(~F.col("source").isin(inner) & ~F.col("target").isin(inner))
    return spark.createDataFrame(out, "path_no int, hop int, node_id string")


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within an undirected radius and the edges among them."""
    both = edges.select("source", "target", "rel").unionByName(reversed_edges(edges))
    ids = reach(both, edges.sparkSession.createDataFrame([(start,)], "id string"), radius, keep_seeds=True).select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50) -> DataFrame:
    """id, rank: a fixed number of iterations in doubles, the mass of nodes without out-edges shared by all; parallel edges count.

    The edges are weighted once and kept; every round is a join and an aggregation, and is cut.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank")).limit(0)
    e = edges.select(F.col("source").alias("id"), "target").join(nodes.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    out = e.groupBy("id").agg(F.count("*").alias("out"))
    # edges and nodes are partitioned by id once; a round moves only ranks
    e = e.groupBy("id", "target").agg(F.count("*").alias("w")).join(out, "id").select("id", "target", (F.col("w") / F.col("out")).alias("share")).repartition("id").persist()
    base = nodes.select("id").join(out.select("id", F.lit(True).alias("linked")), "id", "left").select("id", F.col("linked").isNull().alias("dangling")).repartition("id").persist()
    rank = cut(base.select("id", "dangling", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        # the mass without out-edges is one broadcast row of the same job
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = rank.select("id", "rank").join(e, "id").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        step = base.join(got, "id", "left").crossJoin(F.broadcast(lost))
        rank = cut(step.select("id", "dangling", ((F.lit(1 - damping) + damping * F.col("lost")) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    e.unpersist()
    base.unpersist()
    return rank.select("id", "rank")


#: Edges that one task labels, or searches as one weak component; beyond them the work goes on in rounds.
TASK_EDGES = 2_000_000


def _weak_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component (the least id of it) of all edges a, b of one task: labels are hooked onto smaller ones and jumped over."""
    t = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.string()), ("b", pa.string())]))
    ids = pa.chunked_array([*t["a"].chunks, *t["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ids.dictionary)
    names, rank = ids.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[ids.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.empty(0, np.int64)
    a, b, label = codes[: t.num_rows], codes[t.num_rows :], np.arange(len(names))
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["id", "component"])


def _labels(e: DataFrame, most: int) -> DataFrame:
    """id, component of the ends of distinct edges a < b: in one task up to so many edges, beyond by large-star and small-star rounds."""
    size = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = size(e)
    while mark[0] > most:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m"))
        small = large.withColumnRenamed("b", "x").join(least, "x")
        small = small.select(F.col("m").alias("a"), "x").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("x"))).where("a < x").distinct()
        e = cut(small.withColumnRenamed("x", "b"))
        new = size(e)
        if new == mark:
            return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        mark = new
    return e.repartition(1).mapInArrow(_weak_labels, "id string, component string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id of each weakly connected component.

    Of many edges, two of each node are labelled first; what still links different labels then is mostly little. Labels are found in one task up to
    TASK_EDGES; beyond, each round moves every node to a smaller neighbour, so long chains need few rounds and no neighbour list is collected.
    """
    e = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a < b").distinct()
    e = cut(e)
    most = TASK_EDGES if e.schema["a"].dataType == StringType() else -1
    if e.count() <= max(0, most):
        label = _labels(e, most)
    else:
        some = e.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("b"))
        first = cut(_labels(cut(some.select("a", F.explode("b").alias("b"))), most))
        held = e
        for end in ("a", "b"):
            held = held.join(first.select(F.col("id").alias(end), F.col("component").alias("_" + end)), end, "left").withColumn("_" + end, F.coalesce("_" + end, end))
        left = cut(held.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        then = _labels(left, most).select(F.col("id").alias("component"), F.col("component").alias("_c"))
        # a label of the first pass, or an end that had none, may be joined to a smaller one
        whole = first.unionByName(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().join(first.select("id"), "id", "left_anti").withColumn("component", F.col("id")))
        label = whole.join(then, "component", "left").select("id", F.coalesce("_c", "component").alias("component"))
    return nodes.select("id").join(cut(label), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_sizes(at: np.ndarray, to: np.ndarray, n: int) -> list[int]:
    """Sizes of the strong components of nodes 0 to n - 1 over the edges of one task, by an iterative low-link search."""
    order = np.argsort(at, kind="stable")
    near, first = to[order].tolist(), np.searchsorted(at[order], np.arange(n + 1)).tolist()
    number, low, sizes, held = [-1] * n, [0] * n, [], []
    done, place, count = [False] * n, list(first), 0
    for root in range(n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = count
        count += 1
        held.append(root)
        way = [root]
        while way:
            v = way[-1]
            k, end = place[v], first[v + 1]
            while k < end:
                w = near[k]
                k += 1
                if number[w] < 0:
                    break
                if not done[w] and number[w] < low[v]:
                    low[v] = number[w]
            else:
                way.pop()
                if way and low[v] < low[way[-1]]:
                    low[way[-1]] = low[v]
                if low[v] == number[v]:
                    size = 0
                    while True:
                        w = held.pop()
                        done[w] = True
                        size += 1
                        if w == v:
                            break
                    sizes.append(size)
                continue
            place[v] = k
            number[w] = low[w] = count
            count += 1
            held.append(w)
            way.append(w)
    return sizes


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (the greatest id of it) of all strongly connected components of more than one node.

    Nodes without in- or out-edges are trimmed away first; then, round by round, the greatest id spreads forward and
    the nodes that also reach it backward within their colour form its component and leave.
    """
    e = cut(edges.select("source", "target").where("source <> target").distinct())
    found = None
    while True:
        # trimming
        while True:
            live = e.select(F.col("source").alias("id")).intersect(e.select(F.col("target").alias("id")))
            kept = cut(e.join(live.withColumnRenamed("id", "source"), "source", "left_semi").join(live.withColumnRenamed("id", "target"), "target", "left_semi"))
            done = kept.count() == e.count()
            e = kept
            if done:
                break
        if e.isEmpty():
            break
        colour = cut(e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("c", F.col("id")))
        while True:
            pushed = e.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("p"))
            new = cut(colour.join(pushed, "id", "left").select("id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.col("p") > F.col("c")).alias("moved")))
            colour, moved = new.select("id", "c"), not new.where("moved").isEmpty()
            if not moved:
                break
        within = e.join(colour.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target")
        within = cut(within.where("cs = ct").select("source", "target"))
        back = reach(within.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("r").alias("rel")), colour.where("id = c").select("id"), None, keep_seeds=True)
        part = cut(colour.join(back.select("id"), "id", "left_semi").withColumnRenamed("c", "component"))
        found = part if found is None else found.unionByName(part)
        e = cut(within.join(part.select(F.col("id").alias("source")), "source", "left_anti").join(part.select(F.col("id").alias("target")), "target", "left_anti"))
    if found is None:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    big = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(big.select("component"), "component", "left_semi").select("id", "component")


def cycles_with_loops(edges: DataFrame, rels: Iterable[str]) -> DataFrame:
    """id, component of all nodes on a cycle of the relations, self-loops included."""
    own = of_relations(edges, rels)
    strong = strong_components(own)
    loops = own.where("source = target").select(F.col("source").alias("id")).distinct().join(strong.select("id"), "id", "left_anti")
    return strong.unionByName(loops.withColumn("component", F.col("id")))


def _low_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bridges and articulation points of one component, by an iterative low-link search."""
    near: dict[str, list[str]] = {}
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order, low, rows, points = {}, {}, [], set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children = 0
        stack = [(root, None, iter(near[root]))]
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    children += v == root
                    stack.append((w, v, iter(near[w])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        rows.append(("bridge", min(v, parent), max(v, parent)))
                    if parent != root and low[v] >= order[parent]:
                        points.add(parent)
        if children > 1:
            points.add(root)
    rows += [("articulation", p, None) for p in points]
    return pd.DataFrame(rows, columns=["kind", "a", "b"])


def cut_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridges (kind bridge, a < b) and articulation points (kind articulation, a) of the undirected graph.

    Trees hanging off the graph are peeled by joins, round by round: every peeled edge is a bridge. Only the 2-core of each
    component, in which a search must see all of it, goes to one task.
    """
    u = cut(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a < b").distinct())
    degree = u.select(F.col("a").alias("id")).unionAll(u.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    core, peeled = u, None
    while True:
        leaf = core.select(F.col("a").alias("id")).unionAll(core.select("b")).groupBy("id").agg(F.count("*").alias("d")).where("d = 1").select("id")
        off = cut(core.join(leaf.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(core.join(leaf.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")).distinct())
        if off.isEmpty():
            break
        peeled = off if peeled is None else peeled.unionByName(off)
        core = cut(core.join(off, ["a", "b"], "left_anti"))
    inner_nodes = core.select(F.col("a").alias("id")).union(core.select("b")).distinct()
    part = components(inner_nodes, core.select(F.col("a").alias("source"), F.col("b").alias("target")))
    found = core.join(part.withColumnRenamed("id", "a"), "a").groupBy("component").applyInPandas(_low_links, "kind string, a string, b string")
    if peeled is not None:
        # an inner end of a peeled edge separates its tree from the rest
        ends = peeled.select(F.col("a").alias("id")).union(peeled.select("b")).distinct().join(degree.where("d > 1"), "id").select("id")
        found = found.unionByName(peeled.select(F.lit("bridge").alias("kind"), "a", "b"))
        found = found.unionByName(ends.select(F.lit("articulation").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")))
    return found.distinct()


def reciprocal(edges: DataFrame, rel: str = "CALLS") -> DataFrame:
    """Unordered pairs a < b that are linked both ways."""
    e = of_relations(edges, [rel]).select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return e.join(back, ["source", "target"], "left_semi").where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))


def covered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that tests reach over CALLS and CALLS_NIF, the tested ones included: id."""
    return reach(of_relations(edges, ["CALLS", "CALLS_NIF"]), nodes.where("tested").select("id"), None, keep_seeds=True).select("id")


def reaches(edges: DataFrame, start: str, end: str, rels: Iterable[str] | None = None) -> bool:
    """Whether end can be reached; every node reaches itself."""
    if start == end:
        return True
    hit = reach(of_relations(edges, rels), edges.sparkSession.createDataFrame([(start,)], "id string"), None)
    return not hit.where(F.col("id") == end).isEmpty()


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak clusters of two or more of the given nodes, over the edges among them: cluster, size, members."""
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return components(ids, inside).groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size")).where("size > 1")


def layer_violations(nodes: DataFrame, edges: DataFrame, layers_: list[tuple[str, int]]) -> DataFrame:
    """Edges from a layer of lower to one of higher priority; the first matching prefix of a name gives the priority."""
    rank: Column = F.lit(None).cast("int")
    for prefix, p in reversed(layers_):
        rank = F.when(F.col("name").startswith(prefix), F.lit(p)).otherwise(rank)
    ranked = nodes.select("id", rank.alias("p")).where("p is not null")
    s, t = ranked.select(F.col("id").alias("source"), F.col("p").alias("sp")), ranked.select(F.col("id").alias("target"), F.col("p").alias("tp"))
    return edges.join(s, "source").join(t, "target").where("sp < tp").select("source", "target", "rel", F.col("sp").alias("source_priority"), F.col("tp").alias("target_priority"))


def edge_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added and removed, with their real relation: change, source, target, rel."""
    key = ["source", "target", "rel"]
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological waves (source before target): id, wave from 1. Nodes on or behind a cycle get no row."""
    e = edges.select("source", "target").distinct()
    left, out, k = cut(nodes.select("id")), None, 0
    while True:
        k += 1
        live = e.join(left.withColumnRenamed("id", "source"), "source", "left_semi")
        ready = cut(left.join(live.select(F.col("target").alias("id")), "id", "left_anti").withColumn("wave", F.lit(k)))
        if ready.isEmpty():
            return out if out is not None else ready
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready.select("id"), "id", "left_anti"))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """All pairs (source, target) linked by a way of one or more edges, up to a depth; for hierarchies, whose closure is small."""
    e = edges.select("source", "target").distinct()
    all_, new, k = cut(e), None, 1
    new = all_
    while depth is None or k < depth:
        k += 1
        step = new.select("source", F.col("target").alias("m")).join(e.withColumnRenamed("source", "m"), "m").select("source", "target").distinct()
        new = cut(step.join(all_, ["source", "target"], "left_anti"))
        if new.isEmpty():
            break
        all_ = all_.unionByName(new)
    return all_


def descendants(edges: DataFrame) -> DataFrame:
    """id, descendants: distinct nodes below each node that has any."""
    return closure(edges).where("source <> target").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("descendants"))


def two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least distance 0, 1 or 2 of every node around the seeds, by two joins: id, distance."""
    e = edges.select(F.col("source").alias("id"), "target")
    zero = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    one = zero.join(e, "id").select(F.col("target").alias("id"), F.lit(1).alias("distance")).distinct()
    two = one.join(e, "id").select(F.col("target").alias("id"), F.lit(2).alias("distance"))
    return zero.unionByName(one).unionByName(two).groupBy("id").agg(F.min("distance").alias("distance"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree, one row per endpoint."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def resolve_phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node point to the only function or method of that short name; CALLS_NIF then to the least
    is_nif node of the name other than the caller. What stays unresolved keeps its name. source, target, rel, resolved."""
    short = F.element_at(F.split("id", "::"), -1)
    known = nodes.where(F.col("kind").isin("function", "method")).groupBy(short.alias("short")).agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1")
    nif = nodes.where("is_nif").select(short.alias("short"), F.col("id").alias("nif"))
    e = edges.select("source", "target", "rel").distinct()
    hit = e.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").withColumn("resolved", F.lit(True))
    miss = e.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").withColumn("short", F.element_at(F.split("target", "::"), -1))
    named = miss.join(known.select("short", "only"), "short", "left")
    first = named.join(nif, "short", "left").groupBy("source", "target", "rel", "only").agg(F.min(F.when(F.col("nif") != F.col("source"), F.col("nif"))).alias("nif"))
    found = F.coalesce("only", F.when(F.col("rel") == "CALLS_NIF", F.col("nif")))
    done = first.select("source", F.coalesce(found, "target").alias("target"), "rel", found.isNotNull().alias("resolved"))
    return hit.unionByName(done).groupBy("source", "target", "rel").agg(F.max("resolved").alias("resolved"))


def subgraph_matches(pattern: list[tuple[str, str]], edges: DataFrame, most: int | None = None) -> DataFrame:
    """Injective matches of a small directed pattern: one column per pattern node, by one join per pattern edge."""
    e = edges.select("source", "target").distinct()
    found: DataFrame | None = None
    left = list(pattern)
    while left:
        bound = set(found.columns) if found is not None else set()
        a, b = next(((x, y) for x, y in left if not bound or x in bound or y in bound), left[0])
        left.remove((a, b))
        step = e.select(F.col("source").alias(a), F.col("target").alias(b)) if a != b else e.where("source = target").select(F.col("source").alias(a))
        if found is not None and not bound & {a, b}:
            raise ValueError("the pattern must be connected: its parts would be crossed")
        found = step if found is None else found.join(step, sorted(bound & {a, b}))
        names = found.columns
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                found = found.where(F.col(x) != F.col(y))
    found = found.select(*sorted(found.columns)).distinct()
    return found.orderBy(*sorted(found.columns)).limit(most) if most else found
