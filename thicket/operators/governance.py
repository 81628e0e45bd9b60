"""Governance: verdicts, digests and packets over files, the code graph, the intent graph and mail.

Ranks end in an id, so that ties have one order; nulls count as absent; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.operators import graph, smells

#: Words that tell the kind of an intent, in the order they are tried: fixed values.
INTENT_WORDS = {
    "Requirement": ["constraint", "must", "should", "need", "requires", "rule"],
    "Decision": ["decision", "choose", "adopt", "use ", "switch", "architecture"],
    "Guideline": ["guideline", "policy", "convention", "standard"],
    "Concept": ["concept", "means", "term", "definition"],
}
#: Effort and risk of mending each kind of anomaly, and its severity: fixed values.
ANOMALIES = {
    "wrapper": ("low", "medium", "low"), "orphan_code": ("medium", "high", "medium"), "phantom_dead_ref": ("low", "medium", "medium"), "phantom_multi_declare": ("low", "low", "low"),
    "feature_envy": ("medium", "medium", "medium"), "detour": ("medium", "medium", "low"), "abstraction_detour": ("medium", "medium", "low"), "orphan_intent": ("medium", "high", "medium"),
    "cycle": ("high", "high", "high"), "god_object": ("high", "medium", "high"),
}
#: Failures that a later sight of a resolved friction speaks of: fixed values.
FAILURES = ("error", "timeout", "failure", "crash")
#: Relations over which work hangs on other work, and the narrower ones that order it: fixed values.
CHILD_RELATIONS = ("SOLVES", "BELONGS_TO", "TARGETS", "REFINES", "EXPLAINS", "VERIFIES")
ORDER_RELATIONS = ("SOLVES", "BELONGS_TO")


def intent_kind(text: Column) -> Column:
    """The first kind one of whose words a statement holds; Requirement where none does or the text is null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    kind: Column = F.lit("Requirement")
    for name, words in reversed(INTENT_WORDS.items()):
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit | t.contains(w)
        kind = F.when(hit, name).otherwise(kind)
    return kind


def indexing_verdicts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """By project: eligible, indexed, discovered files, those without chunks, the verdict, and the cause of a gap in chunk coverage.

    files: path, project_code, status, eligible, one row a path; chunks: file_path. Verdicts in order: none_eligible, not_extracted, stale_flags,
    complete, incomplete, stale_rows. Below 50 % of the enrolled files with chunks the gap is severe, below 90 % partial.
    """
    has = chunks.where("file_path is not null").select(F.col("file_path").alias("path")).distinct().withColumn("chunked", F.lit(True))
    f = files.join(has, "path", "left").withColumn("chunked", F.coalesce("chunked", F.lit(False)))
    g = f.groupBy("project_code").agg(
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("status") != "discovered").alias("indexed"), F.count_if(F.col("status") == "discovered").alias("discovered"),
        F.count_if((F.col("status") == "discovered") & ~F.col("chunked")).alias("unextracted"), F.count("*").alias("enrolled"), F.count_if("chunked").alias("chunked"),
    )
    gap = F.col("eligible") - F.col("indexed")
    verdict = (
        F.when(F.col("eligible") == 0, "none_eligible").when(F.col("unextracted") > 0, "not_extracted").when(F.col("discovered") > 0, "stale_flags")
        .when(gap == 0, "complete").when(gap > 0, "incomplete").otherwise("stale_rows")
    )
    pct = F.col("chunked") * 100.0 / F.col("enrolled")
    cause = F.when(F.col("chunked") >= F.col("enrolled"), None).when(pct < 50, "severe").when(pct < 90, "partial")
    return g.withColumns({"verdict": verdict, "cause": cause})


def diff_paths(diff: str) -> list[str]:
    """Files a unified diff touches, without /dev/null, in order."""
    out = []
    for line in diff.splitlines():
        for mark in ("+++ b/", "--- a/"):
            if line.startswith(mark) and (path := line[len(mark) :].strip()) and path not in out:
                out.append(path)
    return out


def symbols_of_diff(diff: str, chunks: DataFrame) -> DataFrame:
    """file, symbol: symbols with a chunk in a file the diff touches, by the end of the chunk's path."""
    paths = diff_paths(diff)
    if not paths:
        return chunks.select(F.lit("").alias("file"), F.col("source_id").alias("symbol")).limit(0)
    c = chunks.where("source_id is not null and file_path is not null and source_type = 'symbol'")
    hits = F.filter(F.array(*[F.lit(p) for p in paths]), lambda p: F.col("file_path").contains(p))
    return c.select("source_id", F.explode(hits).alias("file")).select("file", F.col("source_id").alias("symbol")).distinct()


def test_impact(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, radius: int = 4) -> DataFrame:
    """id, distance: tests within a radius of reverse calls of any of the symbols."""
    back = graph.reversed_edges(graph.of_relations(edges, ["CALLS", "CALLS_NIF"]))
    return graph.reach(back, symbols.select("id"), radius).join(nodes.where("tested").select("id"), "id", "left_semi").select("id", "distance")


def resolve(symbols: DataFrame, wanted: str, most: int = 6) -> DataFrame:
    """id, homonym, truncated: the exact id alone, else all symbols of that name or last part of the id; the first is the answer, the others homonyms."""
    s = symbols.select("id", "name").where("id is not null").distinct()
    rank = F.when(F.col("id") == wanted, 0).when((F.col("name") == wanted) | (F.element_at(F.split("id", "::"), -1) == wanted), 1)
    hit = s.select("id", rank.alias("r")).where("r is not null").groupBy("id").agg(F.min("r").alias("r")).orderBy("r", "id").limit(most)
    w = Window.orderBy("r", "id")
    ranked = hit.withColumns({"k": F.row_number().over(w), "best": F.min("r").over(Window.partitionBy()), "n": F.count("*").over(Window.partitionBy())})
    return ranked.where("best = 1 or r = 0").select("id", (F.col("k") > 1).alias("homonym"), (F.when(F.col("best") == 0, False).otherwise(F.col("n") >= most)).alias("truncated"))


def conception(chunks: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """By project the modules of most symbols, the first interfaces and the public contracts: project_code, section, name, number."""
    w = lambda *order: F.row_number().over(Window.partitionBy("project_code").orderBy(*order))
    m = chunks.where("file_path is not null").groupBy("project_code", F.col("file_path").alias("name")).agg(F.countDistinct("source_id").alias("number"))
    m = m.withColumn("k", w(F.desc("number"), "name")).where(F.col("k") <= most).select("project_code", F.lit("module").alias("section"), "name", "number")
    i = symbols.where("kind = 'interface'").select("project_code", "name").distinct().withColumn("k", w("name")).where(F.col("k") <= most)
    p = symbols.where("is_public").groupBy("project_code").agg(F.countDistinct("id").alias("number"))
    return m.unionByName(i.select("project_code", F.lit("interface").alias("section"), "name", F.col("k").cast("long").alias("number"))).unionByName(
        p.select("project_code", F.lit("public").alias("section"), F.lit("all").alias("name"), "number")
    )


def anomalies(nodes: DataFrame, edges: DataFrame, untraced: DataFrame) -> DataFrame:
    """All detectors as one listing: kind, subject, severity, effort, risk. untraced: id of intents without any evidence."""
    found = {
        "wrapper": smells.wrappers(nodes, edges).select(F.col("id").alias("subject")), "orphan_code": smells.orphan_code(nodes, edges).select(F.col("name").alias("subject")),
        "feature_envy": smells.feature_envy(nodes, edges).select(F.col("id").alias("subject")), "detour": smells.detours(nodes, edges).select(F.col("mid").alias("subject")),
        "abstraction_detour": smells.abstraction_detours(nodes, edges).select(F.col("interface").alias("subject")), "god_object": smells.god_objects(nodes, edges).select(F.col("id").alias("subject")),
        "phantom_dead_ref": smells.phantom_data(edges).where("issue = 'dead'").select(F.col("id").alias("subject")), "phantom_multi_declare": smells.phantom_data(edges).where("issue = 'multi'").select(F.col("id").alias("subject")),
        "cycle": smells.circular_dependencies(edges).select(F.col("component").alias("subject")), "orphan_intent": untraced.select(F.col("id").alias("subject")),
    }
    out = None
    for kind, rows in found.items():
        effort, risk, severity = ANOMALIES[kind]
        own = rows.distinct().select(F.lit(kind).alias("kind"), "subject", F.lit(severity).alias("severity"), F.lit(effort).alias("effort"), F.lit(risk).alias("risk"))
        out = own if out is None else out.unionByName(own)
    return out


def debt_digest(nodes: DataFrame, duplicates: DataFrame, untraced: DataFrame, traced: DataFrame, ranks: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """Four sections of debt, each ranked by the PageRank of its subject: section, subject, other, rank, place.

    dry: unordered pairs of near duplicates, neither tested; unlinked_soll: intents without evidence; unlinked_code: public callables without a trace;
    stubs: symbols whose text only says it is not done. Each section keeps its `most` first.
    """
    score = ranks.select(F.col("id").alias("subject"), F.col("rank").alias("score"))
    none = F.lit(None).cast("string").alias("other")
    untested = nodes.where(~F.col("tested")).select("id")
    dry = duplicates.select(F.least("a", "b").alias("subject"), F.greatest("a", "b").alias("other")).distinct()
    dry = dry.join(untested.withColumnRenamed("id", "subject"), "subject", "left_semi").join(untested.withColumnRenamed("id", "other"), "other", "left_semi")
    code = nodes.where(smells.is_callable(F.col("kind")) & F.col("is_public") & ~F.col("tested")).join(traced.select("id"), "id", "left_anti")
    stub = chunks.where(F.col("content").rlike(r"(?i)\bnot implemented\b|\bunimplemented!|\btodo!\(|raise NotImplementedError")).select(F.col("id").alias("subject")).distinct()
    parts = {
        "dry": dry.select("subject", "other"), "unlinked_soll": untraced.select(F.col("id").alias("subject"), none),
        "unlinked_code": code.select(F.col("id").alias("subject"), none), "stubs": stub.select("subject", none),
    }
    out = None
    for section, rows in parts.items():
        own = rows.join(score, "subject", "left").select(F.lit(section).alias("section"), "subject", "other", F.coalesce("score", F.lit(0.0)).alias("rank"))
        own = own.orderBy(F.desc("rank"), "subject", "other").limit(most)
        out = own if out is None else out.unionByName(own)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("rank"), "subject", "other")))


def blocked_by_cycles(edges: DataFrame, rels: tuple[str, ...] = ORDER_RELATIONS) -> DataFrame:
    """id: nodes behind a cycle of the relations, on none themselves."""
    own = graph.of_relations(edges, rels)
    on = graph.cycles_with_loops(own, rels).select("id").distinct()
    return graph.reach(own, on).select("id").join(on, "id", "left_anti")


def schedulable(nodes: DataFrame) -> DataFrame:
    """Requirements, decisions and milestones that are not at an end."""
    return nodes.where(F.col("type").isin("Requirement", "Decision", "Milestone") & ~F.coalesce(F.col("status"), F.lit("")).isin("delivered", "superseded", "rejected", "archived"))


def plan_scores(nodes: DataFrame, edges: DataFrame, as_of: str, bonus: dict[str, int], half_life: float = 30.0, centrality: bool = True) -> DataFrame:
    """id, type, descendants, score of each schedulable node.

    round((40 * descendants + bonus of the priority + round(100 * PageRank) - 10 for a milestone without descendants) * exp(-age in days / half_life)),
    and 50 more for a requirement that is current. Descendants are all schedulable nodes that hang below over CHILD_RELATIONS.
    """
    own = schedulable(nodes)
    ids = own.select("id")
    e = edges.where(F.col("rel").isin(*CHILD_RELATIONS)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    hang = graph.descendants(e)
    p: Column = F.lit(0)
    for k, v in bonus.items():
        p = F.when(F.col("priority") == k, v).otherwise(p)
    j = own.join(hang, "id", "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)))
    c = F.lit(0)
    if centrality:
        j = j.join(graph.pagerank(ids, e).select("id", "rank"), "id", "left")
        c = F.round(100 * F.coalesce("rank", F.lit(0.0))).cast("long")
    age = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000, F.lit(0.0)))
    base = 40 * F.col("descendants") + p + c - F.when((F.col("type") == "Milestone") & (F.col("descendants") == 0), 10).otherwise(0)
    score = F.round(base * F.exp(-age / half_life)).cast("long") + F.when((F.col("type") == "Requirement") & (F.lower(F.trim("status")) == "current"), 50).otherwise(0)
    return j.select("id", "type", "priority", "descendants", score.alias("score"))


def actionable_leaves(scores: DataFrame, edges: DataFrame, priorities: list[str]) -> DataFrame:
    """id, score, parent_score, rank, place of each requirement: its score and a quarter of its best parent's, between 0 and 40.

    Parents hang over it by CHILD_RELATIONS; without one its own score stands for it. Order: rank, priority, id.
    """
    parents = edges.where(F.col("rel").isin(*CHILD_RELATIONS)).select(F.col("source").alias("p"), F.col("target").alias("id"))
    best = parents.join(scores.select(F.col("id").alias("p"), F.col("score").alias("ps")), "p").groupBy("id").agg(F.max("ps").alias("ps"))
    r = scores.where("type = 'Requirement'").join(best, "id", "left").withColumn("parent_score", F.coalesce("ps", "score"))
    rank = F.col("score") + F.floor(F.greatest(F.lit(0), F.least(F.lit(40), F.col("parent_score"))) / 4)
    level: Column = F.lit(len(priorities))
    for i, name in enumerate(priorities):
        level = F.when(F.col("priority") == name, i).otherwise(level)
    return r.select("id", "score", "parent_score", rank.cast("long").alias("rank"), level.alias("level"))


def anchors(nodes: DataFrame, decided: DataFrame, revised: DataFrame, most: int = 10) -> DataFrame:
    """What a session is to recall: current pillars, skills, and the latest decisions and revisions: section, id, place."""
    pick = lambda df, section, order: df.orderBy(*order).limit(most).select(F.lit(section).alias("section"), "id", F.row_number().over(Window.orderBy(*order)).alias("place"))
    current = nodes.where("status = 'current'")
    return (
        pick(current.where("type = 'Pillar'"), "pillar", [F.col("id")]).unionByName(pick(current.where("type = 'Skill'"), "skill", [F.col("id")]))
        .unionByName(pick(decided, "decision", [F.desc("at"), F.col("id")])).unionByName(pick(revised, "revision", [F.desc("at"), F.col("id")]))
    )


def friction_regressions(frictions: DataFrame) -> DataFrame:
    """Resolved frictions of a failure class seen again after they were resolved: id, kind, late_seconds. Those by design never regress."""
    hit = frictions.where((F.col("status") == "resolved") & F.col("kind").isin(*FAILURES) & (F.col("last_observed") > F.col("resolved_at")))
    return hit.select("id", "kind", (F.unix_seconds(F.col("last_observed").cast("timestamp")) - F.unix_seconds(F.col("resolved_at").cast("timestamp"))).alias("late_seconds"))


def live_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Holders of a lease that has not run out, the first to have it first: resource, holder, acquired_at, place."""
    w = Window.partitionBy("resource").orderBy("acquired_at", "holder")
    return leases.where(F.col("expires_at") > now).select("resource", "holder", "acquired_at", F.row_number().over(w).alias("place"))


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One delivery for each subscriber of a message's topic but its sender: message_id, recipient. A star subscribes to all topics."""
    s = subscriptions.select("topic", "recipient").distinct()
    named = messages.join(s.where("topic <> '*'"), "topic")
    everyone = messages.crossJoin(F.broadcast(s.where("topic = '*'").select("recipient"))) if s.where("topic = '*'").take(1) else None
    rows = named.select("message_id", "sender", "recipient")
    rows = rows if everyone is None else rows.unionByName(everyone.select("message_id", "sender", "recipient"))
    return rows.where("recipient <> sender").select("message_id", "recipient").distinct()


def seals(nodes: DataFrame, edges: DataFrame, shape: Column) -> DataFrame:
    """Merkle seals of a hierarchy: id, seal. A seal is sixteen hexadecimal digits of the hash of a node's shape and its children's seals in their order.

    Bottom-up, one round a level: each takes the nodes whose children all have seals. Nodes on or above a cycle get none.
    """
    from thicket.session import cut

    sep = "\x1f"
    own = nodes.select("id", shape.alias("shape"))
    e = edges.select("source", "target").distinct()
    waiting = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("children"))
    left = cut(own.join(waiting, "id", "left").select("id", "shape", F.coalesce("children", F.lit(0)).alias("children")))
    done = cut(left.where("children = 0").select("id", F.substring(F.sha2("shape", 256), 1, 16).alias("seal")))
    left = cut(left.where("children > 0"))
    while True:
        got = e.join(done.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("seal")), sep).alias("seals"))
        ready = cut(left.join(got, "id").where("n = children").select("id", F.substring(F.sha2(F.concat("shape", F.lit(sep), "seals"), 256), 1, 16).alias("seal")))
        if ready.isEmpty():
            return done
        done = done.unionByName(ready)
        left = cut(left.join(ready.select("id"), "id", "left_anti"))


def parse_intents(texts: DataFrame) -> DataFrame:
    """Intents from Markdown bullets `- **ID** [status] title`: path, line, id, type, status, title. Other lines are prose.

    texts: path, text; a null text has no lines.
    """
    kinds = {"REQ": "Requirement", "DEC": "Decision", "PIL": "Pillar", "VIS": "Vision", "VAL": "Validation", "MIL": "Milestone", "CPT": "Concept", "GUI": "Guideline", "SKI": "Skill", "STK": "Stakeholder", "PRT": "Practice"}
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t"))
    p = r"^\s*[-*] \*\*([A-Z]{3}-[A-Za-z0-9-]+)\*\*(?: \[([a-z]+)\])? ?(.*)$"
    hit = lines.where(F.col("t").rlike(p)).select("path", (F.col("line") + 1).alias("line"), *[F.regexp_extract("t", p, k).alias(n) for k, n in ((1, "id"), (2, "status"), (3, "title"))])
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.substring("id", 1, 3))
    return hit.select("path", "line", "id", kind.alias("type"), F.nullif("status", F.lit("")).alias("status"), F.trim("title").alias("title"))


def write_intents(nodes: DataFrame) -> DataFrame:
    """The Markdown bullet of each intent, the form parse_intents reads: id, text."""
    return nodes.select("id", F.concat(F.lit("- **"), "id", F.lit("**"), F.coalesce(F.concat(F.lit(" ["), "status", F.lit("]")), F.lit("")), F.lit(" "), F.coalesce(F.regexp_replace("title", r"\s+", " "), F.lit(""))).alias("text"))


def neighbourhood_clones(nodes: DataFrame, edges: DataFrame, most_distance: float = 0.05, least_edges: int = 4) -> DataFrame:
    """Pairs of nodes whose signed neighbourhoods are alike: a, b, distance.

    A node's vector counts its edges by direction, relation and kind of the other end. Exact twins are one class before near
    ones are sought; only nodes of the same kind and at least so many edges take part.
    """
    from thicket.operators.retrieval import similar_pairs

    kinds = nodes.select("id", "kind")
    # as many features as relations times kinds times two; a row of null has no feature and counts as an edge
    rels, names = ([r[0] for r in df.distinct().orderBy(df.columns[0]).collect()] for df in (edges.where("rel is not null").select("rel"), nodes.where("kind is not null").select("kind")))
    code = lambda c, of: F.coalesce(*[F.when(F.col(c) == x, F.lit(k)) for k, x in enumerate(of)], F.lit(None).cast("int"))
    feature = code("rel", rels) * len(names) + code("kind", names)
    out = edges.join(kinds.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), feature.alias("f"))
    back = edges.join(kinds.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), (feature + len(rels) * len(names)).alias("f"))
    counts = out.unionByName(back).groupBy("id", "f").agg(F.count("*").alias("n"))
    width = 2 * len(rels) * len(names)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, n = batch.column(2), batch.column(3)
            v, row = np.zeros((len(batch), width)), np.repeat(np.arange(len(batch)), np.diff(f.offsets.to_numpy()))
            known = f.flatten().is_valid().to_numpy(zero_copy_only=False)
            v[row[known], f.flatten().drop_null().to_numpy()] = n.flatten().to_numpy()[known]
            e = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), e], names=["id", "kind", "embedding"])

    v = counts.groupBy("id").agg(F.collect_list(F.struct("f", "n")).alias("x"), F.sum("n").alias("edges")).where(F.col("edges") >= least_edges).join(kinds, "id")
    of = nodes.schema["id"].dataType.simpleString()
    v = v.select("id", "kind", "x.f", "x.n").mapInArrow(spell, f"id {of}, kind string, embedding array<double>")
    return similar_pairs(v, "kind", most_distance)
