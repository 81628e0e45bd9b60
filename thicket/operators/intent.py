"""The intent graph: legal relations, coverage states, rules, planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators import graph

#: Legal relations by source and target prefix; the first is the default where one exists. Fixed values.
POLICY = """
PIL VIS EPITOMIZES
REQ PIL BELONGS_TO
CPT REQ EXPLAINS REFINES
CPT PIL BELONGS_TO
CPT CPT INHERITS_FROM REFINES SUPERSEDES
CPT DEC INHERITS_FROM
GUI PIL BELONGS_TO
TMG PIL BELONGS_TO
TMG DEC REFINES
TMG ART HAS_REMNANT
DEC REQ SOLVES REFINES
MIL REQ TARGETS
VAL REQ VERIFIES
VAL DEC REFUTES VERIFIES
STK REQ ORIGINATES CONTRIBUTES_TO
GUI GUI INHERITS_FROM SUPERSEDES
REQ GUI BELONGS_TO COMPLIES_WITH
REQ DEC BLOCKED_BY
REQ MIL BLOCKED_BY
DEC GUI COMPLIES_WITH
SKI PIL BELONGS_TO
SKI GUI INHERITS_FROM
SKI SKI REFINES COMPOSES_WITH SUPERSEDES INHERITS_FROM
PRT PIL BELONGS_TO
PRT GUI INHERITS_FROM
PRT PRT EXTENDS REFINES SUPERSEDES INHERITS_FROM
SKI PRT USES
DEC DEC SUPERSEDES REFINES
DEC CPT REFINES SUPERSEDES
REQ REQ REFINES BELONGS_TO SUPERSEDES BLOCKED_BY
PIL PIL SUPERSEDES
MIL MIL SUPERSEDES
VAL VAL REFINES SUPERSEDES
DEC ART IMPACTS SUBSTANTIATES
REQ ART SUBSTANTIATES BLOCKED_BY
VAL ART SUBSTANTIATES
"""
TERMINAL = ("delivered", "superseded", "rejected", "archived")


def policy(spark) -> DataFrame:
    """source_prefix, target_prefix, rel: one row per legal relation."""
    rows = [(a, b, r) for line in POLICY.split("\n") if line for a, b, *rels in [line.split()] for r in rels]
    return spark.createDataFrame(rows, "source_prefix string, target_prefix string, rel string")


def illegal_edges(edges: DataFrame) -> DataFrame:
    """Edges the policy does not allow; ids begin with their three-letter prefix, others count as artifacts (ART)."""
    prefix = lambda c: F.when(F.col(c).rlike("^[A-Z]{3}-"), F.substring(c, 1, 3)).otherwise("ART")
    e = edges.select("source", "target", "rel", prefix("source").alias("source_prefix"), prefix("target").alias("target_prefix"))
    return e.join(F.broadcast(policy(edges.sparkSession)), ["source_prefix", "target_prefix", "rel"], "left_anti").select("source", "target", "rel")


def coverage_states(requirements: DataFrame, traces: DataFrame) -> DataFrame:
    """id, state (done, partial, missing) and the missing dimensions of each requirement.

    requirements: id, status, criteria; traces: entity, artifact_status. Terminal statuses are done; so are current or accepted ones
    with evidence, none of it broken, and criteria; any evidence or criteria is partial.
    """
    t = traces.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("evidence"), F.count_if(F.col("artifact_status") == "broken").alias("broken"))
    r = requirements.join(t, "id", "left").na.fill(0, ["evidence", "broken"])
    has = F.coalesce(F.length("criteria") > 0, F.lit(False))
    state = (
        F.when(F.col("status").isin(*TERMINAL), "done")
        .when((F.col("evidence") > 0) & (F.col("broken") == 0) & has & F.col("status").isin("current", "accepted"), "done")
        .when((F.col("evidence") > 0) | has, "partial").otherwise("missing")
    )
    gaps = F.concat_ws(",", F.when(F.col("evidence") == 0, "evidence"), F.when(F.col("broken") > 0, "broken"), F.when(~has, "criteria"), F.when(~F.col("status").isin("current", "accepted", *TERMINAL), "status"))
    return r.select("id", state.alias("state"), gaps.alias("gaps"), "evidence", "broken")


def uncovered(requirements: DataFrame, traces: DataFrame) -> DataFrame:
    """Requirements with neither evidence nor acceptance criteria."""
    return requirements.where(F.coalesce(F.length("criteria"), F.lit(0)) == 0).join(traces.select(F.col("entity").alias("id")), "id", "left_anti").select("id")


def untraced(nodes: DataFrame, traces: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").isin("Requirement", "Decision", "Concept", "Validation")).join(traces.select(F.col("entity").alias("id")), "id", "left_anti").select("id", "type")


def rule_violations(nodes: DataFrame, edges: DataFrame, traces: DataFrame, rules: list[dict]) -> DataFrame:
    """Violations of declared rules: rule, predicate, source, target.

    Predicates: forbidden_edge and required_edge (source, target types, relation, direction out or in), forbidden_evidence (type, status),
    required_field (type, field), unique_by (type, field), at_most (type, relation, most), reaches (source, target types, relations), body_contains
    (type, words), acyclic (relations). A required rule without any constraint asks for nothing.
    """
    spark, out = nodes.sparkSession, []
    typed = lambda t: nodes.where(F.col("type") == t) if t else nodes
    ids = lambda t, c: typed(t).select(F.col("id").alias(c))
    for r in rules:
        p, none = r["predicate"], F.lit(None).cast("string").alias("target")
        e = edges if not r.get("relation") else edges.where(F.col("rel") == r["relation"])
        if r.get("direction") == "in":
            e = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "rel")
        if p in ("forbidden_edge", "required_edge"):
            if p == "required_edge" and not (r.get("source") or r.get("target") or r.get("relation")):
                continue
            hit = e.join(ids(r.get("source"), "source"), "source", "left_semi") if r.get("source") else e
            hit = hit.join(ids(r.get("target"), "target"), "target", "left_semi") if r.get("target") else hit
            rows = hit.select("source", "target") if p == "forbidden_edge" else ids(r.get("source"), "source").join(hit, "source", "left_anti").select("source", none)
        elif p == "forbidden_evidence":
            rows = traces.where(F.col("artifact_status") == r["status"]).select(F.col("entity").alias("source"), F.col("id").alias("target")).join(ids(r.get("type"), "source"), "source", "left_semi")
        elif p == "required_field":
            rows = typed(r.get("type")).where(F.coalesce(F.length(F.col(r["field"]).cast("string")), F.lit(0)) == 0).select(F.col("id").alias("source"), none)
        elif p == "unique_by":
            twice = typed(r.get("type")).groupBy(r["field"]).agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n > 1")
            rows = typed(r.get("type")).join(twice, r["field"]).where(F.col("id") != F.col("target")).select(F.col("id").alias("source"), "target")
        elif p == "at_most":
            rows = e.join(ids(r.get("type"), "source"), "source", "left_semi").groupBy("source").agg(F.countDistinct("target").alias("n")).where(F.col("n") > r["most"]).select("source", none)
        elif p == "reaches":
            back = graph.reversed_edges(graph.of_relations(edges, r.get("relations")))
            got = graph.reach(back, typed(r["target"]).select("id"), None, keep_seeds=True).select(F.col("id").alias("source"))
            rows = ids(r["source"], "source").join(got, "source", "left_anti").select("source", none)
        elif p == "body_contains":
            wanted = "(?i)" + "|".join(r["words"])
            rows = typed(r.get("type")).where(~F.coalesce(F.col("title").rlike(wanted), F.lit(False))).select(F.col("id").alias("source"), none)
        elif p == "acyclic":
            rows = graph.cycles_with_loops(edges, r["relations"]).select(F.col("id").alias("source"), F.col("component").alias("target"))
        else:
            raise ValueError(f"unknown predicate {p}")
        out.append(rows.select(F.lit(r["id"]).alias("rule"), F.lit(p).alias("predicate"), "source", "target"))
    if not out:
        return spark.createDataFrame([], "rule string, predicate string, source string, target string")
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


PRIORITY = {"1-URGENT": 20, "2-HIGH": 15, "3-MEDIUM": 8}


def work_plan(requirements: DataFrame, edges: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """id, score: 40 for each node that hangs on the requirement, its priority, halved by age with e as base (exp(-age / half_life)),
    and 50 more where it is current."""
    hang = edges.where(F.col("rel").isin("SOLVES", "VERIFIES", "TARGETS", "REFINES")).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n"))
    p = F.lit(4)
    for k, v in PRIORITY.items():
        p = F.when(F.col("priority") == k, v).otherwise(p)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("created_at")).cast("double")
    base = 40 * F.coalesce("n", F.lit(0)) + p
    score = base * F.exp(-F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0))) / half_life) + F.when(F.col("status") == "current", 50).otherwise(0)
    return requirements.join(hang, "id", "left").select("id", score.alias("score"))


def roadmap(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """By milestone: requirements, ready ones, readiness and the dominant pillar."""
    t = edges.where("rel = 'TARGETS'").select(F.col("source").alias("milestone"), F.col("target").alias("id"))
    b = edges.where("rel = 'BELONGS_TO'").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("pillar"))
    j = t.join(states.select("id", "state"), "id").join(b, "id", "left")
    count = j.groupBy("milestone").agg(F.count("*").alias("requirements"), F.count_if(F.col("state") == "done").alias("ready"))
    top = j.where("pillar is not null").groupBy("milestone", "pillar").agg(F.count("*").alias("n")).groupBy("milestone").agg(F.max(F.struct("n", "pillar"))["pillar"].alias("dominant_pillar"))
    return count.join(top, "milestone", "left").withColumn("readiness", F.col("ready") / F.col("requirements"))


def next_ids(nodes: DataFrame) -> DataFrame:
    """By prefix of the id: the greatest number in use and the next one."""
    n = F.regexp_extract("id", r"-(\d+)$", 1).cast("long")
    return nodes.groupBy(F.substring("id", 1, 3).alias("prefix")).agg(F.max(n).alias("last")).withColumn("next", F.col("last") + 1)
