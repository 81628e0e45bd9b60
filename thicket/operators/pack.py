"""The named property-graph queries over nodes(id, label, project_code, name, ...) and edges(from_id, to_id, relation_type).

Shared rules: project '' means all; optional matches are left joins; counts are distinct; samples are the first by
order, so that results do not depend on the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators import graph


def scoped(nodes: DataFrame, project: str) -> DataFrame:
    return nodes if project in ("", "*") else nodes.where(F.col("project_code") == project)


def with_sample(rows: DataFrame, values: DataFrame, n: int, name: str) -> DataFrame:
    """rows by id with the first n distinct values (id, n) of each as one text; the values are ranked and cut before any list is made."""
    first = graph.at_most(values.select("id", "n").where("n is not null").distinct(), "id", "n", n)
    text = first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias(name))
    return rows.join(text, "id", "left").na.fill("", [name])


def sample(c: Column, n: int) -> Column:
    """The first n distinct values of a column of few, such as relations."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ",")


def _ends(nodes: DataFrame, edges: DataFrame, columns: tuple[str, ...] = ("label", "project_code", "name")) -> DataFrame:
    pick = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(pick("from"), "from_id").join(pick("to"), "to_id")


def _degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    i = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_degree"))
    o = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_degree"))
    d = nodes.join(i, "id", "left").join(o, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def calls_hotspots_with_file(nodes: DataFrame, edges: DataFrame, top: int = 200) -> DataFrame:
    called = edges.where("relation_type = 'CALLS'").select(F.col("from_id").alias("id"), F.col("to_id").alias("n"))
    c = with_sample(called.groupBy("id").agg(F.countDistinct("n").alias("callees")), called, 20, "callee_sample")
    f = edges.where("relation_type = 'CONTAINS'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("file_id"))
    return c.join(nodes.where("label = 'Symbol'").select("id", "project_code"), "id").join(f, "id", "left").orderBy(F.desc("callees"), "id").limit(top)


def cross_project_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = _ends(nodes, edges).where("from_project_code <> to_project_code")
    return e.groupBy("from_project_code", "to_project_code", "relation_type").agg(F.count("*").alias("links"))


def _signal() -> Column:
    return F.when(~F.col("graph_ready"), "graph_missing").when(~F.col("vector_ready"), "vector_missing").otherwise("ready")


def drift_readiness_signals(nodes: DataFrame) -> DataFrame:
    f = nodes.where("label = 'File'").groupBy("project_code", "status", "graph_ready", "vector_ready").agg(F.count("*").alias("files"))
    s = f.withColumn("signal", _signal())
    return s.withColumn("rank", F.when(F.col("signal") == "graph_missing", 1).when(F.col("signal") == "vector_missing", 2).otherwise(3))


def evidence_inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("relation_type = 'TRACEABLE_TO'").select(F.col("to_id").alias("id"), "from_id")
    return nodes.where("label = 'Evidence'").join(e, "id", "left").groupBy("kind").agg(F.countDistinct("id").alias("items"), F.countDistinct("from_id").alias("intents"))


def files_by_readiness(nodes: DataFrame) -> DataFrame:
    f = nodes.where("label = 'File'")
    return f.groupBy("graph_ready", "vector_ready").agg(F.count("*").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


def high_degree_nodes(nodes: DataFrame, edges: DataFrame, least: int = 25, top: int = 300) -> DataFrame:
    return _degree(nodes, edges).where(F.col("degree") >= least).select("id", "label", "in_degree", "out_degree", "degree").orderBy(F.desc("degree"), "id").limit(top)


def ist_hot_symbols(nodes: DataFrame, edges: DataFrame, top: int = 200) -> DataFrame:
    return _degree(nodes.where("label = 'Symbol'"), edges).select("id", "in_degree", "out_degree", "degree").orderBy(F.desc("degree"), "id").limit(top)


def _isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("from_id").alias("id")), "id", "left_anti").join(edges.select(F.col("to_id").alias("id")), "id", "left_anti")


def ist_orphan_symbols(nodes: DataFrame, edges: DataFrame, top: int = 300) -> DataFrame:
    return _isolated(nodes.where("label = 'Symbol'"), edges).select("id", "project_code", "name").orderBy("project_code", "id").limit(top)


def orphan_soll_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _isolated(nodes.where(F.col("label").isin("Requirement", "Decision", "Validation")), edges).select("id", "label", "status")


LABELS = ("File", "Symbol", "Requirement", "Decision", "Validation", "Pillar", "Evidence")


def project_code_inventory(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_code").agg(*[F.count_if(F.col("label") == x).alias(x.lower() + "s") for x in LABELS], F.count("*").alias("nodes"))


def project_dashboard(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_code", "label").agg(F.count("*").alias("nodes"))


def project_entry_points(nodes: DataFrame, edges: DataFrame, top: int = 200) -> DataFrame:
    s = edges.where("relation_type = 'CONTAINS'").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("symbols"))
    f = _degree(nodes.where("label = 'File'"), edges).join(s, "id", "left")
    return f.select("id", "degree", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("size_bytes", F.lit(0)).alias("bytes")).orderBy(F.desc("degree"), F.desc("symbols"), "id").limit(top)


def project_health_scoreboard(nodes: DataFrame) -> DataFrame:
    f = F.col("label") == "File"
    return project_code_inventory(nodes).join(
        nodes.groupBy("project_code").agg(F.count_if(f & F.col("graph_ready")).alias("graph_ready_files"), F.count_if(f & F.col("vector_ready")).alias("vector_ready_files")), "project_code"
    )


def project_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges).groupBy(F.coalesce("from_project_code", "to_project_code").alias("project_code"), "relation_type").agg(F.count("*").alias("links"))


def soll_decision_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = nodes.where("label = 'Decision'").select("id")
    one = d.join(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("n")), "id")
    two = one.join(edges.select(F.col("from_id").alias("n"), F.col("to_id").alias("m")), "n").select("id", F.col("m").alias("n"))
    both = one.unionByName(two).select("id", "n")
    return with_sample(both.groupBy("id").agg(F.countDistinct("n").alias("reached")), both, 20, "reached_sample")


def _linked(edges: DataFrame, rel: str, name: str) -> DataFrame:
    return edges.where(F.col("relation_type") == rel).groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias(name))


def _evidence(edges: DataFrame) -> DataFrame:
    return edges.where("relation_type = 'TRACEABLE_TO'").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("evidence"))


def requirement_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    r = nodes.where("label = 'Requirement'").select("id", "status")
    r = r.join(_linked(edges, "SOLVES", "decisions"), "id", "left").join(_linked(edges, "VERIFIES", "validations"), "id", "left").join(_evidence(edges), "id", "left")
    return r.na.fill(0, ["decisions", "validations", "evidence"])


def soll_requirement_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    r = requirement_coverage(nodes, edges)
    risk = F.when((F.col("evidence") == 0) & (F.col("validations") == 0), "high").when((F.col("evidence") == 0) | (F.col("validations") == 0), "medium").otherwise("low")
    return r.withColumn("risk", risk)


def top_evidence_references(nodes: DataFrame, edges: DataFrame, top: int = 100) -> DataFrame:
    e = edges.where("relation_type = 'TRACEABLE_TO'").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("intents"))
    return nodes.where("label = 'Evidence'").select("id", "kind").join(e, "id").orderBy(F.desc("intents"), "id").limit(top)


def trace_target_context(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Nodes matching a target by id, name, title or path (equal or contained) with their neighbours within two hops."""
    hit = F.lit(False)
    for c in ("id", "name", "title", "path"):
        hit = hit | (F.col(c) == target) | F.col(c).contains(target)
    m = nodes.where(hit).select("id", "label")
    u = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionAll(edges.select("to_id", "from_id"))
    one = m.select("id").join(u.withColumnRenamed("a", "id"), "id").select("id", F.col("b").alias("n")).distinct()
    two = one.join(u.select(F.col("a").alias("n"), F.col("b").alias("m")), "n").where("m <> id").select("id", F.col("m").alias("n")).distinct()
    g = lambda d, x: with_sample(d.groupBy("id").agg(F.count("*").alias(x)), d, 10, x + "_sample")
    return m.join(g(one, "one_hop"), "id", "left").join(g(two, "two_hop"), "id", "left").na.fill(0, ["one_hop", "two_hop"])


def traceability_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.where(F.col("label").isin("Requirement", "Decision", "Validation")).join(edges.where("relation_type = 'TRACEABLE_TO'").select(F.col("from_id").alias("id")), "id", "left_anti")
    return n.select("id", "label", F.when(F.col("label") == "Requirement", "missing_evidence").when(F.col("label") == "Decision", "missing_implementation").otherwise("missing_proof").alias("gap"))


def unresolved_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _degree(nodes.where("label = 'UnresolvedEndpoint'"), edges).select("id", "in_degree", "out_degree", "degree")


def why_unresolved_endpoint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    u = nodes.where("label = 'UnresolvedEndpoint'").select("id")
    side = lambda a, b, x: with_sample(edges.groupBy(F.col(a).alias("id")).agg(sample(F.col("relation_type"), 10).alias(x + "_relations")), edges.select(F.col(a).alias("id"), F.col(b).alias("n")), 5, x + "_sample")
    i, o = side("to_id", "from_id", "in"), side("from_id", "to_id", "out")
    return u.join(i, "id", "left").join(o, "id", "left")


def hot_files(nodes: DataFrame, top: int = 100) -> DataFrame:
    return nodes.where("label = 'File'").select("id", "path", "status", F.coalesce("size_bytes", F.lit(0)).alias("bytes")).orderBy(F.desc("bytes"), "id").limit(top)


def ist_soll_traceability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("relation_type = 'TRACEABLE_TO'")
    return e.join(nodes.select(F.col("id").alias("from_id"), F.col("label").alias("intent_label")), "from_id").join(nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("evidence_kind")), "to_id").select("from_id", "intent_label", "to_id", "evidence_kind")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "name", "n")
    return n.unionByName(edges.groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "name", "n"))


def soll_decisions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("from_id").alias("id"), F.concat("relation_type", F.lit(" -> "), "to_id").alias("link"))
    return nodes.where("label = 'Decision'").select("id", "status").join(e, "id", "left").groupBy("id", "status").agg(F.array_join(F.array_sort(F.collect_set("link")), ",").alias("links"))
