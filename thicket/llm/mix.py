"""Mixing sources to target weights by hierarchical budgeting.

The targets form a tree domain - language - source: each source spreads its target share over its languages by their
tokens, a language of a domain has the sum of its sources there, a domain the sum of its languages. A leaf holds at most max_repeats times
its tokens. What a leaf cannot hold goes to its siblings first, then to the siblings of its parent, up
to the root, in proportion to their targets. Each leaf then yields a prefix of its token stream: whole
epochs, each in an order seeded by (seed, epoch), and a part of the last one, whose last document is cut
so that the budget is met to the token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Domain of each source of the corpus; unnamed ones form the domain "other". A parameter of mix().
DOMAINS = {
    "review_threads": "discussion", "mailbox": "discussion", "issue_mirror": "discussion", "chat_export": "discussion", "forum_mirror": "discussion",
    "survey_answers": "discussion", "friction_reports": "discussion", "decision_records": "records", "working_notes": "records", "handoffs": "records",
    "release_notes": "records", "practice_cards": "records", "glossary": "records", "incident_log": "records", "bench_reports": "records",
    "archive_tape": "records", "source_excerpts": "code", "docstrings": "code", "commit_log": "code",
}
SEED, BUCKET_ROWS = 20, 20_000


@dataclass
class Node:
    name: tuple
    weight: float = 0.0
    room: float = 0.0
    budget: float = 0.0
    children: list[Node] = field(default_factory=list)


def pour(node: Node, amount: float) -> None:
    """Budget of every node below: amount by weight, shortages first among siblings."""
    node.budget = amount = min(amount, node.room)
    open_, left = [c for c in node.children if c.room > 0], amount
    for c in node.children:
        c.budget = 0.0
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_)
        # children without any target take from what is left only after those with one
        share = {id(c): left * (c.weight / total if total > 0 else 1 / len(open_)) for c in open_}
        full = [c for c in open_ if c.budget + share[id(c)] >= c.room]
        if not full:
            for c in open_:
                c.budget += share[id(c)]
            break
        for c in full:
            left -= c.room - c.budget
            c.budget = c.room
        open_ = [c for c in open_ if c.budget < c.room]
    for c in node.children:
        pour(c, c.budget)


def feasible_total(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]]) -> int:
    """The most tokens of a mixture in which no source with documents falls short of its share within its repeats; 0 without any.

    A listed source without documents cannot be met by any total: its share goes to others and sets no limit.
    """
    have: dict[str, int] = {}
    for s, _, n in leaves:
        have[s] = have.get(s, 0) + n
    limits = [have[s] * max(r, 0) / share for s, (share, r) in targets.items() if share > 0 and have.get(s, 0) > 0]
    return math.floor(min(limits)) if limits else 0


def plan(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: int | None, domains: dict[str, str]) -> dict[tuple[str, str], int]:
    """Token budget of each (source, language). leaves: source, language, tokens; targets: source -> share, repeats.

    total None: the largest at which every listed source that has documents reaches its share.
    """
    known = [(s, g, n) for s, g, n in leaves if s in targets and n > 0]
    if total is None:
        total = feasible_total(leaves, targets)
    root = Node(("all",))
    by: dict[tuple, Node] = {}
    size: dict[str, int] = {}
    for s, _, n in known:
        size[s] = size.get(s, 0) + n
    for s, g, n in sorted(known):
        share, repeats = targets[s]
        d = domains.get(s, "other")
        for path, parent in (((d,), root), ((d, g), (d,)), ((d, g, s), (d, g))):
            if path not in by:
                by[path] = Node(path)
                (parent if isinstance(parent, Node) else by[parent]).children.append(by[path])
        room, weight = n * max(repeats, 0), share * n / size[s]
        for path in ((d,), (d, g), (d, g, s)):
            by[path].room += room
            by[path].weight += weight
        root.room += room
        root.weight += weight
    pour(root, float(total))
    budgets = {(p[2], p[1]): c.budget for p, c in by.items() if len(p) == 3}
    whole = {k: math.floor(v + 1e-6) for k, v in budgets.items()}
    # the largest remainders take what rounding left, within each leaf's room
    left = math.floor(min(float(total), root.room) + 1e-6) - sum(whole.values())
    for k in sorted(budgets, key=lambda k: (whole[k] - budgets[k], k))[: max(0, left)]:
        d = domains.get(k[0], "other")
        if whole[k] + 1 <= by[d, k[1], k[0]].room:
            whole[k] += 1
    return whole


def language(lang: Column) -> Column:
    """Lower-case two-letter code; 'und' where it is missing."""
    return F.coalesce(F.nullif(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit("")), F.lit("und"))


def mix(
    sized: DataFrame, targets: DataFrame, total: int | None = None, domains: dict[str, str] | None = None, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    sized: doc_id (unique), source, lang, tokens; targets: source, target_share, max_repeats (one row per source,
    a small table that comes to the driver; the highest share counts where one is repeated, null means 0).
    Mixture: doc_id, source, lang, epoch (from 1), tokens_used; a document of no tokens, and one of a source that is not
    listed or null, takes no part. Report: source, target_share, actual_share, available_tokens, used_tokens,
    max_repeats, repeats, feasible_total (the most tokens at which all shares can be met, and the total by default); one row per target, also without documents. Running sums go over hashed buckets of a
    leaf, never over a whole leaf in one task.
    """
    spark = sized.sparkSession
    want: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").collect():
        if r[0] is not None:
            want[r[0]] = max(want.get(r[0], (0.0, 0)), (float(r[1] or 0), int(r[2] or 0)))
    docs = sized.select("doc_id", "source", language(F.col("lang")).alias("lang"), F.col("tokens").cast("long").alias("n"))
    docs = docs.where(F.col("source").isin(list(want)) & (F.col("n") > 0) & F.col("doc_id").isNotNull())
    # one row for each source and language
    sums = docs.groupBy("source", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    leaves = [(r["source"], r["lang"], r["n"]) for r in sums]
    budgets, feasible = plan(leaves, want, total, domains or DOMAINS), feasible_total(leaves, want)
    rows = [
        (r["source"], r["lang"], budgets.get((r["source"], r["lang"]), 0), r["n"], max(1, math.ceil(r["rows"] / bucket_rows)))
        for r in sums
    ]
    leaf = spark.createDataFrame(rows, "source string, lang string, budget long, size long, buckets long")
    taken = docs.join(F.broadcast(leaf.where("budget > 0")), ["source", "lang"]).withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("budget") / F.col("size")).cast("int")))
    )
    whole = taken.where(F.col("epoch") * F.col("size") <= F.col("budget")).select("doc_id", "source", "lang", "epoch", F.col("n").alias("tokens_used"))
    # only the last epoch is a prefix; its order is a hash, cut into buckets of consecutive hashes
    last = taken.where(F.col("epoch") * F.col("size") > F.col("budget")).withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id"))
    width = (F.lit(2.0**64) / F.col("buckets")).cast("double")
    last = last.withColumn("bucket", F.least(F.floor((F.col("h").cast("double") + F.lit(2.0**63)) / width), F.col("buckets") - 1))
    key = ["source", "lang", "bucket"]
    parts = last.groupBy(*key).agg(F.sum("n").alias("b"))
    ahead = Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("b").over(ahead), F.lit(0))).drop("b")
    within = Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    prefix = (
        last.join(parts, key)
        .withColumn("upto", F.col("before") + F.sum("n").over(within))
        .withColumn("rest", F.col("budget") - (F.col("epoch") - 1) * F.col("size") - (F.col("upto") - F.col("n")))
        .where(F.col("rest") > 0)
        .select("doc_id", "source", "lang", "epoch", F.least("n", "rest").alias("tokens_used"))
    )
    used: dict[str, int] = {}
    have: dict[str, int] = {}
    for s, _, b, n, _ in rows:
        used[s], have[s] = used.get(s, 0) + b, have.get(s, 0) + n
    everything = sum(used.values()) or 1
    report = [
        (s, share, used.get(s, 0) / everything, have.get(s, 0), used.get(s, 0), repeats, used.get(s, 0) / have[s] if have.get(s) else 0.0, feasible)
        for s, (share, repeats) in sorted(want.items())
    ]
    shares = spark.createDataFrame(
        report, "source string, target_share double, actual_share double, available_tokens long, used_tokens long, max_repeats int, repeats double, feasible_total long"
    )
    return whole.unionByName(prefix), shares
