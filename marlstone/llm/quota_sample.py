"""A sample with given shares over a tree of categories (problem 2).

The tree is mixture > source > task type. Numbers are allotted from the top: a source gets its quota (its own, or
the sum of its task types'), or all it has; within it each task type gets its quota, or all it has. A task type's unmet quota therefore goes to its
siblings while the source has spare records, and only what the whole source lacks goes to the other sources, in
proportion to their quotas. Small categories keep a minimum as far as their supply goes. The tree has the size of
the configuration; the records are only counted, and drawn at the leaves by hash rank.

Defined cases: a record is a distinct key; one with a null source or task type belongs to no category; one that was
delivered under several categories is available in each, but drawn in the first by spelling only; a quota that is
null or not above zero is no entry; an empty table gives drawn 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import rank
from marlstone.functions.text import spelled, spelled_source
from marlstone.operators.ranking import first_by_rank

#: Stands for all task types of a source that only has a quota of its own; no task type is spelled so.
ANY = ""
REPORT = "mixture_id string, source string, task_type string, quota long, available long, minimum long, drawn long, received long, unmet long, target_share double, actual_share double"


def spread(amount: int, weights: Sequence[float], least: Sequence[int], most: Sequence[int]) -> list[int]:
    """Whole numbers in proportion to the weights, each between its least and most, that add up to the amount.

    The amount is first brought between the sums of both. Fractions go to the largest remainder, ties to the first.
    """
    n = len(weights)
    amount = max(sum(least), min(amount, sum(most)))
    lo, hi = 0.0, 1.0
    at = lambda f: [min(max(f * weights[i], least[i]), most[i]) for i in range(n)]
    while sum(at(hi)) < amount and hi < 1e18:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < amount else (lo, mid)
    exact = at(hi)
    whole = [int(x + 1e-9) for x in exact]
    rest = amount - sum(whole)
    for i in sorted(range(n), key=lambda i: (-(exact[i] - whole[i]), i)):
        step = max(-(whole[i] - least[i]), min(rest, most[i] - whole[i], 1 if rest > 0 else rest))
        whole[i] += step
        rest -= step
    for i in range(n):  # a weight of zero, or rounding at the bounds
        step = max(-(whole[i] - least[i]), min(rest, most[i] - whole[i]))
        whole[i] += step
        rest -= step
    return whole


def allot(leaves: pd.DataFrame) -> pd.DataFrame:
    """The report of one mixture; leaves: its entries with quota, source_quota, available, capacity, minimum and total."""
    leaves = leaves.sort_values(["source", "task_type"], kind="stable").reset_index(drop=True)
    least = [int(min(m, c)) for m, c in zip(leaves["minimum"], leaves["capacity"])]
    most = [int(c) for c in leaves["capacity"]]
    of = {s: list(g.index) for s, g in leaves.groupby("source", sort=True)}
    sums = lambda x: [sum(x[i] for i in ix) for ix in of.values()]
    quota = [int(q) for q in leaves["quota"]]
    drawn = [0] * len(leaves)
    # a source's own quota decides its amount; without one, those of its task types do
    own = leaves["source_quota"]
    weights = [q if pd.isna(own[ix[0]]) else int(own[ix[0]]) for ix, q in zip(of.values(), sums(quota))]
    share = {i: w / max(1, sum(weights)) if w != q else None for ix, w, q in zip(of.values(), weights, sums(quota)) for i in ix}
    within = {i: quota[i] / max(1, q) for ix, q in zip(of.values(), sums(quota)) for i in ix}
    for ix, amount in zip(of.values(), spread(int(leaves["total"].iloc[0]), weights, sums(least), sums(most))):
        got = spread(amount, [quota[i] for i in ix], [least[i] for i in ix], [most[i] for i in ix])
        for i, g in zip(ix, got):
            drawn[i] = g
    out = leaves[["mixture_id", "source", "task_type", "quota", "available", "minimum"]].copy()
    out["drawn"] = drawn
    out["received"] = [max(0, d - q) for d, q in zip(drawn, quota)]
    out["unmet"] = [max(0, q - d) for d, q in zip(drawn, quota)]
    out["target_share"] = [q / max(1, sum(weights)) if share[i] is None else share[i] * within[i] for i, q in enumerate(quota)]
    out["actual_share"] = [d / max(1, sum(drawn)) for d in drawn]
    return out


def entries(mixtures: DataFrame) -> DataFrame:
    """(mixture_id, source, task_type, quota, minimum, total, source_quota): one row an entry; configuration size.

    A source with a quota of its own and none for a task type is one entry of the task type ANY.
    """
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    known = mixtures.where("mixture_id is not null").withColumn(
        "minimum", whole("minimum_questions_per_category")
    ).withColumn("total", whole("total_questions"))
    m = known.select("mixture_id", "minimum", "total", F.explode("public_source_task_quotas").alias("source", "_tasks"))
    m = m.select("*", F.explode("_tasks").alias("task_type", "quota")).where("quota > 0")
    tasks = m.select("mixture_id", "source", "task_type", F.col("quota").cast("long").alias("quota"), "minimum", "total")
    if "public_source_quotas" not in mixtures.columns:
        return tasks.withColumn("source_quota", F.lit(None).cast("long"))
    own = known.select("mixture_id", "minimum", "total", F.explode("public_source_quotas").alias("source", "source_quota")).where("source_quota > 0")
    own = own.withColumn("source_quota", F.col("source_quota").cast("long"))
    alone = own.join(tasks.select("mixture_id", "source").distinct(), ["mixture_id", "source"], "left_anti")
    alone = alone.select(
        "mixture_id", "source", F.lit(ANY).alias("task_type"), F.col("source_quota").alias("quota"), "minimum", "total", "source_quota"
    )
    return tasks.join(own.select("mixture_id", "source", "source_quota"), ["mixture_id", "source"], "left").select(*alone.columns).unionByName(alone)


def categorised(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, cats): each key once with the set of its (source, task_type); the set is bounded by the spellings kept."""
    r = rows.select(F.col(key).alias("key"), spelled_source("source").alias("source"), spelled("task_type").alias("task_type"))
    known = r.where(F.col("key").isNotNull() & F.col("source").isNotNull() & F.col("task_type").isNotNull())
    return known.groupBy("key").agg(F.collect_set(F.struct("source", "task_type")).alias("cats"))


class QuotaSample:
    """The parts of one draw: ``report`` (one row an entry) and ``drawn`` (one row a record of each mixture)."""

    def __init__(self, rows: DataFrame, mixtures: DataFrame, key: str = "sample_id"):
        keys = categorised(rows, key)
        leaf, by = ["source", "task_type"], ["mixture_id", "source", "task_type"]
        listed = entries(mixtures)
        every = lambda c: F.struct(c["source"].alias("source"), F.lit(ANY).alias("task_type"))
        each = keys.select(
            "key", F.explode(F.array_union("cats", F.transform("cats", every))).alias("c")
        ).select("key", "c.*").groupBy(*leaf).agg(F.count(F.lit(1)).alias("available"))
        home = keys.select("key", F.array_min("cats").alias("c")).select(
            "key", F.col("c.task_type").alias("own"), F.explode(F.array("c", every(F.col("c")))).alias("c")
        ).select("key", "own", "c.*")
        supply = home.groupBy(*leaf).agg(F.count(F.lit(1)).alias("capacity"))
        tree = listed.join(each, leaf, "left").join(supply, leaf, "left").na.fill(0, ["available", "capacity"])
        allotted = tree.groupBy("mixture_id").applyInPandas(allot, REPORT)
        # a null task type in the report: a source without quotas of task types
        self.report = allotted.withColumn("task_type", F.expr(f"nullif(task_type, '{ANY}')"))
        # one row for each record and mixture that names its category
        asked = home.join(F.broadcast(listed.select(*by)), leaf).withColumn("rank", rank(F.col("mixture_id"), "key"))
        take = allotted.select(*by, F.col("drawn").alias("take"))
        self.drawn = first_by_rank(asked, by, take, tie="key").select(
            "mixture_id", F.col("key").alias(key), "source", F.col("own").alias("task_type")
        )
