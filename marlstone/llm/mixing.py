"""Mixing sources to target weights, with a cap on repeats (problem 3).

Records are ordered by a hash of their key. Sizes are summed by source and hash bucket; each (mixture, source)
budget falls into one bucket of its source, only that bucket is summed again by finer buckets, and in the one fine
bucket that is left single records are summed. The result is one hash threshold for each budget: a filter then
picks the records, and nothing is sorted or ranked. Thresholds of a source share the order, so a smaller budget's
records are also a larger one's.

A budget above a source's total size repeats the source whole, at most ``repeats`` times, and draws the rest. The
records taken up to a threshold are the longest run whose size stays within the budget.

Defined cases: keys count once, with their greatest size; one that was delivered under several sources is available in
each, but drawn in the first by spelling only, so a source may use less than its budget without being short; null keys, null sources and sources that no mixture names
take no part; a null or negative size is 0; a budget above repeats x total is short and uses all that is allowed; a
source without records is short by its whole budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import digest
from marlstone.functions.text import spelled_source

DIGITS = 3


def budgets_of(mixtures: DataFrame) -> DataFrame:
    """(mixture_id, source, budget, repeats, total): one row an entry; configuration size."""
    m = mixtures.select("mixture_id", "maximum_repeats_per_record", "total_questions", F.explode("public_source_quotas").alias("source", "budget"))
    m = m.where((F.col("budget") > 0) & F.col("mixture_id").isNotNull())
    whole = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("long")
    return m.select(
        "mixture_id", "source", F.col("budget").cast("long").alias("budget"), whole("maximum_repeats_per_record", 1).alias("repeats"),
        whole("total_questions", 0).alias("total")
    )


class Mix:
    """The parts of one mix: ``thresholds`` and ``report`` (one row a budget), ``records`` (key, uses)."""

    def __init__(self, rows: DataFrame, budgets: DataFrame, key: str = "sample_id", source: Column | None = None, size: Column | None = None):
        source = spelled_source("source") if source is None else source
        size = F.lit(1) if size is None else size
        r = rows.select(F.col(key).alias("key"), source.alias("source"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
        named = F.broadcast(budgets.select("source").distinct())
        r = r.where(F.col("key").isNotNull() & F.col("source").isNotNull()).join(named, "source", "left_semi")
        # a key is available in each source that it was delivered under, but drawn in the first by spelling only
        keys = r.groupBy("key").agg(F.collect_set("source").alias("sources"), F.max("size").alias("size"))
        each = keys.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("available"))
        keys = keys.select("key", F.array_min("sources").alias("source"), "size", digest("key").alias("rank"))

        def summed(rows: DataFrame, by: list[str], part: Column) -> DataFrame:
            s = rows.groupBy(*by, part.alias("part")).agg(F.sum("size").alias("sum"))
            return s.withColumn("before", F.sum("sum").over(W.partitionBy(*by).orderBy("part")) - F.col("sum"))

        ids = ["mixture_id", "source"]
        coarse = summed(keys, ["source"], F.substring("rank", 1, DIGITS))
        whole = coarse.groupBy("source").agg(F.sum("sum").alias("supply"))
        plan = budgets.join(whole, "source", "left").na.fill(0, ["supply"])
        plan = plan.withColumn("rounds", F.when(F.col("supply") > 0, F.least("repeats", F.floor(F.col("budget") / F.col("supply")))).otherwise(0))
        plan = plan.withColumn("rest", F.when(F.col("rounds") < F.col("repeats"), F.col("budget") - F.col("rounds") * F.col("supply")).otherwise(0))

        def crossed(asks: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
            """The part in which each budget's rest runs out, and what is left on reaching it."""
            hit = F.broadcast(asks).join(sums, by).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum")))
            return hit.withColumn("rest", F.col("rest") - F.col("before")).drop("before", "sum")

        first = crossed(plan.where("supply > 0").select(*ids, "rest"), coarse, ["source"]).withColumnRenamed("part", "p1")
        edge = keys.withColumn("p1", F.substring("rank", 1, DIGITS)).join(F.broadcast(first.select("source", "p1").distinct()), ["source", "p1"])
        second = crossed(
            first, summed(edge, ["source", "p1"], F.substring("rank", 1 + DIGITS, DIGITS)), ["source", "p1"]
        ).withColumnRenamed("part", "p2")
        edge = edge.withColumn("p2", F.substring("rank", 1 + DIGITS, DIGITS)).join(
            F.broadcast(second.select("source", "p1", "p2").distinct()), ["source", "p1", "p2"]
        )
        single = summed(edge, ["source", "p1", "p2"], F.col("rank"))
        last = F.broadcast(second).join(single, ["source", "p1", "p2"]).where(F.col("before") + F.col("sum") <= F.col("rest"))
        last = last.groupBy(*ids).agg(F.max("part").alias("to"), F.max(F.col("before") + F.col("sum")).alias("more"))
        found = second.join(last, ids, "left").select(
            *ids, F.coalesce("to", F.concat("p1", "p2")).alias("threshold"), (F.col("rest") - F.coalesce("more", F.lit(0))).alias("unused")
        )
        self.thresholds = plan.join(found, ids, "left").select(
            *ids, "budget", "repeats", "total", "supply", "rounds", F.coalesce("threshold", F.lit("")).alias("threshold"),
            F.when(F.col("supply") > 0, F.col("rounds") * F.col("supply") + F.col("rest") - F.coalesce("unused", F.lit(0))).otherwise(0).alias("used")
        )
        uses = (F.col("rounds") + F.when(F.col("rank") <= F.col("threshold"), 1).otherwise(0)).cast("int")
        picked = keys.join(F.broadcast(self.thresholds.select(*ids, "rounds", "threshold")), "source")
        self.records = picked.withColumn("uses", uses).where("uses > 0").select("mixture_id", F.col("key").alias(key), "source", "uses")

        def report(t: DataFrame) -> DataFrame:
            share = F.col("used") / F.greatest(F.sum("used").over(W.partitionBy("mixture_id")), F.lit(1))
            return t.select(
                *ids, "budget", "repeats", "available", "used", (F.col("budget") / F.greatest("total", F.lit(1))).alias("target_share"),
                share.alias("actual_share"), (F.col("budget") > F.col("repeats") * F.col("available")).alias("short")
            )

        self.report = report(self.thresholds.join(F.broadcast(each), "source", "left").na.fill(0, ["available"]))
