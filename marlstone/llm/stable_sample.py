"""A sample that is the same at every run and layout and only ever gains members (problem 1).

Keys fall for ever into 16**DIGITS fine buckets by an unkeyed hash. Each plan orders the buckets by a permutation
that its seed fixes, and holds a list of the first few. The list is append-only: intake by intake it is extended
until the buckets on it hold the plan's size due by then, and never shortened. As an intake's bucket counts only
depend on that and earlier intakes, later intakes can't take a bucket off the list, nor a key out of the sample.

Sizes fall due evenly over the first ``intakes`` batches (a batch counts by its place among those that brought new keys), so the
list settles at the plan's share of a whole intake period instead of taking in whole early batches; afterwards the
sample keeps growing in proportion to the data. A plan larger than the supply lists all buckets.

Defined cases: rows with a null key are no members; a key counts once, in its first batch; a null batch is never
the first of several and its keys take no part in extending the list, but are members where their bucket is
listed; plans with a null or non-positive size list nothing; duplicate plan ids are an error of the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import digest, hex_bucket, rank

DIGITS = 3
INTAKES = 16


def first_seen(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """(key, batch, bucket): each key once, with its first batch and its permanent bucket."""
    keys = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(batch).alias("batch"))
    return keys.withColumn("bucket", hex_bucket(digest("key"), DIGITS))


def bucket_list(keys: DataFrame, plans: DataFrame, intakes: int = INTAKES) -> DataFrame:
    """(plan_id, bucket, position, opened): the buckets on each plan's list and the intake that put them there.

    plans: plan_id, seed, size. All tables from the counts on are bounded by buckets x intakes x plans.
    """
    counts = keys.where(F.col("batch").isNotNull()).groupBy("bucket", "batch").agg(F.count(F.lit(1)).alias("n"))
    # every bucket, also those without keys so far, so that a bucket's position never changes
    names = F.transform(F.sequence(F.lit(0), F.lit(16**DIGITS - 1)), lambda i: F.lower(F.lpad(F.hex(i), DIGITS, "0")))
    # a running sum for each bucket over the list of all batches, which is one row
    batches = counts.agg(F.sort_array(F.collect_set("batch")).alias("batches"))
    grid = batches.select(F.explode(names).alias("bucket"), "batches").repartition("bucket").select(
        "bucket", F.posexplode("batches").alias("place", "intake")
    )
    upto = grid.join(counts.withColumnRenamed("batch", "intake"), ["bucket", "intake"], "left").withColumn("place", F.col("place") + 1)
    upto = upto.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("bucket").orderBy("place")))
    order = plans.where(F.col("size") > 0).select("plan_id", "seed", "size", F.explode(names).alias("bucket"))
    order = order.withColumn("position", F.row_number().over(W.partitionBy("plan_id").orderBy(rank(F.col("seed"), "bucket"), "bucket")))
    held = order.join(upto, "bucket")
    held = held.withColumn("sum", F.sum("n").over(W.partitionBy("plan_id", "intake").orderBy("position")))
    held = held.withColumn("due", F.ceil(F.col("size") * F.least(F.col("place"), F.lit(intakes)) / F.lit(intakes)))
    reach = held.groupBy("plan_id", "intake").agg(F.min(F.when(F.col("sum") >= F.col("due"), F.col("position"))).alias("length"))
    reach = reach.withColumn("length", F.coalesce("length", F.lit(16**DIGITS)))
    length = F.max("length").over(W.partitionBy("plan_id").orderBy("intake"))
    steps = reach.withColumn("to", length).groupBy("plan_id", "to").agg(F.min("intake").alias("opened"))
    steps = steps.withColumn("after", F.lag("to", 1, 0).over(W.partitionBy("plan_id").orderBy("to")))
    listed = order.select("plan_id", "bucket", "position").join(F.broadcast(steps), "plan_id")
    return listed.where("position > after and position <= to").select("plan_id", "bucket", "position", "opened")


def stable_sample(rows: DataFrame, plans: DataFrame, key: str = "sample_id", batch: str = "ingest_batch", intakes: int = INTAKES) -> DataFrame:
    """(plan_id, key, bucket, position, first_batch): the sample of each plan.

    One shuffle of the distinct keys; the bucket list has at most 16**DIGITS rows a plan and is broadcast.
    """
    keys = first_seen(rows, key, batch)
    listed = bucket_list(keys, plans, intakes)
    out = keys.join(F.broadcast(listed), "bucket")
    return out.select(
        "plan_id", F.col("key").alias(key), "bucket", F.col("position").cast("int").alias("position"), F.col("batch").alias("first_batch")
    )


def shortfall(keys: DataFrame, plans: DataFrame, intakes: int = INTAKES) -> DataFrame:
    """(plan_id, size, supply, undated, intakes, members, short): what each plan asks for and what its sample holds.

    supply: all keys; undated: those without a batch; intakes: batches that brought new keys; short: what members lack
    of the size, because sizes aren't due yet, all batches are null or the supply is smaller.
    """
    counts = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = keys.agg(
        F.count(F.lit(1)).alias("supply"), F.count_if(F.col("batch").isNull()).alias("undated"), F.count_distinct("batch").alias("intakes")
    )
    held = bucket_list(keys, plans, intakes).join(F.broadcast(counts), "bucket").groupBy("plan_id").agg(F.sum("n").alias("members"))
    out = plans.select("plan_id", "size").join(F.broadcast(held), "plan_id", "left").crossJoin(F.broadcast(whole)).na.fill(0, ["members"])
    return out.select(
        "plan_id", "size", "supply", "undated", "intakes", "members",
        F.greatest(F.coalesce("size", F.lit(0)) - F.col("members"), F.lit(0)).alias("short")
    )
