"""Exact hash-ordered cuts of groups of any size, without sorting a group in one task.

A group may hold a third of all rows. Its rows are spread over 16**digits hash buckets, which are counted with
partial aggregation; a running sum over the counts finds the one bucket in which the cut falls, and only that
bucket is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DIGITS = 3


def bucket_counts(rows: DataFrame, by: list[str], rank: str = "rank", digits: int = DIGITS) -> DataFrame:
    """(by, bucket, n, before): rows of each hash bucket and the rows of the group's earlier buckets."""
    n = rows.groupBy(*by, F.substring(rank, 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by).orderBy("bucket")
    return n.withColumn("before", F.sum("n").over(w) - F.col("n"))


def first_by_rank(
    rows: DataFrame, by: list[str], quota: DataFrame, counts: DataFrame | None = None, rank: str = "rank", tie: str | None = None,
    digits: int = DIGITS
) -> DataFrame:
    """The ``quota`` rows of least rank in each group.

    rows: has ``by`` and the hex digest ``rank``. quota: ``by`` and ``take``, one row a group, of configuration size
    (it is broadcast, and so is one row of its cut bucket each). Ties of rank are broken by ``tie``. Groups without
    a quota, a null or a zero quota give no rows; null group values match nothing.
    """
    counts = bucket_counts(rows, by, rank, digits) if counts is None else counts
    cut = counts.join(F.broadcast(quota), by).where((F.col("take") > 0) & (F.col("before") < F.col("take")))
    cut = cut.groupBy(*by).agg(F.max(F.struct("bucket", "before")).alias("at"), F.first("take").alias("take"))
    cut = cut.select(*by, "take", F.col("at.bucket").alias("_last"), F.col("at.before").alias("_before"))
    near = rows.join(F.broadcast(cut), by).withColumn("_b", F.substring(rank, 1, digits)).where(F.col("_b") <= F.col("_last"))
    whole = near.where(F.col("_b") < F.col("_last"))
    order: list[Column | str] = [rank] + ([tie] if tie else [])
    edge = near.where(F.col("_b") == F.col("_last"))
    edge = edge.withColumn(
        "_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))
    ).where(F.col("_before") + F.col("_n") <= F.col("take")).drop("_n")
    return whole.unionByName(edge).drop("_b", "_last", "_before", "take")
