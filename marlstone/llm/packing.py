"""Filling containers of fixed token capacity with documents (problem 7).

An item's cost is estimated as linear in its tokens plus quadratic for attention. Items go, longest first, to the
open container of least cost that still has room for them; a new one is opened only if none has. Containers open at
the start are as many as the shard's tokens need at least, so cost stays even and little room stays unused.

Items are spread over shards by a hash of their key; a shard holds about ``PER_SHARD`` containers' worth of tokens,
whatever the size of the table, and is packed in one task. The number of shards follows the tokens.

Only a document longer than a container is split: into full containers, and a rest that is packed like any other.

Defined cases: a document without tokens (null or empty text) is placed in the least costly container, taking no
room; in a shard of only such documents one container is opened; rows with a null key are packed as one more
document each; repeated keys are separate items; a budget with a null or non-positive capacity gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_SHARD = 128
#: Cost of n tokens: n * LINEAR + n * n * QUADRATIC; for a model of width 4096 attention passes the rest near 24k tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 24_576


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items given in descending size, none above the capacity."""
    n = max(1, -(-int(sizes.sum()) // capacity))
    room = [capacity] * n
    heap = [(0.0, i) for i in range(n)]
    out = np.zeros(len(sizes), dtype=np.int64)
    for k, size in enumerate(map(int, sizes)):
        passed = []
        while heap and room[heap[0][1]] < size:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, i = heapq.heappop(heap)
        else:
            cost, i = 0.0, len(room)
            room.append(capacity)
        room[i] -= size
        out[k] = i
        for p in passed:
            heapq.heappush(heap, p)
        heapq.heappush(heap, (cost + size * LINEAR + size * size * QUADRATIC, i))
    return out


def pack_corpus(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", per_shard: int = PER_SHARD) -> DataFrame:
    """(budget_id, container, key, piece, start, n_tokens): where each piece of each document goes.

    sizes: key, n_tokens, read twice, so best a written table. budgets: budget_id, capacity_tokens; a few rows of
    configuration. A container's name is its shard and number
    for packed items, and its document and piece for a full piece of a split document.
    """
    kind = sizes.schema[key].dataType.simpleString()
    s = sizes.select(F.col(key).alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
    total = s.agg(F.sum("n").alias("n")).first()["n"] or 0
    known = [(r["budget_id"], int(r["capacity_tokens"])) for r in budgets.where("budget_id is not null and capacity_tokens > 0").collect()]
    each = [
        F.struct(
            F.lit(i).alias("budget_id"), F.lit(c).cast("long").alias("capacity"),
            F.lit(max(1, round(total / (c * per_shard)))).cast("long").alias("shards")
        ) for i,
        c in known
    ]
    # every document is packed once under every budget
    items = s.withColumn(
        "b", F.explode(F.array(*each) if each else F.expr("cast(array() as array<struct<budget_id:string,capacity:long,shards:long>>)"))
    ).select("key", "n", "b.*")
    full = F.floor(F.col("n") / F.col("capacity"))
    # full containers of split documents come straight from the scan
    split = items.where(F.col("n") > F.col("capacity")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    split = split.select(
        "budget_id",
        F.concat(F.lit("d"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit("-"), F.col("piece").cast("string")).alias("container"),
        F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"),
        F.col("capacity").alias("n_tokens")
    )
    cut = F.when(F.col("n") > F.col("capacity"), full).otherwise(0)
    rest = items.withColumn("piece", cut).withColumn("start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.col("n") - F.col("start"))
    rest = rest.where((F.col("n_tokens") > 0) | (F.col("piece") == 0))
    shard = F.pmod(F.xxhash64(F.lit("pack"), "key", "n"), F.col("shards"))
    rest = rest.select("budget_id", "capacity", shard.alias("shard"), "key", F.col("piece").cast("int").alias("piece"), "start", "n_tokens")

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True], kind="stable")
        at = pack(g["n_tokens"].to_numpy(), int(g["capacity"].iloc[0]))
        name = f"s{int(g['shard'].iloc[0])}-"
        return pd.DataFrame(
            {
                "budget_id": g["budget_id"], "container": [name + str(i) for i in at], key: g["key"], "piece": g["piece"], "start": g["start"],
                "n_tokens": g["n_tokens"]
            }
        )

    schema = f"budget_id string, container string, `{key}` {kind}, piece int, start long, n_tokens long"
    out = rest.groupBy("budget_id", "shard").applyInPandas(packed, schema)
    return out.unionByName(split)


def oversize(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(budget_id, key): the documents that had to be split."""
    return placed.where("piece > 0").select("budget_id", key).distinct()


def utilisation(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, tokens, capacity_tokens, fill): how full the containers are."""
    used = placed.groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("n"))
    out = used.groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    out = out.join(F.broadcast(budgets.select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))), "budget_id")
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
