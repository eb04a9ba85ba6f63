"""Connected components by hooking and shortcutting over parent tables, and the joins that hot nodes need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.lineage import cut

#: A value on which more than this share of all rows meet is joined apart; there are fewer than 1 / HOT such values.
HOT = 1 / 512


def join_unique(rows: DataFrame, on: str, table: DataFrame, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` that has the same ``on``, or null; ``on`` is unique in ``table``.

    Values of ``on`` that more than HOT of ``total`` (a bound on the number of rows) share are fewer than 1 / HOT:
    their part of the table is broadcast and their rows are spread over all tasks. The others are joined by shuffle.
    """
    table = table.select(on, value)
    hot = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(1000, int(total * HOT))).select(on)
    part = F.broadcast(hot).join(table, on)
    part = hot.join(F.broadcast(part), on, "left").withColumn("_is_hot", F.lit(True)).withColumnRenamed(value, "_hot")
    rows = rows.join(F.broadcast(part), on, "left")
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[c for c in rows.columns if not c.startswith("_")]).cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("_is_hot"), spread).otherwise(F.col(on)))
    out = rows.join(table.select(F.col(on).alias("_key"), F.col(value).alias("_cold")), "_key", "left")
    return out.withColumn(value, F.coalesce("_hot", "_cold")).drop("_key", "_hot", "_cold", "_is_hot")


def lookup(rows: DataFrame, at: str, parents: DataFrame, total: int) -> DataFrame:
    """Replace column ``at`` by its parent where it has one. parents: (node, parent), node unique."""
    named = parents.select(F.col("node").alias(at), F.col("parent").alias("_parent_of"))
    return join_unique(rows, at, named, "_parent_of", total).withColumn(at, F.coalesce("_parent_of", at)).drop("_parent_of")


def links(rows: DataFrame, entity: str, unit: str, total: int) -> DataFrame:
    """(a, b): edges that join all units that share an entity; the least unit of each entity is the hub of its star.

    Entities with one unit give no edge, so what goes on from here is only as large as the relations are.
    """
    pairs = rows.where(F.col(entity).isNotNull() & F.col(unit).isNotNull()).select(F.col(entity).alias("e"), F.col(unit).alias("b")).distinct()
    hubs = pairs.groupBy("e").agg(F.min("b").alias("a"), F.max("b").alias("_z")).where("a != _z").select("e", "a")
    return join_unique(pairs, "e", hubs, "a", total).where("a is not null and a != b").select("a", "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the least node name that it is connected to.

    In each round every node is hooked under its least neighbour, the trees are shortcut to stars by joining the parent
    table with itself, a logarithmic number of times, and the edges are contracted to the roots: edges within a tree and
    repeats vanish, and at most half the nodes are left. The parent tables are checkpointed and joined from the last to the first at the end. Everything is aggregated before its
    shuffle, so a node with any number of edges does not fill one task.

    Defined cases: edges with a null end and loops are ignored; repeated edges count once; an empty table gives no rows.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return cut(e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), forget=True)

    left = canonical(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    kept: list[tuple[DataFrame, int]] = []
    while n := left.count():
        if len(kept) == rounds:
            raise RuntimeError(f"no end after {rounds} rounds")
        both = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            left.select(F.col("a").alias("node"), F.col("b").alias("to"))
        )
        hooked = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")), forget=True)
        size = hooked.count()
        # each pass halves the depth of the trees, until every parent is a root
        moved = True
        while moved:
            up = lookup(hooked.select("node", "parent", F.col("parent").alias("_was")), "parent", hooked, size)
            hooked = cut(up.select("node", "parent", (F.col("parent") != F.col("_was")).alias("moved")), forget=True)
            moved = hooked.where("moved").limit(1).count() > 0
            hooked = hooked.select("node", "parent")
        kept.append((hooked, size))
        left = canonical(lookup(lookup(left, "a", hooked, n), "b", hooked, n))
    if not kept:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    later = kept[-1][0]
    for parents, size in reversed(kept[:-1]):
        later = cut(lookup(parents, "parent", later, size).select("node", "parent"), forget=True)
    return later.select("node", F.col("parent").alias("component"))
