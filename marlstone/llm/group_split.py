"""Splits in given proportions that keep related records together (problem 5).

Records are related by group, root or delivery under one key. A record belongs to one unit: its group, else its
root, else itself. Units that share a root or a key are linked; only these links, not the records, go through the
component search. A component's size is its number of keys.

Of each size, every split first gets its share of the components, rounded down, so that splits are alike. What is
then missing to a split's total is met as closely as the components left over allow: a bitset of reachable sums over
their size multiplicities, smaller splits first; the largest split keeps the rest. Pairs of splits then exchange
components, by the same bitsets, until none gets nearer. At most about sqrt(2 x keys)
different sizes can exist, and only their counts come to the driver. Which components of a size go to which split is
decided by hash rank.

Defined cases: a null key is no record; null and blank groups, roots and splits say nothing; a record with neither
group nor root is its own component; a component larger than a split's total goes where the totals stay closest; a target of zero gets nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import rank
from marlstone.functions.text import spelled, spelled_group, stripped
from marlstone.operators.components import components, join_unique, links
from marlstone.operators.ranking import bucket_counts
from marlstone.plans.lineage import cut

LIMIT = 1 << 21
#: Sizes of at least so many components are dealt in bulk in the second draft.
ONE_BY_ONE = 64
#: Passes over all pairs of splits, at most.
ROUNDS = 8
#: Rows of (plan, size, split) that are broadcast; more are joined by shuffle.
FEW = 1_000_000


def closest_sum(counts: dict[int, int], target: int, limit: int = LIMIT, upto: int | None = None) -> dict[int, int]:
    """How many components of each size to take so that their total is closest to the target (ties: the lower).

    Bit i of the set says that total i can be reached; multiplicities are taken in doubling bundles, small sizes
    first, until the target itself is reached. A target above ``limit`` first takes large sizes greedily down to it;
    a greater limit is the exact way. upto: any total from the target up to this one is as good.
    """
    slack = max(0, (target if upto is None else upto) - target)
    taken: dict[int, int] = {}
    free = {s: c for s, c in counts.items() if 0 < s and c > 0}
    if target > limit:
        for s in sorted(free, reverse=True):
            k = min(free[s], (target - limit // 2) // s)
            if k > 0:
                taken[s] = k
                free[s] -= k
                target -= k * s
            if target <= limit:
                break
        target = min(target, limit)
    if target <= 0:
        return taken
    top = 2 * target + slack
    mask, good = (1 << (top + 1)) - 1, ((1 << (slack + 1)) - 1) << target
    steps: list[tuple[int, int, int]] = []  # size, copies, the set before
    reach = 1
    for s in sorted(free):
        if s > top or reach & good:
            break
        left, bundle = free[s], 1
        while left and not reach & good:
            k = min(bundle, left)
            steps.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            left, bundle = left - k, bundle * 2
    if reach & good:
        at = target + ((reach & good) >> target & -((reach & good) >> target)).bit_length() - 1
    else:
        below = (reach & ((1 << target) - 1)).bit_length() - 1
        above = reach >> (target + slack)
        over = (above & -above).bit_length() - 1 if above else target + 1
        at = below if target - below <= over else target + slack + over
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            taken[s] = taken.get(s, 0) + k
            at -= s * k
    return taken


def deviation(split: dict[int, int], want: int) -> int:
    """How far a split's total is from what is wanted."""
    return abs(sum(s * k for s, k in split.items()) - want)


def rebalanced(x: dict[int, int], y: dict[int, int], want_x: int, want_y: int) -> tuple[dict[int, int], dict[int, int]]:
    """The components of two splits, dealt to them so that both deviations together are least."""
    pool = {s: x.get(s, 0) + y.get(s, 0) for s in {*x, *y}}
    total = sum(s * c for s, c in pool.items())
    # between these totals of x the sum of the deviations is the same; outside it grows
    lo, hi = sorted((want_x, total - want_y))
    new_x = closest_sum(pool, max(0, lo), upto=max(0, hi))
    new_y = {s: c - new_x.get(s, 0) for s, c in pool.items()}
    better = deviation(new_x, want_x) + deviation(new_y, want_y) < deviation(x, want_x) + deviation(y, want_y)
    return (new_x, new_y) if better else (x, y)


def share_out(counts: dict[int, int], targets: dict[str, int]) -> dict[str, dict[int, int]]:
    """Numbers of components of each size for each split. targets: questions of each split, in any unit.

    Two first drafts are improved, and the better is taken: every split's share of each size, with what is missing
    filled in, smaller splits first; and the largest components first, each to the split that lacks most. Then pairs
    of splits exchange components, each time as well as any exchange could, until no pair gets nearer to its totals.
    So no exchange between two splits can improve the result.
    """
    total, whole = sum(s * c for s, c in counts.items()), sum(targets.values())
    order = sorted((t for t in targets if targets[t] > 0), key=lambda t: (targets[t], t))
    if not order:
        return {}
    want = {t: round(total * targets[t] / whole) for t in order}
    alike = {t: {s: c * targets[t] // whole for s, c in counts.items() if s <= want[t]} for t in order[:-1]}
    free = {s: c - sum(o.get(s, 0) for o in alike.values()) for s, c in counts.items()}
    for t in order[:-1]:
        for s, k in closest_sum(free, want[t] - sum(s * k for s, k in alike[t].items())).items():
            alike[t][s] = alike[t].get(s, 0) + k
            free[s] -= k
    alike[order[-1]] = free
    drafts = [alike]
    # one by one only where a size is too large or too rare to be shared alike
    large: dict[str, dict[int, int]] = {t: {} for t in order}
    lacking = dict(want)
    for s in sorted(counts, reverse=True):
        each = {t: counts[s] * targets[t] // whole if counts[s] >= ONE_BY_ONE else 0 for t in order}
        for t in [t for t in order for _ in range(1 if each[t] else 0)]:
            large[t][s] = each[t]
            lacking[t] -= s * each[t]
        for _ in range(counts[s] - sum(each.values())):
            t = max(order, key=lambda t: (lacking[t], t))
            large[t][s] = large[t].get(s, 0) + 1
            lacking[t] -= s
    drafts.append(large)
    for out in drafts:
        for _ in range(ROUNDS):
            before = sum(deviation(out[t], want[t]) for t in order)
            for i, t in enumerate(order):
                for u in order[i + 1 :]:
                    if deviation(out[t], want[t]) + deviation(out[u], want[u]):
                        out[t], out[u] = rebalanced(out[t], out[u], want[t], want[u])
            if sum(deviation(out[t], want[t]) for t in order) == before:
                break
    return min(drafts, key=lambda out: sum(deviation(out[t], want[t]) for t in order))


class Related:
    """The related records of a table: ``units`` with their component, ``keys`` with their component."""

    def __init__(self, rows: DataFrame, key: str = "sample_id"):
        group, root = spelled_group("group_id"), stripped("root_id")
        r = rows.select(
            F.col(key).alias("key"), group.alias("g"), F.when(root.isNotNull(), F.col("root_id")).alias("root"), spelled("split").alias("split")
        ).where(F.col("key").isNotNull())
        self.rows = cut(
            r.select(
                "key", "root", "split",
                F.coalesce(F.concat(F.lit("g:"), "g"), F.concat(F.lit("r:"), "root"), F.concat(F.lit("s:"), "key")).alias("unit")
            )
        )
        self.total = self.rows.count()
        edges = links(self.rows, "root", "unit", self.total).unionByName(links(self.rows, "key", "unit", self.total))
        self.labels = components(edges).withColumnRenamed("node", "unit")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their unit replaced by its component; a unit without links is its own."""
        return join_unique(rows, "unit", self.labels, "component", self.total).withColumn("component", F.coalesce("component", "unit"))

    def split_groups(self) -> DataFrame:
        """(group_key): the groups of every component that has two or more split values."""
        seen = self.rows.groupBy("unit").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        units = self.labelled(seen)
        torn = units.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").withColumn("torn", F.lit(True))
        found = join_unique(units.select("unit", "component"), "component", torn, "torn", self.total)
        return found.where("torn and unit like 'g:%'").select(F.substring("unit", 3, 1 << 30).alias("group_key"))

    def keys(self) -> DataFrame:
        """(key, component): all rows of a key lie in one component, so any unit of it will do."""
        return self.labelled(self.rows.groupBy("key").agg(F.min("unit").alias("unit"))).select("key", "component")

    def assign(self, plans: dict[str, dict[str, int]]) -> tuple[DataFrame, DataFrame]:
        """(plan_id, key, split) and the report (plan_id, split, questions, target_share, actual_share).

        plans: a few plan ids with the questions wanted of each split.
        """
        spark = self.rows.sparkSession
        keys = cut(self.keys())
        sized = keys.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
        spans, report = [], []
        total = sum(s * c for s, c in counts.items())
        for plan, targets in sorted(plans.items()):
            upto: dict[int, int] = {}
            for split, ks in sorted(share_out(counts, targets).items()):
                for s, k in ks.items():
                    if k:
                        spans.append((plan, s, upto.get(s, 0), upto.get(s, 0) + k, split))
                        upto[s] = upto.get(s, 0) + k
                n = sum(s * k for s, k in ks.items())
                report.append((plan, split, n, targets[split] / sum(targets.values()), n / max(1, total)))
        spans_df = spark.createDataFrame(spans, "plan_id string, size long, after long, upto long, split string")
        names = spark.createDataFrame([(p,) for p in sorted(plans)], "plan_id string")
        # components, not keys, are ranked: exactly, by hash bucket within each plan and size
        ranked = sized.join(F.broadcast(names)).withColumn(
            "rank", rank(F.col("plan_id"), "component")
        ).withColumn("bucket", F.substring("rank", 1, 3))
        by = ["plan_id", "size"]
        before = bucket_counts(ranked, by).drop("n")
        place = F.row_number().over(W.partitionBy(*by, "bucket").orderBy("rank", "component"))
        placed = ranked.withColumn("place", place).join(before, [*by, "bucket"]).withColumn("place", F.col("place") + F.col("before"))
        chosen = placed.join(
            F.broadcast(spans_df) if len(spans) <= FEW else spans_df, by
        ).where("place > after and place <= upto").select("plan_id", "component", "split")
        wide = chosen.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("plan_id", "split"))).alias("splits"))
        out = join_unique(keys, "component", wide, "splits", max(1, total)).select("key", F.explode("splits").alias("plan_id", "split"))
        return out.select("plan_id", "key", "split"), spark.createDataFrame(
            report, "plan_id string, split string, questions long, target_share double, actual_share double"
        )


def targets_of(plans: DataFrame) -> dict[str, dict[str, int]]:
    """Questions by plan and schema_split, from the plans' roles; a handful of rows of configuration."""
    roles = plans.where(F.col("plan_id").isNotNull()).select("plan_id", F.explode(F.map_values("roles")).alias("r"))
    sums = roles.groupBy("plan_id", F.col("r.schema_split").alias("split")).agg(F.sum(F.coalesce("r.questions", F.lit(0))).cast("long").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for r in sums.where(F.col("split").isNotNull()).collect():
        out.setdefault(r["plan_id"], {})[r["split"]] = r["n"]
    return out
