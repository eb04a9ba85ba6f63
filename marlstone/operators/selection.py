"""Selecting exact-quota, hash-ranked manifests and assigning roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import prefix_mod, rank
from marlstone.operators.ranking import first_by_rank


def exclusion() -> Column:
    """Why a question can't be trained on; the first reason that holds, else null."""
    return F.when(F.col("split") != "train", "non_train").when(F.col("teacher_only"), "teacher_only").when(F.col("blocked"), "release_blocked")


def quota_manifest(questions: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """The quota of least rank of each source. quotas: mixture_id, source, take. Adds the output rank."""
    ranked = questions.where(exclusion().isNull()).join(F.broadcast(quotas.select("mixture_id", "source")), "source")
    ranked = ranked.withColumn("rank", rank(F.concat(F.lit(seed + ":"), "source"), "sample_id"))
    got = first_by_rank(ranked.select("mixture_id", "source", "sample_id", "rank"), ["mixture_id", "source"], quotas, tie="sample_id")
    return got.select("mixture_id", "source", "sample_id", rank(seed, "sample_id").alias("output_rank"))


def source_quotas(mixtures: DataFrame) -> DataFrame:
    """(mixture_id, source, take) of a mixture table."""
    return mixtures.select("mixture_id", F.explode("public_source_quotas").alias("source", "take"))


def shortage(questions: DataFrame, quotas: DataFrame) -> DataFrame:
    """(mixture_id, source, quota, available, short): quotas without any supply count as short too."""
    have = questions.where(exclusion().isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    out = quotas.join(have, "source", "left").na.fill(0, ["available"])
    return out.select(
        "mixture_id", "source", F.col("take").alias("quota"), "available", F.greatest(F.col("take") - F.col("available"), F.lit(0)).alias("short")
    )


def evaluation_groups(questions: DataFrame, seed: str, percent: int) -> DataFrame:
    """(group_id, role): every group in train or eval by hash; neither role stays empty if there are two groups."""
    groups = questions.where("group_id != ''").select("group_id").distinct().withColumn("h", rank(seed + ":eval", "group_id"))
    ends = groups.agg(
        F.min("h").alias("lo"), F.max(rank(seed + ":train", "group_id")).alias("hi"), F.count_if(prefix_mod(F.col("h"), 100) < percent).alias("n"),
        F.count(F.lit(1)).alias("all")
    )
    marked = groups.join(F.broadcast(ends)).withColumn("eval", prefix_mod(F.col("h"), 100) < percent)
    marked = marked.withColumn(
        "eval",
        F.when(F.col("n") == 0, F.col("h") == F.col("lo")).when(
            F.col("n") == F.col("all"), rank(seed + ":train", "group_id") != F.col("hi")
        ).otherwise(F.col("eval"))
    )
    return marked.select("group_id", F.when(F.col("eval"), "eval").otherwise("train").alias("role"))


def largest_remainder(counts: DataFrame, by: list[str], n: str, total: int) -> DataFrame:
    """Whole quotas that add up to ``total``, in proportion to ``n``; ties of remainders go to the greater key.

    counts: one row a stratum, of configuration size; the windows run over strata, not over rows.
    """
    all_ = W.partitionBy(F.lit(0))
    exact = F.col(n) * F.lit(total) / F.sum(n).over(all_)
    c = counts.withColumn("exact", exact).withColumn("quota", F.floor("exact"))
    c = c.withColumn("place", F.row_number().over(all_.orderBy(F.desc(F.round(F.col("exact") - F.col("quota"), 9)), *[F.desc(x) for x in by])))
    c = c.withColumn("left", F.lit(total) - F.sum("quota").over(all_))
    return c.select(*by, n, (F.col("quota") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def round_robin(rows: DataFrame, count: int, seed: str, cap: int) -> DataFrame:
    """The k-th question of every source before the (k+1)-th of any, sources in hashed order, at most ``cap`` each.

    The first ``cap`` of a source are cut by hash rank without sorting a source in one task; what is left to order is
    at most cap x sources rows.
    """
    ranked = rows.withColumn("rank", rank(seed, "sample_id"))
    names = ranked.select("source").distinct().withColumn("take", F.lit(cap))
    head = first_by_rank(ranked.select("source", "sample_id", "rank"), ["source"], names, tie="sample_id")
    turn = F.row_number().over(W.partitionBy("source").orderBy("rank", "sample_id"))
    head = head.withColumn("turn", turn).withColumn("place", rank(seed + ":sources", "source"))
    return head.orderBy("turn", "place").limit(count).select("source", "sample_id", "turn")


def unused(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that share no sample, root or group with used rows: three anti-joins, never one with OR."""
    out = candidates
    for key in ("sample_id", "root_id", "group_id"):
        out = out.join(used.where(F.col(key) != "").select(key).distinct(), key, "left_anti")
    return out


def leakage(questions: DataFrame) -> DataFrame:
    """(split_pair, groups): groups whose questions lie in more than one split."""
    g = questions.where("group_id != '' and split != ''").groupBy("group_id").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return g.where(F.size("s") > 1).groupBy(F.array_join("s", "+").alias("splits")).agg(F.count(F.lit(1)).alias("groups"))


def permutations(options: Column, key: Column, seed: str, most: int = 3, attempts: int = 32) -> Column:
    """Up to ``most`` different orders of option ids, none the given one, from hash-ranked attempts."""
    def order(attempt: Column) -> Column:
        ranked = F.transform(
            options,
            lambda o: F.struct(
                F.sha2(F.concat(F.lit(seed + ":"), key, F.lit(":"), attempt.cast("string"), F.lit("\u0000"), o), 256).alias("h"), o.alias("o")
            )
        )
        return F.transform(F.array_sort(ranked), lambda x: x["o"])

    # the given order stands first; no more orders are tried once there are enough, or as many as there can be
    enough = F.when(F.size(options) < 2, 1).when(F.size(options) == 2, 2).otherwise(most + 1)
    given = F.array(options)
    tried = F.aggregate(
        F.sequence(F.lit(0), F.lit(attempts - 1)), given,
        lambda got, t: F.when(F.size(got) >= enough, got).otherwise(F.array_union(got, F.array(order(t))))
    )
    return F.slice(tried, 2, most)
