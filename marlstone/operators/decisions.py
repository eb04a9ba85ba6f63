"""Decisions with tied best actions, made into choices and yes-or-no questions by quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import rank
from marlstone.operators.grids import flow
from marlstone.operators.ranking import first_by_rank

#: Hex digits of the hash buckets in which places are counted; 16**DIGITS rows a stage and role are broadcast.
DIGITS = 2


def unite(stages: dict[str, DataFrame], expected: set[str]) -> DataFrame:
    """All stages in one table, with a column ``stage``. Stages other than expected are an error; missing columns are null."""
    if set(stages) != expected:
        raise ValueError(f"stages {sorted(stages)} instead of {sorted(expected)}")
    out = None
    for name in sorted(stages):
        part = stages[name].withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def optimal_actions(quality: Column) -> Column:
    """The best actions that a label's JSON lists; a label without any is an error."""
    q = F.from_json(quality, "all_optimal_actions array<string>, all_best_measured_actions array<string>")
    found = F.coalesce(q["all_optimal_actions"], q["all_best_measured_actions"])
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("no optimal actions")).cast("array<string>"))


def action_ids(quality: Column) -> Column:
    """All actions that a label's JSON gives a value for, in its order; a label without any is an error."""
    q = F.from_json(quality, "oracle_q map<string,string>, policy_success_rates map<string,string>")
    found = F.map_keys(F.coalesce(q["oracle_q"], q["policy_success_rates"]))
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("no actions")).cast("array<string>"))


def by_steps(distance: Column, most: int) -> Column:
    """The worth of a state by its distance to the goal: 1 at the goal, a tenth at ``most`` steps, never below 0."""
    return F.greatest(F.lit(0.0), 1 - 0.9 * distance / most)


def by_hundreds(distance: Column) -> Column:
    """The worth of a state that halves at a hundred steps."""
    return 1 / (1 + distance / 100)


def allocated(rows: DataFrame, key: str, labels: dict[str, int], seed: str) -> DataFrame:
    """As many rows as the labels add up to, by hash of their key, each with the label of its place.

    The labels' places are hashed as well. Both lists are as long as the plan says; fewer rows leave labels unused.
    """
    spark, total = rows.sparkSession, sum(labels.values())
    flat = [name for name, n in labels.items() for _ in range(n)]
    names = spark.createDataFrame(list(enumerate(flat)), "i int, label string").withColumn(
        "h", rank(seed + ":labels", F.concat_ws(":", F.col("i").cast("string"), "label"))
    )
    names = names.select("label", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("h")).alias("place"))
    ranked = rows.withColumn("_all", F.lit(0)).withColumn("rank", rank(seed, key))
    quota = spark.createDataFrame([(0, total)], "_all int, take int")
    head = first_by_rank(ranked, ["_all"], quota, tie=key).withColumn("place", F.row_number().over(W.partitionBy("_all").orderBy("rank", key)))
    return head.join(F.broadcast(names), "place").drop("_all", "rank")


def first_accepted(
    jobs: DataFrame, quotas: DataFrame, by: str = "environment", order: str = "job", picture: str = "picture", failed: str = "failed"
) -> DataFrame:
    """The first accepted jobs of each environment, as many as its quota, with ``place``.

    A job with a reason in ``failed`` isn't accepted, nor is one whose picture an earlier job has: a picture belongs to
    its first job. quotas: by, quota.
    """
    ok = jobs.where(F.col(failed).isNull()).withColumn("digest", F.sha2(picture, 256))
    first = ok.groupBy("digest").agg(F.min(F.struct(order, by)).alias("f")).select("digest", f"f.{order}", f"f.{by}")
    kept = ok.join(first, ["digest", order, by], "left_semi")
    out = kept.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(order))).join(F.broadcast(quotas), by)
    return out.where("place <= quota").drop("digest", "quota")


def rejections(jobs: DataFrame, order: str = "job", picture: str = "picture", failed: str = "failed") -> DataFrame:
    """(reason, n): why jobs were not accepted, repeated pictures included."""
    bad = jobs.where(F.col(failed).isNotNull()).groupBy(F.col(failed).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    again = jobs.where(F.col(failed).isNull()).groupBy(F.sha2(picture, 256).alias("d")).agg(
        (F.count(F.lit(1)) - 1).alias("n")
    ).agg(F.sum("n").alias("n")).where("n > 0")
    return bad.unionByName(again.select(F.lit("picture seen before").alias("reason"), "n"))


def choice_quotas(available: dict[tuple[str, str], int], choices: dict[str, int], wanted: dict[str, int]) -> dict[tuple[str, str], int]:
    """How many choices each stage gives each role. available: rows by (stage, role); choices by stage; wanted by role.

    A greatest flow, over a few dozen numbers of configuration; a shortfall is an error.
    """
    sent = flow(choices, wanted, available)
    if sum(sent.values()) < sum(wanted.values()):
        raise ValueError(f"{sum(wanted.values()) - sum(sent.values())} choices are missing")
    return sent


def wrong_actions() -> Column:
    """The actions that aren't among the best ones; a row without any can only be a choice."""
    return F.filter("actions", lambda a: ~F.array_contains("optimal", a))


def decision_tasks(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Each row as a choice or a yes-or-no question: adds task_type, candidate, targets (ids), answer (boolean).

    rows: sample_id, stage, role, actions and optimal (arrays of ids). quotas: stage, role, choice. Rows without a
    wrong action can only be choices and come first; the rest of a quota is filled in hashed order. Questions ask about
    a right action at even places of the hashed order, about a wrong one at odd places. A stage and role has as many
    rows as its plan says; more rows that can only be choices than the quota are an error.
    """
    by = ["stage", "role"]
    r = rows.withColumn("_wrong", wrong_actions()).withColumn("_forced", F.size("_wrong") == 0).withColumn("_rank", rank(F.col("stage"), "sample_id"))
    r = r.withColumn("_bucket", F.substring("_rank", 1, DIGITS))
    # a stage and role may hold most of all rows: places are counted by hash bucket, and only a bucket is ordered in one task
    free = F.when(F.col("_forced"), 0).otherwise(1)
    counts = r.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(free).alias("_free"))
    earlier = W.partitionBy(*by).orderBy("_bucket")
    counts = counts.select(
        *by, "_bucket", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), (F.sum("_free").over(earlier) - F.col("_free")).alias("_free_before"),
        F.sum(F.col("_n") - F.col("_free")).over(W.partitionBy(*by)).alias("_all_forced")
    )
    counts = counts.join(F.broadcast(quotas), by, "left").na.fill(0, ["choice"])
    for c in (*by, "_bucket"):
        counts = counts.withColumnRenamed(c, "_c" + c)
    same = [F.col(c).eqNullSafe(F.col("_c" + c)) for c in (*by, "_bucket")]
    r = r.join(F.broadcast(counts), same).drop(*["_c" + c for c in (*by, "_bucket")])
    hashed = W.partitionBy(*by, "_bucket").orderBy("_rank", "sample_id")
    r = r.withColumn("_place", F.col("_before") + F.row_number().over(hashed) - 1).withColumn("_place", F.col("_place").cast("int"))
    free = F.col("_free_before") + F.sum(free).over(hashed.rowsBetween(W.unboundedPreceding, W.currentRow))
    too_many = F.raise_error(F.concat_ws(" ", F.lit("more choices than the quota of"), "stage", "role")).cast("boolean")
    is_choice = F.when(F.col("_all_forced") > F.col("choice"), too_many).otherwise(
        F.col("_forced") | (free <= F.col("choice") - F.col("_all_forced"))
    )
    r = r.withColumn("_choice", is_choice)
    pick = F.when(
        F.col("_place") % 2 == 0, F.get("optimal", F.col("_place") % F.size("optimal"))
    ).otherwise(F.get("_wrong", F.col("_place") % F.greatest(F.size("_wrong"), F.lit(1))))
    r = r.withColumn("task_type", F.when(F.col("_choice"), "choice").otherwise("noul")).withColumn("candidate", F.when(~F.col("_choice"), pick))
    r = r.withColumn("targets", F.when(F.col("_choice"), F.col("optimal"))).withColumn("answer", F.array_contains("optimal", F.col("candidate")))
    return r.drop("_wrong", "_forced", "_rank", "_bucket", "_before", "_free_before", "_place", "_all_forced", "_choice", "choice")


def repeated_states(rows: DataFrame, *state: str) -> DataFrame:
    """States that more than one row has, with their number: violations, for ``files.publish``."""
    return rows.groupBy(*state).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
