"""Calibration metrics of predictions, thresholds and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BINS = 15


def softmax(logits: Column | str, temperature: Column | float = 1.0) -> Column:
    """Probabilities of logits, stable for large values; all of ``-inf`` is an error of the caller."""
    x = F.col(logits) if isinstance(logits, str) else logits
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top) / t))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def nll(logits: Column | str, target: Column, temperature: Column | float = 1.0) -> Column:
    """-ln of the target's probability, clipped at 1e-12, straight from logits."""
    x = F.col(logits) if isinstance(logits, str) else logits
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp((v - top) / t))
    return F.least(F.ln(total) - (F.element_at(x, target + 1) - top) / t, F.lit(27.631021115928547))


def scored(predictions: DataFrame) -> DataFrame:
    """Each prediction with probabilities, predicted index, hit, top probability and its losses."""
    p = predictions.withColumn("p", softmax("logits"))
    p = p.withColumn("top", F.array_max("p")).withColumn("pick", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
    miss = F.aggregate(F.transform("p", lambda v, i: F.pow(v - F.when(i == F.col("target"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, v: a + v)
    steps = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda k: F.pow(F.aggregate(F.slice("p", 1, k), F.lit(0.0), lambda a, v: a + v) - F.when(F.col("target") < k, 1.0).otherwise(0.0), 2)
    )
    rps = F.when(F.size("p") > 1, F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / (F.size("p") - 1))
    return p.select(
        "prediction_id", "model_id", "sample_id", "source", "task_type", "target", "pick", "top", "latency_ms",
        (F.col("pick") == F.col("target")).alias("hit"),
        F.least(-F.ln(F.greatest(F.element_at("p", F.col("target") + 1), F.lit(1e-12))), F.lit(27.631021115928547)).alias("nll"), miss.alias("brier"),
        rps.alias("rps")
    )


def summary(scores: DataFrame) -> DataFrame:
    """Accuracy and mean losses for all, each task, each source and each source of a task, in one pass."""
    sets = scores.groupingSets([[], ["task_type"], ["source"], ["task_type", "source"]], "task_type", "source")
    out = sets.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"), F.round(F.avg("nll"), 6).alias("nll"),
        F.round(F.avg("brier"), 6).alias("brier"), F.grouping_id().alias("level")
    )
    return out.select("level", "task_type", "source", "n", "accuracy", "nll", "brier")


def calibration_error(scores: DataFrame) -> DataFrame:
    """(task_type, n, ece): the weighted gap between confidence and accuracy over equal bins."""
    bins = scores.groupBy("task_type", F.least(F.lit(BINS - 1), F.floor(F.col("top") * BINS)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("top").alias("c"), F.sum(F.col("hit").cast("double")).alias("h")
    )
    return bins.groupBy("task_type").agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n"), 6).alias("ece"))


def nll_any(logits: Column | str, targets: Column, temperature: Column | float = 1.0) -> Column:
    """-ln of the sum of the probabilities of all right targets, clipped at 1e-12. targets: an array of indexes."""
    p = softmax(logits, temperature)
    right = F.aggregate(F.array_distinct(targets), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(p, i), F.lit(0.0)))
    return -F.ln(F.greatest(right, F.lit(1e-12)))


def sigmoid(logit: Column | str) -> Column:
    """The probability of a binary logit, stable for large values."""
    x = F.col(logit) if isinstance(logit, str) else logit
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def masked_softmax(logits: Column, valid: Column) -> Column:
    """Probabilities over the valid places, zero elsewhere. A row without a valid place is an error."""
    kept = F.zip_with(logits, valid, lambda v, ok: F.when(ok, v))
    top = F.array_max(kept)
    e = F.transform(kept, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0)))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.exists(valid, lambda ok: ok), F.transform(e, lambda v: v / total)).otherwise(F.raise_error(F.lit("every place is masked")))


def target_indexes(options: Column, ids: Column) -> Column:
    """The place of each target id among the options, from 0. An id that is no option is an error."""
    names = F.transform(options, lambda o: o["id"])
    place = lambda i: F.array_position(names, i).cast("int") - 1
    return F.transform(
        ids, lambda i: F.when(F.array_contains(names, i), place(i)).otherwise(F.raise_error(F.concat(F.lit("no such option: "), i)).cast("int"))
    )


def temperature_fit(predictions: DataFrame, points: int = 121, low: float = 0.25, high: float = 4.0, tasks: tuple[str, ...] = ()) -> DataFrame:
    """(task_type, temperature, nll): the best of a logarithmic grid for each task; the grid is exploded row by row.

    predictions: task_type, logits, and target (an index) or targets (an array of all right ones, whose probabilities
    add up). Tasks listed without any prediction keep the temperature 1.
    """
    grid = F.array(*[F.lit(round(low * (high / low) ** (i / (points - 1)), 9)) for i in range(points)])
    loss = (lambda t: nll_any("logits", F.col("targets"), t)) if "targets" in predictions.columns else (lambda t: nll("logits", F.col("target"), t))
    losses = predictions.select("*", F.explode(grid).alias("t")).groupBy("task_type", "t").agg(F.round(F.avg(loss(F.col("t"))), 9).alias("loss"))
    best = losses.groupBy("task_type").agg(F.min(F.struct("loss", "t")).alias("m")).select(
        "task_type", F.col("m.t").alias("temperature"), F.round("m.loss", 6).alias("nll")
    )
    if not tasks:
        return best
    named = predictions.sparkSession.createDataFrame([(t,) for t in tasks], "task_type string")
    return named.join(best, "task_type", "full").na.fill(1.0, ["temperature"])


def repeats(runs: DataFrame, key: str, value: str, latency: str) -> DataFrame:
    """(key, value, runs, latency): the value that all runs of a key agree on and their median latency.

    Keys whose runs differ in their value have a null value: their result is not stable. Runs of a key are few.
    """
    out = runs.groupBy(key).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("runs"), F.count(value).alias("known"),
        F.percentile(latency, F.lit(0.5)).alias("latency")
    )
    return out.select(key, F.when((F.col("lo") == F.col("hi")) & (F.col("known") == F.col("runs")), F.col("lo")).alias("value"), "runs", "latency")


def outcomes(rollouts: DataFrame, by: list[str], action: str = "action", result: str = "result", success: str = "success") -> DataFrame:
    """(by, action, n, mean, success_rate, quality, optimal): what rollouts of each action in a state came to.

    quality: softmax of five times the mean results of a state's actions. optimal: whether the mean equals the best
    within a relative 1e-9. A state has as many rows here as it has actions.
    """
    a = rollouts.groupBy(*by, action).agg(
        F.count(F.lit(1)).alias("n"), F.avg(result).alias("mean"), F.avg(F.col(success).cast("double")).alias("success_rate")
    )
    w = W.partitionBy(*by)
    best = F.max("mean").over(w)
    e = F.exp(5 * (F.col("mean") - best))
    tied = F.abs(F.col("mean") - best) <= 1e-9 * F.greatest(F.abs("mean"), F.abs(best))
    return a.select(*by, action, "n", "mean", "success_rate", (e / F.sum(e).over(w)).alias("quality"), tied.alias("optimal"))


def thresholds(scores: DataFrame, target: float = 0.95, minimum: int = 25, by: tuple[str, ...] = ("task_type",)) -> DataFrame:
    """(by, threshold, accepted, questions, coverage, accuracy): the longest run of highest confidence with the target accuracy.

    Running sums go over distinct confidences, pre-aggregated, and in two levels: over 4096 bins of confidence, then
    inside each bin, so a task with any number of rows is not sorted in one task of the job. Rows of equal confidence
    are accepted together, as any threshold does. Groups without such a run accept nothing at 1.000001.
    """
    c = scores.groupBy(*by, "top").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("h"))
    c = c.withColumn("bin", F.floor(F.col("top") * 4096))
    above = W.partitionBy(*by).orderBy(F.desc("bin"))
    bins = c.groupBy(*by, "bin").agg(F.sum("n").alias("bn"), F.sum("h").alias("bh"))
    bins = bins.select(*by, "bin", (F.sum("bn").over(above) - F.col("bn")).alias("n0"), (F.sum("bh").over(above) - F.col("bh")).alias("h0"))
    w = W.partitionBy(*by, "bin").orderBy(F.desc("top"))
    run = c.withColumn("rn", F.sum("n").over(w)).withColumn("rh", F.sum("h").over(w)).join(bins, [*by, "bin"])
    run = run.withColumn("n", F.col("rn") + F.col("n0")).withColumn("acc", (F.col("rh") + F.col("h0")) / F.col("n"))
    best = run.groupBy(*by).agg(
        F.max(F.when((F.col("n") >= minimum) & (F.col("acc") >= target), F.struct("n", "top", "acc"))).alias("m"), F.max("n").alias("questions")
    )
    accepted = F.coalesce("m.n", F.lit(0))
    return best.select(
        *by, F.round(F.coalesce("m.top", F.lit(1.000001)), 6).alias("threshold"), accepted.alias("accepted"), "questions",
        F.round(accepted / F.col("questions"), 6).alias("coverage"), F.round("m.acc", 6).alias("accuracy")
    )


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, sum, mean, exact interpolated percentiles, least and greatest of a duration.

    Equal values are counted first; running counts then go over logarithmic bins and inside each bin, so no group is
    held or sorted in one task.
    """
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0))
    c = ok.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("bin", F.floor(F.log1p("v") * 256))
    upto = W.partitionBy(by).orderBy("bin")
    bins = c.groupBy(by, "bin").agg(F.sum("c").alias("bc")).select(
        by, "bin", (F.sum("bc").over(upto) - F.col("bc")).alias("before"), F.sum("bc").over(W.partitionBy(by)).alias("n")
    )
    run = c.withColumn(
        "run", F.sum("c").over(W.partitionBy(by, "bin").orderBy("v"))
    ).join(bins, [by, "bin"]).withColumn("upto", F.col("run") + F.col("before"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    marks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    place = {p: F.lit(q) * (F.col("n") - 1) for p, q in marks.items()}
    found = run.groupBy(by).agg(
        F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("sum"), F.min("v").alias("least"), F.max("v").alias("most"),
        *[at(g(place[p])).alias(p + s) for p in marks for s, g in (("lo", F.floor), ("hi", F.ceil))]
    )
    between = lambda p: F.round(F.col(p + "lo") + (F.col(p + "hi") - F.col(p + "lo")) * (place[p] - F.floor(place[p])), 6).alias(p)
    return found.select(
        by, "n", F.round("sum", 4).alias("total"), F.round(F.col("sum") / F.col("n"), 6).alias("mean"), *[between(p) for p in marks], "least", "most"
    )


def choice_set_loss(probabilities: Column, valid: Column) -> Column:
    """-ln of the probability of all valid candidates together, clipped at 1e-12; a question without any is an error."""
    mass = F.aggregate(F.zip_with(probabilities, valid, lambda p, ok: F.when(ok, p).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    return F.when(
        F.exists(valid, lambda ok: ok), -F.ln(F.greatest(mass, F.lit(1e-12)))
    ).otherwise(F.raise_error(F.lit("no valid target")).cast("double"))


def generation_rates(rows: DataFrame, by: list[str], raw: str = "raw", answer: str = "answer") -> DataFrame:
    """(by, questions, syntax_valid, exact_match): shares of texts that are JSON objects, and that equal the answer as JSON.

    Objects are compared as maps, so spacing and the order of fields don't matter.
    """
    parsed = lambda c: F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    valid = F.coalesce(F.from_json(raw, "map<string,string>").isNotNull() & F.col(raw).rlike(r"^\s*\{[\s\S]*\}\s*$"), F.lit(False))
    same = valid & F.coalesce(parsed(raw) == parsed(answer), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.avg(valid.cast("double")).alias("syntax_valid"), F.avg(same.cast("double")).alias("exact_match")
    )


def brier_any(probabilities: Column, targets: Column) -> Column:
    """The squared error of probabilities against the targets (an array of indexes), which share one evenly."""
    right = F.array_distinct(targets)
    each = F.transform(probabilities, lambda v, i: F.pow(v - F.when(F.array_contains(right, i), 1.0 / F.size(right)).otherwise(0.0), 2))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def gate(summary: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """The summary with one boolean a metric, ``<metric>_ok``, and ``passed``: whether each is at least its minimum. A null metric fails."""
    out = summary
    for name, least in minimums.items():
        out = out.withColumn(f"{name}_ok", F.coalesce(F.col(name) >= F.lit(least), F.lit(False)))
    return out.withColumn("passed", F.forall(F.array(*[F.col(f"{n}_ok") for n in minimums]), lambda ok: ok))
