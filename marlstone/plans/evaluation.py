"""Queries over predictions and timings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import metrics as m
from marlstone.operators.grids import drawn_levels, solve_levels, tiles
from marlstone.operators.questions import predictions
from marlstone.plans.dataset import Q, TRIM
from marlstone.operators.questions import questions
from marlstone.sources.tables import table

_t = TRIM.format
P = rf"""p as (select distinct prediction_id, model_id, sample_id, nullif(translate(lower({_t('source')}), ' -', '__'), '') source, nullif(lower({_t('task_type')}), '') task_type, logits, target, confidence, correct, latency_ms from prediction),
ok as (select * from p where task_type is not null and logits is not null and target >= 0 and target < len(logits) and len(list_filter(logits, lambda x: x is null or isnan(x))) = 0),
e as (select *, list_transform(logits, lambda v: exp(v - list_max(logits))) x from ok),
s as (select *, list_transform(x, lambda v: v / list_sum(x)) pr, list_position(logits, list_max(logits)) - 1 pick from e),
sc as (select *, pick = target hit, list_max(pr) top, least(-ln(greatest(pr[target + 1], 1e-12)), 27.631021115928547) nll, list_sum(list_transform(pr, lambda v, i: pow(v - case when i = target + 1 then 1.0 else 0.0 end, 2))) brier from s)"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    return m.scored(predictions(table(s, d, "prediction")))


def metric_summary(s: SparkSession, d: str) -> DataFrame:
    return m.summary(_scores(s, d))


def calibration_error(s: SparkSession, d: str) -> DataFrame:
    return m.calibration_error(_scores(s, d))


def macro_accuracy(s: SparkSession, d: str) -> DataFrame:
    by = _scores(s, d).groupBy("model_id", "task_type").agg(F.avg(F.col("hit").cast("double")).alias("a"))
    return by.groupBy("model_id").agg(F.round(F.avg("a"), 6).alias("macro_accuracy"), F.count(F.lit(1)).alias("tasks"))


def ordinal_errors(s: SparkSession, d: str) -> DataFrame:
    o = _scores(s, d).where("task_type = 'score'")
    return o.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pick") - F.col("target"))), 6).alias("mae"),
        F.count_if(F.abs(F.col("pick") - F.col("target")) <= 1).alias("within_one"), F.round(F.avg("rps"), 6).alias("rps")
    )


def confusion(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).groupBy("task_type", F.concat("target", F.lit("->"), "pick").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def temperature_fit(s: SparkSession, d: str) -> DataFrame:
    return m.temperature_fit(predictions(table(s, d, "prediction")), tasks=("choice", "noul", "score"))


def threshold_select(s: SparkSession, d: str) -> DataFrame:
    return m.thresholds(_scores(s, d).withColumn("top", F.round("top", 9)))


def threshold_report(s: SparkSession, d: str) -> DataFrame:
    scores = _scores(s, d).withColumn("top", F.round("top", 9))
    t = m.thresholds(scores).select("task_type", "threshold")
    j = scores.join(F.broadcast(t), "task_type").withColumn("in", F.round("top", 6) >= F.col("threshold"))
    return j.groupBy("task_type", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in").alias("accepted"), F.count_if(F.col("in") & F.col("hit")).alias("right")
    )


def high_confidence_errors(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).groupBy("model_id").agg(F.count_if(~F.col("hit") & (F.col("top") >= 0.9)).alias("errors"), F.count(F.lit(1)).alias("n"))


def _agreed(s: SparkSession, d: str) -> DataFrame:
    """(sample_id, source, task_type): samples that every model answers rightly, as confidently as its task's threshold asks."""
    scores = _scores(s, d).where("sample_id is not null").withColumn("top", F.round("top", 9))
    # half of the answers at each threshold may be wrong, as models of this table are weak
    t = m.thresholds(scores, 0.5, 5, by=("model_id", "task_type")).select("model_id", "task_type", "threshold")
    j = scores.join(F.broadcast(t), ["model_id", "task_type"]).withColumn("ok", F.col("hit") & (F.round("top", 6) >= F.col("threshold")))
    one = j.groupBy("sample_id", "model_id").agg(F.bool_and("ok").alias("ok"), F.min("source").alias("source"), F.min("task_type").alias("task_type"))
    all_ = scores.agg(F.count_distinct("model_id").alias("all"))
    each = one.where("ok").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("models"), F.min("source").alias("source"), F.min("task_type").alias("task_type")
    )
    return each.join(F.broadcast(all_)).where("models = all").drop("all")


def all_models_agree(s: SparkSession, d: str) -> DataFrame:
    return _agreed(s, d).select("sample_id", "models")


def showcase_selection(s: SparkSession, d: str) -> DataFrame:
    """(source, task_type, sample_id, eligible): of the samples all models agree on, the one of least hash."""
    return _agreed(s, d).groupBy("source", "task_type").agg(
        F.min_by("sample_id", F.sha2("sample_id", 256)).alias("sample_id"), F.count(F.lit(1)).alias("eligible")
    )


def source_of_predictions(s: SparkSession, d: str) -> DataFrame:
    q = questions(table(s, d, "example")).where("split = 'test'").select("sample_id", F.col("source").alias("listed"))
    j = predictions(table(s, d, "prediction")).join(q, "sample_id", "left")
    return j.groupBy(F.col("listed").isNull().alias("unknown"), (F.col("listed") == F.col("source")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(s: SparkSession, d: str) -> DataFrame:
    return m.latencies(predictions(table(s, d, "prediction")), "task_type", "latency_ms")


def quality_gate(s: SparkSession, d: str) -> DataFrame:
    g = _scores(s, d).groupBy("model_id").agg(F.avg(F.col("hit").cast("double")).alias("a"), F.avg("nll").alias("l"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "model_id", (F.col("a") >= 0.5).alias("accurate"), (F.col("l") <= 1.0).alias("calibrated"),
        ((F.col("a") >= 0.5) & (F.col("l") <= 1.0) & (F.col("n") >= 100)).alias("passed")
    )


def _levels(s: SparkSession, d: str) -> DataFrame:
    return drawn_levels(table(s, d, "documents"))


def grid_tiles(s: SparkSession, d: str) -> DataFrame:
    """What the grids drawn in documents hold."""
    return tiles(_levels(s, d), ("doc_id", "place"))


def grid_levels(s: SparkSession, d: str) -> DataFrame:
    """The grids drawn in documents, solved; the graph search has no SQL."""
    return solve_levels(_levels(s, d), keys=("doc_id", "place"))


QUERIES = {
    f.__name__: f for f in (
        metric_summary, calibration_error, macro_accuracy, ordinal_errors, confusion, temperature_fit, threshold_select, threshold_report,
        high_confidence_errors, all_models_agree, showcase_selection, source_of_predictions, latency_summary, quality_gate, grid_tiles, grid_levels
    )
}

_THR = "t0 as (select task_type, round(top, 9) top, count(*) n, count(*) filter (hit) h from sc group by 1, 2), t1 as (select *, sum(n) over (partition by task_type order by top desc) rn, sum(h) over (partition by task_type order by top desc) rh from t0), t2 as (select task_type, max(case when rn >= 25 and rh / rn >= 0.95 then struct_pack(n := rn, top := top, acc := rh / rn) end) m, max(rn) al from t1 group by 1), thr as (select task_type, round(coalesce(m.top, 1.000001), 6) threshold, cast(coalesce(m.n, 0) as bigint) accepted, cast(al as bigint) questions, round(coalesce(m.n, 0) / al, 6) coverage, round(m.acc, 6) accuracy from t2)"

_AGREE = """m0 as (select model_id, task_type, round(top, 9) top, count(*) n, count(*) filter (hit) h from sc where sample_id is not null group by 1, 2, 3), m1 as (select *, sum(n) over w rn, sum(h) over w rh from m0 window w as (partition by model_id, task_type order by top desc)),
 mt as (select model_id, task_type, round(coalesce(max(case when rn >= 5 and rh / rn >= 0.5 then struct_pack(n := rn, top := top) end).top, 1.000001), 6) threshold from m1 group by 1, 2),
 o as (select sample_id, sc.model_id, bool_and(hit and round(round(top, 9), 6) >= threshold) ok, min(source) source, min(sc.task_type) task_type from sc join mt on mt.model_id = sc.model_id and mt.task_type = sc.task_type where sample_id is not null group by 1, 2),
 ag as (select sample_id, count(*) models, min(source) source, min(task_type) task_type from o where ok group by 1 having count(*) = (select count(distinct model_id) from sc where sample_id is not null))"""

SQL = {
    "grid_tiles": r"""with f as (select doc_id, unnest(regexp_extract_all(text, '┌─+┐\n((?:│[^│\n]*│\n)+)└─+┘', 1)) frame, unnest(range(len(regexp_extract_all(text, '┌─+┐\n((?:│[^│\n]*│\n)+)└─+┘', 1)))) place from documents where doc_id is not null),
 l as (select doc_id, cast(place as int) place, list_transform(string_split(rtrim(frame, chr(10)), chr(10)), lambda r: substr(r, 2, length(r) - 2)) rs from f), j as (select *, array_to_string(rs, '') t from l)
 select doc_id, place, cast(case when len(list_distinct(list_transform(rs, lambda r: length(r)))) = 1 then length(rs[1]) end as int) width, cast(len(rs) as int) height, cast(length(t) - length(translate(t, '#', '')) as int) walls, cast(length(t) - length(translate(t, '@+', '')) as int) players, cast(length(t) - length(translate(t, '$*', '')) as int) boxes, cast(length(t) - length(translate(t, '.*+', '')) as int) goals from j""",
    "metric_summary": f"with {P} select grouping(task_type, source) \"level\", task_type, source, count(*) n, round(avg(hit::int), 6) accuracy, round(avg(nll), 6) nll, round(avg(brier), 6) brier from sc group by grouping sets ((), (task_type), (source), (task_type, source))",
    "calibration_error": f"with {P}, b as (select task_type, least(14, floor(top * 15)) bin, count(*) n, sum(top) c, sum(hit::int) h from sc group by 1, 2) select task_type, cast(sum(n) as bigint) n, round(sum(abs(c - h)) / sum(n), 6) ece from b group by 1",
    "macro_accuracy": f"with {P}, b as (select model_id, task_type, avg(hit::int) a from sc group by 1, 2) select model_id, round(avg(a), 6) macro_accuracy, count(*) tasks from b group by 1",
    "ordinal_errors": f"with {P}, r as (select *, list_sum(list_transform(range(1, len(pr)), lambda k: pow(list_sum(pr[1:k]) - case when target < k then 1.0 else 0.0 end, 2))) / (len(pr) - 1) rps from sc where task_type = 'score') select model_id, count(*) n, round(avg(abs(pick - target)), 6) mae, count(*) filter (abs(pick - target) <= 1) within_one, round(avg(rps), 6) rps from r group by 1",
    "confusion": f"with {P} select task_type, target || '->' || pick pair, count(*) n from sc group by 1, 2",
    "threshold_select": f"with {P}, {_THR} select * from thr",
    "threshold_report": f"with {P}, {_THR} select task_type, source, count(*) n, count(*) filter (round(round(top, 9), 6) >= threshold) accepted, count(*) filter (round(round(top, 9), 6) >= threshold and hit) \"right\" from sc join thr using (task_type) group by 1, 2",
    "high_confidence_errors": f"with {P} select model_id, count(*) filter (not hit and top >= 0.9) errors, count(*) n from sc group by 1",
    "all_models_agree": f"with {P}, {_AGREE} select sample_id, models from ag",
    "showcase_selection": f"with {P}, {_AGREE} select source, task_type, arg_min(sample_id, sha256(sample_id)) sample_id, count(*) eligible from ag group by 1, 2",
    "source_of_predictions": f"with {Q}, {P}, l as (select sample_id, source listed from q where split = 'test') select listed is null \"unknown\", listed = source same, count(*) n from ok left join l using (sample_id) group by 1, 2",
    "latency_summary": f"with {P} select task_type, count(*) n, round(sum(latency_ms), 4) total, round(avg(latency_ms), 6) mean, round(quantile_cont(latency_ms, 0.5), 6) p50, round(quantile_cont(latency_ms, 0.95), 6) p95, round(quantile_cont(latency_ms, 0.99), 6) p99, min(latency_ms) least, max(latency_ms) most from ok where latency_ms is not null and not isnan(latency_ms) and latency_ms >= 0 group by 1",
    "quality_gate": f"with {P}, g as (select model_id, avg(hit::int) a, avg(nll) l, count(*) n from sc group by 1) select model_id, a >= 0.5 accurate, l <= 1.0 calibrated, a >= 0.5 and l <= 1.0 and n >= 100 passed from g",
    "temperature_fit": f"with {P}, g as (select task_type, logits, target, unnest([round(0.25 * pow(16.0, i / 120.0), 9) for i in range(121)]) t from ok), l as (select task_type, t, round(avg(least(ln(list_sum(list_transform(logits, lambda v: exp((v - list_max(logits)) / t)))) - (logits[target + 1] - list_max(logits)) / t, 27.631021115928547)), 9) loss from g group by 1, 2) select task_type, arg_min(t, (loss, t)) temperature, round(min(loss), 6) nll from l group by 1",
}
