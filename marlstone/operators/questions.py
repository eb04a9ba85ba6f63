"""The canonical question view: one row a question, spelling unified, unknown values as defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import spelled, spelled_group, spelled_source, stripped

FIELDS = (
    "ingest_batch", "ingested_at", "source", "task_type", "split", "group_id", "root_id", "language", "teacher_only", "blocked", "image", "question"
)


def questions(example: DataFrame) -> DataFrame:
    """The first delivery of each sample_id (by batch and time, then by value), by one partial aggregate.

    Unknown text is '', an unknown root is the sample itself, unknown flags are false; null keys are left out.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    row = example.where(F.col("sample_id").isNotNull()).select(
        "sample_id",
        F.coalesce("ingest_batch", F.lit(0)).alias("ingest_batch"),
        F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz" if dict(example.dtypes)["ingested_at"] == "timestamp_ntz" else "timestamp")).alias("ingested_at"),
        text(spelled_source("source")).alias("source"),
        text(spelled("task_type")).alias("task_type"),
        text(spelled("split")).alias("split"),
        text(spelled_group("group_id")).alias("group_id"),
        F.coalesce(stripped("root_id"), "sample_id").alias("root_id"),
        text(spelled("language")).alias("language"),
        F.coalesce("teacher_only", F.lit(False)).alias("teacher_only"),
        F.coalesce("quality.release_blocked", F.lit(False)).alias("blocked"),
        text(stripped("image")).alias("image"),
        text(stripped("question")).alias("question"),
    )
    return row.groupBy("sample_id").agg(F.min(F.struct(*FIELDS)).alias("q")).select("sample_id", "q.*")


def predictions(prediction: DataFrame) -> DataFrame:
    """Distinct predictions with a target that indexes their logits and a known task."""
    p = prediction.select(
        "prediction_id", "model_id", "sample_id", spelled_source("source").alias("source"), spelled("task_type").alias("task_type"), "logits",
        "target", "confidence", "correct", "latency_ms"
    ).distinct()
    return p.where(
        "task_type is not null and logits is not null and target >= 0 and target < size(logits) and not exists(logits, x -> x is null or isnan(x))"
    )
