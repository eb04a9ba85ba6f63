"""Catalogs of sources, records of downloads, recorded predictions, and the rows a training run reads."""

from __future__ import annotations

import ast
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.hashing import rank
from marlstone.operators.ranking import first_by_rank
from marlstone.sources.files import json_field, json_lines


def only_once(rows: DataFrame, key: str, what: str) -> DataFrame:
    """The rows, if no key stands in two of them; else an error that names some."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{what} more than once: {[r[key] for r in twice]}")
    return rows


def catalog(spark: SparkSession, path: str, schema: str = "id string, name string, priority int, enabled boolean") -> DataFrame:
    """The sources of a catalog file; an id that stands twice is an error."""
    return only_once(json_field(spark, path, "sources", f"struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>"), "id", "source")


def active(sources: DataFrame) -> DataFrame:
    """The sources that are not disabled, in the order of priority and id; those without a priority come last."""
    return sources.where(F.coalesce("enabled", F.lit(True))).orderBy(F.col("priority").asc_nulls_last(), "id")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(source, files, bytes) of the records of a folder: one JSON object a file, with its artifacts."""
    records = spark.read.schema(
        "source string, artifacts array<struct<path:string,bytes:long,sha256:string>>"
    ).option("multiLine", True).option("mode", "FAILFAST").json(folder)
    sizes = F.aggregate(
        F.coalesce("artifacts", F.array().cast("array<struct<path:string,bytes:bigint,sha256:string>>")), F.lit(0).cast("long"),
        lambda a, x: a + F.coalesce(x["bytes"], F.lit(0))
    )
    return records.groupBy("source").agg(F.sum(F.coalesce(F.size("artifacts"), F.lit(0))).alias("files"), F.sum(sizes).alias("bytes"))


def absent(wanted: DataFrame, present: DataFrame, key: str = "id", other: str = "source") -> DataFrame:
    """Keys that are wanted and not present."""
    return wanted.select(key).distinct().join(present.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def unlike(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, problem): listed files that are missing, or whose length or digest is another. files: as from ``files.digests``."""
    j = listed.select(
        "path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")
    ).join(files.select("path", "length", "sha256"), "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(
        F.col("length") != F.col("_bytes"), "length"
    ).when(F.col("sha256") != F.col("_sha"), "digest")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def split_of_file(path: Column) -> Column:
    """train, or dev for any other file; null for files of test questions, which are not read."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.contains("test"), F.lit(None)).when(name.contains("train"), "train").otherwise("dev")


@F.pandas_udf(T.StringType())
def literal_json(text: pd.Series) -> pd.Series:
    """A Python literal as JSON; null if it is none. There is no built-in for these, so it runs in Arrow batches."""

    def one(t: Any) -> str | None:
        try:
            return json.dumps(ast.literal_eval(t), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return text.map(one).astype(object).where(text.notna(), None)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded predictions to resume from: a malformed line fails the read, a sample recorded twice is an error."""
    return only_once(json_lines(spark, path, schema), "sample_id", "prediction")


def matched(predictions: DataFrame, manifest: DataFrame, fields: list[str], key: str = "sample_id") -> DataFrame:
    """Predictions with fields of the manifest; one of a sample that the manifest doesn't have is an error."""
    m = manifest.select(key, *fields, F.lit(True).alias("_known"))
    j = predictions.join(m, key, "left")
    error = F.raise_error(F.concat(F.lit("not in the manifest: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return j.withColumn("_known", F.when(F.col("_known"), True).otherwise(error)).where("_known").drop("_known")


def training_rows(
    rows: DataFrame, seed: str, role: str | None = None, sources: list[str] | None = None, maximum: int | None = None,
    repeats: dict[str, int] | None = None, key: str = "sample_id"
) -> DataFrame:
    """The rows a training run reads: of a role and of some sources, in hashed order (``rank``), at most ``maximum``,
    those of each task repeated (``copy``, from 1; a task without a number, or with less than one, once)."""
    r = rows if role is None else rows.where(F.coalesce("role", F.lit("train")) == role)
    r = (r if sources is None else r.where(F.col("source").isin(sources))).withColumn("rank", rank(seed, key))
    if maximum is not None:
        quota = rows.sparkSession.createDataFrame([(0, maximum)], "_all int, take int")
        r = first_by_rank(r.withColumn("_all", F.lit(0)), ["_all"], quota, tie=key).drop("_all")
    times = F.lit(1)
    for task, n in (repeats or {}).items():
        times = F.when(F.col("task_type") == task, max(1, n)).otherwise(times)
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def epoch_order(rows: DataFrame, seed: str, epoch: int, key: str = "sample_id") -> DataFrame:
    """The rows in an order of their own for each epoch, by hash of seed, epoch and key: the same at every run and layout."""
    return rows.orderBy(rank(f"{seed}:{epoch}", key), key)


def at_turn(turns: DataFrame, replays: DataFrame, status: str = "valid") -> DataFrame:
    """Turns with the event of their demo's replay at their index, of this status; indexes out of range give nothing.

    turns: demo, turn. replays: demo, events (an array of structs with a status).
    """
    j = turns.join(replays.select("demo", "events"), "demo")
    return j.withColumn("event", F.when(F.col("turn") >= 0, F.get("events", F.col("turn")))).drop("events").where(F.col("event.status") == status)


def config_errors(config: dict[str, Any], world: int) -> list[str]:
    """What is wrong with the batch sizes of a training configuration, for so many processes."""
    number = lambda k, d=0: int(config.get(k, d))
    found = [f"{k} must be positive" for k in ("epochs", "microbatch_questions_per_device", "gradient_accumulation_steps") if number(k) < 1]
    if number("expected_world_size", world) != world:
        found.append(f"made for {number('expected_world_size')} processes, not {world}")
    batch = number("microbatch_questions_per_device") * number("gradient_accumulation_steps") * world
    if number("global_batch_questions", batch) != batch:
        found.append(f"a global batch of {number('global_batch_questions')} is configured, {batch} follows from the rest")
    if number("checkpoint_every_steps") < 0:
        found.append("checkpoint_every_steps must not be negative")
    return found


def group_errors(models: list[dict[str, Any]], roles: set[str]) -> list[str]:
    """What is wrong with a list of models (id, group, role): ids that repeat, groups without exactly these roles."""
    ids = [m["id"] for m in models]
    found = [f"id {i} repeats" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for group in sorted({m["group"] for m in models}):
        have = sorted(m["role"] for m in models if m["group"] == group)
        if have != sorted(roles):
            found.append(f"group {group} has the roles {have}")
    return found
