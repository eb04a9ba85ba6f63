"""The contract of a question table: what every row and the whole table have to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import spelled, spelled_group, stripped

# Fields no question may lack, and those that schema version 2 adds.
REQUIRED = (
    "schema_version", "sample_id", "group_id", "source", "source_version", "license", "split", "task_type", "state_text", "question", "options",
    "target_kind", "target", "label_origin", "language"
)
REQUIRED_2 = (
    "root_id", "source_bucket", "image_metadata", "allowed_history", "input_track", "candidates", "origin_label_method", "generator_revision",
    "quality", "teacher_only"
)
# The task types and splits there are.
TASKS = ("choice", "noul", "score")
SPLITS = ("train", "dev", "calibration", "test")


def row_checks() -> list[tuple[str, Column]]:
    """(violation, whether a row has it), in the order in which they are reported; never null.

    Spelling of task and split is unified first; a field that is null is a field that is missing.
    """
    task, split = F.coalesce(spelled("task_type"), F.lit("")), F.coalesce(spelled("split"), F.lit(""))
    options, targets = F.coalesce(
        "options", F.array().cast("array<struct<id:string,text:string,box:array<double>>>")
    ), F.coalesce("target.ids", F.array().cast("array<string>"))
    ids = F.transform(options, lambda o: o["id"])
    lacks = lambda names: F.greatest(*[F.col(n).isNull() for n in names])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    second = F.coalesce(F.col("schema_version") == 2, F.lit(False))
    flat = lambda b: (F.size(b) != 4) | F.coalesce((b[0] >= b[2]) | (b[1] >= b[3]), F.lit(True))
    chosen = task.isin("choice", "score")
    return [
        ("missing fields", lacks(REQUIRED)),
        ("schema_version", ~F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False))),
        ("missing v2 fields", second & lacks(REQUIRED_2)),
        ("candidates differ from options", second & ~F.col("candidates").eqNullSafe(F.col("options"))),
        ("teacher_only", second & F.coalesce("teacher_only", F.lit(False))),
        ("unknown task_type", ~task.isin(*TASKS)),
        ("unknown split", ~split.isin(*SPLITS)),
        ("no list of options", F.col("options").isNull()),
        ("option without id or text", F.exists(options, lambda o: blank(o["id"]) | blank(o["text"]))),
        ("box without area", F.exists(options, lambda o: o["box"].isNotNull() & flat(o["box"]))),
        ("option ids repeat", F.size(ids) != F.size(F.array_distinct(ids))),
        ("too few options", chosen & (F.size(options) < 2)),
        ("target is no option", chosen & ((F.size(targets) < 1) | (F.size(F.array_except(targets, ids)) > 0))),
        ("noul with options", (task == "noul") & (F.size(options) > 0)),
        ("noul target is not boolean", (task == "noul") & F.col("target.bool").isNull()),
        ("teacher label outside train", F.coalesce(F.col("label_origin") == "teacher_only", F.lit(False)) & (split != "train")),
    ]


def violations(rows: DataFrame) -> DataFrame:
    """The rows that break the contract, with all their ``violations`` and the ``first`` of them."""
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in row_checks()]), lambda v: v.isNotNull())
    return rows.withColumn("violations", found).where(F.size("violations") > 0).withColumn("first", F.get("violations", F.lit(0)))


def table_violations(rows: DataFrame) -> DataFrame:
    """(violation, at): ids delivered more than once, groups whose rows lie in two or more splits, an empty table."""
    ids = rows.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = rows.select(spelled_group("group_id").alias("g"), spelled("split").alias("s")).where("g is not null and s is not null")
    torn = groups.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo != hi")
    none = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    named = lambda df, name, at: df.select(F.lit(name).alias("violation"), at.alias("at"))
    return named(ids, "sample_id repeats", F.col("sample_id")).unionByName(
        named(torn, "group in several splits", F.col("g"))
    ).unionByName(named(none, "no rows", F.lit(None).cast("string")))


# The only fields that a model may see when it answers.
VISIBLE = ("image", "image_metadata", "state_text", "question", "allowed_history", "input_track", "task_type", "candidates")


def visible(rows: DataFrame) -> DataFrame:
    """Only the fields that exist at inference time, of those the table has: no targets, no ids, no evidence."""
    return rows.select(*[c for c in VISIBLE if c in rows.columns])


def eligible() -> Column:
    """Whether a question may be used at all, whatever its split: not for teachers only and not blocked."""
    return ~F.coalesce(F.col("teacher_only"), F.lit(False)) & ~F.coalesce(F.col("quality.release_blocked"), F.lit(False))


def missing_assets(rows: DataFrame, files: DataFrame, image: str = "image", path: str = "path") -> DataFrame:
    """Rows whose picture isn't among the listed files; rows without a picture need none. files: one path a row."""
    return rows.where(stripped(image).isNotNull()).join(files.select(F.col(path).alias(image)).distinct(), image, "left_anti")
