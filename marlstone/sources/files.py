"""Raw files and published tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a known schema; blank lines are skipped. A malformed line fails the read, or becomes nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def csv_rows(spark: SparkSession, path: str, fill: bool = True) -> DataFrame:
    """CSV with a header; fields may hold line breaks; all columns are text, missing ones '' if ``fill``."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.na.fill("") if fill else df


def json_field(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The elements of an array field of a whole-file JSON object, as rows. schema: that of an element."""
    whole = spark.read.schema(f"`{field}` array<{schema}>").option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("e")).select("e.*")


def json_by_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a whole-file JSON object keyed by id: (key, value fields). schema: that of a value.

    The file may be laid out over any lines; one that is no such object fails the read.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,{schema}>", {"mode": "FAILFAST"})
    return text.select(F.explode(parsed).alias("key", "e")).select("key", "e.*")


def levels(spark: SparkSession, path: str) -> DataFrame:
    """(file, level_id, level, error) of level texts: blocks that begin with '; id'.

    error: why a level is unusable: it has no rows, rows of unequal length or a tile other than ``# @$.*+``; else null.
    """
    text = spark.read.text(path, wholetext=True).withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    blocks = F.filter(F.split(F.concat(F.lit("\n"), "value"), r"\n;"), lambda b: F.trim(b) != "")
    text = text.select(F.input_file_name().alias("file"), F.explode(blocks).alias("b"))
    lines = F.filter(F.slice(F.split("b", "\n"), 2, 1 << 30), lambda r: F.trim(r) != "")
    out = text.select(
        "file", F.trim(F.substring_index("b", "\n", 1)).alias("level_id"), F.array_join(lines, "\n").alias("level"), lines.alias("lines")
    )
    ragged = F.array_min(F.transform("lines", F.length)) != F.array_max(F.transform("lines", F.length))
    error = F.when(F.size("lines") == 0, "no rows").when(ragged, "rows of unequal length").when(F.col("level").rlike(r"[^# @$.*+\n]"), "unknown tile")
    return out.withColumn("error", error).drop("lines")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def compact_json(rows: DataFrame) -> Column:
    """A row as JSON with its nulls, fields in the order of their names."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def manifest_digest(rows: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a table that no partitioning changes, of any size.

    Rows become JSON with their nulls and are hashed one by one. Four sums of 60 bits each of the hashes, over all
    rows, so that no hash has to be kept or ordered, are hashed together with the number of rows. It tells accidental
    changes, also of repeated rows; it is no signature.
    """
    h = rows.select(F.sha2(compact_json(rows), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = h.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(part(i), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


Check = DataFrame | Callable[[DataFrame], DataFrame]


def publish(df: DataFrame, path: str, checks: dict[str, Check], report: DataFrame | None = None) -> int:
    """Write a new table if every check (a table of violations) is empty; returns its rows. Never overwrites.

    A check is a table, or a function that makes one of the staged rows: what is checked then is what is published.
    The report, and the outcome of each check, are written beside the table before a failed check raises. Nothing
    is left under the table's name, nor in its staging folder, if a check fails.
    """
    spark = df.sparkSession
    staging = path.rstrip("/") + ".staging"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, temp = hadoop.Path(path), hadoop.Path(staging)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    n = staged.count()
    failed = [name for name, bad in checks.items() if (bad(staged) if callable(bad) else bad).limit(1).count()]
    if report is not None:
        report.write.mode("overwrite").json(path.rstrip("/") + ".report")
    outcome = [(name, name not in failed, n) for name in checks] or [("none", True, n)]
    spark.createDataFrame(outcome, "check string, passed boolean, rows long").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".checks")
    if failed:
        fs.delete(temp, True)
        raise ValueError(f"not published: {', '.join(failed)}")
    if not fs.rename(temp, target):
        raise OSError(f"{staging} could not be renamed")
    return n
