"""Options, histories, candidates, answers and prompts, as expressions over nested columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marlstone.operators.ranking import first_by_rank
from marlstone.plans.lineage import cut

# Colour words that make an answer a colour.
COLOURS = (
    "black", "blue", "brown", "cyan", "gold", "gray", "green", "grey", "orange", "pink", "purple", "red", "silver", "tan", "teal", "white", "yellow"
)

# Patterns of answers that are numbers and times; the whole answer has to match.
NUMBER = r"[$€£]?[-+]?\d[\d,.]*(?::\d+|%|\s*(?:percent|percentage))?"
TIME = r"\d{1,2}:\d{2}\s*[ap]m"

# Patterns by which questions fall into families, tried in this order.
FAMILIES = (
    ("count", r"\bhow many\b|\bnumber of\b"),
    ("quantity", r"\bhow much\b|\bwhat (?:percentage|percent|value|amount)\b"),
    ("color", r"\b(?:what|which) colou?r\b"),
    ("shape", r"\b(?:what|which) shape\b"),
    ("material", r"\bmade of\b|\bmaterial\b"),
    ("size", r"\b(?:what|which) size\b|\bhow (?:large|small|big|tall|long)\b"),
    ("location", r"^where\b|\b(?:what|which) (?:room|place|location|country|city|state|region)\b"),
    ("organization", r"\b(?:what|which) (?:company|organization|team)\b"),
    ("person", r"^who\b|\bwhich person\b"),
    ("time", r"^when\b|\bwhat time\b|\bwhich year\b"),
    ("text", r"\b(?:say|says|read|written|word|text|title)\b"),
    ("brand", r"\bbrand\b|\blogo\b"),
    ("sport", r"\b(?:sport|game)\b"),
    ("animal", r"\b(?:animal|bird|dog|cat)\b"),
    ("type", r"\b(?:type|kind|sort) of\b"),
    ("reason", r"^why\b"),
)

# Opening words that are a family of their own where no pattern holds.
OPENING = r"^(?:what|which|how|is|are|does|do|can)\b"


#: Hashes in a task, about.
WORK = 10_000_000


def normalized(answer: Column | str) -> Column:
    """An answer in lower case, without white space at its ends, inner white space as one space."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def answer_kind(answer: Column) -> Column:
    """color, number, time, phrase or word; the first that fits. answer: normalized."""
    whole = lambda p: answer.rlike(rf"(?U)\A(?:{p})\z")
    return F.when(answer.isin(*COLOURS), "color").when(whole(NUMBER), "number").when(whole(TIME), "time").when(
        F.instr(answer, " ") > 0, "phrase"
    ).otherwise("word")


def question_family(question: Column) -> Column:
    """The first family whose pattern is found in the normalized question; else its opening word, if that is listed,
    else 'other'."""
    q, out = normalized(question), None
    for name, pattern in FAMILIES:
        hit = q.rlike("(?U)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    opening = F.regexp_extract(q, "(?U)" + OPENING, 0)
    return out.when(opening != "", opening).otherwise("other")


def hashed_order(values: Column, key: Column, sep: str = ":") -> Column:
    """Array values in the order of the hash of key, separator and value."""
    return after_hash(F.array_sort(with_hash(values, key, sep)))


def with_hash(values: Column, key: Column, sep: str) -> Column:
    """Each value behind the hash of key, separator and value: strings compare faster than structs."""
    return F.transform(values, lambda v: F.concat(F.sha2(F.concat(key, F.lit(sep), v), 256), v))


def after_hash(values: Column) -> Column:
    """The values without their hashes."""
    return F.transform(values, lambda x: F.substring(x, 65, 1 << 30))


def pools(answers: DataFrame, by: list[str], cap: int = 512) -> DataFrame:
    """(by, pool): the distinct answers of each pool, cut to the ``cap`` of least hash.

    The hash is that of the answer alone, so it is cut in hash ranges first: a pool with any number of answers is not
    sorted in one task.
    """
    members = answers.select(*by, "answer").distinct().withColumn("rank", F.sha2(F.concat(F.lit("pool\u0000"), "answer"), 256))
    heads = first_by_rank(members, by, members.select(*by).distinct().withColumn("take", F.lit(cap)), tie="answer")
    return heads.groupBy(*by).agg(F.array_sort(F.collect_list("answer")).alias("pool"))


def negatives(
    answers: DataFrame, by: list[str], wanted: int = 3, cap: int = 512, most: int = 4096, members: DataFrame | None = None, fallback: bool = True
) -> DataFrame:
    """(sample_id, answer, negatives): other answers of the same pool, hash-ranked for each sample.

    answers: sample_id, answer and the columns ``by`` of its pool. A sample whose pool has fewer than ``wanted`` other
    answers takes the pool of all columns but the last, and has fewer negatives if that is small as well. Pools are
    cut to ``cap`` answers by the operator's definition. The pool is chosen before it is ranked, so each member is
    hashed once a sample. members: the rows that make the pools, if others than ``answers``. fallback: whether small
    pools are widened; one column of ``by`` has to remain then. Pools are counted: up to ``most`` of them, of ``cap`` answers each, are broadcast, more are
    joined by shuffle.
    """
    a = cut(answers.select("sample_id", "answer", *by))
    # a row takes as many hashes as its pool has answers, so rows are spread by work, not by bytes, and before pools are joined
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, a.count() * cap // WORK)
    members = a if members is None else members
    out = a.repartition(tasks, "sample_id").withColumn("negatives", F.lit(None).cast("array<string>"))
    ways = [(keys, enough, cut(pools(members, keys, cap))) for keys, enough in (((by, wanted), (by[:-1], 0)) if fallback else ((by, 0),))]
    if all(p.count() <= most for _, _, p in ways):
        return few_pools(out.drop("negatives"), ways, wanted)
    for keys, enough, p in ways:
        out = out.join(F.broadcast(p) if p.count() <= most else p, keys, "left")
        pool = F.coalesce("pool", F.array().cast("array<string>"))
        others = F.size(pool) - F.coalesce(F.array_contains(pool, F.col("answer")), F.lit(False)).cast("int")
        pool = F.array_remove(pool, F.col("answer"))
        first = F.slice(F.array_sort(with_hash(pool, F.col("sample_id"), "\u0000")), 1, wanted)
        # what a pool gives is taken before the row moves on, so that no pool moves with a row
        out = out.withColumn("negatives", F.when(F.col("negatives").isNull() & (others >= enough), after_hash(first)).otherwise(F.col("negatives")))
        out = out.drop("pool")
    return out.select("sample_id", "answer", "negatives")


def few_pools(rows: DataFrame, ways: list[tuple[list[str], int, DataFrame]], wanted: int) -> DataFrame:
    """(sample_id, answer, negatives) by pools that were counted: each row gets its pools' numbers, and a Python worker has the
    pools and hashes a pool as one list, which takes less time than the JVM's expressions.

    ways: columns of the pool, other answers it has to have, pools; the first that has enough is taken.
    """
    spark, lists = rows.sparkSession, []
    for i, (keys, enough, p) in enumerate(ways):
        found = p.select(*keys, "pool").collect()
        shape = T.StructType([*p.select(*keys).schema.fields, T.StructField(f"_at{i}", T.IntegerType())])
        numbers = spark.createDataFrame([(*r[:-1], n) for n, r in enumerate(found)], shape)
        rows = rows.join(F.broadcast(numbers), keys, "left")
        lists.append((enough, [r.pool for r in found]))
    shared = spark.sparkContext.broadcast(lists)

    @F.pandas_udf("array<string>")
    def least(sample: pd.Series, answer: pd.Series, at: pd.DataFrame) -> pd.Series:
        tried = [(enough, pools_, [[v.encode() for v in p] for p in pools_], [set(p) for p in pools_]) for enough, pools_ in shared.value]
        sha, out = hashlib.sha256, []
        for s, a, *ns in zip(sample, answer, *(at[c].fillna(-1).astype(int) for c in at.columns)):
            got = None
            for n, (enough, names, coded, known) in zip(ns, tried):
                pool = names[n] if n >= 0 else []
                others = len(pool) - (n >= 0 and a in known[n])
                if a is None or others < enough:
                    continue
                if s is None or not pool:
                    got = [None] * min(wanted, others)
                    break
                key = s.encode() + b"\0"
                hashes = [sha(key + v).digest() for v in coded[n]]
                got = [v for v in (pool[hashes.index(h)] for h in sorted(hashes)[: wanted + 1]) if v != a][:wanted]
                break
            out.append(got)
        return pd.Series(out, dtype=object)

    return rows.select("sample_id", "answer", least("sample_id", "answer", F.struct(*[f"_at{i}" for i in range(len(ways))])).alias("negatives"))


def history(steps: DataFrame) -> DataFrame:
    """(episode_id, step, action, history): all actions of earlier steps, in order; repeated steps count once."""
    first = steps.where("episode_id is not null and step is not null").groupBy("episode_id", "step").agg(F.min("action").alias("action"))
    w = W.partitionBy("episode_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return first.withColumn("history", F.collect_list("action").over(w))


def usable(options: Column) -> Column:
    """Options with a box of positive area."""
    return F.filter(options, lambda o: o["box"].isNotNull() & (F.size(o["box"]) == 4) & (o["box"][2] > o["box"][0]) & (o["box"][3] > o["box"][1]))


def smallest(options: Column) -> Column:
    """The id of the usable option of least area, ties by id."""
    area = lambda o: F.round((o["box"][2] - o["box"][0]) * (o["box"][3] - o["box"][1]), 9)
    return F.array_min(F.transform(usable(options), lambda o: F.struct(area(o).alias("a"), o["id"].alias("id"))))["id"]


def smallest_of(options: Column, ids: Column) -> Column:
    """The id of the option of least area among those named, ties by id; null if none of them is an option."""
    area = lambda o: (o["box"][2] - o["box"][0]) * (o["box"][3] - o["box"][1])
    named = F.filter(options, lambda o: F.array_contains(ids, o["id"]))
    return F.array_min(F.transform(named, lambda o: F.struct(area(o).alias("a"), o["id"].alias("id"))))["id"]


def visible_target(options: Column, target: Column, width: Column, height: Column) -> Column:
    """Whether a target can be seen in a picture of this size: its box has an area, of at most nine tenths of the
    picture, and at least half of it lies inside. A target without a box, or that is no option, passes."""
    box = F.get(F.filter(options, lambda o: o["id"] == target), F.lit(0))["box"]
    area = (box[2] - box[0]) * (box[3] - box[1])
    inside = lambda lo, hi, size: F.greatest(F.lit(0.0), F.least(hi, size) - F.greatest(lo, F.lit(0.0)))
    within = inside(box[0], box[2], width) * inside(box[1], box[3], height)
    fits = (area > 0) & (width > 0) & (height > 0) & (area <= width * height * 0.9)
    return F.when(
        F.size(F.filter(options, lambda o: o["id"] == target)) == 0, True
    ).when(box.isNull(), True).otherwise(F.coalesce(fits & (within / area >= 0.5), F.lit(False)))


def at_point(options: Column, x: float, y: float) -> Column:
    """Ids of the usable options whose closed box holds the point."""
    return F.transform(
        F.filter(usable(options), lambda o: F.lit(x).between(o["box"][0], o["box"][2]) & F.lit(y).between(o["box"][1], o["box"][3])),
        lambda o: o["id"]
    )


def thousandths(box: Column) -> Column:
    """A box in whole thousandths, rounded half to even, inside 0..1000."""
    return F.transform(box, lambda v: F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * 1000).cast("int"))))


def prompt(state: Column, question: Column, options: Column) -> Column:
    """State, question and numbered options as one text; empty parts are left out."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o["text"])), "\n")
    part = lambda c: F.when(c != "", c)
    return F.concat_ws("\n\n", part(state), part(question), part(lines))
