"""Manifests of several roles from one pool, without leaks: evaluation roles first, training from rows already trained on.

The choice is sequential by nature: a role may not touch a group that an earlier one has claimed. It is made over
candidates whose number the plan bounds: each role, task and source keeps the ``limit`` questions of least hash (all
evaluation questions of the task; for training the role's own number), cut in parallel by hash ranges. What is left,
at most roles x tasks x sources x limit narrow rows a plan, is sorted by step and dealt in one task a plan, which holds
the rows of one step at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import NUL, rank
from marlstone.operators.ranking import first_by_rank
from marlstone.operators.selection import unused

#: Tasks in the order in which a role picks them.
ORDER = ("score", "noul", "choice")
OUT = "plan_id string, role string, schema_split string, task_type string, source string, sample_id string, root_id string, group_id string, wanted long, short long"

SHAPE = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in OUT.split(", ")])
#: Order in which rows are dealt: each step's own row, which has no source, stands before its candidates.
IN = ("plan_id", "turn", "no", "source_place", "place", "sample_id")
FEED = ("plan_id", "turn", "no", "role", "schema_split", "task_type", "wanted", "cap", "source", "sample_id", "root_id", "group_id")


def plan_roles(plans: DataFrame) -> DataFrame:
    """(plan_id, seed, turn, role, schema_split, task_type, wanted, limit, cap): one row for each role and task of a plan.

    turn: evaluation roles as the plan lists them, training last. cap: most questions of one source in training.
    """
    r = plans.where(F.col("plan_id").isNotNull()).select(
        "plan_id", "seed", F.col("selection.maximum_train_share_per_source").alias("share"), F.posexplode(F.map_entries("roles")).alias("pos", "e")
    )
    r = r.select(
        "plan_id", "seed", "share", F.when(F.col("e.key") == "train", 1 << 20).otherwise(F.col("pos")).alias("turn"), F.col("e.key").alias("role"),
        F.col("e.value").alias("v")
    )
    tasks = F.array(*[F.struct(F.lit(t).alias("task_type"), F.coalesce(F.col(f"v.{t}"), F.lit(0)).cast("long").alias("wanted")) for t in ORDER])
    r = r.select(
        "plan_id", "seed", "turn", "role", F.col("v.schema_split").alias("schema_split"),
        F.when(F.col("role") == "train", F.ceil(F.col("v.questions") * F.col("share"))).alias("cap"), F.explode(tasks).alias("t")
    ).select("*", "t.*").drop("t")
    sums = r.where("role != 'train'").groupBy("plan_id", "task_type").agg(F.sum("wanted").alias("all"))
    r = r.join(F.broadcast(sums), ["plan_id", "task_type"], "left")
    return r.withColumn("limit", F.greatest(F.lit(1), F.when(F.col("role") == "train", F.col("wanted")).otherwise(F.col("all")))).drop("all")


def candidates(pool: DataFrame, steps: DataFrame, quotas: DataFrame) -> DataFrame:
    """The ``limit`` questions of least hash for each step and source of a pool: truncated by one hash, to be dealt by another.

    pool: sample_id, root_id, group_id, source, task_type. steps and quotas: rows of ``plan_roles``, of configuration size.
    """
    by = ["plan_id", "role", "task_type", "source"]
    wide = pool.join(F.broadcast(steps.select("plan_id", "seed", "turn", "role", "task_type", "limit")), "task_type")
    wide = wide.withColumn("rank", rank(F.concat_ws(":", "seed", "role", "task_type", "source"), "sample_id"))
    quota = quotas.select(
        "plan_id", "role", "task_type", F.col("limit").alias("take")
    ).join(pool.select("source", "task_type").distinct(), "task_type")
    cut = first_by_rank(wide.select(*by, "turn", "sample_id", "root_id", "group_id", "rank"), by, quota, tie="sample_id")
    # as bytes: they order as their digits do
    place = F.unhex(rank(F.concat(F.lit("rlcd:"), F.concat_ws(":", "role", "task_type")), "sample_id"))
    source_place = F.unhex(rank(F.concat(F.lit("rlcd:"), F.concat_ws(":", "role", "task_type"), F.lit(":sources")), "source"))
    return cut.select(
        "plan_id", "turn", place_of(F.col("task_type")).alias("no"), source_place.alias("source_place"), place.alias("place"), "source", "sample_id",
        "root_id", "group_id"
    )


def place_of(task: Column) -> Column:
    """The task's place in ORDER."""
    return F.array_position(F.array(*map(F.lit, ORDER)), task).cast("int")


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All roles of whole plans, step after step. A row without a sample tells how many questions a step lacks.

    batches: rows of FEED, in the order of IN. A step's rows are held while it is dealt, then let go; of earlier steps only
    what was taken is kept.
    """
    plan, owner, taken, used = None, {}, set(), {}

    def deal(s: dict, pool: pa.Table | None) -> list[tuple]:
        nonlocal plan
        if plan is None or plan[0] != s["plan_id"]:
            plan = (s["plan_id"],)
            owner.clear(), taken.clear(), used.clear()
        name, role = s["task_type"], s["role"]
        cap = math.inf if s["cap"] is None else s["cap"]
        queues = {}
        if pool is not None:
            runs = pc.run_end_encode(pool.column("source").combine_chunks())
            begin = 0
            for source, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                queues[source] = rows_of(pool.slice(begin, end - begin))
                begin = end
        out = []
        while len(out) < s["wanted"] and queues:
            for source in list(queues):
                if len(out) == s["wanted"] or used.get((role, source), 0) >= cap:
                    continue
                row = next((r for r in queues[source] if r[0] not in taken and owner.get(r[2], role) == role), None)
                if row is None:
                    del queues[source]
                    continue
                taken.add(row[0])
                owner[row[2]] = role
                used[role, source] = used.get((role, source), 0) + 1
                out.append((s["plan_id"], role, s["schema_split"], name, source, *row, s["wanted"], 0))
            if len(out) < s["wanted"] and all(used.get((role, n), 0) >= cap for n in queues):
                break
        if len(out) < s["wanted"]:
            out.append((s["plan_id"], role, s["schema_split"], name, None, None, None, None, s["wanted"], s["wanted"] - len(out)))
        return out

    def step() -> Iterator[pa.RecordBatch]:
        pool = pa.Table.from_batches(parts) if parts else None
        for s in heads:
            rows = deal(s, pool)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHAPE)], schema=SHAPE)

    heads: list[dict] = []
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        begin = 0
        for at in np.flatnonzero(batch.column("source").is_null().to_numpy(zero_copy_only=False)).tolist():
            if at > begin:
                parts.append(batch.slice(begin, at - begin))
            head = batch.slice(at, 1).to_pylist()[0]
            if parts or heads and any(heads[-1][k] != head[k] for k in ("plan_id", "turn", "no")):
                yield from step()
                heads, parts = [], []
            heads.append(head)
            begin = at + 1
        if begin < batch.num_rows:
            parts.append(batch.slice(begin))
    yield from step()


def rows_of(pool: pa.Table, many: int = 1000) -> Iterator[tuple]:
    """(sample_id, root_id, group_id) of each row, read a few at a time: most rows of a step are never asked for."""
    for i in range(0, pool.num_rows, many):
        some = pool.slice(i, many)
        yield from zip(*(some.column(c).to_pylist() for c in ("sample_id", "root_id", "group_id")))


def role_manifest(questions: DataFrame, trained: DataFrame, plans: DataFrame, strict: bool = False) -> DataFrame:
    """(plan_id, role, schema_split, task_type, source, sample_id, root_id, group_id, wanted, short): the manifests of all plans.

    questions: sample_id, root_id, group_id, source, task_type, all eligible. trained: the same columns of rows that
    were trained on. Evaluation roles take questions that share no sample, root or group with them; training takes from
    them. A step that lacks questions has one row more, without a sample, that says how many; ``strict`` makes it an error.
    Rows without a source are never taken; those without a group are their own.
    """
    cols = ["sample_id", "root_id", "group_id", "source", "task_type"]
    known = lambda df: df.where("source != '' and task_type != ''").select(*cols)
    own = F.when(F.col("group_id") != "", F.col("group_id")).otherwise(F.concat(F.lit("root" + NUL), "root_id")).alias("group_id")
    listed = plan_roles(plans)
    rows = listed.collect()  # a few rows of configuration
    steps, again, heads = (plans.sparkSession.createDataFrame(rows, listed.schema) for _ in range(3))
    free = known(unused(questions, trained)).select("sample_id", "root_id", own, "source", "task_type")
    seen = known(trained).select("sample_id", "root_id", own, "source", "task_type")
    found = candidates(free, steps.where("role != 'train'"), again).unionByName(candidates(seen, steps.where("role = 'train'"), again))
    heads = heads.withColumn("no", place_of(F.col("task_type"))).drop("seed", "limit")
    feed = found.unionByName(heads, allowMissingColumns=True).repartition("plan_id").sortWithinPartitions(*IN).select(*FEED)
    out = feed.mapInArrow(dealt, OUT)
    if strict:
        lacks = out.where("short > 0").select("plan_id", "role", "task_type", "short").collect()
        if lacks:
            raise ValueError(f"too few questions: {[tuple(r) for r in lacks]}")
    return out


def role_leakage(manifest: DataFrame, trained: DataFrame) -> DataFrame:
    """(check, cases): what must not be: evaluation roots or groups that were trained on, training roots that were
    not, groups in several roles of a plan."""
    rows = manifest.where("sample_id is not null")
    test, train = rows.where("role != 'train'"), rows.where("role = 'train'")
    shared = lambda a, key, how: a.where(F.col(key) != "").select(key).distinct().join(trained.select(key).distinct(), key, how)
    roles = rows.groupBy("plan_id", "group_id").agg(F.min("role").alias("lo"), F.max("role").alias("hi")).where("lo != hi")
    checks = {
        "evaluation roots trained on": shared(test, "root_id", "left_semi"), "evaluation groups trained on": shared(test, "group_id", "left_semi"),
        "training roots not trained on": shared(train, "root_id", "left_anti"), "groups in several roles": roles
    }
    parts = [df.agg(F.count(F.lit(1)).alias("cases")).select(F.lit(name).alias("check"), "cases") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
