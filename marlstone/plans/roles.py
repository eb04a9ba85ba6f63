"""Queries that build the manifests of several roles, with what SQL can state of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import selection as sel
from marlstone.operators.questions import questions
from marlstone.operators.roles import plan_roles, role_leakage, role_manifest
from marlstone.plans.dataset import SEED
from marlstone.plans.lineage import cut
from marlstone.sources.tables import table


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All eligible questions, and those of the training mixtures."""
    q = cut(
        questions(table(s, d, "example")).where("not teacher_only and not blocked").select(
            "sample_id", "root_id", "group_id", "source", "task_type", "split", "teacher_only", "blocked"
        )
    )
    trained = sel.quota_manifest(q, sel.source_quotas(table(s, d, "sft_117k")), SEED).select("sample_id").distinct()
    return q, cut(q.join(trained, "sample_id", "left_semi"))


def role_steps(s: SparkSession, d: str) -> DataFrame:
    return plan_roles(table(s, d, "rlcd_72k")).select(
        "plan_id", "role", "schema_split", "task_type", "wanted", "limit", F.col("cap").cast("long").alias("cap")
    )


def role_rows(s: SparkSession, d: str) -> DataFrame:
    q, trained = _parts(s, d)
    return role_manifest(q, trained, table(s, d, "rlcd_72k"))


def role_counts(s: SparkSession, d: str) -> DataFrame:
    """(plan_id, role, task_type, wanted, questions, short)"""
    return role_rows(s, d).groupBy("plan_id", "role", "task_type").agg(
        F.max("wanted").alias("wanted"), F.count("sample_id").alias("questions"), F.sum("short").alias("short")
    )


def role_leaks(s: SparkSession, d: str) -> DataFrame:
    q, trained = _parts(s, d)
    return role_leakage(cut(role_manifest(q, trained, table(s, d, "rlcd_72k"))), trained)


QUERIES = {f.__name__: f for f in (role_steps, role_rows, role_counts, role_leaks)}

SQL = {
    "role_steps": """with r as (select plan_id, selection.maximum_train_share_per_source share, unnest(map_keys(roles)) role, unnest(map_values(roles)) v from rlcd_72k where plan_id is not null),
 t as (select plan_id, role, v.schema_split schema_split, case when role = 'train' then cast(ceil(v.questions * share) as bigint) end cap, unnest(['choice', 'noul', 'score']) task_type, unnest([v.choice, v.noul, v.score])::bigint wanted from r)
 select plan_id, role, schema_split, task_type, wanted, cast(greatest(1, case when role = 'train' then wanted else sum(wanted) filter (role <> 'train') over (partition by plan_id, task_type) end) as bigint) "limit", cap from t""",
    # what has to come out, whatever the rows are
    "role_leaks": "select unnest(['evaluation roots trained on', 'evaluation groups trained on', 'training roots not trained on', 'groups in several roles']) \"check\", 0::bigint cases",
}
