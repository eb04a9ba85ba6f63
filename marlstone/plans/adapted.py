"""Queries that run dataset adapters over raw tables made of the driver's, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import spelled, spelled_source
from marlstone.operators import decisions
from marlstone.operators.questions import questions
from marlstone.plans.answers import _ANS
from marlstone.plans.dataset import SEED, TRIM, Q
from marlstone.plans.lineage import cut
from marlstone.sources import adapters, catalog
from marlstone.sources.tables import table


def _shown(rows: DataFrame) -> DataFrame:
    options = F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["id"], o["text"])), "|")
    return rows.select(
        "sample_id", "group_id", "split", "task_type", options.alias("options"),
        F.coalesce(F.get("target.ids", F.lit(0)), F.col("target.bool").cast("string")).alias("target")
    )


def adapted_koniq10k(s: SparkSession, d: str) -> DataFrame:
    rows = adapters.koniq10k(table(s, d, "image_rating"))
    return _shown(rows).drop("options").join(
        rows.select("sample_id", F.get_json_object("quality", "$.upstream_mode").cast("int").alias("mode")), "sample_id"
    )


def adapted_gui_odyssey(s: SparkSession, d: str) -> DataFrame:
    return _shown(adapters.gui_odyssey(table(s, d, "gui_step")))


def adapted_gqa(s: SparkSession, d: str) -> DataFrame:
    """The questions of gqa, as if their right option were the raw answer; repeated deliveries are merged."""
    e = table(s, d, "example").where(F.col("sample_id").isNotNull() & (spelled_source("source") == "gqa") & (F.size("options") > 0))
    answer = F.get(F.filter("options", lambda o: o["id"] == F.get("target.ids", F.lit(0))), F.lit(0))["text"]
    raw = e.select(
        F.col("sample_id").alias("key"), F.coalesce("question", F.lit("")).alias("question"), answer.alias("answer"), F.lit("im").alias("imageId"),
        F.coalesce(spelled("split"), F.lit("")).alias("split")
    ).where("answer is not null")
    one = adapters.one_of_each(raw.select("key", "split", "question", "answer", "imageId"), "key")
    return _shown(adapters.gqa(one))


def adapted_nlvr(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "example").where(F.col("sample_id").isNotNull() & (spelled_source("source") == "nlvr") & F.col("target.bool").isNotNull())
    raw = e.select(
        F.col("sample_id").alias("identifier"), F.lit("0").alias("directory"), F.col("question").alias("sentence"),
        F.col("target.bool").cast("string").alias("label"), F.coalesce(spelled("split"), F.lit("")).alias("split")
    ).distinct()
    return _shown(adapters.nlvr(raw))


def training_rows(s: SparkSession, d: str) -> DataFrame:
    """The first 2,000 training questions of three sources in hashed order, score questions twice and noul ones three times."""
    q = questions(table(s, d, "example")).withColumn("role", F.col("split")).select("sample_id", "role", "source", "task_type")
    return catalog.training_rows(
        q, SEED, "train", ["gqa", "koniq10k", "vqav2"], 2000, {"score": 2, "noul": 3}
    ).select("sample_id", "task_type", "rank", "copy")


def allocated_roles(s: SparkSession, d: str) -> DataFrame:
    """Roles dealt to the test questions by hashed places."""
    q = questions(table(s, d, "example")).where("split = 'test'").select("sample_id", "source")
    return decisions.allocated(q, "sample_id", {"dev": 30, "audit": 20, "test": 150}, SEED).select("sample_id", "place", "label")


def decision_tasks(s: SparkSession, d: str) -> DataFrame:
    """Choice questions with several options as decisions: the options are the actions, the targets the best ones.

    A stage and role has 20 choices, or as many as it has rows that can only be choices, if those are more.
    """
    e = table(s, d, "example").where(F.col("sample_id").isNotNull() & (F.size("options") > 0) & (F.size("target.ids") > 0))
    names = lambda c: F.transform(c, lambda o: o["id"])
    rows = e.select(
        "sample_id", F.coalesce(spelled_source("source"), F.lit("")).alias("stage"), F.coalesce(spelled("split"), F.lit("")).alias("role"),
        names("options").alias("actions"), F.col("target.ids").alias("optimal")
    )
    rows = cut(adapters.one_of_each(rows, "sample_id"))
    forced = F.size(decisions.wrong_actions()) == 0
    quotas = rows.groupBy("stage", "role").agg(F.greatest(F.lit(20), F.count_if(forced)).alias("choice"))
    out = decisions.decision_tasks(rows, quotas)
    return out.select("sample_id", "stage", "role", "task_type", "candidate", F.array_join("targets", ",").alias("targets"), "answer")


QUERIES = {f.__name__: f for f in (training_rows, allocated_roles, decision_tasks, adapted_koniq10k, adapted_gui_odyssey, adapted_gqa, adapted_nlvr)}

_t = TRIM.format
_SRC = f"translate(lower({_t('source')}), ' -', '__')"
_GQA = _ANS.replace("from example where sample_id is not null", f"from (select * replace (coalesce(question, '') as question) from example) where {_SRC} = 'gqa' and sample_id is not null").replace(
    f"struct_pack(split := coalesce(lower({_t('split')}), ''), family :=",
    f"struct_pack(split := case when lower({_t('split')}) = 'train' then 'train' else 'dev' end, family :="
)
_PICK = "list_transform(list_sort(list_transform(o, lambda v: struct_pack(h := sha256(sample_id || chr(0) || v), v := v)))[1:3], lambda s: s.v)"
_SORT = "list_transform(list_sort(list_transform(list_prepend(answer, wrong), lambda v: struct_pack(h := sha256(sample_id || ':' || v), v := v))), lambda s: s.v)"

SQL = {
    "training_rows": f"with {Q}, r as (select sample_id, task_type, sha256('{SEED}' || chr(0) || sample_id) rank from q where split = 'train' and source in ('gqa', 'koniq10k', 'vqav2')), h as (select * from r order by rank limit 2000) select sample_id, task_type, rank, unnest(range(1, 2 + case task_type when 'score' then 1 when 'noul' then 2 else 0 end))::int copy from h",
    "allocated_roles": f"""with {Q}, l as (select label, row_number() over (order by sha256('{SEED}:labels' || chr(0) || i || ':' || label)) place from (select i, case when i < 30 then 'dev' when i < 50 then 'audit' else 'test' end label from (select unnest(range(200)) i))),
 h as (select sample_id, row_number() over (order by sha256('{SEED}' || chr(0) || sample_id)) place from q where split = 'test') select sample_id, cast(place as int) place, label from h join l using (place)""",
    "decision_tasks": f"""with r as (select sample_id, min(struct_pack(stage := coalesce({_SRC}, ''), role := coalesce(lower({_t('split')}), ''), actions := list_transform(options, lambda o: o.id), optimal := target.ids)) m from example where sample_id is not null and len(options) > 0 and len(target.ids) > 0 group by 1),
 w as (select sample_id, m.*, list_filter(m.actions, lambda a: not list_contains(m.optimal, a)) wrong from r),
 p as (select *, row_number() over (partition by stage, role order by sha256(stage || chr(0) || sample_id)) - 1 place, count(*) filter (len(wrong) = 0) over (partition by stage, role) forced from w),
 f as (select *, count(*) filter (len(wrong) > 0) over (partition by stage, role order by place rows between unbounded preceding and current row) free from p),
 c as (select *, len(wrong) = 0 or free <= 20 - forced choice from f)
 select sample_id, stage, role, case when choice then 'choice' else 'noul' end task_type, case when not choice then case when place % 2 = 0 then optimal[1 + place % len(optimal)] else wrong[1 + place % len(wrong)] end end candidate, case when choice then array_to_string(optimal, ',') end targets, case when not choice then list_contains(optimal, case when place % 2 = 0 then optimal[1 + place % len(optimal)] else wrong[1 + place % len(wrong)] end) end answer from c""",
    "adapted_koniq10k": """with r as (select image_name, m.* from (select image_name, min(struct_pack(mos := mos, c1 := c1, c2 := c2, c3 := c3, c4 := c4, c5 := c5)) m from image_rating where image_name is not null and mos is not null group by 1)),
 b as (select *, ('0x' || substr(sha256('koniq10k:' || image_name), 1, 2))::int % 10 b from r), t as (select list_sort(list(mos)) l from b where b < 8),
 u as (select image_name, mos, unnest([1, 2, 3, 4, 5]) level, unnest([coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0), coalesce(c4, 0), coalesce(c5, 0)]) votes from r), m as (select image_name, arg_min(level, (-votes, abs(level - mos), level)) mode from u group by 1)
 select 'koniq10k:' || regexp_replace(image_name, '\\.[^.]*$', '') sample_id, 'koniq10k:' || regexp_replace(image_name, '\\.[^.]*$', '') group_id, case when b < 8 then 'train' when b = 8 then 'dev' else 'test' end split, 'score' task_type, 'score_' || (len(list_filter([l[1 + len(l) * k // 5] for k in [1, 2, 3, 4]], lambda x: x <= mos)) + 1) target, cast(mode as int) mode from b join m using (image_name), t""",
    "adapted_gui_odyssey": rf"""with x as (select 'gui-odyssey:' || episode_id || ':' || step sample_id, episode_id, upper(action) a, info, regexp_matches(info, '^\s*\[') p, regexp_extract_all(info, '-?[0-9]+') n from gui_step where episode_id is not null and step is not null and action is not null),
 v as (select sample_id, episode_id, case when a in ('COMPLETE', 'IMPOSSIBLE') then a when a = 'TEXT' then 'TYPE ' || coalesce(info, 'None') when a in ('CLICK', 'LONG_PRESS') and p then a || ' (' || n[1] || ',' || n[2] || ')' when a = 'SCROLL' and p and len(n) >= 4 then 'SCROLL (' || n[1] || ',' || n[2] || ')->(' || n[3] || ',' || n[4] || ')' else a || ' ' || coalesce(info, 'None') end t, info, a from x),
 w as (select sample_id, episode_id, regexp_replace(lower({_t('t')}), '[\s\pZ]+', ' ', 'g') answer, info, a from v), f as (select sample_id, min(episode_id) episode_id, arg_min(answer, (answer)) answer from w group by 1),
 pool as (select list(answer) pool from (select answer from (select distinct answer from f) order by sha256('pool' || chr(0) || answer) limit 512)),
 c as (select sample_id, episode_id, answer, list_filter(pool, lambda v: v <> answer) o from f, pool), d as (select *, {_PICK} wrong from c), e as (select *, {_SORT} vs from d where len(wrong) > 0)
 select sample_id, 'gui-odyssey:' || episode_id group_id, 'train' split, 'choice' task_type, array_to_string(list_transform(vs, lambda v, i: 'action_' || (i - 1) || '=' || v), '|') "options", 'action_' || (list_position(vs, answer) - 1) target from e""",
    "adapted_gqa": f"""with {_GQA}, a2 as (select * replace ('gqa:' || sample_id as sample_id) from a),
 q0 as (select split, kind, family, list(answer) pool from (select *, row_number() over (partition by split, kind, family order by sha256('pool' || chr(0) || answer)) n from (select distinct split, kind, family, answer from a2)) where n <= 512 group by all),
 q1 as (select split, kind, list(answer) pool from (select *, row_number() over (partition by split, kind order by sha256('pool' || chr(0) || answer)) n from (select distinct split, kind, answer from a2)) where n <= 512 group by all),
 c0 as (select sample_id, split, answer, list_filter(q0.pool, lambda x: x <> answer) o0, list_filter(q1.pool, lambda x: x <> answer) o1 from a2 join q0 using (split, kind, family) join q1 using (split, kind)),
 c as (select sample_id, split, answer, case when len(o0) >= 3 then o0 else o1 end o from c0), d as (select *, {_PICK} wrong from c), e as (select *, {_SORT} vs, answer in ('yes', 'true', 'no', 'false') noul from d where len(wrong) > 0 or answer in ('yes', 'true', 'no', 'false'))
 select sample_id, 'gqa-image:im' group_id, split, case when noul then 'noul' else 'choice' end task_type, case when noul then '' else array_to_string(list_transform(vs, lambda v, i: 'option_' || (i - 1) || '=' || v), '|') end "options", case when noul then (answer in ('yes', 'true'))::text else 'option_' || (list_position(vs, answer) - 1) end target from e""",
    "adapted_nlvr": f"""with r as (select distinct sample_id i, question, target.bool b, coalesce(lower({_t('split')}), '') s from example where sample_id is not null and {_SRC} = 'nlvr' and target.bool is not null)
 select 'nlvr:' || s || ':' || i || ':' || p sample_id, 'nlvr:' || s || ':' || i group_id, s split, 'noul' task_type, '' "options", b::text target from r, (select unnest(range(6)) p)""",
}
