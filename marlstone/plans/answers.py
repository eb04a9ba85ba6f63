"""Queries over answers, prompts and the contract, with SQL that states its own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import spelled
from marlstone.operators import contract
from marlstone.operators import nesting as nest
from marlstone.operators import prompts
from marlstone.plans.dataset import TRIM
from marlstone.sources.tables import table


def answers(s: SparkSession, d: str) -> DataFrame:
    """(sample_id, split, family, answer, kind): one right answer a question with options; deliveries are merged."""
    e = table(s, d, "example").where("sample_id is not null and size(options) > 0 and get(target.ids, 0) is not null")
    chosen = F.get(F.filter("options", lambda o: o["id"] == F.get("target.ids", F.lit(0))), F.lit(0))["text"]
    family = nest.question_family(F.coalesce("question", F.lit("")))
    a = e.select(
        "sample_id", F.coalesce(spelled("split"), F.lit("")).alias("split"), family.alias("family"), nest.normalized(chosen).alias("answer")
    ).where("answer is not null")
    a = a.groupBy("sample_id").agg(F.min(F.struct("split", "family", "answer")).alias("a")).select("sample_id", "a.*")
    return a.withColumn("kind", nest.answer_kind(F.col("answer")))


def answer_kinds(s: SparkSession, d: str) -> DataFrame:
    return answers(s, d).groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("answer").alias("answers"))


def stable_negatives(s: SparkSession, d: str) -> DataFrame:
    n = nest.negatives(answers(s, d), ["split", "kind", "family"])
    return n.select("sample_id", "answer", F.array_join("negatives", "|").alias("negatives"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "example").where("sample_id is not null")
    return e.withColumn("task", F.coalesce(spelled("task_type"), F.lit("")))


def model_input(s: SparkSession, d: str) -> DataFrame:
    """The digest of each prompt; boxes of this table are fractions of the picture."""
    one = F.lit(1.0)
    text = prompts.prompt(F.col("task"), F.col("state_text"), F.col("allowed_history"), F.col("question"), F.col("options"), one, one)
    boxed = F.coalesce(F.exists("options", lambda o: o["box"].isNotNull()), F.lit(False))
    e = _asked(s, d).select(
        "sample_id", text.alias("prompt"), F.when((F.col("task") == "score") | boxed, 576).otherwise(256).alias("budget")
    ).distinct()
    return e.select("sample_id", F.sha2("prompt", 256).alias("prompt_digest"), F.length("prompt").alias("characters"), "budget")


def answer_json(s: SparkSession, d: str) -> DataFrame:
    """(sample_id, answer, right): the answer to give, and whether it is judged right when read back."""
    e = _asked(s, d).select(
        "sample_id", "task", "target", "options", prompts.answer_json(F.col("task"), F.col("target")).alias("answer")
    ).where("answer is not null")
    value = prompts.generated(F.col("task"), F.col("answer"), F.col("options"))
    # a score's ids name levels; their number is what is answered
    levels = F.transform("target.ids", lambda i: F.concat(F.lit("score_"), F.regexp_extract(i, "([^_]*)$", 1)))
    target = F.struct(F.col("target.bool").alias("bool"), F.when(F.col("task") == "score", levels).otherwise(F.col("target.ids")).alias("ids"))
    return e.select("sample_id", "answer", prompts.is_correct(F.col("task"), value, target).alias("right")).distinct()


def contract_violations(s: SparkSession, d: str) -> DataFrame:
    """(violation, rows, first): rows with each violation, and those of which it is the first."""
    v = contract.violations(table(s, d, "example")).select(F.explode("violations").alias("violation"), F.col("first").alias("f"))
    return v.groupBy("violation").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("f") == F.col("violation")).alias("first"))


def contract_rejects(s: SparkSession, d: str) -> DataFrame:
    """(sample_id, first): every question with a delivery that breaks the contract, with the first rule broken."""
    v = contract.violations(table(s, d, "example")).where("sample_id is not null")
    return v.select("sample_id", "first").distinct()


def table_violations(s: SparkSession, d: str) -> DataFrame:
    return contract.table_violations(table(s, d, "example")).groupBy("violation").agg(F.count(F.lit(1)).alias("cases"))


QUERIES = {f.__name__: f for f in (answer_kinds, stable_negatives, model_input, answer_json, contract_violations, contract_rejects, table_violations)}

_t = TRIM.format
_N = rf"regexp_replace(lower({_t('{0}')}), '[\s\pZ]+', ' ', 'g')"
_ANS = rf"""a0 as (select sample_id, min(struct_pack(split := coalesce(lower({_t('split')}), ''), family := case
  when regexp_matches(nq, '\bhow many\b|\bnumber of\b') then 'count'
  when regexp_matches(nq, '\bhow much\b|\bwhat (percentage|percent|value|amount)\b') then 'quantity'
  when regexp_matches(nq, '\b(what|which) (color|colour)\b') then 'color'
  when regexp_matches(nq, '\b(what|which) shape\b') then 'shape'
  when regexp_matches(nq, '\bmade of\b|\bmaterial\b') then 'material'
  when regexp_matches(nq, '\b(what|which) size\b|\bhow (large|small|big|tall|long)\b') then 'size'
  when regexp_matches(nq, '^where\b|\b(what|which) (room|place|location|country|city|state|region)\b') then 'location'
  when regexp_matches(nq, '\b(what|which) (company|organization|team)\b') then 'organization'
  when regexp_matches(nq, '^who\b|\bwhich person\b') then 'person'
  when regexp_matches(nq, '^when\b|\bwhat time\b|\bwhich year\b') then 'time'
  when regexp_matches(nq, '\b(say|says|read|written|word|text|title)\b') then 'text'
  when regexp_matches(nq, '\b(brand|logo)\b') then 'brand'
  when regexp_matches(nq, '\b(sport|game)\b') then 'sport'
  when regexp_matches(nq, '\b(animal|bird|dog|cat)\b') then 'animal'
  when regexp_matches(nq, '\b(type|kind|sort) of\b') then 'type'
  when regexp_matches(nq, '^why\b') then 'reason'
  when regexp_matches(nq, '^(what|which|how|is|are|does|do|can)\b') then regexp_extract(nq, '^[a-z]+')
  else 'other' end, answer := answer)) a from
 (select sample_id, split, {_N.format("coalesce(question, '')")} nq, {_N.format("list_filter(options, lambda o: o.id = target.ids[1])[1].text")} answer
  from example where sample_id is not null and len(options) > 0 and target.ids[1] is not null) where answer is not null group by sample_id),
a as (select sample_id, a.*, case
  when a.answer in ('black', 'blue', 'brown', 'cyan', 'gold', 'gray', 'green', 'grey', 'orange', 'pink', 'purple', 'red', 'silver', 'tan', 'teal', 'white', 'yellow') then 'color'
  when regexp_full_match(a.answer, '[$€£]?[+-]?[0-9][0-9,.]*(:[0-9]+|%|\s*percent|\s*percentage)?') then 'number'
  when regexp_full_match(a.answer, '[0-9]{{1,2}}:[0-9]{{2}}\s*(am|pm)') then 'time'
  when contains(a.answer, ' ') then 'phrase' else 'word' end kind from a0)"""
_PART = "(select {0}, list(answer) pool from (select *, row_number() over (partition by {0} order by sha256('pool' || chr(0) || answer)) n from (select distinct {0}, answer from a)) where n <= 512 group by {0})"
_TASK = f"coalesce(lower({_t('task_type')}), '')"
_LEVEL = "regexp_extract(target.ids[1], '([^_]*)$', 1)"
_V = f"""e as (select *, coalesce(lower({_t('split')}), '') s, {_TASK} t, coalesce(options, []) o, coalesce(list_transform(options, lambda o: o.id), []) ids, coalesce(target.ids, []) tids from example),
v as (select sample_id, list_filter([
 case when schema_version is null or sample_id is null or group_id is null or source is null or source_version is null or license is null or split is null or task_type is null or state_text is null or question is null or options is null or target_kind is null or target is null or label_origin is null or language is null then 'missing fields' end,
 case when coalesce(schema_version not in (1, 2), true) then 'schema_version' end,
 case when schema_version = 2 and (root_id is null or source_bucket is null or image_metadata is null or allowed_history is null or input_track is null or candidates is null or origin_label_method is null or generator_revision is null or quality is null or teacher_only is null) then 'missing v2 fields' end,
 case when schema_version = 2 and candidates is distinct from options then 'candidates differ from options' end,
 case when schema_version = 2 and teacher_only then 'teacher_only' end,
 case when t not in ('choice', 'noul', 'score') then 'unknown task_type' end,
 case when s not in ('train', 'dev', 'calibration', 'test') then 'unknown split' end,
 case when options is null then 'no list of options' end,
 case when len(list_filter(o, lambda x: coalesce(x.id, '') = '' or coalesce(x.text, '') = '')) > 0 then 'option without id or text' end,
 case when len(list_filter(o, lambda x: x.box is not null and (len(x.box) <> 4 or coalesce(x.box[1] >= x.box[3] or x.box[2] >= x.box[4], true)))) > 0 then 'box without area' end,
 case when len(ids) <> len(list_distinct(ids)) then 'option ids repeat' end,
 case when t in ('choice', 'score') and len(o) < 2 then 'too few options' end,
 case when t in ('choice', 'score') and (len(tids) < 1 or len(list_filter(tids, lambda x: not list_contains(ids, x))) > 0) then 'target is no option' end,
 case when t = 'noul' and len(o) > 0 then 'noul with options' end,
 case when t = 'noul' and target.bool is null then 'noul target is not boolean' end,
 case when label_origin = 'teacher_only' and s <> 'train' then 'teacher label outside train' end], lambda x: x is not null) vs from e)"""

SQL = {
    "answer_kinds": f"with {_ANS} select family, kind, count(*) n, count(distinct answer) answers from a group by all",
    "stable_negatives": f"""with {_ANS}, p0 as {_PART.format('split, kind, family')}, p1 as {_PART.format('split, kind')},
 o as (select sample_id, answer, list_filter(p0.pool, lambda x: x <> answer) o0, list_filter(p1.pool, lambda x: x <> answer) o1 from a join p0 using (split, kind, family) join p1 using (split, kind)),
 c as (select sample_id, answer, case when len(o0) >= 3 then o0 else o1 end o from o)
 select sample_id, answer, array_to_string(list_transform(list_sort(list_transform(o, lambda v: struct_pack(h := sha256(sample_id || chr(0) || v), v := v)))[1:3], lambda s: s.v), '|') negatives from c""",
    "model_input": rf"""with e as (select *, {_TASK} task, {_t("coalesce(state_text, '')")} state from example where sample_id is not null),
 p as (select distinct sample_id, concat_ws(chr(10) || chr(10), 'Task: ' || task, case when state <> '' then 'Visible state: ' || state end,
  case when len(allowed_history) > 0 then 'Completed steps (oldest to newest):' || chr(10) || array_to_string(list_transform(allowed_history, lambda h, i: i || '. ' || to_json(h)), chr(10)) end,
  'Question: ' || coalesce(question, ''),
  case when len(options) > 0 then 'Candidates:' || chr(10) || array_to_string(list_transform(options, lambda o: '- ' || o.id || ': ' || o.text || coalesce('; box_0_1000=[' || array_to_string(list_transform(o.box, lambda v: cast(greatest(0, least(1000, round_even(v * 1000, 0))) as int)), ',') || ']', '')), chr(10)) end,
  case when len(list_filter(options, lambda o: o.box is not null)) > 0 then 'Box coordinates are normalized to 0-1000 as [x1,y1,x2,y2]. Match the referring expression against both the image and each candidate box.' end,
  case when task = 'noul' then 'Return exactly {{"noul":true}} or {{"noul":false}}.'
   when task = 'score' then 'Judge perceptual image quality from blur, noise, exposure, color, compression, and overall appearance. The ordered levels are:' || chr(10) || '1 = very poor: lowest quality, with severe visible degradation' || chr(10) || '2 = poor: below-average quality, with clear degradation' || chr(10) || '3 = fair: middle quality, with noticeable but limited defects' || chr(10) || '4 = good: above-average quality, with only minor defects' || chr(10) || '5 = excellent: highest quality, clean and visually pleasing' || chr(10) || chr(10) || 'Return exactly {{"score":<integer from 1 to 5>}}.'
   else 'Return exactly {{"' || task || '":"<candidate_id>"}}.' end) prompt,
  case when task = 'score' or len(list_filter(options, lambda o: o.box is not null)) > 0 then 576 else 256 end budget from e)
 select sample_id, sha256(prompt) prompt_digest, length(prompt) characters, budget from p""",
    "answer_json": f"""with e as (select *, {_TASK} task from example where sample_id is not null),
 a as (select *, '{{"' || task || '":' || case when task = 'noul' then target.bool::text when task = 'score' then try_cast({_LEVEL} as int)::text else to_json(target.ids[1])::text end || '}}' answer from e)
 select distinct sample_id, answer, case when task = 'noul' then true when task = 'score' then coalesce(try_cast({_LEVEL} as int) between 1 and 5, false) else list_contains(list_transform(coalesce(options, []), lambda o: o.id), target.ids[1]) and task <> '' end "right" from a where answer is not null""",
    "contract_violations": f"with {_V}, u as (select unnest(vs) violation, vs[1] f from v) select violation, count(*) \"rows\", count(*) filter (violation = f) \"first\" from u group by 1",
    "contract_rejects": f"with {_V} select distinct sample_id, vs[1] \"first\" from v where len(vs) > 0 and sample_id is not null",
    "table_violations": f"""with g as (select translate(lower(regexp_replace(group_id, '[\\s\\pZ]+', '', 'g')), '_', '-') g, nullif(lower({_t('split')}), '') s from example), t as (select g from g where g <> '' and s is not null group by 1 having count(distinct s) > 1), i as (select sample_id from example where sample_id is not null group by 1 having count(*) > 1)
 select 'sample_id repeats' violation, count(*) cases from i having count(*) > 0 union all select 'group in several splits', count(*) from t having count(*) > 0""",
}
