"""Queries that build, split and check manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import byte_mod, digest, prefix_mod, rank
from marlstone.functions.text import spelled
from marlstone.operators import nesting as nest
from marlstone.operators import selection as sel
from marlstone.operators.questions import questions
from marlstone.sources.files import manifest_digest as digest_of
from marlstone.sources.tables import table
from marlstone.streaming.resume import coverage, pending

SEED = "marlstone-1"

TRIM = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_t = TRIM.format
Q = rf"""q as (select sample_id, m.* from (select sample_id, min(struct_pack(ingest_batch := coalesce(ingest_batch, 0), ingested_at := coalesce(ingested_at, timestamp '1970-01-01'),
 source := coalesce(translate(lower({_t('source')}), ' -', '__'), ''), task_type := coalesce(lower({_t('task_type')}), ''), split := coalesce(lower({_t('split')}), ''),
 group_id := coalesce(translate(lower(regexp_replace(group_id, '[\s\pZ]+', '', 'g')), '_', '-'), ''), root_id := coalesce(nullif({_t('root_id')}, ''), sample_id), lang := coalesce(lower({_t('language')}), ''),
 teacher_only := coalesce(teacher_only, false), blocked := coalesce(quality.release_blocked, false), image := coalesce({_t('image')}, ''), question := coalesce({_t('question')}, ''))) m
 from example where sample_id is not null group by sample_id))"""
_REASON = "case when split <> 'train' then 'non_train' when teacher_only then 'teacher_only' when blocked then 'release_blocked' end"
_QUOTA = "quotas as (select mixture_id, unnest(map_keys(public_source_quotas)) source, unnest(map_values(public_source_quotas)) take from sft_117k)"


def _q(s: SparkSession, d: str) -> DataFrame:
    return questions(table(s, d, "example"))


def quota_manifest(s: SparkSession, d: str) -> DataFrame:
    return sel.quota_manifest(_q(s, d), sel.source_quotas(table(s, d, "sft_117k")), SEED)


def exclusion_counts(s: SparkSession, d: str) -> DataFrame:
    return _q(s, d).groupBy("source", F.coalesce(sel.exclusion(), F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shortage_report(s: SparkSession, d: str) -> DataFrame:
    return sel.shortage(_q(s, d), sel.source_quotas(table(s, d, "sft_117k")))


def hash_rank(s: SparkSession, d: str) -> DataFrame:
    q = _q(s, d).select("sample_id", rank(SEED, "sample_id").alias("rank"))
    return q.withColumn("mod_100", prefix_mod(F.col("rank"), 100)).withColumn("byte_10", byte_mod(F.col("rank"), 10))


def argmin_sha(s: SparkSession, d: str) -> DataFrame:
    return _q(s, d).where("source != ''").groupBy("source").agg(F.min_by("sample_id", digest("sample_id")).alias("sample_id"))


def evaluation_roles(s: SparkSession, d: str) -> DataFrame:
    return sel.evaluation_groups(_q(s, d), SEED, 5)


def pilot_quotas(s: SparkSession, d: str) -> DataFrame:
    counts = _q(s, d).where("source != '' and task_type != ''").groupBy("source", "task_type").agg(F.count(F.lit(1)).alias("n"))
    return sel.largest_remainder(counts, ["source", "task_type"], "n", 500)


def pilot_manifest(s: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.ranking import first_by_rank

    ranked = _q(s, d).where("source != '' and task_type != ''").select(
        "source", "task_type", "sample_id", rank(SEED + ":select", "sample_id").alias("rank")
    )
    quota = pilot_quotas(s, d).select("source", "task_type", F.col("quota").alias("take"))
    return first_by_rank(ranked, ["source", "task_type"], quota, tie="sample_id").select("source", "task_type", "sample_id")


def round_robin_manifest(s: SparkSession, d: str) -> DataFrame:
    rows = _q(s, d).where("source != '' and split = 'train' and task_type = 'noul'")
    return sel.round_robin(rows, 300, SEED + ":noul", 90)


def group_leakage(s: SparkSession, d: str) -> DataFrame:
    return sel.leakage(_q(s, d))


def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return _q(s, d).groupBy("source").agg(
        F.count_distinct("group_id").alias("groups"), F.count_distinct("image").alias("images"), F.count_distinct("image", "question").alias("views")
    )


def unused_candidates(s: SparkSession, d: str) -> DataFrame:
    q = _q(s, d)
    return sel.unused(q.where("split = 'test'"), q.where("split = 'train'")).select("sample_id", "source")


def role_by_task(s: SparkSession, d: str) -> DataFrame:
    p = _q(s, d).groupBy("split").pivot("task_type", ["choice", "noul", "score"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


def split_promotion(s: SparkSession, d: str) -> DataFrame:
    q = _q(s, d).where("image != '' and split in ('train', 'dev')")
    return q.groupBy("image").agg(F.max(F.col("split") == "dev").alias("is_dev"), F.count(F.lit(1)).alias("n"))


def first_split_wins(s: SparkSession, d: str) -> DataFrame:
    q = _q(s, d).where("group_id != '' and split != ''")
    first = q.groupBy("group_id").agg(F.min_by("split", F.struct("ingest_batch", "sample_id")).alias("split"))
    return first.groupBy("split").agg(F.count(F.lit(1)).alias("groups"))


def option_order(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "example").where("sample_id is not null and size(options) > 1").select(
        "sample_id", F.transform("options", lambda o: o["id"]).alias("ids")
    ).distinct()
    return e.select(
        "sample_id", F.array_join("ids", ",").alias("given"), F.array_join(nest.hashed_order(F.col("ids"), F.col("sample_id")), ",").alias("ordered")
    )


def permutation_views(s: SparkSession, d: str) -> DataFrame:
    """The canonical view of every training question, and up to three other orders of its options, however many there are."""
    e = table(s, d, "example").where((F.col("sample_id").isNotNull()) & (spelled("split") == "train"))
    e = e.select(
        "sample_id",
        F.transform(F.coalesce("options", F.array().cast("array<struct<id:string,text:string,box:array<double>>>")), lambda o: o["id"]).alias("ids")
    ).distinct()
    orders = F.concat(F.array("ids"), sel.permutations(F.col("ids"), F.col("sample_id"), SEED))
    views = e.select("sample_id", "ids", F.posexplode(orders).alias("n", "o"))
    name = F.when(F.col("n") == 0, "canonical").otherwise(F.concat(F.lit("candidate_permutation_"), F.col("n").cast("string")))
    return views.select(
        F.concat("sample_id", F.lit("::rlcd-view:"), name).alias("view_id"), F.array_join("ids", ",").alias("given"),
        F.array_join("o", ",").alias("ordered")
    )


def box_targets(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "example").where("sample_id is not null and exists(options, o -> o.box is not null)").select("sample_id", "options").distinct()
    return e.select(
        "sample_id", F.size(nest.usable(F.col("options"))).alias("usable"), nest.smallest(F.col("options")).alias("smallest"),
        F.size(nest.at_point(F.col("options"), 0.5, 0.5)).alias("at_centre"),
        F.array_join(
            F.transform(
                F.filter("options", lambda o: o["box"].isNotNull()), lambda o: F.array_join(nest.thousandths(o["box"]).cast("array<string>"), " ")
            ),
            "|"
        ).alias("boxes")
    )


def history_prefix(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gui_step").withColumn("action", nest.normalized("action"))
    return nest.history(g).select("episode_id", "step", "action", F.array_join("history", ">").alias("history"))


def majority_action(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gui_step").where(
        "episode_id is not null and step is not null and action is not null"
    ).select("episode_id", "step", nest.normalized("action").alias("action")).distinct()
    votes = g.groupBy("episode_id", "action").agg(F.count(F.lit(1)).alias("votes"), F.min("step").alias("first"))
    return votes.groupBy("episode_id").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "first", "action")).alias("m"), F.sum("votes").alias("n")
    ).select("episode_id", F.col("m.action").alias("action"), (-F.col("m.v")).alias("votes"), "n")


def _ratings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "image_rating").where("image_name is not null and mos is not null").groupBy("image_name").agg(
        F.min(F.struct("mos", "c1", "c2", "c3", "c4", "c5")).alias("r")
    ).select("image_name", "r.*")


def rating_mode(s: SparkSession, d: str) -> DataFrame:
    r = _ratings(s, d).select(
        "image_name", "mos", F.posexplode(F.array("c1", "c2", "c3", "c4", "c5")).alias("i", "votes")
    ).withColumn("level", F.col("i") + 1)
    best = F.min_by("level", F.struct(-F.coalesce("votes", F.lit(0)), F.abs(F.col("level") - F.col("mos")), "level"))
    return r.groupBy("image_name").agg(best.alias("level"))


def rating_quintiles(s: SparkSession, d: str) -> DataFrame:
    r = _ratings(s, d).withColumn("h", F.sha2(F.concat(F.lit("ratings:"), "image_name"), 256)).withColumn("b", byte_mod(F.col("h"), 10))
    train = r.where("b < 8")
    # the k-th value of n, from counts of distinct values; only values, of which a rating scale has few, are ordered
    seen = train.groupBy("mos").agg(F.count(F.lit(1)).alias("c"))
    run = seen.withColumn("upto", F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("mos"))).withColumn("n", F.sum("c").over(W.partitionBy(F.lit(0))))
    cuts = run.withColumn(
        "q", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))
    ).where("n * q div 5 >= upto - c and n * q div 5 < upto").agg(F.array_sort(F.collect_list("mos")).alias("cuts"))
    out = r.join(F.broadcast(cuts)).withColumn("quintile", F.size(F.filter("cuts", lambda t: t <= F.col("mos"))) + 1)
    return out.groupBy(
        F.when(F.col("b") < 8, "train").when(F.col("b") == 8, "dev").otherwise("test").alias("split"), "quintile"
    ).agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "example").where("sample_id is not null").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("deliveries")
    ).where("deliveries > 1")


def manifest_digest(s: SparkSession, d: str) -> DataFrame:
    return digest_of(quota_manifest(s, d))


def prediction_coverage(s: SparkSession, d: str) -> DataFrame:
    want = _q(s, d).where("split = 'test'")
    return coverage(want, table(s, d, "prediction"), "sample_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def pending_rows(s: SparkSession, d: str) -> DataFrame:
    return pending(_q(s, d).where("split = 'test'"), table(s, d, "prediction"), "sample_id").select("sample_id", "source")


QUERIES = {
    f.__name__: f for f in (
        quota_manifest, exclusion_counts, shortage_report, hash_rank, argmin_sha, evaluation_roles, pilot_quotas, pilot_manifest,
        round_robin_manifest, group_leakage, distinct_counts, unused_candidates, role_by_task, split_promotion, first_split_wins, option_order,
        permutation_views, box_targets, history_prefix, majority_action, rating_mode, rating_quintiles, duplicate_ids, manifest_digest,
        prediction_coverage, pending_rows
    )
}

_N = rf"regexp_replace(lower({_t('{0}')}), '[\s\pZ]+', ' ', 'g')"

SQL = {
    "quota_manifest": f"with {Q}, {_QUOTA}, r as (select mixture_id, source, sample_id, take, row_number() over (partition by mixture_id, source order by sha256('{SEED}:' || source || chr(0) || sample_id)) n from q join quotas using (source) where {_REASON} is null) select mixture_id, source, sample_id, sha256('{SEED}' || chr(0) || sample_id) output_rank from r where n <= take",
    "exclusion_counts": f"with {Q} select source, coalesce({_REASON}, 'eligible') reason, count(*) n from q group by all",
    "shortage_report": f"with {Q}, {_QUOTA}, h as (select source, count(*) n from q where {_REASON} is null group by 1) select mixture_id, source, take quota, coalesce(n, 0) available, greatest(take - coalesce(n, 0), 0) short from quotas left join h using (source)",
    "hash_rank": f"with {Q}, r as (select sample_id, sha256('{SEED}' || chr(0) || sample_id) rank from q) select sample_id, rank, cast(('0x' || substr(rank, 1, 16))::ubigint % 100 as int) mod_100, cast(('0x' || substr(rank, 1, 2))::ubigint % 10 as int) byte_10 from r",
    "argmin_sha": f"with {Q} select source, arg_min(sample_id, sha256(sample_id)) sample_id from q where source <> '' group by 1",
    "evaluation_roles": f"with {Q}, g as (select distinct group_id, sha256('{SEED}:eval' || chr(0) || group_id) h, sha256('{SEED}:train' || chr(0) || group_id) t from q where group_id <> ''), m as (select *, ('0x' || substr(h, 1, 16))::ubigint % 100 < 5 e, min(h) over () lo, max(t) over () hi from g), c as (select *, count(*) filter (e) over () n, count(*) over () al from m) select group_id, case when case when n = 0 then h = lo when n = al then t <> hi else e end then 'eval' else 'train' end role from c",
    "pilot_quotas": f"with {Q}, c as (select source, task_type, count(*) n from q where source <> '' and task_type <> '' group by all), e as (select *, n * 500 / sum(n) over () x from c), f as (select *, floor(x) k, row_number() over (order by round(x - floor(x), 9) desc, source desc, task_type desc) p, 500 - sum(floor(x)) over () l from e) select source, task_type, n, cast(k + case when p <= l then 1 else 0 end as bigint) quota from f",
    "pilot_manifest": f"with {Q}, c as (select source, task_type, count(*) n from q where source <> '' and task_type <> '' group by all), e as (select *, n * 500 / sum(n) over () x from c), f as (select *, floor(x) k, row_number() over (order by round(x - floor(x), 9) desc, source desc, task_type desc) p, 500 - sum(floor(x)) over () l from e), t as (select source, task_type, k + case when p <= l then 1 else 0 end quota from f), r as (select q.source, q.task_type, sample_id, quota, row_number() over (partition by q.source, q.task_type order by sha256('{SEED}:select' || chr(0) || sample_id)) rn from q join t using (source, task_type)) select source, task_type, sample_id from r where rn <= quota",
    "round_robin_manifest": f"with {Q}, r as (select source, sample_id, row_number() over (partition by source order by sha256('{SEED}:noul' || chr(0) || sample_id)) turn from q where source <> '' and split = 'train' and task_type = 'noul') select source, sample_id, cast(turn as int) turn from r where turn <= 90 order by turn, sha256('{SEED}:noul:sources' || chr(0) || source) limit 300",
    "group_leakage": f"with {Q}, g as (select group_id, string_agg(distinct split, '+' order by split) splits, count(distinct split) n from q where group_id <> '' and split <> '' group by 1) select splits, count(*) groups from g where n > 1 group by 1",
    "distinct_counts": f"with {Q} select source, count(distinct group_id) groups, count(distinct image) images, count(distinct (image, question)) views from q group by 1",
    "unused_candidates": f"with {Q}, u as (select * from q where split = 'train') select sample_id, source from q where split = 'test' and sample_id not in (select sample_id from u) and root_id not in (select root_id from u) and group_id not in (select group_id from u where group_id <> '')",
    "role_by_task": f"with {Q} select split, count(*) filter (task_type = 'choice') choice, count(*) filter (task_type = 'noul') noul, count(*) filter (task_type = 'score') score from q group by 1",
    "split_promotion": f"with {Q} select image, bool_or(split = 'dev') is_dev, count(*) n from q where image <> '' and split in ('train', 'dev') group by 1",
    "first_split_wins": f"with {Q}, f as (select group_id, arg_min(split, (ingest_batch, sample_id)) split from q where group_id <> '' and split <> '' group by 1) select split, count(*) \"groups\" from f group by 1",
    "option_order": "with e as (select distinct sample_id, list_transform(options, lambda o: o.id) ids from example where sample_id is not null and len(options) > 1), u as (select sample_id, ids, unnest(ids) i from e) select sample_id, array_to_string(ids, ',') given, string_agg(i, ',' order by sha256(sample_id || ':' || i), i) ordered from u group by sample_id, ids",
    "permutation_views": f"""with e as (select distinct sample_id, list_transform(coalesce(options, []), lambda o: o.id) ids from example where sample_id is not null and lower({_t('split')}) = 'train'), t as (select sample_id, ids, unnest(range(32)) t from e), u as (select *, unnest(ids) i from t),
 o as (select sample_id, ids, t, string_agg(i, ',' order by sha256('{SEED}:' || sample_id || ':' || t || chr(0) || i), i) ordered from u group by all), f as (select sample_id, array_to_string(ids, ',') given, ordered, min(t) t from o group by all),
 v as (select *, row_number() over (partition by sample_id, given order by t) n from f where ordered <> given)
 select sample_id || '::rlcd-view:candidate_permutation_' || n view_id, given, ordered from v where n <= 3 union all select sample_id || '::rlcd-view:canonical', array_to_string(ids, ','), array_to_string(ids, ',') from e""",
    "box_targets": """with e as (select distinct sample_id, options from example where sample_id is not null and len(list_filter(options, lambda o: o.box is not null)) > 0), u as (select sample_id, options, list_filter(options, lambda o: o.box is not null and len(o.box) = 4 and o.box[3] > o.box[1] and o.box[4] > o.box[2]) ok from e)
 select sample_id, cast(len(ok) as int) usable, list_sort(list_transform(ok, lambda o: struct_pack(a := round((o.box[3] - o.box[1]) * (o.box[4] - o.box[2]), 9), id := o.id)))[1].id smallest, cast(len(list_filter(ok, lambda o: 0.5 between o.box[1] and o.box[3] and 0.5 between o.box[2] and o.box[4])) as int) at_centre, array_to_string(list_transform(list_filter(options, lambda o: o.box is not null), lambda o: array_to_string(list_transform(o.box, lambda v: cast(least(1000, greatest(0, round_even(v * 1000, 0))) as int)), ' ')), '|') boxes from u""",
    "history_prefix": rf"with f as (select episode_id, step, min({_N.format('action')}) action from gui_step where episode_id is not null and step is not null group by 1, 2) select episode_id, step, action, coalesce(string_agg(action, '>') over (partition by episode_id order by step rows between unbounded preceding and 1 preceding), '') history from f",
    "majority_action": rf"with g as (select distinct episode_id, step, {_N.format('action')} action from gui_step where episode_id is not null and step is not null and action is not null), v as (select episode_id, action, count(*) votes, min(step) f from g group by all) select episode_id, arg_min(action, (-votes, f, action)) action, max(votes) votes, cast(sum(votes) as bigint) n from v group by 1",
    "rating_mode": "with r as (select image_name, m.* from (select image_name, min(struct_pack(mos := mos, c1 := c1, c2 := c2, c3 := c3, c4 := c4, c5 := c5)) m from image_rating where image_name is not null and mos is not null group by 1)), u as (select image_name, mos, unnest([1, 2, 3, 4, 5]) level, unnest([c1, c2, c3, c4, c5]) votes from r) select image_name, arg_min(level, (-coalesce(votes, 0), abs(level - mos), level)) level from u group by 1",
    "rating_quintiles": "with r as (select image_name, min(struct_pack(mos := mos, c1 := c1, c2 := c2, c3 := c3, c4 := c4, c5 := c5)).mos mos from image_rating where image_name is not null and mos is not null group by 1), s as (select mos, ('0x' || substr(sha256('ratings:' || image_name), 1, 2))::int % 10 b from r), t as (select list_sort(list(mos)) l from s where b < 8), c as (select [l[1 + len(l) * k // 5] for k in [1, 2, 3, 4]] cuts from t) select case when b < 8 then 'train' when b = 8 then 'dev' else 'test' end split, cast(len(list_filter(cuts, lambda x: x <= mos)) + 1 as int) quintile, count(*) n from s, c group by all",
    "duplicate_ids": "select sample_id, count(*) deliveries from example where sample_id is not null group by 1 having count(*) > 1",
    "prediction_coverage": f"with {Q}, w as (select sample_id from q where split = 'test'), p as (select distinct sample_id from prediction where sample_id is not null) select 'missing' side, count(*) n from w where sample_id not in (select sample_id from p) having count(*) > 0 union all select 'extra', count(*) from p where sample_id not in (select sample_id from w) having count(*) > 0",
    "pending_rows": f"with {Q} select sample_id, source from q where split = 'test' and sample_id not in (select sample_id from prediction where sample_id is not null)",
}
