"""SQL of those queries that SQL can state; the others are tested against brute force and round trips."""

from __future__ import annotations

_SOURCE = r"nullif(translate(lower(regexp_replace(source, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), ' -', '__'), '')"
_TASK = r"nullif(lower(regexp_replace(task_type, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), '')"
_SPLIT = r"nullif(lower(regexp_replace(split, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), '')"
_GROUP = r"nullif(translate(lower(regexp_replace(group_id, '[\s\pZ]+', '', 'g')), '_', '-'), '')"

_P1 = """
with keys as (select sample_id, min(ingest_batch) batch, substr(sha256(sample_id), 1, 3) bucket from example where sample_id is not null group by sample_id),
intakes as (select batch intake, row_number() over (order by batch) place from (select distinct batch from keys where batch is not null)),
names as (select lpad(lower(printf('%x', i)), 3, '0') bucket from (select unnest(range(4096)) i)),
ordered as (select plan_id, total_root_questions size, bucket, row_number() over (partition by plan_id order by sha256(seed || chr(0) || bucket)) position from rlcd_72k, names),
n as (select bucket, intake, place, count(*) n from keys join intakes on keys.batch <= intakes.intake group by all),
held as (select plan_id, intake, position, sum(n) over (partition by plan_id, intake order by position) s, ceil(size * least(place, 16) / 16.0) due from ordered join n using (bucket)),
reach as (select plan_id, intake, coalesce(min(case when s >= due then position end), 4096) length from held group by all),
upto as (select plan_id, intake, max(length) over (partition by plan_id order by intake) upto from reach)
"""

SQL: dict[str, str] = {
    "p1_stable_sample": _P1 + "select plan_id, sample_id, bucket, cast(position as int) position, batch first_batch from keys join ordered using (bucket) where position <= (select max(upto) from upto where upto.plan_id = ordered.plan_id)",
    "p1_bucket_list": _P1 + "select plan_id, bucket, cast(position as int) position, min(intake) opened from ordered join upto using (plan_id) where position <= upto group by all",
    "p1_report": _P1
    + """, listed as (select plan_id, bucket from ordered where position <= (select max(upto) from upto where upto.plan_id = ordered.plan_id)),
members as (select plan_id, count(*) members from keys join listed using (bucket) group by 1),
whole as (select count(*) supply, count(*) filter (batch is null) undated, count(distinct batch) intakes from keys)
select plan_id, total_root_questions size, supply, undated, intakes, coalesce(members, 0) members, greatest(total_root_questions - coalesce(members, 0), 0) short from rlcd_72k left join members using (plan_id), whole""",
    "p2_found": f"""
with quotas as (select mixture_id, unnest(map_keys(public_source_task_quotas)) source, unnest(map_values(public_source_task_quotas)) tasks from sft_117k),
entries as (select mixture_id, source, unnest(map_keys(tasks)) task_type, unnest(map_values(tasks)) quota from quotas),
supply as (select {_SOURCE} source, {_TASK} task_type, count(distinct sample_id) n from example group by 1, 2)
select mixture_id, source, task_type from entries left join supply using (source, task_type) where quota > coalesce(n, 0)""",
    "p3_found": f"""
with entries as (select mixture_id, maximum_repeats_per_record m, unnest(map_keys(public_source_quotas)) source, unnest(map_values(public_source_quotas)) quota from public_extension_pilot),
supply as (select {_SOURCE} source, count(distinct sample_id) n from example group by 1)
select mixture_id, source from entries left join supply using (source) where quota > m * coalesce(n, 0)""",
    "p3_report": f"""
with entries as (select mixture_id, maximum_repeats_per_record m, total_questions t, unnest(map_keys(public_source_quotas)) source, unnest(map_values(public_source_quotas)) quota from public_extension_pilot),
supply as (select {_SOURCE} source, count(distinct sample_id) available from example where sample_id is not null group by 1),
drawn as (select source, count(*) n from (select sample_id, min({_SOURCE}) source from example where sample_id is not null and {_SOURCE} in (select source from entries) group by 1) group by 1),
used as (select mixture_id, source, quota, m, t, coalesce(available, 0) available, least(quota, m * coalesce(n, 0)) used from entries left join supply using (source) left join drawn using (source) where quota > 0)
select mixture_id, source, cast(quota as bigint) budget, cast(m as bigint) repeats, available, cast(used as bigint) used, quota / greatest(t, 1) target_share, used / greatest(sum(used) over (partition by mixture_id), 1) actual_share, quota > m * available short from used""",
    "p3_mix": f"""
with entries as (select mixture_id, maximum_repeats_per_record m, unnest(map_keys(public_source_quotas)) source, unnest(map_values(public_source_quotas)) quota from public_extension_pilot),
records as (select sample_id, min({_SOURCE}) source from example where {_SOURCE} is not null group by 1),
ranked as (select *, row_number() over (partition by source order by sha256(sample_id)) rn, count(*) over (partition by source) n from records),
used as (select mixture_id, sample_id, source, least(m, quota // n) + case when quota // n < m and rn <= quota % n then 1 else 0 end uses from entries join ranked using (source))
select mixture_id, sample_id, source, cast(uses as int) uses from used where uses > 0""",
    "p5_found": f"""
with recursive r as (select sample_id, case when trim(root_id) <> '' then root_id end root, {_GROUP} g, {_SPLIT} split from example where sample_id is not null),
u as (select *, coalesce('g:' || g, 'r:' || root, 's:' || sample_id) unit from r),
hubs as (select 'r' kind, root e, min(unit) a from u where root is not null group by root having count(distinct unit) > 1 union all select 's', sample_id, min(unit) from u group by sample_id having count(distinct unit) > 1),
edges as (select distinct a, unit b from u join hubs on kind = 'r' and e = root where a <> unit union select a, unit from u join hubs on kind = 's' and e = sample_id where a <> unit),
ends as (select a, b from edges union select b, a from edges),
reach(node, other) as (select a, a from ends union select reach.node, ends.b from reach join ends on reach.other = ends.a),
label as (select node unit, min(other) component from reach group by node),
units as (select unit, coalesce(component, unit) component, split, g from u left join label using (unit)),
torn as (select component from units group by component having count(distinct split) > 1)
select distinct g group_key from units join torn using (component) where g is not null""",
}
