"""Stable samples, quota samples and mixes against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import mixing, quota_sample, stable_sample

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_stable_sample_keeps_members(spark):
    data = [(f"k{i}", i // 60 + 1) for i in range(420)] + [(f"k{i}", 7) for i in range(300)] + [(None, 1), ("late", None)]
    plans = rows(spark, [("a", "s1", 60), ("b", "s2", 0), ("c", "s3", 5000), ("n", "s4", None)], "plan_id string, seed string, size int")
    kept = set()
    for b in (1, 3, 5, 7):
        df = rows(spark, [r for r in data if r[1] is None or r[1] <= b], "sample_id string, ingest_batch int")
        now = {(r.plan_id, r.sample_id) for r in stable_sample.stable_sample(df.repartition(3), plans, intakes=7).collect()}
        assert kept <= now
        kept = now
    keys = {k for k, _ in data if k}
    assert {k for p, k in kept if p == "c"} == keys
    assert 60 <= sum(p == "a" for p, _ in kept) < 120
    assert not any(p in ("b", "n") for p, _ in kept)


def test_stable_sample_of_nothing(spark):
    plans = rows(spark, [("a", "s1", 60)], "plan_id string, seed string, size int")
    assert stable_sample.stable_sample(rows(spark, [], "sample_id string, ingest_batch int"), plans).count() == 0


def test_shortfall_is_reported(spark):
    plans = rows(spark, [("a", "s1", 320), ("all", "s2", 5000), ("n", "s3", None)], "plan_id string, seed string, size int")
    for batch, dated in ((1, 1), (None, 0)):
        df = rows(spark, [(f"k{i}", batch) for i in range(1000)] + [("k1", batch), (None, 1)], "sample_id string, ingest_batch int")
        sample = stable_sample.stable_sample(df, plans)
        got = {r.plan_id: r for r in stable_sample.shortfall(stable_sample.first_seen(df, "sample_id", "ingest_batch"), plans).collect()}
        assert set(got) == {"a", "all", "n"}
        for p, r in got.items():
            assert r.members == sample.where(sample.plan_id == p).count() and r.short == max(0, (r["size"] or 0) - r.members)
            assert (r.supply, r.intakes, r.undated) == (1000, dated, 0 if dated else 1000)
        assert got["a"].short > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 300))
def test_spread_stays_in_bounds(parts, amount):
    least, most = [min(a, c) for _, a, c in parts], [c for _, _, c in parts]
    got = quota_sample.spread(amount, [w for w, _, _ in parts], least, most)
    assert all(a <= x <= b for a, x, b in zip(least, got, most))
    assert sum(got) == max(sum(least), min(amount, sum(most)))


E_SCHEMA = "sample_id string, source string, task_type string, extra int"
MIX = "mixture_id string, total_questions int, minimum_questions_per_category int, public_source_task_quotas map<string,map<string,int>>"


def test_quota_sample(spark):
    data = [
        (f"a{i}", " A-x ", "Choice", i) for i in range(30)
    ] * 2 + [(f"b{i}", "a_X", "noul", i) for i in range(50)] + [(f"c{i}", "c", "choice", i) for i in range(100)]
    data += [(None, "c", "choice", 0), ("u", None, "choice", 0), ("v", "c", " ", 0), ("small", "a x", "score", 1)]
    m = [
        ("m", 150, 2, {"a_x": {"choice": 60, "noul": 10, "score": 1}, "c": {"choice": 70}, "none": {"choice": 9}}), ("e", 10, 1, {}),
        ("n", 5, 1, None)
    ]
    q = quota_sample.QuotaSample(rows(spark, data, E_SCHEMA), rows(spark, m, MIX))
    report = {(r.source, r.task_type): r for r in q.report.collect()}
    assert {k: r.available for k, r in report.items()} == {
        ("a_x", "choice"): 30, ("a_x", "noul"): 50, ("a_x", "score"): 1, ("c", "choice"): 100, ("none", "choice"): 0
    }
    assert {k for k, r in report.items() if r.quota > r.available} == {("a_x", "choice"), ("none", "choice")}
    assert report["a_x", "choice"].drawn == 30 and report["a_x", "score"].drawn == 1 and report["none", "choice"].drawn == 0
    assert report["a_x", "noul"].drawn > 35  # the sibling takes what its source lacks, cousins the rest
    assert sum(r.drawn for r in report.values()) == 150
    drawn = q.drawn.collect()
    assert len(drawn) == len({(r.mixture_id, r.sample_id) for r in drawn}) == 150
    by = {}
    for r in drawn:
        by.setdefault((r.source, r.task_type), set()).add(r.sample_id)
    assert {k: len(v) for k, v in by.items()} == {k: r.drawn for k, r in report.items() if r.drawn}
    pool = sorted((f"c{i}" for i in range(100)), key=lambda k: sha("m\0" + k))
    assert by["c", "choice"] == set(pool[: report["c", "choice"].drawn])


def test_quotas_of_sources_decide_their_amounts(spark):
    data = [(f"{s}{t}{i}", s, t, 0) for s in "abc" for t in ("choice", "noul") for i in range(100)]
    m = [("m", 100, 0, {"a": {"choice": 10, "noul": 10}, "b": {"choice": 20}}, {"a": 60, "b": 20, "c": 20})]
    q = quota_sample.QuotaSample(rows(spark, data, E_SCHEMA), rows(spark, m, MIX + ", public_source_quotas map<string,int>"))
    report = {(r.source, r.task_type): r for r in q.report.collect()}
    assert {k: r.drawn for k, r in report.items()} == {("a", "choice"): 30, ("a", "noul"): 30, ("b", "choice"): 20, ("c", None): 20}
    assert report["c", None].available == 200 and abs(report["a", "noul"].target_share - 0.3) < 1e-9
    drawn = q.drawn.collect()
    assert len({r.sample_id for r in drawn}) == len(drawn) == 100
    assert sum(r.source == "c" for r in drawn) == 20 and all(r.sample_id.startswith(r.source + r.task_type) for r in drawn)


def test_quota_sample_of_nothing(spark):
    q = quota_sample.QuotaSample(rows(spark, [], E_SCHEMA), rows(spark, [("m", 5, 1, {"a": {"choice": 5}})], MIX))
    assert [r.drawn for r in q.report.collect()] == [0] and q.drawn.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mix_matches_ranking(spark, seed):
    rnd = random.Random(seed)
    data = [
        (f"{s}{i}", s.upper() if i % 2 else f" {s}", i) for s, n in (("a", 40), ("b", 7), ("c", 300)) for i in range(n)
    ] * 2 + [(None, "a", 1), ("x", None, 1), ("y", "other", 1)]
    rnd.shuffle(data)
    m = [("m1", 3, 100, {"a": 55, "b": 30, "c": 299}), ("m2", 1, 50, {"a": 40, "b": 8, "zero": 3, "c": 1}), ("m3", None, 9, {"c": 300})]
    mix = mixing.Mix(
        rows(spark, data, "sample_id string, source string, source_bucket int"),
        mixing.budgets_of(
            rows(spark, m, "mixture_id string, maximum_repeats_per_record int, total_questions int, public_source_quotas map<string,int>")
        )
    )
    got = {(r.mixture_id, r.sample_id): r.uses for r in mix.records.collect()}
    want = {}
    for name, repeats, _, quotas in m:
        for s, q in quotas.items():
            keys = sorted({k for k, v, _ in data if k and v and v.strip().lower() == s}, key=sha)
            if keys:
                rounds = min(repeats or 1, q // len(keys))
                more = q % len(keys) if rounds < (repeats or 1) else 0
                for i, k in enumerate(keys):
                    if rounds + (i < more):
                        want[name, k] = rounds + (i < more)
    assert got == want
    report = {(r.mixture_id, r.source): r for r in mix.report.collect()}
    assert report["m1", "b"].short and report["m1", "b"].used == 21 and report["m2", "zero"].used == 0


def test_mix_counts_a_key_in_each_of_its_sources(spark):
    data = [(f"k{i}", "a") for i in range(6)] + [(f"k{i}", " B") for i in range(4)] + [("own", "b"), ("own", "b")]
    budgets = rows(
        spark, [("m", "a", 6, 1, 12), ("m", "b", 5, 1, 12), ("n", "b", 6, 1, 6), ("n", "c", 1, 1, 6)],
        "mixture_id string, source string, budget long, repeats long, total long"
    )
    mix = mixing.Mix(rows(spark, data, "sample_id string, source string"), budgets)
    report = {(r.mixture_id, r.source): r for r in mix.report.collect()}
    assert {k: (r.available, r.short) for k, r in report.items()} == {
        ("m", "a"): (6, False), ("m", "b"): (5, False), ("n", "b"): (5, True), ("n", "c"): (0, True)
    }
    drawn = [(r.mixture_id, r.sample_id) for r in mix.records.collect()]
    assert len(drawn) == len(set(drawn)) == 8 and report["m", "b"].used == 1


def test_mix_by_tokens_stays_within_budget(spark):
    from pyspark.sql import functions as F

    data = [(f"k{i}", "a", i % 9) for i in range(200)]
    budgets = rows(spark, [("m", "a", 333, 1, 400)], "mixture_id string, source string, budget long, repeats long, total long")
    mix = mixing.Mix(rows(spark, data, "sample_id string, source string, tokens int"), budgets, source=F.col("source"), size=F.col("tokens"))
    order = sorted(data, key=lambda r: sha(r[0]))
    total, want = 0, set()
    for k, _, n in order:
        if total + n > 333:
            break
        total += n
        want.add(k)
    got = {r.sample_id for r in mix.records.collect()}
    assert {k for k in want if dict((a, c) for a, _, c in data)[k]} <= got and mix.report.first().used == total
