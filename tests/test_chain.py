"""Decisions, catalogs, recorded predictions and training rows on small fixtures."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import decisions as de
from marlstone.operators import metrics
from marlstone.plans import adapted
from marlstone.sources import catalog as ca

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_decision_tasks(spark):
    data = [(f"s{i}", "st", "dev", ["up", "down", "left"], ["up", "left"][: 1 + i % 2]) for i in range(7)] + [
        ("f0", "st", "dev", ["up"], ["up"]), ("f1", "st", "dev", ["up", "left"], ["up", "left"]), ("o", "st", "test", ["a", "b"], ["a"])
    ]
    df = spark.createDataFrame(data, "sample_id string, stage string, role string, actions array<string>, optimal array<string>")
    quotas = lambda n: spark.createDataFrame([("st", "dev", n)], "stage string, role string, choice int")
    got = {r.sample_id: r for r in de.decision_tasks(df, quotas(4)).collect()}
    order = sorted((r for r in data if r[2] == "dev"), key=lambda r: sha("st\0" + r[0]))
    flexible = [r[0] for r in order if set(r[3]) - set(r[4])]
    assert {k for k, r in got.items() if r.task_type == "choice"} == {"f0", "f1", *flexible[:2]}
    for place, (sid, _, _, actions, best) in enumerate(order):
        r = got[sid]
        wrong = [a for a in actions if a not in best]
        if r.task_type == "noul":
            want = best[place % len(best)] if place % 2 == 0 else wrong[place % len(wrong)]
            assert (r.candidate, r.answer, r.targets) == (want, want in best, None)
        else:
            assert r.targets == best and r.candidate is None
    assert got["o"].task_type == "noul" and got["o"].candidate == "a"
    with pytest.raises(Exception, match="more choices than the quota"):
        de.decision_tasks(df, quotas(1)).collect()
    assert de.decision_tasks(df.limit(0), quotas(1)).count() == 0


def test_decision_query_with_more_forced_choices_than_the_quota(spark, tmp_path):
    shape = "sample_id string, source string, split string, options array<struct<id:string>>, target struct<ids:array<string>>"
    two = [("a",), ("b",)]
    data = [(f"f{i}", "S", "train", [("a",)], (["a"],)) for i in range(23)] + [(f"w{i}", "s", "train", two, (["b"],)) for i in range(300)]
    data += [(f"d{i}", "s", "dev", two, (["a"],)) for i in range(300)]
    spark.createDataFrame(data, shape).write.parquet(str(tmp_path / "example.parquet"))
    got = {r.sample_id: r for r in adapted.decision_tasks(spark, str(tmp_path)).collect()}
    assert len(got) == 623 and {k for k, r in got.items() if r.task_type == "choice" and r.role == "train"} == {f"f{i}" for i in range(23)}
    places = {k: sorted((r[0] for r in data if r[2] == k), key=lambda x: sha("s\0" + x)) for k in ("train", "dev")}
    assert {k for k, r in got.items() if r.task_type == "choice" and r.role == "dev"} == set(places["dev"][:20])
    for split, best in (("train", "b"), ("dev", "a")):
        for place, k in enumerate(places[split]):
            if got[k].task_type == "noul":
                assert got[k].answer == (place % 2 == 0) == (got[k].candidate == best)


def test_stages_and_labels(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("y",)], "k string")
    assert sorted(map(tuple, de.unite({"b": b, "a": a}, {"a", "b"}).select("k", "v", "stage").collect())) == [("x", 1, "a"), ("y", None, "b")]
    with pytest.raises(ValueError):
        de.unite({"a": a}, {"a", "b"})
    q = spark.createDataFrame(
        [
            ('{"oracle_q": {"up": 1.0, "down": 0.5}, "all_optimal_actions": ["up"]}',),
            ('{"policy_success_rates": {"b": 1}, "all_best_measured_actions": ["b"]}',)
        ],
        "q string"
    )
    assert [
        tuple(r) for r in q.select(de.optimal_actions(F.col("q")), de.action_ids(F.col("q"))).collect()
    ] == [(["up"], ["up", "down"]), (["b"], ["b"])]
    with pytest.raises(Exception, match="no optimal"):
        spark.createDataFrame([('{"all_optimal_actions": []}',)], "q string").select(de.optimal_actions(F.col("q"))).collect()
    r = spark.range(1).select(de.by_steps(F.lit(50), 100), de.by_steps(F.lit(999), 100), de.by_hundreds(F.lit(100))).first()
    assert tuple(r) == (pytest.approx(0.55), 0.0, 0.5)
    rows = spark.createDataFrame([(f"k{i}",) for i in range(30)], "k string")
    got = {r.k: (r.place, r.label) for r in de.allocated(rows, "k", {"dev": 3, "train": 9}, "s").collect()}
    heads = sorted((f"k{i}" for i in range(30)), key=lambda k: sha("s\0" + k))[:12]
    labels = sorted(enumerate(["dev"] * 3 + ["train"] * 9), key=lambda x: sha(f"s:labels\0{x[0]}:{x[1]}"))
    assert got == {k: (i + 1, labels[i][1]) for i, k in enumerate(heads)}
    jobs = spark.createDataFrame(
        [
            (1, "e", b"p", None), (2, "e", b"p", None), (3, "f", b"p", None), (4, "e", b"q", "timeout"), (5, "e", b"r", None), (6, "e", b"s", None),
            (7, "f", b"t", None)
        ],
        "job int, environment string, picture binary, failed string"
    )
    quotas = spark.createDataFrame([("e", 2), ("f", 5)], "environment string, quota int")
    assert sorted((r.environment, r.job, r.place) for r in de.first_accepted(jobs, quotas).collect()) == [("e", 1, 1), ("e", 5, 2), ("f", 7, 1)]
    assert sorted(map(tuple, de.rejections(jobs).collect())) == [("picture seen before", 2), ("timeout", 1)]
    assert de.choice_quotas({("a", "x"): 3, ("b", "x"): 2, ("b", "y"): 1}, {"a": 3, "b": 2}, {"x": 4, "y": 1})["b", "y"] == 1
    with pytest.raises(ValueError, match="1 choices"):
        de.choice_quotas({("a", "x"): 3}, {"a": 3}, {"x": 4})
    assert [tuple(r) for r in de.repeated_states(jobs, "picture").collect()] == [(b"p", 3)]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        json.dumps(
            {
                "sources": [
                    {"id": "b", "name": "B", "priority": 2}, {"id": "a", "name": "A", "priority": 2, "enabled": True},
                    {"id": "c", "name": "C", "priority": 1, "enabled": False}, {"id": "d", "name": "D"}
                ]
            },
            indent=2
        )
    )
    c = ca.catalog(spark, str(tmp_path / "c.json"))
    assert [r.id for r in ca.active(c).collect()] == ["a", "b", "d"]
    (tmp_path / "twice.json").write_text('{"sources": [{"id": "a"}, {"id": "a"}]}')
    with pytest.raises(ValueError, match="more than once"):
        ca.catalog(spark, str(tmp_path / "twice.json"))
    states = tmp_path / "states"
    states.mkdir()
    (states / "a.json").write_text('{\n"source": "a", "artifacts": [{"path": "x", "bytes": 3},\n {"path": "y", "bytes": 4}]}')
    (states / "z.json").write_text('{"source": "z"}')
    inv = ca.inventory(spark, str(states))
    assert sorted(map(tuple, inv.collect())) == [("a", 2, 7), ("z", 0, 0)] and sorted(r.id for r in ca.absent(c, inv).collect()) == ["b", "c", "d"]
    files = spark.createDataFrame([("x", 3, "h"), ("y", 5, "h"), ("w", 1, "k")], "path string, length long, sha256 string")
    listed = spark.createDataFrame([("x", 3, "h"), ("y", 4, "h"), ("w", 1, "h"), ("v", 1, "h")], "path string, bytes long, sha256 string")
    assert sorted(map(tuple, ca.unlike(files, listed).collect())) == [("v", "missing"), ("w", "digest"), ("y", "length")]
    names = spark.createDataFrame([("a/train-1.parquet",), ("train/val.parquet",), ("x/test_2",), (None,)], "p string")
    assert [r[0] for r in names.select(ca.split_of_file(F.col("p"))).collect()][:3] == ["train", "dev", None]
    texts = spark.createDataFrame([("[{'a': None, 'b': (1, 2)}]",), ("import os",), (None,)], "t string")
    assert [r[0] for r in texts.select(ca.literal_json("t")).collect()] == ['[{"a": null, "b": [1, 2]}]', None, None]


def test_predictions_and_rows(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"sample_id": "a", "ok": true}\n\n{"sample_id": "b", "ok": false}\n')
    p = ca.recorded(spark, str(tmp_path / "p.jsonl"), "sample_id string, ok boolean")
    m = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "sample_id string, source string")
    assert sorted(map(tuple, ca.matched(p, m, ["source"]).select("sample_id", "source").collect())) == [("a", "s1"), ("b", "s2")]
    with pytest.raises(Exception, match="not in the manifest: b"):
        ca.matched(p, m.where("sample_id != 'b'"), ["source"]).collect()
    (tmp_path / "d.jsonl").write_text('{"sample_id": "a"}\n{"sample_id": "a"}\n')
    with pytest.raises(ValueError, match="more than once"):
        ca.recorded(spark, str(tmp_path / "d.jsonl"), "sample_id string")
    rows = spark.createDataFrame(
        [(f"k{i}", "train" if i < 20 else None if i < 25 else "dev", "ab"[i % 2], ["score", "noul"][i % 2]) for i in range(40)],
        "sample_id string, role string, source string, task_type string"
    )
    got = ca.training_rows(rows, "s", "train", ["a"], 8, {"score": 3, "noul": 0}).orderBy("rank", "copy").collect()
    heads = sorted((f"k{i}" for i in range(0, 25, 2)), key=lambda k: sha("s\0" + k))[:8]
    assert [r.sample_id for r in got] == [k for k in heads for _ in range(3)]
    one, two = ([r.sample_id for r in ca.epoch_order(rows, "s", e).collect()] for e in (1, 2))
    assert one == sorted(one, key=lambda k: sha("s:1\0" + k)) and one != two and sorted(one) == sorted(two)
    turns = spark.createDataFrame([("d", 0), ("d", 1), ("d", 5), ("d", -1), ("e", 0)], "demo string, turn int")
    replays = spark.createDataFrame([("d", [("valid", "x"), ("bad", "y")])], "demo string, events array<struct<status:string,what:string>>")
    assert [(r.turn, r.event.what) for r in ca.at_turn(turns, replays).collect()] == [(0, "x")]
    good = {
        "epochs": 1, "microbatch_questions_per_device": 2, "gradient_accumulation_steps": 4, "expected_world_size": 8, "global_batch_questions": 64
    }
    assert ca.config_errors(good, 8) == [] and len(ca.config_errors({**good, "epochs": 0, "checkpoint_every_steps": -1}, 4)) == 4
    models = [{"id": "a", "group": "g", "role": "x"}, {"id": "b", "group": "g", "role": "y"}, {"id": "a", "group": "h", "role": "x"}]
    assert ca.group_errors(models, {"x", "y"}) == ["id a repeats", "group h has the roles ['x']"]


def test_losses_and_rates(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], [True, False, True]), ([1.0, 0.0], [False, True])], "p array<double>, v array<boolean>")
    got = [r[0] for r in df.select(metrics.choice_set_loss(F.col("p"), F.col("v"))).collect()]
    assert got == [pytest.approx(0.6931471805599453), pytest.approx(27.631021115928547)]
    with pytest.raises(Exception, match="no valid target"):
        spark.createDataFrame([([1.0], [False])], df.schema).select(metrics.choice_set_loss(F.col("p"), F.col("v"))).collect()
    g = spark.createDataFrame(
        [("t", '{ "a": 1 }', '{"a":1}'), ("t", '{"a":2}', '{"a":1}'), ("t", "[1]", '{"a":1}'), ("t", "oops", '{"a":1}'), ("t", None, '{"a":1}')],
        "task string, raw string, answer string"
    )
    (r,) = metrics.generation_rates(g, ["task"]).collect()
    assert tuple(r) == ("t", 5, 0.4, 0.2)


def test_brier_and_gate(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], [0, 1]), ([1.0, 0.0, 0.0], [0]), ([0.2, 0.8], [0, 0])], "p array<double>, t array<int>")
    assert [r[0] for r in df.select(metrics.brier_any(F.col("p"), F.col("t"))).collect()] == [pytest.approx(0.08), 0.0, pytest.approx(1.28)]
    s = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.9, 0.4), ("c", None, 0.9)], "model string, exact double, within double")
    assert {
        r.model: (r.exact_ok, r.passed) for r in metrics.gate(s, {"exact": 0.9, "within": 0.5}).collect()
    } == {"a": (True, True), "b": (True, False), "c": (False, False)}
