"""Role manifests against a plain sequential statement, prompts and judged answers, and the row contract."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import contract, prompts, roles

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
Q = "sample_id string, root_id string, group_id string, source string, task_type string, extra int"
PLAN = "plan_id string, seed string, roles array<struct<key:string,value:struct<schema_split:string,questions:int,choice:int,noul:int,score:int>>>, selection struct<maximum_train_share_per_source:double>"


def sequential(pool, trained, seed, plan, share):
    """One plan, one question after another."""
    ids, roots, groups = ({r[i] for r in trained} for i in range(3))
    free = [r for r in pool if r[0] not in ids and r[1] not in roots and r[2] not in groups]
    owner, taken, out = {}, set(), {}
    tests = [r for r in plan if r != "train"]
    for role in [*tests, "train"]:
        used = {}
        for task in ("score", "noul", "choice"):
            want = plan[role][task]
            limit = max(1, want if role == "train" else sum(plan[t][task] for t in tests))
            queues = {}
            for s in {r[3] for r in pool + trained}:
                mine = [r for r in (trained if role == "train" else free) if r[3] == s and r[4] == task]
                mine = sorted(mine, key=lambda r: sha(f"{seed}:{role}:{task}:{s}\0{r[0]}"))[:limit]
                queues[s] = sorted(mine, key=lambda r: sha(f"rlcd:{role}:{task}\0{r[0]}"))
            got, moved = [], True
            while len(got) < want and moved:
                moved = False
                for s in sorted(queues, key=lambda s: sha(f"rlcd:{role}:{task}:sources\0{s}")):
                    if len(got) == want or role == "train" and used.get(s, 0) >= math.ceil(plan[role]["questions"] * share):
                        continue
                    while queues[s]:
                        r = queues[s].pop(0)
                        if r[0] in taken or owner.get(r[2], role) != role:
                            continue
                        got.append(r[0])
                        taken.add(r[0])
                        owner[r[2]] = role
                        used[s] = used.get(s, 0) + 1
                        moved = True
                        break
            out[role, task] = got
    return out


def test_role_manifest(spark):
    rnd = random.Random(2)
    pool = [
        (
            f"s{i}", f"r{rnd.randrange(300)}", f"g{rnd.choice([0, rnd.randrange(150)])}", rnd.choice("aaab") + "x",
            rnd.choice(["choice", "choice", "noul", "score"]), 0
        ) for i in range(500)
    ]
    trained = rnd.sample(pool, 160)
    one = lambda split, c, n, s: {"schema_split": split, "questions": c + n + s, "choice": c, "noul": n, "score": s}
    plan = {"train": one("train", 20, 8, 6), "dev": one("dev", 9, 3, 2), "audit": one("calibration", 6, 2, 1), "test": one("test", 12, 4, 3)}
    big = {"dev": one("dev", 900, 3, 2), "train": one("train", 5, 5, 5)}
    listed = [("p", "seed", list(plan.items()), (0.6,)), ("big", "z", list(big.items()), (0.3,)), (None, "z", list(big.items()), (0.3,))]
    # entries, as a dict would lose the order of the roles on its way
    plans = spark.createDataFrame(listed, PLAN).withColumn("roles", F.map_from_entries("roles"))
    q, t = spark.createDataFrame(pool, Q), spark.createDataFrame(trained, Q)
    found = roles.role_manifest(q, t, plans).collect()
    for name, seed, p, share in (("p", "seed", plan, 0.6), ("big", "z", big, 0.3)):
        want = sequential(pool, trained, seed, p, share)
        got = {}
        for r in found:
            if r.plan_id == name and r.sample_id:
                got.setdefault((r.role, r.task_type), set()).add(r.sample_id)
        assert {k: set(v) for k, v in want.items() if v} == got
        short = {(r.role, r.task_type): r.short for r in found if r.plan_id == name and r.short}
        assert short == {k: p[k[0]][k[1]] - len(v) for k, v in want.items() if p[k[0]][k[1]] > len(v)}
    m = roles.role_manifest(q, t, plans.where("plan_id = 'p'"))
    assert all(r.cases == 0 for r in roles.role_leakage(m, t).collect())
    with pytest.raises(ValueError, match="too few"):
        roles.role_manifest(q, t, plans.where("plan_id = 'big'"), strict=True)
    # rows that leak are counted
    bad = {
        r.check: r.cases for r in roles.role_leakage(
            t.selectExpr("'p' as plan_id", "'test' as role", "sample_id", "root_id", "group_id").limit(1), t
        ).collect()
    }
    assert bad["evaluation roots trained on"] == bad["evaluation groups trained on"] == 1
    empty = roles.role_manifest(q.limit(0), t.limit(0), plans.where("plan_id = 'p'")).collect()
    assert all(r.sample_id is None for r in empty) and sum(r.short for r in empty) == sum(r["questions"] for r in plan.values())


def test_roles_are_dealt_step_by_step():
    step = lambda turn, role, ids, wanted=2: [
        dict(plan_id="p", turn=turn, no=1, role=role, schema_split=role, task_type="score", wanted=wanted, cap=None)
    ] + [dict(plan_id="p", turn=turn, no=1, source="s", sample_id=i, root_id=i, group_id="g" + i) for i in ids]
    steps = [step(0, "dev", "ab"), step(1, "test", []), step(2, "audit", "bc"), step(3, "test", "defgh")]
    rows, read = [{c: r.get(c) for c in roles.FEED} for x in steps for r in x], []
    fields = [(c, pa.int64() if c in ("turn", "no", "wanted", "cap") else pa.string()) for c in roles.FEED]

    def batches():
        for i in range(0, len(rows), 2):
            read.append(i)
            yield pa.RecordBatch.from_pylist(rows[i : i + 2], pa.schema(fields))

    found = roles.dealt(batches())
    # a step is given out before the rows of the step after next are read
    assert [r["sample_id"] for r in next(found).to_pylist()] == ["a", "b"] and len(read) == 2
    rest = [(r["role"], r["sample_id"], r["short"]) for b in found for r in b.to_pylist()]
    assert rest == [("test", None, 2), ("audit", "c", 0), ("audit", None, 1), ("test", "d", 0), ("test", "e", 0)]


O = "array<struct<id:string,text:string,box:array<double>>>"


def test_prompts(spark):
    data = [
        ("choice", " a state ", ['say "hi"', "é\n"], "Q?", [("a", "x", None), ("b", "y", [10.0, 20.0, 110.0, 60.0])], (None, ["b", "a"])),
        ("noul", None, [], "Q", [], (True, [])), ("score", "", None, None, [("score_1", "l", None)], (None, ["score_4"])),
        ("choice", "", [], "Q", [], (None, []))
    ]
    df = spark.createDataFrame(data, f"t string, s string, h array<string>, q string, o {O}, g struct<bool:boolean,ids:array<string>>")
    c = F.col
    got = df.select(
        prompts.prompt(c("t"), c("s"), c("h"), c("q"), c("o"), F.lit(200.0), F.lit(100.0)).alias("p"), prompts.answer_json(c("t"), c("g")).alias("a")
    ).collect()
    assert got[0].p == 'Task: choice\n\nVisible state: a state\n\nCompleted steps (oldest to newest):\n1. "say \\"hi\\""\n2. "é\\n"\n\nQuestion: Q?\n\nCandidates:\n- a: x\n- b: y; box_0_1000=[50,200,550,600]\n\n' + prompts.BOXES + '\n\nReturn exactly {"choice":"<candidate_id>"}.'
    assert got[1].p == 'Task: noul\n\nQuestion: Q\n\nReturn exactly {"noul":true} or {"noul":false}.' and "5 = excellent" in got[2].p
    assert [r.a for r in got] == ['{"choice":"b"}', '{"noul":true}', '{"score":4}', None]
    raws = [
        ("choice", '{"choice": "b"}', "b", True), ("choice", '{"choice":"z"}', None, False), ("choice", '{"choice":1}', None, False),
        ("noul", '{"noul":true}', "true", True), ("noul", '{"noul":"true"}', None, False), ("score", '{"score":4}', "score_4", True),
        ("score", '{"score":6}', None, False), ("score", '{"score":"4"}', None, False), ("noul", "no json", None, False), ("noul", None, None, False)
    ]
    known = {r[0]: (r[4], r[5]) for r in data[:3]}
    df = spark.createDataFrame([(t, raw, *known[t]) for t, raw, _, _ in raws], f"t string, r string, o {O}, g struct<bool:boolean,ids:array<string>>")
    v = prompts.generated(c("t"), c("r"), c("o"))
    got = df.select(v.alias("v"), prompts.is_correct(c("t"), v, c("g")).alias("ok"), prompts.is_json_object(c("r")).alias("j")).collect()
    assert [(r.v, r.ok) for r in got] == [x[2:] for x in raws] and [r.j for r in got] == [True] * 8 + [False] * 2
    r = spark.range(1).select(
        prompts.letter(F.lit(0)).alias("a"), prompts.letter(F.lit(25)).alias("z"), prompts.letter(F.lit(26)).alias("n"),
        prompts.cache_key(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b")).alias("k")
    ).first()
    assert (r.a, r.z, r.n) == ("A", "Z", None) and r.k == sha('{"a":"x","b":null}')


def test_contract(spark):
    base = {
        "schema_version": 2, "sample_id": "s", "group_id": "g", "root_id": "r", "source": "s", "source_version": "1", "license": "l",
        "split": "Train ", "task_type": "choice", "state_text": "", "question": "q", "options": [("a", "x", None), ("b", "y", [0.0, 0.0, 1.0, 1.0])],
        "target_kind": "single", "target": (None, ["a"]), "label_origin": "human", "language": "en", "source_bucket": "public",
        "image_metadata": ("none",), "allowed_history": [], "input_track": "t", "origin_label_method": "m", "generator_revision": "c",
        "quality": (False,), "teacher_only": False
    }
    shape = f"schema_version int, sample_id string, group_id string, root_id string, source string, source_version string, license string, split string, task_type string, state_text string, question string, options {O}, target_kind string, target struct<bool:boolean,ids:array<string>>, label_origin string, language string, source_bucket string, image_metadata struct<transform:string>, allowed_history array<string>, input_track string, origin_label_method string, generator_revision string, quality struct<release_blocked:boolean>, teacher_only boolean, candidates {O}"
    box = lambda b: [("a", "x", b), ("b", "y", None)]
    cases = {
        "ok": ({}, None), "missing": ({"license": None}, "missing fields"), "version": ({"schema_version": 3}, "schema_version"), "v2": ({"input_track": None}, "missing v2 fields"), "v1": ({"schema_version": 1, "input_track": None, "candidates": None, "teacher_only": True}, None),
        "cand": ({"candidates": []}, "candidates differ from options"), "teacher": ({"teacher_only": True}, "teacher_only"), "task": ({"task_type": "rank"}, "unknown task_type"), "split": ({"split": "audit"}, "unknown split"), "empty": ({"options": [("", "x", None), ("b", "y", None)], "target": (None, ["b"])}, "option without id or text"),
        "text": ({"options": [("a", None, None), ("b", "y", None)]}, "option without id or text"), "flat": ({"options": box([0.0, 0.0, 0.0, 1.0])}, "box without area"), "short": ({"options": box([0.0, 1.0])}, "box without area"), "twice": ({"options": [("a", "x", None), ("a", "y", None)]}, "option ids repeat"), "few": ({"options": [("a", "x", None)]}, "too few options"),
        "target": ({"target": (None, ["z"])}, "target is no option"), "none": ({"target": (None, [])}, "target is no option"), "noul": ({"task_type": "noul", "target": (True, [])}, "noul with options"), "bool": ({"task_type": "noul", "options": []}, "noul target is not boolean"), "label": ({"label_origin": "teacher_only", "split": "dev"}, "teacher label outside train"),
    }
    names = [f.split()[0].split(":")[0] for f in shape.replace(f" {O}", " x").split(", ") if " " in f]
    data = []
    for k, (change, _) in cases.items():
        row = {**base, **change, "sample_id": k}
        row.setdefault("candidates", row["options"])
        data.append(tuple(row[n] for n in names))
    df = spark.createDataFrame(data, shape)
    got = {r.sample_id: r["first"] for r in contract.violations(df).collect()}
    assert got == {k: v for k, (_, v) in cases.items() if v}
    shown = {r.violation: r.at for r in contract.table_violations(df.unionByName(df.where("sample_id = 'ok'"))).collect()}
    assert shown == {"sample_id repeats": "ok", "group in several splits": "g"}
    assert json.loads(df.select(F.to_json(F.struct(*contract.visible(df).columns))).limit(1).first()[0]).keys() <= set(contract.VISIBLE)
    files = spark.createDataFrame([("a.jpg",)], "path string")
    assert [
        r.image for r in contract.missing_assets(spark.createDataFrame([("a.jpg",), ("b.jpg",), (None,), (" ",)], "image string"), files).collect()
    ] == ["b.jpg"]
