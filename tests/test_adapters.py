"""Each dataset adapter over a small raw table, against its rules stated in plain Python."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import contract
from marlstone.sources import adapters as ad

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def rows(df):
    assert tuple(df.columns) == ad.CANON
    return {r.sample_id: r for r in df.collect()}


def texts(r):
    return [o.text for o in r.options]


def right(r):
    return next(o.text for o in r.options if [o.id] == r.target.ids)


def open_choice(r, answer, pool):
    """Whether a row is the choice that an answer and its pool come to."""
    wrong = sorted(set(pool) - {answer}, key=lambda v: sha(f"{r.sample_id}\0{v}"))[:3]
    return texts(r) == sorted([answer, *wrong], key=lambda v: sha(f"{r.sample_id}:{v}")) and right(r) == answer


def test_vqav2_and_textvqa(spark):
    q = spark.createDataFrame(
        [(i, 7, f"what is {i}", "train") for i in range(1, 6)] + [(6, 8, "is it?", "val"), (None, 1, "x", "train")],
        "question_id long, image_id long, question string, split string"
    )
    votes = lambda a, n: [(a,)] * n + [("else",)] * (10 - n)
    a = spark.createDataFrame(
        [(1, votes(" Dog ", 9)), (2, votes("cat", 8)), (3, votes("cow", 7)), (4, votes("pig", 10)), (5, votes("hen", 10)), (6, votes("Yes", 10))],
        "question_id long, answers array<struct<answer:string>>"
    )
    got = rows(ad.vqav2(q, a))
    assert set(got) == {f"vqav2:{i}" for i in (1, 2, 4, 5, 6)} and open_choice(got["vqav2:1"], "dog", ["cat", "pig", "hen", "dog"])
    assert got["vqav2:6"].target.bool is True and got["vqav2:6"].options == [] and got["vqav2:6"].split == "dev" and got["vqav2:6"].image.endswith(
        "/COCO_val2014_000000000008.jpg"
    )
    assert json.loads(got["vqav2:2"].quality) == {"answer_agreement": 8, "minimum_required": 8} and got["vqav2:1"].group_id == "coco:7"
    with pytest.raises(Exception, match="no annotation of question 1"):
        ad.vqav2(q, a.where("question_id > 1")).collect()
    t = spark.createDataFrame(
        [
            (i, "im", f"what is {i}", [w] * 8 + ["q", "r"], "train") for i, w in enumerate(["a", "b", "c"])
        ] + [(9, "im", "what", ["a"] * 7 + ["b"] * 3, "train")],
        "question_id long, image_id string, question string, answers array<string>, split string"
    )
    got = rows(ad.textvqa(t))
    assert len(got) == 3 and open_choice(got["textvqa:0"], "a", "abc") and ad.textvqa(t.limit(0)).count() == 0


def test_gqa_clevr_chartqa(spark):
    g = spark.createDataFrame(
        [
            (f"q{i}", f"what color {i}", c, "77", "train") for i, c in enumerate(["red", "blue", "green", "tan"])
        ] + [("n", "is it", "no", "77", "val"), ("lone", "who", "bob", "1", "val")],
        "key string, question string, answer string, imageId string, split string"
    )
    got = rows(ad.gqa(g))
    assert open_choice(got["gqa:q0"], "red", ["red", "blue", "green", "tan"]) and got["gqa:n"].target.bool is False
    # the only other answer of its split and kind
    assert texts(got["gqa:lone"]) in (["bob", "no"], ["no", "bob"])
    c = spark.createDataFrame(
        [
            (1, "a.png", "q", "cube", [("scene",), ("query_shape",)], "train"), (2, "a.png", "q", "ball", [("query_shape",)], "train"),
            (3, "b.png", "q", "red", [("query_color",)], "train"), (4, "b.png", "q", "yes", None, "val")
        ],
        "question_index long, image_filename string, question string, answer string, program array<struct<function:string>>, split string"
    )
    got = rows(ad.clevr(c))
    assert set(got) == {"clevr:train:1", "clevr:train:2", "clevr:val:4"} and sorted(texts(got["clevr:train:1"])) == ["ball", "cube"]
    h = spark.createDataFrame(
        [
            ("train-0", 0, b"p", "how many", "3", "i", "human"), ("train-0", 1, b"q", "how many", "4", "i", "machine"),
            ("val-0", 0, b"p", "how many", "5", "i", None), ("val-0", 1, b"r", "how many", "6", "j", "Human"),
            ("test-0", 0, b"p", "how many", "7", "i", "human")
        ],
        "file string, row int, image binary, query string, label string, imgname string, type string"
    )
    got = {r.question + r.evidence_reference + right(r): r for r in ad.chartqa(h).collect()}
    first = next(r for k, r in got.items() if k.endswith("row:03"))
    # the picture stands in a dev file, so the train row is dev and looks its negatives up in the dev pool
    assert len(got) == 4 and first.split == "dev" and open_choice(
        first, "3", ["5", "6"]
    ) and first.group_id == "chartqa-image:" + hashlib.sha256(b"p").hexdigest()
    assert first.sample_id == "chartqa:" + sha("train-0\x000\0i\0how many\x003")[:20] and {
        r.label_origin for r in got.values()
    } == {"human", "programmatic"}


def test_mnli_nlvr(spark):
    m = spark.createDataFrame(
        [
            ("x/train-0.parquet", 0, "1e", "p", "h", 2), ("x/val.parquet", 0, "1e", "p", "h", 2), ("x/val.parquet", 1, "2n", "p", "h", 1),
            ("x/val.parquet", 2, "3n", "p", "h", -1)
        ],
        "file string, row int, pairID string, premise string, hypothesis string, label int"
    )
    got = rows(ad.mnli(m))
    assert set(got) == {
        "mnli:train-0:0:1e", "mnli:val:1:2n"
    } and right(got["mnli:train-0:0:1e"]) == "contradiction" and got["mnli:val:1:2n"].split == "dev"
    n = spark.createDataFrame(
        [("12-0", "3", "There is one.", "True", "train"), ("13-1", "4", "None.", "false", "dev")],
        "identifier string, directory string, sentence string, label string, split string"
    )
    got = rows(ad.nlvr(n))
    assert len(got) == 12 and got["nlvr:train:12-0:5"].image == "images/train/images/3/train-12-0-5.png" and got["nlvr:train:12-0:5"].target.bool and not got["nlvr:dev:13-1:0"].target.bool and len(
        {r.group_id for r in got.values()}
    ) == 2


def test_visual7w_scienceqa(spark):
    boxes = spark.createDataFrame([(i, i, 2, 3, 4) for i in range(1, 6)] + [(6, 0, 0, 0, 4)], "box_id int, x int, y int, width int, height int")
    im = "image_id int, filename string, split string, qa_pairs array<struct<qa_id:int,question:string,answer:int,multiple_choices:array<int>,type:string>>"
    i = spark.createDataFrame(
        [
            (
                9, "v7w_9.jpg", "val",
                [(1, "Which?", 3, [1, 2, 4], "which"), (2, "Which?", 3, [3, 2, 4], "which"), (3, "W", 3, [1, 2, 6], None), (4, "W", 3, [1, 2], None)]
            ),
            (8, "f", "other", [(5, "W", 3, [1, 2, 4], None)])
        ],
        im
    )
    got = rows(ad.visual7w(i, boxes))
    r = got["visual7w:1"]
    assert set(got) == {"visual7w:1"} and [o.id for o in r.options] == [
        f"box_{b}" for b in sorted([3, 1, 2, 4], key=lambda v: sha(f"visual7w:1:{v}"))
    ] and r.target.ids == ["box_3"] and r.split == "dev"
    assert next(o.box for o in r.options if o.id == "box_3") == [3.0, 2.0, 6.0, 6.0]
    with pytest.raises(Exception, match="no box"):
        ad.visual7w(i, boxes.where("box_id != 4")).collect()
    s = spark.createDataFrame(
        [
            ("11", "Q", None, "image.png", "train", ["x", "y", "z"], 1), ("12", "Q", "h", None, "train", ["x", "y"], 0),
            ("13", "Q", "h", "i", "minitest", ["x", "y"], 0), ("14", "Q", "h", "i", "test", ["x", "y"], 2), ("15", "Q", "h", "i", "val", ["x"], 0)
        ],
        "key string, question string, hint string, image string, split string, choices array<string>, answer int"
    ).withColumn("grade", F.lit("g")).withColumn("subject", F.lit("s")).withColumn("category", F.lit(None).cast("string"))
    got = rows(ad.scienceqa(s))
    r = got["scienceqa:11"]
    assert set(got) == {"scienceqa:11"} and right(r) == "y" and [o.id for o in r.options] == [
        f"choice_{k}" for k in sorted(range(3), key=lambda v: sha(f"scienceqa:11:{v}"))
    ] and r.image == "images/train_images/train/11/image.png"
    assert json.loads(r.quality) == {"grade": "g", "subject": "s", "category": None}


def test_gui_odyssey_koniq(spark):
    steps = [
        ("e", 0, "CLICK", "[[885, 87]]"), ("e", 1, "text", "Hello  World"), ("e", 2, "SCROLL", "[[1,2],[3,4]]"), ("e", 3, "COMPLETE", None),
        ("e", 3, "COMPLETE", None), ("e", 4, "CLICK", "HOME"), (None, 1, "CLICK", None)
    ]
    g = spark.createDataFrame(
        [(e, s, "im", a, i, "do it", ["x"]) for e, s, a, i in steps],
        "episode_id string, step int, image string, action string, info string, instruction string, history array<string>"
    )
    got = rows(ad.gui_odyssey(g))
    pool = ["click (885,87)", "type hello world", "scroll (1,2)->(3,4)", "complete", "click home"]
    assert len(got) == 5 and all(
        open_choice(got[f"gui-odyssey:e:{i}"], pool[i], pool) for i in range(5)
    ) and got["gui-odyssey:e:0"].allowed_history == ["x"]
    data = [(f"{i}.jpg", 1, 2, 3, 2, 1, 9, 1 + i * 0.1, 0.5, 0.0) for i in range(40)]
    k = spark.createDataFrame(
        data + data[:3] + [("null.jpg", 1, 1, 1, 1, 1, 5, None, None, None)],
        "image_name string, c1 int, c2 int, c3 int, c4 int, c5 int, c_total int, mos double, sd double, mos_zscore double"
    )
    got = rows(ad.koniq10k(k))
    split = lambda n: (lambda b: "train" if b < 8 else "dev" if b == 8 else "test")(hashlib.sha256(f"koniq10k:{n}".encode()).digest()[0] % 10)
    train = sorted(d[7] for d in data if split(d[0]) == "train")
    cuts = [train[len(train) * q // 5] for q in range(1, 5)]
    assert len(got) == 40
    for d in data:
        r = got["koniq10k:" + d[0][:-4]]
        assert r.split == split(d[0]) and r.target.ids == [
            f"score_{sum(c <= d[7] for c in cuts) + 1}"
        ] and json.loads(r.quality)["upstream_mode"] == 3
    assert ad.koniq10k(k.limit(0)).count() == 0


def test_refcoco_mind2web(spark):
    r = [
        ("refcoco", "train", 1, 10, "im1", "a/COCO_1.jpg", [0.0, 0.0, 2.0, 2.0], [(1, "left"), (2, "the left one")]),
        ("refcocog", "validation", 2, 11, "im1", "a/COCO_1.jpg", [1.0, 1.0, 3.0, 3.0], [(3, "right")]),
        ("refcoco", "train", 3, 12, "im2", "b.jpg", [0.0, 0.0, 2.0, 2.0], [(4, "lone")]),
        ("refcoco", "train", 4, 13, "im1", "a/COCO_1.jpg", [5.0, 1.0, 3.0, 3.0], [(5, "flat")]),
        ("refcoco", "test", 5, 14, "im1", "a", [0.0, 0.0, 9.0, 9.0], [(6, "x")])
    ]
    df = spark.createDataFrame(
        r,
        "dataset string, split string, ref_id int, ann_id int, global_image_id string, image_path string, bbox array<double>, sentences array<struct<sent_id:int,sent:string>>"
    )
    got = rows(ad.refcoco(df))
    assert set(got) == {"refcoco:1:1", "refcoco:1:2", "refcocog:2:3"} and all(
        x.split == "dev" and [o.id for o in x.options] == ["region:10", "region:11"] for x in got.values()
    ) and got["refcoco:1:2"].question == "Which region matches: the left one?" and got["refcoco:1:1"].image == "images/COCO_1.jpg"
    node = lambda i, rect, **a: json.dumps({"tag": "button", "backend_node_id": str(i), "attributes": json.dumps({"bounding_box_rect": rect, **a})})
    neg = [node(100 + i, f"{i},0,5,5", title=f"t{i}") for i in range(40)] + ["{bad", node(7, "0,0,0,5"), node(8, "x")]
    acts = [
        (
            "u1", '{"op": "click"}', [node(1, "0,0,50,50", aria_label=" Go "), node(2, "10,10,20,20")], neg, "w", "t", "task", ["a", "b", "c"], "2",
            100, 100
        ),
        ("u2", '{"op": "HOVER"}', [node(1, "0,0,5,5")], neg, "w", "t", "task", [], "0", 100, 100),
        ("u3", "bad", [node(1, "0,0,5,5")], neg, "w", "t", "task", [], "0", 100, 100),
        ("u4", '{"op": "TYPE"}', [node(1, "0,0,99,99")], neg, "w", "t", "task", [], "0", 100, 100),
        ("u5", '{"op": "TYPE"}', ["{}"], neg, "w", "t", "task", [], "0", 100, 100)
    ]
    df = spark.createDataFrame(
        acts + acts[:1],
        "action_uid string, operation string, pos_candidates array<string>, neg_candidates array<string>, website string, annotation_id string, confirmed_task string, action_reprs array<string>, target_action_index string, width int, height int"
    )
    got = rows(ad.mind2web(df))
    m = got["mind2web:u1"]
    others = sorted(["dom:1", *[f"dom:{100 + i}" for i in range(40)]], key=lambda c: sha(f"u1\0select\0{c}"))[:31]
    assert set(got) == {"mind2web:u1"} and m.target.ids == ["dom:2"] and [o.id for o in m.options] == sorted(
        ["dom:2", *others], key=lambda c: sha(f"u1\0order\0{c}")
    ) and m.allowed_history == ["a", "b"]
    shown = {o.id: o.text for o in m.options}
    assert shown["dom:2"] == "button: button" and shown.get("dom:1", "button: Go") == "button: Go"


def test_android_control_weblinx(spark):
    nodes = [
        (1, True, True, False, 0, 0, 50, 50), (2, True, False, True, 10, 10, 20, 20), (3, False, True, False, 0, 0, 9, 9),
        (2, True, True, False, 10, 10, 30, 30), (4, True, False, False, 0, 0, 40, 40)
    ]
    acts = [
        json.dumps({"action_type": "open_app", "app_name": "secret"}), "bad", json.dumps({"action_type": "click", "x": 15, "y": 15}),
        json.dumps({"action_type": "scroll", "direction": "down"}), json.dumps({"action_type": "wait"})
    ]
    shape = "episode_id long, step int, goal string, actions array<string>, nodes array<struct<unique_id:int,visible:boolean,clickable:boolean,long_clickable:boolean,left:int,top:int,right:int,bottom:int>>, width int, height int"
    s = spark.createDataFrame(
        [(5, i, "goal", acts, nodes, 100, 100) for i in range(5)] + [(6, 2, "g", acts, nodes, 100, 100), (7, 2, "g", acts, nodes, 100, 100)], shape
    )
    got = rows(ad.android_control(s, spark.createDataFrame([(5, "validation"), (6, "test")], "episode_id long, split string")))
    assert set(got) == {f"android-control:5:{i}" for i in (2, 3, 4)}
    r = got["android-control:5:2"]
    # the repeated node keeps its last box; of the two hit, it is the smaller
    assert r.target.ids == ["node:2"] and [o.id for o in r.options][2:4] == [
        "global:scroll:up", "global:scroll:down"
    ] and {o.id for o in r.options[:2]} == {"node:1", "node:2"} and r.split == "dev"
    assert [
        json.loads(h) for h in r.allowed_history
    ] == [
        {"action_type": "open_app"}
    ] and got[
        "android-control:5:3"
    ].target.ids == ["global:scroll:down"] and got["android-control:5:4"].target.ids == ["global:wait"] and r.image == "images/5-0002.png"
    page = "(uid = a1) [[tag]] b [[text]]  Sign  in [[bbox]] x=1 y=2.5 width=30 height=10\n(uid = b2) [[text]]  [[bbox]] x=5 y=5 width=4 height=4 [[x]]\n(uid = c3) [[bbox]] x=5 y=5 width=0 height=4\nno uid"
    t = spark.createDataFrame(
        [("d", 3, " go  there ", page, 17), ("d", 4, " ", page, 18), ("d", 5, "x", page, 19), ("d", 6, "x", page, 20), ("e", 3, "x", page, 21)],
        "demo string, turn int, utterances string, candidates string, row int"
    )
    sel = spark.createDataFrame(
        [
            ("d", 3, "click", "a1", "s.png", 100, 100), ("d", 4, "click", "a1", "s.png", 100, 100), ("d", 5, "click", "zz", "s.png", 100, 100),
            ("d", 6, "click", "a1", "s.png", None, None)
        ],
        "demo string, turn int, intent string, target_uid string, screenshot string, width int, height int"
    )
    got = rows(ad.weblinx(t, sel))
    r = got["weblinx:d:3"]
    assert set(got) == {"weblinx:d:3"} and [(o.id, o.text, o.box) for o in r.options] == [
        ("element:a1", "Sign in", [1.0, 2.5, 31.0, 12.5]), ("element:b2", "visible webpage element", [5.0, 5.0, 9.0, 9.0])
    ] and r.state_text == "go there"


def test_adapted_rows_keep_the_contract(spark):
    g = spark.createDataFrame(
        [(f"q{i}", f"what color {i}", c, "77", "train") for i, c in enumerate(["red", "blue", "green", "tan", "yes"])],
        "key string, question string, answer string, imageId string, split string"
    )
    full = ad.gqa(g).withColumn(
        "image_metadata", F.struct(F.lit("none").alias("transform"))
    ).withColumn("quality", F.struct(F.lit(False).alias("release_blocked")))
    assert contract.violations(full).count() == 0 and contract.table_violations(full).count() == 0
    bad = full.withColumn("options", F.slice("options", 1, 1))
    found = {r["first"] for r in contract.violations(bad).collect()}
    assert found == {
        "candidates differ from options"
    } and "target" not in contract.visible(full).columns and contract.table_violations(full.limit(0)).count() == 1
