"""Core operators on small fixtures with ties, nulls, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions.hashing import byte_mod, prefix_mod, rank
from marlstone.functions.text import plain_words, spelled_group, spelled_source
from marlstone.operators import grids, metrics, nesting, selection
from marlstone.operators.components import components, join_unique, links
from marlstone.operators.ranking import first_by_rank
from marlstone.sources import files
from marlstone.streaming import resume

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_hashes(spark):
    r = spark.createDataFrame([("é",), (None,)], "k string").select(rank("s", "k").alias("r")).withColumn(
        "m", prefix_mod(F.col("r"), 100)
    ).withColumn("b", byte_mod(F.col("r"), 10)).collect()
    h = sha("s\0é")
    assert tuple(r[0]) == (h, int(h[:16], 16) % 100, int(h[:2], 16) % 10) and tuple(r[1]) == (None, None, None)


def test_spelling(spark):
    df = spark.createDataFrame([("\tA b-C ", " A_b :0 1"), ("  ", "\n"), (None, None)], "s string, g string")
    assert [tuple(r) for r in df.select(spelled_source("s"), spelled_group("g")).collect()] == [("a_b_c", "a-b:01"), (None, None), (None, None)]
    assert plain_words("Qu&amp;#39;É-tе, 图中 A1") == ["qu", "e", "te", "图", "中", "a1"]


def test_first_by_rank_cuts_exactly(spark):
    data = [("hot", f"k{i}") for i in range(5000)] + [("cold", f"k{i}") for i in range(3)] + [(None, "k")]
    rows = spark.createDataFrame(data, "g string, k string").withColumn("rank", rank("s", "k"))
    quota = spark.createDataFrame([("hot", 137), ("cold", 9), ("none", 5), ("zero", 0)], "g string, take int")
    got = first_by_rank(rows, ["g"], quota, tie="k").collect()
    want = set(sorted((f"k{i}" for i in range(5000)), key=lambda k: sha("s\0" + k))[:137])
    assert {r.k for r in got if r.g == "hot"} == want and len(got) == 140


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [
        (f"n{rnd.randrange(200)}", f"n{rnd.randrange(200)}") for _ in range(260)
    ] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"x{i}") for i in range(3000)] + [("a", "a"), (None, "b"), ("n1", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_join_unique_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(4000)] + [("c", 1), (None, 2), ("gone", 3)], "k string, v int")
    t = spark.createDataFrame([("hot", 1), ("c", 2), ("z", 3)], "k string, w int")
    got = join_unique(rows, "k", t, "w", 4003).collect()
    assert len(got) == 4003 and {(r.k, r.w) for r in got} == {("hot", 1), ("c", 2), (None, None), ("gone", None)}
    assert sorted(
        map(
            tuple,
            links(
                spark.createDataFrame([("e", "u1"), ("e", "u2"), ("e", "u3"), ("f", "u1"), (None, "u9")], "e string, u string"), "e", "u", 5
            ).collect()
        )
    ) == [("u1", "u2"), ("u1", "u3")]


def test_roles_are_never_empty(spark):
    q = spark.createDataFrame([(f"g{i}",) for i in range(6)], "group_id string")
    for percent in (0, 100):
        got = {r.group_id: r.role for r in selection.evaluation_groups(q, "s", percent).collect()}
        assert set(got.values()) == {"train", "eval"} and len(got) == 6
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert {r.k: r.quota for r in selection.largest_remainder(c, ["k"], "n", 10).collect()} == {"a": 3, "b": 3, "c": 4}


def test_permutations(spark):
    df = spark.createDataFrame([("s", ["a", "b", "c"]), ("t", ["a"]), ("u", ["a", "b"])], "k string, o array<string>")
    got = {r.k: r.p for r in df.select("k", selection.permutations(F.col("o"), F.col("k"), "seed").alias("p")).collect()}
    tried = [sorted("abc", key=lambda o: sha(f"seed:s:{t}\0{o}")) for t in range(32)]
    assert got["s"] == [list(x) for x in dict.fromkeys(map(tuple, tried)) if x != ("a", "b", "c")][:3]
    assert got["t"] == [] and got["u"] == [["b", "a"]]
    long = [f"o{i}" for i in range(12)]
    (r,) = spark.createDataFrame([("s", long)], "k string, o array<string>").select(
        selection.permutations(F.col("o"), F.col("k"), "seed").alias("p")
    ).collect()
    assert r.p == [sorted(long, key=lambda o: sha(f"seed:s:{t}\0{o}")) for t in range(3)]


def test_nesting(spark):
    df = spark.createDataFrame([("  A  B ",)], "a string")
    assert df.select(nesting.normalized("a")).first()[0] == "a b"
    given = ["cyan", "beige", "3.5%", "12:30", "3:05 pm", "$1,234", "5 percent", "two words", "word", "red\n"]
    kinds = spark.createDataFrame([(x,) for x in given], "a string").select(nesting.answer_kind(F.col("a")))
    assert [r[0] for r in kinds.collect()] == ["color", "word", "number", "number", "time", "number", "number", "phrase", "word", "word"]
    asked = {
        "How many cats?": "count", "WHAT  color is it": "color", "which colour": "color", "Where is it": "location", "why": "reason",
        "what time is it": "time", "how tall is he": "size", "Is it made of wood": "material", "Which one": "which", "do you": "do", "dogs": "other",
        "": "other", "the dog": "animal"
    }
    families = spark.createDataFrame([(x,) for x in asked], "q string").select(nesting.question_family(F.col("q")))
    assert [r[0] for r in families.collect()] == list(asked.values())
    boxes = spark.createDataFrame(
        [([("a", "x", [0.0, 0.0, 1.0, 1.0]), ("b", "y", [0.4, 0.4, 0.6, 0.6]), ("c", "z", None), ("d", "w", [0.5, 0.5, 0.5, 0.9])],)],
        "o array<struct<id:string,text:string,box:array<double>>>"
    )
    o = F.col("o")
    assert tuple(
        boxes.select(nesting.smallest(o), nesting.at_point(o, 0.6, 0.6), nesting.prompt(F.lit(""), F.lit("Q"), F.slice(o, 1, 2))).first()
    ) == ("b", ["a", "b"], "Q\n\n1. x\n2. y")
    steps = spark.createDataFrame(
        [("e", 1, "a"), ("e", 3, None), ("e", 4, "b"), ("e", 1, "a"), (None, 1, "z")], "episode_id string, step int, action string"
    )
    assert [(r.step, r.history) for r in nesting.history(steps).orderBy("step").collect()] == [(1, []), (3, ["a"]), (4, ["a"])]


def test_metrics(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, 1.0, 2.0],)], "x array<double>")
    got = [r[0] for r in df.select(metrics.softmax("x")).collect()]
    assert got[0] == [0.5, 0.5] and sum(got[1]) == pytest.approx(1)
    s = spark.createDataFrame(
        [("t", 0.9, True)] * 3 + [("t", 0.8, False), ("t", 0.8, True), ("u", 0.9, False)], "task_type string, top double, hit boolean"
    )
    assert {r.task_type: (r.threshold, r.accepted) for r in metrics.thresholds(s, 0.8, 2).collect()} == {"t": (0.8, 5), "u": (1.000001, 0)}
    assert {r.task_type: r.ece for r in metrics.calibration_error(s).collect()}["u"] == 0.9
    assert {r.task_type: (r.questions, r.coverage) for r in metrics.thresholds(s, 0.8, 2).collect()} == {"t": (5, 1.0), "u": (1, 0.0)}
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(metrics.sigmoid(F.lit(-800.0))) == 0 and one(metrics.sigmoid(F.lit(0.0))) == 0.5
    assert one(metrics.masked_softmax(arr(1.0, 9.0, 1.0), arr(True, False, True))) == [0.5, 0.0, 0.5]
    with pytest.raises(Exception, match="masked"):
        one(metrics.masked_softmax(arr(1.0), arr(False)))
    o = spark.createDataFrame(
        [([("a", "x"), ("b", "y")], ["b", "a"]), ([("a", "x")], ["z"])], "o array<struct<id:string,text:string>>, t array<string>"
    )
    assert o.where("size(o) = 2").select(metrics.target_indexes(F.col("o"), F.col("t"))).first()[0] == [1, 0]
    with pytest.raises(Exception, match="no such option"):
        o.select(metrics.target_indexes(F.col("o"), F.col("t"))).collect()
    p = spark.createDataFrame(
        [("t", [0.0, 0.0, 5.0], [0, 1]), ("t", [0.0, 0.0, 5.0], [2])], "task_type string, logits array<double>, targets array<int>"
    )
    fit = {r.task_type: r.temperature for r in metrics.temperature_fit(p, tasks=("t", "none")).collect()}
    assert fit["none"] == 1.0 and fit["t"] == 4.0
    lat = spark.createDataFrame(
        [("a", float(v)) for v in [5, 1, 1, 1, 9, 2, 700]] + [("a", None), ("a", float("nan")), ("a", -1.0), ("b", 0.0)], "g string, v double"
    )
    got = {r.g: r for r in metrics.latencies(lat, "g", "v").collect()}
    assert (
        got["a"].n, got["a"].p50, got["a"].p95, got["a"].least, got["a"].most
    ) == (7, 2.0, pytest.approx(492.7), 1.0, 700.0) and got["b"].p99 == 0.0
    runs = spark.createDataFrame([("k", "v", 1.0), ("k", "v", 3.0), ("j", "v", 1.0), ("j", "w", 1.0)], "k string, v string, ms double")
    assert {r.k: (r.value, r.latency) for r in metrics.repeats(runs, "k", "v", "ms").collect()} == {"k": ("v", 2.0), "j": (None, 1.0)}
    roll = spark.createDataFrame(
        [("s", "a", 1.0, True), ("s", "a", 0.0, False), ("s", "b", 0.5, True), ("s", "c", 0.0, False)],
        "state string, action string, result double, success boolean"
    )
    out = {r.action: (r.mean, r.success_rate, r.optimal, r.quality) for r in metrics.outcomes(roll, ["state"]).collect()}
    assert out["a"][:3] == (0.5, 0.5, True) and out["b"][2] and not out["c"][2] and sum(x[3] for x in out.values()) == pytest.approx(1)


def test_grids(spark):
    assert grids.shortest(3, 3, {(1, 1)}, (0, 0), {(2, 2)}) == (4, ["down", "right"])
    assert grids.shortest(3, 1, {(1, 0)}, (0, 0), {(2, 0)}) == (None, [])
    levels = spark.createDataFrame(
        [("a", "#####\n#@$.#\n#####"), ("bad", "##\n#"), ("n", None), ("stuck", "#####\n#.@$#\n#####")], "level_id string, level string"
    )
    got = {r.level_id: (r.moves, r.error is None) for r in grids.solve_levels(levels).collect()}
    assert got == {"a": (1, True), "bad": (None, False), "n": (None, False), "stuck": (None, True)}
    assert grids.solve_boxes("#####\n# . #\n# $ #\n# @ #\n#####")[:2] == (1, ["up"])
    assert grids.solve_boxes("#####\n# @ #\n# $ #\n# . #\n#####")[:2] == (1, ["down"]) and grids.solve_boxes(
        "#######\n#@    #\n# $  .#\n#     #\n#######"
    )[:2] == (4, ["down"])
    # round a box on either side
    assert grids.solve_boxes("#####\n# . #\n#   #\n# $ #\n#   #\n# @ #\n#####")[:2] == (3, ["up"]) and grids.solve_boxes(
        "#######\n#  .  #\n#     #\n#  $  #\n#     #\n#   @ #\n#######"
    )[1] == ["left", "up"]
    wide = "\n".join(["##########", "#@       #", "# $ $ $  #", "#        #", "#    ... #", "#        #", "##########"])
    (row,) = grids.solve_levels(spark.createDataFrame([("w", wide)], "level_id string, level string"), limit=50).collect()
    assert row.moves is None and "50 states" in row.error
    square = {(x, y) for x in range(3) for y in range(3)}
    assert grids.navigate(3, 3, square, {(0, 1)}, {}, (1, 1), 0) == (3, ["left", "right"]) and grids.navigate(
        3, 1, {(0, 0), (2, 0)}, {(2, 0)}, {(1, 0): 0}, (0, 0), 0
    ) == (3, ["toggle"])
    assert grids.navigate(
        3, 1, {(0, 0), (2, 0)}, {(2, 0)}, {}, (0, 0), 0
    ) == (None, []) and grids.navigate(3, 3, square, {(1, 1)}, {}, (1, 1), 0) == (0, [])
    with pytest.raises(grids.LimitReached):
        grids.navigate(3, 3, square, {(9, 9)}, {}, (1, 1), 0, limit=5)
    ring = {(x, y) for x in range(-1, 5) for y in (-1, 1)} | {(-1, 0), (4, 0)}
    key, door = {(1, 0): ("key", "red", "")}, {(2, 0): ("door", "red", "locked")}
    tools = lambda things, mission, **k: grids.use_tools(ring, {(3, 0)}, things, (0, 0), 0, mission, **k)
    # take the key, walk up to the door, open it, walk through
    assert tools({**key, **door}, "reach") == (5, ["take"]) and tools({**key, **door}, "open") == (3, ["take"])
    assert tools(door, "reach") == (None, []) and tools(door, "open", held=("key", "red")) == (2, ["forward"]) and tools(
        door, "open", held=("key", "blue")
    ) == (None, [])
    assert tools(
        {(2, 0): ("door", "red", "closed")}, "reach"
    ) == (4, ["forward"]) and tools({(2, 0): ("door", "red", "open")}, "reach") == (3, ["forward"])
    # a held ball has to be put down, behind or at once, before the box is taken
    assert tools({(1, 0): ("box", "red", "")}, "take") == (1, ["take"]) and tools(
        {(1, 0): ("box", "red", "")}, "take", held=("ball", "blue")
    )[0] is None
    assert tools({(2, 0): ("box", "red", "")}, "take", held=("ball", "blue"))[0] == 7
    docs = spark.createDataFrame(
        [(1, "x\n┌──┐\n│#@│\n│$.│\n└──┘\ny\n┌─┐\n│ │\n└─┘"), (2, None), (3, "┌─┐"), (None, "┌─┐\n│ │\n└─┘")], "doc_id long, text string"
    )
    drawn = grids.drawn_levels(docs)
    assert [(r.doc_id, r.place, r.level) for r in drawn.orderBy("place").collect()] == [(1, 0, "#@\n$."), (1, 1, " ")]
    assert sorted(map(tuple, grids.tiles(drawn, ("doc_id", "place")).collect())) == [(1, 0, 2, 2, 1, 1, 1, 1), (1, 1, 1, 1, 0, 0, 0, 0)]
    assert sum(grids.flow({"a": 3, "b": 2}, {"x": 4, "y": 2}, {("a", "x"): 3, ("b", "x"): 2, ("b", "y"): 1}).values()) == 5


def test_levels(spark, tmp_path):
    (tmp_path / "l.txt").write_text("; 0\n###\n#@#\n\n; 1\r\n####\r\n#@$#\r\n; 2\n##\n#\n; 3\n#x\n; 4\n")
    got = [(r.level_id, r.level, r.error) for r in files.levels(spark, str(tmp_path / "l.txt")).collect()]
    assert got == [
        ("0", "###\n#@#", None), ("1", "####\n#@$#", None), ("2", "##\n#", "rows of unequal length"), ("3", "#x", "unknown tile"),
        ("4", "", "no rows")
    ]


def test_json_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{\n  "7": {"q": "a"},\n  "8": {\n    "q": null\n  }\n}\n')
    assert sorted((r.key, r.q) for r in files.json_by_key(spark, str(tmp_path / "o.json"), "struct<q:string>").collect()) == [("7", "a"), ("8", None)]
    (tmp_path / "bad.json").write_text('{"7": {"q": "a"')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|parse"):
        files.json_by_key(spark, str(tmp_path / "bad.json"), "struct<q:string>").collect()
    (tmp_path / "a.json").write_text('{"data": [{"x": 1},\n {"x": 2}]}')
    assert [r.x for r in files.json_field(spark, str(tmp_path / "a.json"), "data", "struct<x:int>").collect()] == [1, 2]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "j.jsonl"), "a int").count() == 2
    assert files.digests(spark, str(tmp_path / "j.jsonl")).first()["sha256"] == hashlib.sha256((tmp_path / "j.jsonl").read_bytes()).hexdigest()
    (tmp_path / "c.csv").write_text('a,b\n"x\ny",\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "c.csv")).collect()] == [("x\ny", "")]


def test_publish(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.when(F.col("id") > 3, "é"))
    assert files.manifest_digest(df).first() == files.manifest_digest(df.repartition(7)).first()
    assert files.manifest_digest(df).first() != files.manifest_digest(
        df.unionByName(df.limit(1))
    ).first() and files.manifest_digest(df.limit(0)).first()["rows"] == 0
    out = str(tmp_path / "out")
    assert files.publish(df, out, {"none": df.where("id < 0"), "staged": lambda s: s.where("id is null")}) == 100
    with pytest.raises(FileExistsError):
        files.publish(df, out, {})
    with pytest.raises(ValueError, match="some"):
        files.publish(df, out + "2", {"some": df})
    with pytest.raises(ValueError, match="short"):
        files.publish(df, out + "3", {"fine": df.limit(0), "short": lambda s: s.where("id > 98")}, report=df.selectExpr("count(*) as n"))
    assert spark.read.json(out + "3.report").first()["n"] == 100 and not (tmp_path / "out3").exists() and not (tmp_path / "out3.staging").exists()
    assert {r.check: r.passed for r in spark.read.json(out + "3.checks").collect()} == {"fine": True, "short": False}


def test_negatives(spark):
    data = [(f"s{i}", "train", "word", "f", w) for i, w in enumerate(["a", "b", "c", "d", "a"])] + [
        ("t0", "train", "word", "g", "x"), ("u0", "dev", "word", "f", "a"), ("u1", "dev", "word", "g", "b")
    ]
    df = spark.createDataFrame(data, "sample_id string, split string, kind string, family string, answer string")
    got = {r.sample_id: r.negatives for r in nesting.negatives(df, ["split", "kind", "family"]).collect()}
    assert got["s0"] == sorted("bcd", key=lambda v: sha("s0\0" + v)) and got["t0"] == sorted("abcd", key=lambda v: sha("t0\0" + v))[:3]
    # where the wide pool is small as well there are fewer; answers of other splits never help out
    assert got["u0"] == ["b"] and got["u1"] == ["a"]
    many = spark.createDataFrame([(f"m{i}", "s", "k", "f", f"v{i}") for i in range(700)], df.schema)
    kept = sorted((f"v{i}" for i in range(700)), key=lambda v: sha("pool\0" + v))[:512]
    (pool,) = nesting.pools(many, ["split", "kind", "family"]).collect()
    assert pool.pool == sorted(kept)
    assert nesting.negatives(df.limit(0), ["split", "kind", "family"]).count() == 0


def test_no_pool_moves_with_a_row(spark):
    data = [(f"s{i}", "train", "word", f"f{i % 5}", f"v{i % 40}") for i in range(200)]
    df = spark.createDataFrame(data, "sample_id string, split string, kind string, family string, answer string")
    want = None
    for most in (4096, 0):  # pools broadcast, and joined by shuffle
        n = nesting.negatives(df, ["split", "kind", "family"], most=most)
        got = {r.sample_id: r.negatives for r in n.collect()}
        assert len(got) == 200 and got == (want or got)
        want = got
        plan = n._jdf.queryExecution().optimizedPlan()
        if most:
            moved = [p for p in str(plan.toString()).split("\n") if "RepartitionByExpression" in p]
            below = plan.toString().split("RepartitionByExpression", 1)[1]
            assert moved and "Join" not in below.split("LogicalRDD", 1)[0]
    for k, _, _, f, own in data:
        pool = {v for _, _, _, g, v in data if g == f} - {own}
        assert want[k] == sorted(pool, key=lambda v: sha(f"{k}\0{v}"))[:3]


def test_resume(spark, tmp_path):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert [r.k for r in resume.pending(a, b, "k").where("k is not null").collect()] == [1]
    assert sorted(map(tuple, resume.coverage(a, b, "k").collect())) == [("extra", 3), ("missing", 1)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = datetime(2025, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t)], "k int, t timestamp").write.parquet(src)
    for extra in ([], [(2, t), (3, t)]):
        if extra:
            spark.createDataFrame(extra, "k int, t timestamp").write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, t timestamp").parquet(src)
        resume.append_once(stream, out, str(tmp_path / "cp"), "k", "t", "1 day").awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
