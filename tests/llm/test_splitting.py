"""Related records, splits and overlap against brute force on small fixtures."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import group_split, overlap

SCHEMA = "sample_id string, group_id string, root_id string, split string, key string, unit string"


def brute(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[find(a)] = find(b)

    norm = lambda g: "".join(g.split()).lower().replace("_", "-") if g else ""
    for s, g, r, _ in data:
        if s is None:
            continue
        find(("s", s))
        if norm(g):
            join(("s", s), ("g", norm(g)))
        if r and r.strip():
            join(("s", s), ("r", r))
    comp = {}
    for s, g, r, sp in data:
        if s is not None:
            c = comp.setdefault(find(("s", s)), (set(), set(), set()))
            c[0].add(s)
            if norm(g):
                c[1].add(norm(g))
            if sp and sp.strip():
                c[2].add(sp.strip().lower())
    return list(comp.values())


def nearest(sizes, targets):
    """The least total deviation of any assignment of components to splits."""
    want = [round(sum(sizes) * t / sum(targets.values())) for t in targets.values()]
    sums = {(0,) * len(want)}
    for s in sizes:
        sums = {tuple(v + (s if i == j else 0) for j, v in enumerate(x)) for x in sums for i in range(len(want))}
    return min(sum(abs(a - b) for a, b in zip(x, want)) for x in sums)


def test_share_out_is_nearest():
    rnd = random.Random(1)
    missed = 0
    for _ in range(300):
        sizes = [rnd.choice([1, 1, 2, 3, 5, 8, 20, rnd.randrange(1, 60)]) for _ in range(rnd.randrange(1, 9))]
        targets = {n: rnd.randrange(1, 10) for n in rnd.choice(["ab", "abc", "abcd"])}
        counts = {s: sizes.count(s) for s in sizes}
        out = group_split.share_out(counts, targets)
        assert {s: sum(o.get(s, 0) for o in out.values()) for s in counts} == counts
        got = sum(group_split.deviation(out[t], round(sum(sizes) * w / sum(targets.values()))) for t, w in targets.items())
        assert got <= nearest(sizes, targets) + 0.1 * sum(sizes)
        missed += got > nearest(sizes, targets)
    # two splits are dealt exactly; of three and more, an exchange among three at once is seldom needed
    assert missed <= 3


def test_related_matches_union_find(spark):
    rnd = random.Random(5)
    pick = lambda p, n, nulls=0.15: None if rnd.random() < nulls else f"{p}{rnd.randrange(n)}"
    data = [(f"s{rnd.randrange(260)}", pick("G_", 60), pick("r", 240), rnd.choice(["train", " TRAIN", "dev", "test", None, " "])) for _ in range(300)]
    data += [(f"h{i}", "Hub 1" if i % 2 else "hub1", f"h{i}", "train") for i in range(120)] + [
        (None, "x", "y", "dev"), ("alone", " ", "", "dev"), ("alone", None, None, "test")
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)
    found = group_split.Related(df)
    comps = brute(data)
    assert sorted(r.group_key for r in found.split_groups().collect()) == sorted(g for _, gs, sp in comps if len(sp) > 1 for g in gs)
    out, report = found.assign({"p": {"train": 60, "dev": 20, "test": 20}, "q": {"train": 1, "dev": 0}})
    got = {(r.plan_id, r.key): r.split for r in out.collect()}
    keys = set().union(*(c[0] for c in comps))
    assert {k for p, k in got if p == "p"} == keys == {k for p, k in got if p == "q"}
    assert all(len({got["p", k] for k in c[0]}) == 1 for c in comps)
    share = {(r.plan_id, r.split): r.actual_share for r in report.collect()}
    # no assignment of these components is within two per cent of the targets; the nearest one of all is found
    total = len(keys)
    assert sum(
        abs(share["p", t] * total - round(total * w)) for t, w in (("train", 0.6), ("dev", 0.2), ("test", 0.2))
    ) == pytest.approx(nearest([len(c[0]) for c in comps], {"train": 60, "dev": 20, "test": 20})) and share["q", "train"] == 1


def test_related_of_nothing(spark):
    found = group_split.Related(spark.createDataFrame([], SCHEMA))
    assert found.split_groups().count() == 0 and found.assign({"p": {"train": 1, "dev": 1}})[0].count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), max_size=6), st.integers(0, 80))
def test_closest_sum(counts, target):
    got = group_split.closest_sum(counts, target)
    assert all(0 <= k <= counts[s] for s, k in got.items())
    sums = {0}
    for s, c in counts.items():
        sums = {a + s * k for a in sums for k in range(c + 1)}
    best = min(abs(a - target) for a in sums) if target > 0 else target
    if target > 0:
        assert abs(sum(s * k for s, k in got.items()) - target) == best


E = "sample_id string, split string, source string, image string, question string, class string, letters string"


def test_overlap(spark):
    base = "What material would you guess the metallic mailbox resting above the stone fireplace is made from?"
    near = "So, what material would you guess teh metallic mailbox resting above THE stone fireplace was made from"
    other = "What material would you guess the wooden violin resting behind the glass counter is made from?"
    pic, pic2 = "images/gqa/00000000123.jpg", "thumbs\\00000000123-small.JPG"
    data = [
        ("a", "train", "S", pic, base), ("b", "Dev", "s", pic2, near), ("c", " test", "s", pic, other),
        ("d", "test", "t", "images/00000000999.jpg", base), ("e", "calibration", "t", pic, f"  {base.upper()}!! "), ("a", "dev", "s", pic, base)
    ]
    data += [
        ("f", "train", "s", None, base), ("g", "test", "s", " ", near), ("h", "test", "s", "no number", base), ("i", "dev", "s", pic, None),
        ("j", "dev", "s", pic, " "), ("k", "dev", "s", pic, "?!"), (None, "dev", "s", pic, base), ("l", None, "s", pic, base)
    ]
    data += [(f"t{i}", "train", "s", None, f"Unrelated line {i} about {chr(97 + i % 26) * 5} things and {i * 7} others") for i in range(300)]
    data += [
        ("long1", "train", "s", None, "word " * 3 + " ".join(f"w{i}" for i in range(3000))),
        ("long2", "test", "s", None, " ".join(f"w{i}" for i in range(20, 3010)))
    ]
    o = overlap.Overlap(spark.createDataFrame([(*r, "x", "y") for r in data], E))
    got = sorted((r.sample_id_a, r.sample_id_b) for r in o.pairs().collect())
    assert got == [("a", "b"), ("a", "e"), ("f", "g"), ("long1", "long2")]
    report = {(r.split, r.source): (r.questions, r.exact, r.near) for r in o.report().collect()}
    assert report["calibration", "t"] == (1, 1, 0) and report["dev", "s"] == (2, 0, 1) and report["test", "s"] == (3, 0, 2)


def test_overlap_with_errors_in_all_words(spark):
    clean = "read the lettering painted upon the jug name the word that follows harvest"
    # an error in every second word: no two neighbouring words are whole
    typos = "raed the letering painted upn the jgu name teh word tht follows harvets"
    data = [
        ("a", "train", "images/1/00000000123.jpg", clean), ("b", "dev", "images/2/00000000123.jpg", typos),
        ("c", "train", "images/1/00000000123.jpg", "is there a cat")
    ]
    o = overlap.Overlap(spark.createDataFrame([(k, sp, "s", im, q, "x", "y") for k, sp, im, q in data], E))
    assert [tuple(r) for r in o.pairs().collect()] == [("a", "b")]


def test_overlap_does_not_depend_on_the_crowd(spark, monkeypatch):
    rnd = random.Random(11)
    words = "read lettering painted upon jug name word follows harvest every narrow window behind green wooden door counts".split()

    def typos(t, k):
        t = list(t)
        for _ in range(k):
            i = rnd.randrange(len(t) - 1)
            t[i], t[i + 1] = t[i + 1], t[i]
        return "".join(t)

    clean = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 12, 25]))) for _ in range(40)]
    held = clean + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30))) for _ in range(260)]
    asked = [typos(t, len(t) // 8) for t in clean]
    letters = lambda t: t.replace(" ", "")
    same = lambda a, b: overlap.common(letters(a), letters(b)) / max(len(letters(a)), len(letters(b))) >= overlap.AGREE
    want = sorted((f"a{i}", f"b{j}") for i, a in enumerate(asked) for j, b in enumerate(held) if same(a, b))
    assert len(want) >= 40
    data = [
        (f"a{i}", "test", "s", None, t, "x", "y") for i, t in enumerate(asked)
    ] + [(f"b{j}", "train", "s", None, t, "x", "y") for j, t in enumerate(held)]
    df = spark.createDataFrame(data, E)
    for crowd, block in ((1000, 4096), (256, 4096), (0, 20)):
        monkeypatch.setattr(overlap, "CROWD", crowd)
        monkeypatch.setattr(overlap, "BLOCK", block, raising=False)
        assert sorted(tuple(r) for r in overlap.Overlap(df).pairs().collect()) == want


def test_block_pairs_match_brute_force():
    rnd = random.Random(3)

    def changed(t, k):
        t = list(t)
        for _ in range(k):
            if t and rnd.random() < 0.5:
                del t[rnd.randrange(len(t))]
            else:
                t.insert(rnd.randrange(len(t) + 1), rnd.choice("abcdé图🙂"))
        return "".join(t) or "a"

    for _ in range(20):
        base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 3, 20, 63, 64, 65, 130, 300, 1200]))) for _ in range(4)]
        x, y = ([changed(rnd.choice(base), rnd.randrange(60)) for _ in range(n)] for n in (40, 50))
        want = {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if overlap.common(a, b) / max(len(a), len(b)) >= overlap.AGREE}
        got = overlap.block_pairs(
            pd.DataFrame({"a": [("x", i) for i in range(40)], "x": x}), pd.DataFrame({"b": [("y", j) for j in range(50)], "y": y}), 17
        )
        assert {(a[1], b[1]) for a, b in zip(got.a, got.b)} == want


def test_overlap_of_nothing(spark):
    o = overlap.Overlap(spark.createDataFrame([], E))
    assert o.pairs().count() == 0 and o.report().count() == 0


def test_common_is_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap.common(a, b) == t[-1][-1]
