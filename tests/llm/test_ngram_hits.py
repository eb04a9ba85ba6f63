"""The n-gram search of problem 4 against its own rule by brute force, and its defined cases."""

from __future__ import annotations

import random
import time

from marlstone.llm import ngram_hits, overlap

E = "sample_id string, split string, source string, image string, question string, class string, letters string"


def found(spark, data):
    o = overlap.Overlap(spark.createDataFrame([(*r, "x", "y") for r in data], E), search=ngram_hits.contained_classes)
    return sorted((r.sample_id_a, r.sample_id_b) for r in o.pairs().collect()), o


def test_cases(spark):
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
    data += [
        ("long1", "train", "s", None, "word " * 3 + " ".join(f"w{i}" for i in range(3000))),
        ("long2", "test", "s", None, " ".join(f"w{i}" for i in range(20, 3010)))
    ]
    got, o = found(spark, data)
    assert got == [("a", "b"), ("a", "e"), ("f", "g"), ("long1", "long2")]
    assert all(r.contained >= ngram_hits.CONTAINED and r.agree >= overlap.AGREE for r in o.matches().collect())
    assert found(spark, [])[0] == []


def test_errors_in_every_second_word(spark):
    clean = "read the lettering painted upon the jug name the word that follows harvest"
    typos = "raed the letering painted upn the jgu name teh word tht follows harvets"
    pic = "images/1/00000000123.jpg"
    assert found(
        spark, [("a", "train", "s", pic, clean), ("b", "dev", "s", pic, typos), ("c", "train", "s", pic, "is there a cat")]
    )[0] == [("a", "b")]


def test_rule_by_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    words = "read lettering painted upon jug name word follows harvest every narrow window behind green wooden door counts".split()

    def typos(t, k):
        t = list(t)
        for _ in range(k):
            i = rnd.randrange(len(t) - 1)
            t[i], t[i + 1] = t[i + 1], t[i]
        return " ".join("".join(t).split())

    data = []
    for pic in (None, "p/00000000123.jpg"):
        clean = [
            "again and again the same opening words " * (i % 2) + " ".join(
                rnd.choice(words) for _ in range(rnd.choice([1, 3, 6, 12, 25]))
            ) for i in range(60)
        ]
        data += [(f"a{pic}{i}", "test", "s", pic, typos(t, len(t) // rnd.choice([8, 15, 30, 999]))) for i, t in enumerate(clean)]
        data += [
            (f"b{pic}{i}", "train", "s", pic, t) for i,
            t in enumerate(clean + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30))) for _ in range(60)])
        ]
    letters = lambda t: t.replace(" ", "")
    want = set()
    for k, split, _, pic, x in data:
        for m, split2, _, pic2, y in data if split == "test" else ():
            if split2 == "train" and pic == pic2 and overlap.share(letters(x), letters(y)) >= overlap.AGREE:
                n, o = len(x.split()), len(y.split())
                if letters(x) == letters(y) or n / 2 <= o <= 2 * n and ngram_hits.contained(x, y, pic is not None) >= ngram_hits.CONTAINED:
                    want.add((k, m))
    assert len(want) > 80
    for hot, floor in ((1 / 512, 1000), (1e-9, 3)):
        monkeypatch.setattr(ngram_hits, "HOT", hot)
        monkeypatch.setattr(ngram_hits, "LEAST_HOT", floor)
        assert set(found(spark, data)[0]) == want


def test_met_pairs_are_not_moved(spark):
    """Questions made of stock phrases meet in pairs; five times the questions must not move 25 times the bytes."""
    rnd = random.Random(5)
    phrases = [" ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(6)) for _ in range(40)]

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.5)  # what the store shows lags behind by a moment
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    sizes = []
    for n in (400, 2000):
        texts = [" ".join(rnd.sample(phrases, 5)) for _ in range(2 * n)]
        data = [(f"b{i}", "train", "s", None, t) for i, t in enumerate(texts[:n])]
        data += [(f"a{i}", "test", "s", None, t) for i, t in enumerate(texts[n:])] + [("z", "dev", "s", None, f"{texts[7]} then")]
        before = moved()
        pairs = found(spark, data)[0]
        sizes.append(moved() - before)
        assert ("b7", "z") in pairs and len(pairs) < n
    assert sizes[1] < 8 * sizes[0], sizes
