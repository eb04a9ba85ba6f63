"""Encoding, packing and garble operators: round trips, public encoders and small fixtures."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import encoding, garbled, packing

VOCABULARY = f"{encoding.TOKENIZERS}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def codec():
    return encoding.Codec(encoding.serialise(encoding.read_ranks(VOCABULARY)))


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = encoding.read_ranks(VOCABULARY.replace(".json", ".tiktoken"))
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_encoder(codec, public, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert codec.encode(text) == public.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


@needs_vocabulary
def test_encode_corpus(spark, codec):
    texts = [None, "", " ", "<|endoftext|> plain", "x" * 20000, "naïve 图中 🙂‍", "same", "same", "  \r\n\t it's 12345's"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df, VOCABULARY).collect()}
    assert got == {i: codec.encode(t) for i, t in enumerate(texts)} and got[0] == got[1] == []
    counts = {r.doc_id: r.n_tokens for r in encoding.encode_corpus(df, VOCABULARY, counts_only=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert 50256 not in got[3]
    assert encoding.encode_corpus(df.limit(0), VOCABULARY).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_pack_never_overfills(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    at = packing.pack(sizes, 50)
    assert len(at) == len(sizes)
    if len(sizes):
        used = np.bincount(at, weights=sizes)
        assert used.max() <= 50
        # at most one container is half empty or less: two of them would have been one
        assert (used * 2 <= 50).sum() <= 1 + int((sizes.sum() + 49) // 50 <= 1) or sizes.max(initial=0) <= 25


def test_pack_corpus(spark):
    data = [(i, (i * 37) % 90) for i in range(400)] + [(1000, 250), (1001, 200), (1002, 0), (1003, None), (None, 10), (5, 20)]
    sizes = spark.createDataFrame(data, "doc_id long, n_tokens long")
    budgets = spark.createDataFrame([("small", 100), ("large", 1000), ("zero", 0), ("null", None)], "budget_id string, capacity_tokens int")
    placed = packing.pack_corpus(sizes, budgets, per_shard=16)
    p = placed.toPandas()
    assert set(p.budget_id) == {"small", "large"}
    assert (
        p.groupby(["budget_id", "container"]).n_tokens.sum() <= p.budget_id.map(
            {"small": 100, "large": 1000}
        ).groupby([p.budget_id, p.container]).first()
    ).all()
    for b in ("small", "large"):
        part = p[p.budget_id == b]
        assert part.n_tokens.sum() == sum(n or 0 for _, n in data)
        assert set(part.doc_id.dropna().astype(int)) == {i for i, _ in data if i is not None}
    pieces = p[(p.budget_id == "small") & (p.doc_id == 1000)].sort_values("piece")
    assert list(zip(pieces.piece, pieces.start, pieces.n_tokens)) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert {(r.budget_id, r.doc_id) for r in packing.oversize(placed).collect()} == {("small", 1000), ("small", 1001)}
    fill = {r.budget_id: r.fill for r in packing.utilisation(placed, budgets).collect()}
    assert fill["small"] > 0.9
    assert packing.pack_corpus(sizes.limit(0), budgets).count() == 0


CLEAN = [
    "Le café de l’élève est près de la fenêtre, à côté du théâtre.", "Der Gegenstand „Körbchen“ steht über dem Tor und wirkt grün.",
    "Сколько клеток пройдёт агент до цели? Ответ: 35. Предмет «ящик» находится у стены.", "图中楼梯底部放着一个绿色的长椅，旁边没有人。第34题的候选区域互相重叠。",
    "A grid of 8 × 14 cells holds “boxes” – at 20 °C.", "La opción número 6 no coincidió con la región azul. ¡Atención!"
]
BAD = [
    (CLEAN[0], "utf-8", "cp1252"), (CLEAN[1], "utf-8", "latin-1"), (CLEAN[1], "utf-8", "mac_roman"), (CLEAN[2], "utf-8", "latin-1"),
    (CLEAN[2], "cp1251", "koi8-r"), (CLEAN[3], "gb18030", "latin-1"), (CLEAN[3], "utf-8", "latin-1"), (CLEAN[5], "cp1252", "cp1251"),
    (CLEAN[4], "utf-8", "cp437")
]
FINE = [
    "plain ascii", "zero​width ﬁne ｆｕｌｌ", "√2 ≈ 1.41, π; µ = 80 ± 2 ÷ 7", "┌──┐\n│@*│\n└──┘", "&eacute;tage \\u00e9cran \\xc3\\xa9", "cajón",
    "🙂 👩‍🔬 ✅", "العربة 71 قرب النافذة", "SÃO 4 OPÇÕES; ÂNGULO", ""
]


def test_find_garbled(spark):
    clean = [t for t in CLEAN for _ in range(60)]
    docs = clean + FINE + [None]
    first_bad = len(docs)
    docs += [
        t.encode(a).decode(b, "replace") if b != "cp1252" else "".join(
            bytes([x]).decode(b, "replace").replace("�", chr(x)) for x in t.encode(a)
        ) for t,
        a, b in BAD
    ]
    lossy = len(docs)
    docs += ["Le caf� de l��l�ve est pr�s de la fen�tre."]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, restored string").repartition(3)
    got = {r.doc_id: (r.restored, r.complete) for r in garbled.find_garbled(df).collect()}
    assert set(got) == set(range(first_bad, lossy + 1))
    assert [got[first_bad + i] for i in range(len(BAD))] == [(t, True) for t, _, _ in BAD]
    assert got[lossy][1] is False


def test_rare_characters_keep_their_stumps(spark, monkeypatch):
    monkeypatch.setattr(garbled, "RARE", 0.01)
    df = spark.createDataFrame([(i, "plain words") for i in range(100)] + [(100, "plain Á words")], "doc_id long, text string")
    model = garbled.pair_model(df)
    assert ord("Á") in model.char_p and "Á" in model.stumps["Ã"]
    assert abs(sum(model.char_p.values()) - 1) < 1e-9
    assert (ord("Á") << 21 | ord(" ")) not in model.pairs


def test_find_garbled_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert garbled.find_garbled(df).count() == 0 and garbled.find_garbled(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_segments_are_the_maximal_ones(score):
    got = garbled.segments(np.array(score, dtype=float))
    best = max([sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)], default=0)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert max([sum(score[i:j]) for i, j in got], default=0) == max(best, 0)
