"""Questions of evaluation splits that also stand, exactly or almost, in training (problem 4).

Questions are folded (case, spacing, punctuation, accents, entities, look-alike letters) and grouped into classes:
one class for each picture and string of letters and digits, with the splits in which it occurs. Copies therefore
never meet in pairs while searching. Exact overlaps are classes that occur on both sides. For the others,
the two strings' longest common subsequence decides, by one criterion for pictures of every size. The queries search
candidates by word n-grams (``ngram_hits``). ``near_classes`` below is the exact way, which compares all pairs; ``CROWD``
only chooses how they are met:

* up to CROWD training classes, by a join on the picture;
* beyond, and for questions without a picture, in blocks of up to about ``BLOCK`` evaluation and BLOCK training
  classes of similar length. In each block all pairs are tested against a bound that the criterion implies: if L letters of two
  strings of n and m letters agree in order, at least 3 L - n - m - 1 adjacent pairs of letters agree too, none of
  them moved by more than n - L or m - L places. One matrix product a zone of the strings counts them. For pairs that
  pass, subsequences are computed bit-parallel, many at a time, and given up once L is out of reach.

No pair that meets the criterion is lost. The price is that each evaluation class is compared with each training class
of a crowded picture that isn't too long or too short, so work grows with the product of both numbers.

Defined cases: null and blank questions, and those without letters and digits, are no cases; a null or blank image is
no picture, and such questions are compared with each other; an image without an eleven-digit number is an unknown
picture and matches nothing; null keys are no cases; a key delivered in several splits counts in each; texts of any
length are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import plain_words, spelled, spelled_source, stripped
from marlstone.plans.lineage import cut

CROWD = 256
FEW = 2_000_000
#: Classes of one side in a block, about.
BLOCK = 4096
#: Bands of length are this wide (natural logarithm).
BAND = 0.1
#: Adjacent letters are hashed into so many buckets; pairs that share one only weaken the bound.
BUCKETS = 1024
ZONES = 4
#: Occurrences of a pair in a zone that are matched one by one; more count as if they matched.
REPEATS = 3
#: Share of the longer question's letters and digits that have to agree in order.
AGREE = 0.775
EVALUATION = ("dev", "calibration", "test")


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one bit for each letter of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def share(x: str, y: str) -> float:
    """The common share of the longer of two strings; 0 where their lengths alone rule out AGREE."""
    longer = max(len(x), len(y))
    return 0.0 if min(len(x), len(y)) / longer < AGREE else common(x, y) / longer


@F.pandas_udf(T.DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """``share`` of two columns."""
    return pd.Series([share(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def folded(question: pd.Series) -> pd.Series:
    """The plain words of a question, joined by spaces. One pass in Python costs a tenth of the same regular
    expressions and translations in the JVM."""
    return pd.Series([None if q is None else " ".join(plain_words(q)) for q in question], dtype=object)


def picture(image: Column | str = "image") -> Column:
    """The eleven-digit number of a picture; -1 for no picture, null for one that can't be told."""
    number = F.regexp_extract(image, r"(?<![0-9])[0-9]{11}(?![0-9])", 0)
    return F.when(number != "", number.cast("long")).when(stripped(image).isNull(), F.lit(-1).cast("long"))


def deliveries(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, split, source, picture, class, fold): the deliveries in a known split whose picture both sides ask about.

    The pictures are found first, from their numbers alone; only the questions about them are folded and moved. The
    list of pictures is counted, and broadcast only up to FEW rows of eight bytes; beyond, it is joined by shuffle.
    """
    r = rows.where(
        F.col(key).isNotNull() & F.col("question").isNotNull()
    ).withColumn("split", spelled("split")).where(F.col("split").isin("train", *EVALUATION))
    r = r.select(
        F.col(key).alias("key"), "split", spelled_source("source").alias("source"), picture().alias("picture"), "question"
    ).where("picture is not null")
    sides = r.groupBy("picture").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") != "train").alias("e"))
    sides = cut(sides.where("t and e").select("picture"))
    r = r.join(F.broadcast(sides) if sides.count() <= FEW else sides, "picture", "left_semi")
    r = r.withColumn("fold", folded("question")).where("fold != ''")
    named = F.unhex(F.md5(F.concat(F.col("picture").cast("string"), F.lit(" "), F.replace("fold", F.lit(" "), F.lit("")))))
    return cut(r.select("key", "split", "source", "picture", named.alias("class"), "fold"))


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Letters that have to agree in strings of n and m letters."""
    return np.ceil(AGREE * np.maximum(n, m) - 1e-9).astype(np.int64)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and the lengths of the texts."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def occurrences(codes: np.ndarray, lengths: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(text, bucket): how often adjacent pairs that start in places lo to hi - 1 occur."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.nonzero((place >= lo) & (place < hi) & (place < np.repeat(lengths, lengths) - 1))[0]
    pair = (codes[at].astype(np.int64) * 1009 + codes[at + 1] * 31) % BUCKETS
    return np.bincount(row[at] * BUCKETS + pair, minlength=len(lengths) * BUCKETS).reshape(len(lengths), BUCKETS)


def hopeful(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of x and y that lengths and adjacent letters don't rule out."""
    (cx, n), (cy, m) = coded(x), coded(y)
    least = least_common(n[:, None], m[None])
    fit = np.minimum(n[:, None], m[None]) >= least
    if not fit.any():
        return np.nonzero(fit)
    # letter i of x and j of y agree only with j - (m - L) <= i <= j + (n - L); the farthest of all pairs that fit
    before, after = int((m[None] - least)[fit].max()), int((n[:, None] - least)[fit].max())
    width = -(-int(m.max()) // ZONES)
    common_pairs = np.zeros(fit.shape, dtype=np.float32)
    for z in range(ZONES):
        a = occurrences(cx, n, z * width - before, (z + 1) * width + after)
        b = occurrences(cy, m, z * width, (z + 1) * width)
        common_pairs += np.maximum(b - REPEATS, 0).sum(axis=1, dtype=np.float32)[None]
        for k in range(1, REPEATS + 1):
            used = np.nonzero((a >= k).any(axis=0) & (b >= k).any(axis=0))[0]
            common_pairs += (a[:, used] >= k).astype(np.float32) @ (b[:, used] >= k).astype(np.float32).T
    return np.nonzero(fit & (common_pairs >= 3 * least - n[:, None] - m[None] - 1))


def common_of(x: list[str], y: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair x[i], y[j] the length of the longest common subsequence; 0 where it is too short to agree."""
    (cx, n), (cy, m) = coded(x), coded(y)
    words = -(-int(n.max()) // 64)
    letters, cx = np.unique(cx, return_inverse=True)
    if len(i) < 16 or words > 16 or len(x) * (len(letters) + 1) * words > 1 << 23:
        return np.array([common(x[p], y[q]) for p, q in zip(i, j)], dtype=np.int64)
    # one bit for each place of a letter in x; the last letter stands for those that no x has
    masks = np.zeros((words, len(x), len(letters) + 1), dtype=np.uint64)
    place = np.arange(len(cx)) - np.repeat(np.cumsum(n) - n, n)
    np.bitwise_or.at(masks, (place // 64, np.repeat(np.arange(len(x)), n), cx), np.uint64(1) << (place % 64).astype(np.uint64))
    at = np.minimum(np.searchsorted(letters, cy), len(letters) - 1)
    at = np.where(letters[at] == cy, at, len(letters))
    spread = np.full((len(y), int(m.max())), len(letters))
    spread[np.repeat(np.arange(len(y)), m), np.arange(len(cy)) - np.repeat(np.cumsum(m) - m, m)] = at
    masks = masks.reshape(words, -1)
    out = np.zeros(len(i), dtype=np.int64)
    for start in range(0, len(i), 4096):
        live = np.arange(start, min(start + 4096, len(i)))
        row = [np.full(len(live), ~np.uint64(0)) for _ in range(words)]
        p, q, least = i[live], j[live], least_common(n[i[live]], m[j[live]])
        for step in range(int(m[q].max())):
            hit = p * (len(letters) + 1) + spread[q, step]
            carry = np.zeros(len(live), dtype=np.uint64)
            for w in range(words):
                mask = masks[w][hit]
                both = row[w] & mask
                total = row[w] + both
                over = total < both
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                row[w] = total | (row[w] & ~mask)
            done = step + 1
            if done % 16 == 0 or done == spread.shape[1]:
                reach = np.minimum(n[p], done + n[p] - least)
                got = sum(np.bitwise_count(~row[w] & low_bits(reach - 64 * w)).astype(np.int64) for w in range(words))
                keep = got + np.maximum(m[q] - done, 0) >= least
                if not keep.all():
                    live, p, q, least, row = live[keep], p[keep], q[keep], least[keep], [r[keep] for r in row]
                    if not len(live):
                        break
        if len(live):
            out[live] = sum(np.bitwise_count(~r).astype(np.int64) for r in row)
    return out


def low_bits(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set; none below 0, all from 64 on."""
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1))


def block_pairs(asked: pd.DataFrame, held: pd.DataFrame, side: int = 1024) -> pd.DataFrame:
    """(a, b, agree): the pairs of a block that agree."""
    asked, held = (f.sort_values(k, key=lambda t: t.str.len(), kind="stable") for f, k in ((asked, "x"), (held, "y")))
    found = []
    for r in range(0, len(asked), side):
        a, x = asked.a.iloc[r : r + side].tolist(), asked.x.iloc[r : r + side].tolist()
        for s in range(0, len(held), side):
            b, y = held.b.iloc[s : s + side].tolist(), held.y.iloc[s : s + side].tolist()
            i, j = hopeful(x, y)
            if len(i):
                got = common_of(x, y, i, j)
                found += [
                    (a[p], b[q], k / max(len(x[p]), len(y[q]))) for p, q,
                    k in zip(i, j, got) if k / max(len(x[p]), len(y[q])) >= AGREE and a[p] != b[q]
                ]
    return pd.DataFrame(found, columns=["a", "b", "agree"])


def crowded_pairs(c: DataFrame) -> DataFrame:
    """(a, b, agree) of crowded pictures. A block is a picture, a band of lengths and a slot of either side."""
    c = c.withColumn("band", F.floor(F.log(F.length("letters")) / BAND).cast("int"))
    slots = c.groupBy("picture", "band").agg(*[F.ceil(F.sum(F.col(s).cast("int")) / BLOCK).cast("int").alias(s) for s in ("evaluation", "train")])
    slot = lambda n: F.pmod(F.xxhash64("class"), F.greatest(F.col(n), F.lit(1))).cast("int")
    # two bands are far apart only if the lengths in them are
    far = math.ceil(-math.log(AGREE) / BAND)
    other = slots.select("picture", F.col("band").alias("band2"), F.col("evaluation").alias("e2"), F.col("train").alias("t2"))
    met = c.join(
        slots.withColumnRenamed("evaluation", "e1").withColumnRenamed("train", "t1"), ["picture", "band"]
    ).join(other, "picture").where(F.abs(F.col("band") - F.col("band2")) <= far)
    block = lambda *k: F.xxhash64("picture", *k).alias("block")

    def sided(of: str, mine: str, others: str, names: tuple[str, str], *k: str) -> DataFrame:
        r = met.where(of).where(F.col(others) > 0).withColumn("mine", slot(mine)).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        )
        return r.select(block(*k), F.col("class").alias(names[0]), F.col("letters").alias(names[1]))

    asked = sided("evaluation", "e1", "t2", ("a", "x"), "band", "mine", "band2", "other")
    held = sided("train", "t1", "e2", ("b", "y"), "band2", "other", "band", "mine")
    return asked.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(
        lambda asked, held: block_pairs(asked, held), "a binary, b binary, agree double"
    )


def near_classes(classes: DataFrame) -> DataFrame:
    """(a, b, agree): evaluation class a and a different training class b whose questions are almost the same.

    classes: class, picture, fold, train, evaluation (whether it occurs there); one row a class, written.
    """
    # pictures with both sides; sizes of pictures, not of their rows, are joined
    sides = classes.groupBy("picture").agg(F.sum(F.col("train").cast("int")).alias("crowd"), F.max("evaluation").alias("asked"))
    sides = sides.where("crowd > 0 and asked").select("picture", "crowd")
    c = classes.join(sides, "picture").select(
        "class", "picture", "crowd", "train", "evaluation", F.replace("fold", F.lit(" "), F.lit("")).alias("letters")
    )
    few = c.where(F.col("crowd") <= CROWD)
    asked = few.where("evaluation").select("picture", F.col("class").alias("a"), F.col("letters").alias("_la"))
    whole = asked.join(
        few.where("train").select("picture", F.col("class").alias("b"), F.col("letters").alias("_lb")), "picture"
    ).where(F.col("a") != F.col("b"))
    short = F.least(F.length("_la"), F.length("_lb")) / F.greatest(F.length("_la"), F.length("_lb")) >= AGREE
    whole = whole.where(short).select("a", "b", agreement("_la", "_lb").alias("agree")).where(F.col("agree") >= AGREE)
    return whole.unionByName(crowded_pairs(c.where(F.col("crowd") > CROWD)))


class Overlap:
    """Overlap between the evaluation splits and training of one table.

    search: finds the classes that are almost the same. ``near_classes`` compares all; ``contained_classes`` of
    ``ngram_hits`` looks for word n-grams of evaluation records in training, which holds at any scale.
    """

    def __init__(self, rows: DataFrame, key: str = "sample_id", search: Callable[[DataFrame], DataFrame] = near_classes):
        self.rows = deliveries(rows, key)
        side = self.rows.groupBy("class", "picture").agg(
            F.min("fold").alias("fold"), F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("evaluation")
        )
        self.classes = cut(side)
        self.near = cut(search(self.classes))

    def matches(self) -> DataFrame:
        """(a, b, agree, contained): evaluation classes and training classes that are the same or nearly so.

        contained: containment of the evaluation record in the training record; null if the search compares all.
        """
        same = self.classes.where("train and evaluation").select(
            F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("agree"), F.lit(1.0).alias("contained")
        )
        return same.unionByName(self.near, allowMissingColumns=True)

    def pairs(self) -> DataFrame:
        """(sample_id_a, sample_id_b): all pairs of different keys across the splits, the lesser key first."""
        m = self.matches()
        asked = self.rows.where(F.col("split") != "train").select(
            F.col("class").alias("a"), F.col("key").alias("x")
        ).join(m.select("a").distinct(), "a", "left_semi").distinct()
        held = self.rows.where(F.col("split") == "train").select(
            F.col("class").alias("b"), F.col("key").alias("y")
        ).join(m.select("b").distinct(), "b", "left_semi").distinct()
        out = m.select("a", "b").join(asked, "a").join(held, "b").where("x != y")
        return out.select(F.least("x", "y").alias("sample_id_a"), F.greatest("x", "y").alias("sample_id_b")).distinct()

    def report(self) -> DataFrame:
        """(split, source, questions, exact, near): evaluation keys of each split and source and those that overlap.

        A key counts as exact if another key has the same question in training, as near if only an almost equal one
        is there. Copies are not expanded: each class carries how many training keys it has, and the only one.
        """
        held = self.rows.where(F.col("split") == "train").groupBy("class").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        seen = held.select(F.col("class").alias("b"), "lo", "hi")
        best = self.matches().join(seen, "b").groupBy("a").agg(
            F.max(F.when(F.col("a") == F.col("b"), F.struct("lo", "hi"))).alias("same"),
            F.min(F.when(F.col("a") != F.col("b"), F.col("lo"))).alias("lo"), F.max(F.when(F.col("a") != F.col("b"), F.col("hi"))).alias("hi")
        )
        asked = self.rows.where(F.col("split") != "train").select("split", "source", "key", F.col("class").alias("a")).distinct()
        other = lambda lo, hi: F.coalesce((F.col(lo) != F.col("key")) | (F.col(hi) != F.col("key")), F.lit(False))
        judged = asked.join(best, "a", "left").withColumn("exact", other("same.lo", "same.hi")).withColumn("near", other("lo", "hi"))
        one = judged.groupBy("split", "source", "key").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
        return one.groupBy("split", "source").agg(
            F.count(F.lit(1)).alias("questions"), F.count_if("exact").alias("exact"), F.count_if(F.col("near") & ~F.col("exact")).alias("near")
        )
