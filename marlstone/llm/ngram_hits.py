"""Evaluation questions whose word n-grams stand in training: the search of problem 4 at scale.

The n-grams of every evaluation class are hashed together with its picture. Training classes are scanned for hits:
a training n-gram that no evaluation class has is dropped before anything is shuffled, as long as the evaluation's
hashes can be broadcast (they are counted first), and by a shuffle join beyond. An evaluation class of k n-grams that
shares ``CONTAINED`` k of them with a training class shares one of its k - CONTAINED k + 1 rarest, whatever the order
of rarity; only those are looked up, so phrases that many questions have are seldom met. Questions meet where they
share one, with their lengths and 512-bit sketches of their n-grams of that width, and a pair that the two bounds rule
out, which containment and agreement imply, is dropped there: the met pairs, which grow with the product of both sides,
are never moved or written. What is left is judged by exact containment and by the longest common subsequence.

The rule depends on the two questions alone, never on the corpus, a group's size or the layout: a pair is found if
the evaluation record's containment in the training record is at least CONTAINED, the numbers of words are within a
factor of two, and at least ``AGREE`` of the letters agree in order. Questions of one picture are compared by single
words, questions without a picture by four (fewer in questions of under sixteen words). Pairs of which nearly every
word differs are the price; ``overlap.near_classes`` compares all pairs and finds those as well.

Defined cases: as in ``overlap``; repeated n-grams count once; two classes whose 64-bit ids collide are both judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marlstone.llm.overlap import AGREE, FEW, share
from marlstone.plans.lineage import cut

#: Share of an evaluation record's n-grams that the training record has to have.
CONTAINED = 0.3
#: Words of an n-gram in questions without a picture, and words of a question for each word of its n-grams.
MOST, PER = 4, 4
#: Classes in a task, about.
PER_TASK = 20_000
#: An n-gram on which more than this share of all hits meet is split; there are fewer than 1 / HOT such n-grams.
HOT, SLOTS = 1 / 512, 8
LEAST_HOT = 1000
WORDS_OF_SKETCH = 8


def width(words: np.ndarray, pictured: np.ndarray) -> np.ndarray:
    """Words of an n-gram in an evaluation question of so many words."""
    return np.where(pictured, 1, np.clip(words // PER, 1, MOST))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(picture: pd.Series, fold: pd.Series, asked: bool) -> pd.DataFrame:
    """(row, k, g, s): the distinct n-gram hashes of each text and width, their number and their sketch.

    asked: n-grams of an evaluation question, of one width; else those that any evaluation question of half to twice
    as many words may ask for.
    """
    words = [f.split(" ") for f in fold]
    n = np.array([len(w) for w in words], dtype=np.int64)
    codes, names = pd.factorize(np.array([x for w in words for x in w], dtype=object))
    word = pd.util.hash_array(names.astype(object), categorize=False)[codes] if len(names) else np.array([], dtype=np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(word))  # words up to the end of the text, this one included
    pic = picture.to_numpy(np.int64)
    lo, hi = (width(n, pic >= 0),) * 2 if asked else (width((n + 1) // 2, pic >= 0), width(2 * n, pic >= 0))
    parts, hashes, run = [], [], np.zeros(len(word), dtype=np.uint64)
    for k in range(1, MOST + 1):
        run[: len(word) - k + 1] = run[: len(word) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :]
        at = np.nonzero((left >= k) & (lo[row] <= k) & (k <= hi[row]))[0]
        parts.append(row[at] * MOST + k - 1)
        hashes.append(mixed(run[at] ^ mixed(pic[row[at]].astype(np.uint64) * np.uint64(8) + np.uint64(k))))
    parts, hashes = np.concatenate(parts), np.concatenate(hashes)
    order = np.lexsort((hashes, parts))
    parts, hashes = parts[order], hashes[order]
    new = np.ones(len(parts), dtype=bool)
    new[1:] = (parts[1:] != parts[:-1]) | (hashes[1:] != hashes[:-1])
    each, at, k = np.unique(parts[new], return_inverse=True, return_counts=True)
    hashes = hashes[new]
    sketch = np.zeros((len(each), WORDS_OF_SKETCH), dtype=np.uint64)
    bit = (hashes >> np.uint64(8)).astype(np.int64) % (64 * WORDS_OF_SKETCH)
    np.bitwise_or.at(sketch, (at, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    lists = np.split(hashes.view(np.int64), np.cumsum(k)[:-1]) if len(each) else []
    return pd.DataFrame({"row": each // MOST, "k": k, "g": pd.Series(lists, dtype=object), "s": pd.Series(list(sketch.view(np.int64)), dtype=object)})


def shingles(frames: Iterator[pd.DataFrame], asked: bool) -> Iterator[pd.DataFrame]:
    """(id, letters, k, g, s): ``grams`` of classes, with the number of their letters."""
    for f in frames:
        out = grams(f["picture"], f["fold"], asked)
        letters = f["fold"].str.len() - f["fold"].str.count(" ")
        yield out.assign(id=f["id"].to_numpy()[out["row"]], letters=letters.to_numpy()[out["row"]]).drop(columns="row")


def contained(x: str, y: str, pictured: bool) -> float:
    """The share of distinct n-grams of x, of the width that x asks for, that y has."""
    a, b = x.split(" "), y.split(" ")
    k = int(width(np.array(len(a)), np.array(pictured)))
    mine = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    return len(mine & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}) / len(mine)


@F.pandas_udf(T.StructType([T.StructField("agree", T.DoubleType()), T.StructField("contained", T.DoubleType())]))
def judged(picture: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Share of letters that agree in order and containment of x in y; 0 letters where the containment is too low."""
    c = [contained(a, b, p >= 0) for p, a, b in zip(picture, x, y)]
    s = [share(a.replace(" ", ""), b.replace(" ", "")) if k >= CONTAINED else 0.0 for k, a, b in zip(c, x, y)]
    return pd.DataFrame({"agree": s, "contained": c}, dtype="float64")


def least(k: Column) -> Column:
    """N-grams that have to be shared of k."""
    return F.ceil(k * CONTAINED - 1e-9)


def contained_classes(classes: DataFrame) -> DataFrame:
    """(a, b, agree, contained): evaluation class a and a different training class b that are almost the same.

    classes: class, picture, fold, train, evaluation (whether it occurs there); one row a class, written.
    """
    c = classes.select(F.xxhash64("class").alias("id"), "class", "picture", "fold", "train", "evaluation")
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, classes.count() // PER_TASK)

    def shingled(of: str) -> DataFrame:
        rows = c.where(of).select("id", "picture", "fold").repartition(tasks)
        return cut(rows.mapInPandas(partial(shingles, asked=of == "evaluation"), "id long, letters int, k int, g array<long>, s array<long>"))

    asked = shingled("evaluation")
    # a row for each width; two rows of one key would only be met both
    held = shingled("train").withColumn("key", F.xxhash64("id", F.get("g", F.lit(0))))
    keys = asked.select(F.col("id").alias("a"), "k", F.explode("g").alias("gram"))
    wanted = keys.select("gram").distinct()
    hits = held.select("key", F.explode("g").alias("gram"))
    hits = cut(hits.join(F.broadcast(wanted) if keys.count() <= FEW else wanted, "gram", "left_semi"))
    much = max(LEAST_HOT, int(hits.count() * HOT))
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # of k n-grams the m that training has; the others are the rarest
    of = W.partitionBy("a")
    looked = keys.join(often, "gram").withColumn("place", F.row_number().over(of.orderBy("n", "gram"))).withColumn("m", F.count(F.lit(1)).over(of))
    looked = looked.where(F.col("place") <= F.col("m") - least(F.col("k")) + 1)
    # n-grams on which many meet are few; their hits are spread over slots
    slots = F.when(F.col("n") > much, F.ceil(F.col("n") * SLOTS / much).cast("int")).otherwise(F.lit(1))
    own = sum((F.bit_count(F.get("s", F.lit(i))) for i in range(WORDS_OF_SKETCH)), F.lit(0))
    mine = asked.select(
        F.col("id").alias("a"), F.col("letters").alias("_la"), (least(F.col("k")) - F.col("k") + own).cast("int").alias("bits"), F.col("s").alias("_s")
    )
    looked = looked.select("a", "gram", slots.alias("slots")).join(mine, "a").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    ).drop("slots")
    hot = often.where(F.col("n") > much).select("gram", slots.alias("slots"))
    spread = hits.join(held.select("key", F.col("id").alias("b"), F.col("letters").alias("_lb"), "s"), "key").join(
        F.broadcast(hot), "gram", "left"
    ).select(
        "gram", "b", "_lb", "s", F.when(F.col("slots").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.col("slots"))).cast("int").alias("slot")
    )
    both = sum((F.bit_count(F.get("_s", F.lit(i)).bitwiseAND(F.get("s", F.lit(i)))) for i in range(WORDS_OF_SKETCH)), F.lit(0))
    near = looked.join(spread, ["gram", "slot"]).where("a != b").where(
        F.least("_la", "_lb") / F.greatest("_la", "_lb") >= AGREE
    ).where(both >= F.col("bits")).select("a", "b").distinct()
    left = c.where("evaluation").select(F.col("id").alias("a"), F.col("class").alias("_a"), "picture", F.col("fold").alias("_fa"))
    right = c.where("train").select(F.col("id").alias("b"), F.col("class").alias("_b"), F.col("picture").alias("_pb"), F.col("fold").alias("_fb"))
    near = near.join(left, "a").join(right, "b").where("picture = _pb and _a != _b")
    near = near.select(F.col("_a").alias("a"), F.col("_b").alias("b"), judged("picture", "_fa", "_fb").alias("j"))
    return near.select("a", "b", "j.*").where((F.col("agree") >= AGREE) & (F.col("contained") >= CONTAINED))
