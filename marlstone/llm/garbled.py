"""Text that was decoded with the wrong character encoding, and its original (problem 8).

Adjacent character pairs are counted over the whole corpus. A pair's contribution to the mutual information of
neighbours, p(ab) ln(p(ab) / p(a)p(b)), is small where a pair is rare or its characters meet by chance; pairs below a
threshold score above zero, others and pairs of plain ASCII below. Maximum-scoring segments of these scores are the
improbable runs. Only inside runs, inverse mappings are tested: the run is encoded again by the encoding that it may
have been read with, and decoded by the one that it may have been written in. A mapping holds if its result is more
likely, by pair statistics of the corpus, by at least ``GAIN`` nats, neighbours included. Mappings are repeated, for
texts that were garbled more than once. U+FFFD is what a decoder leaves of bytes it can't read: such a run is
garbled and can't be restored there.

The pair table keeps pairs of at least ``RARE`` of all pairs, so it has at most 1 / RARE rows whatever the corpus,
and is broadcast; rarer pairs are scored by their characters, whose table is whole. Documents are scanned twice, nothing else is shuffled
than the counts.

Defined cases: null and empty texts are not garbled; escapes, entities, rare scripts, emoji, box drawings and
decomposed accents are not, as no inverse mapping makes them likelier; repeated ids are judged row by row.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE = 1e-6
#: Contribution to mutual information (nats) under which a pair is improbable.
IMPROBABLE = 2e-3
GAIN = 5.0
#: The gain that is enough for a mapping that holds elsewhere in the same text.
AGAIN = 1.0
#: The gain that is enough for UTF-8, whose byte sequences hardly come about by chance.
GAIN_UTF8 = 1.0
#: The gain that is enough where bytes that can't be shown were dropped, so that the character is a guess.
GAIN_LOST = 4.0
LOST = ("dropped", "utf-8")
ROUNDS = 3
#: Results for stretches of up to so many characters are remembered within a task.
REMEMBERED = 40
#: From so many characters on, likelihoods are summed by array operations.
LONG = 24

# Encodings texts are read with by mistake, and encodings texts are written in.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "gb18030", "cp932")
WRITTEN_IN = ("utf-8", "cp1252", "cp1251", "koi8-r", "gb18030", "euc_jp", "cp932", "big5", "euc_kr")
MANY_BYTES = ("utf-8", "gb18030", "euc_jp", "cp932", "big5", "euc_kr")

_NON_ASCII = re.compile(r"[^\x00-\x7f�]+")


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int] | None:
    """Byte of each character of a one-byte encoding; bytes it leaves undefined stand for themselves, as browsers do."""
    if encoding in MANY_BYTES:
        return None
    out: dict[str, int] = {}
    for b in range(256):
        c = bytes([b]).decode(encoding, "replace")
        out.setdefault(chr(b) if c == "�" else c, b)
    return out


@lru_cache(None)
def points_of(encoding: str) -> dict[int, int] | None:
    """``byte_of`` by code points."""
    table = byte_of(encoding)
    return None if table is None else {ord(c): b for c, b in table.items()}


@lru_cache(None)
def producible(encoding: str) -> re.Pattern:
    """Stretches of characters beyond ASCII that reading with an encoding can have produced."""
    table = byte_of(encoding)
    return _NON_ASCII if table is None else re.compile("[" + "".join(re.escape(c) for c in table if ord(c) > 0x7F) + "]+")


def encoded(text: str, encoding: str) -> bytes | None:
    """The bytes that would read as the text, or None."""
    table = points_of(encoding)
    try:
        return text.encode(encoding) if table is None else codecs.charmap_encode(text, "strict", table)[0]
    except UnicodeEncodeError:
        return None


def decoded(data: bytes, encoding: str) -> str | None:
    """The text that the bytes stand for, or None if they are none."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def pair_keys(text: str) -> np.ndarray:
    """Each adjacent pair as one number; the ends pair with a line end."""
    points = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    return points[:-1] << 21 | points[1:]


#: Marks pairs that are neighbours once white space is left out.
CLOSED_UP = 1 << 42


def counted(text: str) -> list[np.ndarray]:
    """The pairs of a text that are counted: neighbours, and neighbours across white space."""
    return [pair_keys(text), pair_keys("".join(text.split())) | CLOSED_UP]


def count_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n): how often each pair occurs; counted per batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [k for t in b["_text"] if t for k in counted(t)]
            if keys:
                pair, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pd.DataFrame({"pair": pair, "n": n})

    out = docs.select(docs[text].alias("_text")).where("_text is not null").mapInPandas(run, "pair long, n long")
    return out.groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Pair statistics: arrays of the kept pairs and of the characters, and the scores made from them."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, chars: np.ndarray, m: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, n = pairs[order], n[order].astype(float)
        self.total = max(1.0, float(m.sum()))
        self.char_p = dict(zip(map(int, chars), map(float, m / self.total)))
        least = 0.1 / self.total
        first = np.array([self.char_p.get(int(a), least) for a in self.pairs >> 21 & (1 << 21) - 1])
        second = np.array([self.char_p.get(int(b), least) for b in self.pairs & (1 << 21) - 1])
        p = n / self.total
        with np.errstate(divide="ignore"):
            self.contribution = p * np.log(np.maximum(p, 1e-300) / (first * second)) if len(p) else p
            self.conditional = np.minimum(1.0, p / first) if len(p) else p
        self.pair_score = np.clip(math.log(IMPROBABLE) - np.log(np.maximum(self.contribution, 1e-12)), -3.0, 3.0)
        self.least = max(1e-9, least)
        self.chars = np.array(sorted(self.char_p), dtype=np.int64)
        self.of_char = np.array([max(self.char_p[c], self.least) for c in self.chars.tolist()])
        self.cache: dict[tuple[str, str, int], float] = {}
        # what is left of a UTF-8 character that was misread while control characters or undefined bytes were dropped
        self.stumps: dict[str, list[str]] = {}
        for c in sorted(chr(p) for p in self.char_p if 0x9F < p < 0x110000 and not 0xD800 <= p < 0xE000):
            for encoding in ("latin-1", "cp1252"):
                full = c.encode().decode("latin-1")
                if encoding == "cp1252":
                    full = "".join(x.encode("latin-1").decode("cp1252", "ignore") for x in full)
                left = "".join(x for x in full if not 0x7F < ord(x) < 0xA0)
                if 0 < len(left) < len(c.encode()) and left != c:
                    self.stumps.setdefault(left, []).append(c)
        starts = sorted({x[0] for x in self.stumps})
        self.stump_starts = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None
        self.guesses: dict[tuple[str, str, str, str, str], tuple[float, str]] = {}
        self.mapped: dict[tuple[str, str, str], list[tuple[float, tuple[str, str], Edits]]] = {}
        self.steps: dict[tuple[str, str, str, str, bool], dict[str, tuple[float, str]]] = {}

    def improbable(self, text: str) -> np.ndarray:
        """The score of each pair between adjacent characters of the text: above zero where it is improbable."""
        keys = pair_keys(text)[1:-1]
        score = np.full(len(keys), 3.0)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = self.pairs[at] == keys
            score[hit] = self.pair_score[at[hit]]
        score[(keys >> 21 < 128) & ((keys & (1 << 21) - 1) < 128)] = -2.0
        return score

    def log_p(self, a: str, b: str, closed_up: int = 0) -> float:
        """ln p(b | a), with the character's own frequency as the fallback."""
        if (a, b, closed_up) not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            key = closed_up | ord(a) << 21 | ord(b)
            i = int(np.searchsorted(self.pairs, key))
            cond = float(self.conditional[i]) if i < len(self.pairs) and self.pairs[i] == key else 0.0
            self.cache[a, b, closed_up] = math.log(0.9 * cond + 0.1 * max(self.char_p.get(ord(b), 0.0), self.least))
        return self.cache[a, b, closed_up]

    def likelihood(self, before: str, text: str, after: str) -> float:
        whole = before + text + after
        if len(whole) < LONG or not len(self.pairs):
            return sum(self.log_p(a, b) for a, b in zip(whole, whole[1:]))
        keys = pair_keys(whole)[1:-1]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        b = keys & (1 << 21) - 1
        i = np.minimum(np.searchsorted(self.chars, b), len(self.chars) - 1)
        p = 0.9 * np.where(self.pairs[at] == keys, self.conditional[at], 0.0) + 0.1 * np.where(self.chars[i] == b, self.of_char[i], self.least)
        return float(np.log(p).sum())


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments [i, j) of a sequence, by one pass with a stack of candidates (Ruzzo and Tompa)."""
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    if not len(score):
        return []
    # neighbours of one sign are one step; segments begin and end where the sign changes
    turns = np.concatenate([[0], np.nonzero(np.diff(score > 0))[0] + 1])
    sums, ends = np.add.reduceat(score, turns), np.append(turns[1:], len(score))
    after = np.cumsum(sums)
    some = score[turns] > 0
    for begin, end, left, right in zip(turns[some].tolist(), ends[some].tolist(), (after - sums)[some].tolist(), after[some].tolist()):
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                stack.append((begin, end, left, right))
                break
            begin, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(b, e) for b, e, _, _ in stack]


def runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """The improbable runs [i, j) of a text that hold characters beyond ASCII."""
    if text.isascii():
        return []
    found = [(b, e + 1) for b, e in segments(model.improbable(text))]
    if len(text) == 1:
        found = [(0, 1)]
    return [(b, e) for b, e in found if not text[b:e].isascii()]


Edits = list[tuple[int, int, str]]


def remapped(before: str, span: str, after: str, read: str, wide: bool, model: PairModel) -> dict[str, tuple[float, str]]:
    """What the inverse mappings from one encoding make of a span: for each encoding it may have been written in, the
    gain and the text, of those that gain. Words come again and again, so results are remembered.

    wide: the span is more than what the encoding can have produced; only encodings of several bytes are tried.
    """
    key = (before, span, after, read, wide)
    known = model.steps.get(key)
    if known is not None:
        return known
    out: dict[str, tuple[float, str]] = {}
    data, cost = encoded(span, read), None
    for written in () if data is None else ("utf-8",) if read in MANY_BYTES else MANY_BYTES if wide else WRITTEN_IN:
        if written == read or (wide and written == "utf-8" and read not in MANY_BYTES):
            continue
        new, got = span, []
        for i in range(ROUNDS if written == "utf-8" else 1):  # UTF-8 may have been misread repeatedly
            bytes_ = data if i == 0 else encoded(new, read)
            again = None if bytes_ is None else decoded(bytes_, written)
            if again is None or again == new or "�" in again:
                break
            new = again
            if cost is None:
                cost = model.likelihood(before, span, after)
            got.append((model.likelihood(before, new, after) - cost, new))
        if got and max(got)[0] > 0:
            out[written] = max(got)
    if len(span) <= REMEMBERED:
        if len(model.steps) > 500_000:
            model.steps.clear()
        model.steps[key] = out
    return out


def guessed(before: str, after: str, stump: str, far_before: str, far_after: str, model: PairModel) -> tuple[float, str]:
    """The likeliest character that a stump can be what is left of, and its gain between its neighbours.

    What the nearest characters other than white space say counts as well; no neighbour says nothing.
    """
    key = (before, after, stump, far_before, far_after)
    known = model.guesses.get(key)
    if known is not None:
        return known

    def value(x: str) -> float:
        far = (model.log_p(*p, CLOSED_UP) for p in ((far_before, x[0]), (x[-1], far_after)) if all(p))
        return model.likelihood(before, x, after) + sum(far)

    own = value(stump)
    # no character is likelier than certain
    best = max((value(c) - own, c) for c in model.stumps[stump]) if -own >= GAIN_LOST else (0.0, "")
    if len(model.guesses) > 500_000:
        model.guesses.clear()
    model.guesses[key] = best
    return best


def mappings(left: str, run: str, right: str, model: PairModel) -> list[tuple[float, tuple[str, str], Edits]]:
    """The inverse mappings that make the run likelier between its neighbours: gain, encodings and replacements."""
    known = model.mapped.get((left, run, right))
    if known is not None:
        return known
    whole, shift = left + run + right, len(left)

    def ends(b: int, e: int) -> tuple[str, str]:
        return whole[max(0, b + shift - 1) : b + shift] or "\n", whole[e + shift : e + shift + 1] or "\n"

    out = []
    for read in READ_AS:
        found = [m.span() for m in producible(read).finditer(run)]
        if not found:
            continue
        core = (found[0][0], found[-1][1])
        # a letter beside or inside the core may be the second byte of a character; where an encoding of several bytes
        # was read with, such letters are part of its characters already
        tries = [found]
        if read not in MANY_BYTES:
            tries += [[core], [(core[0], min(len(run), core[1] + 1))], [(b, min(len(run), e + 1)) for b, e in found]]
        best: dict[str, tuple[float, Edits]] = {}
        for wide, spans in enumerate(tries):
            sums: dict[str, tuple[float, Edits]] = {}
            for b, e in spans:
                before, after = ends(b, e)
                for written, (g, new) in remapped(before, run[b:e], after, read, wide > 0, model).items():
                    total, edits = sums.setdefault(written, (0.0, []))
                    edits.append((b, e, new))
                    sums[written] = total + g, edits
            for written, (total, edits) in sums.items():
                if total > best.get(written, (0.0,))[0]:
                    best[written] = total, edits
        out += [(total, (read, written), edits) for written, (total, edits) in best.items()]
    got, total, free = [], 0.0, 0
    for m in model.stump_starts.finditer(run) if model.stump_starts else ():
        i = m.start()
        for k in (3, 2, 1) if i >= free else ():
            stump = run[i : i + k]
            if len(stump) == k and stump in model.stumps:
                far = whole[: i + shift].rstrip()[-1:], whole[i + k + shift :].lstrip()[:1]
                score, new = guessed(*ends(i, i + k), stump, *far, model)
                if score >= GAIN_LOST:
                    total += score
                    got.append((i, i + k, new))
                    free = i + k
                    break
    if got:
        out.append((total, LOST, got))
    out.sort(key=lambda x: (x[1] == LOST, -x[0], x[1]))  # a guess only where nothing else holds
    if len(run) <= REMEMBERED:
        if len(model.mapped) > 200_000:
            model.mapped.clear()
        model.mapped[left, run, right] = out
    return out


def enough(mapping: tuple[str, str]) -> float:
    """The gain from which a mapping holds."""
    return GAIN_LOST if mapping == LOST else GAIN_UTF8 if mapping[1] == "utf-8" else GAIN


def restore(text: str | None, model: PairModel) -> tuple[bool, str | None, bool]:
    """(garbled, restored, complete): complete if nothing is unreadable or guessed; restored is null for clean texts."""
    if not text or text.isascii():
        return False, None, True
    now, garbled, guessed = text, "�" in text, False
    seen: set[tuple[str, str]] = set()  # mappings that hold somewhere in this text are believed sooner elsewhere in it
    for _ in range(ROUNDS):
        edits: Edits = []
        found = [(i, j, mappings(now[max(0, i - 2) : i], now[i:j], now[j : j + 2], model)) for i, j in runs(now, model)]
        seen |= {m[0][1] for _, _, m in found if m and m[0][0] >= enough(m[0][1])}
        for i, _, m in found:
            best = next((x for x in m if x[0] >= enough(x[1]) or x[1] in seen and x[0] >= AGAIN), None)
            if best:
                guessed |= best[1] == LOST
                edits += [(i + b, i + e, new) for b, e, new in best[2]]
        if not edits:
            break
        garbled = True
        for b, e, new in sorted(edits, reverse=True):
            now = now[:b] + new + now[e:]
    return garbled, now if garbled else None, not guessed and "�" not in now


def pair_model(docs: DataFrame, text: str = "text") -> PairModel:
    """The model of a corpus. Pairs of at least RARE of all come to the driver, 1 / RARE rows, and all characters,
    which Unicode bounds."""
    from marlstone.plans.lineage import cut

    counts = cut(count_pairs(docs, text))
    total = counts.where(F.col("pair") < CLOSED_UP).agg(F.sum("n").alias("n")).first()["n"] or 0
    kept = counts.where(F.col("n") >= RARE * total).toPandas()
    chars = counts.where(F.col("pair") < CLOSED_UP).groupBy(F.shiftright("pair", 21).alias("c")).agg(F.sum("n").alias("n")).toPandas()
    return PairModel(kept["pair"].to_numpy(np.int64), kept["n"].to_numpy(np.int64), chars["c"].to_numpy(np.int64), chars["n"].to_numpy(np.int64))


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, complete): the garbled documents."""
    model = docs.sparkSession.sparkContext.broadcast(pair_model(docs, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [restore(t, model.value) for t in b["_text"]]
            keep = [g[0] for g in got]
            if any(keep):
                yield pd.DataFrame(
                    {key: b["_key"][keep].reset_index(drop=True), "restored": [g[1] for g in got if g[0]], "complete": [g[2] for g in got if g[0]]}
                )

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    return picked.mapInPandas(run, f"`{key}` {kind}, restored string, complete boolean")
