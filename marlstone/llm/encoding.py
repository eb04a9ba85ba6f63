"""Token ids of a byte-level BPE vocabulary through a sentencepiece model made from it (problem 6).

The vocabulary file gives byte strings and their ranks. Each byte is written as one printable character (a fixed
one-to-one mapping), so each vocabulary entry becomes a piece of characters; the piece's score is its negative rank.
Sentencepiece's BPE joins the adjacent pair whose joined piece scores highest, the leftmost of equals: the pair
that byte-level BPE joins. The model is serialised directly, with identity normalisation, without training. Texts
are cut into pre-tokens by the tokenizer's pattern, each pre-token is encoded, and decoding maps pieces back to bytes.

Defined cases: null, empty texts give an empty list; strings that look like special tokens are ordinary text; lone
surrogates, which UTF-8 can't hold, are replaced by U+FFFD; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files are, unless a path is given.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

# Fixed value: how texts are cut into pre-tokens (contractions, letters, digits, other signs, white space).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens that a worker remembers; a bound on memory only, it changes no result.
REMEMBERED = 200_000


@lru_cache(1)
def byte_chars() -> str:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (chr(0x100 + i) for i in range(256 - len(plain)))
    return "".join(chr(b) if b in plain else next(other) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of base64 and rank, or a JSON file with byte-mapped pieces."""
    if path.endswith(".json"):
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
        back = {c: b for b, c in enumerate(byte_chars())}
        return {bytes(back[c] for c in p): i for p, i in model["model"]["vocab"].items() if p not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One protobuf field: text and messages by length, floats as 32 bits, whole numbers as varints."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file with one piece for each id; an id that no piece has becomes the unknown piece."""
    chars = byte_chars()
    by_id = {i: "".join(chars[b] for b in p) for p, i in ranks.items()}
    size = max(by_id) + 1
    free = next((i for i in range(size) if i not in by_id), size)
    size = max(size, free + 1)
    out = bytearray()
    for i in range(size):
        if i in by_id:
            piece = _field(1, by_id[i]) + _field(2, float(-i)) + _field(3, 1)  # a normal piece
        elif i == free:
            piece = _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)  # the unknown piece
        else:
            piece = _field(1, f"<unused{i}>") + _field(2, 0.0) + _field(3, 5)
        out += _field(1, piece)
    # BPE, the vocabulary's size, no begin, end or padding ids
    no_id = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, size) + _field(40, free) + _field(41, no_id) + _field(42, no_id) + _field(43, no_id))
    out += _field(3, _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False))
    return bytes(out)


class Codec:
    """Encoder and decoder of one model; a worker keeps one for all its batches."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.chars = byte_chars()
        self.table = {b: ord(c) for b, c in enumerate(self.chars)}
        self.back = {c: b for b, c in enumerate(self.chars)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, tokens: Iterable[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [*dict.fromkeys(t for t in tokens if t not in self.known)]
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for t in new]
        self.known.update(zip(new, self.pieces.encode(mapped, num_threads=1)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text."""
        if not text:
            return []
        try:
            text.encode()
        except UnicodeEncodeError:
            text = "".join("�" if 0xD800 <= ord(c) < 0xE000 else c for c in text)
        tokens = self.find(text)
        self._learn(tokens)
        ids: list[int] = []
        for t in tokens:
            ids += self.known[t]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; ids that cut a character apart give U+FFFD there."""
        pieces = "".join(self.pieces.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec for a model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_corpus(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", counts_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens): one row for each row, encoded in Arrow batches next to the scan, no shuffle.

    The serialised model (a megabyte, fixed by the vocabulary) is broadcast; workers need no file.
    """
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    out = "n_tokens" if counts_only else "ids"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model.value)
        for b in batches:
            ids = [c.encode(t) for t in b["_text"]]
            yield pd.DataFrame({key: b["_key"], out: [len(i) for i in ids] if counts_only else ids})

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    return picked.mapInPandas(run, f"`{key}` {kind}, {out} {'long' if counts_only else 'array<int>'}")
