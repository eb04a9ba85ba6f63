"""Spelling of categories, answers and questions, all as JVM expressions."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.hashing import as_col

#: Any run of white space at either end; (?U) makes \\s Unicode-aware, as str.strip is.
_ENDS = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


def stripped(c: Column | str) -> Column:
    """The text without white space at its ends; null if nothing is left."""
    out = F.regexp_replace(as_col(c), _ENDS, "")
    return F.when(out != "", out)


def spelled(c: Column | str) -> Column:
    """A task type or split: lower case, no white space at the ends; blank and null are null."""
    return F.lower(stripped(c))


def spelled_source(c: Column | str) -> Column:
    """A source: as ``spelled``, and each space or ``-`` inside written as ``_``."""
    return F.translate(spelled(c), " - ", "___")


def spelled_group(c: Column | str) -> Column:
    """A group key: lower case, no white space at all, ``_`` written as ``-``; blank and null are null."""
    out = F.translate(F.lower(F.regexp_replace(as_col(c), r"(?U)[\s​﻿]+", "")), "_", "-")
    return F.when(out != "", out)


# Letters of other alphabets that look like Latin ones, and those Latin ones.
LOOKALIKE = str.maketrans("аеорсхуіјѕԁһкмтвнёαοινρυκτ", "aeopcxyijsdhkmtbheaoivpukt")

_SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힣"
_WORD = re.compile(f"[{_SPACELESS}]|[^\\W_{_SPACELESS}]+")


def plain_words(text: str) -> list[str]:
    """The words of a text for comparison: entities resolved, compatibility forms, accents and look-alike letters
    plain, lower case, no punctuation; scripts that don't put spaces between words give one word a character."""
    while "&" in text and (resolved := html.unescape(text)) != text:
        text = resolved
    text = text.lower()
    if not text.isascii():
        spread = unicodedata.normalize("NFKD", text)
        text = unicodedata.normalize(
            "NFC", "".join(c for c in spread if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        ).translate(LOOKALIKE)
    return _WORD.findall(text)
