"""Keyed SHA-256 ranks: the only source of order and chance in this library.

A rank is the lower-case hex digest of ``seed NUL key``. Digests have a fixed width, so comparing the strings
compares the 256-bit numbers, in Spark as in any SQL engine. A null key gives a null rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def as_col(x: Column | str) -> Column:
    """A column name or a column; literals have to be given as ``F.lit``."""
    return F.col(x) if isinstance(x, str) else x


def rank(seed: Column | str, *parts: Column | str, sep: str = NUL) -> Column:
    """Hex digest of the seed (a plain string or a column) and the parts, joined by ``sep``."""
    first = F.lit(seed) if isinstance(seed, str) else seed
    out = first
    for p in parts:
        out = F.concat(out, F.lit(sep), as_col(p).cast("string"))
    return F.sha2(out, 256)


def digest(*parts: Column | str, sep: str = NUL) -> Column:
    """Hex digest of columns alone, joined by ``sep``."""
    return rank(as_col(parts[0]).cast("string"), *parts[1:], sep=sep)


def prefix_mod(hexdigest: Column, n: int) -> Column:
    """The first 64 bits of a digest, as an unsigned number, modulo n."""
    return (F.conv(F.substring(hexdigest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def byte_mod(hexdigest: Column, n: int) -> Column:
    """The first byte of a digest modulo n."""
    return (F.conv(F.substring(hexdigest, 1, 2), 16, 10).cast("int") % F.lit(n)).cast("int")


def hex_bucket(hexdigest: Column, digits: int = 3, skip: int = 0) -> Column:
    """One of 16**digits buckets: hex digits of the digest, beginning after the first ``skip``."""
    return F.substring(hexdigest, 1 + skip, digits)
