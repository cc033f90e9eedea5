"""Hashes, fingerprints and hash orders (sha-256 hex, identical in any engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(*parts: Column | str, sep: str = ":") -> Column:
    """sha-256 hex of the parts joined by ``sep``; strings are literals, Columns data."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = cols[0] if len(cols) == 1 else F.concat_ws(sep, *cols)
    return F.sha2(joined, 256)


def priority(seed: str | int, *parts: Column) -> Column:
    """Sampling priority: hash of ``seed:part:part``."""
    return sha(str(seed), *parts)


def hash_int(hex_col: Column, digits: int = 8) -> Column:
    """Leading hex digits as a whole number."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def hash_mod(hex_col: Column, k: int, digits: int = 8) -> Column:
    return hash_int(hex_col, digits) % k


def last_digit_odd(hex_col: Column) -> Column:
    """Side flip: parity of the last hex digit."""
    return F.conv(F.right(hex_col, F.lit(1)), 16, 10).cast("int") % 2 == 1


def payload_sha(payload: Column) -> Column:
    return F.sha2(payload, 256)


def size_proxy(payload: Column) -> Column:
    """Token estimate: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(payload) / 4)).cast("bigint")


def hash_order(values: Column, *prefix: Column | str) -> Column:
    """Array re-ordered by the hash of ``prefix:value``."""
    keyed = F.transform(values, lambda v: F.struct(sha(*prefix, v).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])
