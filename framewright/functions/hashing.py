"""Content hashes: xxh3-128 (little-endian hexadecimal) through Arrow, or md5 inside the JVM."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def hash_bytes(data: bytes | str) -> str:
    """xxh3-128 with seed 0, little-endian, as lower-case hexadecimal."""
    return xxhash.xxh3_128_digest(data.encode() if isinstance(data, str) else data)[::-1].hex()


@F.pandas_udf(StringType())
def xxh3_128(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hash_bytes(t))


def content_hash(text: Column, mode: str = "xxh3") -> Column:
    if mode == "md5":
        return F.md5(text.cast("binary"))
    if mode == "xxh3":
        return xxh3_128(text)
    raise ValueError(f"unknown hash {mode!r}")
