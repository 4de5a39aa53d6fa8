"""Point and batch reads, checksums and numeric arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from framewright.errors import MissingFrame
from framewright.functions import soa
from framewright.schema import KEYS

#: Key sets up to this many rows are broadcast to the blobs; larger ones are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def texts_of(blobs: DataFrame, keys: DataFrame, small: bool = False) -> DataFrame:
    """(pos, keys, blob) for keys (pos, traj_id, frame_idx); a missing frame has a null blob. ``small``: the caller has counted the keys."""
    if not small:
        return keys.join(blobs.select(*KEYS, "blob"), KEYS, "left")
    found = blobs.select(*KEYS, "blob").join(F.broadcast(keys.select(*KEYS).distinct()), KEYS, "left_semi")
    return keys.join(found, KEYS, "left")


def first_missing(blobs: DataFrame, keys: DataFrame) -> None:
    """MissingFrame for the first of keys (pos, traj_id, frame_idx) without a text; the texts themselves are not read."""
    row = keys.join(blobs.select(*KEYS), KEYS, "left_anti").orderBy("pos").first()
    if row is not None:
        raise MissingFrame((row.traj_id, row.frame_idx))


@F.pandas_udf(LongType())
def byte_checksum(blob: pd.Series) -> pd.Series:
    """Sum of byte value times 1-based place, modulo 2^64 as a signed long; 0 for an empty or null text. One product a text."""
    out = np.zeros(len(blob), np.int64)
    for k, text in enumerate(blob):
        if text:
            data = np.frombuffer(text.encode(), np.uint8)
            for at in range(0, data.size, 1 << 20):
                part = data[at : at + (1 << 20)].astype(np.int64)
                out[k] += part @ np.arange(at + 1, at + 1 + part.size)
    return pd.Series(out)


def touch(blobs: DataFrame) -> DataFrame:
    """traj_id -> n_frames, n_bytes, checksum."""
    size = F.octet_length("blob").cast("long")
    return blobs.groupBy("traj_id").agg(F.count("*").alias("n_frames"), F.sum(size).alias("n_bytes"), F.sum(byte_checksum("blob")).alias("checksum"))


def positions_of(atoms: Column) -> Column:
    return F.transform(atoms, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z")))


def vectors_of(atoms: Column, name: str) -> Column:
    """force or velocity of every atom, zeros where one lacks it; null if no atom has any."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "xyz"))
    return F.when(F.exists(atoms, lambda a: a[name].isNotNull()), F.transform(atoms, lambda a: F.coalesce(a[name], zero)))


def cook(parsed: DataFrame) -> DataFrame:
    """PARSED rows -> (keys, rcso)."""
    atoms = F.col("atoms")
    return parsed.select(*KEYS, soa.rcso_encode(positions_of(atoms), vectors_of(atoms, "force"), vectors_of(atoms, "velocity")).alias("rcso"))


def arrays(parsed: DataFrame, cooked: DataFrame | None = None) -> DataFrame:
    """keys, positions, forces, velocities: from valid cooked blocks, else from the text, block by block."""
    atoms = F.col("atoms")
    text = parsed.select(*KEYS, positions_of(atoms).alias("positions"), vectors_of(atoms, "force").alias("forces"), vectors_of(atoms, "velocity").alias("velocities"))
    if cooked is None:
        return text
    fast = cooked.select(*KEYS, soa.rcso_decode("rcso").alias("c")).where("c.positions is not null")
    both = fast.join(text, KEYS, "full_outer")
    return both.select(*KEYS, *(F.coalesce(F.col(f"c.{k}"), F.col(k)).alias(k) for k in ("positions", "forces", "velocities")))
