"""RCSO v1: positions and optional forces and velocities of a frame as little-endian blocks of doubles."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.schema import XYZ

MAGIC, VERSION, HEADER = b"RCSO", 1, 24


def encode(positions, forces=None, velocities=None) -> bytes:
    blocks = [np.asarray(b, "<f8").reshape(-1, 3) for b in (positions, forces, velocities) if b is not None]
    if any(len(b) != len(blocks[0]) for b in blocks):
        raise ValueError("blocks of different lengths")
    flags = (forces is not None) | (velocities is not None) << 1
    return MAGIC + struct.pack("<IIIB3xI", VERSION, len(blocks[0]), flags, 0, 0) + b"".join(b.tobytes() for b in blocks)


def decode(data: bytes | None) -> dict | None:
    """positions, forces and velocities (None if absent); None if the bytes are not a valid block. Trailing bytes are allowed."""
    if data is None or len(data) < HEADER or data[:4] != MAGIC:
        return None
    version, n, flags, kind = struct.unpack_from("<IIIB", data, 4)
    parts = 1 + (flags & 1) + (flags >> 1 & 1)
    if version != VERSION or kind != 0 or len(data) < HEADER + parts * n * 24:
        return None
    blocks = np.frombuffer(data, "<f8", parts * n * 3, HEADER).reshape(parts, n, 3)
    return {"positions": blocks[0], "forces": blocks[1] if flags & 1 else None, "velocities": blocks[1 + (flags & 1)] if flags & 2 else None}


_LIST = T.ArrayType(XYZ)
DECODED = T.StructType([T.StructField(c, _LIST) for c in ("positions", "forces", "velocities")])


def _blocks(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of every row as a view of one matrix; None for a null row."""
    flat = column.flatten()
    xyz = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype("<f8", copy=False) for c in "xyz"])
    ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.int64)
    return [xyz[b:e] if there else None for b, e, there in zip([0, *ends], ends, column.is_valid().to_pylist(), strict=False)]


@F.arrow_udf(T.BinaryType())
def rcso_encode(positions: pa.Array, forces: pa.Array, velocities: pa.Array) -> pa.Array:
    return pa.array([None if p is None else encode(p, f, v) for p, f, v in zip(*map(_blocks, (positions, forces, velocities)), strict=True)], pa.binary())


def _lists(blocks: list[np.ndarray | None]) -> pa.Array:
    """The blocks as one column of lists: numbers are never objects of their own."""
    there = [b for b in blocks if b is not None]
    xyz = np.concatenate(there) if there else np.empty((0, 3))
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, c], dtype=float)) for c in range(3)], list("xyz"))
    ends = np.cumsum([0, *(0 if b is None else len(b) for b in blocks)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([b is None for b in blocks], pa.bool_()))


@F.arrow_udf(DECODED)
def rcso_decode(data: pa.Array) -> pa.Array:
    rows = [decode(d.as_py()) or {} for d in data]
    names = ("positions", "forces", "velocities")
    return pa.StructArray.from_arrays([_lists([r.get(c) for r in rows]) for c in names], list(names))


@F.pandas_udf(T.BooleanType())
def rcso_valid(data: pd.Series) -> pd.Series:
    return data.map(lambda d: decode(d) is not None).astype(bool)
