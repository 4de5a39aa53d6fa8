"""Keys and hashes as fixed-length bytes: a frame key is 12 big-endian bytes (8 of traj_id, 4 of frame_idx), a hash 16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES, HASH_BYTES = 12, 16
#: What a corpus can be exported as: a folder of shards, a folder of one shard, a file of frames.
EXPORT_KINDS = {"sharded": "sharded-parquet", "single": "single-parquet", "extxyz": "extxyz"}


def key_bytes(traj_id: Column, frame_idx: Column) -> Column:
    """Bytes whose order is the order of keys; null for a null or a number that doesn't fit."""
    fits = traj_id.between(0, 2**63 - 1) & frame_idx.between(0, 2**32 - 1)
    return F.when(fits, F.concat(F.unhex(F.lpad(F.hex(traj_id), 16, "0")), F.unhex(F.lpad(F.hex(frame_idx), 8, "0"))))


def key_of(data: Column) -> Column:
    """Struct of traj_id and frame_idx; null unless there are exactly KEY_BYTES bytes and the id is below 2^63."""
    digits = F.hex(data)
    number = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10).cast("decimal(20,0)")
    ok = (F.octet_length(data) == KEY_BYTES) & (number(1, 16) <= F.lit(2**63 - 1))
    return F.when(ok, F.struct(number(1, 16).cast("long").alias("traj_id"), number(17, 8).cast("long").alias("frame_idx")))


def hash_to_bytes(digits: Column) -> Column:
    """A content hash's bytes from its hexadecimal text; null unless these are HASH_BYTES."""
    return F.when(digits.rlike(f"^[0-9a-fA-F]{{{2 * HASH_BYTES}}}$"), F.unhex(digits))


def hash_of_bytes(data: Column) -> Column:
    return F.when(F.octet_length(data) == HASH_BYTES, F.lower(F.hex(data)))
