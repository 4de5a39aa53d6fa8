"""Table schemas of a corpus."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["traj_id", "frame_idx"]
META = ["time", "timestep", "frame_index", "neb_bead", "neb_band", "charge", "magmom"]
XYZ = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
ATOM = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        *(T.StructField(c, T.DoubleType()) for c in "xyz"),
        T.StructField("fixed", T.LongType()),
        T.StructField("atom_id", T.LongType()),
        T.StructField("mass", T.DoubleType()),
        T.StructField("velocity", XYZ),
        T.StructField("force", XYZ),
    ]
)
#: One parsed frame, as the parser gives it.
PARSED = T.StructType(
    [
        T.StructField("traj_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("comment", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("boxl", T.ArrayType(T.DoubleType())),
        T.StructField("angles", T.ArrayType(T.DoubleType())),
        T.StructField("postbox", T.ArrayType(T.StringType())),
        T.StructField("atoms", T.ArrayType(ATOM)),
        T.StructField("has_forces", T.BooleanType()),
        T.StructField("has_velocities", T.BooleanType()),
        T.StructField("blob", T.StringType()),
    ]
)
FRAMES = T.StructType(
    [
        T.StructField("traj_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("natoms", T.LongType()),
        T.StructField("formula", T.StringType()),
        T.StructField("species", T.MapType(T.StringType(), T.LongType())),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        *(T.StructField(c, T.DoubleType()) for c in ("energy", "fmax", "mass", "volume")),
        T.StructField("pbc_mask", T.IntegerType()),
        *(T.StructField(c, T.DoubleType()) for c in META),
        *(T.StructField(c, T.BooleanType()) for c in ("has_forces", "has_velocities", "has_energy")),
        T.StructField("content_hash", T.StringType()),
        T.StructField("is_rep", T.BooleanType()),
        T.StructField("commit_seq", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ]
)
BLOBS = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("blob", T.StringType()), T.StructField("shard", T.IntegerType())])
TRAJ = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("n_frames", T.LongType()), T.StructField("source", T.StringType()), T.StructField("commit_seq", T.LongType())])
SOA = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("rcso", T.BinaryType())])
