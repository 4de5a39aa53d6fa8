"""Projection of frames and atoms to the wide screening table: one grouped pass, no joins beyond the cell columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import scalars as S
from framewright.functions.hashing import content_hash
from framewright.functions.ranges import finite
from framewright.schema import KEYS, META


def project_parsed(parsed: DataFrame, hash_mode: str = "xxh3") -> DataFrame:
    """PARSED rows -> screening columns, all inside the row: no shuffle."""
    atoms = F.col("atoms")
    counts = F.col("counts_")
    energy = S.variant_number(F.col("parsed_"), "energy")
    # Computed once: a column that is used more than once stays one.
    once = {"counts_": S.species_of(F.transform(atoms, lambda a: a["symbol"])), "parsed_": F.try_parse_json("metadata")}
    return parsed.withColumns(once).select(
        *KEYS,
        F.size(atoms).cast("long").alias("natoms"),
        S.formula_of(counts).alias("formula"),
        F.map_from_entries(counts).alias("species"),
        F.transform(counts, lambda c: c["symbol"]).alias("symbols"),
        energy.alias("energy"),
        finite(F.when(F.col("has_forces"), F.array_max(F.transform(atoms, lambda a: S.norm(a["force"]))))).alias("fmax"),
        F.aggregate(atoms, F.lit(0.0), lambda m, a: m + a["mass"]).alias("mass"),
        finite(F.coalesce(S.lattice_volume(F.col("metadata")), S.cell_volume(F.col("boxl"), F.col("angles")))).alias("volume"),
        S.metadata_pbc(F.col("metadata")).cast("int").alias("pbc_mask"),
        *S.metadata_columns(F.col("parsed_")),
        "has_forces",
        "has_velocities",
        energy.isNotNull().alias("has_energy"),
        content_hash(F.col("blob"), hash_mode).alias("content_hash"),
        "blob",
    )


def project_atoms(headers: DataFrame, atoms: DataFrame, mass: Column | None = None) -> DataFrame:
    """Columnar form: headers (keys and cell/metadata columns, one row a frame) and atoms (keys, symbol, force, velocity, ...).

    Two grouped aggregations on the frame key share one shuffle of the atoms: by (key, symbol), then by key, with partial
    aggregation before it. Frames without atoms stay, with natoms 0 and no formula.
    """
    per_symbol = atoms.groupBy(*KEYS, "symbol").agg(
        F.count("*").alias("n"),
        F.max(finite(S.norm(F.col("force")))).alias("fmax"),
        F.bool_or(F.col("force").isNotNull()).alias("has_forces"),
        F.bool_or(F.col("velocity").isNotNull()).alias("has_velocities"),
        (F.sum(mass) if mass is not None else F.sum("mass")).alias("mass"),
    )
    per_frame = per_symbol.groupBy(*KEYS).agg(
        F.sum("n").alias("natoms"),
        F.array_sort(F.collect_list(F.struct("symbol", "n"))).alias("counts"),
        F.max("fmax").alias("fmax"),
        F.bool_or("has_forces").alias("has_forces"),
        F.bool_or("has_velocities").alias("has_velocities"),
        F.sum("mass").alias("mass"),
    )
    out = headers.join(per_frame, KEYS, "left")
    none = F.array().cast("array<struct<symbol:string,n:bigint>>")
    counts = F.coalesce("counts", none)
    return out.select(
        *headers.columns,
        F.coalesce("natoms", F.lit(0)).cast("long").alias("natoms"),
        S.formula_of(counts).alias("formula"),
        F.map_from_entries(counts).alias("species"),
        F.transform(counts, lambda c: c["symbol"]).alias("symbols"),
        F.when(F.coalesce("has_forces", F.lit(False)), F.col("fmax")).alias("fmax"),
        F.coalesce("mass", F.lit(0)).alias("mass"),
        F.coalesce("has_forces", F.lit(False)).alias("has_forces"),
        F.coalesce("has_velocities", F.lit(False)).alias("has_velocities"),
    )


def with_frame_idx(rows: DataFrame, traj: str, *order: str, start: Column | None = None) -> DataFrame:
    """frame_idx by order within each trajectory, from 0 or from ``start``."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy(traj).orderBy(*order)) - 1
    return rows.withColumn("frame_idx", (idx + (start if start is not None else F.lit(0))).cast("long"))


__all__ = ["META", "project_atoms", "project_parsed", "with_frame_idx"]
