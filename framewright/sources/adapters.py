"""Views of relational tables as frames and atoms: an order is a frame, its lines are atoms; documents are frame texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.project import project_atoms, with_frame_idx
from framewright.plans.dedup import mark_representatives
from framewright.schema import KEYS

#: Symbol by return flag and line status, and masses in millionths.
SYMBOLS = {"AF": "C", "AO": "Cu", "NF": "H", "NO": "N", "RF": "O", "RO": "S"}
MASSES = {"C": 12011000, "Cu": 63546000, "H": 1007930, "N": 14007000, "O": 15999000, "S": 32065000}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: keys and the columns that need no atoms."""
    return orders(spark, sf_dir, with_frame_idx(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"))


def orders(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """``headers`` without frame_idx, or of o with it."""
    o = o if o is not None else _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    energy = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", -F.col("o_totalprice") / 1000)
    return o.select(
        F.col("o_custkey").cast("long").alias("traj_id"),
        *(["frame_idx"] if "frame_idx" in o.columns else []),
        k.alias("orderkey"),
        "o_orderstatus",
        energy.alias("energy"),
        ((10 + k % 7) * 100).cast("double").alias("volume"),
        F.when(F.col("o_orderstatus") == "F", 7).when(F.col("o_orderstatus") == "P", 3).alias("pbc_mask"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("time"),
        F.when(k % 2 == 0, 0.25).alias("timestep"),
        (k % 100).cast("double").alias("frame_index"),
        (k % 8).cast("double").alias("neb_bead"),
        (k % 3).cast("double").alias("neb_band"),
        (k % 3 - 1).cast("double").alias("charge"),
        F.when(k % 5 == 0, 2.0).alias("magmom"),
        energy.isNotNull().alias("has_energy"),
    )


def atoms(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """One row a line: keys, symbol, micro-mass, position, force and velocity structs."""
    heads = heads if heads is not None else headers(spark, sf_dir)
    line = _read(spark, sf_dir, "lineitem")
    lookup = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    mass = F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair])
    joined = line.join(heads.select(*KEYS, "orderkey", "o_orderstatus"), line["l_orderkey"] == F.col("orderkey")).withColumn("symbol", F.try_element_at(lookup, F.concat("l_returnflag", "l_linestatus"))).where("symbol is not null")
    xyz = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    disc, tax, qty = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return joined.select(
        *KEYS,
        "symbol",
        F.try_element_at(mass, F.col("symbol")).cast("long").alias("mass"),
        xyz(qty, F.col("l_extendedprice") / 1000, disc * 100).alias("position"),
        F.when(F.col("o_orderstatus") != "O", xyz(disc, tax, qty / 50)).alias("force"),
        F.when(F.col("o_orderstatus") == "P", xyz(tax, disc, qty / 100)).alias("velocity"),
        "l_linenumber",
    )


def framed(spark: SparkSession, sf_dir: str, heads: DataFrame, *order: str) -> DataFrame:
    """Frames with atoms: the columns of heads (with orderkey) and ``lines``, an array sorted by the given columns of lineitem and symbol.

    Lines are gathered by their order before they meet its columns: each is moved once, and the join is of one row a frame.
    """
    line = _read(spark, sf_dir, "lineitem")
    lookup = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    line = line.withColumn("symbol", F.try_element_at(lookup, F.concat("l_returnflag", "l_linestatus"))).where("symbol is not null and l_orderkey is not null")
    per = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("lines"))
    return heads.join(per, heads["orderkey"] == per["l_orderkey"]).drop("l_orderkey")


def mass_of(symbol: Column) -> Column:
    """Mass in millionths."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair]), symbol).cast("long")


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def place_of(line: Column) -> tuple[Column, Column, Column]:
    return line["l_quantity"], line["l_extendedprice"] / 1000, line["l_discount"] * 100


def force_of(line: Column) -> Column:
    """Of a row with o_orderstatus, as in ``atoms``."""
    return F.when(F.col("o_orderstatus") != "O", vector(line["l_discount"], line["l_tax"], line["l_quantity"] / 50))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide screening table."""
    heads = headers(spark, sf_dir)
    out = project_atoms(heads, atoms(spark, sf_dir, heads))
    return out.withColumn("mass", F.col("mass").cast("double") / 1e6).drop("orderkey", "o_orderstatus")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as frame blobs: keys, blob, natoms (characters), md5 content hash, commit_seq."""
    d = _read(spark, sf_dir, "documents").where("source is not null")
    d = with_frame_idx(d.withColumn("traj_id", F.regexp_extract("source", "([0-9]+)", 1).cast("long")), "traj_id", "doc_id")
    return d.select(*KEYS, F.col("text").alias("blob"), F.col("n_chars").alias("natoms"), F.md5(F.col("text").cast("binary")).alias("content_hash"), F.lit(1).cast("long").alias("commit_seq"), "doc_id")


def screened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_representatives(documents(spark, sf_dir).drop("blob"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 21 positions: traj_id = label, frame_idx by vec_id."""
    e = _read(spark, sf_dir, "embeddings").where("label is not null and size(embedding) >= 63")
    e = with_frame_idx(e.withColumn("traj_id", F.col("label").cast("long")), "traj_id", "vec_id")
    xyz = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(F.col("embedding")[(k * 3).cast("int")].cast("double").alias("x"), F.col("embedding")[(k * 3 + 1).cast("int")].cast("double").alias("y"), F.col("embedding")[(k * 3 + 2).cast("int")].cast("double").alias("z")))
    return e.select(*KEYS, xyz.alias("positions"), "vec_id")


__all__ = ["Window", "atoms", "documents", "frames", "headers", "screened_documents", "vectors"]
