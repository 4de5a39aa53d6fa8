"""Named queries over a stored corpus: all orders are ingested as frames, then selected, split, joined, extended, reindexed and exported.

The corpus is written once for each application and folder of tables, under spark.checkpoint.dir (a folder of this process only
in local mode without that setting).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.corpus import Corpus, join_shards, split_shards
from framewright.plans.select import Select
from framewright.schema import KEYS
from framewright.sources import adapters as A
from framewright.sources import con

N_SHARDS = 8
_stored: dict[tuple[str, str], Corpus] = {}
SELECTED = Select().require_symbol("Cu").require_forces().energy_range(-250.0, -20.0).natoms_range(2, 6)


def workspace(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='framewright-')).rstrip('/')}/corpus-{uuid.uuid4().hex}"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with atoms in the form that Corpus.append_frame_table takes, which numbers them by orderkey."""
    o = A.orders(spark, sf_dir).withColumn("frame_idx", F.col("orderkey"))
    per = A.framed(spark, sf_dir, o, "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "symbol", "l_tax")
    xyz = "struct<x:double,y:double,z:double>"

    def atom(line):
        x, y, z = A.place_of(line)
        velocity = F.when(F.col("o_orderstatus") == "P", A.vector(line["l_tax"], line["l_discount"], line["l_quantity"] / 100))
        return F.struct(
            line["symbol"].alias("symbol"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"),
            F.lit(0).cast("long").alias("fixed"), line["l_linenumber"].cast("long").alias("atom_id"), (A.mass_of(line["symbol"]) / 1e6).alias("mass"),
            velocity.cast(xyz).alias("velocity"), A.force_of(line).cast(xyz).alias("force"),
        )

    metadata = F.to_json(F.struct(F.lit(2).alias("con_spec_version"), "energy"))
    boxl = F.array(F.lit(10.0), F.lit(10.0), F.col("volume") / 100)
    return per.select(*KEYS, metadata.alias("metadata"), boxl.alias("boxl"), F.array(*[F.lit(90.0)] * 3).alias("angles"), F.transform("lines", atom).alias("atoms"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        made = Corpus(spark, workspace(spark), hash_mode="md5")
        made.append_frame_table(frames(spark, sf_dir), "orders")
        _stored[key] = made
    return _stored[key]


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c, n: F.round(c, n).alias(c)
    return corpus(spark, sf_dir).frames.select(*KEYS, "natoms", "formula", "energy", rounded("fmax", 9), rounded("mass", 6), rounded("volume", 6), "has_forces", "has_velocities")


def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(SELECTED)


def extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every trajectory after a split into shards and one more frame (its first again) for the smallest trajectory."""
    c = split_shards(corpus(spark, sf_dir), workspace(spark), N_SHARDS)
    first = c.trajectories.agg(F.min("traj_id")).first()[0]
    if first is not None:
        c.extend(first, list(con.parse(c.frame_text((first, 0)))))
    return c.trajectories.select("traj_id", "n_frames", "source")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the shards joined again, with the shard that each came from."""
    c = join_shards(split_shards(corpus(spark, sf_dir), workspace(spark), N_SHARDS), workspace(spark))
    return c.trajectories.select("traj_id", "n_frames", "source")


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening columns derived again from the stored texts of a copy."""
    c = split_shards(corpus(spark, sf_dir), workspace(spark), N_SHARDS)
    c.reindex()
    return c.frames.select(*KEYS, "natoms", "formula", "energy", F.round("fmax", 9).alias("fmax"), F.col("shard").cast("long").alias("shard"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms and their coordinates in the extended XYZ export of the whole corpus, by symbol, read back from its files."""
    folder = workspace(spark)
    c = corpus(spark, sf_dir)
    c.export_extxyz_parts(c.list_keys(), folder)
    word = lambda k: F.try_element_at(F.split(F.trim("value"), " +"), F.lit(k))
    lines = spark.read.text(folder).where("not contains(value, 'Lattice=')").select(word(1).alias("symbol"), *(word(k + 2).cast("double").alias(c) for k, c in enumerate("xyz")))
    return lines.where("x is not null").groupBy("symbol").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(c) for c in "xyz"))


#: After the frames of the catalog (f): those with atoms, numbered anew, as frames without atoms are not stored.
OWN = "g AS (SELECT f.* EXCLUDE (frame_idx), CAST(row_number() OVER (PARTITION BY traj_id ORDER BY frame_idx) - 1 AS BIGINT) AS frame_idx FROM f WHERE natoms > 0)"
QUERIES = {
    "corpus_ingest": (ingest, "SELECT traj_id, frame_idx, natoms, formula, energy, round(fmax, 9) AS fmax, round(mass, 6) AS mass, round(volume, 6) AS volume, has_forces, has_velocities FROM g"),
    "corpus_select": (select, "SELECT traj_id, frame_idx FROM g WHERE has_forces AND natoms BETWEEN 2 AND 6 AND energy BETWEEN -250 AND -20 AND contains(concat('|', formula), '|Cu:')"),
    "corpus_extend": (extend, "SELECT traj_id, count(*) + CASE WHEN traj_id = (SELECT min(traj_id) FROM g) THEN 1 ELSE 0 END AS n_frames, 'split-from-single' AS source FROM g GROUP BY 1"),
    "corpus_join": (joined, f"SELECT traj_id, count(*) AS n_frames, concat('join-from-shard-', traj_id % {N_SHARDS}) AS source FROM g GROUP BY 1"),
    "corpus_reindex": (reindexed, f"SELECT traj_id, frame_idx, natoms, formula, energy, round(fmax, 9) AS fmax, traj_id % {N_SHARDS} AS shard FROM g"),
    "corpus_export": (exported, "SELECT symbol, count(*) AS n, round(sum(l_quantity), 4) AS x, round(sum(l_extendedprice / 1000), 4) AS y, round(sum(l_discount * 100), 4) AS z FROM a WHERE symbol IS NOT NULL GROUP BY 1"),
}
