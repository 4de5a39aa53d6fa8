"""Shared plumbing: input tables, scratch tables in the shared checkpoint folder, connected components."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every word-based operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of this process if the executors are it too (local mode); an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app)
        if root is None:
            root = _own[app] = tempfile.mkdtemp(prefix="framewright-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def row_hash(*columns: str) -> Column:
    """A row's second name beside its doc_id: 64 bits of its columns and of which are null. Only rows of one doc_id are told apart by it."""
    return F.xxhash64(*(F.col(c).isNull() for c in columns), *columns)


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no recomputation.

    ``cut`` writes a frame and reads it back; ``drop`` deletes tables that no later plan reads. Tables that the frame returned to
    the caller still reads stay; they lie under the folder of spark.checkpoint.dir, which the cluster clears with the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Up to this many edges (16 bytes each) components are settled by one task; more are settled by all.
LOCAL_EDGES = 2_000_000


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) pairs of a bounded number -> (node, component), by hooking roots on smaller ones and halving paths."""
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    pairs = np.concatenate([x[["u", "v"]].to_numpy() for x in parts])
    nodes, at = np.unique(pairs, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    parent = np.arange(nodes.size)
    while True:
        a, b = parent[u], parent[v]
        if (a == b).all():
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    yield pd.DataFrame({"node": nodes, "component": nodes[parent]})


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps: each is a grouped minimum (combined before the shuffle) and
    a join that adaptive execution can split when one node has very many neighbours. Rounds are written to
    the shared folder; only a count and a checksum of each reach the driver. They go on until nothing changes; a given limit raises.
    When the edges, counted first, are at most ``local_edges``, one task does the same without the rounds.
    """
    edges = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if edges.count() <= local_edges:
        return edges.coalesce(1).mapInPandas(_settled, "node long, component long")
    before, whole = None, edges
    edges = scratch.cut(edges.distinct(), "edges")
    scratch.drop(whole)
    for done in itertools.count():
        if done == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.cut(small, "edges")
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
