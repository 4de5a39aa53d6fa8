"""First-wins representatives of equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.plans.select import Select, select_keys
from framewright.schema import KEYS


def representatives(frames: DataFrame, order: str = "commit") -> DataFrame:
    """(content_hash, traj_id, frame_idx): the first committed frame of each hash, or with order="key" the smallest key.

    A grouped minimum: partial minima are taken before the shuffle, so one content that fills the corpus moves one row a task.
    """
    first = F.struct("commit_seq", *KEYS) if order == "commit" else F.struct(*KEYS)
    return frames.where("content_hash is not null").groupBy("content_hash").agg(F.min(first).alias("f")).select("content_hash", *(f"f.{k}" for k in KEYS))


def mark_representatives(frames: DataFrame, order: str = "commit") -> DataFrame:
    """frames with is_rep recomputed."""
    reps = representatives(frames, order).select(*KEYS, F.lit(True).alias("rep_"))
    return frames.drop("is_rep").join(reps, KEYS, "left").withColumn("is_rep", F.coalesce("rep_", F.lit(False))).drop("rep_")


def unique_frame_keys(frames: DataFrame, sel: Select, n_shards: int | None = None) -> DataFrame:
    """Selected keys (limited first) that represent their content in the whole corpus."""
    return select_keys(frames, sel, n_shards, "is_rep").where("is_rep").select(*KEYS)
