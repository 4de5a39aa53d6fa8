"""Incremental ingest: new frame files of a folder become trajectories, batch by batch, through the ordinary commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.operators.corpus import Corpus
from framewright.schema import TRAJ


def ingest_stream(corpus: Corpus, folder: str, checkpoint: str, glob: str = "*.con*") -> StreamingQuery:
    """A file's trajectory id is a hash of its path, so a batch that runs again after a failure finds its files stored and skips them."""
    files = corpus.spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    rows = files.select(F.abs(F.xxhash64(F.input_file_name()) % F.lit(2**62)).alias("traj_id"), F.col("value").alias("text"), F.input_file_name().alias("source"))

    def commit(batch: DataFrame, batch_id: int) -> None:
        stored = corpus.store.table(corpus.store.manifest(), "traj_meta", TRAJ).select("traj_id")
        new = batch.join(stored, "traj_id", "left_anti").persist()
        try:
            if not new.isEmpty():
                corpus.append(new)
        finally:
            new.unpersist()

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
