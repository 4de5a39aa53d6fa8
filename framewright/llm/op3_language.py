"""Language identification by rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams (one to three letters, with a mark at each word's ends) in order of
frequency. A text's profile is compared with each language's by the out-of-place distance: the sum of how far each
n-gram's rank is from its rank there, ``TOP`` for one that is missing. The nearest language is the answer; the score
is 1 less its distance over the largest possible one.

Profiles are counted over up to ``TRAIN_TEXTS`` different training texts a language (those with the smallest hashes of
doc_id and text among rows with a lang and crc32(doc_id as text) mod 3 not 1), in parallel; only ``TOP`` rows a language
reach the driver. Every document is judged on its whole text; lang, source and doc_id are never inputs of a prediction.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text when nothing can be learned; ties
of frequency go to the smaller code points, ties of distance to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import row_hash, table

TOP, TRAIN_TEXTS = 300, 1000
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])
MARK = 32


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (up to three code points of 21 bits) and their counts; empty without a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(cp, _LETTER.size - 1)]
    far = cp >= _LETTER.size
    if far.any():
        letter = letter.copy()
        letter[far] = [chr(c).isalpha() for c in cp[far]]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(letter, cp, MARK).astype(np.int64)
    c = np.concatenate(([MARK], c, [MARK]))
    c = c[np.concatenate(([True], (c[1:] != MARK) | (c[:-1] != MARK)))]  # runs of marks are one
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    three = three[c[1:-1] != MARK]  # no n-gram spans two words
    return np.unique(np.concatenate((c[c != MARK], two, three)), return_counts=True)


def profile(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    if grams.size > top:
        floor = np.partition(counts, counts.size - top)[counts.size - top]
        pick = counts >= floor
        grams, counts = grams[pick], counts[pick]
    return grams[np.lexsort((grams, -counts))[:top]]


class Profiles:
    """All languages' ranks by n-gram, for comparing one text with every language at once."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.grams = np.array(sorted({g for p in ranked.values() for g in p}), np.int64)
        self.ranks = np.full((self.grams.size + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, ranked[name]), k] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(*ngrams(text or ""))
        if not own.size or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), self.grams.size - 1)
        there = self.ranks[np.where(self.grams[at] == own, at, self.grams.size)]
        apart = np.where(there < 0, TOP, np.abs(there - np.arange(own.size)[:, None]))
        total = np.minimum(apart, TOP).sum(axis=0)
        best = int(np.argmin(total))
        return self.names[best], float(1 - total[best] / (TOP * own.size))


def learn(docs: DataFrame, top: int = TOP, texts: int = TRAIN_TEXTS) -> Profiles:
    """Profiles from (doc_id, text, lang)."""
    usable = docs.where("lang is not null and text is not null").where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(1)) != 1)
    usable = usable.select("lang", "text", row_hash("doc_id", "text").alias("h"))
    # Of a language with very many rows only those below a hash that twice as many as are wanted stay under; the rest of
    # the choice is among these few. Equal rows have equal hashes and count once.
    share = F.least(F.lit(1.0), F.lit(2.0 * texts) / F.col("n"))
    few = usable.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * 2.0**64 - 2.0**63).alias("limit"))
    below = usable.select("lang", "h").join(few, "lang").where("h <= limit").select("lang", "h").distinct()
    last = below.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts).groupBy("lang").agg(F.max("h").alias("last"))
    chosen = usable.join(last, "lang").where("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                grams, counts = ngrams(batch.column(1)[at].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at].as_py()] * grams.size, pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    ranked: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "r").collect():
        ranked.setdefault(row.lang, []).append(row.gram)
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
