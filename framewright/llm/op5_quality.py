"""Quality classifier: a generalised additive model with pairwise interactions over cheap text statistics.

Training is cyclic boosting: in each round every feature in turn gets one shallow tree (at most two levels of
splits) on its bins, fitted to the present residuals, so each feature ends as a lookup table; then the pairs with the
largest remaining gain get tables over two features the same way. A score is the sum of one table entry for each
feature and pair, looked up for a whole batch at once.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``MAX_TRAIN`` of them (a seeded, documented
sample); every document is scored on its whole text. Labels, lang, source and doc_id are never inputs of a score.

Cases: null and empty texts score as a text without words; without labels of both classes the score is the share of
label 1 (0.5 without labels); repeated rows are scored alike; labels of unknown doc_ids and null labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import textkit as K
from framewright.llm.common import table

MAX_TRAIN, THRESHOLD = 20_000, 0.3
BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 32, 8, 120, 8, 0.1

_CLASS = np.zeros((6, 256), np.int32)
_CLASS[0, 65:91] = 1  # upper case
_CLASS[1, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 1  # symbols
_CLASS[2, 48:58] = 1
_CLASS[3, [ord(c) for c in "!?"]] = 1
_CLASS[4, [ord(c) for c in ".,;:"]] = 1
_CLASS[5, 10] = 1
FEATURES = ["log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "shouts", "stops", "lines", "distinct_words", "adjacent_equal", "distinct_pairs", "top_word", "upper_words", "symbol_words", "shout_words", "long_words", "worst_upper", "worst_symbols", "worst_shouts", "worst_equal"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x FEATURES of the texts in one chunk."""
    n = offsets.size - 1
    size = np.maximum(np.diff(offsets), 1)
    chars = np.stack([_sums(c[data], offsets) for c in _CLASS], axis=1)
    h, first = K.words(data, offsets)
    count = np.diff(first)
    words = np.maximum(count, 1)
    equal = np.zeros(h.size, np.int8)
    equal[1:] = h[1:] == h[:-1]
    pairs = h.copy()
    pairs[1:] = K.mix(h[1:] * K.U64(31) + h[:-1])
    # A text's first word has none before it.
    opening = first[:-1][count > 0]
    equal[opening], pairs[opening] = 0, h[opening]
    # Per word: does it hold an upper case letter that is not its first, a symbol, a shout.
    starts, ends = K.word_bounds(data, offsets)
    marks = np.zeros((4, h.size), np.int8)
    for k, c in ((0, 0), (1, 1), (2, 3)):
        run = np.concatenate(([0], np.cumsum(_CLASS[c][data], dtype=np.int64)))
        hits = run[ends] - run[starts]
        marks[k] = hits > (1 if c == 0 else 0)
    marks[3] = (ends - starts) > 24
    marked = [_sums(m, first) for m in marks]
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = np.log1p(np.diff(offsets)), np.log1p(count)
    out[:, 2] = (np.diff(offsets)) / words
    out[:, 3:9] = chars / size[:, None]
    equals = _sums(equal, first)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            u, c = np.unique(h[a:b], return_counts=True)
            out[i, 9], out[i, 12] = u.size / (b - a), c.max() / (b - a)
            out[i, 11] = np.unique(pairs[a:b]).size / (b - a)
            # The worst stretch of 32 words, for junk inside a longer text.
            if b - a > 32:
                for k, m in ((17, marks[0]), (18, marks[1]), (19, marks[2]), (20, equal)):
                    run = np.concatenate(([0], np.cumsum(m[a:b], dtype=np.int64)))
                    out[i, k] = (run[32:] - run[:-32]).max() / 32
            else:
                out[i, 17:21] = marks[0][a:b].mean(), marks[1][a:b].mean(), marks[2][a:b].mean(), equal[a:b].mean()
    out[:, 10] = equals / words
    for k in range(4):
        out[:, 13 + k] = marked[k] / words
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    prior: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Step values for the bins of one feature: the best splits of the gradient sums, ``depth`` levels deep."""
    out = np.full(g.size, g.sum() / (h.sum() + ridge))
    if depth == 0 or g.size < 2:
        return out
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + ridge) + (g.sum() - cg) ** 2 / (h.sum() - ch + ridge)
    k = int(np.argmax(gain)) + 1
    return np.concatenate((_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of each of two features: gain and step values of the four quadrants."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, table_ = -1.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            q = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*q, strict=True))
            if gain > best:
                best = gain
                v = [a / (b + ridge) for a, b in zip(*q, strict=True)]
                table_ = np.zeros_like(g)
                table_[: i + 1, : j + 1], table_[: i + 1, j + 1 :], table_[i + 1 :, : j + 1], table_[i + 1 :, j + 1 :] = v
    return best, table_


def train(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(prior=float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)))
    m = Model(prior=float(y.mean()))
    m.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = m.bins(x)
    width = [c.size + 1 for c in m.cuts]
    m.coarse = [np.minimum(np.arange(w) * PAIR_BINS // w, PAIR_BINS - 1) for w in width]
    m.tables = [np.zeros(w) for w in width]
    f = np.full(len(y), np.log(m.prior / (1 - m.prior)))
    for _ in range(ROUNDS):
        for j, w in enumerate(width):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _tree(np.bincount(b[:, j], y - p, w), np.bincount(b[:, j], p * (1 - p), w), 2)
            m.tables[j] += step
            f += step[b[:, j]]
    rough = np.stack([c[b[:, j]] for j, c in enumerate(m.coarse)], axis=1)
    p = 1 / (1 + np.exp(-f))
    shape = (PAIR_BINS, PAIR_BINS)

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        at = rough[:, i] * PAIR_BINS + rough[:, j]
        return np.bincount(at, y - p, PAIR_BINS**2).reshape(shape), np.bincount(at, p * (1 - p), PAIR_BINS**2).reshape(shape)

    d = x.shape[1]
    gains = sorted(((_quadrants(*grids(i, j))[0], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    m.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    m.pair_tables = [np.zeros(shape) for _ in m.pairs]
    for _ in range(ROUNDS // 4):
        for k, (i, j) in enumerate(m.pairs):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _quadrants(*grids(i, j))[1]
            m.pair_tables[k] += step
            f += step[rough[:, i], rough[:, j]]
    return m


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Trained on the driver from at most ``max_rows`` feature rows: the labelled ones outside the held-out fold with the smallest hashes."""
    usable = labels.where("quality is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = {r.doc_id: int(r.quality) for r in chosen.collect()}
    if not ids:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long"))
    rows = sorted((r.doc_id, list(r.x)) for r in feature_rows(docs.join(wanted, "doc_id", "left_semi")).toLocalIterator())
    return train(np.array([x for _, x in rows]).reshape(-1, len(FEATURES)), np.array([ids[i] for i, _ in rows], float))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """SCORED rows, one for each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes of tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.score(features(data, offsets)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns, in one pass and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(shared.value.score(features(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
