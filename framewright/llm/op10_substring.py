"""Substring dedup by paragraph MinHash banding and word windows: repeated paragraphs and passages are cut out, one occurrence stays.

Two kinds of pieces are compared; words are what white space parts:

* whole paragraphs of at least ``MIN_WORDS`` words (lines, and blocks of several lines, see ``paragraphs``): MinHash bands
  (tuned so that a pair of similarity 0.8 is missed with probability 2e-4) propose pairs, exact Jaccard of their five-word
  shingles confirms them at ``percent``, and connected components group them; every paragraph but the first of its
  component is removed;
* passages inside different paragraphs: every window of ``MIN_WORDS`` words, wherever it starts, so sentence and line
  ends do not matter. A window is served by its anchor, the ``GRAM`` words of smallest hash in it (about one word in
  eleven is an anchor). Only anchors that occur again matter; equal anchors with equal served words are one class, of
  which all but the first are repeats; where an anchor has several classes, the windows of their firsts are compared.
  Classes, windows and equal paragraphs are known by 128 bits.

Every word of a removed paragraph or of a window that was seen before goes; so nothing shorter than ``MIN_WORDS`` words
does, and common short lines stay. "First" is the smallest (doc_id, position). Equal pieces are one class before bands or
pairs are made, and a document's occurrences of a class are one row, so a passage that a third of all documents share, or
one document many times, costs one counted row for each document and no pairs.

Cases: a null text stays null and counts as empty; an empty text is unchanged; repeats inside one document count;
rows with the same doc_id and text are judged as one document, other rows of a doc_id each on their own (ordered by a
hash of the text); a null doc_id stands after all others; words are compared with A-Z folded; a text's own last line end stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from framewright.llm import textkit as K
from framewright.llm.common import Scratch, row_hash, table
from framewright.llm.near import PARAGRAPHS, near_components

MIN_WORDS = 30
#: Words of an anchor. A window has MIN_WORDS - GRAM + 1 of them, which is below SPAN.
GRAM = 10
#: A run of windows is packed as first window * SPAN + number of windows.
SPAN = 32
#: What a document is, without nulls: its doc_id, and a hash of its text (and of whether the doc_id is null).
ID = ["doc", "x"]


def identified(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """ID, doc_id, text and ``carry``."""
    return docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), row_hash("doc_id", "text").alias("x"), "doc_id", "text", *carry)


#: The second hash of words: a class, a window or a paragraph is known by 128 bits.
SEED = 0x5EED


def anchors(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two word hashes of texts -> anchor hash, class (two hashes of the anchor and all words of the windows it serves), packed run of windows; and each text's first."""
    n = hashes.size - MIN_WORDS + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(first.size, np.int64)
    at = np.arange(hashes.size - GRAM + 1)
    grams = K.tree(hashes, at, np.full(at.size, GRAM))
    # The leftmost smallest of each MIN_WORDS - GRAM + 1 grams, by doubling.
    low, width, size = grams, 1, MIN_WORDS - GRAM + 1
    while width < size:
        step = min(width, size - width)
        take = low[step:] < low[:-step]
        low, at = np.where(take, low[step:], low[:-step]), np.where(take, at[step:], at[:-step])
        width += step
    text = np.repeat(np.arange(first.size - 1), np.diff(first))
    start = np.flatnonzero(text[:n] == text[MIN_WORDS - 1 :])
    if not start.size:
        return none, none, none, none, np.zeros(first.size, np.int64)
    at, text = at[start], text[start]
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(head, start.size))
    start, at, text = start[head], at[head], text[head]
    place = K.mix((at - start).astype(np.uint64) * K.U64(SPAN) + count.astype(np.uint64) + K.U64(1))
    one, two = (K.mix(K.tree(h, start, count - 1 + MIN_WORDS) ^ place).view(np.int64) for h in (hashes, second))
    return grams[at].view(np.int64), one, two, (start - first[text]) * SPAN + count, np.searchsorted(text, np.arange(first.size))


def gathered(ah: np.ndarray, ac: np.ndarray, ac2: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts by position -> one row for each class of a text: ah, ac, ac2, all at in order, where a class's at begin, where a text's classes begin."""
    text = np.repeat(np.arange(ends.size - 1), np.diff(ends))
    order = np.lexsort((ac2, ac, ah, text))  # stable, so a class's first occurrence stays in front
    by = [x[order] for x in (text, ah, ac, ac2)]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, order.size), bool), np.any([x[1:] != x[:-1] for x in by], axis=0))))
    return *(x[head] for x in by[1:]), at[order], np.append(head, order.size), np.searchsorted(by[0][head], np.arange(ends.size))


def paragraphs(data: bytes, counts: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs of at least MIN_WORDS words, in order of their starts.

    Every line of so many words is one; so are, between blank lines, the lines of a wrapped block together (each line
    but the last is too full for the next line's first word, and one ends inside a sentence), and otherwise every run
    of at least two shorter lines. A line of a wrapped block is inside of it; no other paragraphs overlap.
    ``counts``: the words of each line, where they are known.
    """
    out, start, block = [], 0, []

    def close() -> None:
        if len(block) > 1:
            full = max(len(x) for _, x, _ in block)
            wrapped = all(len(a[1]) + 1 + len(b[1].split(None, 1)[0]) > full for a, b in zip(block[:-1], block[1:], strict=True)) and any(x[-1:] not in b".!?:;" for _, x, _ in block[:-1])
            run = []
            for line in [*block, None]:
                if line and (wrapped or line[2] < MIN_WORDS):
                    run.append(line)
                    continue
                if len(run) > 1 and sum(n for _, _, n in run) >= MIN_WORDS:
                    out.append((run[0][0], run[-1][0] + len(run[-1][1])))
                run = []
        out.extend((at, at + len(x)) for at, x, n in block if n >= MIN_WORDS)
        block.clear()

    lines = data.split(b"\n")
    for line, n in zip(lines, counts or [len(x.split()) for x in lines], strict=True):
        if n:
            block.append((start, line.rstrip(), n))
        else:
            close()
        start += len(line) + 1
    close()
    return sorted(out)


def paragraph_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Texts, where their words start and each text's first word -> first word and word after the last of each paragraph, and the number of each text's paragraphs."""
    breaks = np.flatnonzero(data == 10) + 1
    after, of = np.searchsorted(starts, breaks), np.searchsorted(breaks, offsets, "right")
    whole, spans, count = data.tobytes(), [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        counts = np.diff(np.concatenate((first[k : k + 1], after[of[k] : of[k + 1]], first[k + 1 : k + 2]))).tolist()
        own = paragraphs(whole[a:b], counts) if first[k + 1] - first[k] >= MIN_WORDS else []
        spans += [(a + i, a + j) for i, j in own]
        count.append(len(own))
    return np.searchsorted(starts, np.array(spans, np.int64).reshape(-1, 2)), count


HASHED = "doc long, x long, ps array<binary>, keys array<array<long>>, sigs array<array<long>>, ah array<long>, ac array<long>, ac2 array<long>, at array<array<long>>"


def hashed(docs: DataFrame) -> DataFrame:
    """HASHED rows: of the paragraphs of MIN_WORDS words digest, band keys and signature; of the word windows the anchors, one for each class of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = K.MinHash(*PARAGRAPHS)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found, lines, count = [], [], []
                for _, _, bytes_, offsets in K.chunks(part.column(2)):
                    starts, ends = K.word_bounds(bytes_, offsets)
                    one, two = K.hashes_at(bytes_, starts, ends, (0, SEED))
                    first = np.searchsorted(starts, offsets)
                    found.append(anchors(one, first, two))
                    own, n = paragraph_words(bytes_, offsets, starts, first)
                    # A paragraph's words are some of the text's, already hashed.
                    size = own[:, 1] - own[:, 0]
                    begin = np.concatenate(([0], np.cumsum(size)))
                    each = np.repeat(own[:, 0] - begin[:-1], size) + np.arange(begin[-1])
                    digests = np.stack([K.sequence(h[each], begin) for h in (one, two)], 1)
                    lines.append((digests, *sketch(*K.shingles(one[each], begin))))  # repeated shingles change no minimum
                    count += n
                digests, keys, sigs = (np.concatenate([x[k] for x in lines]) for k in range(3))
                ps = pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer((np.arange(len(digests) + 1) * 16).astype(np.int32)), pa.py_buffer(digests.tobytes())])
                ends = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                nested = [pa.ListArray.from_arrays(ends, x) for x in (ps, K.matrix_array(keys), K.matrix_array(sigs))]
                ends = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[4]) for x in found]))))
                *classes, places, begin, ends = gathered(*(np.concatenate([x[k] for x in found]) for k in range(4)), ends)
                served = [*(K.list_array(x, ends) for x in classes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), K.list_array(places, begin))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *nested, *served], [x.split()[0] for x in HASHED.split(", ")])

    return docs.select(*ID, "text").mapInArrow(run, HASHED)


def windows(docs: DataFrame) -> DataFrame:
    """(ID, at, w, w2): the hashes of every window in the packed runs ``runs`` (array<long>) of each document; at is packed for it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for i, j, data, offsets in K.chunks(part.column(2)):
                    lists, (hashes, first) = part.column(3).slice(i, j - i), K.words_by(data, offsets, (0, SEED))
                    runs, text = lists.flatten().to_numpy(), np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                    count = runs % SPAN
                    start = np.repeat(runs // SPAN - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    text = np.repeat(text, count)
                    both = [pa.array(K.tree(h, start + first[text], np.full(start.size, MIN_WORDS)).view(np.int64)) for h in hashes]
                    same = [part.column(k).slice(i, j - i).take(pa.array(text)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(start * SPAN + 1), *both], [*ID, "at", "w", "w2"])

    return docs.select(*ID, "text", "runs").mapInArrow(run, "doc long, x long, at long, w long, w2 long")


def repeated_windows(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(ID, seen): packed runs of the windows of each document that are not the first of their words."""
    # Anchors and windows are dealt by their hash once: what repeats is counted in the same exchange (so it names all columns).
    all_ = rows.select(*ID, F.explode(F.arrays_zip("ah", "ac", "ac2", "at")).alias("a")).select(*ID, "a.ah", "a.ac", "a.ac2", "a.at").repartition("ah")
    again = all_.groupBy("ah").agg(F.expr("count(doc, x)").alias("docs"), F.sum(F.size("at")).alias("n"), ((F.min("ac") < F.max("ac")) | (F.min("ac2") < F.max("ac2"))).alias("mixed")).where("n > 1 and docs > 0").select("ah", "mixed")
    met = scratch.cut(all_.join(again.hint("shuffle_hash"), "ah").select(*ID, "ac", "ac2", "at", "mixed"), "met")
    classes = met.groupBy("ac", "ac2").agg(F.sum(F.size("at")).alias("n"), F.min(F.struct(*ID, F.col("at")[0].alias("at"))).alias("f"), F.max("mixed").alias("mixed"))
    classes = scratch.cut(classes, "classes")
    same = met.join(classes.where("n > 1").select("ac", "ac2", "f"), ["ac", "ac2"]).select(*ID, F.expr("if(doc = f.doc and x = f.x, slice(at, 2, size(at)), at)").alias("at")).where("size(at) > 0")
    runs = scratch.cut(classes.where("mixed").groupBy(*(F.col(f"f.{c}").alias(c) for c in ID)).agg(F.collect_list("f.at").alias("runs")), "runs")
    own = scratch.cut(windows(docs.join(runs, ID).dropDuplicates(ID)), "windows")
    dealt = own.repartition("w", "w2")
    first = dealt.groupBy("w", "w2").agg(F.count("*").alias("n"), F.min(F.struct(*ID, "at")).alias("f")).where("n > 1").select("w", "w2", "f")
    edges = dealt.join(first.hint("shuffle_hash"), ["w", "w2"]).where("struct(doc, x, at) <> f").select(*ID, F.array("at").alias("at"))
    out = scratch.cut(same.unionByName(edges).groupBy(*ID).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("seen")), "seen")
    scratch.drop(met, classes, runs, own)
    return out


def paragraph_texts(docs: DataFrame) -> DataFrame:
    """(id, text) of the paragraphs listed in ``wanted`` (array<struct<pos, id>>) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = (batch.column(0)[at].as_py() or "").encode()
                own = paragraphs(data)
                wanted = [(w["id"], data[slice(*own[w["pos"]])].decode()) for w in batch.column(1)[at].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in wanted], pa.int64()), pa.array([t for _, t in wanted], pa.string())], ["id", "text"])

    return docs.select("text", "wanted").mapInArrow(run, "id long, text string")


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def cleaned(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, near: positions of paragraphs to remove and of their component's first if that is in the same document, seen: runs of windows seen before) -> CLEANED rows and ``carry``."""
    carried = [docs.schema[c] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for text, near, seen in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    data = (text or "").encode()
                    spans = removed_spans(data, [tuple(x.values()) for x in near or ()], seen or []) if near or seen else []
                    kept, end = [], 0
                    for a, b in spans:
                        kept.append(data[end:a])
                        end = b
                    kept = b"".join([*kept, data[end:]])
                    if spans and spans[-1][1] == len(data) and not data.endswith(b"\n"):
                        kept = kept.removesuffix(b"\n")  # the line end that stood before a passage at the text's end
                    rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), text if text is None else kept.decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)), *(part.column(4 + k) for k in range(len(carry)))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *carry])

    schema = StructType([*_parse(CLEANED), *carried])
    return docs.select("doc_id", "text", "near", "seen", *carry).mapInArrow(run, schema)


def _parse(ddl: str) -> list[StructField]:
    kinds = {"long": LongType(), "string": StringType()}
    return [StructField(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


def removed_spans(data: bytes, near: list[tuple[int, int | None]], seen: list[int]) -> list[tuple[int, int]]:
    """Byte ranges of the runs of words to remove: those of windows seen before and of removed paragraphs."""
    starts, ends = K.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    repeated = np.zeros(starts.size, bool)
    for r in seen:
        repeated[r // SPAN : r // SPAN + r % SPAN - 1 + MIN_WORDS] = True
    blocks = paragraphs(data) if near else []
    for k, first in near:
        a, b = blocks[k]
        # A line and the wrapped block around it may be near each other; neither repeats the other.
        if first is None or blocks[first][1] <= a or b <= blocks[first][0]:
            repeated[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
    turn = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
    spans = []
    for i, j in zip(turn[::2], turn[1::2], strict=True):
        line = data.rfind(b"\n", 0, starts[i]) + 1
        opens = not data[line : starts[i]].strip()
        end = int(starts[j]) if j < starts.size else len(data)
        tail = data.find(b"\n", ends[j - 1], end)
        # A run from inside a line leaves the line's end; one of whole lines takes it along, and no indentation of the next.
        end = end if tail < 0 else tail + opens
        spans.append((line if opens else int(starts[i]), end))
    return spans


def remove_repeats(docs: DataFrame, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """CLEANED for every row of (doc_id, text), with the columns in ``carry``."""
    scratch = Scratch(docs.sparkSession, "substring")
    docs = identified(docs, carry)
    rows = scratch.cut(hashed(docs), "hashed")
    seen = repeated_windows(rows, docs, scratch)
    # Paragraphs: one representative for each digest, near components of these, then all but the first of a component.
    own = rows.select(*ID, F.posexplode(F.arrays_zip("ps", "keys", "sigs")).alias("pos", "p")).select(*ID, "pos", "p.ps", F.col("p.keys").alias("keys"), F.col("p.sigs").alias("sig"))
    where = scratch.cut(own.select(*ID, "pos", "ps"), "paragraphs")
    # A class has a number of its own, fixed by writing it.
    at = where.groupBy("ps").agg(F.min(F.struct(*ID, "pos")).alias("f"))
    at = scratch.cut(at.select(F.monotonically_increasing_id().alias("id"), "ps", "f"), "first")
    reps = scratch.cut(own.join(at.select("id", "f.doc", "f.x", "f.pos"), [*ID, "pos"]).dropDuplicates(["id"]).select("id", "keys", "sig"), "reps")
    scratch.drop(rows)

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = ids.join(at, "id").groupBy(*(F.col(f"f.{c}").alias(c) for c in ID)).agg(F.collect_list(F.struct("f.pos", "id")).alias("wanted"))
        return paragraph_texts(docs.select(*ID, "text").join(wanted, ID).dropDuplicates(ID))

    found = near_components(reps, texts_of, percent, scratch, K.MinHash(*PARAGRAPHS))
    named = at.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    firsts = named.groupBy("component").agg(F.min("f").alias("f"))
    named = named.select("ps", "component").join(firsts, "component").select("ps", "f")
    near = where.join(named, "ps").where("struct(doc, x, pos) <> f").groupBy(*ID).agg(F.collect_set(F.expr("struct(pos, if(doc = f.doc and x = f.x, f.pos, null) as first)")).alias("near"))
    near = scratch.cut(near, "near")
    scratch.drop(where, at, reps, found)
    return cleaned(docs.join(near.join(seen, ID, "full_outer"), ID, "left"), carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
