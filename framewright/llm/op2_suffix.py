"""Exact removal of repeated 400-byte strings by a distributed, common-prefix-aware merge sort of sampled suffixes.

Sorting the suffix at every byte would move hundreds of bytes for each byte of input. The suffixes are therefore
sampled so that no repeat can be missed: of the ``LENGTH - GRAM + 1`` GRAM-byte strings inside a LENGTH-byte window,
the one with the smallest hash is the window's anchor. Equal windows have equal anchors at equal offsets, so a window
repeats only if its anchor's hash does, and comparing the suffixes at anchors (with the window starts that belong to
them) finds every repeat of every window.

1. every document's anchors; hashes that occur once in the corpus are dropped (their windows are unique);
2. each task sorts the suffixes at the remaining anchors (hash, then bytes) and front-codes the sorted run: every
   suffix is stored as the length of the prefix it shares with the one before and the bytes after it;
   Of equal contexts within a task one travels, for all: their windows are repeated already;
3. runs are exchanged by anchor hash, and each receiver combines them with a loser tree whose matches compare
   only bytes beyond the prefix both sides are known to share with the last winner;
4. neighbours in the merged order that share whole contexts are repeats at once; anchors with several contexts
   group their windows by hash and compare the bytes of each group, so that nothing but equal bytes is removed;
5. repeated windows, as intervals, return to their documents and are cut out.

Hot anchors (more than ``HOT`` occurrences) are exchanged in slices of ``SLICE`` window offsets, by the bytes that all windows
of the slice contain; slices that occur once are dropped like anchors. A slice that is hot too and has several contexts (a
passage's end with different bytes after it) is cut once more, into slices of ``FINE`` offsets. So what meets at one key
is few occurrences, or copies of one context, of which a task sends one, or contexts that differ in ``FINE`` - 1 bytes at
either end only, of which there are at most 256 ** 2.

Texts are read in stretches of ``STRETCH`` bytes that overlap by a window, so memory does not follow the longest text.

Cases: a null or empty text has no bytes and keeps the empty string; repeats inside one document count, and may
overlap; rows are known by doc_id and text together, so repeated rows of one doc_id (also of a null one) repeat each other,
and different texts of one doc_id are documents each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import textkit as K
from framewright.llm.common import Scratch, row_hash, table

LENGTH, GRAM = 400, 145
#: What a document is: its doc_id without nulls, and a hash of its doc_id's nullness and text.
ID = ["doc", "x"]
#: Suffix records of one exchanged run; about this many anchors are merged by a task at once.
GROUP_ROWS = 30_000
#: Anchors with more occurrences are split by window offset and by the bytes common to the windows of a slice.
HOT, SLICE, FINE = 4096, 32, 2
STRETCH = 4 << 20
#: Windows compared at once: the arrays for them take about 80 bytes each.
SEGMENT_WINDOWS = 500_000


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over values[i:i+size] for every i, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window start, last window start) of a text's anchors, by position.

    A window belongs to the rightmost of its smallest gram hashes. An anchor whose windows lie in two stretches is two.
    """
    n = data.size - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    if n > STRETCH:
        parts = [(at, anchors(data[at : at + STRETCH + length - 1], length, gram)) for at in range(0, n, STRETCH)]
        return tuple(np.concatenate([x[k] + (at if k else 0) for at, x in parts]) for k in range(4))
    prefix = K.prefix_hash(K.BYTE[data])
    at = np.arange(data.size - gram + 1)
    h = K.span_hash(prefix, at, at + gram)
    low = _sliding(h, length - gram + 1, np.minimum)
    # Rightmost position of the minimum: the last occurrence of low[i] at or before i + length - gram.
    is_anchor = np.zeros(h.size, bool)
    w = length - gram + 1
    padded = np.concatenate((np.zeros(w - 1, K.U64), low, np.zeros(w - 1, K.U64)))
    is_anchor = _sliding(padded, w, np.maximum) == h
    pos = np.flatnonzero(is_anchor)
    # The anchor of window i is the rightmost candidate in [i, i + w) whose hash is low[i]; candidates in a window
    # with a larger hash than low[i] come before or after it, so walk back from the last candidate inside.
    last = np.searchsorted(pos, np.arange(n) + w, "left") - 1
    wrong = np.flatnonzero(h[pos[last]] != low)
    while wrong.size:
        last[wrong] -= 1
        wrong = wrong[h[pos[last[wrong]]] != low[wrong]]
    owners, first = np.unique(last, return_index=True)
    # The windows of one anchor are contiguous: both ends of the range move right with it.
    end = np.concatenate((first[1:], [n])) - 1
    return h[pos[owners]].view(np.int64), pos[owners], first, end


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, x, hs array<long>): the anchor hashes of every document, without repeats beyond two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(2)):
                parts = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    h, n = np.unique(anchors(data[a:b])[0], return_counts=True)
                    parts.append(np.concatenate((h, h[n > 1])))
                first = np.concatenate(([0], np.cumsum([p.size for p in parts])))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), K.list_array(np.concatenate(parts), first)], ["doc", "x", "hs"])

    return docs.select(*ID, "text").mapInArrow(run, "doc long, x long, hs array<long>")


def front_code(keys: np.ndarray, suffixes: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of sorted (key, suffix): shared prefix lengths, the bytes beyond them, and their lengths."""
    shared = np.zeros(len(suffixes), np.int32)
    parts = []
    before, key = b"", None
    for i, s in enumerate(suffixes):
        n = 0
        if keys[i] == key:
            n = common(before, s, 0)
        shared[i] = n
        parts.append(s[n:])
        before, key = s, keys[i]
    return shared, b"".join(parts), np.fromiter(map(len, parts), np.int32, len(parts))


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``: galloping over slice comparisons."""
    n, end, step = start, min(len(a), len(b)), 16
    while n < end:
        m = min(end, n + step)
        if a[n:m] == b[n:m]:
            n, step = m, step * 4
        elif m - n == 1:
            return n
        else:
            step = max(1, (m - n) // 2)
    return n


class Run:
    """A sorted front-coded run, read one suffix at a time."""

    __slots__ = ("at", "bytes", "data", "i", "key", "keys", "lengths", "no", "shared", "suffix")

    def __init__(self, no: int, keys: np.ndarray, shared: np.ndarray, lengths: np.ndarray, data: bytes):
        self.no, self.keys, self.shared, self.lengths, self.data = no, keys.tolist(), shared.tolist(), lengths.tolist(), data
        self.i, self.at, self.suffix, self.key = -1, 0, b"", None
        self.step()

    def step(self) -> int:
        """Moves on; returns the prefix the new suffix shares with the one before, -1 if the key changed or the run ended."""
        self.i += 1
        if self.i >= len(self.keys):
            self.key = None
            return -1
        n, m, key = self.shared[self.i], self.lengths[self.i], self.keys[self.i]
        self.suffix = self.suffix[:n] + self.data[self.at : self.at + m]
        self.at += m
        same = key == self.key
        self.key = key
        return n if same else -1


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """(key, run, index, prefix shared with the output before; -1 for a new key), in order of (key, suffix).

    A loser tree. Every contender carries the length of the prefix it shares with the last winner: of two with
    the same key, the longer shared prefix is the smaller suffix and no byte is compared; with equal lengths the
    comparison starts there, and the loser keeps the prefix it turned out to share with the one that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    live: list[Run | None] = [*runs, *[None] * (k - len(runs))]
    known = [-1 if r and r.key is not None else -2 for r in live]  # -1: nothing known; -2: ended
    loser = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; sets the loser's shared prefix to what it shares with the winner."""
        x, y = live[a], live[b]
        if known[b] == -2:
            return True
        if known[a] == -2:
            return False
        if x.key != y.key:
            if x.key < y.key:
                known[b] = -1
                return True
            known[a] = -1
            return False
        p, q = known[a], known[b]
        if p > q:  # both relative to the last winner; q stays what b shares with a
            return True
        if p < q:
            return False
        n = common(x.suffix, y.suffix, max(p, 0))
        if x.suffix[n : n + 1] < y.suffix[n : n + 1] or (n == len(x.suffix) == len(y.suffix) and a < b):
            known[b] = n
            return True
        known[a] = n
        return False

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            loser[node] = b
            return a
        loser[node] = a
        return b

    top = build(1) if k > 1 else 0
    last = None
    while known[top] != -2:
        r = live[top]
        yield r.key, r.no, r.i, (known[top] if r.key == last else -1)
        last = r.key
        n = r.step()
        known[top] = -2 if r.key is None else n
        node = (top + k) // 2
        while node >= 1:
            other = loser[node]
            if not beats(top, other):
                loser[node], top = top, other
            node //= 2


def sorted_run(rows: list[tuple]) -> tuple[dict, list[tuple[int, int, int]]]:
    """One front-coded run of distinct contexts, and FOUND rows of those that occur twice here.

    rows: (key, suffix, bytes before the anchor back to the first window, doc, x, first window, last window).
    """
    rows.sort(key=lambda r: r[:3])
    kept, found, i = [], [], 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][:3] == rows[i][:3]:
            j += 1
        if j > i + 1:
            found += [(r[3], r[4], r[5], r[6] + LENGTH) for r in rows[i:j]]
        kept.append((*rows[i][:6], j - i))
        i = j
    keys = np.array([r[0] for r in kept], np.int64)
    shared, data, lengths = front_code(keys, [r[1] for r in kept])
    meta = np.array([[r[3], r[4], r[5], r[6], len(r[2])] for r in kept], np.int64)
    return {"keys": keys.tobytes(), "shared": shared.tobytes(), "lengths": lengths.tobytes(), "data": data, "left": b"".join(r[2] for r in kept), "meta": meta.tobytes()}, found


def slices(key: int, data: bytes, p: int, a: int, b: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(key of its own, first window, last window) for each slice of ``step`` offsets of the windows a to b around the anchor at p."""
    for low in range((p - b) // step * step, p - a + 1, step):
        core = data[p - low : p - low - step + 1 + LENGTH]  # in every window that starts low to low + step - 1 bytes before p
        own = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=(key % 2**64).to_bytes(8, "little") + bytes([step, low // step])).digest(), "little", signed=True)
        yield own, max(a, p - low - step + 1), min(b, p - low)


def slice_rows(docs: DataFrame) -> DataFrame:
    """(ID, text, hot: anchor hashes, deep: keys of their slices or null) -> (ID, key, whole) of the slices of hot anchors, or with ``deep`` of the finer slices of these; whole is a hash of all bytes of the slice's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc, x, text, hot, deep = (batch.column(c)[at].as_py() for c in range(5))
                data, out = (text or "").encode(), []
                h, pos, first, last = anchors(np.frombuffer(data, np.uint8))
                for i in np.flatnonzero(np.isin(h, np.array(hot, np.int64))).tolist():
                    p, own = int(pos[i]), slices(int(h[i]), data, int(pos[i]), int(first[i]), int(last[i]), SLICE)
                    if deep is not None:
                        wanted = set(deep)
                        own = [fine for key, a, b in own if key in wanted for fine in slices(key, data, p, a, b, FINE)]
                    out += [(key, int.from_bytes(hashlib.blake2b(data[a : b + LENGTH], digest_size=8).digest(), "little", signed=True)) for key, a, b in own]
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(out), pa.int64()) for v in (doc, x)), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1))], [*ID, "key", "whole"])

    return docs.select(*ID, "text", "hot", "deep").mapInArrow(run, "doc long, x long, key long, whole long")


RUN = "part long, keys binary, shared binary, lengths binary, data binary, left binary, meta binary"
FOUND = "doc long, x long, start long, stop long"


def run_rows(docs: DataFrame, parts: int) -> DataFrame:
    """docs (ID, text; repeated keys: hs of anchors, slices of the hot ones, fine ones of the slices ``deep``) -> RUN rows, one for each part a task has suffixes of.

    Rows of a negative part carry FOUND rows in ``meta``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RUN.replace(",", "").split()[::2]
        held: dict[int, list] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part in sorted(held):
                got, found = sorted_run(held[part])
                empty = dict.fromkeys(names, b"")
                for row in [empty | got | {"part": part}, *([empty | {"part": -1 - part, "meta": np.array(found, np.int64).tobytes()}] if found else [])]:
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], pa.int64() if n == "part" else pa.binary()) for n in names], names)
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                doc, x, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), (batch.column(2)[at].as_py() or "").encode()
                wanted, hot, *sliced = (batch.column(c)[at].as_py() or [] for c in range(3, 8))
                coarse, deep, fine = map(set, sliced)
                hot = set(hot)
                h, pos, first, last = anchors(np.frombuffer(data, np.uint8))
                for i in np.flatnonzero(np.isin(h, np.array(wanted, np.int64))).tolist():
                    key, p, a, b = (int(v[i]) for v in (h, pos, first, last))
                    units = [(key, a, b)]
                    if key in hot:
                        own = list(slices(key, data, p, a, b, SLICE))
                        units = [u for u in own if u[0] in coarse]
                        units += [f for u in own if u[0] in deep for f in slices(u[0], data, p, u[1], u[2], FINE) if f[0] in fine]
                    for own, a, b in units:
                        held.setdefault(own % parts, []).append((own, data[p : b + LENGTH], data[a:p], doc, x, a, b))
                    count += len(units)
                    if count >= 2 * GROUP_ROWS:
                        yield from flush()
                        count = 0
        yield from flush()

    return docs.select(*ID, "text", "hs", "hot", "coarse", "deep", "fine").mapInArrow(run, RUN)


def windows_repeat(contexts: list[bytes], lefts: list[int], spans: list[int], groups: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every window of every context (context c has spans[c] windows, the first at its byte 0): whether it repeats.

    contexts: bytes from the first window's start to the last window's end; lefts: bytes before the anchor; groups: the
    anchor of each; weight: how many times the very context occurs.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))[:-1]
    spans_, lefts_ = np.array(spans), np.array(lefts)
    begin = np.concatenate(([0], np.cumsum(spans_)))
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], spans_)
    start = np.repeat(base, spans_) + inner
    offset = np.repeat(lefts_, spans_) - inner  # from the window's start to the anchor
    key = K.span_hash(K.prefix_hash(K.BYTE[data]), start, start + LENGTH)
    key = K.mix(key + K.mix(np.repeat(groups.astype(K.U64), spans_) * K.U64(1024) + offset.astype(K.U64)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    flags = np.repeat(weight, spans_) > 1
    wrong = equal_pairs(b"".join(contexts), start, order[same], order[same + 1], flags)
    for k in np.unique(key[wrong]):  # windows of one hash and different bytes
        own: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(key == k):
            own.setdefault(data[start[i] : start[i] + LENGTH].tobytes(), []).append(i)
        for alike in own.values():
            if len(alike) > 1:
                flags[alike] = True
    return flags


def equal_pairs(data: bytes, start: np.ndarray, one: np.ndarray, two: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Compares the windows one[i] and two[i] byte by byte; flags both of the equal ones and returns members of the other pairs.

    Pairs that follow each other in both contexts are compared as one stretch.
    """
    if not one.size:
        return np.zeros(0, np.int64)
    by = np.argsort(two, kind="stable")
    one, two = one[by], two[by]
    s, t = start[one], start[two]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(s) != 1) | (np.diff(t) != 1))))
    bad = []
    for i, j in zip(head.tolist(), [*head[1:].tolist(), s.size], strict=True):
        a, b, n = int(s[i]), int(t[i]), j - i - 1 + LENGTH
        if data[a : a + n] == data[b : b + n]:
            flags[one[i:j]] = flags[two[i:j]] = True
            continue
        for k in range(i, j):
            a, b = int(s[k]), int(t[k])
            if data[a : a + LENGTH] == data[b : b + LENGTH]:
                flags[one[k]] = flags[two[k]] = True
            else:
                bad.append(two[k])
    return np.array(bad, np.int64)


def repeats(part: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of one part; FOUND rows: repeated windows' byte ranges."""
    if len(part) and part["part"].iloc[0] < 0:
        return pd.DataFrame(np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 4) for m in part["meta"]]), columns=[*ID, "start", "stop"])
    runs, metas, lefts = [], [], []
    for no, r in enumerate(part.itertuples(index=False)):
        runs.append(Run(no, np.frombuffer(r.keys, np.int64), np.frombuffer(r.shared, np.int32), np.frombuffer(r.lengths, np.int32), r.data))
        metas.append(np.frombuffer(r.meta, np.int64).reshape(-1, 5))
        lefts.append((r.left, np.concatenate(([0], np.cumsum(metas[-1][:, 4])))))
    out: list[np.ndarray] = []
    # Contexts of the anchors merged so far: {(suffix, left): [members]} of the present key; then resolved together.
    contexts: list[bytes] = []
    left_sizes: list[int] = []
    spans: list[int] = []
    groups: list[int] = []
    members: list[list[tuple[int, int]]] = []
    load = 0

    def resolve() -> None:
        nonlocal load
        if contexts:
            weight = np.array([sum(int(metas[n][i, 3]) for n, i in m) for m in members])
            hit = windows_repeat(contexts, left_sizes, spans, np.array(groups), weight)
            begin = np.concatenate(([0], np.cumsum(spans)))
            for c, own in enumerate(members):
                flags = hit[begin[c] : begin[c + 1]]
                if flags.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                    ranges = edges.reshape(-1, 2)
                    got = np.array([metas[n][i, :3] for n, i in own])
                    start = got[:, 2]
                    for a, b in ranges:
                        out.append(np.stack([got[:, 0], got[:, 1], start + a, start + b - 1 + LENGTH], axis=1))
        for x in (contexts, left_sizes, spans, groups, members):
            x.clear()
        load = 0

    present, group, seen, suffix = None, -1, {}, b""
    for key, no, i, known in merge(runs):
        r = runs[no]
        if key != present:
            if load >= SEGMENT_WINDOWS:
                resolve()
            present, group, seen = key, group + 1, {}
        if known < len(r.suffix) or len(suffix) != len(r.suffix):  # else the whole suffix is the one before
            seen = {}
            suffix = r.suffix
        blob, ends = lefts[no]
        left = blob[ends[i] : ends[i + 1]]
        at = seen.get(left)
        if at is None:
            seen[left] = at = len(contexts)
            contexts.append(left + suffix)
            left_sizes.append(len(left))
            spans.append(len(left) + len(suffix) - LENGTH + 1)
            groups.append(group)
            members.append([])
            load += spans[-1]
        members[at].append((no, i))
    resolve()
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pd.DataFrame(found, columns=[*ID, "start", "stop"])


def cut_out(rows: DataFrame) -> DataFrame:
    """(doc_id, text, spans array<struct<start, stop>> or null) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for at in range(batch.num_rows):
                data, kept, end, removed, spans = (batch.column(1)[at].as_py() or "").encode(), [], 0, 0, 0
                held = None
                for a, b in sorted((s["start"], s["stop"]) for s in batch.column(2)[at].as_py() or []):
                    if held and a <= held[1]:
                        held[1] = max(held[1], b)
                        continue
                    if held:
                        kept.append(data[end : held[0]])
                        removed, spans, end = removed + held[1] - held[0], spans + 1, held[1]
                    held = [a, b]
                if held:
                    kept.append(data[end : held[0]])
                    removed, spans, end = removed + held[1] - held[0], spans + 1, held[1]
                kept.append(data[end:])
                got.append((len(data), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.string() if k == 3 else pa.int64()) for k in range(4))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def sliced(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """wanted (ID, hs, hot) with coarse, deep and fine: the keys of slices that occur more than once."""
    none = F.lit(None).cast("array<long>")
    hot = wanted.where(F.size("hot") > 0).select(*ID, "hot")
    if hot.isEmpty():
        return wanted.select("*", none.alias("coarse"), none.alias("deep"), none.alias("fine"))
    first = scratch.cut(slice_rows(docs.select(*ID, "text").join(hot.withColumn("deep", none), ID)), "slices")
    counted = first.groupBy("key").agg(F.count("*").alias("n"), (F.min("whole") < F.max("whole")).alias("mixed")).where("n > 1")
    deeper = (F.col("n") > HOT) & F.col("mixed")
    first = first.join(counted, "key").groupBy(*ID).agg(F.collect_set(F.when(~deeper, F.col("key"))).alias("coarse"), F.collect_set(F.when(deeper, F.col("key"))).alias("deep"))
    first = scratch.cut(first, "coarse")
    second = scratch.cut(slice_rows(docs.select(*ID, "text").join(hot.join(first.where(F.size("deep") > 0).select(*ID, "deep"), ID), ID)), "slices")
    again = second.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    second = second.join(again, "key").groupBy(*ID).agg(F.collect_set("key").alias("fine"))
    return wanted.join(first, ID, "left").join(second, ID, "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), row_hash("doc_id", "text").alias("x"), "doc_id", "text")
    hs = scratch.cut(anchor_rows(docs), "anchors")
    flat = hs.select(*ID, F.explode("hs").alias("h"))
    twice = flat.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    wanted = flat.join(twice, "h").groupBy(*ID).agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("n") > HOT, F.col("h"))).alias("hot"))
    wanted = scratch.cut(wanted, "repeated")
    scratch.drop(hs)
    wanted = scratch.cut(sliced(docs, wanted, scratch), "wanted")
    total = wanted.agg(F.sum(F.size("hs") + F.coalesce(F.size("coarse"), F.lit(0)) + F.coalesce(F.size("fine"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-total // GROUP_ROWS))
    runs = run_rows(docs.join(wanted, ID), parts)
    found = runs.groupBy("part").applyInPandas(repeats, FOUND)
    spans = scratch.cut(found.groupBy(*ID).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    scratch.drop(wanted)
    return cut_out(docs.join(spans, ID, "left").select("doc_id", "text", "spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
