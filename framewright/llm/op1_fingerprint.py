"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph blocks; SQL functions only.

A text's paragraphs (lines), in blocks of up to ``BLOCK_WORDS`` words counted from the paragraph's start, are hashed; the
set of digests goes into a sketch of cells, each holding how many digests fell in and the XOR of them. A digest of 64
bits is 40 bits of hash and 24 check bits of these. Cells come in regions of 4 x ``SUB``; a digest picks one region and
in it one cell of each of the 4 sub-tables.

Two versions are compared by subtracting their cells (counts subtract, XORs combine) and peeling: a cell with
count 1 or -1 whose content passes its check gives up a digest that one version has and the other lacks; it is taken
out of its other cells, which may free more, until all cells are empty. Then, with n and m digests and d recovered
ones, likeness is the Jaccard similarity (n + m - d) / (n + m + d). If cells remain, both versions are sketched again
with twice the regions and another salt, up to ``RETRIES`` times; after that the sets are compared themselves.

All work on a pair is done within its row, over arrays whose length follows the two texts; a region is peeled on its
own, so no step is larger than one region.

Cases: null and empty texts have no digests; two texts without digests are alike (1), one without and one with are
not (0); a table of one row has itself as the next document; rows of one doc_id stand in the order of a hash of their texts
(descending), rows with a null doc_id after all others; equal rows are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, table, utf8

BLOCK_WORDS, SUB, RETRIES = 32, 16, 3
#: Ranges of doc_ids at most, found by quantiles of quantiles; their edges and first ids are broadcast (a few MB).
MAX_CELLS, LEVELS = 1 << 16, 3
#: Digests of both versions together that a region is sized for; it peels reliably up to about twice as many.
LOAD = 24
_BLOCK = rf"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){{1,{BLOCK_WORDS}}}"
_H40, _CHECK = 0xFFFFFFFFFF, 0xFFFFFF


def _digests(text: str) -> str:
    """Sorted distinct 64-bit digests of a text's blocks: 40 bits of hash above 24 check bits."""
    h = f"transform(regexp_extract_all({text}, r'{_BLOCK}', 0), b -> xxhash64(rtrim(b)) & {_H40}L)"
    return f"sort_array(array_distinct(transform({h}, h -> shiftleft(h, 24) | (hash(h, 7) & {_CHECK}))))"


def _let(value: str, name: str, body: str) -> str:
    """body with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _regions(n: str, retry: int) -> str:
    """Regions for n digests of both versions, a power of two, doubled with each retry."""
    return f"cast(pow(2, greatest(0, ceil(log2(greatest(1, {n}) / {LOAD}.0))) + {retry}) as int)"


def _place(d: str, salt: int) -> str:
    """64 bits, one for each cell of a region; set for the digest's cell in each of the four sub-tables."""
    return _let(f"hash({d}, {salt + 100})", "w", " | ".join(f"shiftleft(1L, {k * SUB} + (shiftright(w, {4 * k}) & {SUB - 1}))" for k in range(4)))


def _at(place: str, i: str) -> str:
    """Whether a digest of that place belongs in cell i of its region."""
    return f"getbit({place}, {i}) = 1Y"


def _sketch(digests: str, regions: str, salt: int) -> str:
    """Regions of cells: array<array<struct<c int, x long>>>; a region's cells are 4 sub-tables of SUB cells, one after the other.

    Digests are dealt to about sqrt(regions) groups first and from these to regions, so none is looked at once a region.
    """
    placed = f"transform({digests}, d -> named_struct('d', d, 'r', pmod(hash(d, {salt}), regions), 'p', {_place('d', salt)}))"
    cell = f"aggregate(own, named_struct('c', 0, 'x', 0L), (a, e) -> if({_at('e.p', 'i')}, named_struct('c', a.c + 1, 'x', a.x ^ e.d), a))"
    region = _let("filter(part, e -> e.r = g * each + f)", "own", f"transform(sequence(0, {4 * SUB - 1}), i -> {cell})")
    group = _let("if(each = regions, placed, filter(placed, e -> e.r div each = g))", "part", f"transform(sequence(0, each - 1), f -> {region})")
    each = "cast(pow(2, ceil(log2(regions) / 2)) as int)"
    return _let(regions, "regions", _let(placed, "placed", _let(each, "each", f"flatten(transform(sequence(0, regions div each - 1), g -> {group}))")))


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> zip_with(p, q, (u, v) -> named_struct('c', u.c - v.c, 'x', u.x ^ v.x)))"


def _pure(cells: str, salt: int) -> str:
    """(x digest, c sign, p place) of the cells that hold one digest: count and check bits agree."""
    ok = f"abs(z.c) = 1 and (hash(shiftrightunsigned(z.x, 24), 7) & {_CHECK}) = (z.x & {_CHECK})"
    return f"transform(array_distinct(filter({cells}, z -> {ok})), z -> named_struct('c', z.c, 'x', z.x, 'p', {_place('z.x', salt)}))"


_EMPTY = "forall(s.cells, z -> z.c = 0 and z.x = 0L)"


def _peel(region: str, salt: int, rounds: int = 24) -> str:
    """How many digests one region gives up, -1 if cells remain. Every round takes out all that is pure."""
    left = f"transform(s.cells, (z, i) -> aggregate(pure, z, (a, e) -> if({_at('e.p', 'i')}, named_struct('c', a.c - e.c, 'x', a.x ^ e.x), a)))"
    step = _let(_pure("s.cells", salt), "pure", f"if(size(pure) = 0, named_struct('cells', s.cells, 'n', s.n, 'more', false), named_struct('cells', {left}, 'n', s.n + size(pure), 'more', true))")
    state = f"aggregate(sequence(1, {rounds}), named_struct('cells', {region}, 'n', 0, 'more', true), (s, k) -> if(s.more, {step}, s))"
    return _let(state, "s", f"if({_EMPTY}, s.n, -1)")


def _differing(a: str, b: str, n: str) -> str:
    """How many digests differ: peeled from subtracted sketches, larger on failure, at last from the sets themselves."""

    def attempt(k: int) -> str:
        r = _regions(n, k)
        diff = _subtract(_sketch(a, r, k), _sketch(b, r, k))
        counts = f"transform({diff}, g -> {_peel('g', k)})"
        return _let(counts, "t", "if(exists(t, m -> m < 0), null, aggregate(t, 0, (o, m) -> o + m))")

    last = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    return f"coalesce({', '.join(attempt(k) for k in range(RETRIES))}, {last})"


def _likeness(a: str, b: str) -> str:
    n = f"(size({a}) + size({b}))"
    return f"case when {a} = {b} then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {_let(_differing(a, b, n), "apart", f"cast({n} - apart as double) / ({n} + apart)")} end"


def _text(digests: str) -> str:
    """A sketch as a string: digests, regions, then every cell that isn't empty as region.cell:count:xor in hexadecimal."""
    regions = _regions(f"2 * size({digests})", 0)
    cells = f"flatten(transform({_sketch(digests, regions, 0)}, (g, r) -> filter(transform(g, (z, i) -> if(z.c = 0, '', concat(hex(r), '.', hex(i), ':', hex(z.c), ':', hex(z.x)))), t -> t <> '')))"
    return f"concat('iblt1 ', size({digests}), ' ', {regions}, ' ', array_join({cells}, ' '))"


def placed_in_cells(rows: DataFrame, scratch: Scratch, cells: int, rows_a_cell: int) -> DataFrame:
    """rows (key, tie, ...) with ``cell``: numbers that rise with (key, tie), of about rows_a_cell rows each.

    Cells are cut by rank: quantiles of the keys, then quantiles within each of these, ``LEVELS`` times. A cell with
    more rows than twice its share has one key (quantiles repeat); it is cut by ties, and where all its ties are equal
    too, its rows are equal and are dealt out. Edges and sizes are broadcast: at most MAX_CELLS cells and those cuts.
    """
    fan = max(1, min(64, math.ceil(cells ** (1 / LEVELS))))
    keys = rows.select("key", "tie", F.lit(0).cast("long").alias("cell"))
    edges = []
    for _ in range(LEVELS if cells > 1 else 0):
        cut = keys.groupBy("cell").agg(F.percentile_approx("key", [k / fan for k in range(1, fan)], 2000).alias("edges")) if fan > 1 else None
        if cut is None:
            break
        edges.append(scratch.cut(cut, "edges"))
        keys = _deeper(keys, edges[-1], fan)
    for e in edges:
        rows = _deeper(rows if "cell" in rows.columns else rows.withColumn("cell", F.lit(0).cast("long")), e, fan)
    rows = rows if edges else rows.withColumn("cell", F.lit(0).cast("long"))
    sizes = keys.groupBy("cell").agg(F.count("*").alias("m"), (F.min("key") < F.max("key")).alias("keys"), (F.min("tie") < F.max("tie")).alias("ties"))
    sizes = sizes.select("cell", F.when(F.col("keys"), 1).otherwise(F.ceil(F.col("m") / (2 * rows_a_cell))).cast("long").alias("parts"), "ties")
    sizes = scratch.cut(sizes.where("parts > 1"), "sizes")
    by_tie = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * F.col("parts"))
    part = F.when(F.col("parts").isNull(), 0).when(F.col("ties"), F.least(by_tie, F.col("parts") - 1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    rows = rows.join(F.broadcast(sizes), "cell", "left")
    return rows.withColumn("cell", F.struct("cell", part.cast("long").alias("part"))).drop("parts", "ties")


def _deeper(rows: DataFrame, edges: DataFrame, fan: int) -> DataFrame:
    at = F.size(F.filter("edges", lambda e: e <= F.col("key")))
    return rows.join(F.broadcast(edges), "cell").withColumn("cell", F.col("cell") * fan + at).drop("edges")


def neighbours(docs: DataFrame, scratch: Scratch, rows_a_cell: int = 1000) -> DataFrame:
    """Rows of (doc_id, text) with own digests and, from the next row in descending doc_id (after the last: the first), next_text and next.

    Every row goes to its cell (see ``placed_in_cells``), and the first of each cell also, as a guest at the end, to the cell
    before it in order; so one shuffle brings every row together with its successor. The first rows, one a cell, are broadcast.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))  # nulls come last
    rows = docs.withColumn("key", key).withColumn("tie", F.xxhash64("text"))
    cells = max(1, min(MAX_CELLS, rows.count() // rows_a_cell))
    rows = placed_in_cells(rows, scratch, cells, rows_a_cell)
    first = scratch.cut(rows.groupBy("cell").agg(F.max(F.struct("key", "tie")).alias("first")), "first")
    down = Window.orderBy(F.desc("cell"))  # one small row a cell
    first = first.select("cell", "first", F.coalesce(F.lag("cell").over(down), F.min("cell").over(Window.partitionBy())).alias("guest_of"))
    placed = rows.withColumn("own", F.expr(_digests("text"))).join(F.broadcast(first), "cell")
    twice = F.when(F.struct("key", "tie") == F.col("first"), F.array(F.struct("cell", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("cell"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct("cell", F.lit(False).alias("guest"))))
    placed = placed.select("doc_id", "text", "own", "key", "tie", F.explode(twice).alias("at")).select("doc_id", "text", "own", "key", "tie", "at.*")
    order = Window.partitionBy("cell").orderBy("guest", F.desc("key"), F.desc("tie"))
    out = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order)).where("not guest")
    return out.select("doc_id", "text", "own", "next_text", "next", F.length("text").alias("n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    docs = docs.select("doc_id", utf8("text").alias("text"))
    bucketed = neighbours(docs, scratch)
    edited = "concat(substring(text, 1, n - n div 3), substring(next_text, 1, n div 3))"
    rows = bucketed.withColumn("edited", F.expr(edited))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next", F.expr(_digests("edited")).alias("ed"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.expr(_text("own")).alias("fingerprint"), F.expr(_text("ed")).alias("edited_fingerprint"), F.expr(_likeness("own", "ed")).alias("near_edited"), F.expr(_likeness("own", "next")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
