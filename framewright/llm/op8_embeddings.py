"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections, verified exactly.

Vectors are compared only within a label and a length. Equal vectors are one class first, so a thousand copies are one point.

1. Joint cells say which pairs are counted at all. A table cuts a label's points in halves by each of ``K`` projections; K
   grows with the logarithm of the label's points, so that a cell holds about ``CELL``. A pair at the threshold is in one
   cell of a table with probability (1 - angle / pi) ** K, whatever the data; so many tables are made that it is in none
   with probability 1 - ``TABLES_RECALL``. A label of up to CELL points is one cell. Work grows as n log n times a small
   power of n (0.18, the ratio of the logarithms of both chances).
2. In a cell, points are sorted by each of ``PROJECTIONS`` projections. A query point's window of a projection is the run of
   sorted points around it; a pair's count is the number of windows that hold it. Pairs that reach the count calibrated for
   the threshold are verified by cosine in double precision. A pair is dealt with in the first table that it shares.
3. Links are counted and joined to components inside the cell, which returns one row for each linked point.

Calibration: for a pair exactly at the threshold a Gaussian projection of its difference falls into the window with
probability p, independently for each projection, so its count is binomial; the count asked for is its largest value
with P(count >= it) at least ``RECALL``. Closer pairs collide more often.

A cell with many points (a dense group cannot be cut) is compared in blocks of ``BLOCK``, each pair of blocks a task of
bounded size, and all its links are found.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing;
vectors of other lengths than a point's never link with it; every row is a vector of its own, so rows with a null vec_id and
different vectors of one vec_id are compared like any other; component_id is the smallest vec_id that a row reaches, null
only if all are null, and a row is kept if that is its own vec_id; -0.0 equals 0.0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, connected_components, table

COSINE, RECALL, TABLES_RECALL = 0.93, 0.99999, 0.9999
PROJECTIONS, WIDTH, CELL, BLOCK = 24, 2.0, 512, 1024
#: Rows of a cell that are counted against all its points at once.
TILE = 256


def needed(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The count that a pair at the threshold reaches with probability ``recall``; width: half window in its standard deviations."""
    p = math.erf(width / math.sqrt(2))
    tail, k = 0.0, projections + 1
    while k > 0 and tail < recall:
        k -= 1
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
    return k


def directions(dim: int, n: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def tables(n: int, cosine: float = COSINE, cell: int = CELL, recall: float = TABLES_RECALL) -> tuple[int, int]:
    """(projections of a table, tables) for n points."""
    k = max(0, math.ceil(math.log2(max(1, n) / cell)))
    if not k:
        return 0, 1
    same = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def codes(unit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Each row's cell in each of n tables of k projections."""
    if not k:
        return np.zeros((len(unit), n), np.int64)
    # Table t has directions of its own, the same for every k.
    above = np.stack([unit @ directions(unit.shape[1], k, 1000 + t) >= 0 for t in range(n)], axis=1)
    return above @ (1 << np.arange(k, dtype=np.int64))


def windows(queries: np.ndarray, points: np.ndarray, cosine: float, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each projection: every query's window as first and last rank, and every point's rank."""
    d = directions(queries.shape[1])
    half = width * math.sqrt(max(0.0, 2 - 2 * cosine))
    lo, hi, rank = (np.zeros((PROJECTIONS, len(x)), np.int32) for x in (queries, queries, points))
    for k, (q, p) in enumerate(zip((queries @ d).T, (points @ d).T, strict=True)):
        order = np.argsort(p)
        rank[k, order] = np.arange(len(p))
        lo[k], hi[k] = np.searchsorted(p[order], q - half, "left"), np.searchsorted(p[order], q + half, "right")
    return lo, hi, rank


def candidates(queries: np.ndarray, points: np.ndarray, cosine: float, met: tuple[np.ndarray, np.ndarray] | None = None, width: float = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows whose windows collide often enough, a tile of queries at a time.

    met: the rows' cells in the first table, sorted by it; pairs that are equal there are left out (a cell's first column is
    then theirs to settle), whole tiles of them unseen.
    """
    lo, hi, rank = windows(queries, points, cosine, width)
    least = needed(width=width)
    for a in range(0, len(queries), TILE):
        b = min(a + TILE, len(queries))
        for c in range(0, len(points), 4 * TILE):
            e = min(c + 4 * TILE, len(points))
            if met is not None and met[0][a] == met[0][b - 1] == met[1][c] == met[1][e - 1]:
                continue
            counts = np.zeros((b - a, e - c), np.uint8)
            for k in range(PROJECTIONS):
                r = rank[k, None, c:e]
                counts += (r >= lo[k, a:b, None]) & (r < hi[k, a:b, None])
            i, j = np.nonzero(counts >= least)
            yield i + a, j + c


def block_links(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one block pair of one cell: for each linked point its id, how many vectors it links with, and the smallest id it reaches here.

    Links are counted where they are found; a dense group leaves one row a point, not one a pair. side 0 holds the queries
    and side 1 the points; a block against itself has side 0 only. Pairs that share an earlier table's cell are that cell's.
    """
    own, t = bool(pdf["i"].iloc[0] == pdf["j"].iloc[0]), int(pdf["t"].iloc[0])
    pdf = pdf.assign(met=[x[0] for x in pdf["codes"]]).sort_values("met", kind="stable") if t else pdf
    a = pdf[pdf["side"] == 0]
    b = a if own else pdf[pdf["side"] == 1]
    if not len(a) or not len(b):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "others", "root")})
    u, w = (np.stack(part["v"].to_numpy()).astype(np.float64) for part in (a, b))
    u, w = (m / np.linalg.norm(m, axis=1)[:, None] for m in (u, w))
    earlier = [np.stack(part["codes"].to_numpy())[:, :t] for part in (a, b)]
    met = tuple(part["met"].to_numpy() for part in (a, b)) if t else None
    links = []
    for i, j in candidates(u, w, cosine, met):
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, i.size, 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            ok = np.einsum("ij,ij->i", u[x], w[y]) >= cosine
            x, y = x[ok], y[ok]
            if t:
                new = (earlier[0][x] != earlier[1][y]).all(axis=1)
                x, y = x[new], y[new]
            links.append((x, y))
    i, j = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (0, 1))
    j = j + (0 if own else len(a))
    ids, copies = (np.concatenate([p[c].to_numpy() for p in ((a,) if own else (a, b))]) for c in ("id", "copies"))
    others = np.bincount(i, copies[j], ids.size) + np.bincount(j, copies[i], ids.size)
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
    hit = np.flatnonzero(others)
    return pd.DataFrame({"id": ids[hit], "others": others[hit].astype(np.int64), "root": root[hit]})


def coded(points: DataFrame) -> DataFrame:
    """(id, v, copies, label, dim, k, n) -> id, label, dim, copies, v and codes: the cell in each of the label's tables."""
    kind = points.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, k, n = (batch.column(c).to_numpy() for c in (4, 5, 6))
            for shape in sorted(set(zip(dim.tolist(), k.tolist(), n.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((dim == shape[0]) & (k == shape[1]) & (n == shape[2]))))
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, shape[0])
                own = codes(v / np.linalg.norm(v, axis=1)[:, None], *shape[1:])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, shape[2], dtype=np.int32)), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in (0, 3, 4, 2, 1)] + [lists], ["id", "label", "dim", "copies", "v", "codes"])

    label = points.schema["label"].dataType.simpleString()
    return points.select("id", "v", "copies", "label", "dim", "k", "n").mapInArrow(run, f"id long, label {label}, dim int, copies long, v {kind}, codes array<long>")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = F.expr("label is not null and size(d) > 0 and forall(d, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(d, x -> x <> 0)")
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"), v.alias("d")).withColumn("good", F.coalesce(good, F.lit(False)))
    name = F.struct("label", F.sha2(F.concat_ws(",", F.transform("d", lambda x: x.cast("string"))), 256).alias("h"))
    rows = scratch.cut(rows.select("vec_id", F.when(F.col("good"), name).alias("cls"), "label", "v"), "rows")
    # A class has a number of its own, fixed by writing it.
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("id"), "*", F.size("v").alias("dim")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("m"))
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / cell)))
    same = F.pow(F.lit(1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi), "k")
    n = F.when(F.col("k") == 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(math.log(1 - TABLES_RECALL)) / F.log(1 - same))))
    sizes = sizes.withColumn("k", k.cast("int")).withColumn("n", n.cast("int"))
    points = scratch.cut(coded(classes.join(sizes, ["label", "dim"])), "points")
    where = ["label", "dim", "t", "code"]
    cells = points.select("label", "dim", F.posexplode("codes").alias("t", "code")).groupBy(*where).agg(F.count("*").alias("m"))
    big = scratch.cut(cells.where(F.col("m") > 2 * block).select(*where, F.ceil(F.col("m") / block).cast("int").alias("blocks")), "big")
    placed = points.select("*", F.posexplode("codes").alias("t", "code")).join(big, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block's points are the queries of (own, j) for j from own on, and the points of (i, own) for i before.
    turns = F.concat(F.transform(F.sequence(F.col("own"), F.col("blocks") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.col("own").alias("i"), j.alias("j"))), F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.col("own").alias("j")))).otherwise(F.array()))
    placed = placed.select(*where, F.explode(turns).alias("turn"), "id", "copies", "v", "codes").select(*where, "turn.*", "id", "copies", "v", "codes")
    links = placed.groupBy(*where, "i", "j").applyInPandas(lambda pdf: block_links(pdf, cosine), "id long, others long, root long")
    links = scratch.cut(links, "links")
    found = scratch.cut(connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch), "components")
    linked = links.groupBy("id").agg(F.sum("others").alias("others"))
    known = classes.select("id", "cls", "copies", "vec_id")
    low = found.join(known.select(F.col("id").alias("node"), "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("low"))
    named = known.join(linked, "id", "left").join(found.select(F.col("node").alias("id"), "component"), "id", "left").join(low, "component", "left")
    named = scratch.cut(named.select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("low", "vec_id").alias("component")), "named")
    out = rows.select("vec_id", "cls").join(named, "cls", "left")
    component = F.coalesce("component", "vec_id")
    scratch.drop(classes, points, big, links, found)
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) ON d = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY 1) ON a = vec_id
"""
