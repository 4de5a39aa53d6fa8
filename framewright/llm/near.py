"""Near-duplicate components of sets of word shingles: MinHash bands, b-bit estimates, exact confirmation.

Items enter as class representatives (equal sets are one class), so exact copies never meet in a band. Every
pair that shares a band and is not already connected is estimated by its b-bit signature and confirmed on its
words:

1. each band bucket's members are paired with its centre, the member whose buckets hold the most others (linear in the
   bucket; of many copies with changes it is the one closest to their common text, so its links are the most);
2. confirmed links make components; while the buckets that still hold several have more than ``DENSE`` pairs a member,
   every member is paired with a member drawn anew, if that is of another component, up to ``ROUNDS`` times and while that joins more than one in ``FEW``;
3. buckets that still hold several components are joined on themselves across components only; sizes,
   estimate and ``PARITY`` bits, whose differences are never more than the sets', are conditions of that join, and the shared shingles of the pairs it leaves are counted. One link for two components
   stays. It is confirmed on the words like the others; should that fail, the pair is struck out and the join repeated. A bucket of more than ``HEAVY`` members (texts that
   share a passage but are not alike, or copies with changes of which some are too far) is not joined whole: its members meet
   where they differ from its centre (``centred``), and those unlike the centre at the shingles that are rarest among such
   members, of which linked ones share at least one (``rare_keys``). In any group the members of its largest component meet
   only the others. Groups of more than ``BLOCK`` members are joined in blocks, as many tasks.

Connected members need no further comparison, since only components are asked for; so no true link between
different components is lost, and a bucket of n near copies, or of n texts with one common passage, makes a few n pairs
rather than n*n/2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from framewright.llm import textkit as K
from framewright.llm.common import Scratch, connected_components

#: Documents: 32 bands of 6 rows find a pair of similarity 0.8 with probability 0.99994, of 0.85 with 0.9999997.
DOCUMENTS = (32, 6, 4)
#: Paragraphs: 16 bands of 4 rows find a pair of similarity 0.8 with probability 0.9998.
PARAGRAPHS = (16, 4, 2)
#: Standard deviations below the threshold at which an estimate still asks for confirmation: one true link in 10^9 falls lower.
SLACK, ROUNDS, DENSE, BLOCK = 6, 3, 32, 1024
#: Members of the largest bucket whose pairs are all compared.
HEAVY = 32
#: Members for one link found, beyond which drawing again does not pay: the links left are found by the join.
FEW = 100
#: Bits of a set in the join.
PARITY = 1024


def estimate(a: str, b: str, bits: int, size: int) -> Column:
    """Similarity from the equal b-bit minima of two packed signatures, corrected for chance collisions. Unrolled, so it compiles."""
    mask = sum(1 << k for k in range(0, 64, bits))
    mask = mask - (1 << 64) if mask >> 63 else mask
    z = "~({a}[{k}] ^ {b}[{k}])"
    parts = [" & ".join([*(f"shiftright({z.format(a=a, b=b, k=k)}, {s})" for s in range(bits)), f"{mask}L"]) for k in range(-(-size * bits // 64))]
    equal = " + ".join(f"bit_count({p})" for p in parts)
    pad = -size % (64 // bits)
    return (F.expr(equal) - F.lit(pad)) / F.lit(float(size)) * F.lit(2**bits / (2**bits - 1)) - F.lit(1 / (2**bits - 1))


def alike(a: str, b: str, percent: int, n: int) -> Column:
    """Whether two texts' sets of n-word shingles have 100 * intersection >= percent * union, by their words."""

    @F.pandas_udf(BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = (K.shared_shingles(x, y, n) for x, y in zip(a, b, strict=True))
        return pd.Series([100 * both >= percent * either for both, either in sizes], dtype=bool)

    return linked(a, b)


def item_sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, items, odd): sorted distinct shingle hashes of every (id, text), and their ``PARITY`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                own = K.distinct(*K.shingles(*K.words(data, offsets), n))
                odd = [K.parity(own[0][own[1][k] : own[1][min(k + 512, j - i)]], own[1][k : k + 513] - own[1][k], PARITY) for k in range(0, j - i, 512)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.list_array(*own), K.matrix_array(np.concatenate(odd))], ["id", "items", "odd"])

    return texts.select("id", "text").mapInArrow(run, "id long, items array<long>, odd array<long>")


def rare_keys(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, c, m) of members (id, c) and their sets (id, items): the items at which pairs of them meet, each with its m members.

    Of two sets with 100 * intersection >= percent * union each holds at least ceil(size * percent / 100) common items, so in
    any order of all items they share one among each one's first size + 1 less that many. Rarest first, items of one set
    alone stand in front, and an item that all share is only reached by sets with little of their own.
    """
    # One row for each item of a member; members are dealt evenly, as the files of sets may hold many or none.
    own = sets.join(members.select("id"), "id").select("id", "items")
    own = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = own.select("id", F.size("items").alias("size"), F.explode("items").alias("key"))
    shared = items.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    ordered = items.join(shared, "key").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("own"))
    # The items of one set alone are left out here, and of the first ones as many.
    ordered = ordered.withColumn("front", F.expr(f"size(own) + 1 - int((size * {percent} + 99) div 100)")).where("front > 0")
    front = ordered.select("id", F.explode(F.expr("slice(own, 1, front)")).alias("o")).select("id", "o.key")
    front = front.join(members, "id")
    met = front.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "m")
    return front.join(met, "key").select("key", "id", "c", "m")


def centred(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Where linked members (key, id, c, m) of the same bucket, of different components c, can meet; sets: (id, items).

    -> (key, id, c, m, far, strong, d, own): pairs that share a key, one of them far; if both are, both strong; own are the items of
    D that others hold too, so d1 + d2 less twice the common ones is d of the pair. (ca, cb, a, b): pairs
    of a centre with a member near it that is not of its component. (id, c): members to be told apart by ``rare_keys``. A table under the first, to be dropped.

    With d the number of items that two sets do not share, a link is (100 + percent) * d <= (100 - percent) * (size + size). Let
    g be that quotient, r the centre of a bucket (of its largest component the member that meets most others), D the items in
    which a set differs from r's. Two members share (d1 + d2 - d) / 2 items of their Ds, for a link at least
    (d1 + d2 - g * (size1 + size2)) / 2. A near member, with d1 <= g * (size1 + r's size), is linked to r. With a far one that
    bound is above 0 for every partner, as d2 is not below the difference of the sizes: it is above
    (d2 - g * (size2 - r's size)) / 2, and at least (d1 - g * (size1 + r's size)) / 2. So they share one of so many first items of
    their Ds, in the order of rarity, as sets of so many shared items do. What all have of r is in no D. A member of
    similarity below 0.5 to r differs in most items; it and its links, of similarity below 1.5 - percent / 100 to r, are left to ``rare_keys``.
    """
    hubs = members.groupBy("c", "id").agg(F.sum("m").alias("near")).groupBy(F.col("c").alias("rc")).agg((-F.max(F.struct("near", (-F.col("id")).alias("low")))["low"]).alias("r"))
    centres = members.groupBy("key").agg(F.mode("c", deterministic=True).alias("rc")).join(hubs, "rc")
    group = members.join(centres, "key").select("r", "rc", "id", "c").distinct()
    own, other = sets.select("id", "items"), sets.select(F.col("id").alias("r"), F.col("items").alias("others"))
    group = group.join(own, "id").join(other, "r").withColumn("apart", F.concat(F.array_except("items", "others"), F.array_except("others", "items")))
    group = group.select("r", "rc", "id", "c", "apart", F.size("apart").alias("d"), F.size("items").alias("size"), F.size("others").alias("of"))
    group = group.withColumn("far", F.expr(f"{100 + percent} * d > {100 - percent} * (size + of)")).withColumn("close", F.expr("size + of >= 3 * d"))
    group = scratch.cut(group.withColumn("unlike", F.expr(f"100 * (size + of - d) < {150 - percent} * (size + of + d)")), "centred")
    unlike = group.where("unlike").select("id", "c").distinct()
    direct = group.where("not far and c <> rc").select(F.least("c", "rc").alias("ca"), F.greatest("c", "rc").alias("cb"), F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b"))
    items = group.where("close").select("r", "id", "c", "d", "size", "of", "far", F.explode("apart").alias("item"))
    shared = items.groupBy("r", "item").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("far").alias("some"))
    # Items of one member alone stand in front and are left out, as in rare_keys.
    ordered = items.join(shared.where("f > 1"), ["r", "item"]).groupBy("r", "id").agg(*(F.first(c).alias(c) for c in ("c", "d", "size", "of", "far")), F.array_sort(F.collect_list(F.struct("f", "item", F.expr("c0 < c1 and some").alias("met")))).alias("own"))
    p, q = 100 + percent, 100 - percent
    front = ordered.withColumn("least", F.expr(f"size(own) - ({p}L * d - {q}L * (size - of)) div {2 * p}L"))
    front = front.withColumn("most", F.expr(f"if(far, size(own) + 1 - ({p}L * d - {q}L * (size + of) + {2 * p - 1}) div {2 * p}L, least)")).where("most > 0")
    front = front.select("r", "id", "c", "far", "least", "d", F.expr("transform(own, o -> o.item)").alias("own"), F.posexplode(F.expr("slice(own, 1, cast(most as int))")).alias("at", "o")).where("o.met")
    front = front.select(F.xxhash64("r", "o.item").alias("key"), "id", "c", "far", F.expr("not far or at < least").alias("strong"), "d", "own")
    met = front.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("far").alias("some")).where("c0 < c1 and some").select("key", "m")
    return front.join(met, "key").select("key", "id", "c", "m", "far", "strong", "d", "own"), direct.distinct(), unlike, group


def near_components(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, sketch: K.MinHash, n: int = 5) -> DataFrame:
    """(id, keys array<long>, sig array<long>), one row for each class of equal non-empty sets -> (node, component).

    ``texts_of`` takes a frame (id) and returns (id, text), a text of each of those classes. Only ids that are not the
    smallest of their component are returned. percent: links have 100 * intersection >= percent * union.
    """
    p, bits, size = percent / 100, sketch.bits, sketch.a.size
    hit = p + (1 - p) * 2.0**-bits
    slack = p - SLACK * (hit * (1 - hit) / size) ** 0.5 / (1 - 2.0**-bits)
    # Dealt by key once: the counts read the same exchange as the rows (so they name all columns), and few keys have a count above one.
    rows = reps.select("id", F.explode("keys").alias("key")).repartition("key")
    crowds = rows.groupBy("key").agg(F.count("id").alias("m")).where("m > 1")
    hits = scratch.cut(rows.join(crowds.hint("shuffle_hash"), "key"), "buckets")  # members of the buckets with more than one
    ranked = hits.join(hits.groupBy("id").agg(F.struct(F.sum("m").alias("near"), (-F.col("id")).alias("low")).alias("rank")), "id")
    sig = scratch.cut(reps.select("id", "sig").join(hits.select("id").distinct(), "id"), "signatures")
    texts = scratch.cut(texts_of(sig.select("id")), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return scratch.cut(pairs.join(one, "a").join(two, "b").where(alike("ta", "tb", percent, n)).select("a", "b"), "links")

    def tried(pairs: DataFrame) -> DataFrame:
        """The links among (a, b)."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        one, two = (sig.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
        close = scratch.cut(pairs.join(one, "a").join(two, "b").where(estimate("sa", "sb", bits, size) >= slack).select("a", "b"), "pairs")
        out = confirmed(close)
        scratch.drop(close)
        return out

    def joined(links: DataFrame) -> DataFrame:
        """Where each component of ``links`` (a, b) goes that is not the smallest it meets."""
        steps.append(scratch.cut(connected_components(links, scratch).where("node <> component"), "components"))
        return steps[-1]

    def relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
        """Members (key, id, c) after joining components by ``links`` (of c's), only those of buckets with several components, with m, the bucket's members."""
        moved = joined(links).select(F.col("node").alias("c"), "component")
        now = members.join(moved, "c", "left").select("key", "id", F.coalesce("component", "c").alias("c"))
        mixed = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("key", "m")
        return scratch.cut(now.join(mixed, "key"), "labelled")

    steps: list[DataFrame] = []
    centres = ranked.groupBy("key").agg((-F.max("rank")["low"]).alias("centre"))
    links = tried(hits.join(centres, "key").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    members = relabelled(hits.select("key", "id", F.col("id").alias("c")), links)
    scratch.drop(hits, links)
    member = F.struct("id", "c")
    for k in range(ROUNDS):
        n_members, n_pairs = members.agg(F.count("*"), F.sum("m")).first()
        if (n_pairs or 0) <= 2 * DENSE * n_members:
            break
        drawn = F.xxhash64("id", F.lit(k))
        pivots = members.groupBy("key").agg(F.min_by(member, drawn).alias("p"))
        again = members.join(pivots, "key").where("c <> p.c")
        links = tried(again.select(F.col("id").alias("a"), F.col("p.id").alias("b")))
        found = links.count()
        if not found:
            scratch.drop(links)
            break
        label = members.select("id", "c").distinct()
        between = links.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        before, members = members, relabelled(members, between)
        scratch.drop(links, before)
        if found * FEW < n_members:
            break
    refuted = None
    while not members.isEmpty():
        wanted = scratch.cut(texts.join(members.select("id").distinct(), "id"), "wanted")
        sets = scratch.cut(item_sets(wanted, n), "sets")
        heavy = scratch.cut(members.where(F.col("m") > HEAVY), "heavy")
        parts, direct, unlike, group = centred(heavy, sets, percent, scratch)
        parts = parts.withColumn("rare", F.lit(2))
        for k, found in enumerate((members.where(F.col("m") <= HEAVY), rare_keys(unlike, sets, percent))):
            parts = parts.unionByName(found.select("key", "id", "c", "m", F.lit(True).alias("far"), F.lit(True).alias("strong"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("array<long>").alias("own"), F.lit(k).alias("rare")))
        left = scratch.cut(parts, "left")
        whole = left
        left = left.join(left.groupBy("key", "rare").agg(F.mode("c").alias("most")), ["key", "rare"])
        left = left.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        full = left.join(sig, "id").join(sets.select("id", F.size("items").alias("size"), "odd"), "id")
        # Each member is in one block of its group, and those outside the group's largest component meet every block.
        two = full.withColumn("block", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("blocks")).cast("int"))
        one = full.where("c <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        one, two = (x.select("key", "rare", "block", *(F.col(c).alias(c + s) for c in ("id", "c", "most", "far", "strong", "d", "own", "sig", "size", "odd"))) for x, s in ((one, "1"), (two, "2")))
        sizes = F.expr(f"100L * least(size1, size2) >= {percent}L * greatest(size1, size2)")
        can = F.expr("(far1 or far2) and (not far1 or not far2 or strong1 and strong2)")
        differ = F.expr(f"{100 + percent}L * aggregate(zip_with(odd1, odd2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {100 - percent}L * (size1 + size2)")
        apart = F.expr(f"own1 is null or {100 + percent}L * (d1 + d2 - 2 * size(array_intersect(own1, own2))) <= {100 - percent}L * (size1 + size2)")
        rest = one.join(two, ["key", "rare", "block"]).where(can & (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("most2")) | (F.col("id1") < F.col("id2"))) & sizes & (estimate("sig1", "sig2", bits, size) >= slack) & differ & apart)
        rest = rest.select(F.least("c1", "c2").alias("ca"), F.greatest("c1", "c2").alias("cb"), F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).unionByName(direct).distinct()
        # The items are joined only to these pairs, each once.
        exact = F.expr(f"{100 + percent}L * size(array_intersect(ia, ib)) >= {percent}L * (size(ia) + size(ib))")
        one, two = (sets.select(F.col("id").alias(c), F.col("items").alias(f"i{c}")) for c in "ab")
        rest = rest.join(one, "a").join(two, "b").where(exact).select("ca", "cb", "a", "b")
        if refuted is not None:
            rest = rest.join(refuted, ["a", "b"], "left_anti")
        rest = scratch.cut(rest.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")).select("ca", "cb", "p.a", "p.b"), "rest")
        links = confirmed(rest.select("a", "b"))
        between = rest.join(links, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        wrong = scratch.cut(rest.join(links, ["a", "b"], "left_anti").select("a", "b"), "refuted")
        done = wrong.isEmpty()
        if done:
            joined(between)
        else:
            refuted = wrong if refuted is None else scratch.cut(refuted.unionByName(wrong), "refuted")
            before, members = members, relabelled(members, between)
            scratch.drop(before)
        scratch.drop(wanted, sets, heavy, group, whole, rest, links)
        if done:
            break
    out = steps[0]
    # Each step moved some components on; a node went where its component went in the steps after.
    for moved in steps[1:]:
        out = out.join(moved.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(moved)
    out = scratch.cut(out, "near")
    scratch.drop(members, sig, texts, *steps)
    return out
