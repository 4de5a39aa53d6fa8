"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks; SQL functions only.

1. every document's size in words, and every source's; targets share the total by weight, capped at ``REPEATS`` times
   the source (excess reshared by weight: water-filling, solved in closed form over sources ordered by cap/weight);
2. each source's target is cut into blocks of ``BLOCK`` words; the blocks of all sources are seats, given to the
   highest quotients target / (2 k + 1). Only the at most 2 x sources seats that a safe divisor leaves open are ranked;
3. a source is split into shards of about ``SHARD_WORDS`` words by a seeded hash, so a source with a third of the
   corpus is spread over many; its quota goes to its shards by the same apportionment of their words;
4. in a shard, documents stand in seeded order. The quota takes whole rounds of all of them, then the first blocks
   of the order; the block at the end may cut a document, so ``taken`` is exact to the word.

Cases: a null text has size 0 and takes 0; a null source is a source of its own, ordered last; ties of quotients go
to the earlier source (shard), ties of documents to the smaller doc_id; repeated rows of a doc_id are documents each,
told apart by their order; an empty table gives an empty result. No document exceeds ``REPEATS`` times its size, so of a
source at its cap a shard whose quota was rounded up leaves up to a block (16 words) untaken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import WORD, Scratch, table

REPEATS = 3
BLOCK = 16
SHARD_WORDS = 1 << 22
SEED = "mix-1"


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))).alias("h"))


def targets(per_source: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> with rn (order), weight and target. One row a source: a window over them all is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = per_source.withColumn("rn", F.row_number().over(order)).withColumn("weight", (1 + (F.col("rn") - 1) % 3).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("total", F.sum("source_size").over(everything))
    # Sources by cap/weight: the capped ones come first. A source is capped if its cap is below its share of what
    # the ones before leave, in integers: cap * (weights from here on) < weight * (total - caps before).
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap").cast("decimal(38,0)") * F.col("rest") <= F.col("weight").cast("decimal(38,0)") * (F.col("total") - F.col("caps")))
    s = s.withColumn("c", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).withColumn("w", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    share = ((F.col("total") - F.col("c")) * F.col("weight")).cast("double") / F.col("w").cast("double")
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "rn", "target")


def apportion(rows: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """Sainte-Lague: ``quota`` of the group's ``seats`` for each row, by its ``votes``.

    With V votes, N seats and S rows in the group, the divisor V / (N - S/2) gives at most N seats and at least N - S;
    the divisor V / (N + S/2) at least N. Only the seats between, 2 S at most, are ranked by quotient.
    """
    w = Window.partitionBy(*group)
    v, n, s = F.sum(votes).over(w), F.col(seats), F.count("*").over(w)
    rows = rows.withColumn("v_", v).withColumn("s_", s)
    seat = lambda x: F.floor(F.when(F.col("v_") > 0, F.col(votes) / F.col("v_") * F.greatest(x, F.lit(0.0))).otherwise(0.0) + 0.5)
    rows = rows.withColumn("lo_", F.greatest(seat(n - F.col("s_") / 2) - 1, F.lit(0))).withColumn("hi_", seat(n + F.col("s_") / 2) + 1)
    rows = rows.withColumn("open_", n - F.sum("lo_").over(w))
    seat_rows = rows.where((F.col("hi_") > F.col("lo_")) & (F.col(votes) > 0)).select(*group, order, votes, "open_", F.explode(F.sequence(F.col("lo_"), F.col("hi_") - 1)).alias("k_"))
    ranked = seat_rows.withColumn("r_", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("k_") + 1)).desc(), order, "k_")))
    won = ranked.where("r_ <= open_").groupBy(*group, order).agg(F.count("*").alias("won_"))
    out = rows.join(won, [*group, order], "left")  # neither key is ever null
    return out.withColumn("quota", (F.col("lo_") + F.coalesce("won_", F.lit(0))).cast("long")).drop("v_", "s_", "lo_", "hi_", "open_", "won_")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and shard for every row of (doc_id, source, text), with the columns in ``carry`` (the last to break ties)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.cut(sizes(docs, carry), "sizes")
    s = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats)
    blocks = F.sum(F.floor(F.col("target") / block + 0.5)).over(Window.partitionBy()).cast("long")
    s = scratch.cut(apportion(s.withColumn("blocks", blocks).withColumn("g", F.lit(0)), ["g"], "target", "blocks", "rn"), "quotas")
    s = s.select("source", "source_size", "target", "rn", F.col("quota").alias("source_quota"), F.ceil(F.col("source_size") / shard_words).cast("long").alias("n_shards"))
    shard = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.greatest("n_shards", F.lit(1))
    # Broadcast: one small row a source. Sources are counted first; with very many, the join shuffles instead.
    few = s.count() <= 10_000
    placed = rows.join(F.broadcast(s) if few else s, rows["source"].eqNullSafe(s["source"])).select(*carry, "doc_id", "size", "h", "source_size", "target", "rn", "source_quota", shard.alias("shard"))
    per_shard = placed.groupBy("rn", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = scratch.cut(apportion(per_shard, ["rn"], "shard_size", "source_quota", "shard").select("rn", "shard", "shard_size", "quota"), "shards")
    order = Window.partitionBy("rn", "shard").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(quotas, ["rn", "shard"]).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    words = F.least(F.col("quota") * block, F.col("shard_size") * repeats)
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    out = out.withColumn("words", words).withColumn("rounds", rounds).withColumn("left", F.col("words") - F.col("rounds") * F.col("shard_size"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before")))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("shard").cast("long").alias("shard"), *carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _apportion_sql(name: str, rows: str, group: str, votes: str, seats: str, order: str) -> str:
    return f"""
{name}_a AS (SELECT *, sum({votes}) OVER (PARTITION BY {group}) AS v_, count(*) OVER (PARTITION BY {group}) AS s_ FROM {rows}),
{name}_b AS (SELECT *, greatest(floor(CASE WHEN v_ > 0 THEN CAST({votes} AS DOUBLE) / v_ * greatest({seats} - s_ / 2.0, 0) ELSE 0 END + 0.5) - 1, 0) AS lo_,
  floor(CASE WHEN v_ > 0 THEN CAST({votes} AS DOUBLE) / v_ * greatest({seats} + s_ / 2.0, 0) ELSE 0 END + 0.5) + 1 AS hi_ FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(lo_) OVER (PARTITION BY {group}) AS open_ FROM {name}_b),
{name}_d AS (SELECT {group}, {order}, {votes}, open_, unnest(range(CAST(lo_ AS BIGINT), CAST(hi_ AS BIGINT))) AS k_ FROM {name}_c WHERE {votes} > 0),
{name}_e AS (SELECT {group}, {order}, count(*) AS won_ FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CAST({votes} AS DOUBLE) / (2 * k_ + 1) DESC, {order}, k_) AS r_ FROM {name}_d) WHERE r_ <= open_ GROUP BY ALL),
{name} AS (SELECT c.* EXCLUDE (v_, s_, lo_, hi_, open_), CAST(lo_ + coalesce(won_, 0) AS BIGINT) AS quota FROM {name}_c c LEFT JOIN {name}_e USING ({group}, {order}))"""


SQL = (
    rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':{SEED}')) AS h FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (rn - 1) % 3 AS weight, source_size * {REPEATS} AS cap, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS rest FROM s1 WINDOW p AS (ORDER BY CAST(cap AS DOUBLE) / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * rest <= weight * (total - caps) AS capped FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS c, sum(weight) FILTER (WHERE NOT capped) OVER () AS w FROM s3),
s5 AS (SELECT source, source_size, rn, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((total - c) * weight AS DOUBLE) / CAST(w AS DOUBLE) END AS target, 0 AS g FROM s4),
s6 AS (SELECT *, sum(floor(target / {BLOCK} + 0.5)) OVER () AS blocks FROM s5),"""
    + _apportion_sql("sq", "s6", "g", "target", "blocks", "rn")
    + f""",
p AS (SELECT doc_id, size, h, CAST(source_size AS BIGINT) AS source_size, target, rn, quota AS source_quota, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % greatest(CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT), 1) AS shard FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
h0 AS (SELECT rn, shard, sum(size) AS shard_size, any_value(source_quota) AS source_quota FROM p GROUP BY 1, 2),"""
    + _apportion_sql("hq", "h0", "rn", "shard_size", "source_quota", "shard")
    + f""",
o AS (SELECT p.*, shard_size, least(quota * {BLOCK}, shard_size * {REPEATS}) AS words, coalesce(sum(size) OVER (PARTITION BY rn, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN hq USING (rn, shard))
SELECT doc_id, size, source_size, target, shard, CAST(CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words % shard_size - before)) ELSE 0 END AS BIGINT) AS taken FROM o
"""
)
