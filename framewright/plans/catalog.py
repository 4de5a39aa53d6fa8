"""Named queries over the adapter tables, each with the SQL that states it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import soa
from framewright.functions.hashing import content_hash
from framewright.functions.scalars import formula_of
from framewright.operators import extract
from framewright.plans import stored
from framewright.plans.dedup import representatives
from framewright.plans.select import Select, select_keys
from framewright.schema import KEYS
from framewright.sources import adapters as A

N_SHARDS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CASE = "CASE concat(l_returnflag, l_linestatus) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.SYMBOLS.items()) + " END"
_MASS = "CASE symbol " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in A.MASSES.items()) + " END"
HEADS = """h AS (SELECT o_orderkey AS k, CAST(o_custkey AS BIGINT) AS traj_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS frame_idx, o_orderstatus AS status,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN -o_totalprice / 1000 END AS energy, CAST((10 + o_orderkey % 7) * 100 AS DOUBLE) AS volume,
  CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'P' THEN 3 END AS pbc_mask, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS "time",
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) END AS timestep, CAST(o_orderkey % 100 AS DOUBLE) AS frame_index, CAST(o_orderkey % 8 AS DOUBLE) AS neb_bead, CAST(o_orderkey % 3 AS DOUBLE) AS neb_band,
  CAST(o_orderkey % 3 - 1 AS DOUBLE) AS charge, CASE WHEN o_orderkey % 5 = 0 THEN CAST(2.0 AS DOUBLE) END AS magmom FROM orders)"""
ATOMS = f"""a AS (SELECT h.*, {_CASE} AS symbol, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem JOIN h ON l_orderkey = k)"""
SPECIES = f"""s AS (SELECT k, traj_id, frame_idx, symbol, count(*) AS n, CAST(count(*) AS BIGINT) * {_MASS} AS m FROM a WHERE symbol IS NOT NULL GROUP BY k, traj_id, frame_idx, symbol)"""
FRAMES = f"""{HEADS}, {ATOMS}, {SPECIES},
p AS (SELECT k, sum(n) AS natoms, string_agg(concat(symbol, ':', n), '|' ORDER BY symbol) AS formula, sum(m) AS m FROM s GROUP BY 1),
x AS (SELECT k, max(CASE WHEN status <> 'O' THEN sqrt(l_discount * l_discount + l_tax * l_tax + (l_quantity / 50) * (l_quantity / 50)) END) AS fmax, max(status) AS st FROM a WHERE symbol IS NOT NULL GROUP BY 1),
f AS (SELECT h.*, CAST(coalesce(natoms, 0) AS BIGINT) AS natoms, formula, fmax, CAST(coalesce(m, 0) AS DOUBLE) / 1e6 AS mass, coalesce(st <> 'O', false) AS has_forces, coalesce(st = 'P', false) AS has_velocities, energy IS NOT NULL AS has_energy
  FROM h LEFT JOIN p USING (k) LEFT JOIN x USING (k))"""
DOCS = """d AS (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS traj_id, CAST(row_number() OVER (PARTITION BY CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) ORDER BY doc_id) - 1 AS BIGINT) AS frame_idx, text, n_chars, md5(text) AS content_hash FROM documents WHERE source IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY traj_id, frame_idx) = 1 AS is_rep FROM d)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _needs_atoms(sel: Select) -> bool:
    return bool(sel.natoms or sel.symbols or sel.formula or sel.exact or sel.at_least or {"fmax", "mass"} & set(sel.ranges) or {"has_forces", "has_velocities"} & sel.flags)


def screen(name: str, sel: Select, where: str, *values: str) -> None:
    """A selection with the columns it screens by; a table of atoms is only read if the selection needs it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = A.frames(spark, sf_dir) if _needs_atoms(sel) or {"natoms", "formula", "fmax", "mass"} & set(values) else A.headers(spark, sf_dir)
        return select_keys(table, sel, None, *values)

    tail = f" ORDER BY traj_id, frame_idx LIMIT {sel.max_keys}" if sel.max_keys is not None else ""
    columns = ", ".join(['traj_id', 'frame_idx', *(f'"{v}"' for v in values)])
    base = FRAMES if _needs_atoms(sel) or {"natoms", "formula", "fmax", "mass"} & set(values) else HEADS
    source = "f" if base is FRAMES else "h"
    query(name, f"WITH {base} SELECT {columns} FROM {source} WHERE {where}{tail}")(run)


def _has(symbol: str, test: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM s WHERE s.k = f.k AND symbol = '{symbol}'{test})"


S = Select()
screen("select_symbol", S.require_symbol("Cu"), _has("Cu"))
screen("select_symbols_all", S.require_symbol("C").require_symbol("Cu").require_symbol("H"), f"{_has('C')} AND {_has('Cu')} AND {_has('H')}")
screen("select_traj", S.trajectory(37), "traj_id = 37", "energy")
screen("natoms_range", S.natoms_range(3, 5), "natoms BETWEEN 3 AND 5", "natoms")
screen("exact_composition", S.exact_composition("Cu:2|N:1"), "formula = 'Cu:2|N:1'", "formula")
screen("exact_composition_unordered", S.exact_composition("N:1|Cu:2"), "false", "formula")
screen("element_exact", S.element_exact("Cu", 2), _has("Cu", " AND n = 2"))
screen("element_exact_zero", S.element_exact("Cu", 0), "false")
screen("element_min", S.element_min("N", 2).element_min("S", 0), f"{_has('N', ' AND n >= 2')} AND {_has('S')}")
screen("energy_range", S.energy_range(-150.0, -100.0), "energy BETWEEN -150 AND -100", "energy")
screen("energy_range_unbounded", S.energy_range(math.inf, math.nan), "energy IS NOT NULL", "energy")
screen("energy_range_inverted", S.energy_range(-100.0, -150.0), "false", "energy")
screen("fmax_range", S.fmax_range(None, 0.5), "fmax BETWEEN 0 AND 0.5", "fmax")
screen("mass_range", S.mass_range(50.0, 100.0), "mass BETWEEN 50 AND 100", "mass")
screen("volume_range", S.volume_range(1100.0, 1300.0), "volume BETWEEN 1100 AND 1300", "volume")
screen("pbc_exact", S.pbc(True, True, False), "pbc_mask = 3", "pbc_mask")
screen("time_range", S.time_range(1500.0, 2000.0), "\"time\" BETWEEN 1500 AND 2000", "time")
screen("timestep_range", S.timestep_range(0.1, 0.3), "timestep BETWEEN 0.1 AND 0.3", "timestep")
screen("frame_index_range", S.frame_index_range(10.0, 20.0), "frame_index BETWEEN 10 AND 20", "frame_index")
screen("neb_bead_range", S.neb_bead_range(2.0, 3.0), "neb_bead BETWEEN 2 AND 3", "neb_bead")
screen("neb_band_range", S.neb_band_range(1.0), "neb_band >= 1", "neb_band")
screen("charge_range", S.charge_range(None, -1.0), "charge <= -1", "charge")
screen("magmom_range", S.magmom_range(1.5, 2.5), "magmom BETWEEN 1.5 AND 2.5", "magmom")
screen("require_forces", S.require_forces(), "has_forces", "has_forces")
screen("require_velocities", S.require_velocities(), "has_velocities", "has_velocities")
screen("require_energy", S.require_energy(), "energy IS NOT NULL", "energy")
screen("empty_select_topk", S.limit(100), "true")
screen("list_keys", S, "true")
screen("overwritten_range", S.energy_range(-10.0, 0.0).energy_range(-50.0, -40.0), "energy BETWEEN -50 AND -40", "energy")
screen(
    "campaign_conjunction",
    S.require_symbol("Cu").require_forces().natoms_range(2, 9).fmax_range(None, 1.0).energy_range(-250.0, -20.0).volume_range(1000.0, 1500.0).limit(500),
    f"{_has('Cu')} AND has_forces AND natoms BETWEEN 2 AND 9 AND fmax BETWEEN 0 AND 1 AND energy BETWEEN -250 AND -20 AND volume BETWEEN 1000 AND 1500",
    "energy",
    "fmax",
)


@query("frame_projection", f'WITH {FRAMES} SELECT traj_id, frame_idx, natoms, formula, energy, fmax, mass, volume, pbc_mask, "time", timestep, frame_index, neb_bead, neb_band, charge, magmom, has_forces, has_velocities, has_energy FROM f')
def frame_projection(spark, sf_dir):
    return A.frames(spark, sf_dir).drop("species", "symbols")


@query("species_counts", f"WITH {HEADS}, {ATOMS}, {SPECIES} SELECT traj_id, frame_idx, symbol, CAST(n AS BIGINT) AS n FROM s")
def species_counts(spark, sf_dir):
    return A.atoms(spark, sf_dir).groupBy(*KEYS, "symbol").agg(F.count("*").alias("n"))


@query("formula", f"WITH {HEADS}, {ATOMS}, {SPECIES} SELECT traj_id, frame_idx, string_agg(concat(symbol, ':', n), '|' ORDER BY symbol) AS formula FROM s GROUP BY 1, 2")
def formula(spark, sf_dir):
    n = species_counts(spark, sf_dir)
    return n.groupBy(*KEYS).agg(formula_of(F.collect_list(F.struct("symbol", "n"))).alias("formula"))


@query("fmax_agg", f"WITH {FRAMES} SELECT traj_id, max(fmax) AS fmax, count(fmax) AS n FROM f GROUP BY 1")
def fmax_agg(spark, sf_dir):
    from framewright.functions.scalars import norm

    per = A.atoms(spark, sf_dir).where("force is not null").groupBy(*KEYS).agg(F.max(norm(F.col("force"))).alias("fmax"))
    trajectories = A.headers(spark, sf_dir).select("traj_id").distinct()
    got = per.groupBy("traj_id").agg(F.max("fmax").alias("fmax"), F.count("*").alias("n"))
    return trajectories.join(got, "traj_id", "left").select("traj_id", "fmax", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("total_mass", f"WITH {FRAMES} SELECT traj_id, CAST(sum(CAST(coalesce(m, 0) AS BIGINT)) AS DOUBLE) / 1e6 AS mass FROM h LEFT JOIN p USING (k) GROUP BY 1")
def total_mass(spark, sf_dir):
    trajectories = A.headers(spark, sf_dir).select("traj_id").distinct()
    got = A.atoms(spark, sf_dir).groupBy("traj_id").agg(F.sum("mass").alias("m"))
    return trajectories.join(got, "traj_id", "left").select("traj_id", (F.coalesce("m", F.lit(0)).cast("double") / 1e6).alias("mass"))


@query("traj_meta_counts", f"WITH {HEADS} SELECT traj_id, max(frame_idx) + 1 AS n_frames FROM h GROUP BY 1")
def traj_meta_counts(spark, sf_dir):
    return A.headers(spark, sf_dir).groupBy("traj_id").agg((F.max("frame_idx") + 1).alias("n_frames"))


@query("representatives_commit_order", f"WITH {DOCS} SELECT content_hash, traj_id, frame_idx FROM r WHERE is_rep")
def representatives_commit_order(spark, sf_dir):
    return representatives(A.documents(spark, sf_dir))


@query("unique_keys_corpus", f"WITH {DOCS} SELECT traj_id, frame_idx FROM r WHERE is_rep AND n_chars >= 200")
def unique_keys_corpus(spark, sf_dir):
    return select_keys(A.screened_documents(spark, sf_dir), S.natoms_range(200), None, "is_rep").where("is_rep").select(*KEYS)


@query("unique_keys_limit_first", f"WITH {DOCS}, t AS (SELECT * FROM r ORDER BY traj_id, frame_idx LIMIT 200) SELECT traj_id, frame_idx FROM t WHERE is_rep")
def unique_keys_limit_first(spark, sf_dir):
    return select_keys(A.screened_documents(spark, sf_dir), S.limit(200), None, "is_rep").where("is_rep").select(*KEYS)


#: The content of the smallest key whose text occurs again in a later trajectory.
_TWICE = "(SELECT min_by(content_hash, (traj_id, frame_idx)) FROM r WHERE is_rep AND content_hash IN (SELECT content_hash FROM d GROUP BY 1 HAVING count(DISTINCT traj_id) > 1))"


def _twice(docs: DataFrame) -> DataFrame:
    many = docs.groupBy("content_hash").agg(F.min(F.struct(*KEYS)).alias("first"), F.max("traj_id").alias("last")).where("first.traj_id < last")
    return many.agg(F.min(F.struct("first", "content_hash"))["content_hash"].alias("content_hash"), F.min(F.struct("first", "last"))["last"].alias("last"))


@query("exact_hash_rep", f"WITH {DOCS} SELECT traj_id, frame_idx, content_hash FROM r WHERE content_hash = {_TWICE} AND is_rep")
def exact_hash_rep(spark, sf_dir):
    docs = A.screened_documents(spark, sf_dir)
    return docs.where("is_rep").join(F.broadcast(_twice(docs)), "content_hash").select(*KEYS, "content_hash")


@query("exact_hash_other_traj", f"WITH {DOCS} SELECT traj_id, frame_idx, content_hash FROM r WHERE content_hash = {_TWICE} AND is_rep AND traj_id = (SELECT max(traj_id) FROM d WHERE content_hash = {_TWICE})")
def exact_hash_other_traj(spark, sf_dir):
    docs = A.screened_documents(spark, sf_dir)
    return docs.where("is_rep").join(F.broadcast(_twice(docs)), "content_hash").where("traj_id = last").select(*KEYS, "content_hash")


@query("batch_texts", f"WITH {DOCS}, q AS (SELECT traj_id, frame_idx, row_number() OVER (ORDER BY traj_id DESC, frame_idx DESC) - 1 AS pos FROM d) SELECT pos, traj_id, frame_idx, md5(text) AS blob_md5 FROM q JOIN d USING (traj_id, frame_idx)")
def batch_texts(spark, sf_dir):
    """The texts of every key, last first. Only the offsets, one row a trajectory, are numbered by a window over all."""
    from pyspark.sql import Window

    docs = A.documents(spark, sf_dir)
    before = Window.orderBy(F.desc("traj_id")).rowsBetween(Window.unboundedPreceding, 0)
    ends = docs.groupBy("traj_id").agg(F.count("*").alias("c")).select("traj_id", (F.sum("c").over(before) - 1).alias("end"))
    keys = docs.join(ends, "traj_id").select(*KEYS, (F.col("end") - F.col("frame_idx")).alias("pos"))
    return extract.texts_of(docs, keys).select("pos", *KEYS, F.md5(F.col("blob").cast("binary")).alias("blob_md5"))


@query("touch_bytes", f"WITH {DOCS} SELECT traj_id, count(*) AS n_frames, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM d GROUP BY 1")
def touch_bytes(spark, sf_dir):
    size = F.octet_length("blob").cast("long")
    return A.documents(spark, sf_dir).groupBy("traj_id").agg(F.count("*").alias("n_frames"), F.sum(size).alias("n_bytes"))


@query("touch_checksum", f"WITH {DOCS} SELECT traj_id, count(*) AS n_frames, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x, i: i * CAST(concat('0x', x) AS BIGINT))), 0)) AS BIGINT) AS checksum FROM d GROUP BY 1")
def touch_checksum(spark, sf_dir):
    return extract.touch(A.documents(spark, sf_dir))


@query("positions_extract", """WITH v AS (SELECT CAST(label AS BIGINT) AS traj_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx, embedding FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 63)
SELECT traj_id, frame_idx, atom, CAST(embedding[3 * atom + 1] AS DOUBLE) AS x, CAST(embedding[3 * atom + 2] AS DOUBLE) AS y, CAST(embedding[3 * atom + 3] AS DOUBLE) AS z FROM v, (SELECT unnest(range(0, 21)) AS atom)""")
def positions_extract(spark, sf_dir):
    return A.vectors(spark, sf_dir).select(*KEYS, F.posexplode("positions").alias("atom", "p")).select(*KEYS, F.col("atom").cast("long").alias("atom"), "p.*")


@query("forces_or_none", f"WITH {HEADS}, {ATOMS} SELECT traj_id, frame_idx, CAST(sum(CASE WHEN status <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_forces, max(CASE WHEN status <> 'O' THEN l_discount END) AS max_fx FROM a WHERE symbol IS NOT NULL GROUP BY 1, 2")
def forces_or_none(spark, sf_dir):
    return A.atoms(spark, sf_dir).groupBy(*KEYS).agg(F.count("force").alias("n_forces"), F.max("force.x").alias("max_fx"))


@query("cooked_fallback", """WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS traj_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx, embedding FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 63)
SELECT traj_id, frame_idx, CAST(embedding[1] AS DOUBLE) AS x0, vec_id % 3 <> 0 AS was_cooked FROM v""")
def cooked_fallback(spark, sf_dir):
    """Two thirds of the frames are cooked, a sixth has a corrupt block, a sixth none: all give the positions of the source."""
    v = A.vectors(spark, sf_dir)
    none = F.lit(None).cast("array<struct<x:double,y:double,z:double>>")
    cooked = v.where("vec_id % 3 <> 0").select(*KEYS, soa.rcso_encode("positions", none, none).alias("rcso"))
    corrupt = v.where("vec_id % 6 = 0").select(*KEYS, F.encode(F.lit("XXXX_not_valid"), "utf-8").alias("rcso"))
    fast = cooked.unionByName(corrupt).select(*KEYS, soa.rcso_decode("rcso").alias("c"))
    both = v.join(fast, KEYS, "left")
    return both.select(*KEYS, F.coalesce("c.positions", "positions")[0]["x"].alias("x0"), F.coalesce(F.col("c.positions").isNotNull(), F.lit(False)).alias("was_cooked"))


@query("shard_route", f"WITH {HEADS} SELECT traj_id % {N_SHARDS} AS shard, count(*) AS n, count(DISTINCT traj_id) AS trajectories FROM h GROUP BY 1")
def shard_route(spark, sf_dir):
    return A.headers(spark, sf_dir).withColumn("shard", F.pmod("traj_id", F.lit(N_SHARDS).cast("long"))).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("traj_id").alias("trajectories"))


@query("shard_topk", f"WITH {HEADS} SELECT traj_id, frame_idx, traj_id % {N_SHARDS} AS shard FROM h WHERE energy BETWEEN -120 AND -110 ORDER BY traj_id, frame_idx LIMIT 50")
def shard_topk(spark, sf_dir):
    heads = A.headers(spark, sf_dir).withColumn("shard", F.pmod("traj_id", F.lit(N_SHARDS).cast("long")))
    return select_keys(heads, S.energy_range(-120.0, -110.0).limit(50), None, "shard")


@query("shard_join_guard", f"WITH {HEADS} SELECT traj_id, count(DISTINCT frame_idx % 2) AS shards FROM h GROUP BY 1 HAVING count(DISTINCT frame_idx % 2) > 1")
def shard_join_guard(spark, sf_dir):
    """Trajectories that lie in more than one shard when frames, wrongly, are dealt by frame parity."""
    per = A.headers(spark, sf_dir).select("traj_id", (F.col("frame_idx") % 2).alias("shard"))
    return per.groupBy("traj_id").agg(F.countDistinct("shard").alias("shards")).where("shards > 1")


@query("split_membership", f"WITH {HEADS} SELECT traj_id, traj_id % {N_SHARDS} AS shard, count(*) AS n_frames FROM h GROUP BY 1, 2")
def split_membership(spark, sf_dir):
    heads = A.headers(spark, sf_dir).withColumn("shard", F.pmod("traj_id", F.lit(N_SHARDS).cast("long")))
    return heads.groupBy("traj_id", "shard").agg(F.count("*").alias("n_frames"))


@query("extend_frame_idx", f"WITH {HEADS}, n AS (SELECT traj_id, count(*) AS c FROM h GROUP BY 1) SELECT traj_id, frame_idx + c AS frame_idx, k AS orderkey FROM h JOIN n USING (traj_id)")
def extend_frame_idx(spark, sf_dir):
    """Appending every frame again: new indexes continue after each trajectory's last."""
    heads = A.headers(spark, sf_dir)
    total = heads.groupBy("traj_id").agg(F.count("*").alias("c"))
    return heads.join(total, "traj_id").select("traj_id", (F.col("frame_idx") + F.col("c")).alias("frame_idx"), "orderkey")


@query("traj_exists_guard", "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS traj_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def traj_exists_guard(spark, sf_dir):
    """New ids that are stored already, of all customers."""
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("traj_id"))
    there = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("traj_id")).distinct()
    return there.join(new, "traj_id", "left_semi")


@query("extxyz_lines", f"WITH {HEADS}, {ATOMS} SELECT traj_id, frame_idx, printf('%-2s %16.10f %16.10f', symbol, l_quantity, l_discount * 100) AS line FROM a WHERE symbol IS NOT NULL")
def extxyz_lines(spark, sf_dir):
    return A.atoms(spark, sf_dir).select(*KEYS, F.format_string("%-2s %16.10f %16.10f", "symbol", "position.x", "position.z").alias("line"))


@query("extxyz_frames", f"""WITH {HEADS}, {ATOMS} SELECT traj_id, frame_idx, concat(count(*), chr(10), 'Lattice="10.0 0 0 0 10.0 0 0 0 ', 10 + any_value(k) % 7, '.0" Properties=species:S:1:pos:R:3', CASE WHEN any_value(status) <> 'O' THEN ':forces:R:3' ELSE '' END, ' pbc="T T T"', CASE WHEN any_value(energy) IS NOT NULL THEN concat(' energy=', any_value(energy)) ELSE '' END, chr(10),
  string_agg(printf('%-2s %16.10f %16.10f %16.10f', symbol, l_quantity, l_extendedprice / 1000, l_discount * 100) || CASE WHEN status <> 'O' THEN printf(' %16.10f %16.10f %16.10f', l_discount, l_tax, l_quantity / 50) ELSE '' END, chr(10) ORDER BY l_linenumber, symbol, l_quantity, l_extendedprice, l_discount), chr(10)) AS frame FROM a WHERE symbol IS NOT NULL GROUP BY traj_id, frame_idx""")
def extxyz_frames(spark, sf_dir):
    """Whole frames as the exporter writes them: number of atoms, lattice, properties, energy, positions and forces."""
    from framewright.sources.extxyz import extxyz

    per = A.framed(spark, sf_dir, A.headers(spark, sf_dir), "l_linenumber", "symbol", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    xyz = lambda line: zip("xyz", A.place_of(line), strict=True)
    atom = lambda line: F.struct(line["symbol"].alias("symbol"), *(c.alias(name) for name, c in xyz(line)), A.force_of(line).alias("force"))
    boxl = F.array(F.lit(10.0), F.lit(10.0), F.col("volume") / 100)
    own = per.select(*KEYS, boxl.alias("boxl"), F.transform("lines", atom).alias("atoms"), F.to_json(F.struct("energy")).alias("metadata"))
    return own.select(*KEYS, extxyz()("boxl", "atoms", "metadata").alias("frame"))


@query("key_codec", f"WITH {HEADS} SELECT traj_id, frame_idx, printf('%016x%08x', traj_id, frame_idx) AS key, true AS same, true AS strict FROM h")
def key_codec(spark, sf_dir):
    """Keys as bytes and back; a byte too few or too many is no key."""
    from framewright.functions import keys as C

    data = C.key_bytes(F.col("traj_id"), F.col("frame_idx"))
    coded = A.headers(spark, sf_dir).select(*KEYS, data.alias("data"))
    wrong = C.key_of(F.expr("substring(data, 2)")).isNull() & C.key_of(F.expr("concat(data, unhex('00'))")).isNull()
    return coded.select(*KEYS, F.lower(F.hex("data")).alias("key"), (C.key_of(F.col("data")) == F.struct(*KEYS)).alias("same"), wrong.alias("strict"))


@query("reindex_idempotent", f"WITH {DOCS} SELECT traj_id, frame_idx, content_hash, is_rep FROM r")
def reindex_idempotent(spark, sf_dir):
    from framewright.plans.dedup import mark_representatives

    docs = A.screened_documents(spark, sf_dir)
    return mark_representatives(docs, "key").select(*KEYS, "content_hash", "is_rep")


@query("xxh3_hash")
def xxh3_hash(spark, sf_dir):
    return A.documents(spark, sf_dir).select(*KEYS, content_hash(F.col("blob")).alias("content_hash"))


# Texts and their xxh3-128 digests (seed 0), bytes in little-endian order.
_DIGESTS = {
    "": "7f498d4624c30160d8984701d306aa99",
    "a": "1f4e961eb632c6e63468f15a70af6fa9",
    "abc": "50392f89945faf7885613a73b65ab006",
    "frame": "003afe2aa2806f787723713c2ac043b0",
    "0123456789abcdef0123456789abcdef": "ff5d82a778635ffe725ca012554d9ccc",
}
# Positions and forces of two frames and their blocks.
_BLOCKS = {
    ((1.0, 2.0, -0.5),): "5243534f01000000010000000000000000000000" + "00000000" + "000000000000f03f" + "0000000000000040" + "000000000000e0bf",
    ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)): "5243534f01000000020000000000000000000000" + "00000000" + "000000000000f03f" + "00" * 32 + "000000000000f03f",
}


@query("xxh3_known", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{h}')" for t, h in _DIGESTS.items()) + ") AS v(blob, content_hash)")
def xxh3_known(spark, sf_dir):
    """Known answers of the content hash."""
    return spark.createDataFrame([(t,) for t in _DIGESTS], "blob string").select("blob", content_hash(F.col("blob")).alias("content_hash"))


@query("rcso_known", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{h}', {len(p)})" for k, (p, h) in enumerate(_BLOCKS.items())) + ") AS v(k, rcso, n)")
def rcso_known(spark, sf_dir):
    """Known answers of the block format, written and read."""
    rows = spark.createDataFrame([(k, [{"x": x, "y": y, "z": z} for x, y, z in p]) for k, p in enumerate(_BLOCKS)], "k int, positions array<struct<x:double,y:double,z:double>>")
    none = F.lit(None).cast("array<struct<x:double,y:double,z:double>>")
    coded = rows.select("k", soa.rcso_encode("positions", none, none).alias("data"))
    return coded.select("k", F.lower(F.hex("data")).alias("rcso"), F.size(soa.rcso_decode("data")["positions"]).alias("n"))


@query("rcso_roundtrip", "SELECT CAST(label AS BIGINT) AS traj_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx, true AS positions_equal, true AS forces_equal, true AS no_velocities FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 63")
def rcso_roundtrip(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    none = F.lit(None).cast("array<struct<x:double,y:double,z:double>>")
    back = v.select(*KEYS, "positions", soa.rcso_decode(soa.rcso_encode("positions", "positions", none)).alias("c"))
    return back.select(*KEYS, (F.col("c.positions") == F.col("positions")).alias("positions_equal"), (F.col("c.forces") == F.col("positions")).alias("forces_equal"), F.col("c.velocities").isNull().alias("no_velocities"))


@query("con_parse", f"WITH {FRAMES} SELECT traj_id * 1000000 + frame_idx AS traj_id, natoms, formula, round(mass, 6) AS mass, CAST(1000 AS DOUBLE) AS volume FROM f WHERE natoms > 0")
def con_parse(spark, sf_dir):
    """Frames rendered from order lines as text, parsed back and projected."""
    from framewright.operators.project import project_parsed
    from framewright.sources import con

    per = A.framed(spark, sf_dir, A.headers(spark, sf_dir), "symbol", "l_quantity", "l_extendedprice", "l_discount")
    per = per.withColumn("groups", F.array_distinct(F.transform("lines", lambda p: p["symbol"])))
    own = lambda s: F.filter("lines", lambda p: p["symbol"] == s)
    block = lambda s: F.concat(s, F.lit("\nCoordinates of Component\n"), F.array_join(F.transform(own(s), lambda p: F.format_string("%.6f %.6f %.6f 0 0", *A.place_of(p))), "\n"))
    text = F.concat(
        F.lit('frame\n{"con_spec_version":2}\n10.0 10.0 10.0\n90.0 90.0 90.0\n\n\n'),
        F.size("groups").cast("string"),
        F.lit("\n"),
        F.array_join(F.transform("groups", lambda s: F.size(own(s)).cast("string")), " "),
        F.lit("\n"),
        F.array_join(F.transform("groups", lambda s: F.format_string("%.6f", A.mass_of(s).cast("double") / 1e6)), " "),
        F.lit("\n"),
        F.array_join(F.transform("groups", block), "\n"),
        F.lit("\n"),
    )
    parsed = con.parse_rows(per.select((F.col("traj_id") * 1_000_000 + F.col("frame_idx")).alias("traj_id"), text.alias("text")))
    return project_parsed(parsed).select("traj_id", "natoms", "formula", F.round("mass", 6).alias("mass"), F.round("volume", 6).alias("volume"))


for _name, (_run, _sql) in stored.QUERIES.items():
    query(_name, f"WITH {FRAMES}, {stored.OWN} {_sql}")(_run)
