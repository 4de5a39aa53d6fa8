"""A corpus of trajectory frames: ingest, screening, dedup, extraction, maintenance, export."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.errors import ConcurrentCommit, CorpusError, MissingFrame, ParseError, TrajectoryExists
from framewright.functions.hashing import hash_bytes
from framewright.functions.soa import rcso_valid
from framewright.operators import extract
from framewright.operators.project import project_parsed, with_frame_idx
from framewright.operators.store import Store
from framewright.plans import dedup
from framewright.plans.select import Select, select_keys
from framewright.schema import BLOBS, FRAMES, KEYS, SOA, TRAJ
from framewright.sources import con, extxyz

MAX_ID = 2**63 - 1
DEFAULT_SHARDS = 64
#: Rows of a task that writes frames or texts; ranges of keys, so a shard and a trajectory may be written by many tasks.
ROWS_A_TASK = 250_000


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """Rows by shard and key in ranges of about ROWS_A_TASK, each sorted: files hold narrow ranges of keys."""
    return rows.repartitionByRange(max(1, -(-n // ROWS_A_TASK)), "shard", *KEYS).sortWithinPartitions("shard", *KEYS)


class Corpus:
    """``Corpus(spark, path)`` opens or creates. n_shards partitions frames and blobs by traj_id mod n_shards; an existing corpus keeps its own."""

    def __init__(self, spark: SparkSession, path: str, n_shards: int = 1, hash_mode: str = "xxh3"):
        self.spark, self.store = spark, Store(spark, path)
        if self.store.exists("shards.json"):
            found = json.loads(self.store.read_text("shards.json"))
            n_shards, hash_mode = found["n_shards"], found["hash_mode"]
        else:
            if n_shards < 1:
                raise CorpusError("a corpus has at least one shard")
            try:
                self.store.create("shards.json", json.dumps({"n_shards": n_shards, "hash_mode": hash_mode}))
            except ConcurrentCommit:
                found = json.loads(self.store.read_text("shards.json"))
                n_shards, hash_mode = found["n_shards"], found["hash_mode"]
        self.n_shards, self.hash_mode = n_shards, hash_mode

    # -- tables of the newest commit

    @property
    def frames(self) -> DataFrame:
        return self.store.table(self.store.manifest(), "frames", FRAMES)

    @property
    def blobs(self) -> DataFrame:
        return self.store.table(self.store.manifest(), "blobs", BLOBS)

    @property
    def trajectories(self) -> DataFrame:
        return self.store.table(self.store.manifest(), "traj_meta", TRAJ)

    @property
    def cooked(self) -> DataFrame:
        return self.store.table(self.store.manifest(), "frames_soa", SOA)

    def traj_meta(self, traj_id: int):
        """Row(n_frames, source) or None."""
        return self.trajectories.where(F.col("traj_id") == traj_id).select("n_frames", "source").first()

    # -- ingest

    def append(self, texts: DataFrame, retries: int = 8) -> dict[str, int]:
        """texts (traj_id, text, source): every row is a new trajectory. All or nothing; {'trajectories': n, 'frames': n}.

        Parsing and projection run on executors before the commit; the commit itself is one small file. A concurrent
        commit is retried against the new state, without parsing again.
        """
        texts = texts.select(F.col("traj_id").cast("long"), "text", "source")
        odd = texts.groupBy("traj_id").count().where(f"count > 1 or traj_id is null or traj_id < 0 or traj_id > {MAX_ID}").first()
        if odd is not None:
            raise CorpusError(f"trajectory id {odd.traj_id} is repeated or out of range")
        self._guard(texts)
        staged = self._stage(con.parse_rows(texts))
        counts = staged["rows"].groupBy("traj_id").agg(F.count("*").alias("n"))
        return self._commit(staged, lambda seq: texts.join(counts, "traj_id", "left").select("traj_id", F.coalesce("n", F.lit(0)).alias("n_frames"), "source", F.lit(seq).cast("long").alias("commit_seq")), lambda: self._guard(texts), retries)

    def _guard(self, texts: DataFrame) -> None:
        if not self.store.manifest()["tables"]["traj_meta"]:
            return  # nothing is stored; the new ids need not be computed
        there = self.trajectories.join(texts.select("traj_id"), "traj_id", "left_semi").limit(10).collect()
        if there:
            raise TrajectoryExists([r.traj_id for r in there])

    def _stage(self, parsed: DataFrame, shift: DataFrame | None = None) -> dict:
        """Projects once into a staged table; frames and blobs are written from it at commit."""
        rows = project_parsed(parsed, self.hash_mode)
        if shift is not None:
            rows = rows.join(F.broadcast(shift), "traj_id").withColumn("frame_idx", F.col("frame_idx") + F.col("shift")).drop("shift")
        rows = rows.withColumn("shard", F.pmod("traj_id", F.lit(self.n_shards)).cast("int"))
        try:
            part = self.store.stage(rows, "_projected")
        except Exception as e:
            if "ParseError" in str(e):
                raise ParseError(str(e).split("ParseError: ")[-1].split("\n")[0]) from None
            raise
        rows = self.spark.read.parquet(f"{self.store.path}/{part}")
        return {"rows": rows, "part": part, "n": rows.count()}

    def _with_representatives(self, base: dict, rows: DataFrame, seq: int, n: int) -> DataFrame:
        """New frames of commit ``seq``: a row represents its content if ``base`` lacks the hash and it is the first of this commit."""
        new = rows.drop("blob").withColumn("commit_seq", F.lit(seq).cast("long"))
        fresh = new.groupBy("content_hash").agg(F.min(F.struct(*KEYS)).alias("f"))
        if base["tables"]["frames"]:
            known = self.store.table(base, "frames", FRAMES).where("is_rep").select("content_hash")
            if n <= extract.BROADCAST_KEYS:  # few new frames: the stored hashes are read, not dealt
                known = known.join(F.broadcast(fresh.select("content_hash")), "content_hash", "left_semi")
            fresh = fresh.join(known, "content_hash", "left_anti")
        fresh = fresh.select("f.*", F.lit(True).alias("r"))
        return new.join(fresh, KEYS, "left").withColumn("is_rep", F.coalesce("r", F.lit(False))).drop("r").select([f.name for f in FRAMES])

    def _commit(self, staged: dict, meta, guard, retries: int) -> dict[str, int]:
        rows, n = staged["rows"], staged["n"]
        blobs = self.store.stage(_ranged(staged.get("blobs", rows).select(*KEYS, "blob", "shard"), n), "blobs", "shard")
        for _ in range(retries):
            base = self.store.manifest()
            seq = base["version"] + 1
            frames = self.store.stage(_ranged(self._with_representatives(base, rows, seq, n), n), "frames", "shard")
            trajectories = self.store.stage(meta(seq), "traj_meta")
            tables = base["tables"]
            try:
                self.store.publish(base, {"frames": [*tables["frames"], frames], "blobs": [*tables["blobs"], blobs], "traj_meta": [*tables["traj_meta"], trajectories]})
            except ConcurrentCommit:
                guard()
                continue
            if staged["part"]:
                self.store.remove(staged["part"])
            return {"trajectories": self.store.table(self.store.manifest(seq), "traj_meta", TRAJ).where(f"commit_seq = {seq}").count(), "frames": n}
        raise ConcurrentCommit("too many concurrent commits")

    def append_text(self, traj_id: int, text: str, source: str = "") -> int:
        return self.append(self.spark.createDataFrame([(traj_id, text, source)], "traj_id long, text string, source string"))["frames"]

    def append_path(self, traj_id: int, path: str, cook: bool = False) -> int:
        n = self.append(con.read_files(self.spark, [(traj_id, path)]))["frames"]
        if cook:
            self.cook(self.frames.where(F.col("traj_id") == traj_id).select(*KEYS))
        return n

    def append_frames(self, traj_id: int, frames: Iterable[con.Frame], source: str = "") -> int:
        return self.append_text(traj_id, "".join(map(con.render, frames)), source)

    def append_atoms(self, atoms: DataFrame, source: str = "") -> dict[str, int]:
        """New trajectories from a table of atoms: traj_id, frame_idx, symbol, x, y, z and optionally atom_id, fixed, mass,
        velocity, force (structs of x, y, z), and per frame metadata (JSON), boxl and angles (arrays of three).

        Atoms of a frame are ordered by atom_id, then position; frames are numbered from 0 in the order of frame_idx. Texts are canonical.
        """

        def column(name: str, kind: str, default):
            c = (F.col(name) if name in atoms.columns else F.lit(None)).cast(kind)
            return c if default is None else F.coalesce(c, default)

        xyz = "struct<x:double,y:double,z:double>"
        atom = F.struct(column("atom_id", "long", F.lit(0)).alias("atom_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), F.col("symbol"), column("fixed", "long", F.lit(0)).alias("fixed"), column("mass", "double", F.lit(0.0)).alias("mass"), column("velocity", xyz, None).alias("velocity"), column("force", xyz, None).alias("force"))
        three = lambda x: F.array(*[F.lit(x)] * 3)
        per = atoms.groupBy(*KEYS).agg(F.sort_array(F.collect_list(atom)).alias("atoms"), F.first(column("metadata", "string", F.lit("{}"))).alias("metadata"), F.first(column("boxl", "array<double>", three(0.0))).alias("boxl"), F.first(column("angles", "array<double>", three(90.0))).alias("angles"))
        return self.append_frame_table(per, source)

    def append_frame_table(self, frames: DataFrame, source: str = "") -> dict[str, int]:
        """New trajectories from a table with a row for each frame: traj_id, frame_idx, metadata, boxl, angles, and atoms: an
        array in the order of the text, of structs with the fields of ``schema.ATOM``.

        Frames are numbered from 0 in the order of frame_idx; texts are canonical.
        """
        self._guard(frames)
        per = with_frame_idx(frames.withColumnRenamed("frame_idx", "given"), "traj_id", "given")
        staged = self._stage(con.canonical_rows(per))
        counts = staged["rows"].groupBy("traj_id").agg(F.count("*").alias("n_frames"))
        return self._commit(staged, lambda seq: counts.select("traj_id", "n_frames", F.lit(source).alias("source"), F.lit(seq).cast("long").alias("commit_seq")), lambda: self._guard(counts), 8)

    def ingest_directory(self, folder: str, start_id: int = 1) -> list[tuple[int, int, str]]:
        """(traj_id, n_frames, path) of the .con and .convel files of a folder, in path order, ids counted from start_id."""
        paths = [f"{folder.rstrip('/')}/{p}" for p in self.store.listing(folder) if p.endswith((".con", ".convel"))]
        if not paths:
            return []
        files = [(start_id + k, p) for k, p in enumerate(paths)]
        self.append(con.read_files(self.spark, files))
        n = {r.traj_id: r.n_frames for r in self.trajectories.where(F.col("traj_id").between(start_id, start_id + len(paths) - 1)).collect()}
        return [(i, n[i], p) for i, p in files]

    def extend(self, traj_id: int, frames: Iterable[con.Frame], source: str = "") -> int:
        """Adds frames after the trajectory's last one and keeps its source; the new total. A missing trajectory is created."""
        base = self.store.manifest()
        old = self.store.table(base, "traj_meta", TRAJ).where(F.col("traj_id") == traj_id).first()
        if old is None:
            return self.append_frames(traj_id, frames, source)
        text = self.spark.createDataFrame([(traj_id, "".join(map(con.render, frames)))], "traj_id long, text string")
        shift = self.spark.createDataFrame([(traj_id, old.n_frames)], "traj_id long, shift long")
        staged = self._stage(con.parse_rows(text), shift)
        total = old.n_frames + staged["n"]
        others = self.store.table(base, "traj_meta", TRAJ).where(F.col("traj_id") != traj_id)
        seq = base["version"] + 1
        meta = others.unionByName(self.spark.createDataFrame([(traj_id, total, old.source, seq)], TRAJ))
        rows, n, t = staged["rows"], staged["n"], base["tables"]
        new = {
            "frames": [*t["frames"], self.store.stage(_ranged(self._with_representatives(base, rows, seq, n), n), "frames", "shard")],
            "blobs": [*t["blobs"], self.store.stage(_ranged(rows.select(*KEYS, "blob", "shard"), n), "blobs", "shard")],
            "traj_meta": [self.store.stage(meta, "traj_meta")],
        }
        self.store.publish(base, new)
        self.store.remove(staged["part"])
        return total

    # -- queries

    def select(self, sel: Select | None = None) -> DataFrame:
        """Sorted frame keys."""
        return select_keys(self.frames, sel or Select(), self.n_shards if self.n_shards > 1 else None)

    def list_keys(self) -> DataFrame:
        return self.select()

    def unique_frame_keys(self, sel: Select | None = None) -> DataFrame:
        return dedup.unique_frame_keys(self.frames, sel or Select(), self.n_shards if self.n_shards > 1 else None)

    def find_by_hash(self, content_hash: str) -> tuple[int, int] | None:
        row = self.select(Select().exact_hash(content_hash)).first()
        return None if row is None else tuple(row)

    def frame_hash(self, key: tuple[int, int]) -> str:
        row = self._one(self.frames, key).select("content_hash").first()
        if row is None:
            raise MissingFrame(key)
        return row.content_hash

    def hash_text(self, text: str) -> str:
        """Hash of the first frame of a text in canonical form."""
        frame = next(con.parse(text), None)
        if frame is None:
            raise ParseError("no frame")
        return hash_bytes(con.render(frame))

    def _one(self, table: DataFrame, key: tuple[int, int]) -> DataFrame:
        out = table.where((F.col("traj_id") == key[0]) & (F.col("frame_idx") == key[1]))
        return out.where(F.col("shard") == key[0] % self.n_shards) if "shard" in table.columns else out

    def frame_text(self, key: tuple[int, int]) -> str:
        row = self._one(self.blobs, key).select("blob").first()
        if row is None:
            raise MissingFrame(key)
        return row.blob

    def frame(self, key: tuple[int, int]) -> con.Frame:
        return next(con.parse(self.frame_text(key)))

    def frame_formula(self, key: tuple[int, int]) -> str:
        from framewright.functions.scalars import composition_formula, species_counts

        return composition_formula(species_counts(a.symbol for a in self.frame(key).atoms))

    def _keys(self, keys: Iterable[tuple[int, int]] | DataFrame) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys if "pos" in keys.columns else self._numbered(keys)
        return self.spark.createDataFrame([(k, int(t), int(f)) for k, (t, f) in enumerate(keys)], "pos long, traj_id long, frame_idx long")

    @staticmethod
    def _numbered(keys: DataFrame) -> DataFrame:
        return keys.select(*KEYS).withColumn("pos", F.monotonically_increasing_id())

    def frame_texts(self, keys: Iterable[tuple[int, int]] | DataFrame) -> DataFrame:
        """(pos, keys, blob) in the order given, repeats allowed; MissingFrame for the first key that isn't there."""
        keys = self._keys(keys)
        extract.first_missing(self.blobs, keys)
        texts = extract.texts_of(self.blobs, keys, keys.limit(extract.BROADCAST_KEYS + 1).count() <= extract.BROADCAST_KEYS)
        return texts.orderBy("pos")

    def touch(self, traj_id: int, n: int) -> tuple[int, int]:
        """Bytes and checksum of frames 0 to n-1."""
        part = self.blobs.where((F.col("traj_id") == traj_id) & (F.col("shard") == traj_id % self.n_shards) & (F.col("frame_idx") < n))
        row = extract.touch(part).first()
        if n and (row is None or row.n_frames < n):
            have = part.select("frame_idx")
            # The first gap is 0 or the successor of a frame that is there.
            after = have.select((F.col("frame_idx") + 1).alias("frame_idx")).unionByName(self.spark.createDataFrame([(0,)], "frame_idx long"))
            raise MissingFrame((traj_id, after.join(have, "frame_idx", "left_anti").agg(F.min("frame_idx")).first()[0]))
        return (row.n_bytes, row.checksum) if n else (0, 0)

    # -- numeric arrays and the cooked tier

    def _parsed(self, keys: DataFrame | None = None) -> DataFrame:
        blobs = self.blobs if keys is None else self.blobs.join(keys.select(*KEYS).distinct(), KEYS, "left_semi")
        return con.parse_frames(blobs)

    def arrays(self, keys: Iterable[tuple[int, int]] | DataFrame | None = None) -> DataFrame:
        """keys, positions, forces, velocities as arrays of x, y, z."""
        keys = None if keys is None else self._keys(keys)
        cooked = self.cooked if keys is None else self.cooked.join(keys.select(*KEYS).distinct(), KEYS, "left_semi")
        return extract.arrays(self._parsed(keys), cooked)

    def _vectors(self, key: tuple[int, int], name: str):
        row = self.arrays([key]).first()
        if row is None:
            raise MissingFrame(key)
        return None if row[name] is None else [tuple(v) for v in row[name]]

    def positions(self, key: tuple[int, int]):
        return self._vectors(key, "positions")

    def forces(self, key: tuple[int, int]):
        return self._vectors(key, "forces")

    def velocities(self, key: tuple[int, int]):
        return self._vectors(key, "velocities")

    def cook(self, keys: Iterable[tuple[int, int]] | DataFrame | None = None) -> int:
        """Writes RCSO blocks of the keys (all without) over older ones."""
        keys = None if keys is None else self._keys(keys)
        return self.put_cooked(extract.cook(self._parsed(keys)), replace=keys is None)

    def put_cooked(self, rows: DataFrame, replace: bool = False) -> int:
        base = self.store.manifest()
        new = self.store.stage(rows.select(*KEYS, "rcso"), "frames_soa")
        added = self.spark.read.schema(SOA).parquet(f"{self.store.path}/{new}")
        parts = [new]
        if not replace and base["tables"]["frames_soa"]:
            kept = self.store.table(base, "frames_soa", SOA).join(added, KEYS, "left_anti")
            parts.append(self.store.stage(kept, "frames_soa"))
        self.store.publish(base, {"frames_soa": parts})
        return added.count()

    def delete_cooked(self, key: tuple[int, int]) -> None:
        base = self.store.manifest()
        kept = self.store.table(base, "frames_soa", SOA).where(~((F.col("traj_id") == key[0]) & (F.col("frame_idx") == key[1])))
        self.store.publish(base, {"frames_soa": [self.store.stage(kept, "frames_soa")]})

    def cooked_bytes(self, key: tuple[int, int]) -> bytes | None:
        row = self._one(self.cooked, key).first()
        return None if row is None else bytes(row.rcso)

    def has_valid_cooked(self, key: tuple[int, int]) -> bool:
        row = self._one(self.cooked, key).select(rcso_valid("rcso").alias("ok")).first()
        return bool(row and row.ok)

    # -- maintenance

    def reindex(self) -> int:
        """Derives all screening columns again from the texts; representatives become the smallest keys. Idempotent."""
        base = self.store.manifest()
        old = self.store.table(base, "frames", FRAMES).select(*KEYS, "commit_seq")
        rows = project_parsed(self._parsed(), self.hash_mode).drop("blob").withColumn("shard", F.pmod("traj_id", F.lit(self.n_shards)).cast("int"))
        projected = self.store.stage(rows, "_projected")
        rows = self.spark.read.parquet(f"{self.store.path}/{projected}")
        n = rows.count()
        rows = dedup.mark_representatives(rows, "key").join(old, KEYS, "left").withColumn("commit_seq", F.coalesce("commit_seq", F.lit(0))).select([f.name for f in FRAMES])
        part = self.store.stage(_ranged(rows, n), "frames", "shard")
        self.store.publish(base, {"frames": [part]})
        self.store.remove(projected)
        return n

    def compact(self) -> dict[str, int]:
        """Rewrites the parts of all commits as one part a table; {table: parts before}. Contents stay, older manifests keep their parts."""
        base, new, before = self.store.manifest(), {}, {}
        for name, schema in (("frames", FRAMES), ("blobs", BLOBS), ("traj_meta", TRAJ), ("frames_soa", SOA)):
            before[name] = len(base["tables"][name])
            if before[name] < 2:
                continue
            rows = self.store.table(base, name, schema)
            sharded = "shard" in rows.columns
            new[name] = [self.store.stage(_ranged(rows, rows.count()) if sharded else rows, name, "shard" if sharded else None)]
        if new:
            self.store.publish(base, new)
        return before

    # -- export

    def export_extxyz(self, keys: Iterable[tuple[int, int]] | DataFrame, path: str, energy_key: str | None = "energy") -> int:
        """Frames in the order given, to one file; the number written. Rendering runs on executors, rows arrive one partition at a time."""
        keys = self._keys(keys)
        extract.first_missing(self.blobs, keys)
        texts = extract.texts_of(self.blobs, keys, keys.limit(extract.BROADCAST_KEYS + 1).count() <= extract.BROADCAST_KEYS)
        return extxyz.write_stream((r.text for r in self._rendered(texts.orderBy("pos"), energy_key).toLocalIterator()), path)

    def export_extxyz_parts(self, keys: DataFrame, folder: str, energy_key: str | None = "energy") -> None:
        """The same as a folder of part files in order, written in parallel; MissingFrame for the first key that isn't there."""
        keys = self._keys(keys)
        extract.first_missing(self.blobs, keys)
        # Rendering keeps the order, so the texts are sorted, not what is rendered of them: sorting reads its input twice.
        out = self._rendered(extract.texts_of(self.blobs, keys).orderBy("pos"), energy_key)
        out.select(F.regexp_replace("text", "\n$", "").alias("value")).write.text(folder)

    @staticmethod
    def _rendered(texts: DataFrame, energy_key: str | None) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for blob in batch.column(1).to_pylist():
                    _, metadata, boxl, _, _, atoms, *_ = next(con.rows(blob))
                    forces = [a[8] for a in atoms]
                    out.append(extxyz.text_of(boxl, [a[0] for a in atoms], [a[1:4] for a in atoms], forces, metadata, energy_key))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["pos", "text"])

        return texts.select("pos", "blob").mapInArrow(run, "pos long, text string")

    def export_unique(self, sel: Select, path: str) -> int:
        return self.export_extxyz(self.unique_frame_keys(sel), path, "energy")


def _rewrite(sources: list[tuple[Corpus, Column]], dst: Corpus) -> int:
    """Fills an empty corpus from others, each with a column that labels the source of its trajectories.

    Texts are copied. So are the screening columns that a commit derived from them, unless the source hashes contents
    otherwise: then they are projected again. Representatives are those of the new corpus. No trajectory is gathered into one value.
    """
    shard = F.pmod("traj_id", F.lit(dst.n_shards)).cast("int")
    together = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    screened = [f.name for f in FRAMES if f.name not in ("is_rep", "commit_seq", "shard")]
    # Each source is read at one commit.
    pinned = [(s, label, s.store.manifest()) for s, label in sources]
    frames, blobs, labels, parts = [], [], [], []
    for s, label, at in pinned:
        own = s.store.table(at, "frames", FRAMES)
        texts = s.store.table(at, "blobs", BLOBS)
        labels.append(own.groupBy("traj_id").agg(F.count("*").alias("n_frames"), F.min(label).alias("source")))
        blobs.append(texts.select(*KEYS, "blob", shard.alias("shard")))
        if s.hash_mode != dst.hash_mode:
            staged = dst._stage(con.parse_frames(texts))
            parts.append(staged["part"])
            own = staged["rows"]
        frames.append(own.select(*screened, shard.alias("shard")))
    rows, meta = together(frames), together(labels)
    staged = {"rows": rows, "blobs": together(blobs), "part": None, "n": rows.count()}
    n = dst._commit(staged, lambda seq: meta.withColumn("commit_seq", F.lit(seq).cast("long")), lambda: None, 8)["frames"]
    for part in parts:
        dst.store.remove(part)
    return n


def _no_shared(metas: list[DataFrame]) -> None:
    together = metas[0].select("traj_id")
    for m in metas[1:]:
        together = together.unionByName(m.select("traj_id"))
    twice = together.groupBy("traj_id").count().where("count > 1").limit(10).collect()
    if twice:
        raise TrajectoryExists([r.traj_id for r in twice])


def join_shards(src: Corpus, dst_path: str) -> Corpus:
    """A single-shard corpus with all of a sharded one. The destination is replaced; trajectories without frames are dropped."""
    Store(src.spark, dst_path).delete()
    dst = Corpus(src.spark, dst_path, 1, src.hash_mode)
    _rewrite([(src, F.concat(F.lit("join-from-shard-"), F.col("shard").cast("string")))], dst)
    return dst


def split_shards(src: Corpus, dst_path: str, n_shards: int = DEFAULT_SHARDS) -> Corpus:
    dst = Corpus(src.spark, dst_path, n_shards, src.hash_mode)
    _rewrite([(src, F.lit("split-from-single"))], dst)
    return dst


def join_corpora(sources: list[Corpus], dst_path: str) -> Corpus:
    """One corpus of several with disjoint trajectories."""
    _no_shared([s.trajectories for s in sources])
    dst = Corpus(sources[0].spark, dst_path, 1, sources[0].hash_mode)
    _rewrite([(s, F.lit(f"join-from-corpus-{k}")) for k, s in enumerate(sources)], dst)
    return dst
