from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from framewright import Corpus, Select, join_corpora, join_shards, split_shards
from framewright.errors import ConcurrentCommit, CorpusError, MissingFrame, ParseError, TrajectoryExists
from framewright.functions import scalars, soa
from framewright.functions.hashing import hash_bytes
from framewright.functions.ranges import ordered_range
from framewright.sources import con, extxyz

HEAD = "a seed\n{meta}\n15.3456\t21.702\t100.0\n90.0\t90.0\t90.0\n0 0\n\n2\n2 2\n63.546 1.00793\n"
BODY = "Cu\nCoordinates of Component 1\n0.6 0.9 6.9 1 0\n3.1 0.9 6.9 1 1\nH\nCoordinates of component 2\n8.6 9.9 {z} 0 2\n7.9 9.9 11.7 0 3\n"
VEL = "\nCu\nVelocities of Component 1\n0.1 0.2 0.3 1 0\n0.4 0.5 0.6 1 1\nH\nVelocities of Component 2\n0 0 0 0 2\n0 0 0 0 3\n"
FORCE = "\nCu\nForces of Component 1\n3 4 0 1 0\n0 0 1 1 1\nH\nForces of Component 2\n0 0 0 0 2\n0 0 0 0 3\n"


def frame(meta='{"con_spec_version":2}', z=11.7, *sections):
    return HEAD.replace("{meta}", meta) + BODY.replace("{z}", str(z)) + "".join(sections)


PLAIN = frame()
RICH = frame('{"energy":-42.5,"pbc":[true,true,false],"charge":-1.0,"magmom":2,"time":1.5,"timestep":0.25,"frame_index":7,"neb_bead":2,"neb_band":1,"sections":["velocities","forces"]}', 11.7, VEL, FORCE)


@pytest.fixture
def corpus(spark, tmp_path):
    return Corpus(spark, str(tmp_path / "corpus"))


def keys(df):
    return [tuple(r)[:2] for r in df.collect()]


def test_parser_keeps_spans_and_sections():
    text = PLAIN + RICH + frame("{}", 1.0, VEL) + PLAIN
    frames = list(con.parse(text))
    assert "".join(f.blob for f in frames) == text
    assert [(f.has_forces, f.has_velocities) for f in frames] == [(False, False), (True, True), (False, True), (False, False)]
    assert frames[1].atoms[0].force == (3, 4, 0) and frames[1].atoms[1].velocity == (0.4, 0.5, 0.6)
    assert list(con.parse("")) == [] and list(con.parse("\n\n")) == []


@pytest.mark.parametrize("bad", [PLAIN[:-30], PLAIN.replace("\n2 2\n", "\n2 x\n"), PLAIN.replace("{", "["), "one\n", PLAIN.replace("\n2\n2 2", "\n2\n2")])
def test_parser_is_strict_on_counts(bad):
    with pytest.raises(ParseError):
        list(con.parse(bad))


def test_render_is_canonical():
    for text in (PLAIN, RICH):
        f = next(con.parse(text))
        once = con.render(f)
        assert con.render(next(con.parse(once))) == once
        assert [a.symbol for a in next(con.parse(once)).atoms] == ["Cu", "Cu", "H", "H"]


def test_scalars_and_codecs():
    assert scalars.composition_formula({"H": 2, "Cu": 2, "C": 1}) == "C:1|Cu:2|H:2"
    assert scalars.species_counts(["H", "Cu", "H"]) == {"H": 2, "Cu": 1}
    assert scalars.pbc_mask((True, False, True)) == 5
    data = soa.encode([[1, 2, 3]], [[4, 5, 6]])
    assert len(data) == 72 and soa.decode(data)["forces"].tolist() == [[4, 5, 6]] and soa.decode(data)["velocities"] is None
    assert soa.decode(data + b"trailing")["positions"].tolist() == [[1, 2, 3]]
    for bad in (b"", b"XXXX", b"XXXX_not_valid", data[:-1], b"RCSO" + b"\x02" + data[5:], None):
        assert soa.decode(bad) is None
    assert len(soa.encode([[0, 0, 0]] * 4)) == 120
    assert hash_bytes("") == "7f498d4624c30160d8984701d306aa99"


def test_signed_zero_and_open_bounds(spark):
    df = spark.createDataFrame([(-1.0,), (-0.0,), (0.0,), (1.0,), (None,)], "v double")

    def hits(lo, hi):
        return sorted(str(r.v) for r in df.where(ordered_range(F.col("v"), lo, hi)).collect())

    assert hits(0.0, 1.0) == ["0.0", "1.0"] and hits(-0.0, 1.0) == ["-0.0", "0.0", "1.0"]
    assert hits(-1.0, -0.0) == ["-0.0", "-1.0"] and hits(-1.0, 0.0) == ["-0.0", "-1.0", "0.0"]
    assert len(hits(math.nan, math.inf)) == 4 and len(hits(math.inf, -math.inf)) == 4 and hits(1.0, 0.5) == [] and len(hits(None, None)) == 4


def test_ingest_project_and_every_screen(corpus):
    assert corpus.append_text(1, PLAIN + PLAIN, "two") == 2
    assert corpus.append_text(5, RICH, "rich") == 1
    row = corpus.frames.where("traj_id = 5").first()
    assert (row.natoms, row.formula, row.energy, row.fmax, row.pbc_mask) == (4, "Cu:2|H:2", -42.5, 5.0, 3)
    assert row.mass == pytest.approx(129.10786) and row.volume == pytest.approx(33303.02112)
    hit, both, s = [(5, 0)], [(1, 0), (1, 1), (5, 0)], Select()
    cases = [
        (s, both),
        (s.trajectory(1), both[:2]),
        (s.natoms_range(5, 9), []),
        (s.require_symbol("Cu").require_symbol("H"), both),
        (s.require_symbol("C"), []),
        (s.exact_composition("Cu:2|H:2"), both),
        (s.exact_composition("H:2|Cu:2"), []),
        (s.element_exact("Cu", 2), both),
        (s.element_exact("Fe", 0), []),
        (s.element_min("H", 0).element_min("Cu", 3), []),
        (s.energy_range(-43, -42), hit),
        (s.energy_range(0, 1), []),
        (s.energy_range(math.nan, None), hit),
        (s.fmax_range(None, 5.0), hit),
        (s.mass_range(129, 130), both),
        (s.volume_range(1, 2), []),
        (s.pbc(True, True, False), hit),
        (s.pbc(True, True, True), []),
        (s.time_range(1, 2).timestep_range(0.25, 0.25).frame_index_range(7, 7).neb_bead_range(2, 2).neb_band_range(1, 1).charge_range(-1, -1).magmom_range(2, 2), hit),
        (s.charge_range(0, 1), []),
        (s.require_forces(), hit),
        (s.require_velocities(), hit),
        (s.require_energy(), hit),
        (s.limit(2), both[:2]),
        (s.limit(0), []),
        (s.energy_range(0, 1).energy_range(-50, 0), hit),
        (s.where(F.col("natoms") == 4).trajectory(5), hit),
    ]
    for k, (sel, want) in enumerate(cases):
        assert keys(corpus.select(sel)) == want, k
    before = [tuple(r) for r in corpus.frames.drop("commit_seq", "is_rep").orderBy("traj_id", "frame_idx").collect()]
    assert corpus.reindex() == 3 and corpus.reindex() == 3
    assert [tuple(r) for r in corpus.frames.drop("commit_seq", "is_rep").orderBy("traj_id", "frame_idx").collect()] == before


def test_random_selects_equal_a_set_model(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 3), r.choice([None, r.uniform(-1, 1)]), r.random() < 0.5, r.sample(["C", "Cu", "H"], r.randint(0, 3))) for i in range(60)]
    df = spark.createDataFrame([(i, 0, n, e, f, s, {x: k + 1 for k, x in enumerate(s)}) for i, n, e, f, s in rows], "traj_id long, frame_idx long, natoms long, energy double, has_forces boolean, symbols array<string>, species map<string,long>")
    for _ in range(12):
        sel, want = Select(), set(range(60))
        if r.random() < 0.5:
            lo, hi = sorted((r.uniform(-1, 1), r.uniform(-1, 1)))
            sel, want = sel.energy_range(lo, hi), want & {x[0] for x in rows if x[2] is not None and lo <= x[2] <= hi}
        if r.random() < 0.5:
            sel, want = sel.natoms_range(1, 2), want & {x[0] for x in rows if 1 <= x[1] <= 2}
        if r.random() < 0.5:
            sel, want = sel.require_forces(), want & {x[0] for x in rows if x[3]}
        if r.random() < 0.7:
            sel, want = sel.require_symbol("C").element_min("C", 2), want & {x[0] for x in rows if "C" in x[4] and x[4].index("C") >= 1}
        assert {x.traj_id for x in df.where(sel.predicate()).collect()} == want


def test_dedup_first_commit_wins_then_key_order(corpus):
    corpus.append_text(7, PLAIN)
    corpus.append_text(2, PLAIN + RICH)
    h = corpus.frame_hash((2, 0))
    assert h == hash_bytes(PLAIN) and corpus.find_by_hash(h) == (7, 0)
    assert keys(corpus.select(Select().exact_hash(h))) == [(7, 0)] and keys(corpus.select(Select().exact_hash(h).trajectory(2))) == []
    assert keys(corpus.unique_frame_keys()) == [(2, 1), (7, 0)]
    assert keys(corpus.unique_frame_keys(Select().limit(1))) == []
    corpus.reindex()
    assert corpus.find_by_hash(h) == (2, 0) and keys(corpus.unique_frame_keys()) == [(2, 0), (2, 1)]
    assert corpus.find_by_hash("0" * 32) is None


def test_guards_extend_and_empty_trajectories(corpus):
    assert corpus.append_text(1, "", "nothing") == 0
    assert corpus.traj_meta(1).n_frames == 0 and corpus.traj_meta(9) is None
    with pytest.raises(TrajectoryExists):
        corpus.append_text(1, PLAIN)
    with pytest.raises(ParseError):
        corpus.append_text(3, PLAIN + "broken")
    assert corpus.traj_meta(3) is None
    with pytest.raises(CorpusError):
        corpus.append_text(-1, PLAIN)
    f = list(con.parse(RICH))
    assert corpus.append_frames(4, f, "mem") == 1
    assert corpus.extend(4, f + f) == 3 and corpus.traj_meta(4).source == "mem"
    assert keys(corpus.list_keys()) == [(4, 0), (4, 1), (4, 2)] and keys(corpus.unique_frame_keys()) == [(4, 0)]
    base = corpus.store.manifest()
    corpus.store.publish(base, {})
    with pytest.raises(ConcurrentCommit):
        corpus.store.publish(base, {})


def test_texts_checksums_arrays_and_cooked_tier(corpus):
    corpus.append_text(1, PLAIN + RICH)
    assert corpus.frame_text((1, 1)) == RICH and corpus.frame_formula((1, 0)) == "Cu:2|H:2"
    assert [r.blob for r in corpus.frame_texts([(1, 1), (1, 0), (1, 1)]).collect()] == [RICH, PLAIN, RICH]
    for call in (lambda: corpus.frame_text((1, 5)), lambda: corpus.frame_texts([(1, 0), (8, 8)]), lambda: corpus.touch(1, 3), lambda: corpus.positions((4, 4))):
        with pytest.raises(MissingFrame):
            call()
    want = sum(b * (k + 1) for t in (PLAIN, RICH) for k, b in enumerate(t.encode()))
    assert corpus.touch(1, 2) == (len(PLAIN) + len(RICH), want) and corpus.touch(1, 0) == (0, 0)
    assert corpus.positions((1, 0))[0] == (0.6, 0.9, 6.9)
    assert corpus.forces((1, 0)) is None and corpus.forces((1, 1))[0] == (3, 4, 0) and corpus.velocities((1, 1))[3] == (0, 0, 0)
    assert corpus.cook([(1, 1)]) == 1 and corpus.has_valid_cooked((1, 1)) and not corpus.has_valid_cooked((1, 0))
    assert corpus.positions((1, 1))[1] == (3.1, 0.9, 6.9)
    corpus.put_cooked(corpus.spark.createDataFrame([(1, 1, bytearray(b"XXXX_not_valid"))], "traj_id long, frame_idx long, rcso binary"))
    assert not corpus.has_valid_cooked((1, 1)) and corpus.cooked_bytes((1, 1)) == b"XXXX_not_valid" and corpus.positions((1, 1))[0] == (0.6, 0.9, 6.9)
    assert corpus.cook() == 2 and corpus.has_valid_cooked((1, 1))
    corpus.delete_cooked((1, 1))
    assert corpus.cooked_bytes((1, 1)) is None and corpus.has_valid_cooked((1, 0))


def test_directory_source_export_and_data_source(corpus, spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "b.con").write_text(PLAIN + PLAIN)
    (folder / "a.convel").write_text(RICH)
    (folder / "c.txt").write_text("no")
    got = corpus.ingest_directory(str(folder), 10)
    assert [(i, n) for i, n, _ in got] == [(10, 1), (11, 2)]
    assert corpus.traj_meta(10).source.endswith("a.convel")
    out = str(tmp_path / "out.xyz")
    assert corpus.export_extxyz([(11, 1), (10, 0)], out) == 2
    frames = list(extxyz.frames(out))
    assert frames[0].startswith('4\nLattice="15.3456 0 0 0 21.702 0 0 0 100.0" Properties=species:S:1:pos:R:3 pbc="T T T"\nCu ')
    assert ":forces:R:3" in frames[1] and "energy=-42.5" in frames[1]
    assert frames[0].splitlines()[2] == "Cu " + " ".join(f"{v:16.10f}" for v in (0.6, 0.9, 6.9))
    assert corpus.export_unique(Select(), out) == 2
    con.register(spark)
    assert spark.read.format("con").load(str(folder)).groupBy("traj_id").count().count() == 2
    spark.createDataFrame([(RICH + PLAIN,)], "t string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT frame_idx, size(atoms) AS n FROM texts, LATERAL parse_con(t)").count() == 2


def test_shards_route_join_split(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "sharded"), 4)
    assert Corpus(spark, str(tmp_path / "sharded"), 9).n_shards == 4
    with pytest.raises(CorpusError):
        Corpus(spark, str(tmp_path / "none"), 0)
    for t in (1, 5, 6):
        c.append_text(t, PLAIN + RICH)
    assert {(r.traj_id, r.shard) for r in c.frames.collect()} == {(1, 1), (5, 1), (6, 2)}
    assert keys(c.select(Select().require_forces().limit(2))) == [(1, 1), (5, 1)]
    assert "PartitionFilters: [isnotnull(shard" in c.select(Select().trajectory(5))._jdf.queryExecution().toString()
    one = join_shards(c, str(tmp_path / "one"))
    assert keys(one.list_keys()) == keys(c.list_keys()) and one.traj_meta(6).source == "join-from-shard-2"
    back = split_shards(one, str(tmp_path / "back"), 3)
    assert {(r.traj_id, r.shard) for r in back.frames.collect()} == {(1, 1), (5, 2), (6, 0)} and back.frame_text((5, 1)) == RICH
    other = Corpus(spark, str(tmp_path / "other"))
    other.append_text(40, RICH)
    assert len(keys(join_corpora([one, other], str(tmp_path / "all")).list_keys())) == 7
    with pytest.raises(TrajectoryExists):
        join_corpora([one, c], str(tmp_path / "twice"))


def test_streamed_files_are_ingested_once(corpus, tmp_path):
    from framewright.streaming.ingest import ingest_stream

    folder = tmp_path / "stream"
    folder.mkdir()
    (folder / "a.con").write_text(PLAIN)
    ingest_stream(corpus, str(folder), str(tmp_path / "ckpt")).awaitTermination()
    (folder / "b.con").write_text(RICH)
    ingest_stream(corpus, str(folder), str(tmp_path / "ckpt")).awaitTermination()
    ingest_stream(corpus, str(folder), str(tmp_path / "ckpt-lost")).awaitTermination()
    assert corpus.frames.count() == 2


def test_command_line(spark, tmp_path):
    from framewright import cli

    (tmp_path / "x.con").write_text(PLAIN + RICH)
    lines = []

    def call(*argv):
        lines.clear()
        assert cli.run(cli.parser().parse_args([str(a) for a in argv]), spark, lines.append) == 0
        return list(map(str, lines))

    c = tmp_path / "c"
    assert call("ingest", c, tmp_path / "x.con", "--start-id", 3)[0].startswith("3\t2\t")
    assert call("select", c, "--symbol", "Cu", "--elem", "H:2", "--energy-min", "-50", "--pbc", "1,t,no", "--require-forces", "--export", tmp_path / "o.xyz") == ["1 frames", "3\t1", "1 written"]
    assert call("dedup-export", c, "-o", tmp_path / "o.xyz") == ["2 written"]
    assert call("reindex", c) == ["2 frames"] and call("cook-frame", c, "--traj", 3, "--frame", 0) == ["1 cooked"] and call("recook-all", c) == ["2 cooked"]
    assert len(call("positions", c, "--traj", 3, "--frame", 0)) == 4 and call("delete-cooked", c, "--traj", 3, "--frame", 0) == []
    assert call("compact-split", c, tmp_path / "s", "--shards", 2) == ["2"] and call("compact-join", tmp_path / "s", tmp_path / "j") == ["2"]
    assert call("compact-export-extxyz", tmp_path / "s", tmp_path / "o.xyz", "--sharded", "--symbol", "H") == ["2 written"]
    assert call("hash-file", tmp_path / "x.con") == [hash_bytes(con.render(next(con.parse(PLAIN))))]
    assert call("shard-init", tmp_path / "n", "--shards", 2) == ["2"] and call("shard-ingest", tmp_path / "n", tmp_path / "x.con", "--shard", 1, "--start-id", 3)
    assert call("shard-select", tmp_path / "n", "--traj", 3)[0] == "2 frames"
    with pytest.raises(CorpusError):
        call("shard-ingest", tmp_path / "n", tmp_path / "x.con", "--shard", 0, "--start-id", 3)


def test_tables_of_atoms_are_ingested(corpus, spark):
    rows = [(3, f, s, float(k), 0.0, 1.0, k, (0.0, 3.0, 4.0) if f == 20 else None) for f in (10, 20) for k, s in enumerate(["Cu", "H", "Cu"])]
    atoms = spark.createDataFrame(rows, "traj_id long, frame_idx long, symbol string, x double, y double, z double, atom_id long, force struct<x:double,y:double,z:double>")
    assert corpus.append_atoms(atoms, "table") == {"trajectories": 1, "frames": 2}
    got = corpus.frames.orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.formula, r.fmax) for r in got] == [(0, "Cu:2|H:1", None), (1, "Cu:2|H:1", 5.0)]
    assert corpus.traj_meta(3).source == "table" and corpus.positions((3, 1))[0] == (0.0, 0.0, 1.0)
    with pytest.raises(TrajectoryExists):
        corpus.append_atoms(atoms)


def test_two_writers_of_one_commit(corpus, spark):
    """Both start from one manifest: one publishes, the other is told; the file is never seen without its content."""
    from concurrent.futures import ThreadPoolExecutor

    corpus.append_text(1, PLAIN)
    base = corpus.store.manifest()

    def publish(k):
        try:
            return corpus.store.publish(base, {}, writer=k)["writer"]
        except ConcurrentCommit:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(publish, range(16)) if k is not None]
    assert len(won) == 1 and corpus.store.manifest()["writer"] == won[0]


def test_a_single_shard_is_written_by_many_tasks(corpus, monkeypatch):
    from framewright.operators import corpus as module

    monkeypatch.setattr(module, "ROWS_A_TASK", 2)
    corpus.append_text(1, PLAIN * 9)
    files = corpus.blobs.inputFiles()
    assert len(files) > 2 and corpus.blobs.count() == 9
    assert keys(corpus.list_keys()) == [(1, k) for k in range(9)]


def test_compaction_keeps_everything(corpus):
    for k in range(3):
        corpus.append_text(k, PLAIN + RICH)
    corpus.cook()
    before = [sorted(map(str, t.collect())) for t in (corpus.frames, corpus.blobs, corpus.trajectories, corpus.cooked)]
    assert corpus.compact()["frames"] == 3
    assert corpus.compact()["frames"] == 1
    assert [sorted(map(str, t.collect())) for t in (corpus.frames, corpus.blobs, corpus.trajectories, corpus.cooked)] == before


def test_files_are_read_by_any_name_and_never_lost(corpus, tmp_path):
    odd = tmp_path / "a b %41 ü.con"
    odd.write_text(PLAIN + PLAIN)
    (tmp_path / "empty.con").write_text("")
    assert corpus.append_path(1, f"file://{odd}") == 2 and corpus.append_path(2, str(odd)) == 2
    assert corpus.append_path(3, str(tmp_path / "empty.con")) == 0
    with pytest.raises(CorpusError):
        corpus.append_path(4, str(tmp_path / "missing.con"))
    assert corpus.traj_meta(4) is None


def test_export_in_parts_refuses_missing_frames(corpus, spark, tmp_path):
    corpus.append_text(1, PLAIN)
    with pytest.raises(MissingFrame):
        corpus.export_extxyz_parts(spark.createDataFrame([(1, 0), (1, 7)], "traj_id long, frame_idx long"), str(tmp_path / "out"))


def test_key_codecs_check_lengths(spark):
    from framewright.functions import keys as C

    rows = spark.createDataFrame([(1, 2), (2**63 - 1, 2**32 - 1), (0, 2**32), (-1, 0), (None, 0)], "t long, f long")
    coded = [None if r[0] is None else bytes(r[0]) for r in rows.select(C.key_bytes(F.col("t"), F.col("f"))).collect()]
    assert coded == [bytes(7) + b"\x01" + bytes(3) + b"\x02", b"\x7f" + b"\xff" * 11, None, None, None]
    data = spark.createDataFrame([(bytearray(b),) for b in (coded[0], coded[1], b"\x00" * 11, b"\x00" * 13, b"\xff" * 12)], "b binary")
    assert [r[0] and tuple(r[0]) for r in data.select(C.key_of(F.col("b"))).collect()] == [(1, 2), (2**63 - 1, 2**32 - 1), None, None, None]
    hashes = spark.createDataFrame([(hash_bytes("a"),), ("ab",), ("zz" * 16,)], "h string")
    assert [r[0] for r in hashes.select(C.hash_of_bytes(C.hash_to_bytes(F.col("h")))).collect()] == [hash_bytes("a"), None, None]
    assert set(C.EXPORT_KINDS) == {"sharded", "single", "extxyz"}
