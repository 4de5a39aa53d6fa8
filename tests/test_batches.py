"""Frames move in batches, are parsed only where their columns aren't known, and are rendered once."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from framewright import Corpus, join_corpora, join_shards, split_shards
from framewright.errors import MissingFrame, ParseError
from framewright.functions import soa
from framewright.plans import catalog
from framewright.schema import PARSED
from framewright.sources import con

SF = "/root/testdata/sf0.001"
XYZ = pa.struct([(c, pa.float64()) for c in "xyz"])


class Table:
    """Stands for a DataFrame: gives the function of its mapInArrow."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def frame(r: random.Random, n: int) -> con.Frame:
    vector = lambda p: (r.uniform(-9, 9), -0.0, 0.0000005) if r.random() < p else None
    p, q = r.choice([0, 0.5, 1]), r.choice([0, 0.5, 1])
    atoms = [con.Atom(r.choice(["Cu", "H", "N"]), r.uniform(-1e6, 1e6), 2.5e-7, float("nan") if n > 6 else 1e300, 0, k, 1.00793, vector(p), vector(q)) for k in range(n)]
    return con.Frame("", '{"energy":-%d.5}' % n, [10.0, 11.0, 12.5], [90.0, 90.0, 60.0], ["", ""], atoms)


def test_rows_are_those_of_the_parser():
    r = random.Random(3)
    texts = [con.render(frame(r, n)) for n in [0, 1, 2, 5, 7] * 8]
    texts += [t.replace(" 0 1\n", " 0\n") for t in texts[:10]] + [t.replace(" 0 1\n", " 0 1 more\n") for t in texts[:10]] + [t.replace("\n", "\r\n") for t in texts[:10]]
    texts += ["".join(texts[:20]) + "\n \n", "", "\n\n", texts[3] + texts[3].replace("Component 1", "component one")]
    for t in texts:
        assert str(list(con.rows(t))) == str([f.row(0, 0)[2:] for f in con.parse(t)])
    t = texts[3]
    cut = [t[:-k] for k in range(1, len(t), 7)]
    for bad in (*cut, t.replace("{", "["), t.replace(" 0 0\n", " x 0\n"), t.replace("\n\n\n", "\n\n\n-"), "one\n", t + "one\n"):
        results = []
        for read in (lambda b: list(con.rows(b)), lambda b: [f.row(0, 0)[2:] for f in con.parse(b)]):
            try:
                results.append(str(read(bad)))
            except ParseError as e:
                results.append(f"error {e}")
        assert results[0] == results[1]
    assert results[0].startswith("error")


def test_many_frames_share_a_batch():
    texts = [con.render(frame(random.Random(k), 3)) for k in range(2500)]
    ids = pa.array(range(2500))
    for run, batch in (
        (con.parse_rows(Table()), pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["traj_id", "text"])),
        (con.parse_frames(Table()), pa.RecordBatch.from_arrays([ids, pa.array([7] * 2500), pa.array(texts)], ["traj_id", "frame_idx", "blob"])),
    ):
        out = list(run([batch]))
        assert len(out) == 3 and [b for o in out for b in o.column("blob").to_pylist()] == texts
    assert [o.num_rows for o in con.batched((0, k, "", "{}", [], [], [], [("H", 0.0, 0.0, 0.0, 0, 0, 1.0, None, None)] * 40_000, False, False, "") for k in range(3))] == [1, 1, 1]


def test_canonical_rows_are_the_parsed_texts():
    frames = [frame(random.Random(k), k % 9) for k in range(1500)]
    atom = pa.struct([("atom_id", pa.int64()), *((c, pa.float64()) for c in "xyz"), ("symbol", pa.string()), ("fixed", pa.int64()), ("mass", pa.float64()), ("velocity", XYZ), ("force", XYZ)])
    xyz = lambda v: None if v is None else dict(zip("xyz", v, strict=True))
    atoms = [[{**{c: getattr(a, c) for c in ("atom_id", "x", "y", "z", "symbol", "fixed", "mass")}, "velocity": xyz(a.velocity), "force": xyz(a.force)} for a in f.atoms] for f in frames]
    columns = [pa.array(range(1500)), pa.array([0] * 1500), pa.array([f.metadata for f in frames]), pa.array([f.boxl for f in frames]), pa.array([f.angles for f in frames]), pa.array(atoms, pa.list_(atom))]
    batch = pa.RecordBatch.from_arrays(columns, ["traj_id", "frame_idx", "metadata", "boxl", "angles", "atoms"])
    got = [r for b in con.canonical_rows(Table())([batch]) for r in b.to_pylist()]
    want = con._batch([next(con.parse(con.render(f))).row(k, 0) for k, f in enumerate(frames)], to_arrow_schema(PARSED), pa).to_pylist()
    assert str(got) == str(want)


def _screen(c: Corpus):
    return sorted(map(str, c.frames.drop("shard", "commit_seq").collect()))


def test_split_and_join_copy_what_was_derived(spark, tmp_path, monkeypatch):
    c = Corpus(spark, str(tmp_path / "c"))
    for t in (1, 5, 6):
        c.append_text(t, "".join(con.render(frame(random.Random(k), 3)) for k in range(t)))
    want = _screen(c)
    monkeypatch.setattr(con, "parse_frames", lambda *a: pytest.fail("parsed again"))
    s = split_shards(c, str(tmp_path / "s"), 3)
    j = join_shards(s, str(tmp_path / "j"))
    assert _screen(s) == _screen(j) == want
    assert sorted(map(tuple, j.blobs.drop("shard").collect())) == sorted(map(tuple, c.blobs.drop("shard").collect()))
    assert {(r.traj_id, r.n_frames, r.source) for r in j.trajectories.collect()} == {(1, 1, "join-from-shard-1"), (5, 5, "join-from-shard-2"), (6, 6, "join-from-shard-0")}
    monkeypatch.undo()
    other = Corpus(spark, str(tmp_path / "md5"), hash_mode="md5")
    text = con.render(frame(random.Random(0), 3))
    other.append_text(9, text)
    both = join_corpora([c, other], str(tmp_path / "both"))
    assert both.frame_hash((9, 0)) == both.hash_text(text) and both.frames.where("is_rep").count() == 6
    before = _screen(both)
    assert both.reindex() == 13 and _screen(both) == before
    assert not (tmp_path / "both" / "_projected").exists() or not list((tmp_path / "both" / "_projected").iterdir())


def test_export_sorts_texts_and_renders_once(spark, tmp_path, monkeypatch):
    c = Corpus(spark, str(tmp_path / "c"))
    c.append_text(1, "".join(con.render(frame(random.Random(k), 2)) for k in range(9)))
    seen, rendered = [], Corpus._rendered
    monkeypatch.setattr(Corpus, "_rendered", staticmethod(lambda texts, key: seen.append(texts._jdf.queryExecution().optimizedPlan().toString()) or rendered(texts, key)))
    c.export_extxyz_parts(c.list_keys(), str(tmp_path / "parts"))
    assert c.export_extxyz([(1, 3), (1, 0)], str(tmp_path / "one.xyz")) == 2
    assert len(seen) == 2 and all(p.startswith("Sort [pos") for p in seen)
    missing = spark.createDataFrame([(1, 0), (1, 99)], "traj_id long, frame_idx long")
    with pytest.raises(MissingFrame):
        c.export_extxyz_parts(missing, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("name", ["extxyz_frames", "con_parse"])
def test_lines_are_gathered_before_they_meet_orders(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Join ") < plan.index("Aggregate [l_orderkey")


def test_blocks_are_coded_without_an_object_for_each_vector():
    blocks = [soa.encode([[k, 0.5, -1.0]] * 21, [[1.0, 2.0, 3.0]] * 21 if k % 2 else None) for k in range(10_000)]
    data = pa.array([*blocks, None, b"XXXX"])
    tracemalloc.start()
    got = soa.rcso_decode.func(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    rows = got.slice(9_999, 3).to_pylist()
    assert rows[0]["positions"] == [{"x": 9999.0, "y": 0.5, "z": -1.0}] * 21 and rows[0]["forces"][3] == {"x": 1.0, "y": 2.0, "z": 3.0} and rows[0]["velocities"] is None
    assert rows[1:] == [dict.fromkeys(("positions", "forces", "velocities"))] * 2
    parts = [got.field(k) for k in range(3)]
    assert soa.rcso_encode.func(*parts).to_pylist() == [*blocks, None, None]
