"""Frame text ("con"/"convel"): parser, canonical writer, table function and batch data source.

A frame is nine header lines (comment, JSON metadata, box lengths, angles, two free lines, number of types, counts,
masses), then for each type a symbol line, a label line and its atoms (x y z fixed id). After a blank line may follow
velocity and force sections of the same layout, named by their labels. Frames of a file follow each other without a
delimiter, so one file is read in order; files are read in parallel. Labels and blanks are lenient, counts strict.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.errors import CorpusError, ParseError
from framewright.schema import PARSED

HEADER_LINES = 9
#: A batch of parsed rows ends at so many rows or atoms.
BATCH_ROWS, BATCH_ATOMS = 1024, 32_768


@dataclass
class Atom:
    symbol: str
    x: float
    y: float
    z: float
    fixed: int = 0
    atom_id: int = 0
    mass: float = 0.0
    velocity: tuple[float, float, float] | None = None
    force: tuple[float, float, float] | None = None


@dataclass
class Frame:
    comment: str = ""
    metadata: str = "{}"
    boxl: list[float] = field(default_factory=lambda: [0.0] * 3)
    angles: list[float] = field(default_factory=lambda: [90.0] * 3)
    postbox: list[str] = field(default_factory=lambda: ["", ""])
    atoms: list[Atom] = field(default_factory=list)
    blob: str = ""

    @property
    def has_forces(self) -> bool:
        return any(a.force is not None for a in self.atoms)

    @property
    def has_velocities(self) -> bool:
        return any(a.velocity is not None for a in self.atoms)

    def row(self, traj_id: int, frame_idx: int) -> tuple:
        xyz = lambda v: None if v is None else tuple(map(float, v))
        atoms = [(a.symbol, a.x, a.y, a.z, a.fixed, a.atom_id, a.mass, xyz(a.velocity), xyz(a.force)) for a in self.atoms]
        return traj_id, frame_idx, self.comment, self.metadata, self.boxl, self.angles, self.postbox, atoms, self.has_forces, self.has_velocities, self.blob


class _Lines:
    def __init__(self, text: str):
        self.lines = text.splitlines(keepends=True) if "\r" not in text else [x for x in text.replace("\r\n", "\n").splitlines(keepends=True)]
        self.at = 0
        self.end = len(self.lines)  # only blanks are left behind it
        while self.end and not self.lines[self.end - 1].strip():
            self.end -= 1

    def next(self, what: str) -> str:
        if self.at >= len(self.lines):
            raise ParseError(f"line {self.at + 1}: the text ends before {what}")
        self.at += 1
        return self.lines[self.at - 1].rstrip("\n")

    def numbers(self, what: str, kind: type, count: int) -> list:
        words = self.next(what).split()
        try:
            got = [kind(w) for w in words[:count]]
        except ValueError as e:
            raise ParseError(f"line {self.at}: {what}: {e}") from None
        if len(got) < count:
            raise ParseError(f"line {self.at}: {what}: {count} numbers expected")
        return got

    def peek(self, k: int = 0) -> str | None:
        return self.lines[self.at + k].rstrip("\n") if self.at + k < len(self.lines) else None


def parse(text: str) -> Iterator[Frame]:
    """The frames of a text in order; each keeps its exact span as ``blob``. Raises ParseError."""
    src = _Lines(text)
    while src.at < src.end:
        yield _frame(src)


def rows(text: str) -> Iterator[tuple]:
    """What ``parse`` gives, as the fields of PARSED rows behind the keys, without an object for each atom."""
    src = _Lines(text)
    while src.at < src.end:
        yield _plain(src) or _frame(src).row(0, 0)[2:]


def _plain(src: _Lines) -> tuple | None:
    """One frame with five words for each atom; None, and no line taken, if it is otherwise or wrong: ``_frame`` decides."""
    lines, begin = src.lines, src.at
    try:
        metadata = lines[begin + 1].rstrip("\n")
        boxl, angles = ([float(w) for w in lines[begin + k].split()[:3]] for k in (2, 3))
        types = int(lines[begin + 6].split()[0])
        counts = [int(w) for w in lines[begin + 7].split()[:types]]
        masses = [float(w) for w in lines[begin + 8].split()[:types]]
        if not len(boxl) == len(angles) == 3 or types < 0 or not len(counts) == len(masses) == types or min(counts, default=0) < 0 or not isinstance(json.loads(metadata), dict):
            return None
        at, atoms, vectors = begin + HEADER_LINES, [], {}
        for count, mass in zip(counts, masses, strict=True):
            symbol = lines[at].strip()
            at += 2 + count
            for line in lines[at - count : at]:
                x, y, z, fixed, number = line.split()
                atoms.append((symbol, float(x), float(y), float(z), int(float(fixed)), int(float(number)), mass))
        while at + 2 < len(lines) and not lines[at].strip() and (kind := _SECTIONS.get((lines[at + 2].split() or [""])[0].lower())):
            at += 1
            own = vectors[kind] = []
            for count in counts:
                at += 2 + count
                for line in lines[at - count : at]:
                    x, y, z = line.split()[:3]
                    own.append((float(x), float(y), float(z)))
    except (ValueError, IndexError, OverflowError):
        return None
    if at > len(lines) or any(len(own) < len(atoms) for own in vectors.values()):
        return None
    none = [None] * len(atoms)
    velocities, forces = (vectors.get(kind) or none for kind in ("velocity", "force"))
    src.at = at
    full = [(*a, v, f) for a, v, f in zip(atoms, velocities, forces, strict=True)]
    return lines[begin].rstrip("\n"), metadata, boxl, angles, [lines[begin + k].rstrip("\n") for k in (4, 5)], full, forces is not none, velocities is not none, "".join(lines[begin:at])


def _frame(src: _Lines) -> Frame:
    begin = src.at
    f = Frame(comment=src.next("the comment"), metadata=src.next("the metadata"))
    try:
        meta = json.loads(f.metadata)
    except ValueError as e:
        raise ParseError(f"line {src.at}: the metadata is not JSON: {e}") from None
    if not isinstance(meta, dict):
        raise ParseError(f"line {src.at}: the metadata is not an object")
    f.boxl, f.angles = src.numbers("box lengths", float, 3), src.numbers("angles", float, 3)
    f.postbox = [src.next("the line after the box"), src.next("the line after the box")]
    (types,) = src.numbers("the number of types", int, 1)
    if types < 0:
        raise ParseError(f"line {src.at}: a negative number of types")
    counts = src.numbers("atom counts", int, types)
    masses = src.numbers("masses", float, types)
    if any(c < 0 for c in counts):
        raise ParseError(f"line {src.at}: a negative count")
    for count, mass in zip(counts, masses, strict=True):
        symbol = src.next("a symbol").strip()
        src.next("a label")
        for _ in range(count):
            words = src.next("an atom").split()
            try:
                x, y, z = (float(w) for w in words[:3])
                rest = [int(float(w)) for w in words[3:5]]
            except ValueError:
                raise ParseError(f"line {src.at}: an atom of {symbol}: x y z expected") from None
            f.atoms.append(Atom(symbol, x, y, z, *([*rest, 0, len(f.atoms)][:2] if len(rest) < 2 else rest), mass=mass))
    while (kind := _section(src)) is not None:
        src.next("a blank line")
        k = 0
        for count in counts:
            src.next("a symbol")
            src.next("a label")
            for _ in range(count):
                setattr(f.atoms[k], kind, tuple(src.numbers("a vector", float, 3)))
                k += 1
    f.blob = "".join(src.lines[begin : src.at])
    return f


_SECTIONS = {"velocities": "velocity", "forces": "force"}


def _section(src: _Lines) -> str | None:
    """Which section follows: a blank line, a symbol and a label that starts with its name."""
    blank, label = src.peek(), src.peek(2)
    if blank is None or blank.strip() or label is None:
        return None
    words = label.split()
    return _SECTIONS.get(words[0].lower()) if words else None


def _number(x: float) -> str:
    return f"{x:.6f}"


def render(f: Frame) -> str:
    """Canonical text: atoms grouped by symbol in order of first appearance; parsing it gives the frame back to 6 digits."""
    column = lambda name: [getattr(a, name) for a in f.atoms]
    return _text(f.comment, f.metadata, f.boxl, f.angles, f.postbox, column("symbol"), [(a.x, a.y, a.z) for a in f.atoms], column("fixed"), column("atom_id"), column("mass"), column("velocity"), column("force"))


def _text(comment, metadata, boxl, angles, postbox, symbols, places, fixed, ids, masses, velocities, forces) -> str:
    """The canonical text of a frame whose atoms are given column by column."""
    groups: dict[str, list[int]] = {}
    for k, symbol in enumerate(symbols):
        groups.setdefault(symbol, []).append(k)
    tails = [f" {a} {b}" for a, b in zip(fixed, ids, strict=True)]
    out = [comment, metadata, " ".join(map(_number, boxl)), " ".join(map(_number, angles)), *postbox]
    out += [str(len(groups)), " ".join(str(len(g)) for g in groups.values()), " ".join(_number(masses[g[0]]) for g in groups.values())]
    for label, vectors in (("Coordinates", places), ("Velocities", velocities), ("Forces", forces)):
        if vectors is not places:
            if all(v is None for v in vectors):
                continue
            out.append("")
        for n, (symbol, own) in enumerate(groups.items(), 1):
            out += [symbol, f"{label} of Component {n}"]
            out += ["%.6f %.6f %.6f" % tuple(vectors[k] or (0.0, 0.0, 0.0)) + tails[k] for k in own]
    return "\n".join(out) + "\n"


def canonical_rows(frames: DataFrame) -> DataFrame:
    """PARSED rows of the canonical texts of frames: traj_id, frame_idx, metadata, boxl, angles, atoms (the fields of ATOM by name)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield from batched(_canonical(batch.slice(at, BATCH_ROWS)))

    return frames.select("traj_id", "frame_idx", "metadata", "boxl", "angles", "atoms").mapInArrow(run, PARSED)


def _canonical(batch) -> Iterator[tuple]:
    ids, atoms = [values(batch.column(c)) for c in range(3)], batch.column(5)
    boxes = [lists(batch.column(c)) for c in (3, 4)]
    flat = atoms.flatten()
    symbols, fixed, numbers, masses = (values(flat.field(c)) for c in ("symbol", "fixed", "atom_id", "mass"))
    columns = [symbols, tuples(flat), fixed, numbers, masses, tuples(flat.field("velocity")), tuples(flat.field("force"))]
    at = 0
    for n, traj_id, frame_idx, metadata, boxl, angles in zip(values(atoms.value_lengths()), *ids, *boxes, strict=True):
        text = _text("", metadata, boxl, angles, ("", ""), *[c[at : at + n] for c in columns])
        at += n
        yield traj_id, frame_idx, *next(rows(text))


def values(column) -> list:
    """A list of an Arrow column: by way of numpy, which is several times faster, unless a null would be a NaN there."""
    if column.null_count:
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def lists(column) -> list[list | None]:
    """Lists, or None, of an Arrow column of lists."""
    flat, at, out = values(column.flatten()), 0, []
    for n in values(column.value_lengths()):
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def tuples(vectors) -> list[tuple | None]:
    """Tuples, or None, of an Arrow column of x, y, z."""
    there = vectors.is_valid()
    if vectors.null_count:
        vectors = vectors.filter(there)
    found = zip(*(values(vectors.field(c)) for c in "xyz"), strict=True)
    return list(found) if len(vectors) == len(there) else [next(found) if t else None for t in values(there)]


def parse_frames(frames: DataFrame) -> DataFrame:
    """(traj_id, frame_idx, blob), a text of one frame each -> PARSED rows under the given keys."""

    def run(batches):
        def parsed():
            for batch in batches:
                for traj_id, frame_idx, blob in zip(*(values(batch.column(c)) for c in range(3)), strict=True):
                    yield traj_id, frame_idx, *next(rows(blob))

        return batched(parsed())

    return frames.select("traj_id", "frame_idx", "blob").mapInArrow(run, PARSED)


def parse_rows(texts: DataFrame) -> DataFrame:
    """(traj_id, text) -> PARSED rows, one for each frame. Any error fails the whole read."""

    def run(batches):
        def parsed():
            for batch in batches:
                for traj_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, r in enumerate(rows(text or "")):
                        yield traj_id, k, *r

        return batched(parsed())

    return texts.select("traj_id", "text").mapInArrow(run, PARSED)


def batched(parsed: Iterator[tuple]) -> Iterator:
    """Arrow batches of PARSED rows: many small frames share one, which is what makes them cheap; large ones don't."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PARSED)
    held, atoms = [], 0
    for r in parsed:
        held.append(r)
        atoms += len(r[7])
        if len(held) == BATCH_ROWS or atoms >= BATCH_ATOMS:
            yield _batch(held, schema, pa)
            held, atoms = [], 0
    if held:
        yield _batch(held, schema, pa)


def _batch(rows, schema, pa):
    """Arrow columns of parsed rows; atoms are laid out column by column, without a dictionary each."""
    columns = []
    for k, f in enumerate(schema):
        values = [r[k] for r in rows]
        if f.name == "atoms":
            kind = f.type.value_type
            flat = list(zip(*itertools.chain.from_iterable(values), strict=True)) or [()] * kind.num_fields
            parts = [_vectors(flat[c], x.type, pa) if c > 6 else pa.array(flat[c], x.type) for c, x in enumerate(kind)]
            ends = pa.array([0, *itertools.accumulate(map(len, values))], pa.int32())
            columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind)), type=f.type))
        else:
            columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _vectors(values, kind, pa):
    """Structs of x, y, z from tuples or None."""
    there = [v or (None, None, None) for v in values]
    parts = [pa.array([v[c] for v in there], pa.float64()) for c in range(3)]
    return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))


def read_files(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """(traj_id, text, source) of files, each read whole by an executor; the paths are those of any file system that Spark reads.

    A missing file fails here, and a file whose bytes do not come back under its name fails the query: neither is an empty text.
    """
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    named = []
    for traj_id, name in files:
        fs = path(name).getFileSystem(conf)
        if not fs.exists(path(name)):
            raise CorpusError(f"no file {name}")
        named.append((traj_id, name, fs.makeQualified(path(name)).toString(), fs.getFileStatus(path(name)).getLen()))
    ids = spark.createDataFrame(named, "traj_id long, source string, path string, size long")
    data = spark.read.format("binaryFile").load([n for _, _, n, _ in named]).select("path", "content")
    # Spark has no row for a file without bytes.
    text = F.when(F.col("size") == 0, "").when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("not read: "), F.col("source")))).otherwise(F.decode("content", "utf-8"))
    return ids.join(data, "path", "left").select("traj_id", text.cast("string").alias("text"), "source")


class _Part(InputPartition):
    def __init__(self, path: str, traj_id: int):
        self.path, self.traj_id = path, traj_id


class ConReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob
        import os

        path, start = self.options["path"], int(self.options.get("start_id", 1))
        files = sorted(p for p in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if p.endswith((".con", ".convel")))
        return [_Part(p, start + k) for k, p in enumerate(files)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8", newline="") as f:
            for k, frame in enumerate(parse(f.read())):
                yield frame.row(partition.traj_id, k)


class ConDataSource(DataSource):
    """``spark.read.format("con").load(path)``: a file, glob or folder of .con/.convel files on a shared file system; option start_id."""

    @classmethod
    def name(cls):
        return "con"

    def schema(self):
        return PARSED

    def reader(self, schema):
        return ConReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the data source and the SQL table function parse_con(text)."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import StructType

    spark.dataSource.register(ConDataSource)

    class ParseCon:
        def eval(self, text: str):
            for k, frame in enumerate(parse(text or "")):
                yield frame.row(0, k)[1:]

    spark.udtf.register("parse_con", udtf(ParseCon, returnType=StructType(PARSED.fields[1:])))
