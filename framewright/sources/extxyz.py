"""Extended XYZ: one text for each frame, and files of them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framewright.sources.con import lists, tuples, values

#: Frames whose columns are lists of Python at once.
SLICE = 1024


def _energy(metadata: str | None, key: str) -> float | None:
    try:
        value = json.loads(metadata or "{}").get(key)
    except (ValueError, AttributeError):
        return None
    if isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        return float(value)
    return float(value) if isinstance(value, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value) else None


def frame_text(boxl, atoms, metadata: str | None = None, energy_key: str | None = "energy") -> str:
    """One frame: number of atoms, lattice and properties, then an aligned line for each atom."""
    xyz = lambda v: None if v is None else (v["x"], v["y"], v["z"])
    return text_of(boxl, [a["symbol"] for a in atoms], list(map(xyz, atoms)), [xyz(a["force"]) for a in atoms], metadata, energy_key)


def text_of(boxl, symbols, places, forces, metadata: str | None, energy_key: str | None) -> str:
    """The same from columns: places and forces are tuples, a force may be None."""
    forced = any(f is not None for f in forces)
    box = [float(x) for x in boxl]
    head = f'Lattice="{box[0]} 0 0 0 {box[1]} 0 0 0 {box[2]}" Properties=species:S:1:pos:R:3{":forces:R:3" if forced else ""} pbc="T T T"'
    energy = _energy(metadata, energy_key) if energy_key else None
    if energy is not None:
        head += f" {energy_key}={energy}"
    lines = [str(len(symbols)), head]
    if forced:
        lines += ["%-2s %16.10f %16.10f %16.10f %16.10f %16.10f %16.10f" % (s, *p, *(f or (0.0, 0.0, 0.0))) for s, p, f in zip(symbols, places, forces, strict=True)]
    else:
        lines += ["%-2s %16.10f %16.10f %16.10f" % (s, *p) for s, p in zip(symbols, places, strict=True)]
    return "\n".join(lines) + "\n"


def extxyz(energy_key: str | None = "energy"):
    """A column function of (boxl, atoms, metadata); atoms are read column by column, so none becomes an object of its own."""

    @F.arrow_udf(StringType())
    def render(boxl: pa.Array, atoms: pa.Array, metadata: pa.Array) -> pa.Array:
        out = []
        for begin in range(0, len(atoms), SLICE):
            own = atoms.slice(begin, SLICE)
            flat, at = own.flatten(), 0
            symbols, places, forces = values(flat.field("symbol")), tuples(flat), tuples(flat.field("force"))
            for n, b, m in zip(values(own.value_lengths()), lists(boxl.slice(begin, SLICE)), values(metadata.slice(begin, SLICE)), strict=True):
                out.append(text_of(b, symbols[at : at + n], places[at : at + n], forces[at : at + n], m, energy_key))
                at += n
        return pa.array(out, pa.string())

    return render


def write_stream(texts: Iterable[str], path: str) -> int:
    """Writes frames to one file in the given order, through a temporary name."""
    n, temp = 0, f"{path}.part"
    with open(temp, "w", encoding="utf-8") as out:
        for text in texts:
            out.write(text)
            n += 1
    os.replace(temp, path)
    return n


def frames(path: str) -> Iterator[str]:
    """The frames of a file that ``write_stream`` wrote."""
    with open(path, encoding="utf-8") as f:
        while line := f.readline():
            yield line + "".join(f.readline() for _ in range(int(line) + 1))
