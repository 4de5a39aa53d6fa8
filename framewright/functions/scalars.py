"""Screening columns as expressions: formula, species, forces, mass, cell volume, periodicity, metadata numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.ranges import finite
from framewright.schema import META


def species_counts(symbols: Iterable[str]) -> dict[str, int]:
    return dict(Counter(symbols))


def composition_formula(counts: dict[str, int]) -> str:
    """Symbols in byte order, each with its count: ``Cu:2|H:2``."""
    return "|".join(f"{s}:{n}" for s, n in sorted(counts.items(), key=lambda x: x[0].encode()))


def pbc_mask(flags: Iterable[bool]) -> int:
    return sum(1 << k for k, f in enumerate(flags) if f)


def formula_of(pairs: Column) -> Column:
    """Formula of array<struct<symbol, n>>; null for no atoms."""
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["symbol"], F.lit(":"), p["n"].cast("string"))), "|")
    return F.when(F.size(pairs) > 0, text)


def species_of(symbols: Column) -> Column:
    """array<string> of symbols -> array<struct<symbol, n>> of the present ones."""
    return F.transform(F.array_sort(F.array_distinct(symbols)), lambda s: F.struct(s.alias("symbol"), F.size(F.filter(symbols, lambda t: t == s)).cast("long").alias("n")))


def norm(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def cell_volume(boxl: Column, angles: Column) -> Column:
    """Orthogonal cells as a product, others by the crystallographic formula."""
    a, b, c = (boxl[k] for k in range(3))
    cos = [F.cos(F.radians(angles[k])) for k in range(3)]
    flat = 1 - cos[0] * cos[0] - cos[1] * cos[1] - cos[2] * cos[2] + 2 * cos[0] * cos[1] * cos[2]
    right = (angles[0] == 90) & (angles[1] == 90) & (angles[2] == 90)
    return F.when(right, a * b * c).otherwise(a * b * c * F.sqrt(F.greatest(flat, F.lit(0.0))))


def lattice_volume(metadata: Column) -> Column:
    """|det| of metadata ``lattice_vectors`` (three rows of three numbers), null if absent."""
    m = F.from_json(F.get_json_object(metadata, "$.lattice_vectors"), "array<array<double>>")
    e = [[m[i][j] for j in range(3)] for i in range(3)]
    det = e[0][0] * (e[1][1] * e[2][2] - e[1][2] * e[2][1]) - e[0][1] * (e[1][0] * e[2][2] - e[1][2] * e[2][0]) + e[0][2] * (e[1][0] * e[2][1] - e[1][1] * e[2][0])
    return F.when(F.size(m) == 3, F.abs(det))


def variant_number(v: Column, name: str) -> Column:
    """A JSON number (not a string or boolean) of parsed metadata (a variant), finite or null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    number = F.try_variant_get(v, f"$.{name}", "double")
    return finite(F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), number))


def metadata_pbc(metadata: Column) -> Column:
    flags = F.from_json(F.get_json_object(metadata, "$.pbc"), "array<boolean>")
    return F.when(F.size(flags) == 3, F.expr("0") + sum((F.coalesce(flags[k].cast("int"), F.lit(0)) * (1 << k) for k in range(3)), F.lit(0)))


def metadata_columns(v: Column) -> list[Column]:
    """The META columns of parsed metadata."""
    return [variant_number(v, name).alias(name) for name in META]
