"""Conjunctive screening: an immutable description that compiles to one predicate, so Catalyst prunes and pushes it down."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.ranges import ordered_range
from framewright.functions.scalars import pbc_mask
from framewright.schema import KEYS

_RANGES = ("energy", "fmax", "mass", "volume", "time", "timestep", "frame_index", "neb_bead", "neb_band", "charge", "magmom")
MAX_NATOMS = 2**32 - 1


@dataclass(frozen=True)
class Select:
    """Setters return a new Select. Ranges, pbc, hash, formula and trajectory overwrite; symbols and element counts accumulate."""

    traj_id: int | None = None
    natoms: tuple[int, int] | None = None
    symbols: tuple[str, ...] = ()
    formula: str | None = None
    exact: tuple[tuple[str, int], ...] = ()
    at_least: tuple[tuple[str, int], ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    pbc_flags: int | None = None
    flags: frozenset[str] = frozenset()
    content_hash: str | None = None
    max_keys: int | None = None
    extra: Column | None = None

    def trajectory(self, traj_id: int) -> Select:
        return replace(self, traj_id=traj_id)

    def natoms_range(self, lo: int = 0, hi: int = MAX_NATOMS) -> Select:
        return replace(self, natoms=(lo, hi))

    def require_symbol(self, symbol: str) -> Select:
        return replace(self, symbols=(*self.symbols, symbol))

    def exact_composition(self, formula: str) -> Select:
        return replace(self, formula=formula)

    def element_exact(self, symbol: str, n: int) -> Select:
        return replace(self, exact=(*self.exact, (symbol, n)))

    def element_min(self, symbol: str, n: int) -> Select:
        return replace(self, at_least=(*self.at_least, (symbol, n)))

    def range(self, column: str, lo: float | None = None, hi: float | None = None) -> Select:
        if column not in _RANGES:
            raise ValueError(f"no range over {column!r}")
        return replace(self, ranges={**self.ranges, column: (lo, hi)})

    def energy_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("energy", lo, hi)

    def fmax_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("fmax", 0.0 if lo is None else lo, hi)

    def mass_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("mass", lo, hi)

    def volume_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("volume", lo, hi)

    def time_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("time", lo, hi)

    def timestep_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("timestep", lo, hi)

    def frame_index_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("frame_index", lo, hi)

    def neb_bead_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("neb_bead", lo, hi)

    def neb_band_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("neb_band", lo, hi)

    def charge_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("charge", lo, hi)

    def magmom_range(self, lo: float | None = None, hi: float | None = None) -> Select:
        return self.range("magmom", lo, hi)

    def pbc(self, x: bool, y: bool, z: bool) -> Select:
        return replace(self, pbc_flags=pbc_mask((x, y, z)))

    def require_forces(self) -> Select:
        return replace(self, flags=self.flags | {"has_forces"})

    def require_velocities(self) -> Select:
        return replace(self, flags=self.flags | {"has_velocities"})

    def require_energy(self) -> Select:
        return replace(self, flags=self.flags | {"has_energy"})

    def exact_hash(self, content_hash: str) -> Select:
        return replace(self, content_hash=content_hash)

    def limit(self, n: int | None) -> Select:
        return replace(self, max_keys=n)

    def where(self, extra: Column) -> Select:
        """Any further predicate over the frame columns."""
        return replace(self, extra=extra if self.extra is None else self.extra & extra)

    def predicate(self, n_shards: int | None = None) -> Column:
        """The conjunction. With ``n_shards`` a trajectory also names its shard, so that only its partition is read."""
        p: list[Column] = []
        if self.traj_id is not None:
            p.append(F.col("traj_id") == F.lit(self.traj_id))
            if n_shards:
                p.append(F.col("shard") == F.lit(self.traj_id % n_shards))
        if self.natoms is not None:
            p.append(F.col("natoms").between(*self.natoms))
        p += [F.array_contains("symbols", s) for s in self.symbols]
        if self.formula is not None:
            p.append(F.col("formula") == self.formula)
        p += [F.try_element_at("species", F.lit(s)) == n for s, n in self.exact]
        p += [F.try_element_at("species", F.lit(s)) >= n for s, n in self.at_least]
        p += [ordered_range(F.col(c), lo, hi) for c, (lo, hi) in self.ranges.items()]
        if self.pbc_flags is not None:
            p.append(F.col("pbc_mask") == self.pbc_flags)
        p += [F.col(c) for c in sorted(self.flags)]
        if self.content_hash is not None:
            p += [F.col("content_hash") == self.content_hash, F.col("is_rep")]
        if self.extra is not None:
            p.append(self.extra)
        return reduce(and_, p) if p else F.lit(True)


def select_keys(frames: DataFrame, sel: Select, n_shards: int | None = None, *keep: str) -> DataFrame:
    """Keys in order (and columns in ``keep``), limited after sorting: a scan, a filter and a distributed top-k."""
    out = frames.where(sel.predicate(n_shards)).select(*KEYS, *keep).orderBy(*KEYS)
    return out if sel.max_keys is None else out.limit(sel.max_keys)
