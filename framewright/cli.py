"""Command line: ``python -m framewright.cli COMMAND ...``. Screening options are those of ``Select``."""

from __future__ import annotations

import argparse
import sys

from framewright.errors import CorpusError
from framewright.functions.hashing import hash_bytes
from framewright.operators.corpus import DEFAULT_SHARDS, Corpus, join_shards, split_shards
from framewright.plans.select import MAX_NATOMS, Select

RANGES = ("energy", "fmax", "mass", "volume", "time", "timestep", "frame_index", "neb_bead", "neb_band", "charge", "magmom")


def symbol_count(text: str) -> tuple[str, int]:
    symbol, sep, count = text.partition(":")
    if not sep or not symbol:
        raise argparse.ArgumentTypeError("expected SYM:COUNT")
    try:
        return symbol, int(count)
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a count: {count!r}") from None


def pbc_flags(text: str) -> tuple[bool, bool, bool]:
    parts = [p.strip().lower() in ("1", "true", "t", "yes") for p in text.split(",")]
    if len(parts) != 3:
        raise argparse.ArgumentTypeError("expected X,Y,Z")
    return tuple(parts)


def add_filters(p: argparse.ArgumentParser) -> None:
    p.add_argument("--traj", type=int)
    p.add_argument("--symbol", action="append", default=[])
    p.add_argument("--natoms-min", type=int)
    p.add_argument("--natoms-max", type=int)
    p.add_argument("--elem", type=symbol_count, action="append", default=[])
    p.add_argument("--elem-min", type=symbol_count, action="append", default=[])
    p.add_argument("--formula")
    p.add_argument("--pbc", type=pbc_flags)
    p.add_argument("--hash")
    p.add_argument("--limit", type=int)
    for name in RANGES:
        p.add_argument(f"--{name.replace('_', '-')}-min", type=float)
        p.add_argument(f"--{name.replace('_', '-')}-max", type=float)
    for name in ("forces", "velocities", "energy"):
        p.add_argument(f"--require-{name}", action="store_true")


def selection(a: argparse.Namespace) -> Select:
    s = Select()
    if a.traj is not None:
        s = s.trajectory(a.traj)
    for symbol in a.symbol:
        s = s.require_symbol(symbol)
    if a.natoms_min is not None or a.natoms_max is not None:
        s = s.natoms_range(a.natoms_min or 0, MAX_NATOMS if a.natoms_max is None else a.natoms_max)
    for symbol, n in a.elem:
        s = s.element_exact(symbol, n)
    for symbol, n in a.elem_min:
        s = s.element_min(symbol, n)
    if a.formula:
        s = s.exact_composition(a.formula)
    if a.pbc:
        s = s.pbc(*a.pbc)
    if a.hash:
        s = s.exact_hash(a.hash)
    for name in RANGES:
        lo, hi = getattr(a, f"{name}_min"), getattr(a, f"{name}_max")
        if lo is not None or hi is not None:
            s = getattr(s, f"{name}_range")(lo, hi)
    for name in ("forces", "velocities", "energy"):
        if getattr(a, f"require_{name}"):
            s = getattr(s, f"require_{name}")()
    return s.limit(a.limit)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, filters: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x, **({"nargs": "+"} if x == "files" else {}))
        if filters:
            add_filters(p)
        return p

    command("ingest", "corpus", "files").add_argument("--start-id", type=int, default=1)
    command("ingest-dir", "corpus", "folder").add_argument("--start-id", type=int, default=1)
    command("select", "corpus", filters=True).add_argument("--export")
    command("dedup-export", "corpus", filters=True).add_argument("-o", "--output", required=True)
    command("reindex", "corpus")
    command("shard-init", "corpus").add_argument("--shards", type=int, default=DEFAULT_SHARDS)
    p = command("shard-ingest", "corpus", "files")
    p.add_argument("--shard", type=int, required=True)
    p.add_argument("--start-id", type=int, required=True)
    command("shard-select", "corpus", filters=True)
    command("compact-join", "source", "target")
    command("compact-split", "source", "target").add_argument("--shards", type=int, default=DEFAULT_SHARDS)
    p = command("compact-export-extxyz", "corpus", "output")
    p.add_argument("--sharded", action="store_true")
    p.add_argument("--symbol")
    for name in ("cook-frame", "delete-cooked", "positions"):
        p = command(name, "corpus")
        p.add_argument("--traj", type=int, required=True)
        p.add_argument("--frame", type=int, required=True)
    command("recook-all", "corpus")
    command("hash-file", "file")
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("framewright").getOrCreate()


def run(a: argparse.Namespace, spark=None, out=print) -> int:
    if a.command == "hash-file":
        from framewright.sources import con

        with open(a.file, encoding="utf-8", newline="") as f:
            frame = next(con.parse(f.read()), None)
        if frame is None:
            raise CorpusError("no frame")
        out(hash_bytes(con.render(frame)))
        return 0
    spark = spark or _session()
    if a.command == "compact-join":
        out(join_shards(Corpus(spark, a.source), a.target).frames.count())
    elif a.command == "compact-split":
        out(split_shards(Corpus(spark, a.source), a.target, a.shards).frames.count())
    elif a.command == "shard-init":
        out(Corpus(spark, a.corpus, a.shards).n_shards)
    else:
        c = Corpus(spark, a.corpus)
        if a.command == "ingest":
            for k, path in enumerate(a.files):
                out(f"{a.start_id + k}\t{c.append_path(a.start_id + k, path)}\t{path}")
        elif a.command == "shard-ingest":
            if a.start_id % c.n_shards != a.shard:
                raise CorpusError(f"trajectory {a.start_id} does not belong to shard {a.shard} of {c.n_shards}")
            for k, path in enumerate(a.files):
                traj = a.start_id + k * c.n_shards
                out(f"{traj}\t{c.append_path(traj, path)}\t{path}")
        elif a.command == "ingest-dir":
            for row in c.ingest_directory(a.folder, a.start_id):
                out("\t".join(map(str, row)))
        elif a.command in ("select", "shard-select"):
            keys = c.select(selection(a))
            out(f"{keys.count()} frames")
            for row in keys.limit(20).collect():
                out(f"{row.traj_id}\t{row.frame_idx}")
            if getattr(a, "export", None):
                out(f"{c.export_extxyz(keys, a.export)} written")
        elif a.command == "dedup-export":
            out(f"{c.export_unique(selection(a), a.output)} written")
        elif a.command == "compact-export-extxyz":
            sel = Select().require_symbol(a.symbol) if a.symbol else Select()
            out(f"{c.export_extxyz(c.select(sel), a.output)} written")
        elif a.command == "reindex":
            out(f"{c.reindex()} frames")
        elif a.command == "recook-all":
            out(f"{c.cook()} cooked")
        elif a.command == "cook-frame":
            out(f"{c.cook([(a.traj, a.frame)])} cooked")
        elif a.command == "delete-cooked":
            c.delete_cooked((a.traj, a.frame))
        elif a.command == "positions":
            for v in c.positions((a.traj, a.frame)):
                out(" ".join(map(repr, v)))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (CorpusError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
