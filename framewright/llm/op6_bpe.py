"""BPE encoding and decoding of whole texts, exact to the tokenizers library, with tree concatenation of long pieces.

A text is normalised and split into pieces exactly as the tokenizer's file says; every distinct piece is spelled in
the byte alphabet, encoded once per worker, and remembered (a bounded memo). Pieces of up to ``LEAF`` symbols take the
library's merges, longer ones the tree below.

Tree concatenation: a piece longer than ``LEAF`` symbols (long unsplit text) is cut into leaves that are encoded
independently; neighbours are then joined pairwise, level by level. Leaves, and the joins of a level, of a piece of more
than ``SPLIT_LEAVES`` of them run on worker processes of the task. At each join a window of tokens around it is
re-encoded and grown until its first and last tokens equal the left's and the right's own tokens at the same places.
A sequence of tokens is the encoding of its text if every adjacent pair of it is one, so agreement on both sides
makes the join exact; if a window reaches both ends, it is the encoding itself.

Cases: a null or empty text has no tokens and decodes to the empty text; control characters are letters of the byte
alphabet like any other; a text with a special token's string takes the library's encoder, and one with characters outside
the range ``PLAIN`` its normaliser and its pre-tokenizer (they are the definition, and their Unicode tables are not Python's).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from concurrent.futures import Executor
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table

LEAF = 128
#: Pieces of more leaves than this are encoded on ``WORKERS`` processes.
SPLIT_LEAVES, WORKERS = 512, 2
MEMO = 200_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters are normalised and split the same way by Python's NFC, lower() and ``regex`` as by the library (a test tries each).
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-\xac\xae-įı-ſ–—‘-”•…€]*")


class Bpe:
    """Ranked merges over symbols; the last symbol of a word carries the end-of-word suffix."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}

    def merge(self, symbols: list[str]) -> list[str]:
        """The encoding of the symbols: lowest rank first, leftmost on ties; O(n log n)."""
        n = len(symbols)
        if n < 2:
            return symbols
        part, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := prev[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p]

    def symbols(self, tokens: list[str]) -> list[str]:
        out = [c for t in tokens for c in t.removesuffix(self.suffix)]
        if tokens[-1].endswith(self.suffix):
            out[-1] += self.suffix
        return out

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of both texts together, from their encodings."""
        w = 4
        while True:
            a, b = left[-w:], right[:w]
            mid = self.merge(self.symbols(a) + self.symbols(b))
            ok_left = w >= len(left) or mid[0] == a[0]
            ok_right = w >= len(right) or mid[-1] == b[-1]
            if ok_left and ok_right:
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            w *= 2

    def tree(self, symbols: list[str], leaf: int = LEAF, pool: Executor | None = None) -> list[str]:
        """Leaves encoded independently, then joined pairwise up a balanced tree; on ``pool``'s workers if there is one."""
        run = partial(pool.map, chunksize=32) if pool else map
        level = list(run(self.merge, [symbols[i : i + leaf] for i in range(0, len(symbols), leaf)]))
        while len(level) > 1:
            # Near the root a level has few, long members: sending them would cost more than their joins, which look at a few tokens.
            joined = list((run if len(level) > 64 else map)(self.join, level[:-1:2], level[1::2]))
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0] if level else []


@lru_cache(4)
def merges(path: str) -> Bpe:
    return Bpe(path)


class Workers:
    """merge and join of one tokenizer on forked processes, which share what this one has read; ended by ``with``."""

    def __init__(self, path: str, n: int):
        from concurrent.futures import ProcessPoolExecutor
        from multiprocessing import get_context

        self.path, self.pool = path, ProcessPoolExecutor(n, get_context("fork"))

    def map(self, method: Callable, *parts: list, chunksize: int = 1) -> Iterator[list[str]]:
        return self.pool.map(partial(_call, self.path, "join" if method.__func__ is Bpe.join else "merge"), *parts, chunksize=chunksize)

    def __enter__(self) -> Workers:
        return self

    def __exit__(self, *_) -> None:
        self.pool.shutdown()


def _call(path: str, method: str, *parts: list[str]) -> list[str]:
    return getattr(merges(path), method)(*parts)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else the next code point from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


@lru_cache(4)
def codec(path: str) -> Callable[[str], tuple[int, str, str]]:
    """text -> (number of tokens, decimal ids joined by a space, decoded text), made once per worker."""
    from tokenizers import Tokenizer

    tok, bpe = Tokenizer.from_file(path), merges(path)
    tok.no_truncation()
    tok.no_padding()
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    split = regex.compile(SPLIT).findall
    letters, model = _byte_letters(), tok.model

    def one(piece: str, plain: bool) -> tuple[str, str]:
        mapped = "".join([letters[b] for b in piece.encode()]) if plain and not (piece.isascii() and piece.isprintable()) else piece
        if len(mapped) <= LEAF:  # nothing to split: the library's merges
            found = model.tokenize(mapped)
            return " ".join([str(t.id) for t in found]), " ".join([t.value for t in found])
        symbols = list(mapped)
        symbols[-1] += bpe.suffix
        if len(symbols) > SPLIT_LEAVES * LEAF:
            with Workers(path, WORKERS) as pool:
                tokens = bpe.tree(symbols, pool=pool)
        else:
            tokens = bpe.tree(symbols)
        return " ".join([str(bpe.vocab[t]) for t in tokens]), " ".join(tokens)

    class Memo(dict):
        """Pieces as the text has them (plain), or as the library spells them in the byte alphabet."""

        def __init__(self, plain: bool):
            self.plain = plain

        def __missing__(self, piece: str) -> tuple[str, str]:
            got = one(piece, self.plain)
            if len(piece) <= LEAF:
                self[piece] = got
            return got

    memos = {plain: Memo(plain) for plain in (True, False)}

    def encode(text: str) -> tuple[int, str, str]:
        if any(s in text for s in specials):
            e = tok.encode(text, add_special_tokens=False)
            return len(e.ids), " ".join(map(str, e.ids)), tok.decode(e.ids, skip_special_tokens=False)
        plain = PLAIN.fullmatch(text) is not None
        if plain:
            pieces = split(unicodedata.normalize("NFC", text).lower())
        else:
            pieces = [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]
        if not pieces:
            return 0, "", ""
        memo = memos[plain]
        if len(memo) > MEMO:
            memo.clear()
        ids, tokens = zip(*map(memo.__getitem__, pieces), strict=True)
        ids = " ".join(ids)
        return ids.count(" ") + 1, ids, " ".join(tokens)

    return encode


def encode_documents(docs: DataFrame, path: str, *, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ids (list of ints) and decoded.

    A map over partitions: no shuffle, one text at a time, the memo bounded. ``path`` is the tokenizer's file, present
    on every executor as an installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    n, ids, decoded = encode(text.as_py() or "")
                    row = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append(row + ([[int(x) for x in ids.split()], decoded] if texts else []))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if texts else 3]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), kinds[k]) for k, c in enumerate(zip(*rows, strict=True)))], ["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(ids: list[int], path: str) -> str:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).decode(ids, skip_special_tokens=False)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary())
