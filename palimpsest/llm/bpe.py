"""Byte-level BPE by corpus-level merge replay.

A block of texts is cut into words by the tokenizer's pattern. The block's distinct words are laid out as one array of
byte ids, and an inverted index maps each mergeable token pair (named by the rank of the token it forms) to the positions
where it stands. Ranks are then replayed in order, once for the whole block: each merge visits only the positions in its
index entry and re-files only the two neighbours it touched. A merge can only create pairs of higher rank (its token did
not exist before), so one ascending pass is complete; rank files for which that does not hold are refused.

Blocks are cut by bytes, so memory has a bound; words found in earlier blocks come from a cache of bounded size. The cut
has no effect on results: words are independent of each other.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole; rows are mapped one to
one, so repeated rows and other columns (whatever their names) stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import BATCH_BYTES, bound_batches, lean

#: Bytes of text in a block; words kept in a worker's cache.
BLOCK_BYTES, CACHE_WORDS = 12 << 20, 300_000
_DEAD = 0xFFFF_FFFF


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The bytes of a rank file, from any store Spark reads or from the machine's own disk."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class MergeReplay:
    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.vocab = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.top = max(self.vocab, default=-1) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # by the rank formed: the pairs that form it; by a token: what it forms with its right, or left, neighbour
        self.cuts: dict[int, list[tuple[int, int]]] = {}
        self.rightwards: dict[int, dict[int, int]] = {}
        self.leftwards: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.cuts.setdefault(rank, []).append((a, b))
                    self.rightwards.setdefault(a, {})[b] = rank
                    self.leftwards.setdefault(b, {})[a] = rank
        self.byte_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int32)
        self.words: dict[str, bytes] = {}

    def check(self) -> None:
        """Refuses ranks for which one ascending pass could miss a merge: it cannot if the pass gives every token as itself. (A
        merge that formed a pair of smaller rank would stand in the span of that pair's token, where the pass, which by
        then has met no merge across the span's ends, had already formed that token.)"""
        tokens = [t for t in self.ranks if len(t) > 1]
        bad = [t for t, ids in zip(tokens, self._merge(tokens), strict=True) if ids != self.ranks[t].to_bytes(4, "little")]
        if bad:
            raise ValueError(f"tokens that an ascending pass does not form: {bad[:5]}")

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        done: dict[int, bytes] = {}
        todo = []
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                done[k] = whole.to_bytes(4, "little")
            else:
                todo.append(k)
        if todo:
            done.update(zip(todo, self._merge([words[k] for k in todo]), strict=True))
        return [done[k] for k in range(len(words))]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        # one array for all words, with a dead cell between them that matches no pair
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([0] + [len(w) + 1 for w in words])
        cells = self.byte_ids[raw]
        cells[ends] = _DEAD
        n = len(cells)
        tok = array("q", cells.tobytes())
        nxt, prv = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        index: dict[int, list[int]] = {}
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        first = np.flatnonzero(inside[:-1] & inside[1:])
        rank_of = self.byte_pairs[raw[first].astype(np.int32) << 8 | raw[first + 1]]
        first, rank_of = first[rank_of >= 0], rank_of[rank_of >= 0]
        order = np.argsort(rank_of, kind="stable")
        first, rank_of = first[order], rank_of[order]
        starts = np.flatnonzero(np.diff(rank_of, prepend=-1)).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(first)], strict=False):
            index[int(rank_of[lo])] = first[lo:hi].tolist()
        dead, none = _DEAD, {}
        for r in range(self.top):
            places = index.pop(r, None)
            if places is None:
                continue
            # a pair may overlap itself or another that forms the same token: leftmost first then, as in one word
            places.sort()
            to_right, to_left = self.rightwards.get(r, none), self.leftwards.get(r, none)
            for a, b in self.cuts[r] if len(self.cuts[r]) == 1 else [(None, None)]:
                for i in places:
                    j = nxt[i]
                    if a is None:
                        if (tok[i], tok[j]) not in self.cuts[r]:
                            continue
                    elif tok[i] != a or tok[j] != b:
                        continue
                    k, h = nxt[j], prv[i]
                    tok[i], tok[j] = r, dead
                    nxt[i], prv[k] = k, i
                    if (q := to_left.get(tok[h])) is not None:
                        if q in index:
                            index[q].append(h)
                        else:
                            index[q] = [h]
                    if (q := to_right.get(tok[k])) is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
        left = np.frombuffer(tok, dtype=np.int64)
        alive = left != _DEAD
        upto = np.concatenate([[0], np.cumsum(alive)])
        flat = left[alive].astype("<i4").tobytes()
        cuts = (4 * upto[ends]).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        known, times = self.words, Counter(chain.from_iterable(split))
        fresh = [w for w in times if w not in known]
        look = dict(zip(fresh, self.replay([w.encode("utf-8") for w in fresh]), strict=True))
        # a word that came once in a block is not likely to come in the next
        often = [w for w in fresh if times[w] > 1]
        for w in times.keys() - look.keys():
            look[w] = known[w]
        if len(known) + len(often) > CACHE_WORDS:
            known = self.words = {w: look[w] for w in times if times[w] > 2}
        known.update((w, look[w]) for w in often[: CACHE_WORDS])
        return [b"".join(map(look.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))


_loaded: dict[tuple[int, str], MergeReplay] = {}


@lru_cache(maxsize=8)
def _checked(rank_file: bytes, pattern: str) -> None:
    MergeReplay(rank_file, pattern).check()


def _tokenizer(rank_file: bytes, pattern: str) -> MergeReplay:
    """One per worker process, kept from task to task with its cache."""
    key = (hash(rank_file), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MergeReplay(rank_file, pattern)
    return _loaded[key]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _ids_cell(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the text column replaced by ``ids_col array<int>``, and, if ``decoded_col`` is given, the bytes that
    these ids decode to; all other columns pass through."""
    spark = df.sparkSession
    bound_batches(spark)
    file = read_ranks(spark, rank_path)
    _checked(file, pattern)
    ranks = spark.sparkContext.broadcast(file)
    others = [c for c in df.columns if c not in (text_col, ids_col, decoded_col)]
    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]
    if decoded_col is not None:
        made.append(T.StructField(decoded_col, T.BinaryType(), False))
    names = [*others, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        tokenizer = _tokenizer(ranks.value, pattern)
        for block in _blocks(batches, block_bytes):
            ids = iter(tokenizer.encode(t or "" for b in block for t in b.column(text_col).to_pylist()))
            for b in block:
                # out in slices of bounded size
                lo, rows, held = 0, [], 0
                for k in range(b.num_rows):
                    rows.append(next(ids))
                    held += len(rows[-1])
                    if held >= BATCH_BYTES or k + 1 == b.num_rows:
                        part = b.slice(lo, len(rows))
                        cells = [_ids_cell(rows)]
                        if decoded_col is not None:
                            cells.append(pa.array([tokenizer.decode(r) for r in rows], pa.binary()))
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *cells], names=names)
                        lo, rows, held = k + 1, [], 0

    return df.select(*[f"`{c}`" for c in others], F.col(text_col)).mapInArrow(run, T.StructType([df.schema[c] for c in others] + made))


def decode(df: DataFrame, rank_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col binary`` added: the bytes that ``ids_col`` stands for (null ids: none)."""
    spark = df.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, rank_path))
    kept = [c for c in df.columns if c != bytes_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        vocab = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.value.splitlines() if line.strip())}
        for b in batches:
            out = pa.array([b"".join(map(vocab.__getitem__, ids or ())) for ids in b.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [out], names=[*kept, bytes_col])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
