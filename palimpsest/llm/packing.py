"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Only lengths matter to a packing, so the instance is the histogram of lengths: at most ``capacity`` rows, however many
pieces there are. It alone comes to the driver, which solves it in two steps and writes the solution as patterns (the
lengths in one sequence) with multiplicities:

1. Reduction. For the longest piece left, a sequence is fixed for good where one feasible set provably dominates every
   other that holds the piece: its other members can take the place of whatever an optimal packing put there. Tried are
   the empty set (nothing fits beside it), the largest piece that fits when it fills the sequence or no two pieces fit,
   and sets of two when no three fit. Equal lengths are fixed together, as often as both last.
2. Best fit, decreasing, of the remainder: a piece goes to the fullest open sequence that still takes it. Sequences with
   equal contents are handled as one with a multiplicity.

Each piece then gets its place by its number among the pieces of its length: the numbering is distributed (no length is
gathered in a task, though a third of all pieces may have it), and the pattern table, whose size is bounded by the
capacity alone, is broadcast.

Defined cases: a null text counts as empty and is the separator alone; repeated rows are packed as rows; an empty table
gives an empty table; pieces longer than the capacity are refused by ``pack`` (``cut`` makes none).
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from palimpsest.llm.bpe import read_ranks
from palimpsest.llm.common import bound_batches, buckets_for, durable, lean, number_within

Pattern = tuple[tuple[int, int], ...]


def _tidy(lengths: dict[int, int]) -> Pattern:
    return tuple(sorted(((s, q) for s, q in lengths.items() if q), reverse=True))


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[dict[Pattern, int], dict[int, int]]:
    """Sequences fixed for good, as patterns with multiplicities, and the histogram of what is left."""
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    fixed: dict[Pattern, int] = defaultdict(int)

    def take(members: list[int], times: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in members:
            need[s] += 1
        fixed[_tidy(need)] += times
        for s, q in need.items():
            left[s] -= q * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def smallest(k: int, without: int) -> int | None:
        """The sum of the k smallest pieces beside one of length ``without``; None if there are fewer."""
        total = 0
        for s in sizes:
            n = left[s] - (s == without)
            use = min(k, n)
            total, k = total + use * s, k - use
            if not k:
                return total
        return None

    def largest(room: int, *used: int) -> int | None:
        """The longest piece of at most ``room`` among those not used."""
        at = bisect_right(sizes, room) - 1
        while at >= 0:
            s = sizes[at]
            if left[s] > used.count(s):
                return s
            at -= 1
        return None

    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room = capacity - j
            one = largest(room, j)
            if one is None:
                take([j], left[j])
                continue
            times = left[j] // 2 if one == j else min(left[j], left[one])
            two_least = smallest(2, j)
            if one == room or two_least is None or two_least > room:
                take([j, one], times)
                continue
            three_least = smallest(3, j)
            if three_least is not None and three_least <= room:
                break
            # at most two more pieces fit: the best pair, by its sum
            best = None
            for a in reversed(sizes[: bisect_right(sizes, room)]):
                if left[a] <= (a == j):
                    continue
                b = largest(min(a, room - a), j, a)
                if b is None:
                    continue
                if best is None or a + b > sum(best):
                    best = (a, b)
                if 2 * a < sum(best):
                    break
            if best is None or one >= sum(best):
                take([j, one], times)
            elif best[0] == one and best[1] == largest(room - best[0], j, best[0]) and _second_best(sizes, left, room, one, best[1], j):
                take([j, *best], 1)
            else:
                break
    return dict(fixed), left


def _second_best(sizes: list[int], left: dict[int, int], room: int, a: int, b: int, j: int) -> bool:
    """Whether (a, b) dominates every pair within ``room``: no pair has a second member longer than b."""
    for x in reversed(sizes):
        if x <= b:
            return True
        if x > room - x:
            # the shorter of two members is at most half of the room
            continue
        if left[x] - (x == j) >= 2 or any(y > x and y <= room - x and left[y] > (y == j) for y in sizes):
            return False
    return True


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best fit, decreasing, over the histogram; equal open sequences are one group with a multiplicity."""
    groups: dict[int, list[list]] = defaultdict(list)  # by room left: [multiplicity, lengths]
    rooms: list[int] = []

    def put(room: int, times: int, lengths: dict[int, int]) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append([times, lengths])

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                if n // per:
                    put(capacity - per * s, n // per, {s: per})
                if n % per:
                    put(capacity - n % per * s, 1, {s: n % per})
                break
            room = rooms[at]
            times, lengths = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            per = min(room // s, n)
            use = min(times, n // per)
            if use < times:
                put(room, times - use, lengths)
            put(room - per * s, use, lengths | {s: per})
            n -= per * use
    out: dict[Pattern, int] = defaultdict(int)
    for own in groups.values():
        for times, lengths in own:
            out[_tidy(lengths)] += times
    return dict(out)


def solve(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Patterns with multiplicities that use up the histogram."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    for p, n in best_fit(rest, capacity).items():
        fixed[p] = fixed.get(p, 0) + n
    return fixed


_PLACES = "__length int, __low long, __high long, __first long, __per int, __at int"


def places(patterns: dict[Pattern, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Where piece number ``low <= i < high`` of a length goes: sequence ``first + (i - low) div per``, offset
    ``at + ((i - low) mod per) * length``."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern in sorted(patterns, reverse=True):
        times, at = patterns[pattern], 0
        for s, per in pattern:
            rows.append((s, used[s], used[s] + times * per, sequence, per, at))
            used[s] += times * per
            at += s * per
        sequence += times
    return rows


def pack(pieces: DataFrame, length_col: str = "length", order: list[str] | None = None, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id long`` and ``offset long`` added (columns of these names are replaced). ``order``: columns that
    tell pieces apart."""
    spark = pieces.sparkSession
    order = order or [c for c in pieces.columns if c != length_col]
    held = durable(pieces, "pieces")
    histogram = {r[0]: r[1] for r in held.groupBy(length_col).agg(F.count(F.lit(1))).collect()}
    if bad := [s for s in histogram if s is None or not 0 < s <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    rows = places(solve({int(s): n for s, n in histogram.items()}, capacity))
    numbered = number_within(held, [length_col], F.xxhash64(*order), [F.col(c) for c in order], "__nth", buckets_for(max(histogram.values(), default=0), 256, 2_000))
    where = F.broadcast(spark.createDataFrame(rows, _PLACES))
    fits = (F.col(length_col) == F.col("__length")) & (F.col("__nth") >= F.col("__low")) & (F.col("__nth") < F.col("__high"))
    return (
        numbered.join(where, fits)
        .withColumn("sequence_id", F.col("__first") + F.expr("(__nth - __low) div __per"))
        .withColumn("offset", (F.col("__at") + F.pmod(F.col("__nth") - F.col("__low"), F.col("__per")) * F.col("__length")).cast("long"))
        .select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")
    )


#: The pattern of the plain byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(text: str) -> dict[bytes, int] | None:
    """The byte ranks a byte-level BPE file of the ``tokenizers`` library implies, if they give the same ids: its merges
    must be in the order of the ids they form, nothing else may change a text, and every token must encode to itself."""
    spec = json.loads(text)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    formed = [vocab.get(a + b) for a, b in merges]
    if None in formed or formed != sorted(set(formed)) or len(vocab) != 256 + len(merges) or min(formed) < 256:
        return None
    ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items()}
    encoding = _encoding(ranks)
    return ranks if all(encoding._encode_single_piece(t) == [i] for t, i in ranks.items()) else None


def _encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(text: str) -> Callable[[str], list[int]]:
    """Encodes by the ``tokenizers`` library itself; special tokens are ordinary text."""
    own = Tokenizer.from_str(text)
    own.encode_special_tokens = True
    return lambda t: own.encode(t, add_special_tokens=False).ids


_loaded: dict[int, Callable[[str], list[int]]] = {}


def _tokenizer(spec: bytes) -> Callable[[str], list[int]]:
    """One per worker process; ``spec`` holds ranks where the file implies them, else the file."""
    if (key := hash(spec)) not in _loaded:
        _loaded.clear()
        kind, held = pickle.loads(spec)
        _loaded[key] = _encoding(held).encode_ordinary if kind == "ranks" else encoder(held)
    return _loaded[key]


def cut(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """The pieces of each row's ids, ended by the separator: ``doc_id, piece int, start long, length int, ids binary``
    (little-endian unsigned 32-bit). Only documents of more than ``capacity`` ids are cut: the pieces count back from the
    document's end, so that only the first may be shorter."""
    spark: SparkSession = df.sparkSession
    bound_batches(spark)
    file = read_ranks(spark, tokenizer_path).decode("utf-8")
    ranks = ranks_of(file)
    spec = spark.sparkContext.broadcast(pickle.dumps(("file", file) if ranks is None else ("ranks", ranks)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.IntegerType(), False), T.StructField("ids", T.BinaryType(), False)])
    arrow = pa.schema([("doc_id", pa.int64()), pa.field("piece", pa.int32(), False), pa.field("start", pa.int64(), False), pa.field("length", pa.int32(), False), pa.field("ids", pa.binary(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encode = _tokenizer(spec.value)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), separator], dtype="<u4")
                start, end, piece = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                while start < len(ids):
                    rows.append((doc, piece, start, end - start, ids[start:end].tobytes()))
                    start, end, piece = end, end + capacity, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` for every piece of every row."""
    pieces = cut(df, tokenizer_path, id_col, text_col, capacity)
    return pack(pieces, "length", ["doc_id", "piece", "ids"], capacity)
