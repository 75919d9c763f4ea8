"""Exact deduplication by Grace hashing: records are partitioned recursively into spill files until each bucket fits an
open-addressing table, which compares complete contents.

Two texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one space.

Plan: (1) each input partition combines its own copies in such a table, so that a text leaves a partition once however
often it occurs there; (2) those representatives are shuffled by a hash of the whole text and each partition runs the
Grace recursion; (3) the verdicts go back to the rows over the local group number.

Hot texts: the group that holds a third of all rows is one representative for each table of (1), and a large input has many
of those. Hashes with more than ``MEET`` representatives therefore take a level between (1) and (2): they are dealt to
about the root of their number of tasks, each of which combines its share by the same recursion and passes one
representative on. So a task meets the root of the number of copies, and content is sent once a level.

Defined cases: a null text counts as empty; empty texts are equal to each other; ids may repeat or be null (nulls sort
last) and of rows that tie exactly one is kept; an empty table gives an empty table; other columns of the input are
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, discard, durable, lean, unused

#: Bytes of distinct content a task holds in its table before it spills (or, in the combining pass, flushes).
MEMORY_BYTES = 24 << 20
#: Representatives of one hash that may meet in a task without a level between.
MEET = 64
FANOUT_BITS = 4
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_NO_ID = (1 << 63) - 1
_HEAD = struct.Struct("<QqqqQI")


def normalised(text: bytes) -> bytes:
    text = text.translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class OpenTable:
    """Linear probing over a power-of-two slot array; an entry matches only if its whole content does."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of the entry and whether it is new."""
        slots, mask, hashes = self.slots, self.mask, self.hashes
        i = h & mask
        while (e := slots[i]) >= 0:
            if hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        slots[i] = e = len(hashes)
        hashes.append(h)
        self.contents.append(content)
        self.size += len(content) + 120
        if 3 * len(hashes) > 2 * mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = mask = 2 * self.mask + 1
        self.slots = slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = e


LOCAL = "id long, g long, first boolean, rep boolean, h long, n long, sha binary, content binary"
_LOCAL_PA = pa.schema([("id", pa.int64()), ("g", pa.int64()), ("first", pa.bool_()), ("rep", pa.bool_()), ("h", pa.int64()), ("n", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])
_SLICE = 1 << 20


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _combine(memory: int):
    """Rows ``(id, text)`` of a partition -> a member row for each, and a representative for each distinct text."""

    def flush(table: OpenTable, base: int, ids: list[int], groups: list[int]) -> Iterator[pa.RecordBatch]:
        k = len(table.hashes)
        least, count, where = [_NO_ID] * k, [0] * k, [-1] * k
        for row, (i, e) in enumerate(zip(ids, groups, strict=True)):
            count[e] += 1
            if i < least[e] or where[e] < 0:
                least[e], where[e] = i, row
        firsts = [False] * len(ids)
        for row in where:
            firsts[row] = True
        for lo in range(0, len(ids), 20_000):
            part = slice(lo, lo + 20_000)
            n = len(ids[part])
            none = lambda kind: pa.nulls(n, kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if i == _NO_ID else i for i in ids[part]], pa.int64()), pa.array([base + e for e in groups[part]], pa.int64()), pa.array(firsts[part]), pa.array([False] * n), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary())], schema=_LOCAL_PA
            )
        lo = 0
        while lo < k:
            hi, held = lo, 0
            while hi < k and (hi == lo or held + len(table.contents[hi]) <= _SLICE):
                held += len(table.contents[hi])
                hi += 1
            texts = table.contents[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if i == _NO_ID else i for i in least[lo:hi]], pa.int64()), pa.array(range(base + lo, base + hi), pa.int64()), pa.array([True] * (hi - lo)), pa.array([True] * (hi - lo)), pa.array([_signed(h) for h in table.hashes[lo:hi]], pa.int64()), pa.array(count[lo:hi], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())], schema=_LOCAL_PA
            )
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        base = TaskContext.get().partitionId() << 40
        table, ids, groups = OpenTable(), [], []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                text = normalised(text or b"")
                ids.append(_NO_ID if i is None else i)
                groups.append(table.entry(xxhash.xxh3_64_intdigest(text), text)[0])
            if table.size + 80 * len(ids) > memory:
                yield from flush(table, base, ids, groups)
                base += len(table.hashes)
                table, ids, groups = OpenTable(), [], []
        if ids:
            yield from flush(table, base, ids, groups)

    return run


VERDICT = "g long, keep_id long, keep_g long, group_size long, sha binary"
_VERDICT_PA = pa.schema([("g", pa.int64()), ("keep_id", pa.int64()), ("keep_g", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary())])


HEADS = VERDICT + ", h long, content binary"
_HEADS_PA = pa.schema([*_VERDICT_PA, ("h", pa.int64()), ("content", pa.binary())])


class _Spill:
    """Bucket files of one level of the recursion, in the scratch folder Spark gives its workers."""

    def __init__(self, folder: str) -> None:
        self.folder = tempfile.mkdtemp(dir=folder)
        self.files: dict[int, object] = {}

    def put(self, bucket: int, record: tuple) -> None:
        if (f := self.files.get(bucket)) is None:
            f = self.files[bucket] = open(os.path.join(self.folder, str(bucket)), "wb", buffering=1 << 16)  # noqa: SIM115
        h, i, g, n, sha, content = record
        f.write(_HEAD.pack(h, i, g, n, len(content), len(sha)) + sha)
        f.write(content)

    def buckets(self) -> Iterator[str]:
        for f in self.files.values():
            f.close()
        for b in sorted(self.files):
            yield os.path.join(self.folder, str(b))


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(_HEAD.size):
            h, i, g, n, size, width = _HEAD.unpack(head)
            sha = f.read(width)
            yield h, i, g, n, sha, f.read(size)


def grace(records: Iterator[tuple], memory: int, scratch: str, depth: int = 0) -> Iterator[tuple]:
    """``(hash, id, g, n, sha, content)`` -> ``(g, keep_id, keep_g, total n, sha, hash, content)``; content only where g is keep_g.

    Fills a table; when its distinct contents outgrow ``memory``, that table's records and all further ones go to spill
    files by the next bits of the hash, each of which is treated alike. Copies take no table space, so a bucket of one
    content ends the recursion; so do hashes with no bits left.
    """
    table, members = OpenTable(), []
    records = iter(records)
    for h, i, g, n, sha, content in records:
        e, new = table.entry(h, content)
        if new:
            members.append([i, g, n, sha, [(i, g, n)]])
        else:
            m = members[e]
            m[0], m[1] = min((m[0], m[1]), (i, g))
            m[2] += n
            m[4].append((i, g, n))
        if table.size > memory and len(table.hashes) > 1 and FANOUT_BITS * (depth + 1) < 60:
            break
    else:
        for h, content, (keep, keep_g, total, sha, own) in zip(table.hashes, table.contents, members, strict=True):
            for _, g, _ in own:
                yield g, keep, keep_g, total, sha, h, content if g == keep_g else None
        return
    spill, shift = _Spill(scratch), 60 - FANOUT_BITS * depth
    low = (1 << FANOUT_BITS) - 1
    try:
        for h, content, m in zip(table.hashes, table.contents, members, strict=True):
            for i, g, n in m[4]:
                spill.put(h >> shift & low, (h, i, g, n, m[3], content))
        del table, members
        for r in records:
            spill.put(r[0] >> shift & low, r)
        for path in spill.buckets():
            yield from grace(_read(path), memory, spill.folder, depth + 1)
            os.unlink(path)
    finally:
        shutil.rmtree(spill.folder, ignore_errors=True)


def _scratch() -> str:
    """Where Spark lets this worker spill: one of its own folders, by turns."""
    folders = os.environ["SPARK_LOCAL_DIRS"].split(",")
    return folders[TaskContext.get().partitionId() % len(folders)]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for h, i, g, n, sha, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield h & (1 << 64) - 1, _NO_ID if i is None else i, g, n, sha, content


def _resolve(memory: int, heads: bool = False):
    """``heads``: with the hash and content of the rows that stay (``HEADS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            g, keep, keep_g, total, sha, h, content = zip(*out, strict=True)
            columns = [g, [None if k == _NO_ID else k for k in keep], keep_g, total, sha, *([list(map(_signed, h)), content] if heads else [])]
            schema = _HEADS_PA if heads else _VERDICT_PA
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held = 0
        for row in grace(_records(batches), memory, _scratch()):
            out.append(row)
            held += len(row[-1] or b"") if heads else 0
            if len(out) == 20_000 or held > _SLICE:
                yield batch()
                out.clear()
                held = 0
        if out:
            yield batch()

    return run


REPS = "h long, id long, g long, n long, sha binary, content binary"


def _meet(reps: DataFrame, memory: int) -> DataFrame:
    """``VERDICT`` for representatives, after all of a hash have met."""
    return reps.repartition("h").mapInArrow(_resolve(memory), VERDICT)


def _verdicts(reps: DataFrame, memory: int, meet: int) -> DataFrame:
    """``VERDICT`` for the representatives in ``reps(REPS)``, a written table; those of hot hashes meet in two levels."""
    spark = reps.sparkSession
    hot = durable(reps.groupBy("h").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") > meet), "hot-hashes")
    if hot.isEmpty():
        return _meet(reps, memory)
    # the number of tasks that share a hash: the root of its representatives
    shared = reps.join(hot, "h").withColumn("__share", F.pmod(F.xxhash64("g"), F.ceil(F.sqrt("met")).cast("int")))
    first = durable(shared.repartition("h", "__share").select(*_names(REPS)).mapInArrow(_resolve(memory, heads=True), HEADS), "first-level")
    heads = first.where("g = keep_g").select("h", F.col("keep_id").alias("id"), "g", F.col("group_size").alias("n"), "sha", "content")
    passed = reps.join(hot, "h", "left_anti").unionByName(heads)
    last = durable(_meet(passed, memory), "last-level")
    over = last.select(F.col("g").alias("keep_g"), F.col("keep_id").alias("__id"), F.col("keep_g").alias("__g"), F.col("group_size").alias("__n"))
    lower = first.select("g", "keep_g", "sha").join(over, "keep_g").select("g", F.col("__id").alias("keep_id"), F.col("__g").alias("keep_g"), F.col("__n").alias("group_size"), "sha")
    return last.join(first.select("g"), "g", "left_anti").unionByName(lower)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY_BYTES, meet: int = MEET) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256`` (of the normalised text); a written table."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("content"))
    local = durable(rows.mapInArrow(_combine(memory), LOCAL), "local-groups")
    verdicts = durable(_verdicts(local.where("rep").select(*_names(REPS)), memory, meet), "verdicts")
    told = local.where("not rep").select("id", "g", "first").join(verdicts, "g")
    out = durable(told.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("first") & (F.col("g") == F.col("keep_g"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")), "copies")
    discard(spark, local, verdicts)
    return out


def text_key(text: str) -> F.Column:
    """The normalised text's SHA-256 as ``duplicates`` reports it."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY_BYTES) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of equal texts, the one with the smallest id."""
    own, told = unused(df, "id", "key")
    key = lambda c: F.coalesce(c, F.lit(_NO_ID))
    kept = duplicates(df, id_col, text_col, memory).where("kept").select(key(F.col("doc_id")).alias(own), F.col("text_sha256").alias(told))
    # rows that tie in both are one after the join, which has already brought them together
    found = df.withColumn(own, key(F.col(f"`{id_col}`").cast("long"))).withColumn(told, text_key(f"`{text_col}`")).join(kept, [own, told])
    return found.dropDuplicates([own, told]).select(*[F.col(f"`{c}`") for c in df.columns])
