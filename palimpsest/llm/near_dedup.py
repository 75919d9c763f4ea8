"""Near-duplicate detection by HyperMinHash.

A document is the set of its distinct word n-grams (words: ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; with fewer than n
words, the whole sequence is one). Two documents are linked when the Jaccard similarity of their sets reaches a threshold.

Sketch: each n-gram's 64-bit hash names one of ``REGISTERS`` buckets; a register keeps the least hash of its bucket in
compressed form, the count of leading zeros and the mantissa bits after them (16 bits in all; 0: empty). Bands of
``BAND`` compressed registers are the buckets of candidate search (bands without any n-gram are no evidence and are left
out). The registers of a candidate pair give an estimate of its similarity, corrected for the registers that agree by
accident at the two set sizes; pairs whose estimate is beyond ``MARGIN`` standard errors under the threshold go. All
others are confirmed on their full sets.

A bucket is a band's registers and a size class: sets that reach the threshold are of the same or neighbouring classes, so
each set goes to its own and the next class's bucket.

Groups of any size: documents with equal sets (by a 128-bit hash of the whole set) are one class from the start, so copies
cost nothing; a class gets a number of its own when the classes are written. Round 1 compares
each class with one other, the smallest of the bucket it shares with most: a star. Round 2 looks at the buckets whose
classes are still in different components, and there at all pairs of different components, in blocks of bounded size:
first by sketch, each pair in the first of the buckets it shares; then, for classes with a pair left, on the full sets.
Pairs never become rows; a block returns the links that join components. No bucket is gathered in one task, and no bucket,
pair or partner is left out. What can be lost is lost by the sketch alone: with all registers in use, a pair exactly at the
threshold shares no band with a probability under 1e-7, and falls under the screen with one of under 1e-8 (the binomial's
left tail at ``MARGIN``, for 0.8 and for 0.85). ``margin=None`` turns the screen off: then all pairs of fitting size that
share a bucket are compared on full sets. Every pair that is reported is confirmed.

Defined cases: a null or blank text has an empty set and is linked with nothing; repeated rows are documents of their
own with one id, and share a component if any of them is linked; a null id is linked with nothing but copies of a
known id; an empty table gives an empty table. ``near_duplicates`` returns its four columns alone, ``keep_one`` the rows
with all their columns, whatever their names. ``keep_one`` decides by row, not by id: of linked texts, copies included, the
row of the smallest id stays (known ids before null; then the smallest hash of the text), whatever other rows have its id;
rows that agree in id and text are one document; texts without words all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, components, discard, durable, lean, unused

REGISTERS, BAND = 128, 4
MANTISSA = 11
MARGIN = 6.5
#: Classes, and n-grams of theirs, that a block of round 2 holds.
BLOCK, BLOCK_GRAMS = 1500, 1 << 20

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.translate(_UPPER).split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    kinds = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(kinds.__getitem__, words), dtype=np.uint64, count=len(words))
    m = len(words) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[k : k + m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set of hashes."""
    bits = REGISTERS.bit_length() - 1
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(hashes):
        return out
    # sorted by hash, so a bucket's first is its least; the bucket is the top bits
    where = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    # 53 bits of the rest are exact in a double, whose exponent counts the leading zeros
    rest = ((hashes[first] << np.uint64(bits)) >> np.uint64(11)).astype(np.float64) + 1.0
    fraction, exponent = np.frexp(rest)
    zeros = np.minimum(54 - exponent, 30)
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    out[where[first]] = (zeros << MANTISSA | np.minimum(mantissa, (1 << MANTISSA) - 1)) + 1
    return out


def _accident() -> np.ndarray:
    """The probability that the registers of two disjoint sets agree, by their sizes' powers of two: over all register
    values, the product of the probabilities that each set's least hash has it."""
    per = [max(1.0, 2.0**k / REGISTERS) for k in range(41)]
    edges = np.concatenate([[0.0], *[np.linspace(2.0 ** -(z + 1), 2.0**-z, 65)[:-1] for z in range(40, -1, -1)], [1.0]])
    cells = [np.diff(1 - (1 - edges) ** n) for n in per]
    width = 64.0 / (1 << MANTISSA)
    return np.array([[float((a * b).sum()) * width for b in cells] for a in cells])


ACCIDENT = _accident()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The collision-corrected Jaccard estimate for sketches ``(..., REGISTERS)`` of sets of ``na`` and ``nb`` n-grams."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    p = ACCIDENT[np.log2(np.maximum(na, 1)).astype(int), np.log2(np.maximum(nb, 1)).astype(int)]
    rate = same / np.maximum(used, 1)
    return (rate - p) / (1 - p)


def least_estimate(threshold: float, used: np.ndarray, margin: float = MARGIN) -> np.ndarray:
    return threshold - margin * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) - 1e-9


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, margin: float | None = MARGIN) -> np.ndarray:
    """Whether a pair may reach the threshold, by its sizes (certain) and by its sketches (within the margin, if there is one)."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    fits = 100 * small >= percent * large
    if margin is None:
        return fits
    used = ((a != 0) | (b != 0)).sum(-1)
    return fits & (estimate(a, b, na, nb) >= least_estimate(percent / 100, used, margin))


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


SKETCHED = "doc_id long, mark long, n_shingles long, set_key binary, sketch binary"
_SKETCHED_PA = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])


Key = Callable[[np.ndarray], bytes]


def _sketched(n: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            sizes, keys, regs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text or b"", n)
                sizes.append(len(s))
                keys.append(key(s) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], schema=_SKETCHED_PA)

    return run


def size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sizes whose ratio reaches the threshold are at most one class apart (classes are a little wide, for rounding)."""
    return np.floor(np.log(sizes) / (np.log(100 / percent) * 1.001)).astype(np.int64)


BANDS = "band long, place int, class int, node long"


def _bands(percent: int):
    """Two rows for each band of a class that holds an n-gram: its own size class's bucket, and the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        salt = (np.arange(REGISTERS // BAND, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]
        for b in batches:
            if not b.num_rows:
                continue
            nodes = b.column(0).to_numpy()
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint64).reshape(len(nodes), REGISTERS // BAND)
            own = size_class(b.column(1).to_numpy(), percent)
            row, col = np.nonzero(regs)
            for step in (0, 1):
                at = own[row] + step
                key = salt[0, col] + regs[row, col] + at.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
                for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(col, pa.int32()), pa.array(at, pa.int32()), pa.array(nodes[row], pa.int64())], names=["band", "place", "class", "node"])

    return run


PAIRS = "a long, b long"


def _filter_pairs(percent: int, margin: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if not b.num_rows:
                continue
            a, c, na, nc = (b.column(k).to_numpy() for k in range(4))
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            ok = passes(left, right, na, nc, percent, margin)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], names=["a", "b"])

    return run


def _sets(n: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            rows = [s for t in b.column(0).to_pylist() if len(s := shingles(t or b"", n))]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, dtype=np.int64)
            keys = pa.array([key(r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["set_key", "grams"])

    return run


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, n: int, key: Key) -> DataFrame:
    """``node, grams`` (sorted) of the classes in ``nodes(node)``; only texts of theirs are cut into n-grams again."""
    wanted = durable(classes.join(nodes.distinct(), "node", "left_semi").select("node", "rep", "set_key"), "wanted")
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("content")
    # ids may repeat, so a class's own text is told by its set
    own = texts.mapInArrow(_sets(n, key), "set_key binary, grams array<long>").dropDuplicates(["set_key"])
    sets = durable(own.join(wanted.select("set_key", "node"), "set_key").select("node", "grams"), "sets")
    discard(docs.sparkSession, wanted)
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b")


#: Rows of whole groups handled at once, and pairs looked at in one step.
_ROWS, _STEP = 2048, 20_000


def _groups(batches: Iterator[pa.RecordBatch], size: int = _ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``band, i, j``, with each row's group number."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        keys = [t.column(c).to_numpy() for c in ("band", "i", "j")]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.cumsum(new) - 1

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < size:
            continue
        t = pa.Table.from_batches(held)
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, numbered(t)


def _near_pairs(t: pa.Table, group: np.ndarray, percent: int, margin: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows that make a pair within their group: of different components (and, in a pair of blocks, one of each),
    of fitting size, sharing no earlier bucket, and near by sketch. Left places ascend."""
    regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    keys = regs.view(np.uint64)
    size, part, block, place, at, i, j = (t.column(c).to_numpy() for c in ("n_shingles", "component", "block", "place", "class", "i", "j"))
    own, across = size_class(size, percent), i != j
    n = len(group)
    last = np.searchsorted(group, group, side="right")
    todo = last - np.arange(n) - 1  # partners after each row
    upto = np.concatenate([[0], np.cumsum(todo)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _STEP, side="right")) - 1)
        x = np.repeat(np.arange(lo, hi), todo[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[lo:hi] - upto[lo], todo[lo:hi])
        lo = hi
        ok = (part[x] != part[y]) & (np.maximum(own[x], own[y]) == at[x]) & (~across[x] | (block[x] != block[y]))
        ok &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        x, y = x[ok], y[ok]
        if len(x):
            shared = (keys[x] == keys[y]) & (keys[x] != 0)
            ok = shared.argmax(1) == place[x]
            x, y = x[ok], y[ok]
        if len(x):
            ok = passes(regs[x], regs[y], size[x], size[y], percent, margin)
            if ok.any():
                yield x[ok], y[ok]


OPEN = "band long, i int, j int, node long"


def _open_nodes(percent: int, margin: float | None):
    """The classes of a block that have a partner by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t, group in _groups(batches):
            hit = np.zeros(len(group), dtype=bool)
            for x, y in _near_pairs(t, group, percent, margin):
                hit[x] = hit[y] = True
            yield from t.select(["band", "i", "j", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _block_links(percent: int, margin: float | None):
    """The links on full sets that join components within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t, group in _groups(batches, 512):
            node, size = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
            # sorted as unsigned numbers
            cell = t.column("grams").combine_chunks()
            cell = cell.chunk(0) if isinstance(cell, pa.ChunkedArray) else cell
            ends, flat = cell.offsets.to_numpy(), cell.values.to_numpy().view(np.uint64)
            parts = np.unique(np.stack([group, t.column("component").to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
            out: list[tuple[int, int]] = []
            for xs, ys in _near_pairs(t, group, percent, margin):
                cuts = np.flatnonzero(np.diff(xs, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(xs)], strict=True):
                    x, o = xs[lo], ys[lo:hi]
                    o = o[parts[o] != parts[x]]
                    if not len(o):
                        continue
                    mine = flat[ends[x] : ends[x + 1]]
                    theirs = np.concatenate([flat[ends[y] : ends[y + 1]] for y in o])
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    starts = np.concatenate([[0], np.cumsum(size[o])[:-1]])
                    both = np.add.reduceat((mine[at] == theirs).astype(np.int64), starts)
                    for y in o[100 * both >= percent * (size[o] + size[x] - both)]:
                        if parts[y] != parts[x]:
                            out.append((int(node[x]), int(node[y])))
                            parts[parts == parts[y]] = parts[x]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _by_block(rows: DataFrame) -> DataFrame:
    """The rows of a block side by side in one partition."""
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")


def _linked(df: DataFrame, id_col: str, text_col: str, words: int, percent: int, key: Key, margin: float | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``SKETCHED``, and ``set_key, least, first`` of each class: the smallest id of its component, and the id and
    mark of the document that stands for it."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("content")).withColumn("mark", mark_of(F.col("content")))
    sketched = durable(docs.mapInArrow(_sketched(words, key), SKETCHED), "sketches")
    # classes of equal sets
    by_set = sketched.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # the number of a class is written with it, and read from there ever after
    classes = durable(by_set.withColumn("node", F.monotonically_increasing_id()), "classes")
    # a set of fewer n-grams can reach the threshold with no other set
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60
    facts = classes.where((F.col("n_shingles") >= least) & F.col("rep").isNotNull()).select("node", "n_shingles", "sketch")
    bands = facts.mapInArrow(_bands(percent), BANDS)
    # aggregates are written before they are joined back to their rows: a hot bucket is then a skewed key that can be split
    stars = durable(bands.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "stars")
    # of the buckets, only those shared by two classes or more are written
    shared = durable(bands.join(stars, "band"), "bands")

    def screened(pairs: DataFrame) -> DataFrame:
        left = facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        right = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        rows = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_filter_pairs(percent, margin), PAIRS)

    often = shared.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("times"))
    star = often.groupBy("node").agg(F.max(F.struct("times", "head")).alias("m")).select(F.col("m.head").alias("a"), F.col("node").alias("b"))
    first = durable(screened(star), "pairs")
    sets = _full_sets(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))), classes, docs, words, key)
    links = durable(_confirmed(first, sets, percent), "links")
    kept_links = [links]
    discard(spark, sets)
    parts = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # round 2: buckets with classes of different components
    placed = shared.join(parts, "node", "left").join(facts.select("node", "n_shingles"), "node").select("band", "place", "class", "node", "n", "n_shingles", F.coalesce("component", "node").alias("component"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    placed = durable(placed, "placed")
    open_bands = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("n"), F.sum("n_shingles").alias("grams")).where("lo <> hi").select("band", blocks)
    open_bands = durable(open_bands, "open-bands")
    members = placed.join(open_bands, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = durable(dealt.select("band", "i", "j", "node", "n_shingles", "component", "block", "place", "class"), "blocks")
    seen = durable(_by_block(dealt.join(facts.select("node", "sketch"), "node")).mapInArrow(_open_nodes(percent, margin), OPEN), "open")
    if not seen.isEmpty():
        sets = _full_sets(seen.select("node"), classes, docs, words, key)
        rows = dealt.join(seen, ["band", "i", "j", "node"]).join(facts.select("node", "sketch"), "node").join(sets, "node")
        more = durable(_by_block(rows).mapInArrow(_block_links(percent, margin), PAIRS), "links")
        discard(spark, sets)
        kept_links.append(more)
        known = parts.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
        before, parts = parts, components(known.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        discard(spark, before)
    discard(spark, dealt, shared, placed, stars, open_bands, seen, first)

    grouped = classes.select("node", "set_key", "rep", "own").join(parts, "node", "left").select("set_key", "rep", "own", F.coalesce("component", "node").alias("component"))
    least_doc = durable(grouped.groupBy("component").agg(F.min("rep").alias("least"), F.min("own").alias("first")), "least")
    named = durable(grouped.select("set_key", "component").join(least_doc, "component").select("set_key", "least", "first"), "named")
    discard(spark, classes, least_doc, parts, *kept_links)
    return sketched, named


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, key: Key = set_key, margin: float | None = MARGIN) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, kept``; a written table. Documents are linked when 100 times
    their intersection is at least ``percent`` times their union; ``component_id`` is the smallest id reachable over links.
    ``key`` tells sets apart; ``margin`` is the screen's, in standard errors (None: no screen)."""
    sketched, named = _linked(df, id_col, text_col, words, percent, key, margin)
    rows = sketched.select("doc_id", "n_shingles", "set_key")
    # documents without words apart: as keys of the join they would be one
    linked = rows.where("set_key is not null").join(named.select("set_key", "least"), "set_key", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    out = linked.unionByName(rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    done = durable(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
    discard(df.sparkSession, sketched, named)
    return done


def mark_of(content: Column) -> Column:
    """With its id, what tells a row's text from others."""
    return F.xxhash64(content)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, margin: float | None = MARGIN) -> DataFrame:
    """The rows of ``df`` whose document stands for its component, with all their columns."""
    sketched, named = _linked(df, id_col, text_col, words, percent, set_key, margin)
    rows = sketched.where("set_key is not null").select("doc_id", "mark", "set_key")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    gone = durable(rows.join(named.select("set_key", "first"), "set_key").where(~stays).select("doc_id", "mark").distinct(), "gone")
    again = durable(rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "mark"), "again")
    own, mark = unused(df, "own", "mark")
    told = df.withColumn(own, F.col(f"`{id_col}`").cast("long")).withColumn(mark, mark_of(F.col(f"`{text_col}`").cast("binary")))

    def met(with_: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        a, b = unused(df, "known", "seen")
        keys = with_.select(F.col("doc_id").alias(a), F.col("mark").alias(b))
        return rows.join(keys, F.col(own).eqNullSafe(F.col(a)) & (F.col(mark) == F.col(b)), how)

    kept = met(gone, told, "left_anti")
    if not again.isEmpty():
        # rows that agree in id and text, of which one stays
        kept = met(again, kept, "left_anti").unionByName(met(again, kept, "left_semi").dropDuplicates([own, mark]))
    discard(df.sparkSession, sketched, named)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
