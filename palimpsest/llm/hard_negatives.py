"""Hard negatives by a pivot table.

For every anchor the best rows of its label (positives), and for each of these the best rows of other labels whose score lies
in a band below the positive's (hard negatives). Scores are inner products of integer vectors, exact; better is the
larger score, then the smaller id.

Inner products become distances: with M the largest length of a vector, x gets the further component sqrt(M^2 - |x|^2) and a
query q gets 0, so that d(q, x)^2 = |q|^2 + M^2 - 2 q x. The pivot table stores each row's distances to ``PIVOTS`` rows
(chosen far apart from a sample of at most ``SAMPLE`` rows; that choice changes speed alone). By the triangle inequality
d(q, x) is at least |d(q, p) - d(x, p)| and at most d(q, p) + d(x, p), which brackets the score; three times, coarse to
fine: for a block of anchors and a shard of rows (before either is sent), for an anchor and a tile of ``TILE`` rows, and
for an anchor and a row. What the brackets leave is scored exactly, so no result depends on them; they are widened by more
than what double precision can be off.

The rows are dealt to shards of bounded size by label and nearest pivot; small labels share shards. Equal vectors of one
label are cut to the smallest ids that a result can hold, which changes no result and keeps a common vector from filling
shards. Anchors are dealt to blocks by the shard they lie in. A search has two sweeps: each block visits the shards that
promise most, and what it finds is the bound for the other shards, most of whose brackets or rows fall below it.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, of another width than most, or so
long that scores would not fit a long (|x|^2 from 2^62 on) take no part; a zero vector does. Rows that agree in id, label
and vector are one row; rows with one id that differ are candidates of their own, but none answers an anchor of its id,
and the smallest label and then vector of an anchor's id asks. An anchor without positives, and a positive of negative
score, have no hard negatives. An empty table has an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.llm.common import bound_batches, discard, durable, lean

PIVOTS, SAMPLE = 16, 512
#: Rows and bytes that a shard holds about, rows of a tile, anchors of a block, anchors scored in one step.
SHARD_ROWS, SHARD_BYTES, TILE, BLOCK, STEP = 8192, 4 << 20, 64, 512, 64
#: Shards that a block visits first.
FIRST = 2
_LEAST, _MOST = -(1 << 62), 1 << 62
_FITS = float(1 << 62)
_EXACT = float(1 << 52)


def integers(vector: Column, scale: float) -> Column:
    """Components times ``scale``, rounded down, still as doubles."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def spread_out(vectors: np.ndarray, most: float, count: int) -> np.ndarray:
    """Rows far apart from each other: each next one is the farthest from those before, in the space with the further component."""
    whole = np.hstack([vectors, np.sqrt(np.maximum(most - (vectors * vectors).sum(1, keepdims=True), 0))])
    chosen = [int(np.argmax((vectors * vectors).sum(1)))]
    far = ((whole - whole[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((whole - whole[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def distances(x: np.ndarray, pivots: np.ndarray, most: float, asking: bool) -> np.ndarray:
    """``(rows, pivots)``: distances of rows, or of queries, to the pivots in the space with the further component."""
    own, theirs = (x * x).sum(1)[:, None], (pivots * pivots).sum(1)[None, :]
    up = 0.0 if asking else np.sqrt(np.maximum(most - own, 0)) * np.sqrt(np.maximum(most - theirs, 0))
    return np.sqrt(np.maximum((own if asking else most) + most - 2 * (x @ pivots.T + up), 0))


def bracket(low: np.ndarray, high: np.ndarray, q2: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score at a distance from ``low`` to ``high``, widened for rounding."""
    slack = 1e-6 * np.sqrt(q2 + most) + 1e-6
    wide = 1e-9 * (q2 + most) + 1
    least = (q2 + most - (high + slack) ** 2) / 2 - wide
    return least, (q2 + most - np.maximum(low - slack, 0) ** 2) / 2 + wide


def _measured(pivots: np.ndarray, most: float, asking: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
                d = distances(x, pivots, most, asking)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(d.argmin(1), pa.int32())], names=[*b.schema.names, "far", "nearest"])

    return run


TABLE = "shard int, grp string, n int, low array<double>, high array<double>, ids binary, labels binary, vectors binary, far binary"


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    far = np.stack(rows["far"].to_numpy())
    order = np.lexsort((far.min(1), far.argmin(1)))
    rows, far = rows.iloc[order], far[order]
    vectors = np.stack(rows["vec"].to_numpy()).astype("<f8")
    parts = [rows["id"].to_numpy("<i8").tobytes(), rows["label"].to_numpy("<i8").tobytes(), vectors.tobytes(), far.astype("<f8").tobytes()]
    return pd.DataFrame([[int(rows["shard"].iloc[0]), rows["grp"].iloc[0], len(rows), far.min(0).tolist(), far.max(0).tolist(), *parts]], columns=[c.split()[0] for c in TABLE.split(", ")])


#: A block of anchors; of target t, ``owner[t]`` is the anchor's place, ``about[t]`` what it is asked for, from ``cut[t]`` to ``top[t]``.
BLOCKS = "block long, home int, grp string, q_low double, q_high double, low array<double>, high array<double>, from_score long, to_score long, ids binary, labels binary, vectors binary, far binary, owner binary, about binary, cut binary, top binary"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    vectors, far = np.stack(rows["vec"].to_numpy()).astype("<f8"), np.stack(rows["far"].to_numpy()).astype("<f8")
    q2 = (vectors * vectors).sum(1)
    counts = [len(t) for t in rows["targets"]]
    flat = np.array([(t["about"], t["cut"], t["top"]) for ts in rows["targets"] for t in ts], dtype="<i8").reshape(-1, 3)
    owner = np.repeat(np.arange(len(rows)), counts).astype("<i4")
    parts = [rows["id"].to_numpy("<i8").tobytes(), rows["label"].to_numpy("<i8").tobytes(), vectors.tobytes(), far.tobytes(), owner.tobytes(), *[np.ascontiguousarray(flat[:, k]).tobytes() for k in range(3)]]
    first = rows.iloc[0]
    return pd.DataFrame([[int(first["block"]), int(first["home"]), first["grp"], float(q2.min()), float(q2.max()), far.min(0).tolist(), far.max(0).tolist(), int(flat[:, 1].min()), int(flat[:, 2].max()), *parts]], columns=[c.split()[0] for c in BLOCKS.split(", ")])


HITS = "anchor long, about long, id long, score long"
_HITS_PA = pa.schema([(c.split()[0], pa.int64()) for c in HITS.split(", ")])


def survivors(q2: np.ndarray, dq: np.ndarray, dx: np.ndarray, cut: np.ndarray, top: np.ndarray, most: float) -> np.ndarray:
    """``(queries, rows)``: whether the brackets leave a score between a query's ``cut`` and ``top`` possible."""
    n, m = len(dq), len(dx)
    starts = np.arange(0, m, TILE)
    low, high = np.minimum.reduceat(dx, starts), np.maximum.reduceat(dx, starts)
    apart = np.maximum(dq[:, None, :] - high[None], low[None] - dq[:, None, :]).max(2)
    least, largest = bracket(np.maximum(apart, 0), (dq[:, None, :] + high[None]).min(2), q2[:, None], most)
    tiles = (largest >= cut[:, None]) & (least <= top[:, None])
    out = np.zeros((n, m), dtype=bool)
    rows, cols = tiles.any(1), np.repeat(tiles.any(0), TILE)[:m]
    if not rows.any():
        return out
    a, b = dq[rows], dx[cols]
    low, high = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.inf)
    for p in range(a.shape[1]):
        np.maximum(low, np.abs(a[:, p, None] - b[None, :, p]), out=low)
        np.minimum(high, a[:, p, None] + b[None, :, p], out=high)
    least, largest = bracket(low, high, q2[rows][:, None], most)
    out[np.ix_(rows, cols)] = (largest >= cut[rows][:, None]) & (least <= top[rows][:, None])
    return out & np.repeat(tiles, TILE, axis=1)[:, :m]


def scores(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products: sums of products stay below ``most``, which a double holds exactly up to 2^53."""
    return (q @ x.T).astype(np.int64) if most < _EXACT else q.astype(np.int64) @ x.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``k`` largest scores above ``_LEAST``, ties to smaller ids."""
    rows = np.flatnonzero(score.max(1, initial=_LEAST) > _LEAST)
    if not len(rows):
        return rows, rows
    s = score[rows]
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), _LEAST)
    r, c = np.nonzero((s >= kth[:, None]) & (s > _LEAST))
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    begin = np.searchsorted(r, r)
    keep = np.arange(len(r)) - begin < k
    return rows[r[keep]], c[keep]


def _visits(same: bool, k: int, most: float, pivots: int):
    """For each block and shard, of each target the ``k`` best rows of the shard that it may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        of = lambda r, name, kind="<i8": np.frombuffer(r[name], dtype=kind)
        for b in batches:
            for r in b.to_pylist():
                ids, labels, s_ids, s_labels = of(r, "ids"), of(r, "labels"), of(r, "s_ids"), of(r, "s_labels")
                q, x = of(r, "vectors", "<f8").reshape(len(ids), -1), of(r, "s_vectors", "<f8").reshape(len(s_ids), -1)
                dq, dx = of(r, "far", "<f8").reshape(-1, pivots), of(r, "s_far", "<f8").reshape(-1, pivots)
                owner, about, cut, top = of(r, "owner", "<i4"), of(r, "about"), of(r, "cut"), of(r, "top")
                q2 = (q * q).sum(1)
                least, largest = np.full(len(ids), _MOST), np.full(len(ids), _LEAST)
                np.minimum.at(least, owner, cut)
                np.maximum.at(largest, owner, top)
                for lo in range(0, len(ids), STEP):
                    part = slice(lo, lo + STEP)
                    open_ = survivors(q2[part], dq[part], dx, least[part], largest[part], most)
                    open_ &= ((labels[part, None] == s_labels) == same) & (ids[part, None] != s_ids)
                    cols = np.flatnonzero(open_.any(0))
                    t = np.flatnonzero((owner >= lo) & (owner < lo + STEP))
                    if not len(cols) or not len(t):
                        continue
                    found = np.where(open_[:, cols], scores(q[part], x[cols], most), _LEAST)
                    found = found[owner[t] - lo]
                    found = np.where((found >= cut[t, None]) & (found <= top[t, None]), found, _LEAST)
                    at, col = best(found, s_ids[cols], k)
                    if len(at):
                        made = (ids[owner[t[at]]], about[t[at]], s_ids[cols][col], found[at, col])
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], schema=_HITS_PA)

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    """Each target's ``k`` best, with ``rank`` from 1."""
    rank = F.row_number().over(W.partitionBy("anchor", "about").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


class Pivots:
    """The pivot table of a set of rows, and searches in it; its tables are written."""

    def __init__(self, rows: DataFrame, keep: int, shard_rows: int | None = None):
        """``rows(id, label, vec)``; ``keep`` equal vectors of a label stay at most."""
        spark = self.spark = rows.sparkSession
        bound_batches(spark)
        facts = rows.agg(F.max("norm").alias("most"), F.max(F.size("vec")).alias("width")).first()
        self.most, width = float(facts["most"]), facts["width"]
        self.shard_rows = shard_rows or max(256, min(SHARD_ROWS, SHARD_BYTES // (8 * width)))
        again = W.partitionBy("label", "vec").orderBy("id")
        kept = rows.withColumn("r", F.dense_rank().over(again)).where(F.col("r") <= keep).select("id", "label", "vec").dropDuplicates(["id", "label", "vec"])
        sample = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
        self.pivots = spread_out(np.array([r["vec"] for r in sample], dtype=np.float64), self.most, PIVOTS)
        self.count = len(self.pivots)
        far = "id long, label long, vec array<double>, far array<double>, nearest int"
        measured = durable(kept.mapInArrow(_measured(self.pivots, self.most, False), far), "measured")
        self.groups, self.plan = self._planned(measured)
        # a hot label or cell is a skewed key of a join of written tables, which Spark splits
        dealt = measured.join(self.plan, ["label", "nearest"])
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        named = durable(dealt.groupBy("grp", "cell", "part").agg(F.count(F.lit(1)).alias("held")), "cells")
        number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("grp", "cell", "part")) - 1
        # one row a shard, which has thousands of rows
        self.numbers = durable(named.withColumn("shard", number.cast("int")), "shards")
        self.shards = self.numbers.count()
        placed = dealt.join(self.numbers, ["grp", "cell", "part"]).select("shard", "grp", "id", "label", "vec", "far")
        self.table = durable(placed.repartition(max(1, min(2 * self.shards, 4000)), "shard").groupBy("shard").applyInPandas(_shard, TABLE), "pivot-table")
        discard(spark, measured, named)

    def _planned(self, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``label -> grp`` and ``label, nearest -> grp, cell, parts``: small labels share groups, the cells of a large label
        are cut into parts."""
        counts = durable(measured.groupBy("label", "nearest").agg(F.count(F.lit(1)).alias("n")), "counts")
        labels = counts.groupBy("label").agg(F.sum("n").alias("held"))
        small = labels.where(F.col("held") <= self.shard_rows).agg(F.sum("held").alias("s")).first()["s"] or 0
        shared = max(1, -(-2 * small // self.shard_rows))
        large = F.col("held") > self.shard_rows
        grp = F.when(large, F.concat(F.lit("l"), F.col("label"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(shared))))
        groups = durable(labels.select("label", grp.alias("grp"), large.alias("large")), "groups")
        parts = F.when(F.col("large"), F.ceil(F.col("n") / self.shard_rows)).otherwise(1).cast("int").alias("parts")
        plan = durable(counts.join(groups, "label").select("label", "nearest", "grp", F.when(F.col("large"), F.col("nearest")).otherwise(-1).alias("cell"), parts), "plan")
        discard(self.spark, counts)
        return groups, plan

    def anchors(self, rows: DataFrame) -> DataFrame:
        """``rows(id, label, vec)`` with the distances they ask with and the block they are in; a written table."""
        both = "id long, label long, vec array<double>, far array<double>, nearest int"
        lying = rows.mapInArrow(_measured(self.pivots, self.most, False), both).select("id", "label", "vec", "nearest")
        # copies of the anchor's vector may be what lies in a part, so its own may hold none
        own = self.plan.select("label", "nearest", "cell", "parts")
        placed = lying.join(self.groups.select("label", "grp"), "label").join(own, ["label", "nearest"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        homes = placed.join(self.numbers.select("grp", "cell", "part", "shard"), ["grp", "cell", "part"], "left")
        any_home = self.numbers.groupBy("grp").agg(F.min("shard").alias("any"))
        homes = homes.join(any_home, "grp").select("id", "label", "vec", "grp", F.coalesce("shard", "any").alias("home"))
        homes = durable(homes, "homes")
        sizes = durable(homes.groupBy("home").agg(F.count(F.lit(1)).alias("asking")), "sizes")
        cut = homes.join(sizes, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.ceil(F.col("asking") / BLOCK))))
        asked = "home int, id long, label long, vec array<double>, grp string, block long, far array<double>, nearest int"
        return durable(cut.select("home", "id", "label", "vec", "grp", "block").mapInArrow(_measured(self.pivots, self.most, True), asked), "anchors")

    def _packed(self, anchors: DataFrame, targets: DataFrame) -> DataFrame:
        """Blocks of the anchors that have a target in ``targets(anchor, about, cut, top)``."""
        lists = targets.groupBy("anchor").agg(F.collect_list(F.struct("about", "cut", "top")).alias("targets"))
        met = anchors.join(lists.withColumnRenamed("anchor", "id"), "id").select("block", "home", "grp", "id", "label", "vec", "far", "targets")
        return durable(met.groupBy("block").applyInPandas(_block, BLOCKS), "blocks")

    def _pairs(self, blocks: DataFrame, same: bool) -> DataFrame:
        """``block, shard, home, largest`` of blocks and shards between whose scores the brackets leave a target possible."""
        sides = blocks.select("block", "home", F.col("grp").alias("q_grp"), "q_low", "q_high", F.col("low").alias("q_from"), F.col("high").alias("q_to"), "from_score", "to_score")
        known = self.table.select("shard", "grp", "low", "high")
        if same:
            met = sides.join(known, sides["q_grp"] == known["grp"])
        else:
            # every block is held against every shard, by their boxes alone
            met = sides.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1)))).join(known, "shard")
            met = met.where((F.col("q_grp") != F.col("grp")) | ~F.col("grp").startswith("l"))
        apart = F.array_max(F.zip_with(F.zip_with("q_from", "high", lambda a, b: a - b), F.zip_with("low", "q_to", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
        within = F.array_min(F.zip_with("q_to", "high", lambda a, b: a + b))
        most = F.lit(self.most)
        slack = F.sqrt(F.col("q_high") + most) * 1e-6 + 1e-6
        wide = (F.col("q_high") + most) * 1e-9 + 1
        near = F.greatest(apart - slack, F.lit(0.0))
        largest = (F.col("q_high") + most - near * near) / 2 + wide
        least = (F.col("q_low") + most - (within + slack) * (within + slack)) / 2 - wide
        return met.withColumn("largest", largest).where((F.col("largest") >= F.col("from_score")) & (least <= F.col("to_score"))).select("block", "shard", "home", F.least("largest", F.col("to_score").cast("double")).alias("largest"))

    def _visited(self, blocks: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
        stored = self.table.select("shard", *[F.col(c).alias(f"s_{c}") for c in ("ids", "labels", "vectors", "far")])
        payload = blocks.select("block", "ids", "labels", "vectors", "far", "owner", "about", "cut", "top")
        met = pairs.select("block", "shard").join(payload, "block").repartition(max(1, min(2 * self.shards, 4000)), "shard").join(stored, "shard")
        return durable(met.drop("block", "shard").mapInArrow(_visits(same, k, self.most, self.count), HITS), "hits")

    def search(self, anchors: DataFrame, targets: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor, about, id, score, rank``: each target's ``k`` best among rows of its anchor's label, or of others; written."""
        blocks = self._packed(anchors, targets)
        pairs = durable(self._pairs(blocks, same), "pairs")
        order = W.partitionBy("block").orderBy((F.col("shard") == F.col("home")).desc(), F.desc("largest"), "shard")
        first = durable(pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("block", "shard"), "first-pairs")
        found = self._visited(blocks, first, same, k)
        bounds = _first(found, k).where(F.col("rank") == k).select("anchor", "about", F.col("score").alias("bound"))
        sharper = targets.join(bounds, ["anchor", "about"], "left").select("anchor", "about", F.greatest("cut", F.coalesce("bound", "cut")).alias("cut"), "top")
        again = self._packed(anchors, sharper)
        rest = self._pairs(again, same).join(first, ["block", "shard"], "left_anti")
        more = self._visited(again, rest, same, k)
        out = durable(_first(found.unionByName(more), k), "best")
        discard(self.spark, blocks, pairs, first, found, again, more)
        return out

    def drop(self) -> None:
        discard(self.spark, self.groups, self.plan, self.numbers, self.table)


def hard_negatives(df: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``asks`` holds (an
    expression of the id column): of each of their first ``positives`` rows of the same label, the first ``negatives`` rows
    of another label that score from ``low`` to ``high`` percent of it. A written table."""
    spark = df.sparkSession
    bound_batches(spark)
    known = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col).cast("array<double>"))
    rows = df.where(known).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(F.col(vector_col), scale).alias("vec"), asks.alias("asks"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    rows = durable(rows.withColumn("norm", norm).where(F.col("norm") < _FITS), "vectors")
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not widths:
        return spark.createDataFrame([], empty)
    alike = rows.where(F.size("vec") == widths[0]["w"])
    pivots = Pivots(alike, max(positives, negatives) + 1, shard_rows)
    asking = alike.where("asks").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.label", "m.vec")
    anchors = pivots.anchors(asking)
    any_ = anchors.select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("about"), F.lit(_LEAST + 1).alias("cut"), F.lit(_MOST).alias("top"))
    near = pivots.search(anchors, any_, True, positives)
    # percentages of a long without overflow
    s = F.col("score")
    cut, top = F.expr(f"(score div 100) * {low} + ((score % 100) * {low} + 99) div 100"), F.expr(f"(score div 100) * {high} + ((score % 100) * {high}) div 100")
    # a target is named by its positive's rank, as ids may repeat
    bands = near.where(s >= 0).select("anchor", F.col("rank").cast("long").alias("about"), cut.alias("cut"), top.alias("top"), F.col("id").alias("positive_id"), s.alias("positive_score"))
    bands = durable(bands.where("cut <= top"), "bands")
    if bands.isEmpty():
        return spark.createDataFrame([], empty)
    hard = pivots.search(anchors, bands.select("anchor", "about", "cut", "top"), False, negatives)
    out = hard.join(bands, ["anchor", "about"])
    out = durable(out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    pivots.drop()
    discard(spark, rows, anchors, near, bands, hard)
    return out
