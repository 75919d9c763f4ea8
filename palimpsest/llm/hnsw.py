"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt to cells by their nearest centre (found by k-means on at most ``SAMPLE`` of them), and a cell's vectors by a
hash of the id to as many shards of about ``SHARD_ROWS`` as it needs; each shard's graph is built in one task and stored as one
row of flat arrays (vectors, ids, and per level a neighbour array of fixed width), so an index is a small table that
outlives its builder. A query visits the shards of its ``PROBES`` nearest cells, all of them while there are no more, and the
shards' results are merged by exact score. So a shard never grows, and a query's work is bounded by its cells, of which
there are at most ``CELLS``; only from ``CELLS`` times ``SHARD_ROWS`` vectors on does it grow with the table, by a share of
``PROBES`` in ``CELLS``.

Within a shard, equal vectors are one graph node; its ids are listed from the smallest up, and of a node as many ids as a
result can hold are returned, so copies neither disturb the graph nor get lost. Insertion and search work on blocks of
points in lockstep: every step expands the best open candidate of each point at once.

Scores are cosines of the original vectors in double precision, computed alike for equal vectors. Vectors whose squares
would leave the range of a double are first divided by a power of two, which changes no digit of a cosine.

Defined cases: vectors that are null, zero, of another width than most, or that hold null or non-finite components take
no part, neither as queries nor as candidates; ties go to the smaller id; repeated ids are candidates of their own but
ask once, with the smallest of their vectors, and never answer themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palimpsest.llm.common import bound_batches, discard, durable, lean

#: Neighbours kept per node (twice as many on the ground level), breadth of the search when inserting and when asked.
NEIGHBOURS, BUILD_BREADTH, SEARCH_BREADTH = 16, 80, 160
#: Vectors a shard holds about, cells at most, cells a query visits, vectors that centres are found from; queries of a block.
SHARD_ROWS, CELLS, PROBES, SAMPLE, QUERY_BLOCK = 6000, 1024, 24, 16_384, 512
_INSERT_BLOCK = 128


@dataclass
class Graph:
    """``levels[l]`` is an int32 array ``(nodes, width)`` of neighbours, -1 where there is none."""

    unit: np.ndarray
    levels: list[np.ndarray]
    entry: int
    top: int


def _beam(g: Graph, level: int, q: np.ndarray, starts: np.ndarray, breadth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``breadth`` nearest nodes found for each row of ``q`` on a level, best first, among nodes below ``limit``;
    -1 and -inf where there are fewer."""
    n, links = len(q), g.levels[level]
    lines = np.arange(n)[:, None]
    seen = np.zeros((n, limit + 1), dtype=bool)  # the last column stands for "none"
    ids = np.full((n, breadth), -1, dtype=np.int32)
    near = np.full((n, breadth), -np.inf, dtype=np.float32)
    width = starts.shape[1]
    ids[:, :width] = starts
    near[:, :width] = np.where(starts >= 0, np.einsum("nwd,nd->nw", g.unit[starts], q), -np.inf)
    seen[lines, starts] = True
    open_ = ids >= 0
    while True:
        score = np.where(open_, near, -np.inf)
        pick = score.argmax(1)
        live = np.flatnonzero(score[np.arange(n), pick] > -np.inf)
        if not len(live):
            break
        node = ids[live, pick[live]]
        open_[live, pick[live]] = False
        cand = links[node]
        cand = np.where(cand < limit, cand, -1)
        fresh = ~seen[live[:, None], cand] & (cand >= 0)
        seen[live[:, None], cand] = True
        sims = np.einsum("nwd,nd->nw", g.unit[cand], q[live])
        sims = np.where(fresh, sims, -np.inf)
        useful = np.flatnonzero((sims > near[live].min(1)[:, None]).any(1))
        if not len(useful):
            continue
        rows = live[useful]
        all_near = np.concatenate([near[rows], sims[useful]], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(fresh, cand, -1)[useful]], axis=1)
        all_open = np.concatenate([open_[rows], fresh[useful]], axis=1)
        best = np.argpartition(-all_near, breadth - 1, axis=1)[:, :breadth]
        near[rows] = np.take_along_axis(all_near, best, 1)
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        open_[rows] = np.take_along_axis(all_open, best, 1) & (ids[rows] >= 0)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _spread(unit: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates sorted best first, those nearer to the point than to any already kept, then the next best."""
    own = unit[cand] @ unit[cand].T
    chosen: list[int] = []
    for k in range(len(cand)):
        if len(chosen) == keep:
            break
        if not chosen or (own[k, chosen] < sims[k]).all():
            chosen.append(k)
    if len(chosen) < keep:
        taken = set(chosen)
        chosen += [k for k in range(len(cand)) if k not in taken][: keep - len(chosen)]
    return cand[chosen]


def build(vectors: np.ndarray, neighbours: int = NEIGHBOURS, breadth: int = BUILD_BREADTH) -> tuple[Graph, np.ndarray]:
    """A graph over distinct, non-zero vectors, and the vector's number of each of its nodes."""
    n = len(vectors)
    unit = _unit(vectors)
    draw = np.random.default_rng(n).random(n)
    height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(neighbours)).astype(int)
    height = np.minimum(height, 8)
    order = np.argsort(-height, kind="stable")  # upper levels first: the entry point never changes
    unit, height = unit[order], height[order]
    top = int(height[0]) if n else 0
    levels = [np.full((n, neighbours * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(top + 1)]
    g = Graph(unit, levels, 0, top)
    degree = [np.zeros(n, dtype=np.int32) for _ in levels]

    def link(level: int, a: int, b: int) -> None:
        links, d = levels[level], degree[level]
        if d[a] < links.shape[1]:
            links[a, d[a]] = b
            d[a] += 1
            return
        cand = np.append(links[a], np.int32(b))
        sims = unit[cand] @ unit[a]
        best = np.argsort(-sims, kind="stable")
        links[a] = _spread(unit, cand[best], sims[best], links.shape[1])

    done, block = min(n, 1), 1
    while done < n:
        block = min(_INSERT_BLOCK, max(1, done // 4), n - done)
        points = np.arange(done, done + block)
        starts = np.zeros((block, 1), dtype=np.int32)
        for level in range(top, -1, -1):
            here = height[points] >= level
            wide = breadth if here.any() else 1
            ids, sims = _beam(g, level, unit[points], starts, max(wide, starts.shape[1]), done)
            for p in np.flatnonzero(here):
                # the block's own points, and the graph's
                own = np.flatnonzero(height[points[:p]] >= level)
                mine = np.concatenate([ids[p][ids[p] >= 0], points[own].astype(np.int32)])
                near = unit[mine] @ unit[points[p]]
                best = np.argsort(-near, kind="stable")[:breadth]
                for x in _spread(unit, mine[best], near[best], neighbours):
                    link(level, int(points[p]), int(x))
                    link(level, int(x), int(points[p]))
            starts = ids[:, : max(1, min(8, ids.shape[1]))].copy()
            starts[:, 0] = np.maximum(starts[:, 0], 0)
        done += block
    return g, order


def search(g: Graph, queries: np.ndarray, k: int, breadth: int = SEARCH_BREADTH) -> np.ndarray:
    """``(queries, k)`` nodes of the graph, nearest first as far as found, -1 where there are fewer."""
    n = len(g.unit)
    starts = np.zeros((len(queries), 1), dtype=np.int32)
    for level in range(g.top, 0, -1):
        ids, _ = _beam(g, level, queries, starts, 4, n)
        starts = ids
    ids, _ = _beam(g, 0, queries, starts, max(breadth, k, starts.shape[1]), n)
    return ids[:, :k]


INDEX = "shard int, cell int, centre binary, width int, top int, item int, counts binary, ids binary, vectors binary, links binary"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares may over- or underflow, divided by the power of two next to their largest component."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    far = (most > 1e100) | ((most < 1e-100) & (most > 0))
    if far.any():
        vectors = vectors.copy()
        vectors[far] = np.ldexp(vectors[far], -np.frexp(most[far])[1][:, None])
    return vectors


def centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors in the middle of ``count`` groups of unit vectors, or of fewer, if there are not so many distinct ones."""
    distinct = np.unique(vectors, axis=0)
    out = distinct[np.random.default_rng(len(distinct)).permutation(len(distinct))[:count]].astype(np.float32)
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1)
        out = np.where((norm > 1e-6)[:, None], sums / np.maximum(norm, 1e-6)[:, None], out)
    return out


def _nearest_cells(middle: np.ndarray, count: int):
    """The ``count`` nearest cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if b.num_rows:
                v = _unit(scaled(np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)))
                near = np.argsort(-(v @ middle.T), axis=1, kind="stable")[:, :count].astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, "cells"])

    return run


_CELLED = "vec_id long, embedding array<double>, cells array<int>"


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _pack(shard: int, cell: int, centre: bytes, ids: np.ndarray, vectors: np.ndarray, item: int) -> tuple:
    """A row of ``INDEX``; components take ``item`` bytes, 4 where the source has single precision, which is then exact."""
    distinct, back = np.unique(vectors, axis=0, return_inverse=True)
    g, order = build(distinct)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    node = place[back.reshape(-1)]
    by = np.lexsort((ids, node))
    counts = np.bincount(node, minlength=len(distinct))
    return shard, cell, centre, vectors.shape[1], g.top, item, counts.astype("<i8").tobytes(), ids[by].astype("<i8").tobytes(), distinct[order].astype(f"<f{item}").tobytes(), b"".join(x.tobytes() for x in g.levels)


def _index(item: int, middle: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = scaled(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        cell = int(rows["cell"].iloc[0])
        packed = _pack(int(rows["shard"].iloc[0]), cell, middle[cell].astype("<f4").tobytes(), rows["vec_id"].to_numpy(dtype=np.int64), vectors, item)
        return pd.DataFrame([packed], columns=[c.split()[0] for c in INDEX.split(", ")])

    return run


def usable(embedding: Column) -> Column:
    """Not null, with a component other than 0, and all of them finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all usable vectors, a written table with a row for each shard."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], INDEX)
    width, total = widths[0]["w"], widths[0]["count"]
    alike = rows.where(F.size("embedding") == width)
    cells = max(1, min(round(total / shard_rows), CELLS))
    sample = alike.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(min(SAMPLE, 64 * cells)).select("embedding").collect()
    middle = centres(_unit(scaled(np.array([r["embedding"] for r in sample], dtype=np.float64))), cells)
    dealt = durable(alike.mapInArrow(_nearest_cells(middle, 1), _CELLED).select("vec_id", "embedding", F.col("cells")[0].alias("cell")), "celled")
    # at most ``CELLS`` counts, from which shards are numbered
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    first, plan = 0, []
    for cell in sorted(counts):
        parts = max(1, round(counts[cell] / shard_rows))
        plan.append((cell, first, parts))
        first += parts
    placed = dealt.join(F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int")), "cell")
    placed = placed.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("vec_id", "embedding", "cell", "shard")
    item = 4 if df.schema[vector_col].dataType == T.ArrayType(T.FloatType(), df.schema[vector_col].dataType.containsNull) else 8
    # the number of partitions is given: adaptive execution would put several shards, which are small, into one task
    index = durable(placed.repartition(4 * first, "shard").groupBy("shard").applyInPandas(_index(item, middle), INDEX), "hnsw")
    discard(spark, dealt)
    return index


FOUND = "query_id long, vec_id long, score double"
_FOUND_PA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _answers(k: int, breadth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for r in b.to_pylist():
                width = r["width"]
                vectors = np.frombuffer(r["vectors"], dtype=f"<f{r['item']}").astype(np.float64).reshape(-1, width)
                unit = _unit(vectors)
                counts, ids = np.frombuffer(r["counts"], dtype="<i8"), np.frombuffer(r["ids"], dtype="<i8")
                first = np.concatenate([[0], np.cumsum(counts)])
                flat, n = np.frombuffer(r["links"], dtype=np.int32), len(unit)
                levels, at = [], 0
                for level in range(r["top"] + 1):
                    wide = NEIGHBOURS * (2 if level == 0 else 1)
                    levels.append(flat[at : at + n * wide].reshape(n, wide))
                    at += n * wide
                g = Graph(unit, levels, 0, r["top"])
                query_ids = np.frombuffer(r["query_ids"], dtype="<i8")
                queries = np.frombuffer(r["queries"], dtype="<f8").reshape(-1, width)
                norm = np.sqrt((vectors * vectors).sum(1))
                asked = (queries / np.sqrt((queries * queries).sum(1))[:, None]).astype(np.float32)
                nodes = search(g, asked, min(n, 4 * k + 8), min(breadth, n))
                out: list[tuple[int, int, float]] = []
                for q, q_id, found in zip(queries, query_ids.tolist(), nodes, strict=True):
                    found = found[found >= 0]
                    v = vectors[found]
                    score = (v * q).sum(1) / (norm[found] * np.sqrt((q * q).sum()))
                    hits = [(-s, i) for s, node in zip(score.tolist(), found.tolist(), strict=True) for i in _others(ids, first, node, q_id, k)]
                    out += [(q_id, i, -s) for s, i in sorted(hits)[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND_PA, strict=True)], schema=_FOUND_PA)

    return run


def _others(ids: np.ndarray, first: np.ndarray, node: int, own: int, k: int) -> list[int]:
    """The k smallest ids of a node, the query's own left out."""
    out = []
    for i in range(first[node], first[node + 1]):
        if ids[i] != own:
            out.append(int(ids[i]))
            if len(out) == k:
                break
    return out


def _blocked(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "query_ids": [rows["vec_id"].to_numpy(dtype="<i8").tobytes()], "queries": [scaled(np.stack(rows["embedding"].to_numpy()).astype(np.float64)).astype("<f8").tobytes()]})


def nearest(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, breadth: int = SEARCH_BREADTH, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each usable query, its own id left out."""
    spark = index.sparkSession
    bound_batches(spark)
    # a centre for each cell, of which there are at most ``CELLS``
    known = index.groupBy("cell").agg(F.first("centre").alias("centre"), F.first("width").alias("width"), F.count(F.lit(1)).alias("shards")).collect()
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    names = np.array([r["cell"] for r in known], dtype=np.int32)
    middle, width, shards = np.stack([np.frombuffer(r["centre"], dtype="<f4") for r in known]), known[0]["width"], sum(r["shards"] for r in known)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    asked = asked.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.size("embedding") == width))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    near = asked.mapInArrow(_nearest_cells(middle, min(probes, len(names))), _CELLED)
    number = spark.createDataFrame([(i, int(c)) for i, c in enumerate(names)], "place int, cell int")
    of = index.select("cell", "shard").join(number, "cell").select("place", "shard")
    sent = durable(near.select("vec_id", "embedding", F.explode("cells").alias("place")).join(of, "place").select("shard", "vec_id", "embedding"), "asked")
    sizes = sent.groupBy("shard").agg(F.count(F.lit(1)).alias("asking"))
    cut = sent.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("asking") / QUERY_BLOCK)))
    packed = cut.groupBy("shard", "block").applyInPandas(_blocked, "shard int, query_ids binary, queries binary")
    parts = max(1, min(2 * shards, 2000))
    met = packed.repartition(parts, "shard").join(index.repartition(parts, "shard"), "shard")
    found = met.mapInArrow(_answers(k, breadth), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
