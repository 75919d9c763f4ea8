"""Search: exact top-k by cosine, an inverted index with BM25, and rank fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import vector
from palimpsest.sources.durable import Written

K1, B, FUSION = 1.2, 0.75, 60


def top_k(vectors: DataFrame, query: Column, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors with the largest inner product; one heap of k rows a task, merged."""
    return vectors.select(id_col, vector.dot(F.col(vector_col), query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Bytes of vectors that a shard holds about, queries of a block, queries multiplied in one step.
SHARD_BYTES, ASKED, STEP = 8 << 20, 1024, 256


def _packed(rows: DataFrame, part: str, parts: int, id_col: str, vector_col: str) -> DataFrame:
    """A row for each part: its ids, and its vectors as one flat array of doubles."""
    dealt = rows.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias(part), F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("r"))
    return dealt.groupBy(part).agg(F.collect_list("r").alias("r")).select(part, F.col("r.id").alias(f"{part}_ids"), F.flatten("r.v").alias(f"{part}_flat"))


def _best_of(k: int, width: int):
    """For each block of queries and shard of vectors, the k best of each query; the product is made in steps of ``STEP`` queries."""
    import numpy as np
    import pandas as pd

    def run(pairs):
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for names, asked, ids, flat in zip(pairs["block_ids"], pairs["block_flat"], pairs["shard_ids"], pairs["shard_flat"], strict=True):
            names, ids = np.asarray(names), np.asarray(ids)
            q, v = np.asarray(asked, dtype=np.float64).reshape(-1, width), np.asarray(flat, dtype=np.float64).reshape(-1, width)
            for lo in range(0, len(q), STEP):
                s = q[lo : lo + STEP] @ v.T
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                r, c = np.nonzero(s >= kth[:, None])
                # of equal scores the smaller id, so those at the k-th are all looked at
                order = np.lexsort((ids[c], -s[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                found.append(pd.DataFrame({"query_id": names[lo + r[keep]], "vec_id": ids[c[keep]], "score": s[r[keep], c[keep]]}))
        return pd.concat(found[1:] or found)

    return run


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``queries(query_id, query)``: the k nearest of each by inner product, exactly: ``query_id, vec_id, score, rank``.

    Vectors are packed into shards and queries into blocks, every block meets every shard in a join by shard, and a task holds
    one of each (a group is one pair, so that Python never holds a batch of pairs): what is shuffled is the vectors once, the queries once a shard, and k rows a query and shard. Nothing but two
    counts comes to the driver. Vectors of another width than the queries' widest take no part; nor do null ones."""
    asked = queries.where(F.col("query").isNotNull()).select("query_id", "query")
    known = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("width")).first()
    width = size["width"] or 0
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    if not width:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    known, asked = known.where(F.size(vector_col) == width), asked.where(F.size("query") == width)
    shards = max(1, -(-known.count() * width * 8 // SHARD_BYTES))
    held = _packed(known, "shard", shards, id_col, vector_col)
    blocks = _packed(asked, "block", max(1, -(-size["n"] // ASKED)), "query_id", "query")
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = sent.join(held, "shard").groupBy("shard", "block").applyInPandas(_best_of(k, width), schema)
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", r).where(F.col("rank") <= k)


def terms_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t, length`` of the documents' terms."""
    return docs.select(F.col(id_col).alias("doc_id"), terms_of(F.col(text_col)).alias("t")).withColumn("length", F.size("t"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms: the runs of the sorted array, so a document is counted within its row."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda x: F.transform(x["b"], lambda i, j: F.struct(F.get(x["s"], i).alias("term"), (F.coalesce(F.get(x["b"], j + 1), F.size(x["s"])) - i).cast("long").alias("tf")))
    some = bound(F.sort_array(terms), lambda s: bound(F.struct(s.alias("s"), begins(s).alias("b")), runs))
    return F.when(F.size(terms) > 0, some).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _terms(docs, id_col, text_col).select("doc_id", "length")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """``doc_id, term, tf, length``: the inverted index of a text column; ``only(term)`` limits it to these terms, before anything is
    shuffled."""
    rows = _terms(docs, id_col, text_col).select("doc_id", "length", F.inline(counted(F.col("t"))))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    if not ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # rows of one id and length count as one document
        return rows.groupBy("doc_id", "length", "term").agg(F.sum("tf").alias("tf"))
    return rows.select("doc_id", "length", "term", "tf")


def refreshed(index: DataFrame, docs: DataFrame, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An index after rows changed: their old postings go, their new ones come."""
    ids = changed.select(F.col(id_col).alias("doc_id")).distinct()
    return index.join(ids, "doc_id", "left_anti").unionByName(postings(docs.join(ids.withColumnRenamed("doc_id", id_col), id_col, "left_semi"), id_col, text_col))


def wanted(queries: DataFrame) -> DataFrame:
    """``query_id, term`` of ``queries(query_id, terms array)``."""
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """BM25 without a stored index, in one pass over the texts: a document's length and its counts of the queries' terms come from one
    cut into terms, and are written; the corpus counts are aggregates of that."""
    asked = wanted(queries)
    terms = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        return bm25(postings(docs, id_col, text_col, asked), queries, k, lengths(docs, id_col, text_col).where("length > 0"))
    work = Written(docs.sparkSession)
    hits = F.filter("t", lambda t: t.isin(terms))
    rows = work.table(_terms(docs, id_col, text_col).where("length > 0").select("doc_id", "length", hits.alias("t")), "terms")
    index = rows.select("doc_id", "length", F.explode("t").alias("term")).groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = bm25(index, queries, k, rows)
    work.drop()
    return found


#: Terms of all queries together up to which they are literals of the plan.
MOST_TERMS = 1000


def bm25(index: DataFrame, queries: DataFrame, k: int = 10, sizes: DataFrame | None = None) -> DataFrame:
    """``queries(query_id, terms array)`` against an index: ``query_id, doc_id, score, rank``. The index is filtered by the queries'
    terms before anything else is joined to it, and those postings are written: document frequencies and scores are read
    from there. The corpus counts are one aggregate over ``sizes(doc_id, length)`` of all documents, if given, else over the
    index. The result is written, and what was written on the way to it is deleted."""
    asked = wanted(queries)
    every = index.select("doc_id", "length").distinct() if sizes is None else sizes
    totals = every.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    work = Written(index.sparkSession)
    hit = work.table(index.join(asked.select("term").distinct(), "term", "left_semi").select("doc_id", "length", "term", "tf"), "postings")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    one = F.lit(1).alias("__one")
    # one row, broadcast
    weighed = hit.join(df, "term").select("*", one).join(F.broadcast(totals.select("*", one)), "__one").select("doc_id", "term", (idf * tf).alias("w"))
    scores = weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    found = work.table(scores.withColumn("rank", r).where(F.col("rank") <= k), "ranking")
    work.drop(keep=1)
    return found


def fused(*rankings: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, doc_id, rank)`` lists."""
    rows = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "doc_id", "rank"))
    s = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))
    w = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id"))
    return s.withColumn("rank", w).where(F.col("rank") <= k)
