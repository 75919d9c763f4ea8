"""A maintained inverted index: postings in segments, one for each commit, with tombstones, tiered merging and block maxima.

A segment is three tables: ``docs`` (a document, its length and its terms with counts), ``terms`` (document frequencies) and
``blocks``: the postings of a term, most telling first, cut into blocks of ``BLOCK``; for each count in a block the least length
of its documents is kept, from which follows the most that any of them can score, whatever the mean length is by then. A term in very many documents is
dealt to as many parts as its frequency asks for, so no task sorts more than ``PART`` postings of one.

Adding a document that is there already replaces it. What is replaced or deleted is listed: its segment, its length, and how
often its terms occur less. So counts and frequencies of the live documents are sums over short tables, and scores equal
those of an index made anew. When ``FAN`` segments of a level have come together they are merged into one of the next, in
which the dead are left out. A manifest names the segments, and the lists of the dead, that count; it is written last.

``search`` takes two steps. The first block of each term and segment gives every query scores that its k-th best document
reaches at least. A block whose most, with the most that the query's other terms can add in that segment, is below that
is skipped: no document in it can be among the k best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.operators.search import B, K1, bound, counted, terms_of, wanted
from palimpsest.sources.durable import Written, delete

BLOCK, PART, FAN = 128, 100_000, 4

DOCS = "doc_id long, length int, terms array<struct<term:string,tf:int>>"
TERMS = "term string, df long"
BLOCKS = "term string, part int, block int, corners array<struct<tf:int,length:int>>, postings array<struct<doc_id:long,tf:int,length:int>>"
DEAD = "segment string, doc_id long, length int"
LOST = "segment string, term string, n long"
MANIFEST = "kind string, name string, level int, docs long, length long"


def weight(tf: Column, length: Column, mean: Column) -> Column:
    """How much a term's count in a document of some length tells; more for a larger count and a shorter document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


#: Whether lists are collected in a map of objects, which Spark's memory manager does not see, before rows are sorted.
HASHED = "spark.sql.execution.useObjectHashAggregateExec"


@contextmanager
def sorted_groups(spark: SparkSession) -> Iterator[None]:
    """What is written in here collects lists from sorted rows: the sort spills, and a task holds the list of one group at a time."""
    before = spark.conf.get(HASHED, None)
    spark.conf.set(HASHED, "false")
    try:
        yield
    finally:
        spark.conf.unset(HASHED) if before is None else spark.conf.set(HASHED, before)


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, block: int = BLOCK, part: int = PART) -> None:
        self.spark, self.path, self.fan, self.block, self.part = spark, path.rstrip("/"), fan, block, part

    # storage

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, schema: str, folders: list[str], tagged: bool = False) -> DataFrame:
        """Tables of several folders as one; ``tagged`` with the segment each row is from."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumn("segment", F.regexp_extract(F.input_file_name(), r"/(seg-[0-9a-f]+)/", 1)) if tagged else rows

    def manifest(self) -> list[dict]:
        """The segments and lists that count, and their sizes: a few rows, as segments are merged."""
        if not self._exists("manifests"):
            return []
        last = self.spark.read.schema("n long, name string").parquet(f"{self.path}/manifests").orderBy(F.desc("n")).first()
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{last['name']}").collect()]

    def _publish(self, rows: list[dict]) -> None:
        n = self.spark.read.schema("n long, name string").parquet(f"{self.path}/manifests").agg(F.max("n")).first()[0] + 1 if self._exists("manifests") else 0
        name = f"manifest-{n:08d}"
        self.spark.createDataFrame([tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r in rows], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(n, name)], "n long, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")

    def _of(self, kind: str, rows: list[dict] | None = None) -> list[dict]:
        return [r for r in (self.manifest() if rows is None else rows) if r["kind"] == kind]

    # writing

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add or replace documents. Of rows with one id the longest text counts, then the last in order; null ids are left out."""
        named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        one = named
        if not named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            one = named.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m")).select("doc_id", F.col("m.text").alias("text"))
        # a text is cut into terms once: a filter on their number would be pushed below the cut and repeat it
        cut = one.select("doc_id", F.explode(F.filter(F.array(terms_of(F.col("text"))), lambda t: F.size(t) > 0)).alias("t"))
        made = cut.select("doc_id", F.size("t").alias("length"), counted(F.col("t")).cast("array<struct<term:string,tf:int>>").alias("terms"))
        gone = self._dead(named.select("doc_id"))
        self._publish(self._merged([*self.manifest(), *gone, self._segment(made, 0)]))

    def remove(self, ids: DataFrame) -> None:
        """Delete the documents in ``ids(doc_id)``."""
        self._publish([*self.manifest(), *self._dead(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())])

    def _segment(self, docs: DataFrame, level: int) -> dict:
        """Write a segment of ``DOCS``, and its row of the manifest."""
        name = f"seg-{uuid.uuid4().hex}"
        put = lambda df, table: df.write.parquet(f"{self.path}/{name}/{table}")
        put(docs, "docs")
        own = self._read(DOCS, [f"{name}/docs"])
        rows = own.select("doc_id", "length", F.inline("terms"))
        put(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
        # the few terms that are dealt to several parts; there are no more of them than PART goes into the postings
        parts = self._read(TERMS, [f"{name}/terms"]).where(F.col("df") > self.part).select("term", F.ceil(F.col("df") / self.part).alias("parts"))
        dealt = rows.join(F.broadcast(parts), "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)))
        size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        mean = F.lit(max(size["length"], 1) / max(size["n"], 1))
        # three lists of numbers, filled in step, in place of a list of rows
        held = dealt.groupBy("term", "part").agg(*[F.collect_list(c).alias(c) for c in ("doc_id", "tf", "length")])
        posting = lambda p: F.struct(p["doc_id"].alias("doc_id"), p["tf"].alias("tf"), p["length"].alias("length"))
        ordered = F.sort_array(F.transform(F.arrays_zip("doc_id", "tf", "length"), lambda p: F.struct((-weight(p["tf"], p["length"], mean)).alias("order"), *[p[c].alias(c) for c in ("doc_id", "tf", "length")])))
        # the blocks are cut from one array, so that no block's row carries the whole list
        starts = lambda a: F.sequence(F.lit(0), F.size(a) - 1, F.lit(self.block))
        cut = bound(ordered, lambda a: F.transform(starts(a), lambda i: F.transform(F.slice(a, i + 1, self.block), posting)))
        held = held.select("term", "part", F.posexplode(cut).alias("block", "postings"))
        least = lambda t: F.array_min(F.transform(F.filter("postings", lambda p: p["tf"] == t), lambda p: p["length"]))
        corners = F.transform(F.array_distinct("postings.tf"), lambda t: F.struct(t.alias("tf"), least(t).alias("length")))
        with sorted_groups(self.spark):
            put(held.select("term", "part", "block", corners.alias("corners"), "postings"), "blocks")
        return {"kind": "segment", "name": name, "level": level, "docs": size["n"], "length": size["length"]}

    def _alive(self, rows: list[dict]) -> DataFrame:
        """``DOCS`` of segments, and the segment, without the dead."""
        segments = [r["name"] for r in self._of("segment", rows)]
        dead = self._read(DEAD, [f"{r['name']}/dead" for r in self._of("dead", rows)])
        return self._read(DOCS, [f"{s}/docs" for s in segments], tagged=True).join(dead, ["segment", "doc_id"], "left_anti")

    def _dead(self, ids: DataFrame) -> list[dict]:
        """List the live documents in ``ids`` as dead."""
        rows = self.manifest()
        if not self._of("segment", rows):
            return []
        name = f"dead-{uuid.uuid4().hex}"
        # ids first; only of those found the terms are read
        self._alive(rows).select("segment", "doc_id", "length").join(ids, "doc_id", "left_semi").select("segment", "doc_id", "length").write.parquet(f"{self.path}/{name}/dead")
        held = self._read(DOCS, [f"{r['name']}/docs" for r in self._of("segment", rows)], tagged=True).join(self._read(DEAD, [f"{name}/dead"]), ["segment", "doc_id"], "left_semi")
        held.select("segment", F.explode("terms.term").alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}/lost")
        size = self._read(DEAD, [f"{name}/dead"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        return [{"kind": "dead", "name": name, "level": 0, "docs": -size["n"], "length": -size["length"]}] if size["n"] else []

    def _merged(self, rows: list[dict]) -> list[dict]:
        """The manifest after each level that is full has been merged into the next."""
        level = 0
        while any(r["level"] >= level for r in self._of("segment", rows)):
            full = [r for r in self._of("segment", rows) if r["level"] == level]
            if len(full) >= self.fan:
                names = {r["name"] for r in full}
                made = self._segment(self._alive([*full, *self._of("dead", rows)]).select("doc_id", "length", "terms"), level + 1)
                left = [r for r in rows if r["name"] not in names]
                rows = [r for r in left if r["kind"] == "segment"] + [made] + self._still_dead(left, names)
            level += 1
        return rows

    def _still_dead(self, rows: list[dict], merged: set[str]) -> list[dict]:
        """The lists of the dead without those of segments that have been merged."""
        lists = self._of("dead", rows)
        if not lists:
            return []
        name = f"dead-{uuid.uuid4().hex}"
        for schema, part in ((DEAD, "dead"), (LOST, "lost")):
            self._read(schema, [f"{r['name']}/{part}" for r in lists]).where(~F.col("segment").isin(sorted(merged))).write.parquet(f"{self.path}/{name}/{part}")
        size = self._read(DEAD, [f"{name}/dead"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        return [{"kind": "dead", "name": name, "level": 0, "docs": -size["n"], "length": -size["length"]}] if size["n"] else []

    # reading

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, dict[str, int]]:
        """``queries(query_id, terms array)`` -> ``query_id, doc_id, score, rank`` of the k best live documents by BM25, a written
        table, and how many blocks of the queries' terms there are and how many were read."""
        rows, work = self.manifest(), Written(self.spark)
        segments, lists = [r["name"] for r in self._of("segment", rows)], self._of("dead", rows)
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double, rank int"
        n = sum(r["docs"] for r in rows)
        if not segments or not n:
            return self.spark.createDataFrame([], schema), {"blocks": 0, "read": 0}
        mean = F.lit(sum(r["length"] for r in rows) / n)
        asked = work.table(wanted(queries), "asked")
        dead = self._read(DEAD, [f"{r['name']}/dead" for r in lists]).select("segment", "doc_id")
        # frequencies among the live
        named = asked.select("term").distinct()
        held = self._read(TERMS, [f"{s}/terms" for s in segments]).select("term", F.col("df").alias("n")).unionByName(self._read(LOST, [f"{r['name']}/lost" for r in lists]).select("term", (-F.col("n")).alias("n")))
        df = held.join(named, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        idf = work.table(df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
        blocks = self._read(BLOCKS, [f"{s}/blocks" for s in segments], tagged=True)
        most = F.col("idf") * F.array_max(F.transform("corners", lambda c: weight(c["tf"], c["length"], mean)))
        known = blocks.select("segment", "term", "part", "block", "corners").join(idf, "term").join(asked, "term").select("query_id", "segment", "term", "part", "block", most.alias("most"))
        # what a query's other terms can add in a segment
        known = work.table(known, "blocks")
        tops = known.groupBy("query_id", "segment", "term").agg(F.max("most").alias("top"))
        whole = tops.groupBy("query_id", "segment").agg(F.sum("top").alias("whole"))
        limits = tops.join(whole, ["query_id", "segment"]).select("query_id", "segment", "term", (F.col("whole") - F.col("top")).alias("rest"))
        bounded = work.table(known.join(limits, ["query_id", "segment", "term"]).withColumn("reach", F.col("most") + F.col("rest")), "bounded")
        best = F.row_number().over(W.partitionBy("query_id", "segment", "term").orderBy(F.desc("most"), "part", "block"))
        first = bounded.withColumn("r", best).where("r = 1")

        def scored(chosen: DataFrame) -> DataFrame:
            """Sums over the postings of some blocks, without the dead."""
            cells = ["segment", "term", "part", "block"]
            read = blocks.select(*cells, "postings").join(chosen.select(*cells, "query_id"), cells).select("query_id", "segment", "term", F.inline("postings"))
            told = read.join(dead, ["segment", "doc_id"], "left_anti").join(idf, "term")
            return told.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("length"), mean)).alias("score"))

        ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
        reached = scored(first).withColumn("rank", ranked).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        kept = work.table(bounded.join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("reach") >= F.col("reached") - 1e-6)).drop("reached"), "kept")
        out = work.table(scored(kept).withColumn("rank", ranked).where(F.col("rank") <= k), "ranking")
        cells = lambda d: d.select("query_id", "segment", "term", "part", "block").distinct().count()
        counts = {"blocks": cells(bounded), "read": cells(kept)}
        work.drop(keep=1)
        return out, counts

    def vacuum(self) -> int:
        """Delete segments, lists and manifests that the newest manifest does not name; the number of folders."""
        used = {r["name"] for r in self.manifest()}
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(base)
        names = [f.getPath().getName() for f in files]
        last = max((x for x in names if x.startswith("manifest-")), default="")
        gone = [x for x in names if x.startswith(("seg-", "dead-", "manifest-")) and x not in used and x != last]
        for x in gone:
            delete(self.spark, f"{self.path}/{x}")
        return len(gone)
