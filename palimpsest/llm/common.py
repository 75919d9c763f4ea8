"""What the corpus operators share: durable intermediate tables, distributed numbering, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows and bytes an Arrow batch holds at most, so that a Python worker's memory has a bound.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20

#: Consecutive buckets whose counts are added up on their own when numbering.
RUN = 1024

_own_dir: str | None = None
#: Folders made in this process, for ``release``.
_made: list[str] = []
#: Lists that note what is made while they are open, in this thread (``settled``).
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``; only where unset (tests) a folder of this process."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    for own in _open.get():
        own.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every table this process has written to the shared folder; results not written elsewhere by then are lost."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables behind ``durable`` frames whose last reader has been written itself."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if ``fresh_path`` has made it in this process; leave all others alone."""
    own = folder.rsplit("/", 1)[1]
    for path in [p for p in _made if p.rsplit("/", 1)[1] == own]:
        _delete(spark, path)
        _made.remove(path)


def settled(read: DataFrame, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; every other table that this thread has written for it is deleted, and so is the one
    behind ``read``, if it is ours."""
    spark = read.sparkSession
    own: list[str] = []
    held = _open.set((*_open.get(), own))
    try:
        out = durable(make(), name)
    finally:
        _open.reset(held)
    for folder in own[:-1]:
        drop_folder(spark, folder)
    discard(spark, read)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean() -> None:
    """For a Python worker: have Arrow, and the C library where it can, give freed memory back to the system rather than
    keep it from one task to the next."""
    pa.set_memory_pool(pa.system_memory_pool())
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with so many underscores before it that ``df`` has no such column (Spark does not tell cases apart)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, least: int = 64, each: int = 50_000) -> int:
    """So many buckets that one holds about ``each`` rows, however large the table."""
    return max(least, -(-rows // each))


def sums_before(df: DataFrame, keys: list[str], spread: Column, order: list[Column], amount: str | None, out: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``out long`` added: the sum of ``amount`` (None: 1 a row) over the rows before it in its ``keys`` group, with no
    group in one task.

    A group is cut into ``buckets`` by ``spread``; buckets are summed on their own and shifted by the sums of the buckets
    before. Those come from two levels: runs of ``RUN`` buckets on their own, and the runs; so that a task reads ``RUN`` of
    a group's counts, or one of ``RUN`` of them. ``order`` must tell rows of a bucket apart as far as their outcome
    matters; rows that agree on all of it may swap places.
    """
    b, before = f"__{out}_bucket", f"__{out}_before"
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    dealt = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg((F.count(F.lit(1)) if amount is None else F.sum(amount)).alias("__n"))
    if buckets <= RUN:
        shifts = counts.withColumn(before, zero(F.sum("__n").over(upto(W.partitionBy(*keys).orderBy(b))))).select(*keys, b, before)
    else:
        cut = durable(counts.withColumn("__run", F.expr(f"{b} div {RUN}")), "counts")
        runs = cut.groupBy(*keys, "__run").agg(F.sum("__n").alias("__all"))
        runs = runs.withColumn("__upto", zero(F.sum("__all").over(upto(W.partitionBy(*keys).orderBy("__run"))))).drop("__all")
        inside = cut.withColumn("__in", zero(F.sum("__n").over(upto(W.partitionBy(*keys, "__run").orderBy(b)))))
        shifts = inside.join(runs, [*keys, "__run"]).select(*keys, b, (F.col("__upto") + F.col("__in")).alias(before))
    inner = W.partitionBy(*keys, b).orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(inner) - 1 if amount is None else zero(F.sum(amount).over(upto(inner))))
    return ranked.join(shifts, [*keys, b]).withColumn(out, (F.col(before) + F.col("__r")).cast("long")).drop(b, before, "__r")


def number_within(df: DataFrame, keys: list[str], spread: Column, order: list[Column], out: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 without gaps, with no group in one task (``sums_before``)."""
    return sums_before(df, keys, spread, order, None, out, buckets)


def ordered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos long`` (from 0 within its ``tree``, by ``order``) and ``n long`` (rows of the tree); a written table.

    One range partitioning over all trees puts rows in order; a partition's rows of a tree are numbered on from the tree's
    rows in the partitions before it, of which there is one count each. The two short tables are joined as they are."""
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number that Spark gives is the partition's, in the upper 31 bits, and the row's in it
    at = F.monotonically_increasing_id()
    placed = durable(sorted_.withColumn("at", at).withColumn("part", F.expr("cast(at >> 33 as int)")), "ordered")
    counts = durable(placed.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")), "counts")
    up = W.partitionBy(tree).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = counts.groupBy(tree).agg(F.sum("rows").alias("n"))
    shifts = counts.withColumn("before", F.coalesce(F.sum("rows").over(up), F.lit(0)) - F.col("first")).join(whole, tree).select(tree, "part", "before", "n")
    out = durable(placed.join(shifts, [tree, "part"]).withColumn("pos", F.col("at") + F.col("before")).drop("at", "part", "before"), "numbered")
    discard(rows.sparkSession, placed, counts)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(src long, dst long)``: a row ``(node, component)`` for every node that has
    an edge, ``component`` being the smallest node it reaches.

    Alternating large-star and small-star rounds (each node's larger, then smaller, neighbours move to its least
    neighbour), until the links are stars. No adjacency list is ever gathered: both stars are a ``min`` aggregate,
    combined before the shuffle, written, and joined back to the edges. The join is one of two written tables, so a node
    with very many edges is a skewed key that adaptive execution splits (it cannot below an aggregate on the same key).
    """
    step = durable(
        edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    spark = edges.sparkSession
    for _ in range(max_rounds):
        both = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up, down = F.count_if(F.col("dst") < F.col("src")).alias("up"), F.count_if(F.col("dst") > F.col("src")).alias("down")
        least = durable(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"), up, down), "least")
        # in stars every node has one link up, and then none down, or none up
        if not least.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            discard(spark, least)
            break
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = durable(large, "large")
        low = durable(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        new = durable(small.where("src <> dst").distinct(), "small")
        discard(spark, large, step, least, low)
        step = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = step.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return step.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
