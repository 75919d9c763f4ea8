"""The edge store: append-only logs of writes and operations, and the current view as a query over them.

Plain Parquet has no MERGE, so nothing is updated in place. ``writes`` holds every write, a folder for each commit, below it
partitioned by a hash bucket of the user, so that one user's reads prune to one bucket. ``ops`` holds the tombstones.

A commit is data first, then a row in ``commits``: only commits named there are read. The folder of a stream's batch follows
from the stream and the batch id, and is overwritten when a batch comes again after a crash between the two, so a batch
counts once, and batches of different streams never meet. Each commit numbers its rows on from the last one's: the
``sequence_number`` is the order of arrival, within a commit that of time. One writer at a time; should two commit at once, their
numbers may coincide, and ids decide.

``compact`` writes the merged view as a snapshot folder and begins a new log of commits, which starts with a row for each
stream (its last batch) in place of all commits before, and then names both; readers follow the newest names, so a failed
compaction changes nothing, and a read costs the files of the snapshot and of the commits since. ``vacuum`` deletes what
only older snapshots need; until then, readers that began before a compaction find all they have named.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palimpsest import schemas
from palimpsest.operators import state
from palimpsest.sources.durable import Written

OPS = T.StructType([T.StructField("op_id", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("edge_id", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("at", T.TimestampNTZType())])
DELTAS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("warmth", T.DoubleType()), T.StructField("formality", T.DoubleType())])
COMMITS = "token string, stream string, batch_id long, first long, n long"
FORGETS = "n long, op_id string, user_id long"
SNAPSHOTS = "n long, name string, log string"
_BUCKET = T.StructField("user_bucket", T.IntegerType())


class EdgeStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def bucket(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _read(self, schema: T.StructType, folders: list[str], user_id: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of folders partitioned by user bucket; columns that older files lack are null."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        # commits are partitions of ``writes``: only those asked for are listed
        base = f"{self.path}/{folders[0].split('/')[0]}"
        df = self.spark.read.schema(T.StructType([*schema.fields, _BUCKET])).option("basePath", base).parquet(*[f"{self.path}/{f}" for f in folders])
        if user_id is not None:
            own = self.spark.range(1).select(self.bucket(F.lit(user_id).cast("long"))).first()[0]
            df = df.where((F.col("user_bucket") == own) & (F.col("user_id") == user_id))
        if buckets is not None:
            df = df.where(F.col("user_bucket").isin(buckets))
        return df.drop("user_bucket", "commit")

    def _put(self, df: DataFrame, folder: str, mode: str = "overwrite") -> None:
        df.withColumn("user_bucket", self.bucket(F.col("user_id"))).write.mode(mode).partitionBy("user_bucket").parquet(f"{self.path}/{folder}")

    def _log(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # writing

    def append(self, edges: DataFrame, batch_id: int | None = None, stream: str = "") -> bool:
        """Add writes (conformed to the edge schema, hashed where no hash is given, numbered in order of time, then of a number they
        bring, then of id); False if the stream's batch is known."""
        log = self._commits()
        token = uuid.uuid4().hex if batch_id is None else f"{re.sub(r'[^A-Za-z0-9-]', '_', stream)}.{batch_id:012d}"
        # batches of a stream come in order, so what was folded into one row has all up to its own
        known = (F.col("batch_id") == batch_id) | (F.col("token").isNull() & (F.col("batch_id") >= batch_id))
        if batch_id is not None and not log.where((F.col("stream") == stream) & known).isEmpty():
            return False
        first = log.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 1
        work = Written(self.spark)
        hashed = F.coalesce("source_text_hash", F.sha2(F.col("source_text").cast("binary"), 256))
        # what makes the edges runs once: dealing them out by ranges reads its input twice
        made = work.table(schemas.conform(edges).withColumn("source_text_hash", hashed), "batch")
        rows, n = numbered(work, made, first)
        self._put(rows, f"writes/commit={token}")
        self._log(self._log_name(), [(token, stream, batch_id, first, n)], COMMITS)
        work.drop()
        return True

    def _log_name(self) -> str:
        return self._snapshot()[2] or "commits"

    def _commits(self) -> DataFrame:
        name = self._log_name()
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], COMMITS)

    def next_number(self) -> int:
        """The number that the next write will have."""
        return self._commits().agg(F.max(F.col("first") + F.col("n"))).first()[0] or 1

    # reading

    def _pending(self, since: int = 0) -> list[str]:
        """Folders of the commits that the snapshot does not cover, with numbers from ``since`` on: as many as there were since the
        last compaction."""
        log = self._commits().where((F.col("n") > 0) & (F.col("first") >= since))
        n, _, own = self._snapshot()
        if n is not None and own is None:
            # a snapshot from before logs were folded
            log = log.join(self.spark.read.parquet(f"{self.path}/covered").where(F.col("n") <= n).select("token"), "token", "left_anti")
        return [f"writes/commit={r['token']}" for r in log.select("token").collect()]

    def written(self, since: int) -> DataFrame | None:
        """The writes numbered from ``since`` on, if all of them are in commits of their own; None if a snapshot has taken some in."""
        begin = self._commits().where("token is null").agg(F.max(F.col("first") + F.col("n"))).first()[0] or 1
        return None if since < begin and self._snapshot()[0] is not None else self._read(schemas.EDGE, self._pending(since))

    def merged(self, user_id: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """One edge for each user and text, with its tombstone, if it has one; before supersession."""
        name = self._snapshot()[1]
        rows = self._read(schemas.EDGE, [name] if name else [], user_id, buckets).unionByName(self._read(schemas.EDGE, self._pending(), user_id, buckets))
        edges = schemas.conform(state.confirmed(rows))
        dead = self._read(OPS, ["ops"] if self._exists("ops") else [], user_id, buckets).groupBy("user_id", F.col("edge_id").alias("id")).agg(F.min("at").alias("__at"), F.min_by("reason", "at").alias("__reason"))
        return edges.join(dead, ["user_id", "id"], "left").withColumn("tombstoned_at", F.coalesce("tombstoned_at", "__at")).withColumn("tombstone_reason", F.coalesce("tombstone_reason", "__reason")).select(*[f.name for f in schemas.EDGE.fields])

    def current(self, user_id: int | None = None) -> DataFrame:
        """The merged view after supersession: of a subject's values of a predicate the one confirmed last is current."""
        return state.retired(self.merged(user_id)).select(*[f.name for f in schemas.EDGE.fields])

    def forget(self, user_id: int, by: str, scope: object, now: Column) -> int:
        """Tombstone a user's live edges that are meant; the number of them."""
        op = uuid.uuid4().hex
        meant = self.merged(user_id).where(F.col("tombstoned_at").isNull() & state.forget_predicate(by, scope))
        rows = meant.select(F.lit(op).alias("op_id"), "user_id", F.col("id").alias("edge_id"), F.lit(f"by_{by}:{scope}").alias("reason"), now.cast("timestamp_ntz").alias("at"))
        self._put(rows, "ops", "append")
        self._log("forgets", [(self.forgets() + 1, op, user_id)], FORGETS)
        return self._read(OPS, ["ops"], user_id).where(F.col("op_id") == op).count()

    def forgets(self) -> int:
        """The number of the last ``forget``."""
        return (self._forgotten(0).agg(F.max("n")).first()[0] or 0) if self._exists("forgets") else 0

    def _forgotten(self, since: int) -> DataFrame:
        """``n, op_id, user_id`` of what was forgotten after number ``since``."""
        log = self.spark.read.schema(FORGETS).parquet(f"{self.path}/forgets") if self._exists("forgets") else self.spark.createDataFrame([], FORGETS)
        return log.where(F.col("n") > since)

    # the style profile

    def adapt(self, deltas: DataFrame) -> None:
        """Add ``deltas(user_id, warmth, formality)``: how turns move their users' profiles."""
        self._put(deltas.select("user_id", F.col("warmth").cast("double").alias("warmth"), F.col("formality").cast("double").alias("formality")), "profile", "append")

    def profiles(self, user_id: int | None = None) -> DataFrame:
        """``user_id, warmth, formality`` of the users with deltas (``state.profiles``)."""
        return state.profiles(self._read(DELTAS, ["profile"] if self._exists("profile") else [], user_id))

    # what follows from the edges

    def derive(self, speaker: Column | None = None) -> str:
        """Write the tables that follow from the current view, and then name them: ``edges`` with their cluster, arc, affiliation and
        context entity, ``ambiguities``, ``entities``, ``facts`` and ``milestones``. The name of the set."""
        from palimpsest.operators import arcs, entities, graph

        who = F.coalesce("subject", F.lit("user")) if speaker is None else speaker
        name = f"derived-{uuid.uuid4().hex}"
        put = lambda df, part: df.write.parquet(f"{self.path}/{name}/{part}")
        work = Written(self.spark)
        edges = work.table(self.current(), "current")
        own = edges.drop("cluster_id", "arc_id", "affiliation", "context_entity")
        arc = arcs.arcs(own.where("tombstoned_at is null and embedding is not null")).select("id", F.col("arc_id").cast("string").alias("arc_id"))
        for more in (graph.components(own), arc, entities.affiliation(own, who), entities.context_entity(own, who)):
            own = own.join(more, "id", "left")
        put(schemas.conform(own), "edges")
        nouns = F.filter(F.split(F.lower("source_text"), r"\s+"), lambda w: F.length(w) > 3)
        put(entities.ambiguities(edges, edges.where("tombstoned_at is null").select("id", "user_id", "object", nouns.alias("terms"))), "ambiguities")
        put(entities.mentions(edges), "entities")
        put(state.facts(edges.where(state.tier() == "fact")), "facts")
        put(state.milestones(edges.where((state.tier() == "milestone") & F.col("tombstoned_at").isNull())), "milestones")
        work.drop()
        n = self._read_log("derived").agg(F.max("n")).first()[0] if self._exists("derived") else -1
        self._log("derived", [(n + 1, name)], "n long, name string")
        return name

    def derived(self, part: str) -> DataFrame:
        """A table of the newest set that ``derive`` has written."""
        name = self._read_log("derived").orderBy(F.desc("n")).first()["name"]
        return self.spark.read.parquet(f"{self.path}/{name}/{part}")

    def _read_log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    # compaction

    def _snapshot(self) -> tuple[int | None, str | None, str | None]:
        """The newest snapshot's number, name and log of later commits."""
        if not self._exists("snapshots"):
            return None, None, None
        row = self.spark.read.schema(SNAPSHOTS).parquet(f"{self.path}/snapshots").orderBy(F.desc("n")).first()
        return (row["n"], row["name"], row["log"]) if row else (None, None, None)

    def compact(self) -> str:
        """Write the merged view as a snapshot, and a new log that begins with the last batch of each stream; only then name them."""
        last, pending = self._snapshot()[0], self._pending()
        n = 0 if last is None else last + 1
        own = uuid.uuid4().hex[:8]
        name, log = f"snapshot-{n:06d}-{own}", f"commits-{n:06d}-{own}"
        rows = self.merged().withColumn("user_bucket", self.bucket(F.col("user_id")))
        rows.repartition("user_bucket").sortWithinPartitions("user_id", "id").write.partitionBy("user_bucket").parquet(f"{self.path}/{name}")
        ends = self._commits().groupBy("stream").agg(F.max("batch_id").alias("batch_id"), F.max(F.col("first") + F.col("n")).alias("first"))
        heads = ends.select(F.lit(None).cast("string").alias("token"), "stream", "batch_id", "first", F.lit(0).cast("long").alias("n"))
        heads.coalesce(1).write.parquet(f"{self.path}/{log}")
        self._log("covered", [(n, f.removeprefix("writes/commit=")) for f in pending], "n long, token string")
        self._log("snapshots", [(n, name, log)], SNAPSHOTS)
        return name

    def vacuum(self) -> int:
        """Delete the commits that the newest snapshot covers, and earlier snapshots with their logs; the number of folders."""
        n, name, log = self._snapshot()
        if n is None:
            return 0
        covered = self.spark.read.parquet(f"{self.path}/covered").where(F.col("n") <= n).select("token").distinct().toLocalIterator() if self._exists("covered") else []
        gone = [f"writes/commit={r['token']}" for r in covered]
        older = self.spark.read.schema(SNAPSHOTS).parquet(f"{self.path}/snapshots").where(F.col("n") < n).collect()
        gone += [x for r in older for x in (r["name"], r["log"])] + (["commits"] if log else [])
        gone = [f for f in gone if f and f not in (name, log) and self._exists(f)]
        for folder in gone:
            self._delete(folder)
        return len(gone)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def backfill(self, compute: dict[str, Column]) -> DataFrame:
        """The current view with null columns computed; columns that are known stay."""
        return self.current().withColumns({c: F.coalesce(F.col(c), value) for c, value in compute.items()})


def numbered(work: Written, edges: DataFrame, first: int = 1) -> tuple[DataFrame, int]:
    """``edges`` with ``sequence_number`` counting from ``first`` without gaps in order of (source_timestamp, sequence_number, id), and
    their number. Rows are dealt to tasks by ranges of that order and written with their place in the task; places shift
    by the counts of the tasks before, of which there are as many as shuffle partitions."""
    order = ["source_timestamp", "sequence_number", "id"]
    placed = edges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = work.table(placed, "numbered")
    counts = held.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = work.table(counts.withColumn("__before", before), "shifts")
    n = shifts.agg(F.sum("__n")).first()[0] or 0
    rows = held.join(F.broadcast(shifts.select("__task", "__before")), "__task")
    return rows.withColumn("sequence_number", F.lit(first) + F.col("__before") + F.col("__at")).drop("__task", "__at", "__before"), n
