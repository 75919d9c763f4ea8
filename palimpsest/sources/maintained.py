"""Tables that follow from the edges, kept up to date commit by commit instead of being made anew.

``update`` takes the writes since the last one and carries what they change to the tables: cluster, arc, affiliation and context
of each edge, ambiguities, mentions of entities, facts and milestones. Each table is continued from its own last state,
so history is not read again:

=============  =============================================================================================================
clusters       the commit's edges are joined to the clusters that hold their entities, one pseudo-edge a cluster: components
               of that contracted graph say which clusters merge (``graph.components``), and the stored labels follow
mentions       counts are added; affiliation counts on from them
context,       each user's last ``TAIL`` edges are kept, as far back as these look
ambiguities
arcs           the fold goes on from the edges that opened each user's last arcs
facts          the newest value of an affected (user, fact key) stands in front of the new rows
milestones     texts that are known are left out
=============  =============================================================================================================

That is exact for edges that are new. A user for whom it is not, since a write confirms an older edge or an edge was
forgotten, is made anew from that user's edges alone; so is everybody once a snapshot has taken in writes not yet
carried over.

Storage goes by bucket of the user, as the store's. An update reads and writes only the buckets of users in it, each as a new
version, lists the version of every bucket of every table in a manifest, and then names that; readers follow the newest.
One writer at a time. ``vacuum`` deletes versions that the newest manifest does not name.

Who reads some of the tables alone can name them (``parts``): then these are carried, and what they are continued from. The first
manifest says so, and a table that is not carried cannot be read later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.operators import arcs, entities, graph, state
from palimpsest.operators.scan import arrival, last_n, live
from palimpsest.sources.durable import Written
from palimpsest.sources.store import EdgeStore

#: Edges of a user that are kept as its tail, at least as many as ambiguities and contexts look back at.
TAIL = 30

_VECTOR = "array<float>"
PARTS = {
    "edges": "user_id long, id long, source_text_hash string, cluster_id long, arc_id long, affiliation double, context_entity string",
    "keys": "user_id long, key string, cluster_id long",
    "entities": "user_id long, key string, name string, mention_count long, first_id long, last_id long",
    "tail": "user_id long, id long, sequence_number long, subject string, object string, entities array<string>, source_text string, tombstoned_at timestamp_ntz",
    "arcs": f"user_id long, id long, sequence_number long, embedding {_VECTOR}",
    "facts": "user_id long, key string, value string, edge_id long, sequence_number long, history array<struct<value:string,at:timestamp_ntz,type:string>>",
    "milestones": "user_id long, id long, source_text string, sequence_number long",
    "ambiguities": "user_id long, id long, other_id long, question string",
}
#: What a table is continued from, beside itself.
NEEDS = {"edges": ("keys", "entities", "tail", "arcs"), "ambiguities": ("tail",)}
LOG = "n long, upto long, forgets long"
MANIFEST = "part string, bucket int, version long"
LEFT_OUT = -1


class Maintained:
    def __init__(self, store: EdgeStore, speaker: Column | None = None, parts: tuple[str, ...] = tuple(PARTS)) -> None:
        if unknown := set(parts) - set(PARTS):
            raise ValueError(f"no tables {sorted(unknown)}")
        self.parts = {*parts, *(n for p in parts for n in NEEDS.get(p, ()))}
        self.store, self.spark = store, store.spark
        self.who = F.coalesce("subject", F.lit("user")) if speaker is None else speaker

    # storage

    def _last(self) -> tuple[int, int, int]:
        """The last update's number, the first write it has not seen, the last ``forget`` it has."""
        if not self.store._exists("maintained/log"):
            return 0, 1, 0
        r = self.spark.read.schema(LOG).parquet(f"{self.store.path}/maintained/log").orderBy(F.desc("n")).first()
        return r["n"], r["upto"], r["forgets"]

    def _manifest(self, n: int) -> dict[tuple[str, int], int]:
        """A version for each table and bucket that has rows: as many as there are buckets, for each table."""
        if not n:
            return {}
        found = {(r["part"], r["bucket"]): r["version"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.store.path}/maintained/manifest-{n:08d}").collect()}
        # a table that is left out has a row of no bucket
        if left_out := sorted(p for p, b in found if b == LEFT_OUT and p in self.parts):
            raise ValueError(f"{left_out} have not been carried from the first update on")
        return {k: v for k, v in found.items() if k[1] != LEFT_OUT}

    def _read(self, part: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [self._folder(part, v, b) for (p, b), v in sorted(manifest.items()) if p == part and (buckets is None or b in buckets)]
        return self.spark.read.schema(PARTS[part]).parquet(*folders) if folders else self.spark.createDataFrame([], PARTS[part])

    def _folder(self, part: str, version: int, bucket: int) -> str:
        return f"{self.store.path}/maintained/{part}/v{version:08d}/user_bucket={bucket}"

    def table(self, part: str, user_id: int | None = None) -> DataFrame:
        """A table as of the last update; of one user, if named, from that user's bucket alone."""
        if part not in self.parts:
            raise ValueError(f"{part} is not carried")
        manifest = self._manifest(self._last()[0])
        if user_id is None:
            return self._read(part, manifest)
        own = self.spark.range(1).select(self.store.bucket(F.lit(user_id).cast("long"))).first()[0]
        return self._read(part, manifest, [own]).where(F.col("user_id") == user_id)

    def enriched(self, user_id: int | None = None) -> DataFrame:
        """The store's current view with what is known of its edges."""
        derived = self.table("edges", user_id).drop("source_text_hash").withColumn("arc_id", F.col("arc_id").cast("string"))
        edges = self.store.current(user_id).drop("cluster_id", "arc_id", "affiliation", "context_entity")
        return edges.join(derived, ["user_id", "id"], "left")

    # carrying over

    def update(self) -> int:
        """Carry over what was written and forgotten since the last update; the number of users that it touched."""
        store, work = self.store, Written(self.spark)
        n, upto, forgets = self._last()
        now, ops = store.next_number(), store.forgets()
        if (now, ops) == (upto, forgets):
            return 0
        manifest = self._manifest(n)
        written = store.written(upto)
        since = F.col("sequence_number") >= upto
        writes = work.table(store.merged().where(since | (F.coalesce("last_sequence", F.lit(0)) >= upto)) if written is None else written, "writes")
        gone = store._forgotten(forgets).select("user_id").distinct()
        users = work.table(writes.select("user_id").distinct().withColumn("wrote", F.lit(True)).join(gone.withColumn("forgot", F.lit(True)), "user_id", "full").withColumn("bucket", store.bucket(F.col("user_id"))), "users")
        buckets = sorted(r["bucket"] for r in users.select("bucket").distinct().collect())
        old = {part: self._read(part, manifest, buckets) for part in PARTS}
        again = writes.select("user_id", "source_text_hash").distinct().join(old["edges"].select("user_id", "source_text_hash"), ["user_id", "source_text_hash"], "left_semi").select("user_id")
        anew = again.unionByName(users.where("forgot").select("user_id"))
        if written is None:
            anew = anew.unionByName(users.select("user_id"))
        anew = work.table(anew.distinct(), "anew")
        fresh = state.confirmed(writes.join(anew, "user_id", "left_anti"))
        columns = ["user_id", "id", "source_text_hash", "subject", "predicate", "object", "source_text", "source_timestamp", "entities", "embedding", "schematic", "significance", "negated", "temporal_context", "sequence_number", "tombstoned_at"]
        fresh = fresh.select(*columns)
        if not anew.isEmpty():
            of = sorted(r["bucket"] for r in anew.select(store.bucket(F.col("user_id")).alias("bucket")).distinct().collect())
            fresh = fresh.unionByName(store.merged(buckets=of).join(anew, "user_id", "left_semi").select(*columns))
        fresh = work.table(fresh, "fresh")
        kept = {part: rows.join(anew, "user_id", "left_anti") for part, rows in old.items()}
        for part, rows in self._carried(work, fresh, kept).items():
            rows.withColumn("user_bucket", store.bucket(F.col("user_id"))).write.mode("overwrite").partitionBy("user_bucket").parquet(f"{store.path}/maintained/{part}/v{n + 1:08d}")
        manifest = {k: v for k, v in manifest.items() if k[1] not in buckets}
        manifest |= {(part, b): n + 1 for part in PARTS for b in buckets if store._exists(f"maintained/{part}/v{n + 1:08d}/user_bucket={b}")}
        rows = [(p, b, v) for (p, b), v in manifest.items()] + [(p, LEFT_OUT, 0) for p in PARTS if p not in self.parts]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store.path}/maintained/manifest-{n + 1:08d}")
        store._log("maintained/log", [(n + 1, now, ops)], LOG)
        touched = users.count()
        work.drop()
        return touched

    def _carried(self, work: Written, fresh: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All tables of the buckets touched, after ``fresh`` edges."""
        new = live(fresh)
        users = fresh.select("user_id").distinct()
        own = lambda part: old[part].join(users, "user_id", "left_semi")
        others = lambda part: old[part].join(users, "user_id", "left_anti")
        out: dict[str, DataFrame] = {}

        # each user's last edges, and what looks back at them
        if "tail" in self.parts:
            tail = work.table(own("tail").unionByName(new.select(*[c.split()[0] for c in PARTS["tail"].split(", ")])), "tail")
            out["tail"] = others("tail").unionByName(last_n(tail, TAIL, ["user_id"], [c.desc() for c in arrival(tail)]))
        if "ambiguities" in self.parts:
            nouns = F.filter(F.split(F.lower("source_text"), r"\s+"), lambda w: F.length(w) > 3)
            asked = new.select("id", "user_id", "object", nouns.alias("terms"))
            met = entities.ambiguities(tail, asked, TAIL).join(new.select("id", "user_id"), "id")
            out["ambiguities"] = old["ambiguities"].unionByName(met.select("user_id", "id", "other_id", "question"))

        # mentions
        if "entities" in self.parts:
            heard = entities.mentions(new).withColumn("age", F.lit(1)).unionByName(own("entities").withColumn("age", F.lit(0)))
            counted = heard.groupBy("user_id", "key").agg(F.min_by("name", "age").alias("name"), F.sum("mention_count").alias("mention_count"), F.min_by("first_id", "age").alias("first_id"), F.max_by("last_id", "age").alias("last_id"))
            out["entities"] = others("entities").unionByName(counted)

        # arcs
        if "arcs" in self.parts:
            heads = own("arcs")
            embedded = new.where("embedding is not null")
            told = work.table(arcs.arcs(embedded, heads), "arcs")
            opened = embedded.join(told.where("opened").select("id"), "id", "left_semi").select("user_id", "id", "sequence_number", "embedding")
            out["arcs"] = others("arcs").unionByName(last_n(heads.unionByName(opened), arcs.LOOK, ["user_id"], [F.desc("sequence_number"), F.desc("id")]))

        # clusters: labels of the contracted graph
        if "keys" in self.parts:
            named = entities.named(new).where(~F.col("key").isin(graph.EXCLUDED)).select("user_id", "key", "id")
            keys = work.table(named.select("user_id", "key").distinct().join(own("keys"), ["user_id", "key"]), "met")
            pseudo = keys.groupBy("user_id", F.col("cluster_id").alias("id")).agg(F.collect_list("key").alias("entities"))
            both = new.select("user_id", "id", "entities").unionByName(pseudo.select("user_id", "id", "entities")).withColumn("tombstoned_at", F.lit(None).cast("timestamp_ntz"))
            labels = work.table(graph.components(both), "labels")
            moved = work.table(labels.where("id <> cluster_id").select(F.col("id").alias("from"), F.col("cluster_id").alias("to")), "moved")
            follow = lambda rows: rows.join(moved, rows["cluster_id"] == moved["from"], "left").withColumn("cluster_id", F.coalesce("to", "cluster_id")).drop("from", "to")
            first = named.join(labels, "id").groupBy("user_id", "key").agg(F.min("cluster_id").alias("cluster_id"))
            held = follow(own("keys")).join(first.select("user_id", "key"), ["user_id", "key"], "left_anti")
            out["keys"] = others("keys").unionByName(held).unionByName(first)

        # affiliation goes by how often a name has been heard; which texts are known is always kept
        if "edges" in self.parts:
            affiliation = entities.affiliation(new, self.who, own("entities"))
            context = entities.context_entity(tail, self.who).join(new.select("id"), "id", "left_semi")
            made = fresh.select("user_id", "id", "source_text_hash").join(labels.select("id", "cluster_id"), "id", "left").join(told.select("id", "arc_id"), "id", "left").join(affiliation, "id", "left").join(context, "id", "left")
            out["edges"] = others("edges").unionByName(follow(own("edges"))).unionByName(made)
        else:
            out["edges"] = old["edges"].unionByName(fresh.select("user_id", "id", "source_text_hash"), allowMissingColumns=True)

        # facts and milestones
        if "facts" in self.parts:
            told_facts = new.where(state.tier() == "fact").withColumn("key", state.fact_key())
            touched = told_facts.select("user_id", "key").distinct()
            before = own("facts").join(touched, ["user_id", "key"], "left_semi")
            seeds = before.select("user_id", "key", F.col("edge_id").alias("id"), F.col("value").alias("object"), "sequence_number", F.lit(None).cast("timestamp_ntz").alias("source_timestamp"), F.lit(False).alias("negated"), F.lit(None).cast("string").alias("temporal_context"))
            newest = state.facts_by_key(told_facts.select(*seeds.columns).unionByName(seeds))
            more = F.transform("history", lambda h: F.struct(h["value"].alias("value"), h["at"].alias("at"), h["type"].alias("type")))
            told_before = before.select("user_id", "key", F.col("history").alias("earlier"))
            grown = newest.withColumn("history", more).join(told_before, ["user_id", "key"], "left").withColumn("history", F.concat(F.coalesce("earlier", F.array().cast(PARTS["facts"].split("history ")[1])), "history"))
            out["facts"] = old["facts"].join(touched, ["user_id", "key"], "left_anti").unionByName(grown.select(*[c.name for c in old["facts"].schema.fields]))
        if "milestones" in self.parts:
            marked = state.milestones(new.where(state.tier() == "milestone")).select("user_id", "id", "source_text", "sequence_number")
            out["milestones"] = old["milestones"].unionByName(marked.join(own("milestones").select("user_id", "source_text"), ["user_id", "source_text"], "left_anti"))
        return out

    def vacuum(self) -> int:
        """Delete the versions that the newest manifest does not name; the number of folders."""
        n = self._last()[0]
        manifest = self._manifest(n)
        used = {(p, v) for (p, _), v in manifest.items()}
        gone = [f"maintained/{p}/v{v:08d}" for p in PARTS for v in range(1, n) if (p, v) not in used] + [f"maintained/manifest-{v:08d}" for v in range(1, n)]
        gone = [f for f in gone if self.store._exists(f)]
        for f in gone:
            self.store._delete(f)
        return len(gone)


def replayed(store: EdgeStore, commits: list[DataFrame], speaker: Column | None = None, each: Callable[[Maintained], object] | None = None, parts: tuple[str, ...] = tuple(PARTS)) -> Maintained:
    """Append the commits one by one, with an update after each."""
    out = Maintained(store, speaker, parts)
    for rows in commits:
        store.append(rows)
        out.update()
        if each is not None:
            each(out)
    return out
