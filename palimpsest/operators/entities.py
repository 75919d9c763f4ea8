"""Entities, context and ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.operators.scan import arrival, last_n, live
from palimpsest.sources.durable import Written


def named(edges: DataFrame) -> DataFrame:
    """A row for each edge and each entity it names once, by lower-case name; ``name`` keeps the first spelling."""
    spelled = F.transform("entities", lambda x: F.struct(F.lower(F.trim(x)).alias("key"), F.trim(x).alias("name")))
    first = F.filter(spelled, lambda s, i: (s["key"] != "") & ~F.exists(F.slice(spelled, F.lit(1), i), lambda t: t["key"] == s["key"]))
    return edges.withColumn("__e", F.explode(first)).withColumn("key", F.col("__e.key")).withColumn("name", F.initcap(F.col("__e.name"))).drop("__e")


def mentions(edges: DataFrame) -> DataFrame:
    """``user_id, key, name, mention_count, first_id, last_id`` of live edges."""
    rows = named(live(edges))
    at = F.struct(*arrival(rows))
    return rows.groupBy("user_id", "key").agg(F.min_by("name", at).alias("name"), F.count(F.lit(1)).alias("mention_count"), F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"))


def affiliation(edges: DataFrame, speaker: Column, known: DataFrame | None = None) -> DataFrame:
    """``id, affiliation``: 1 for a speaker's own fact; else the best level of the entities named, by how often they have been
    named up to that edge: 5 or more 0.8, 2 or more 0.6, else 0.4; without entities 0.1. ``known(user_id, key, mention_count)``:
    how often they had been named before all of ``edges``."""
    running = F.count(F.lit(1)).over(W.partitionBy("user_id", "key").orderBy(*arrival(edges)).rowsBetween(W.unboundedPreceding, 0))
    counted = named(live(edges)).withColumn("__speaker", F.lower(speaker)).withColumn("n", running).where(F.col("key") != F.col("__speaker"))
    if known is not None:
        earlier = known.select("user_id", "key", F.col("mention_count").alias("__earlier"))
        counted = counted.join(earlier, ["user_id", "key"], "left").withColumn("n", F.col("n") + F.coalesce("__earlier", F.lit(0)))
    best = counted.groupBy("id").agg(F.max("n").alias("n"))
    level = F.when(F.lower("subject") == F.lower(speaker), 1.0).when(F.col("n") >= 5, 0.8).when(F.col("n") >= 2, 0.6).when(F.col("n") >= 1, 0.4).otherwise(0.1)
    return live(edges).join(best, "id", "left").select("id", level.alias("affiliation"))


def context_entity(edges: DataFrame, speaker: Column, window: int = 5) -> DataFrame:
    """``id, context_entity``: the name most often in the user's previous edges, the speaker and single letters left out; of
    equals, the first by name."""
    w = W.partitionBy("user_id").orderBy(*arrival(edges)).rowsBetween(-window, -1)
    own = F.array_distinct(F.concat(F.array("subject", "object"), F.coalesce("entities", F.array().cast("array<string>"))))
    before = live(edges).select("id", F.lower(speaker).alias("__speaker"), F.flatten(F.collect_list(own).over(w)).alias("names"))
    each = before.select("id", "__speaker", F.explode("names").alias("name")).where((F.length("name") > 1) & (F.lower("name") != F.col("__speaker")))
    counts = each.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("id").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("context_entity"))
    return live(edges).select("id").join(best, "id", "left")


def with_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with the types of their subject and object from ``types(user_id, key, entity_type)``, GENERIC where unknown."""
    s = types.select("user_id", F.col("key").alias("__s"), F.col("entity_type").alias("subject_type"))
    o = types.select("user_id", F.col("key").alias("__o"), F.col("entity_type").alias("object_type"))
    base = edges.drop("subject_type", "object_type").withColumn("__s", F.lower("subject")).withColumn("__o", F.lower("object"))
    return base.join(s, ["user_id", "__s"], "left").join(o, ["user_id", "__o"], "left").withColumn("subject_type", F.coalesce("subject_type", F.lit("GENERIC"))).withColumn("object_type", F.coalesce("object_type", F.lit("GENERIC"))).drop("__s", "__o")


def agreed_type(ner: Column, hypernym: Column) -> Column:
    """``struct(type, confidence)`` from two sources: agreement is high; in conflict the hypernym's is taken, low."""
    return F.struct(F.coalesce(F.when(ner == hypernym, ner), hypernym, ner, F.lit("GENERIC")).alias("type"), F.when(ner.isNull() & hypernym.isNull(), "low").when(F.coalesce(ner != hypernym, F.lit(False)), "low").otherwise("high").alias("confidence"))


#: Bytes of vectors that a shard of entities and a block of mentions hold about, mentions multiplied in one step, pairs summed anew at once.
SHARD_BYTES, BLOCK_BYTES, STEP, AGAIN = 4 << 20, 8 << 20, 256, 1 << 18


def _vectors(table) -> dict:
    """The vectors of a table by width: their rows, the place of the first null in each (the width, if there is none; -1 where the
    vector itself is null), and a matrix with 0 for null."""
    import numpy as np

    vectors = table.column("embedding").combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, values = np.cumsum(sizes), vectors.flatten()
    void, gap = vectors.is_null().to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    out = {}
    for w in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == w)
        at = (ends[rows] - w)[:, None] + np.arange(w)
        first = np.where(gap[at].any(axis=1), gap[at].argmax(axis=1), w) if w and gap.any() else np.full(len(rows), w)
        out[w] = rows, np.where(void[rows], -1, first), flat[at]
    return out


def _scored(asked, known):
    """For the mentions of a block and the entities of a shard, a row a mention: ``n`` entities, ``k`` of these with a score, the mean
    of the scores and the sum of their squared differences from it, the best score and its name. A product of matrices finds the best
    up to its rounding; what lies within that is summed anew, in order as by ``vector.dot``. Of equal ones the last name counts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows_of(asked, names, rows, n, k, mean, m2, s, at):
        lost = np.full(len(rows), k == 0)
        cells = [asked.column("mention_id").combine_chunks().take(pa.array(rows)), np.full(len(rows), n), np.full(len(rows), k), pa.array(mean, mask=lost), pa.array(m2, mask=lost), pa.array(s, mask=lost), names.take(pa.array(at))]
        return pa.table(cells, names=["mention_id", "n", "k", "mean", "m2", "s", "name"])

    nothing = np.zeros(0)
    parts = [rows_of(asked, known.column("name").combine_chunks(), nothing.astype(int), 0, 0, nothing, nothing, nothing, nothing.astype(int))]
    # names in order: a greater place is a greater name
    known = known.take(pc.sort_indices(known, sort_keys=[("name", "ascending")], null_placement="at_start"))
    names = known.column("name").combine_chunks()
    for wv, (places, none_v, v) in _vectors(known).items():
        for wq, (rows, none_q, q) in _vectors(asked).items():
            w = min(wv, wq)
            sure, told = none_v >= w, none_q >= w
            if not sure.any():
                told[:] = False
            blank = np.full(int((~told).sum()), np.nan)
            parts.append(rows_of(asked, names, rows[~told], len(places), 0, blank, blank, blank, np.full(len(blank), places.max())))
            # copies are multiplied once
            cut = np.ascontiguousarray(v[sure, :w])
            keys = cut.view(np.dtype((np.void, 8 * w))).ravel() if w else np.zeros(len(cut), dtype=np.int8)
            _, one, of, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            u, weight, last, k = cut[one], count.astype(float), np.zeros(len(one), dtype=np.int64), len(cut)
            np.maximum.at(last, of.ravel(), places[sure])
            rows, q = rows[told], q[told, :w]
            longest = np.sqrt((u * u).sum(axis=1).max()) if len(u) else 0.0
            for lo in range(0, len(q), STEP):
                x = q[lo : lo + STEP]
                s = x @ u.T
                off = np.isnan(s)
                bad, top = off.any(axis=1), s.max(axis=1)
                slack = np.nan_to_num(4 * (w + 1) * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1)) * longest, nan=0.0, posinf=0.0)
                r, c = np.nonzero(np.where(bad[:, None], off, s >= (top - slack)[:, None]))
                best, at = np.full(len(x), -np.inf), np.full(len(x), -1)
                for i in range(0, len(r), AGAIN):
                    rr, cc = r[i : i + AGAIN], c[i : i + AGAIN]
                    exact = np.zeros(len(rr))
                    for j in range(w):
                        exact += x[rr, j] * u[cc, j]
                    s[rr, cc] = exact
                    exact = np.where(np.isnan(exact), np.inf, exact)
                    order = np.lexsort((last[cc], exact, rr))
                    end = order[np.append(rr[order][1:] != rr[order][:-1], True)]
                    more = (exact[end] > best[rr[end]]) | ((exact[end] == best[rr[end]]) & (last[cc[end]] > at[rr[end]]))
                    best[rr[end[more]]], at[rr[end[more]]] = exact[end[more]], last[cc[end[more]]]
                best = np.where(bad, np.nan, best)
                # from the best on: of equal scores the mean is the score
                mean = best + (s - best[:, None]) @ weight / k
                parts.append(rows_of(asked, names, rows[lo : lo + STEP], len(places), k, mean, (s - mean[:, None]) ** 2 @ weight, best, at))
    return pa.concat_tables(parts)


def linked(mentions_: DataFrame, entities: DataFrame, min_population: int = 3) -> DataFrame:
    """``mentions(mention_id, user_id, embedding)`` to the nearest of ``entities(user_id, name, embedding)`` by dot product; with
    three entities or more only if it stands out by a population standard deviation above the mean.

    A user's entities are dealt to shards and the mentions to blocks; a task multiplies one of each and keeps a row a mention
    (number, mean, squares and best of its scores). Those are merged: pairs never become rows."""
    work = Written(entities.sparkSession)
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    e, m = entities.where("user_id is not null").select("user_id", "name", doubles), mentions_.where("user_id is not null").select("user_id", "mention_id", doubles)
    parts = lambda rows, size, name: rows.groupBy("user_id").agg(F.ceil(F.sum(8 + 8 * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))) / size).cast("int").alias(name))
    sizes = work.table(parts(e, SHARD_BYTES, "shards").join(parts(m, BLOCK_BYTES, "blocks"), "user_id"), "sizes")
    each, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    # names of its own for the user, as both may come from one table
    known = e.join(sizes, "user_id").select(F.col("user_id").alias("owner"), "name", "embedding", own("shards", "name", "embedding").alias("shard"), each("blocks").alias("block"))
    asked = m.join(sizes, "user_id").select("user_id", "mention_id", "embedding", own("blocks", "mention_id", "embedding").alias("block"), each("shards").alias("shard"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"mention_id {kind(m, 'mention_id')}, n long, k long, mean double, m2 double, s double, name {kind(e, 'name')}"
    scored = asked.groupBy("user_id", "shard", "block").cogroup(known.groupBy("owner", "shard", "block")).applyInArrow(_scored, schema)
    best = scored.groupBy("mention_id").agg(F.max(F.struct("s", "name")).alias("b"), F.collect_list(F.when(F.col("k") > 0, F.struct("k", "mean", "m2"))).alias("p"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, p: a + f(p)) / F.col("k")
    best = best.withColumn("mean", F.when(F.col("k") > 0, F.col("b.s") + total(lambda p: p["k"] * (p["mean"] - F.col("b.s")))))
    best = best.withColumn("sd", F.when(F.col("k") > 0, F.sqrt(total(lambda p: p["m2"] + p["k"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))))))
    stands = (F.col("n") < min_population) | (F.col("b.s") >= F.col("mean") + F.col("sd"))
    return best.select("mention_id", F.when(stands, F.col("b.name")).alias("name"), F.col("b.s").alias("score"), "n")


def context_window(turns: DataFrame, key: str = "user_id", keep: int = 10) -> DataFrame:
    """The texts before each turn, oldest first, ``keep`` at most."""
    w = W.partitionBy(key).orderBy("turn").rowsBetween(-keep, -1)
    return turns.withColumn("context", F.collect_list("text").over(w))


def retrieval_mode(turns: DataFrame, key: str = "user_id", look: int = 5) -> DataFrame:
    """Whether the speaker is absent from the previous turns (a cold context)."""
    w = W.partitionBy(key).orderBy("turn").rowsBetween(-look, -1)
    return turns.withColumn("retrieval_mode", ~F.array_contains(F.collect_set("speaker").over(w), F.col("speaker")))


def cooldown(events: DataFrame, limit: int = 3) -> DataFrame:
    """The number of each event in its user's day, and whether it is within the day's limit."""
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.col("nth") <= limit)


def ambiguities(edges: DataFrame, probes: DataFrame, look: int = 30) -> DataFrame:
    """``probes(id, user_id, object, terms array)`` against the ``look`` live edges before each: the newest that shares a term and
    has another object. Edges are numbered and cut into cells of ``look``, so that the join has equality keys: user, term, and
    the probe's own or previous cell; a probe meets at most twice ``look`` edges, however often its term occurs."""
    rows = live(edges)
    n = F.row_number().over(W.partitionBy("user_id").orderBy(*arrival(rows))) - 1
    own = rows.select("user_id", "id", "object", F.array_distinct(F.split(F.lower("source_text"), r"\s+")).alias("w"), n.alias("n"))
    terms = own.select("user_id", F.col("id").alias("other_id"), F.col("object").alias("other_object"), F.col("n").alias("other_n"), F.expr(f"n div {look}").alias("cell"), F.explode("w").alias("term"))
    asked = probes.join(own.select("user_id", "id", "n"), ["id", "user_id"]).withColumn("term", F.explode(F.array_distinct("terms"))).drop("terms")
    asked = asked.withColumn("cell", F.explode(F.array(F.expr(f"n div {look}"), F.expr(f"n div {look} - 1"))))
    met = asked.join(terms, ["user_id", "term", "cell"]).where((F.col("other_n") < F.col("n")) & (F.col("other_n") >= F.col("n") - look) & (F.col("other_object") != F.col("object")))
    best = met.groupBy("id").agg(F.max_by(F.struct("other_id", "object", "other_object"), "other_n").alias("o"))
    return best.select("id", F.col("o.other_id").alias("other_id"), F.concat(F.lit("Did you mean "), F.col("o.object"), F.lit(" or "), F.col("o.other_object"), F.lit("?")).alias("question"))


def patterns(edges: DataFrame, unit: str, keep: int = 200) -> DataFrame:
    """Hours (``unit='hour'``) or weekdays that a user's newest edges fall on more often than evenly: ``user_id, bucket, n, total,
    confidence, example_ids``."""
    at = F.hour("source_timestamp") if unit == "hour" else F.weekday("source_timestamp")
    newest = last_n(live(edges).where("source_timestamp is not null"), keep, ["user_id"], [F.desc("source_timestamp"), F.desc("id")])
    total = newest.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    by = newest.groupBy("user_id", at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, 5).alias("example_ids"))
    cells = 24 if unit == "hour" else 7
    return by.join(total, "user_id").where(F.col("n") > F.col("total") / cells).withColumn("confidence", F.col("n") / F.col("total"))
