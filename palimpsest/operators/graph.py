"""Graph operators over edges read as undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.entities import named
from palimpsest.operators.scan import live
from palimpsest.sources.durable import Written

EXCLUDED = ["user", "i", "me", "my"]


def adjacency(edges: DataFrame) -> DataFrame:
    """``user_id, a, b`` both ways, distinct, lower case."""
    s, o = F.lower("subject").alias("a"), F.lower("object").alias("b")
    forth = live(edges).where("subject is not null and object is not null").select("user_id", s, o)
    return forth.unionByName(forth.select("user_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hops(edges: DataFrame, goals: DataFrame, depth: int = 3) -> DataFrame:
    """``goals(user_id, goal)``: the fewest steps (0 to ``depth``) from either end of an edge to one of its user's goals, -1 if it
    is further or there is none. Distances spread from the goals: a step joins the nodes reached last with the links, and
    drops what an earlier step has reached. Links and each step's nodes are written once."""
    work = Written(edges.sparkSession)
    links = work.table(adjacency(edges), "links")
    reached = last = work.table(goals.select("user_id", F.lower("goal").alias("node"), F.lit(0).alias("d")).distinct(), "reached")
    for step in range(1, depth + 1):
        near = links.join(last.select("user_id", F.col("node").alias("a")), ["user_id", "a"]).select("user_id", F.col("b").alias("node")).distinct()
        last = work.table(near.join(reached, ["user_id", "node"], "left_anti").withColumn("d", F.lit(step)), "reached")
        reached = reached.unionByName(last)
    ends = live(edges).select("id", "user_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("node"))
    found = ends.join(reached, ["user_id", "node"], "left").groupBy("id").agg(F.min("d").alias("d"))
    out = work.table(found.select("id", F.coalesce("d", F.lit(-1)).alias("hops")), "hops")
    work.drop(keep=1)
    return out


def components(edges: DataFrame, excluded: list[str] | None = None, max_rounds: int = 50) -> DataFrame:
    """``id, cluster_id``: edges of a user that share an entity, directly or through others, get the least id among them; a written
    table.

    An entity stands for itself by the least edge that names it, its head, so that an edge links the few heads of its own
    entities: no pairs are made, and the graph has as many nodes as entities, however many edges name them. Then rounds of large
    and small stars: a node's larger, then its smaller, neighbours move to its least neighbour, until the links are
    stars. Every least neighbour is a ``min`` that is written before it is joined back to the links: a node with very
    many links is then a skewed key of a join of two tables, which adaptive execution splits."""
    stop = EXCLUDED if excluded is None else excluded
    spark = edges.sparkSession
    work = Written(spark)
    own = work.table(named(live(edges)).where(~F.col("key").isin(stop)).select("user_id", "id", "key"), "named")
    heads = work.table(own.groupBy("user_id", "key").agg(F.min("id").alias("head")), "heads")
    first = work.table(own.join(heads, ["user_id", "key"]).groupBy("id").agg(F.sort_array(F.collect_set("head")).alias("heads")), "first")
    star = first.where(F.size("heads") > 1).select(F.explode(F.slice("heads", 2, F.size("heads") - 1)).alias("src"), F.col("heads")[0].alias("dst")).distinct()
    rounds = Written(spark)
    links = rounds.table(star, "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up, down = F.count_if(F.col("dst") < F.col("src")).alias("up"), F.count_if(F.col("dst") > F.col("src")).alias("down")
        least = rounds.table(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"), up, down), "least")
        # stars: every node has one link up, and then none down, or none up
        if not least.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            break
        large = rounds.table(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct(), "large")
        low = rounds.table(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        links = rounds.table(small.where("src <> dst").distinct(), "links")
        rounds.drop(keep=1)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    placed = first.select("id", F.col("heads")[0].alias("src")).join(links, "src", "left").select("id", F.coalesce("dst", "src").alias("cluster_id"))
    joined = live(edges).select("id").join(placed, "id", "left")
    out = work.table(joined.select("id", F.coalesce("cluster_id", "id").alias("cluster_id")), "clusters")
    work.drop(keep=1)
    rounds.drop()
    return out


def clusters(edges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Clusters among given edges, in order of their mean sequence number, with sorted members and participants."""
    chosen = edges if subset is None else edges.join(subset, "id", "left_semi")
    parts = components(chosen)
    rows = chosen.join(parts, "id")
    people = named(rows).where(~F.col("key").isin(EXCLUDED)).groupBy("user_id", "cluster_id").agg(F.sort_array(F.collect_set("key")).alias("participants"))
    c = rows.groupBy("user_id", "cluster_id").agg(F.avg("sequence_number").alias("mean_sequence"), F.sort_array(F.collect_list("id")).alias("members"))
    return c.join(people, ["user_id", "cluster_id"], "left")
