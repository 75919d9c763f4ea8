"""A taxonomy as a table: a lexicon is a graph of words and their wider terms, given as ``dag(child, parent)``.

Its closure holds every wider term of a word with the fewest steps to it. Most words have no narrower ones: they are peeled off, then
those that have none left, and so on (``Peeled``), and each takes its wider terms from those of its parents, once. What is left
when little can be peeled off (cycles, long chains) is closed by rounds of joins that each go on from what the round
before has reached for the first time.

What kind a word is of (the nearest of some anchors among its wider terms) and how near two words are need no closure: both follow from
the same of the words' parents, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import analyze, enrich
from palimpsest.sources.durable import Written


#: So many entries of a node's wider terms are held in one row at most, give or take what chance deals to a row.
ROW = 4096
#: Links that a task merges lists over.
TASK = 100_000


class Peeled:
    """A taxonomy by levels. ``levels``: the links of the nodes that have no narrower ones among what is left, level by level, as long as
    a level takes off an eighth of the links; ``core``: the closure of the nodes that remain, the roots among them."""

    def __init__(self, dag: DataFrame, max_depth: int = 100) -> None:
        self.work = work = Written(dag.sparkSession)
        self.links = rest = work.table(dag.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct(), "links")
        self.levels: list[DataFrame] = []
        self.sizes: list[int] = []
        left = rest.count()
        while left:
            marked = work.table(rest.join(rest.select(F.col("parent").alias("child")).distinct().withColumn("wide", F.lit(True)), "child", "left"), "peeled")
            inner = marked.where("wide").count()
            if (left - inner) * 8 < left:
                break
            self.levels.append(marked.where("wide is null").select("child", "parent"))
            self.sizes.append(left - inner)
            rest, left = marked.where("wide").select("child", "parent"), inner
        tops = self.links.select(F.col("parent").alias("node")).unionByName(rest.select(F.col("child").alias("node"))).distinct()
        for level in self.levels:
            tops = tops.join(level.select(F.col("child").alias("node")), "node", "left_anti")
        self.core = work.table(_rounds(work.table(tops, "tops"), rest, max_depth), "core")


def _rounds(nodes: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """The closure of ``nodes(node)`` in rounds, each a written table."""
    work = Written(nodes.sparkSession)
    reached = last = work.table(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    for depth in range(1, max_depth + 1):
        further = last.join(links, last["ancestor"] == links["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        # what an earlier round has reached is nearer
        last = work.table(further.join(reached.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    out = work.table(reached, "closed")
    work.drop(keep=1)
    return out


def closure(dag: DataFrame, max_depth: int = 100) -> DataFrame:
    """``node, ancestor, depth`` (least; 0 for itself) of every node in ``dag(child, parent)``, from written tables. Links that are
    repeated, to nothing or to the node itself count for nothing, and a cycle ends where it comes back."""
    peeled, kept = Peeled(dag, max_depth), Written(dag.sparkSession)
    width = peeled.links.groupBy("child").count().agg(F.max("count")).first()[0] or 0
    sizes = peeled.core.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    known = kept.table(_in_rows(peeled.core.join(sizes, "node")), "lists")
    for level, n in zip(reversed(peeled.levels), reversed(peeled.sizes), strict=True):
        tasks = n // TASK + 1
        # a child has no more wider terms than its parents together, and itself
        most = known.groupBy("node").agg(F.sum("n").alias("n"))
        if (most.agg(F.max("n")).first()[0] or 0) * width < ROW:
            made = _joined(level, known, max_depth, tasks)
        else:
            size = level.join(most, level["parent"] == most["node"]).groupBy("child").agg((F.sum("n") + 1).alias("size"))
            dealt = peeled.work.table(level.join(size, "child"), "dealt")
            each = dealt.where(F.col("size") > ROW)
            told = each.join(known, each["parent"] == known["node"]).select("child", "size", F.inline(F.arrays_zip("ancestors", "depths"))).where(F.col("depths") < max_depth)
            rows = told.select(F.col("child").alias("node"), "size", F.col("ancestors").alias("ancestor"), (F.col("depths") + 1).cast("int").alias("depth"))
            rows = rows.unionByName(each.select(F.col("child").alias("node"), "size", F.col("child").alias("ancestor"), F.lit(0).alias("depth")))
            least = rows.groupBy("node", "size", "ancestor").agg(F.min("depth").alias("depth"))
            made = _joined(dealt.where(F.col("size") <= ROW).drop("size"), known, max_depth, tasks).unionByName(_in_rows(least))
        known = known.unionByName(kept.table(made, "lists"))
    peeled.work.drop()
    return known.select("node", F.inline(F.arrays_zip("ancestors", "depths"))).select("node", F.col("ancestors").alias("ancestor"), F.col("depths").cast("int").alias("depth"))


def _in_rows(rows: DataFrame) -> DataFrame:
    """``node, ancestor, depth, size`` as lists, ``node, ancestors, depths, n``; as many for a node as ``size`` asks for."""
    part = F.pmod(F.xxhash64("ancestor"), F.ceil(F.col("size") / ROW))
    held = rows.groupBy("node", part.alias("part")).agg(F.collect_list(F.struct("ancestor", F.col("depth").cast("short").alias("depth"))).alias("held"))
    return held.select("node", F.col("held.ancestor").alias("ancestors"), F.col("held.depth").alias("depths"), F.size("held").alias("n"))


def _joined(links: DataFrame, known: DataFrame, max_depth: int, tasks: int) -> DataFrame:
    """Lists of the children from those of their parents, a row for each."""
    met = links.join(known, links["parent"] == known["node"]).select("child", "ancestors", "depths").repartition(tasks, "child")
    held = met.groupBy("child").agg(F.collect_list(F.struct("ancestors", "depths")).alias("held"))
    further = F.filter(F.arrays_zip(F.flatten("held.ancestors").alias("ancestor"), F.flatten("held.depths").alias("depth")), lambda x: x["depth"] < max_depth)
    further = F.transform(further, lambda x: F.struct(x["ancestor"].alias("ancestor"), (x["depth"] + 1).cast("short").alias("depth")))
    own = F.array(F.struct(F.col("child").alias("ancestor"), F.lit(0).cast("short").alias("depth")))
    # of an ancestor's depths the least comes first; the sorted list is named, so that it is made once
    first = F.transform(F.array(F.sort_array(F.concat(own, further))), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["ancestor"] != x["ancestor"])))
    cut = held.select(F.col("child").alias("node"), first[0].alias("held"))
    return cut.select("node", F.col("held.ancestor").alias("ancestors"), F.col("held.depth").alias("depths"), F.size("held").alias("n"))


def nearest(closed: DataFrame, anchors: DataFrame) -> DataFrame:
    """``node, anchor, label, depth``: of ``anchors(anchor, label)`` among a node's wider terms the nearest, then the first by name."""
    met = closed.join(anchors.select(F.col("anchor").alias("ancestor"), "label"), "ancestor")
    return met.groupBy("node").agg(F.min(F.struct("depth", F.col("ancestor").alias("anchor"), "label")).alias("m")).select("node", "m.anchor", "m.label", "m.depth")


def similarity(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``similarity``: one over one more than the fewest steps from one to the other by a common wider term;
    0 if there is none."""
    least = _steps(closed, pairs.select("a", "b").distinct())
    return pairs.join(least, ["a", "b"], "left").withColumn("similarity", F.coalesce(1.0 / (1 + F.col("steps")), F.lit(0.0))).drop("steps")


def _steps(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, steps`` of the pairs that have a common wider term."""
    a = closed.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("up"))
    b = closed.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("down"))
    return pairs.join(a, "a").join(b, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.col("up") + F.col("down")).alias("steps"))


def nearest_in(peeled: Peeled, anchors: DataFrame) -> DataFrame:
    """What ``nearest`` finds in the closure, without it: the nearest of a node's own name and its parents' anchors; written tables."""
    kept = Written(peeled.links.sparkSession)
    anchors = anchors.select("anchor", "label")
    known = kept.table(nearest(peeled.core, anchors), "nearest")
    for level in reversed(peeled.levels):
        met = level.join(known, level["parent"] == known["node"]).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), "anchor", "label")
        own = level.select(F.col("child").alias("node")).distinct().join(anchors, F.col("node") == F.col("anchor")).select("node", F.lit(0).alias("depth"), "anchor", "label")
        least = met.unionByName(own).groupBy("node").agg(F.min(F.struct("depth", "anchor", "label")).alias("m"))
        known = known.unionByName(kept.table(least.select("node", "m.anchor", "m.label", "m.depth"), "nearest"))
    return known


def similarity_in(peeled: Peeled, pairs: DataFrame) -> DataFrame:
    """What ``similarity`` finds in the closure, without it. Of two nodes, one on the lower level is not a wider term of the other, so
    their nearest common term is one of its parents and the other's: pairs become pairs of parents, level by level, each
    pair once; those of the core are settled by its closure, and the steps come back down."""
    work = Written(peeled.links.sparkSession)
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    nodes = peeled.links.select(F.col("child").alias("node")).unionByName(peeled.core.select("node")).distinct()
    both = pairs.where("a is not null and b is not null").select(*ordered(F.col("a"), F.col("b"))).distinct()
    for end in ("a", "b"):
        both = both.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    asked = open_ = work.table(both.select("a", "b"), "pairs")
    raised = []
    for level in peeled.levels:
        up = open_.where("a <> b")
        for end in ("a", "b"):
            up = up.join(level.select(F.col("child").alias(end), F.col("parent").alias(f"{end}_up")), end, "left")
        step = F.col("a_up").isNotNull().cast("int") + F.col("b_up").isNotNull().cast("int")
        to = ordered(F.coalesce("a_up", "a"), F.coalesce("b_up", "b"))
        moved = work.table(up.select("a", "b", to[0].alias("to_a"), to[1].alias("to_b"), step.alias("step")), "raised")
        raised.append(moved)
        open_ = work.table(moved.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "pairs")
    known = work.table(_steps(peeled.core, open_.where("a <> b")), "steps")
    for moved in reversed(raised):
        met = moved.where("to_a <> to_b").join(known.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), "steps"), ["to_a", "to_b"]).select("a", "b", (F.col("steps") + F.col("step")).alias("steps"))
        same = moved.where("to_a = to_b").select("a", "b", F.col("step").alias("steps"))
        known = work.table(met.unionByName(same).groupBy("a", "b").agg(F.min("steps").alias("steps")), "steps")
    known = known.unionByName(asked.where("a = b").select("a", "b", F.lit(0).alias("steps")))
    keyed = pairs.withColumns({"__a": F.least("a", "b"), "__b": F.greatest("a", "b")}).join(known.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "steps"), ["__a", "__b"], "left")
    out = work.table(keyed.withColumn("similarity", F.coalesce(1.0 / (1 + F.col("steps")), F.lit(0.0))).drop("steps", "__a", "__b"), "similarity")
    work.drop(keep=1)
    return out


def built_in(spark: SparkSession) -> DataFrame:
    """``dag`` of the library's own small word lists: verbs under their senses, these under classes, heads of names under types."""
    rows = [(v, f"sense:{s}") for v, s in analyze._VERB_SENSE.items()] + [(f"sense:{s}", f"class:{c}") for s, c in analyze._VERB_CLASS.items()]
    rows += [(w, "type:LOCATION") for w in enrich._GEO] + [(w, f"type:{t}") for t, ws in enrich._HEADS.items() for w in ws]
    return spark.createDataFrame(sorted(rows), "child string, parent string")


def anchors_of(dag: DataFrame, prefix: str) -> DataFrame:
    """The terms of a taxonomy that begin with ``prefix``, each its own label without it: ``class:`` or ``type:``, for example."""
    return dag.where(F.col("parent").startswith(prefix)).select(F.col("parent").alias("anchor")).distinct().withColumn("label", F.substring("anchor", len(prefix) + 1, 1000))
