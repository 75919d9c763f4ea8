"""Chat formatting of reply trees, by DataFrame operations alone.

Root-to-leaf paths come from iterative self-joins that double the distance each time: after k rounds a node knows its
ancestor 2^k steps up, how many nodes lie below that ancestor and their scores' sum. A tree of depth d takes log2(d)
rounds, each a join of the nodes with themselves, and no path is carried as a growing array. Branches of a tree are
ranked by their score, and the nodes of the chosen paths are found by walking the same ancestor tables once more.

Template: a turn is ``<|im_start|>``, the role, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts and
roles, ``<`` followed by any number of backslashes and ``|`` gets one backslash more, so that the control strings occur in
the output only where the template put them, and taking one away restores the text. In roles, ``%`` and line feeds are
also percent-encoded.

Defined cases: null texts and roles count as empty; a null tree is a tree of its own; a parent that is no node of the
tree makes a root; nodes that lie on a cycle are on no path from a root and are left out; rows that agree in tree and
turn are put in the order of role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.llm.common import discard, durable

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``nodes(tree string, node long, parent long, score double)`` -> the nodes of each tree's best ``branches`` paths:
    ``tree, leaf, branch (from 1), node, step (0 at the root)``. Better: larger score, then longer, then smaller leaf."""
    known = nodes.select("tree", "node")
    parents = nodes.join(known.withColumnRenamed("node", "parent").withColumn("found", F.lit(True)), ["tree", "parent"], "left")
    spark = nodes.sparkSession
    jump = durable(parents.select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"), F.coalesce("score", F.lit(0.0)).alias("total")), "jumps")
    inner = jump.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    size = jump.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, reach = [jump], 1
    while reach < size and not jump.where("up is not null").isEmpty():
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        going = jump.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"))
        jump = durable(going.unionByName(jump.where("up is null")), "jumps")
        jumps.append(jump)
        reach *= 2
    rooted = jump.where("up is null")  # on a cycle, there is always a node further up
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("n"), "node"))
    best = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    path = durable(best.select("tree", F.col("node").alias("leaf"), "branch", "node", (F.col("n") - 1).alias("step")), "paths")
    for k, jump in enumerate(jumps):
        more = path.join(jump.select("tree", "node", "up").where("up is not null"), ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("step") - (1 << k)).alias("step"))
        longer = durable(path.unionByName(more), "paths")
        discard(spark, path, jump)
        path = longer
    return path


def format_turns(turns: DataFrame, keys: list[str], step: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns(*keys, step, role, text)`` -> a row for each conversation: ``*keys, formatted string, loss_mask array``. The
    mask has an entry for each turn: null, or the place (from 0) and length in code points, within the turn, of the text
    that counts for the loss."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    mask = F.when(role.isin(*loss_roles), F.struct(F.length(head).alias("start"), F.length(body).alias("length")))
    block = F.struct(F.col(step).alias("at"), F.concat(head, body, F.lit(END + "\n")).alias("block"), mask.alias("mask"))
    rows = turns.select(*keys, block.alias("turn")).groupBy(*keys).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select(*keys, F.array_join("turns.block", "").alias("formatted"), F.col("turns.mask").alias("loss_mask"))


def read_back(df: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, turns array<struct<role, text>>, loss_text, formatted_chars`` from the formatted string and its mask."""
    blocks = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)", -1), lambda b: b != "")
    parts = df.select(*keys, "loss_mask", F.length("formatted").cast("long").alias("formatted_chars"), blocks.alias("blocks"))

    def turn(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        at = F.length(head) + 1
        role = F.substring(head, F.lit(len(START) + 1), F.length(head))
        text = F.substring(b, at + 1, F.length(b) - at - len(END) - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    def lost(b: Column, m: Column) -> Column:
        return F.when(m.isNotNull(), unescape(F.substring(b, m["start"] + 1, m["length"]))).otherwise("")

    return parts.select(*keys, F.transform("blocks", turn).alias("turns"), F.array_join(F.zip_with("blocks", "loss_mask", lost), "").alias("loss_text"), "formatted_chars")


def conversation_tree(df: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows of a table of turns as a reply tree: each turn replies to the one before. Adds ``tree, node, parent, score``."""
    at = F.row_number().over(W.partitionBy(tree_col).orderBy(F.col(turn_col).asc_nulls_last(), "role", "text")).cast("long")
    rows = df.withColumn("tree", F.coalesce(F.col(tree_col).cast("string"), F.lit("")))
    return rows.withColumn("node", at).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def format_trees(rows: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``rows(tree, node, parent, score, role, text)`` -> ``tree, leaf, branch, formatted, loss_mask`` of the chosen paths."""
    held = durable(rows.select("tree", "node", F.col("parent").cast("long").alias("parent"), F.col("score").cast("double").alias("score"), "role", "text"), "turns")
    paths = reply_paths(held.select("tree", "node", "parent", "score"), branches)
    return format_turns(paths.join(held.select("tree", "node", "role", "text"), ["tree", "node"]), ["tree", "leaf", "branch"], "step", loss_roles)
