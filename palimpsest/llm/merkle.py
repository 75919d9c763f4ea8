"""A Merkle manifest of a dataset, by higher-order SQL functions on blocks.

Every row is a leaf; the leaves of a group make a tree in which runs of ``ARITY`` consecutive nodes become their hash until
one is left, the group's root, and the group roots make a tree of the same form, whose last node is the dataset's root.

Nodes lie in blocks of ``ARITY ** LEVELS``: an ordered array a row. ``sequence``, ``transform``, ``slice`` and ``aggregate``
collapse all levels of a block inside its row, and the block roots are the nodes of the next tier; 10^10 leaves take five
tiers. A tier is a written table. Proofs come back down the tiers: a block's row meets one row, the path of its own root,
and hands each of its nodes the siblings of its levels in front of that path. So a group is never in one task, whatever its
share of the rows: leaves are put in order by a range partitioning that all groups share, and numbered by the counts of
their group in each partition.

A leaf is the hash of its fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value. Hashes are
SHA-256 in lower-case hex, and hashes of hashes are of that text.

Defined cases: null groups come first, null ids come first in their group; rows with one id are ordered by their leaf, and
rows that agree in all fields are nodes of their own (they may swap places, which changes no output but which of the equal
rows has which proof); null and empty texts are different leaves; a group of one leaf has that leaf as its root; an empty
table has no rows, and no root. ``manifest`` returns its own columns alone, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, durable, ordered

ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS

#: A sibling pair of runs: what stands left and right of a node, as text.
STEP = "array<struct<l: string, r: string>>"


def field(value: Column) -> Column:
    """A field's text in a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def levels_of(n: Column) -> Column:
    """The least number of levels that leave one of ``n`` nodes, or ``LEVELS``."""
    out = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        out = F.when(n <= ARITY**k, F.lit(k)).otherwise(out)
    return out


def collapsed(nodes: Column, up: Column) -> Column:
    """``array<array<string>>``: ``nodes``, then the nodes of each of the ``up`` levels above them."""
    above = lambda below: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int")), lambda i: _hash(F.array_join(F.slice(below, i * ARITY + 1, F.lit(ARITY)), ""))
    )
    steps = F.when(up > 0, F.sequence(F.lit(1), up)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def siblings(levels: Column, at: Column) -> Column:
    """``STEP``: for node ``at`` (from 0) of the lowest level, what stands beside it and its ancestors in their runs; the
    topmost level has one node that no run of this block holds."""

    def beside(level: Column, k: Column) -> Column:
        i = F.floor(at / F.pow(F.lit(ARITY), k)).cast("int")
        left = i % ARITY
        return F.struct(
            F.array_join(F.slice(level, i - left + 1, left), "").alias("l"),
            F.array_join(F.slice(level, i + 2, F.lit(ARITY - 1) - left), "").alias("r"),
        )

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """From ``leaves(tree, pos, n, digest, carried)``, the written tables ``tree, block, n, nodes, levels`` of each tier.
    ``nodes`` are structs of ``digest`` and what the tier's nodes carry; a tree is in every tier up to that where one node
    of it is left."""
    found, now = [], leaves
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest", "carried"))), lambda x: F.struct(x["digest"].alias("digest"), x["carried"].alias("carried")))
        blocks = now.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), held.alias("nodes"))
        tier = durable(blocks.withColumn("levels", collapsed(F.transform("nodes", lambda x: x["digest"]), levels_of(F.col("n")))), "tier")
        found.append(tier)
        if not tier.where(F.col("n") > BLOCK).limit(1).count():
            return found
        now = tier.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), _top().alias("digest"), F.lit(None).cast("string").alias("carried"))


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), -1)


def roots(found: list[DataFrame]) -> DataFrame:
    """``tree, digest``: each tree's last node."""
    ends = [t.where(F.col("n") <= BLOCK).select("tree", _top().alias("digest")) for t in found]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def descend(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, digest, carried, path, ...`` of all nodes of the lowest tier: the path leads from the node over its tree's root
    along ``above(tree, path, ...)``, whose other columns come along."""
    extra = [c for c in above.columns if c not in ("tree", "path")]
    upper: DataFrame | None = None
    for tier in reversed(found):
        # a tree's last block meets the path of the whole tree, all others that of their node in the tier above
        ends = tier.where(F.col("n") <= BLOCK).join(above, "tree")
        met = ends if upper is None else ends.unionByName(tier.where(F.col("n") > BLOCK).join(upper, ["tree", "block"]))
        each = met.select("tree", "block", "levels", "path", *extra, F.posexplode("nodes").alias("i", "node"))
        path = F.concat(siblings(F.col("levels"), F.col("i")), F.col("path"))
        rows = each.select("tree", (F.col("block") * BLOCK + F.col("i")).alias("pos"), "node.digest", "node.carried", path.alias("path"), *extra)
        if tier is found[0]:
            return rows
        upper = durable(rows.select("tree", F.col("pos").alias("block"), "path", *extra), "paths")
    raise AssertionError("no tier")


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaf up."""
    return _hash(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: _hash(F.concat(s["l"], node, s["r"])))


def manifest(df: DataFrame, id_col: str, group_col: str, fields: list[Column], seen: list[Column] | None = None) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``fields`` make a leaf; leaves of a group ascend by id, groups by the bytes of their name. ``seen`` are the fields of a
    copy to be checked (default: the same): its leaf is folded with the siblings of the manifest, and verified if that
    leads to the same root."""
    spark = df.sparkSession
    leaf = leaf_hash(*fields)
    found = leaf if seen is None else leaf_hash(*seen)
    # a group's name as a field tells null from text; the order of groups is kept beside it
    leaves = df.select(field(F.col(group_col)).alias("tree"), F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("digest"), found.alias("found"))
    leaves = durable(leaves, "leaves")
    carried = F.struct("id", "found")
    placed = ordered(leaves.drop("grp"), "tree", ["id", "digest", "found"])
    below = tiers(placed.select("tree", "pos", "n", "digest", carried.alias("carried")))
    names = leaves.groupBy("tree").agg(F.first("grp").alias("grp"))
    tops = durable(roots(below).join(names, "tree").select(F.lit("").alias("whole"), "grp", "tree", "digest"), "subroots")
    heads = ordered(tops, "whole", ["grp"])
    over = tiers(heads.select(F.col("whole").alias("tree"), "pos", "n", "digest", F.col("tree").alias("carried")))
    one = roots(over).first()
    if one is None:
        return spark.createDataFrame([], _schema(id_col))
    none = spark.createDataFrame([("", [])], f"tree string, path {STEP}")
    paths = durable(descend(over, none).select(F.col("carried").alias("tree"), F.col("digest").alias("subroot"), "path"), "subroot-paths")
    rows = descend(below, paths)
    root = F.lit(one["digest"])
    # the fold is written once, so that neither it nor its comparison is planned twice
    checked = durable(rows.select(F.col("carried.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", proof(F.col("path")).alias("proof_sha256"), folded(F.col("carried.found"), F.col("path")).alias("folded_root")), "manifest")
    discard(spark, leaves, placed, *below, tops, heads, *over, paths)
    return checked.select(id_col, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _schema(id_col: str) -> str:
    return f"`{id_col}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
