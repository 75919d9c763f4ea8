"""Sharding by balanced label propagation: linked documents move to the shard where most of their neighbours are, as far
as the shard's quota allows, until nobody moves; then shards are brought to their quotas by whole groups, and documents
without links fill them to the same size.

Links join the documents of a group (here: equal texts), so a node's neighbours are counted by its group's count in each
shard: the star through the group stands for all its pairs, which are never made. Documents of a group that start in one
shard have the same neighbours and the same label for good, so they move as one bundle with a weight: a round joins
bundles with their groups' counts, at most ``shards`` rows a group, and no group is ever gathered.

The law is ``rows``: shard sizes differ by one row at most. A group is cut only if, when its turn comes, it is larger than
the room of every shard; at most as many groups as there are shards are cut. The plan for that is made from the
histogram of group sizes by shard, which alone comes to the driver: ``shards`` times the root of twice the rows at most,
since so many different sizes need so many rows.

Defined cases: a null text has size 1 and is grouped with the empty texts; null keys form no group; repeated rows are
placed as rows; an empty table gives an empty table; other columns are not returned, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import buckets_for, discard, durable, number_within, sums_before

MAX_ROUNDS = 24
#: A shard may hold so many times its quota while labels move; at the end it holds its quota.
SLACK = 2


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def _where(rank: Column, room: list[int]) -> Column:
    """The shard in which number ``rank`` falls when shards are filled one after the other to ``room``."""
    upto, total = [], 0
    for r in room:
        total += r
        upto.append(total)
    return reduce(lambda a, u: a + F.when(rank >= F.lit(u), 1).otherwise(0), upto[:-1], F.lit(0)).cast("int")


def _own_first(shards: int) -> Column:
    """Orders a group's shards, largest first: by its rows there, then by turns that start at a place of the group's own."""
    return F.struct(F.col("here"), -F.pmod(F.col("shard") - F.xxhash64("grp"), F.lit(shards)), F.col("shard"))


def propagate(bundles: DataFrame, quota: list[int], rounds: int = MAX_ROUNDS) -> DataFrame:
    """``bundles(grp, origin, n, shard)``, a written table -> the same after labels have settled, a written table."""
    spark, shards = bundles.sparkSession, len(quota)
    spread = buckets_for(bundles.count())
    for _ in range(rounds):
        counts = bundles.groupBy("grp", "shard").agg(F.sum("n").alias("here"))
        load = {r["shard"]: r["n"] for r in bundles.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, SLACK * q - load.get(s, 0)) for s, q in enumerate(quota)]
        best = counts.where(_pick(F.col("shard"), room) > 0).groupBy("grp").agg(F.max(_own_first(shards)).alias("b")).select("grp", F.col("b.shard").alias("goal"), F.col("b.here").alias("there"))
        moves = counts.join(best, "grp").where((F.col("goal") != F.col("shard")) & (F.col("there") >= F.col("here"))).select("grp", "shard", "goal")
        wish = bundles.join(moves, ["grp", "shard"]).select("grp", "origin", "n", "goal")
        queue = sums_before(wish, ["goal"], F.xxhash64("grp"), [F.col("grp"), F.col("origin")], "n", "before", spread)
        admitted = durable(queue.where(F.col("before") + F.col("n") <= _pick(F.col("goal"), room)).select("grp", "origin", "goal"), "moves")
        if admitted.isEmpty():
            break
        moved = durable(bundles.join(admitted, ["grp", "origin"], "left").select("grp", "origin", "n", F.coalesce("goal", "shard").alias("shard")), "bundles")
        discard(spark, bundles, admitted)
        bundles = moved
    return bundles


#: Groups ``low <= nth < high`` of a shard's groups of n rows: their rows ``start <= i < stop`` go to ``goal``.
Part = tuple[int, int, int, int, int, int, int]
_PARTS = "shard int, n long, low long, high long, start long, stop long, goal int"


def plan(histogram: dict[tuple[int, int], int], quota: list[int]) -> tuple[list[Part], list[int]]:
    """Where groups go, from the number of groups by ``(shard, n)``; and the room that is left in each shard.

    Groups larger than a quota fill whole shards first. Then either every shard keeps what fits, largest first, and the rest
    goes where it fits best; or, if that would cut a group, all are placed by best fit, largest first. What fits nowhere
    is cut at the end, into the largest rooms.
    """
    tries = [_placed(histogram, quota, stay) for stay in (True, False)]
    parts, room, _ = min(tries, key=lambda t: t[2])
    return parts, room


def _placed(histogram: dict[tuple[int, int], int], quota: list[int], stay: bool) -> tuple[list[Part], list[int], int]:
    room, parts = list(quota), []
    left = {key: n for key, n in histogram.items() if n > 0}
    next_: dict[tuple[int, int], int] = dict.fromkeys(left, 0)

    def take(key: tuple[int, int], times: int, goal: int) -> None:
        if times:
            low = next_[key]
            parts.append((*key, low, low + times, 0, key[1], goal))
            next_[key] = low + times
            left[key] -= times
            room[goal] -= times * key[1]

    def cut(key: tuple[int, int]) -> None:
        at, low = 0, next_[key]
        while at < key[1]:
            goal = max(range(len(room)), key=lambda s: (room[s], s == key[0], -s))
            stop = min(key[1], at + room[goal])
            parts.append((*key, low, low + 1, at, stop, goal))
            room[goal] -= stop - at
            at = stop
        next_[key] += 1
        left[key] -= 1

    order = sorted(left, key=lambda k: (-k[1], k[0]))
    for key in order:
        while left[key] and key[1] > max(quota):
            cut(key)
    if stay:
        for key in order:
            take(key, min(left[key], room[key[0]] // key[1]), key[0])
    for key in order:
        take(key, min(left[key], room[key[0]] // key[1]), key[0])
        while left[key] and (fits := [s for s in range(len(room)) if room[s] >= key[1]]):
            goal = min(fits, key=lambda s: (room[s], s))
            take(key, min(left[key], room[goal] // key[1]), goal)
    cuts = 0
    for key in order:
        while left[key]:
            cut(key)
            cuts += 1
    return parts, room, cuts


def balance(nodes: DataFrame, shards: int = 8, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``nodes(row long unique, grp)``, a written table -> ``(row, shard int)``; rows of one ``grp`` are linked, a null ``grp``
    links nothing."""
    spark = nodes.sparkSession
    total = nodes.count()
    quota = _quota(total, shards)
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    counts = durable(nodes.where("grp is not null").groupBy("grp", start.alias("origin")).agg(F.count(F.lit(1)).alias("n")), "counts")
    linked = counts.groupBy("grp").agg(F.sum("n").alias("all")).where("all > 1").select("grp")
    bundles = propagate(durable(counts.join(linked, "grp").withColumn("shard", F.col("origin")), "bundles"), quota, rounds)

    # each group with the shard of most of its rows, numbered among the groups of that shard and size
    by_shard = bundles.groupBy("grp", "shard").agg(F.sum("n").alias("here"))
    settled = by_shard.groupBy("grp").agg(F.sum("here").alias("n"), F.max(_own_first(shards)).alias("b")).select("grp", "n", F.col("b.shard").alias("shard"))
    groups = durable(settled, "groups")
    sizes = groups.groupBy("shard", "n").agg(F.count(F.lit(1)).alias("groups"))
    histogram = {(r["shard"], r["n"]): r["groups"] for r in sizes.collect()}
    parts, room = plan(histogram, quota)
    numbered = number_within(groups, ["shard", "n"], F.xxhash64("grp"), [F.col("grp")], "nth", buckets_for(max(histogram.values(), default=0)))
    within = numbered.join(spark.createDataFrame(parts, _PARTS), ["shard", "n"]).where((F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
    goals = durable(within.select("grp", "n", "start", "stop", "goal"), "goals")
    discard(spark, counts, bundles, groups)

    whole = F.col("stop") - F.col("start") == F.col("n")
    known = goals.where(whole).select("grp", F.col("goal").alias("shard"))
    cut = goals.where(~whole).select("grp", "start", "stop", "goal")
    marked = known.withColumn("cut", F.lit(False)).unionByName(cut.select("grp", F.lit(None).cast("int").alias("shard"), F.lit(True).alias("cut")).distinct())
    met = nodes.where("grp is not null").join(marked, "grp", "left").select("row", "shard", F.when(F.col("cut"), F.col("grp")).alias("grp"), F.col("cut").isNull().alias("alone"))
    free = nodes.where("grp is null").select("row", F.lit(None).cast("int").alias("shard"), "grp", F.lit(True).alias("alone"))
    placed = durable(met.unionByName(free), "placed")
    each = buckets_for(total)
    # of groups that are cut, of which there are ``shards`` at most, each row by its number
    rows = number_within(placed.where("grp is not null").select("row", "grp"), ["grp"], F.xxhash64("row"), [F.col("row")], "nth", each)
    dealt = rows.join(F.broadcast(cut), "grp").where((F.col("nth") >= F.col("start")) & (F.col("nth") < F.col("stop"))).select("row", F.col("goal").alias("shard"))
    single = number_within(placed.where("alone").select("row", F.lit(0).alias("all")), ["all"], F.xxhash64("row"), [F.col("row")], "nth", each)
    return placed.where("shard is not null").select("row", "shard").unionByName(dealt).unionByName(single.select("row", _where(F.col("nth"), room).alias("shard")))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row: size is the text's UTF-8 bytes plus 1, slot
    its place in the shard from 0, grown_shard null under the law ``rows``."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = durable(df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    where = durable(balance(rows.select("row", "grp"), shards), "shards")
    # a hash of its own: the one of the row alone has dealt the shards
    out = number_within(rows.drop("grp").join(where, "row"), ["shard"], F.xxhash64(F.lit("slot"), "row"), [F.col("doc_id"), F.col("row")], "slot", buckets_for(rows.count() // shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
