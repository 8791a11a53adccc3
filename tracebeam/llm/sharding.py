"""Balanced label propagation: linked documents move towards one shard under capacity quotas.

Links are given as (row, hub) pairs: all rows of a hub are linked with each other (an edge is a hub of
two), so a group of k equal texts needs k pairs, not k^2 edges. Equal texts form hubs by themselves;
``links`` adds others, and a row may be in any number of hubs, so labels travel from hub to hub. In
every round hubs count the labels of their rows, rows are drawn to the label that is commonest over
their hubs, and a label accepts the largest moves first until its quota is full. At the end each
label keeps hubs up to an even share, the refused ones go whole to labels with room, and rows without
links fill what is left. Rows are put in the order (label, hub, doc_id) and cut into runs of equal
length: shards differ by one row at most, and only the hubs on a cut are divided. Groups of equal texts
above one shard come first, each as one run. The order comes from a range sort, not from one task per
shard.

Everything is a column expression; the driver sees a few numbers per shard. Null texts have no bytes
and are no group of equal texts (nor are empty ones); null ids sort first; repeated rows are rows of
their own and get slots of their own. An empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebeam.llm.common import checked_lookup
from tracebeam.operators.skew import numbered, range_blocks, running_total
from tracebeam.session import materialize

SHARDS = 24
ROUNDS = 3
WIDEST = 1.0  # room beyond an even share in the first round
ROW_BYTES = 8
GRADES = 256


def wishes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hub, target, label): the label that most rows of a node's hubs have in common, and the
    strongest of the hubs that draw to it."""
    placed = members.join(nodes, "node")
    counts = placed.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    targets = counts.groupBy("hub").agg(
        F.max_by("label", F.struct("n", F.xxhash64("hub", "label"))).alias("target"),
        F.max("n").alias("votes"), F.sum("n").alias("rows"),
    )
    seen = checked_lookup(placed, targets, ["hub"], "shard-targets")
    drawn = seen.groupBy("node", "target", "label").agg(
        F.sum("votes").alias("votes"), F.max_by("hub", F.struct("votes", "rows", "hub")).alias("hub")
    )
    best = drawn.groupBy("node").agg(
        F.max_by(F.struct("hub", "target", "label"), F.struct("votes", "hub")).alias("w")
    )
    return materialize(best.select("node", "w.*"), "shard-wishes")


def accepted(asked: DataFrame, room: DataFrame) -> DataFrame:
    """(hub, target, gain, grade, to): ``to`` is the target if it accepts the move, else null.

    Targets accept by grade (size in doublings, then a hash) as long as the sum fits ``room`` (label,
    room).
    """
    graded = asked.withColumn(
        "grade",
        -F.floor(F.log2("gain")).cast("int") * GRADES + F.pmod(F.xxhash64("hub"), F.lit(GRADES)).cast("int"),
    )
    line = Window.partitionBy("target").orderBy("grade")
    fits = (
        graded.groupBy("target", "grade").agg(F.sum("gain").alias("gain"))
        .withColumn("upto", F.sum("gain").over(line))
        .join(F.broadcast(room.withColumnRenamed("label", "target")), "target")
        .where("upto <= room").select("target", "grade", F.col("target").alias("to"))
    )
    return graded.join(fits, ["target", "grade"], "left")


def propagate(
    members: DataFrame, nodes: DataFrame, room: list[int], rounds: int = ROUNDS
) -> DataFrame:
    """``nodes`` (node, label) with labels moved along ``members`` (node, hub).

    ``room`` is each label's even share. It counts everything that is there before the round, so no
    quota is overrun. Quotas start wide, since rows move out while others move in, and tighten.
    """
    spark = members.sparkSession
    for step in range(rounds):
        wish = wishes(members, nodes)
        quota = spark.createDataFrame(
            [(k, int(n * (1 + WIDEST / (1 + step)))) for k, n in enumerate(room)], "label int, quota long"
        )
        there = wish.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        left = quota.join(there, "label", "left").select(
            "label", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("room")
        )
        asked = wish.where("label <> target").groupBy("hub", "target").agg(F.count(F.lit(1)).alias("gain"))
        moves = accepted(asked, left).where("to is not null").select("hub", "to")
        nodes = checked_lookup(wish, moves, ["hub"], "shard-moves").select(
            "node", F.coalesce("to", "label").alias("label")
        )
    return nodes


def at_room(position: Column, room: list[int]) -> Column:
    """Label whose room, all laid end to end, holds ``position``."""
    ends = F.array(*[F.lit(n).cast("long") for n in accumulate(room)])
    return F.least(F.size(F.filter(ends, lambda x: x <= position)), F.lit(len(room) - 1)).cast("int")


def settled(members: DataFrame, nodes: DataFrame, room: list[int]) -> DataFrame:
    """(node, hub, label): each hub's rows under one label, no label above its room by more than the
    hub that reaches over its end."""
    spark = members.sparkSession
    wish = wishes(members, nodes)
    asked = wish.groupBy("hub", "target").agg(F.count(F.lit(1)).alias("gain"))
    even = spark.createDataFrame(list(enumerate(room)), "label int, room long")
    units = materialize(accepted(asked, even), "shard-units")
    left = list(room)
    for row in units.where("to is not null").groupBy("to").agg(F.sum("gain").alias("n")).collect():
        left[row["to"]] -= row["n"]
    spilled = running_total(
        range_blocks(units.where("to is null"), ["grade", "hub"]), [], ["grade", "hub"], F.col("gain"),
        "upto", block=F.col("_block"),
    ).select("hub", at_room(F.col("upto") - F.col("gain"), left).alias("label"))
    final = units.where("to is not null").select("hub", F.col("to").alias("label")).union(spilled)
    return checked_lookup(wish.drop("label", "target"), final, ["hub"], "shard-settled")


def shard(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: DataFrame | None = None
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, label (before the cut).

    ``links`` (doc_id, hub) adds hubs to those of equal texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(text != "", F.md5(F.col("text").cast("binary"))).alias("text_hash"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "shard-rows",
    )
    total = rows.count()
    per_shard = max(1, -(-total // shards))
    sizes = rows.where("text_hash is not null").groupBy("text_hash").agg(F.count(F.lit(1)).alias("alike"))
    known = materialize(
        checked_lookup(rows, sizes.where("alike > 1"), ["text_hash"], "shard-groups").withColumn(
            "huge", F.coalesce(F.col("alike") > per_shard, F.lit(False))
        ), "shard-known",
    )
    members = known.where("alike > 1 and not huge").select("node", F.xxhash64("text_hash").alias("hub"))
    if links is not None:
        named = links.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.lit("link"), F.col("hub").cast("string")).alias("hub"),
        ).distinct()
        members = members.union(known.where("not huge").join(named, "doc_id").select("node", "hub"))
    members = materialize(members, "shard-members")
    hub_nodes = members.select("node").distinct()
    first = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    nodes = known.join(hub_nodes, "node", "left_semi").select("node", first.alias("label"))
    # huge groups take the first places; what they leave of a shard is its label's room
    ahead = known.where("huge").count()
    edges = [-(-k * total // shards) for k in range(shards + 1)]
    room = [max(0, hi - max(lo, ahead)) for lo, hi in zip(edges, edges[1:])]
    placed = materialize(
        settled(members, propagate(members, nodes, room, rounds), room), "shard-placed"
    )
    left = list(room)
    for row in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        left[row["label"]] = max(0, left[row["label"]] - row["n"])
    alone = at_room(F.pmod(F.xxhash64("doc_id", "text_crc32", "node"), F.lit(max(1, sum(left)))), left)
    everything = known.join(placed, "node", "left").select(
        "doc_id", "size", "text_crc32", "text_hash", "node", "huge",
        F.when(~F.col("huge"), F.coalesce("label", alone)).alias("label"),
        F.when(~F.col("huge"), F.coalesce("hub", F.xxhash64("doc_id"))).alias("order_hub"),
    )
    ranked = numbered(everything, ["label", "order_hub", "text_hash", "doc_id", "node"], "rank")
    at = F.col("rank") - 1
    return ranked.withColumn("shard", F.floor(at * shards / F.lit(total)).cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (at - F.ceil(F.col("shard").cast("long") * total / F.lit(shards))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.coalesce("label", "shard").alias("label"),
    )
