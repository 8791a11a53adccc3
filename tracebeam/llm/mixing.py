"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares (by words) are raised to an exponent between 0 and 1: 1 keeps the natural mix, 0 makes
all sources equal. Bisection finds the largest exponent whose mix reaches a target entropy, then, if
a source would be repeated more often than allowed, the smallest one that keeps the repetition limit
(the limit wins). Weights times the budget give each source whole epochs and a rest; the rest is
taken from a permutation of the source: blocks in the order of a hash of (source, block, epoch),
whole blocks as long as they fit, then documents of the one block at the edge by their own hash.

The edge of a source is a pair of hashes, so a document's number of copies follows from its own row
and one small row per source; texts are never shuffled. Sums run over the 4096 blocks of a source and
the documents of one block, so no source is held in one task. Everything is a column expression.

Weights are whole numbers: a share's power is rounded to a multiple of 2^-40 once, per source, and all
sums run over whole numbers, so neither the order of summation nor the partitioning can change a budget.
With exponent 1 the weights are the token counts themselves and every source gets exactly its own
tokens back; with budget 1 that passes every document on once.

Null sources form one source. Texts without words (null, empty) weigh nothing: in a source with words
they follow their hashes, a source without any words is passed on once. Rows that share doc_id and
source share their hashes and are taken or left together at the edge. Empty tables give empty results.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebeam.llm.common import checked_lookup, group_key, words
from tracebeam.session import materialize

STEPS = 1024
ENTROPY = 0.97  # of the highest possible
REPEATS = 4.0
BUDGET = 1.0  # of the words there are
BLOCK_DIGITS = 3  # hexadecimal: 4096 blocks a source
UNIT = 1 << 40  # parts of one in a rounded power


def doc_hash(epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), epoch))


def block_of() -> Column:
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 1, BLOCK_DIGITS)


def block_hash(block: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col("source_key"), block, epoch))


def with_tokens(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(
        *keep, group_key("source").alias("source_key"), block_of().alias("block"),
        F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"),
    )


def first_step(reached, steps: int = STEPS) -> int:
    """Smallest i of 0..steps with ``reached(i)``, which holds from some i on (``steps`` if none)."""
    lo, hi = 0, steps
    while lo < hi:
        mid = (lo + hi) // 2
        if reached(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def parts(value: Column) -> Column:
    """``value`` as a whole number of ``UNIT`` parts."""
    return F.round(value * F.lit(float(UNIT))).cast("decimal(38,0)")


def power_parts(step: int) -> Column:
    """Whole-number weight of a source at exponent step / STEPS; its token count at exponent 1."""
    if step == STEPS:
        return F.col("tokens").cast("decimal(38,0)")
    return parts(F.pow("share", F.lit(step / STEPS)))


def chosen_step(totals: DataFrame, entropy: float, repeats: float, budget: float) -> int:
    """Step whose exponent fits ``totals`` (source_key, tokens, share); one small job per trial."""

    def mix(step: int):
        power = F.pow("share", F.lit(step / STEPS))
        row = totals.agg(
            F.sum(parts(power)).alias("z"), F.sum(parts(power * F.log("share"))).alias("m"),
            F.max(power / F.col("share")).alias("r"), F.count(F.lit(1)).alias("n"),
        ).first()
        return int(row["z"]) / UNIT, int(row["m"]) / UNIT, row["r"], row["n"]

    def flat_enough(step: int) -> bool:
        z, m, _, n = mix(step)
        return log(z) - step / STEPS * m / z >= entropy * log(n) - 1e-9

    def rare_enough(step: int) -> bool:
        z, _, most, _ = mix(step)
        return most / z * budget <= repeats + 1e-9

    flat = first_step(lambda i: not flat_enough(i), STEPS + 1) - 1
    return max(flat, first_step(rare_enough), 0)


def plan(
    sized: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET
) -> DataFrame:
    """(source_key, weight, epochs, edge_block, edge_doc): how often and how far each source is read.

    ``sized`` has source_key, doc_id, block, n_tokens per document.
    """
    blocks = materialize(
        sized.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks"
    )
    sums = blocks.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    totals = materialize(
        sums.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1))),
        "mix-shares",
    )
    power = power_parts(chosen_step(totals, entropy, repeats, budget) if total else STEPS)
    z = int(totals.agg(F.sum(power)).first()[0] or 1)
    # powers have 13 digits (token counts at exponent 1) and budgets 18: products fit 38
    product = power.cast("decimal(19,0)") * F.lit(int(budget * total)).cast("decimal(18,0)")
    shares = totals.select(
        "source_key", "tokens", (power.cast("double") / F.lit(float(z))).alias("weight"),
        product.alias("product"), F.lit(str(z)).cast("decimal(38,0)").alias("z"),
    )
    weights = shares.withColumn("budget", F.expr("product div z")).select(
        "source_key", "weight", F.expr("budget div tokens").alias("epochs"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )
    # running sums over the blocks of a source in the order of its last, partial epoch
    order = Window.partitionBy("source_key").orderBy("at", "block")
    placed = blocks.join(weights, "source_key").withColumn(
        "at", block_hash(F.col("block"), F.col("epochs"))
    ).withColumn("upto", F.sum("tokens").over(order))
    edges = placed.where("upto > rest").groupBy("source_key").agg(
        F.min_by(
            F.struct("at", "block", "epochs", "weight", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")),
            F.struct("at", "block"),
        ).alias("e")
    ).select("source_key", "e.*")
    inside = sized.join(
        edges.select("source_key", "block", "epochs", "left"), ["source_key", "block"]
    ).withColumn("hash", doc_hash(F.col("epochs")))
    by_hash = Window.partitionBy("source_key").orderBy("hash").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = (
        inside.withColumn("upto", F.sum("n_tokens").over(by_hash)).where("upto <= left")
        .groupBy("source_key").agg(F.max("hash").alias("edge_doc"))
    )
    return edges.join(last, "source_key", "left").select(
        "source_key", "weight", "epochs", F.col("at").alias("edge_block"),
        F.coalesce("edge_doc", F.lit("")).alias("edge_doc"),
    )


def copies(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """``rows`` (source_key, doc_id, block) with weight and ``copies``."""
    known = checked_lookup(rows, mix, ["source_key"], "mix")
    here = block_hash(F.col("block"), F.col("epochs"))
    taken = (here < F.col("edge_block")) | (
        (here == F.col("edge_block")) & (doc_hash(F.col("epochs")) <= F.col("edge_doc"))
    )
    # a source without words has no weight and is passed on once
    return known.withColumn(
        "copies", F.coalesce(F.col("epochs") + taken.cast("bigint"), F.lit(1).cast("bigint"))
    ).drop("epochs", "edge_block", "edge_doc")


def mixed(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET
) -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, epoch, weight (six digits), place.

    ``place`` orders the uses of a source within an epoch: block hash, then document hash.
    """
    sized = materialize(with_tokens(docs, ["doc_id", "source"]), "mix-sizes")
    mix = plan(sized, entropy, repeats, budget)
    used = copies(sized, mix).where("copies > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    )
    return used.select(
        "doc_id", "source", "n_tokens", "epoch", F.round("weight", 6).alias("weight"),
        F.concat(
            F.substring(block_hash(F.col("block"), F.col("epoch")), 1, 8),
            F.substring(doc_hash(F.col("epoch")), 1, 8),
        ).alias("place"),
    )


def mixing_stage(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET
) -> DataFrame:
    """Documents, each as often as the mix uses it, with the columns of ``docs``."""
    sized = materialize(with_tokens(docs, ["doc_id", "source"]), "mix-sizes")
    mix = plan(sized, entropy, repeats, budget)
    mine = [f"_in_{k}" for k in range(len(docs.columns))]
    # the input's own columns step aside, whatever their names
    rows = docs.select(
        *[docs[c].alias(m) for c, m in zip(docs.columns, mine)], F.col("doc_id"),
        group_key("source").alias("source_key"), block_of().alias("block"),
    )
    used = copies(rows, mix).where("copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    )
    return used.select(*[F.col(m).alias(c) for m, c in zip(mine, docs.columns)])
