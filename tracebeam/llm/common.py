"""Helpers shared by the corpus operators: reading, one-row bindings, salted lookups, components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.session import configure, materialize

# fixed values: white space and words of the contracts
SPACE = r"[ \t-\r]+"
SALTS = 16
# rows of at most 64 bytes each: 64 MB
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs without white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def group_key(*cols: str) -> Column:
    """One string for a tuple of group columns in which nulls equal each other."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in cols]
    return F.concat_ws("\x1f", *parts)


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str | Sequence[str], spread_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left join of ``rows`` with one row per key of ``lookup``; a hot key meets ``salts`` copies.

    No side is broadcast by hint: adaptive execution does so where the measured size allows it.
    """
    spread = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [key] if isinstance(key, str) else list(key)
    return spread.join(copies, [*keys, "_salt"], "left").drop("_salt")


def sized(small: DataFrame, name: str, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` written out; marked for broadcast only if it is counted at ``most_rows`` or fewer.

    Beyond that the join falls back to Spark's shuffle join.
    """
    written = materialize(small, name)
    return F.broadcast(written) if written.count() <= most_rows else written


def checked_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Left join with a lookup of one row per key: broadcast below a counted bound, salted above."""
    written = materialize(lookup, name)
    if written.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(written), list(keys), "left")
    return salted_lookup(rows, written, keys, rows.columns)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id (null included) is not in ``gone``."""
    ids = sized(gone.select(F.col(id_col).alias("_gone")).distinct(), "gone-ids")
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (long columns a, b); component = smallest node.

    Alternating large-star and small-star steps: each round hangs the neighbours of a node on the
    smallest of them, so paths shrink geometrically and no step holds a component in one task. A
    node's neighbours are reduced by ``min`` before they are shuffled. Each round is written out.
    """
    tree = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    before = None
    for _ in range(rounds):
        both = tree.union(tree.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: larger neighbours hang on the smallest node of the neighbourhood
        # (the centre of a large component is a hot key, hence the salt)
        large = salted_lookup(
            tree.select(F.col("b").alias("a"), F.col("a").alias("v")), least, "a", ["v"]
        ).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself hang on the smallest
        large = large.distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lows, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lows.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        tree = materialize(small, name)
        state = tree.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("a"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = tree.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
