"""Helpers that keep one hot key from landing in one task.

* ``salted_join``   - equi-join that splits the left rows of hot keys over several tasks.
* ``pair_join``     - equi-join with a result far larger than its sides, dealt by pairs.
* ``interval_join`` - point-in-interval join through time buckets, hot buckets salted.
* ``running_total`` - cumulative sums over a hot group by blocks of its order column.
* ``asof_join``     - last point at or before each probe, carried over blocks of a long series.
* ``counts_before`` - how many points lie before each probe, without making a pair.
* ``last_before``   - the last n points before each probe, without making the other pairs.
* ``first_per_key`` - top-n rows per key (Spark trims each map partition before the shuffle).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebeam.session import materialize

ROWS_PER_TASK = 2_000_000
PAIRS_PER_TASK = 4_000_000
PAIRS_PER_SLICE = 200_000_000
MOST_PARTITIONS = 10_000
BLOCK_ROWS = 100_000
NULL_SLICES = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys holding more than ``rows_per_task`` rows, with the number of slices each needs.

    At most ``rows(df) / rows_per_task`` keys can qualify, so the frame is a few MB even for
    10^12 rows; that bound is what allows callers to broadcast it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > rows_per_task).select(
        *keys, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_slices")
    )


def salt_many(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """Give each row of a hot key one slice, chosen by a hash of ``spread_by`` (stable on retry).

    Rows with a null key match nothing, so they may go anywhere and are spread as well.
    """
    spread = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    slices = F.when(no_key, F.lit(NULL_SLICES)).otherwise(F.coalesce("_slices", F.lit(1)))
    return df.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.pmod(spread, slices.cast("bigint")).cast("int")
    ).drop("_slices")


def salt_copies(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat each row of a hot key once per slice so that it meets every slice of the other side."""
    return df.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    ).drop("_slices")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join a large ``left`` with ``right`` where a few left keys may be very frequent.

    ``spread_by`` names columns that tell apart the left rows of one key. Results equal the plain
    join for ``inner``, ``left``, ``left_semi`` and ``left_anti``.
    """
    hot = hot_keys(left, keys, rows_per_task)
    on = [*keys, "_salt"]
    return salt_many(left, hot, keys, spread_by).join(
        salt_copies(right, hot, keys), on, how
    ).drop("_salt")


def pair_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    pairs_per_slice: int = PAIRS_PER_TASK * 10,
) -> DataFrame:
    """Inner equi-join whose result may be far larger than both sides: dealt by the pairs of each key.

    Keys of more than ``pairs_per_slice`` pairs are split over slices of the left rows (as many as all pairs
    divided by that number), and the join gets partitions by the number of pairs, as in ``interval_join``.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    loads = materialize(
        count(left, "_l").join(count(right, "_r"), list(keys)).select(*keys, (F.col("_l") * F.col("_r")).alias("_pairs")),
        "pair-loads",
    )
    pairs = loads.agg(F.sum("_pairs").alias("n")).first()["n"] or 0
    if pairs <= PAIRS_PER_TASK // 8:
        return left.join(right, list(keys))
    hot = loads.where(F.col("_pairs") > pairs_per_slice).select(
        *keys, F.ceil(F.col("_pairs") / F.lit(pairs_per_slice)).cast("int").alias("_slices")
    )
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, min(-(-pairs // PAIRS_PER_TASK), MOST_PARTITIONS))
    on = [*keys, "_salt"]
    return salt_many(left, hot, keys, spread_by).repartition(partitions, *on).join(
        salt_copies(right, hot, keys).repartition(partitions, *on), on
    ).drop("_salt")


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    at: str,
    bucket_seconds: float,
    spread_by: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All (interval, point) pairs with equal ``keys`` and ``lo <= at <= hi`` (both ends included).

    Both sides are cut into time buckets, which turns the range condition into a hash join; each
    interval is repeated only for the buckets it touches and each point sits in one bucket, so no
    pair appears twice. Buckets with many points or pairs are split into slices. The pairs may outgrow
    both sides by far, so they are counted per bucket first and the join gets partitions by their number:
    left to the bytes it reads, it would end up in as many tasks as there are cores.
    """

    def bucket(col: Column) -> Column:
        return F.floor(F.unix_micros(col) / F.lit(int(bucket_seconds * 1_000_000))).cast("bigint")

    cut_points = points.where(F.col(at).isNotNull()).withColumn("_bucket", bucket(F.col(at)))
    cut_intervals = intervals.where(F.col(lo) <= F.col(hi)).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi))))
    )
    on = [*keys, "_bucket"]
    spans = cut_intervals.groupBy(*on).agg(F.count(F.lit(1)).alias("_spans"))
    # one row per bucket, read several times below
    loads = materialize(
        cut_points.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).join(spans, on, "left").select(
            *on, "_rows", (F.col("_rows") * F.coalesce("_spans", F.lit(0))).alias("_pairs")
        ),
        "interval-loads",
    )
    slices = F.greatest(
        F.ceil(F.col("_rows") / F.lit(rows_per_task)), F.ceil(F.col("_pairs") / F.lit(PAIRS_PER_SLICE))
    )
    # as few as in hot_keys, and one more per PAIRS_PER_SLICE pairs
    hot = loads.select(*on, slices.cast("int").alias("_slices")).where("_slices > 1")
    left = salt_copies(cut_intervals, hot, on)
    right = salt_many(cut_points, hot, on, spread_by)
    pairs = loads.agg(F.sum("_pairs").alias("n")).first()["n"] or 0
    if pairs > PAIRS_PER_TASK:
        # a repartition to fewer than the session's own number may be replaced by that number
        least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(least, min(-(-pairs // PAIRS_PER_TASK), MOST_PARTITIONS))
        left = left.repartition(partitions, *on, "_salt")
        right = right.repartition(partitions, *on, "_salt")
    return (
        left.join(right, [*on, "_salt"])
        .where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
        .drop("_bucket", "_salt")
    )


def range_blocks(
    df: DataFrame, order: Sequence[str | Column], name: str = "range-blocks"
) -> DataFrame:
    """Add ``_block``: consecutive ranges of ``order`` of about equal size, whatever its values.

    The cut is sampled, so it is written out once; every later use sees the same blocks.
    """
    ranged = df.repartitionByRange(*[F.asc(c) if isinstance(c, str) else c for c in order])
    return materialize(ranged.withColumn("_block", F.spark_partition_id()), name)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order``, exact for groups of any size.

    The group is cut into blocks (the first order column divided by ``block_rows`` unless ``block``
    is given; blocks must follow the order). Each block is summed on its own; only one row per
    block goes through the per-group window that carries totals from block to block.
    """
    cut = df.withColumn("_block", F.floor(F.col(order[0]) / block_rows) if block is None else block)
    cut = cut.withColumn("_value", value)
    per_block = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_block.select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        cut.withColumn("_inside", F.sum("_value").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_carried"))
        .drop("_block", "_value", "_inside", "_carried")
    )


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Global row number from 1 in ``order`` without sorting everything in one task."""
    return running_total(
        range_blocks(df, order), [], order, F.lit(1).cast("bigint"), out, block=F.col("_block")
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark keep only n rows per key and map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(window))
    kept = ranked.where(F.col(rank or "_rank") <= n)
    return kept if rank else kept.drop("_rank")


def _in_time_blocks(points: DataFrame, probes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Points and probes of all series in one order (keys, time, side), cut into blocks of equal size.

    Rows need ``_us`` (micros), ``_side`` (order among equal times) and ``_tie``. A series of any length,
    and any number of rows of one instant, spreads over several blocks.
    """
    both = points.unionByName(probes, allowMissingColumns=True)
    return range_blocks(both, [*keys, "_us", "_side", "_tie"], name)


def asof_join(
    probes: DataFrame, points: DataFrame, keys: Sequence[str], probe_at: str, point_at: str,
    values: Sequence[str],
) -> DataFrame:
    """Each probe with the ``values`` of the last point of its series at or before ``probe_at``.

    Also gives that point's time as ``matched_at``; both are null where there is none. Of points at one
    time the largest values count. Probes with a null key or time match nothing. Both sides are sorted
    once, together; the last point of each block is carried to the next, one row per series and block.
    """
    point = F.struct(F.col(point_at).alias("matched_at"), *[F.col(v).alias(v) for v in values])
    shape = points.select(point.alias("p")).schema["p"].dataType
    usable = F.col(point_at).isNotNull()
    left = points.where(usable).select(
        *keys, F.unix_micros(point_at).alias("_us"), F.lit(0).alias("_side"), point.alias("_point"),
        F.xxhash64(*values).alias("_tie"),
    )
    right = probes.select(
        *keys, F.unix_micros(probe_at).alias("_us"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"),
        F.xxhash64(*[c for c in probes.columns if c not in keys]).alias("_tie"),
    )
    no_match = F.col("_us").isNull()
    for k in keys:
        no_match = no_match | F.col(k).isNull()
    lost = right.where(no_match).select("_probe", F.lit(None).cast(shape).alias("_last"))
    cut = _in_time_blocks(left, right.where(~no_match), keys, "asof-blocks")
    # the largest point of a block is its last one; ties at one time go to the largest values
    ends = cut.where("_point is not null").groupBy(*keys, "_block").agg(F.max("_point").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    carried = blocks.select(*keys, "_block", F.max("_end").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_us", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    seen = cut.withColumn("_inside", F.max("_point").over(inside)).where("_probe is not null")
    found = seen.join(carried, [*keys, "_block"]).select(
        "_probe", F.greatest("_inside", "_carried").alias("_last")
    )
    return found.unionByName(lost).select(
        *[F.col(f"_probe.{c}").alias(c) for c in probes.columns], "_last.matched_at",
        *[F.col(f"_last.{v}").alias(v) for v in values],
    )


def counts_before(
    probes: DataFrame, points: DataFrame, keys: Sequence[str], at: str, inclusive: str,
    counts: dict[str, Column], point_at: str,
) -> DataFrame:
    """``probes`` with, per entry of ``counts``, how many points of its series fulfil it before ``at``.

    Points at ``at`` itself count where the probe's boolean column ``inclusive`` is true. Points of one
    instant are added up first; running sums inside a block and one row per series and block carry the
    rest, so nothing grows with the number of (probe, point) pairs. Probes with a null key or time get 0.
    """
    names = list(counts)
    left = (
        points.where(F.col(point_at).isNotNull())
        .groupBy(*keys, F.unix_micros(point_at).alias("_us"))
        .agg(*[F.count_if(c).alias(f"_n_{n}") for n, c in counts.items()])
        .withColumns({"_side": F.lit(1), "_tie": F.lit(0).cast("bigint")})
    )
    right = probes.select(
        *keys, F.unix_micros(at).alias("_us"), F.when(F.col(inclusive), 2).otherwise(0).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"),
        F.xxhash64(*[c for c in probes.columns if c not in keys]).alias("_tie"),
    )
    no_match = F.col("_us").isNull()
    for k in keys:
        no_match = no_match | F.col(k).isNull()
    cut = _in_time_blocks(left, right.where(~no_match), keys, "count-blocks")
    per_block = cut.groupBy(*keys, "_block").agg(
        *[F.coalesce(F.sum(f"_n_{n}"), F.lit(0)).alias(f"_b_{n}") for n in names]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_us", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    seen = cut.withColumns(
        {f"_i_{n}": F.coalesce(F.sum(f"_n_{n}").over(inside), F.lit(0)) for n in names}
    ).where("_probe is not null")
    found = seen.join(carried, [*keys, "_block"]).select(
        "_probe", *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).alias(n) for n in names]
    )
    lost = right.where(no_match).select("_probe", *[F.lit(0).cast("bigint").alias(n) for n in names])
    return found.unionByName(lost).select(*[F.col(f"_probe.{c}").alias(c) for c in probes.columns], *names)


def last_before(
    probes: DataFrame, points: DataFrame, keys: Sequence[str], probe_at: str, point_at: str,
    order: Sequence[str], n: int,
) -> DataFrame:
    """Each probe with the last ``n`` points of its series before ``probe_at`` (points at it left out).

    Of points at one time those first in ``order`` count as the latest. Both sides are sorted once,
    together; points are numbered along their series, by running counts inside a block and one row per
    series and block, and a probe meets its last ``n`` numbers. Rows with a null key or time match nothing.
    """
    present = lambda at: [F.col(c).isNotNull() for c in (*keys, at)]
    ties = [f"_tie{i}" for i in range(len(order))]
    left = points.where(functools.reduce(Column.__and__, present(point_at))).select(
        *keys, F.unix_micros(point_at).alias("_us"), F.lit(1).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(order, ties)],
        F.struct(*[F.col(c) for c in points.columns if c not in keys]).alias("_point"),
    )
    right = probes.where(functools.reduce(Column.__and__, present(probe_at))).select(
        *keys, F.unix_micros(probe_at).alias("_us"), F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns if c not in keys]).alias("_probe"),
        # many probes of one time still spread over blocks
        F.xxhash64(*[c for c in probes.columns if c not in keys]).alias("_spread"),
    )
    along = [F.asc("_us"), F.asc("_side"), *[F.desc(t) for t in ties]]
    both = left.unionByName(right, allowMissingColumns=True)
    cut = range_blocks(both, [*[F.asc(k) for k in keys], *along, F.asc("_spread")], "last-blocks")
    per_block = cut.groupBy(*keys, "_block").agg(F.count("_point").alias("_points"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "_block", F.coalesce(F.sum("_points").over(earlier), F.lit(0)).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*along).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # numbers go into two joins; equal points must keep theirs, so they are written once
    counted = materialize(
        cut.withColumn("_inside", F.count("_point").over(inside))
        .join(carried, [*keys, "_block"])
        .select(*keys, "_point", "_probe", (F.col("_inside") + F.col("_carried")).alias("_number")),
        "last-numbers",
    )
    # a probe before the first point of its series meets none
    wanted = counted.where("_probe is not null and _number > 0").select(
        *keys, "_probe",
        F.explode(F.sequence(F.greatest(F.col("_number") - (n - 1), F.lit(1)), F.col("_number"))).alias("_number"),
    )
    met = wanted.join(counted.where("_point is not null").drop("_probe"), [*keys, "_number"])
    return met.select(*keys, "_probe.*", "_point.*")
