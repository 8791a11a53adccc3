"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch is a table of counts per value bucket (exact up to 64, then six leading bits, so a quantile
is off by 1/32 of its value at most). Two sketches merge by adding counts, which Spark does map-side;
a group with too few documents uses the merged sketch of its language, then that of all documents.
The limits are learned from the tails, not fixed cutoffs: of each metric the group's middle, fifth and
ninety-fifth percentile are read off its sketch, and a document is out if it lies further beyond its tail
than ``FENCE`` times the distance from the middle to that tail. Where nineteen of twenty sound texts of a
group have the same value the distance is 0; a small floor (``METRICS``) then leaves room for a chance
character or line. On the tables of the tests the floor applies to repeated lines and, in the larger ones,
to no other metric.

Everything is a column expression. Nulls: a null text has no words and fails the base rules; null
languages or sources form groups of their own. Repeated rows are judged alike and all returned.
Empty tables give an empty result; other columns of the input pass through ``judge`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebeam.llm.common import SPACE, group_key, let, salted_lookup, words
from tracebeam.session import materialize

# fixed values: base rules of the contract
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: metric -> least distance (in its unit) from the middle to a tail
METRICS = {"word_length": 10, "symbols": 10, "dup_lines": 40, "repeats": 10}
MIN_GROUP = 200
FENCE = 4
TAIL_PERCENT = 5
# groups whose limits (a few hundred bytes) are sent to the tasks; beyond, a salted join
SENT_GROUPS = 100_000


def repeated_words(w: Column) -> Column:
    """Words inside five-word windows that occur twice or more, each word counted once."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda x, j: F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct(
                (a["n"] + p + WINDOW - F.greatest(a["end"], p)).cast("bigint").alias("n"),
                (p + WINDOW).alias("end"),
            ),
            lambda a: a["n"],
        )

    def of_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts repeat no window at all: the sort is only for the others
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(pairs, covered)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(w) >= WINDOW, let(hashes, of_windows)).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with its base counts, one row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    return docs.select(
        *keep,
        let(words(F.col("text")), of_words).alias("_w"),
        let(lines, of_lines).alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    ).select(
        *keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_l.n_lines",
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def metric_values() -> dict[str, Column]:
    """Whole-number metrics of a measured row, null where the text has no words."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    return {
        "word_length": F.expr("word_chars * 100 div nullif(n_words, 0)"),
        "symbols": F.expr("n_symbols * 1000 div nullif(n_words, 0)"),
        "dup_lines": F.when(n.isNotNull(), F.expr("n_dup_lines * 1000 div nullif(n_lines, 0)")),
        "repeats": F.expr("n_repeat_words * 1000 div nullif(n_words, 0)"),
    }


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number from 0."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per group and metric.

    Documents that fail the base rules tell nothing about sound text and are left out.
    """
    entry = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in metric_values().items()])
    )
    return (
        measured.where(~F.col("base_failed"))
        .select(*groups, entry.alias("e"))
        .groupBy(*groups, F.col("e.metric").alias("metric"), bucket(F.col("e.v")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(
    sketch: DataFrame, groups: tuple[str, str] = ("lang", "source"),
    min_group: int = MIN_GROUP, fence: int = FENCE,
) -> DataFrame:
    """(key, metric, low, high) of every group, from its own sketch or a merged, larger one.

    low = p5 - fence * (p50 - p5) and high = p95 + fence * (p95 - p50), each distance at least the
    metric's floor. Windows run over the buckets of a sketch (below 2000), never over documents.
    """
    lang, source = groups
    levels = None
    for level, key in ((0, group_key(lang, source)), (1, group_key(lang)), (2, F.lit("*"))):
        part = sketch.groupBy(F.lit(level).alias("level"), key.alias("at"), "metric", "bucket").agg(
            F.sum("n").alias("n")
        )
        levels = part if levels is None else levels.union(part)
    of_sketch = Window.partitionBy("level", "at", "metric")
    seen = levels.withColumn("seen", F.sum("n").over(of_sketch.orderBy("bucket"))).withColumn(
        "total", F.sum("n").over(of_sketch)
    )
    percentile = lambda p: F.min(F.when(100 * F.col("seen") >= p * F.col("total"), F.col("bucket")))
    tails = seen.groupBy("level", "at", "metric").agg(
        F.max("total").alias("total"), percentile(TAIL_PERCENT).alias("lo"), percentile(50).alias("mid"),
        percentile(100 - TAIL_PERCENT).alias("hi"),
    )
    keys = sketch.select(
        group_key(lang, source).alias("key"), F.explode(F.array(
            F.struct(F.lit(0).alias("level"), group_key(lang, source).alias("at")),
            F.struct(F.lit(1).alias("level"), group_key(lang).alias("at")),
            F.struct(F.lit(2).alias("level"), F.lit("*").alias("at")),
        )).alias("k"), "metric",
    ).distinct().select("key", "k.level", "k.at", "metric")
    floors = F.create_map(*[F.lit(x) for item in METRICS.items() for x in item])
    usable = keys.join(tails, ["level", "at", "metric"]).where(
        (F.col("total") >= min_group) | (F.col("level") == 2)
    )
    best = usable.groupBy("key", "metric").agg(
        F.min_by(F.struct("lo", "mid", "hi"), "level").alias("q")
    )
    least = F.element_at(floors, F.col("metric"))
    return best.select(
        "key", "metric",
        (F.col("q.lo") - fence * F.greatest(F.col("q.mid") - F.col("q.lo"), least)).alias("low"),
        (F.col("q.hi") + fence * F.greatest(F.col("q.hi") - F.col("q.mid"), least)).alias("high"),
    )


def group_limits(
    sketch: DataFrame, groups: tuple[str, str] = ("lang", "source"),
    min_group: int = MIN_GROUP, fence: int = FENCE,
) -> DataFrame:
    """(_key, _limits): the fences of a group as a map by metric."""
    return fences(sketch, groups, min_group, fence).groupBy(F.col("key").alias("_key")).agg(
        F.map_from_entries(
            F.collect_list(F.struct("metric", F.struct("low", "high").alias("f")))
        ).alias("_limits")
    )


def inside_limits() -> Column:
    """Base rules passed and every metric inside ``_limits``.

    One expression over both, so that no part of it is moved below the join and measured twice.
    """
    inside = F.lit(True)
    for metric, value in metric_values().items():
        f = F.try_element_at(F.col("_limits"), F.lit(metric))
        outside = (value < f["low"]) | (value > f["high"])
        inside = inside & ~F.coalesce(outside, F.lit(False))
    return F.least(~F.col("base_failed"), inside)


def judge(
    measured: DataFrame, groups: tuple[str, str] = ("lang", "source"),
    min_group: int = MIN_GROUP, fence: int = FENCE, id_col: str = "doc_id",
) -> DataFrame:
    """Measured rows with ``kept``: base rules passed and every metric inside its group's fence."""
    limits = group_limits(sketches(measured, groups), groups, min_group, fence)
    rows = measured.withColumn("_key", group_key(*groups))
    joined = salted_lookup(rows, limits, "_key", [id_col])
    return joined.withColumn("kept", inside_limits()).drop("_limits", "_key")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, ``base_failed`` and ``kept``.

    The texts are read once: the few numbers per document are written out, then sketched and joined.
    """
    measured = materialize(measure(docs, ["doc_id", "lang", "source"]), "quality")
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def quality_stage(docs: DataFrame) -> DataFrame:
    """Rows that pass, with all their columns.

    Each row is judged by its own text, whatever other rows have its doc_id (null included). Texts are
    measured once, and the rows written with what was measured: reading them again costs less.
    """
    whole = docs.select(F.struct("*").alias("_doc"), "text", "lang", "source")
    rows = materialize(measure(whole, ["_doc", "lang", "source"]), "quality-rows")
    limits = materialize(group_limits(sketches(rows)), "quality-limits")
    rows = rows.withColumn("_key", group_key("lang", "source"))
    if limits.count() <= SENT_GROUPS:
        joined = rows.join(F.broadcast(limits), "_key", "left")
    else:
        joined = salted_lookup(rows, limits, "_key", ["n_words", "word_chars", "n_symbols"])
    return joined.where(inside_limits()).select("_doc.*")
