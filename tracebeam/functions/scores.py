"""Numeric expressions: vectors, decay, confidence, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence penalties and bands.
PENALTY_PER_UNSUPPORTED_CLAIM = 0.30
PENALTY_FLOOR = 0.20
GREEN_FROM = 0.6
YELLOW_FROM = 0.3


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null when a norm is zero or sizes differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def unit_vector(v: Column) -> Column:
    """``v`` scaled to length one (doubles); null for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def decay(seconds: Column, half_life: float) -> Column:
    """Halves every ``half_life`` seconds; one at or before zero."""
    return F.when(seconds <= 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.exp(-F.log(F.lit(2.0)) * seconds / F.lit(float(half_life))))
    )


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def claim_multiplier(unsupported: Column) -> Column:
    """Each unsupported claim takes 0.3 off a factor of one, down to 0.2."""
    count = F.greatest(unsupported, F.lit(0))
    return F.greatest(
        F.lit(PENALTY_FLOOR), F.lit(1.0) - F.lit(PENALTY_PER_UNSUPPORTED_CLAIM) * count
    )


def rounded_score(x: Column, digits: int) -> Column:
    """A score from 0 to 1 rounded half up. ``round`` goes through a decimal text of each value, which is
    the larger part of the work where there is a row per pair."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def band(confidence: Column) -> Column:
    return (
        F.when(confidence >= GREEN_FROM, "green")
        .when(confidence >= YELLOW_FROM, "yellow")
        .otherwise("red")
    )


def token_estimate(text: Column) -> Column:
    """Rough token count: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def call_cost(
    input_tokens: Column, output_tokens: Column, usd_in: Column, usd_out: Column
) -> Column:
    """Cost of one call from prices in USD per million tokens."""
    return input_tokens / F.lit(1e6) * usd_in + output_tokens / F.lit(1e6) * usd_out


def shift_ratio(before: Column, after: Column) -> Column:
    """after / before; null without a usable baseline."""
    return F.when(before.isNotNull() & (before != 0) & after.isNotNull(), after / before)


def is_shift(ratio: Column, threshold: float = 1.5) -> Column:
    """True unless the ratio lies strictly between 1/threshold and threshold."""
    return ratio.isNotNull() & ~((ratio > 1.0 / threshold) & (ratio < threshold))


def shift_confidence(ratio: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(ratio - 1.0) / F.lit(5.0))


CONFIDENCE_COLUMNS = ("score", "retrieval_strength", "causal_confidence")


def confidence_is_valid() -> Column:
    """Scores within [0, 1] and a non-negative evidence count; nulls are invalid."""
    checks = [F.col(name).between(0.0, 1.0) for name in CONFIDENCE_COLUMNS]
    checks.append(F.col("evidence_count") >= 0)
    ok = checks[0]
    for check in checks[1:]:
        ok = ok & check
    return F.coalesce(ok, F.lit(False))


def validate_confidence(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected) rows instead of failing the job."""
    return df.where(confidence_is_valid()), df.where(~confidence_is_valid())
