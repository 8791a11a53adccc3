"""JSON expressions that turn bad input into empty values instead of failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIM_LIST = "array<struct<claim: string, supported: string, citation: string, reason: string>>"
CLAIMS = f"struct<claims: {CLAIM_LIST}>"
# Where a reply in prose may hold its JSON object.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BARE = r'(?s)(\{[^{}]*"claims".*\})'


def string_list(col: Column) -> Column:
    """JSON array text to array<string>; null or bad text is an empty array."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def string_map(col: Column) -> Column:
    """JSON object text to map<string,string>; null or bad text is an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(col, "map<string,string>"), empty)


def _object(text: Column) -> Column:
    """The text when it is a JSON object, else null."""
    return F.when(
        F.is_variant_null(F.try_parse_json(text)).isNotNull()
        & F.substring(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), 1, 1).eqNullSafe("{"),
        text,
    )


def claims_object(text: Column) -> Column:
    """Verifier reply to its JSON object: the reply itself, a fenced block, or an embedded object."""
    fenced = F.regexp_extract(text, FENCED, 1)
    bare = F.regexp_extract(text, BARE, 1)
    return F.when(_object(text).isNotNull(), text).otherwise(
        F.when(fenced != "", _object(fenced)).otherwise(_object(bare))
    )


def claims(text: Column, cap: int = 8) -> Column:
    """Claims of a verifier reply: first ``cap`` entries, blank ones dropped, fields normalised."""
    parsed = F.from_json(claims_object(text), CLAIMS)["claims"]
    none = F.array().cast(CLAIM_LIST)
    first = F.slice(F.coalesce(parsed, none), 1, cap)

    def usable(entry: Column) -> Column:
        return F.coalesce(F.length(F.trim(entry["claim"])) > 0, F.lit(False))

    def clean(entry: Column) -> Column:
        citation, reason = entry["citation"], entry["reason"]
        supported = F.lower(F.coalesce(entry["supported"], F.lit("false")))
        return F.struct(
            F.trim(entry["claim"]).alias("claim"),
            (~supported.isin("false", "null", "0", "")).alias("supported"),
            F.when((F.trim(citation) != "") & (F.lower(citation) != "null"), citation).alias(
                "citation"
            ),
            F.when(F.trim(reason) != "", reason).alias("reason"),
        )

    return F.transform(F.filter(first, usable), clean)
