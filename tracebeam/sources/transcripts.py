"""Agent transcripts and chat exports as turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.functions.texts import project_path, strip
from tracebeam.functions.times import parse_iso
from tracebeam.sources.documents import file_stem, folder_name, read_documents, read_lines

BLOCKS = "array<struct<type: string, text: string, name: string, input: map<string,string>>>"
NO_TOOLS = "array<struct<name: string, input: map<string,string>>>"


def _is_list(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def _block_text(blocks: Column) -> Column:
    """Non-blank text blocks, stripped and joined by line breaks; null when there are none."""
    texts = F.transform(
        F.filter(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False))),
        lambda b: strip(F.coalesce(b["text"], F.lit(""))),
    )
    return F.nullif(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def parse_session_lines(lines: DataFrame) -> DataFrame:
    """Turns of typed session records (session_id, pos, value).

    Kept: user records with text of their own (tool results alone do not count) and assistant
    records with text or tool uses. Malformed lines and other records are left out.
    """
    record = F.try_parse_json("value")
    field = lambda path: F.try_variant_get(record, path, "string")
    rows = lines.select(
        "session_id", "pos",
        field("$.type").alias("role"),
        F.try_variant_get(record, "$.message.content", "variant").alias("content"),
        parse_iso(field("$.timestamp")).alias("ts"),
        field("$.uuid").alias("message_id"),
    ).where(F.col("role").isin("user", "assistant"))
    listed = F.coalesce(_is_list(F.col("content")), F.lit(False))
    blocks = F.when(listed, F.from_json(F.to_json("content"), BLOCKS))
    plain = F.when(
        F.schema_of_variant("content") == "STRING", F.nullif(strip(F.col("content").cast("string")), F.lit(""))
    )
    uses = F.transform(
        F.filter(F.col("blocks"), lambda b: F.coalesce(b["type"] == "tool_use", F.lit(False))),
        lambda b: F.struct(
            F.coalesce(b["name"], F.lit("")).alias("name"), b["input"].alias("input")
        ),
    )
    none = F.array().cast(NO_TOOLS)
    turns = (
        rows.withColumn("blocks", blocks)
        .withColumn("text", F.coalesce(plain, _block_text(F.col("blocks"))))
        .withColumn(
            "tool_uses", F.when(F.col("role") == "assistant", F.coalesce(uses, none)).otherwise(none)
        )
    )
    keep = F.col("text").isNotNull() | (F.size("tool_uses") > 0)
    return turns.where(keep).select(
        "session_id", "pos", "role", F.coalesce("text", F.lit("")).alias("text"), "ts",
        "message_id", "tool_uses",
    )


def sessions_of(lines: DataFrame) -> DataFrame:
    """session_id, project and modification time of the files the lines come from."""
    return lines.groupBy("path").agg(F.max("modified_at").alias("modified_at")).select(
        file_stem(F.col("path")).alias("session_id"),
        project_path(folder_name(F.col("path"))).alias("project"),
        "modified_at",
    )


def read_session_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of the session files under ``path``."""
    lines = read_lines(spark, path)
    named = lines.withColumn("session_id", file_stem(F.col("path")))
    return parse_session_lines(named), sessions_of(lines)


def parse_jsonl_turns(
    lines: DataFrame,
    role_key: str = "role",
    text_key: str = "content",
    ts_key: str | None = "timestamp",
    user_label: str = "user",
    assistant_label: str = "assistant",
) -> DataFrame:
    """Turns of JSON lines (session_id, pos, value) with configurable keys.

    The role is the label contained in the lower-cased role value; list texts are joined by line
    breaks.
    """
    record = F.try_parse_json("value")
    text_of = lambda key: F.try_variant_get(record, f"$['{key}']", "string")
    raw_role = F.lower(F.coalesce(text_of(role_key), F.lit("")))
    role = F.when(F.contains(raw_role, F.lit(user_label)), "user").when(
        F.contains(raw_role, F.lit(assistant_label)), "assistant"
    )
    content = F.try_variant_get(record, f"$['{text_key}']", "variant")
    ts = parse_iso(text_of(ts_key)) if ts_key else F.lit(None).cast("timestamp")
    rows = lines.select(
        "session_id", "pos", role.alias("role"), content.alias("content"), ts.alias("ts"),
        F.coalesce(text_of("id"), F.lit("")).alias("message_id"),
    ).where(F.col("role").isNotNull())
    return _with_text(rows)


def _joined(content: Column) -> Column:
    """Text of a variant: a string itself, or the texts of a list; other types have none."""
    kind = F.schema_of_variant(content)
    parts = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda e: F.when(
            F.startswith(F.schema_of_variant(e), F.lit("OBJECT")),
            F.coalesce(F.try_variant_get(e, "$.text", "string"), F.lit("")),
        ).otherwise(F.coalesce(e.cast("string"), F.lit(""))),
    )
    return F.when(kind == "STRING", content.cast("string")).when(
        F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n")
    )


def _with_text(rows: DataFrame) -> DataFrame:
    text = strip(_joined(F.col("content")))
    return rows.withColumn("text", text).where(F.coalesce("text", F.lit("")) != "").select(
        "session_id", "pos", "role", "text", "ts", "message_id"
    )


def read_jsonl_transcripts(spark: SparkSession, path: str | list[str], **keys) -> DataFrame:
    lines = read_lines(spark, path).withColumn("session_id", file_stem(F.col("path")))
    return parse_jsonl_turns(lines, **keys)


MESSAGE = (
    "struct<type: string, role: string, kind: string, text: variant, content: variant, "
    "markdown: variant, richText: variant, id: string, bubbleId: string>"
)
EXPORT = (
    f"struct<id: string, messages: array<{MESSAGE}>, "
    f"tabs: array<struct<id: string, tabId: string, bubbles: array<{MESSAGE}>, messages: array<{MESSAGE}>>>, "
    f"chats: array<struct<id: string, tabId: string, bubbles: array<{MESSAGE}>, messages: array<{MESSAGE}>>>>"
)
TAB_STRIDE = 1 << 32


def parse_chat_export(docs: DataFrame) -> DataFrame:
    """Turns of exported chats (path, value): tabs or chats with bubbles or messages, and/or
    top-level messages."""
    parsed = docs.select(
        file_stem(F.col("path")).alias("session_id"), F.from_json("value", EXPORT).alias("d")
    )
    filled = lambda a: F.when(F.size(a) > 0, a)
    none = F.array().cast(f"array<{MESSAGE}>")
    tabs = F.coalesce(filled(F.col("d.tabs")), F.col("d.chats"), filled(F.col("d.tabs")))
    per_tab = F.transform(
        F.coalesce(tabs, F.array().cast("array<struct<id: string, tabId: string, bubbles: "
                                        f"array<{MESSAGE}>, messages: array<{MESSAGE}>>>")),
        lambda t: F.coalesce(filled(t["bubbles"]), t["messages"], none),
    )
    groups = F.concat(per_tab, F.array(F.coalesce("d.messages", none)))
    messages = parsed.select("session_id", F.posexplode(groups).alias("tab", "messages")).select(
        "session_id", "tab", F.posexplode("messages").alias("idx", "m")
    )
    raw_role = F.lower(
        F.coalesce(*[F.nullif(F.col(f"m.{n}"), F.lit("")) for n in ("type", "role", "kind")])
    )
    role = F.when(F.contains(raw_role, F.lit("user")), "user").when(
        raw_role.rlike("ai|assistant|bot"), "assistant"
    )
    blank = lambda v: F.coalesce(
        (v.cast("string") == "") | (F.schema_of_variant(v) == "VOID")
        | ((v.cast("string") == "[]") & _is_list(v)), F.lit(True)
    )
    content = F.coalesce(
        *[F.when(~blank(F.col(f"m.{n}")), F.col(f"m.{n}"))
          for n in ("text", "content", "markdown", "richText")]
    )
    rows = messages.select(
        "session_id",
        (F.col("tab") * F.lit(TAB_STRIDE) + F.col("idx")).alias("pos"),
        role.alias("role"), content.alias("content"), F.lit(None).cast("timestamp").alias("ts"),
        F.coalesce(F.nullif(F.col("m.id"), F.lit("")), F.col("m.bubbleId"), F.lit("")).alias("message_id"),
    ).where(F.col("role").isNotNull() & F.col("content").isNotNull())
    return _with_text(rows)


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat_export(read_documents(spark, path))
