"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of 13 words (a shorter item is one window). Windows of one length share a
matcher. A block of two words looked up in the shift table tells how far the search may jump without
missing the end of a window: a block that occurs in no window allows length - 1 words at once. Where
the shift is 0, the block's bucket names the windows that end with it, and words are compared one by
one. The benchmark goes to the tasks in blocks of bounded size, a bounded number of them per pass over
the documents; there is no shuffle.

Null texts, and texts without words, have no hits; items without words match nothing; items without an
id are searched like all others and count together as one item, with no name in the hashed list. Rows
are judged one by one, so repeated rows stay repeated. An empty benchmark leaves every document clean.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.session import materialize

WINDOW = 13
BLOCK_BYTES = 2 << 20
PASS_BLOCKS = 4
PERCENT = 5

# every byte that is no part of a word becomes a space; A-Z become a-z
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """Wu-Manber tables for all windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, item: str | None, words: list[bytes]) -> None:
        m, b = self.length, self.block
        for end in range(b, len(words) + 1):  # block words[end - b:end]
            key = words[end - 1] if b == 1 else (words[end - 2], words[end - 1])
            # the nearest window end at or after this block
            away = max(0, m - end)
            if away < self.shift.get(key, self.far):
                self.shift[key] = away
            if end >= m:
                self.bucket.setdefault(key, []).append((item, words, end))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str | None]) -> None:
        m, far, shift, n = self.length, self.far, self.shift, len(words)
        if self.block == 1:
            if not self.shift.keys() & set(words):
                return
            keys = words
        else:
            keys = None
        end = m
        while end <= n:
            key = keys[end - 1] if keys else (words[end - 2], words[end - 1])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            text = words[end - m : end]
            found = False
            for item, theirs, at in self.bucket[key]:
                if theirs[at - m : at] == text:
                    items.add(item)
                    found = True
            if found:
                spans.append((end - m, end))
            end += 1


class Benchmark:
    """Matchers for a block of items, by window length."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.matchers: dict[int, Matcher] = {}
        for item, text in rows:
            words = word_list(text)
            length = min(window, len(words))
            if length:
                self.matchers.setdefault(length, Matcher(length)).add(item, words)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for matcher in self.matchers.values():
            matcher.search(words, spans, items)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def block_count(items: DataFrame, block_bytes: int) -> int:
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(1, -(-int(total) // block_bytes))


def item_block(items: DataFrame, k: int, n: int) -> list[tuple[str | None, str | None]]:
    """Hash block ``k`` of ``n`` of the items; the driver holds one block beside those sent out."""
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    rows = items.where(block == k).select(F.col("item_id").cast("string"), "text").toArrow()
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def searched(
    docs: DataFrame, items: DataFrame, window: int, block_bytes: int, keep_row: bool
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``keep_row`` also
    text and ``_row``, the other columns of ``docs`` as c0, c1, ...

    At most ``PASS_BLOCKS`` blocks of the benchmark are sent out at a time; between such passes the
    rows are written with what they have found.
    """
    spark = docs.sparkSession
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"])
           .alias("_row")] if keep_row else []),
    )
    schema = state.schema

    def search_block(sent, drop_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Benchmark(sent.value, window)
            for batch in batches:
                old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                counts, spans_out, items_out = [], [], []
                for text, spans, found in zip(batch.column(1), old_spans, old_items):
                    words = word_list(text.as_py())
                    new, names = tests.search(words)
                    if new:
                        pairs = list(zip(spans[::2], spans[1::2]))
                        spans = [x for pair in merged(pairs + new) for x in pair]
                        found = sorted(names.union(found), key=lambda x: (x is None, x or ""))
                    counts.append(len(words))
                    spans_out.append(spans)
                    items_out.append(found)
                text = pa.nulls(batch.num_rows, pa.string()) if drop_text else batch.column(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), text, pa.array(counts, pa.int64()),
                        pa.array(spans_out, pa.list_(pa.int64())),
                        pa.array(items_out, pa.list_(pa.string())),
                        *batch.columns[5:],
                    ],
                    schema.names,
                )

        return run

    n_blocks = block_count(items, block_bytes)
    sent: list = []
    for k in range(n_blocks):
        if len(sent) == PASS_BLOCKS:
            state = materialize(state, "contamination")
            while sent:
                sent.pop().destroy()
        sent.append(spark.sparkContext.broadcast(item_block(items, k, n_blocks)))
        state = state.mapInArrow(search_block(sent[-1], k == n_blocks - 1 and not keep_row), schema)
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
        lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")),
        lambda a: a["n"],
    )
    row = ["text", "_row"] if keep_row else []
    return state.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", *row).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= PERCENT * F.col("n_words"))).alias(
            "contaminated"
        ), *row,
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return searched(docs, items, window, block_bytes, keep_row=False)


def decontaminate_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows that are not contaminated, with all their columns; each is judged by its own text,
    whatever other rows have its doc_id (null included)."""
    rows = searched(docs, items, WINDOW, BLOCK_BYTES, keep_row=True)
    return rows.where(~F.col("contaminated")).select(
        *["text" if c == "text" else F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    )
