"""Token counts of whole texts with a public tokenizer, in Arrow batches that return lengths only.

Texts are cut at safe boundaries and each distinct piece is encoded once per batch, by the library.
A boundary is safe before a space that follows a character other than white space: the byte-level
pre-tokenizer never lets a token reach from a non-space character into the white space after it, so
the counts of the pieces add up to the count of the text. Batches are balanced by bytes, not by rows:
texts are taken together until ``BATCH_BYTES``, and a longer text is worked off in several parts.

Null texts count as empty (0 bytes, 0 tokens), rows are counted one by one (repeated rows stay
repeated), an empty table gives an empty result, and only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN_LIMIT = 512
BATCH_BYTES = 4 << 20
MEMO_PIECES = 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) ")


def cut(text: str) -> list[str]:
    """Pieces of a text; all but the first have lost the one space they begin with."""
    if _SPACE_AFTER_SPACE.search(text) is None and not text.startswith(" "):
        return text.split(" ")
    return _SAFE.split(text)


class Counter:
    """Token counts by piece, remembered up to a bound; misses are encoded together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def learn(self, memo: dict[str, int], pieces: Iterable[str], lead: str) -> None:
        new = [p for p in set(pieces) if p not in memo]
        if new:
            found = self.encode([lead + p for p in new], add_special_tokens=False)
            memo.update(zip(new, map(len, found)))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, worked off in parts of about BATCH_BYTES of characters."""
        totals = [0] * len(texts)
        part: list[tuple[int, list[str], bool]] = []
        held = 0
        for at, text in enumerate(texts):
            pieces = cut(text)
            step = max(1, BATCH_BYTES // 8)
            for lo in range(0, len(pieces), step):
                part.append((at, pieces[lo : lo + step], lo == 0))
            held += len(text)
            if held >= BATCH_BYTES:
                self.add(part, totals)
                part, held = [], 0
        self.add(part, totals)
        return totals

    def add(self, part: list[tuple[int, list[str], bool]], totals: list[int]) -> None:
        if len(self.first) + len(self.later) > MEMO_PIECES:
            self.first.clear()
            self.later.clear()
        self.learn(self.first, [p[0] for _, p, start in part if start], "")
        new: set[str] = set()
        for _, pieces, start in part:
            new.update(pieces[1:] if start else pieces)
        self.learn(self.later, new, " ")
        for at, pieces, start in part:
            if start:
                totals[at] += self.first[pieces[0]] + sum(map(self.later.__getitem__, pieces[1:]))
            else:
                totals[at] += sum(map(self.later.__getitem__, pieces))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
