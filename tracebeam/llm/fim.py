"""Fill-in-the-middle transformation with cuts converted through a sparse exception index.

A text is cut into units (letter runs and single other characters, or code points) and two cuts make
prefix, middle and suffix. Cuts are needed in bytes (to slice the text) and in code points (to report spans). Between the
two lies an index of exceptions only: the byte position of every multibyte character and the excess
bytes summed up to it. Text between exceptions is ASCII and needs no entry: a position there is plain
arithmetic, and ``searchsorted`` on the exceptions gives the excess to add or take away. An ASCII text
has an empty index. Unit starts are counted in blocks, and only the block with the wanted unit is
searched, so a very long text costs a few bytes of memory a block beside itself.

Which documents are transformed, how, and where they are cut follows from a hash of seed and doc_id
alone, so re-runs and other partitionings give the same rows. A text that is empty or already holds a
mark stays plain. Null texts count as empty; a null doc_id is hashed as an empty id; repeated rows are
transformed alike and all returned; empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: marks, shares and seed of the contract
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
BLOCK_BYTES = 1 << 16
BATCH_BYTES = 32 << 20

SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, "
    "middle_bytes long, output string"
)


class ByteIndex:
    """Multibyte characters of a UTF-8 text: where they start and how many excess bytes they add."""

    def __init__(self, raw: np.ndarray):
        self.at = np.flatnonzero(raw >= 0xC0)  # lead bytes, by byte position
        lead = raw[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.char = self.at - self.upto[:-1]  # the same characters, by code point

    def chars(self, cut: int) -> int:
        """Code points before byte ``cut`` (a character border)."""
        return int(cut - self.upto[np.searchsorted(self.at, cut)])

    def bytes(self, cut: int) -> int:
        """Bytes before code point ``cut``."""
        return int(cut + self.upto[np.searchsorted(self.char, cut)])


class Units:
    """Unit starts of a text: the first letter of a run, and every other character."""

    def __init__(self, raw: np.ndarray, block: int = BLOCK_BYTES):
        self.raw, self.block = raw, block
        counts = [np.count_nonzero(self.starts(lo)) for lo in range(0, len(raw), block)]
        self.upto = np.cumsum([0, *counts])
        self.n = int(self.upto[-1])

    def starts(self, lo: int) -> np.ndarray:
        part = self.raw[max(0, lo - 1) : lo + self.block]
        folded = part | 0x20
        letter = (folded >= 97) & (folded <= 122) & (part < 128)
        first = np.empty(len(part), bool)
        first[0] = True
        first[1:] = ~letter[:-1]
        start = np.where(letter, first, (part & 0xC0) != 0x80)
        return start[1:] if lo else start

    def end(self, k: int) -> int:
        """Byte position after the first ``k`` units."""
        if k >= self.n:
            return len(self.raw)
        at = int(np.searchsorted(self.upto, k, "right")) - 1
        return at * self.block + int(np.flatnonzero(self.starts(at * self.block))[k - self.upto[at]])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def check_marks(marks: Sequence[str]) -> list[bytes]:
    """The marks as bytes; no mark may begin inside another or inside itself."""
    raw = [m.encode() for m in marks]
    heads = {m[:1] for m in raw}
    if len(set(raw)) != 3 or any(len(m) < 2 or m[k : k + 1] in heads for m in raw for k in range(1, len(m))):
        raise ValueError(f"marks must differ and begin with characters that occur nowhere else in them: {marks}")
    return raw


def transform(
    doc_id: int | None, raw: bytes, marks: Sequence[bytes], seed: int, plain_from: int, spm_below: int,
    unit: str = "token",
) -> tuple:
    """(n, form, prefix and middle in code points and bytes, output) of one text."""
    view = np.frombuffer(raw, np.uint8)
    index = ByteIndex(view)
    units = Units(view) if unit == "token" else None
    n = units.n if units else index.chars(len(raw))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= plain_from or any(m in raw for m in marks):
        return n, "plain", None, None, None, None, raw
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut, end = (units.end(lo), units.end(hi)) if units else (index.bytes(lo), index.bytes(hi))
    prefix_chars = index.chars(cut)
    prefix, middle, suffix = raw[:cut], raw[cut:end], raw[end:]
    p, s, m = marks
    form = "spm" if h4 % 100 < spm_below else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, form, prefix_chars, index.chars(end) - prefix_chars, cut, end - cut, b"".join(parts)


def restore(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text, rebuilt from its transformed form alone."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    at = output.index(second, len(first))
    end = output.index(m, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(m) :]
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(
    docs: DataFrame, marks: Sequence[str] = MARKS, seed: int = SEED,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, unit: str = "token",
) -> DataFrame:
    """Per row: doc_id, n, form, prefix and middle in code points and bytes (null if plain), output.

    ``unit`` is what is counted and cut between: ``token`` (letter runs, other characters) or ``char``.
    """
    signs = check_marks(marks)
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit: {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
        for batch in batches:
            rows, size = [], 0
            ids = batch.column(0).to_pylist()
            for k, (doc_id, value) in enumerate(zip(ids, batch.column(1))):
                raw = value.as_py() or b""
                rows.append((doc_id, *transform(doc_id, raw, signs, seed, plain_from, spm_below, unit)))
                size += len(raw)
                if size >= BATCH_BYTES or k == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
                    )
                    rows, size = [], 0

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, SCHEMA)


def restored(rows: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``rows`` (with output and form) plus ``restored``, the text rebuilt from these two columns."""
    signs = check_marks(marks)

    @F.pandas_udf("string")
    def rebuild(output, form):
        return output.combine(form, lambda o, f: restore(o.encode(), f, signs).decode())

    return rows.withColumn("restored", rebuild("output", "form"))


def digests(docs: DataFrame) -> DataFrame:
    """The transformation with hashes in place of texts."""
    return restored(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(F.col("restored"), 256).alias("restored_sha256"),
    )
