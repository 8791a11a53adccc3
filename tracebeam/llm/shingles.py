"""Word shingles of texts: sets, hashes, and the comparison of pairs of texts by their full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(words: list[bytes], size: int) -> set:
    """Distinct runs of ``size`` words; a shorter text is one run; no words, no runs."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int, hash_of) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    h = np.fromiter(map(hash_of, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        total += mixed(h[k : k + n] * ODD[k] + ODD[k + 1])
    return np.unique(mixed(total))


def set_sum(hashes: np.ndarray) -> int:
    """Order-free sum that names a shingle set (half of its name)."""
    return int(hashes.sum(dtype=np.uint64).view(np.int64))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    mine = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    theirs = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            a_ids = batch.column(0).to_pylist()
            for a, text_a, text_b in zip(a_ids, batch.column(2), batch.column(3)):
                text_a = text_a.as_py()
                if last[0] != text_a:
                    last = (text_a, shingle_set(word_list(text_a), shingle))
                other = shingle_set(word_list(text_b.as_py()), shingle)
                both = len(last[1] & other)
                keep.append(100 * both >= percent * (len(last[1]) + len(other) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(theirs, "b").join(mine, "a").select("a", "b", "text_a", "text_b")
        .mapInArrow(run, "a long, b long")
    )
