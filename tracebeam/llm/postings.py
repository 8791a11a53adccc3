"""Who else holds a token: rows with lists of tokens meet by token in one shuffle of packed postings.

A task deals the tokens of its rows into buckets by their lowest bits and packs what falls into a bucket into
a few byte columns, as narrow as the values allow. All postings of a token meet in its bucket, are looked at
there and come back as rows of the few that matter. A plain join on the token would shuffle a wide row for
every posting twice: for the counts, and for the rows that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_TOKENS = 1 << 18
SLICE_TOKENS = 1 << 19
LEAST_BITS = 8


def squeezed(values: np.ndarray) -> tuple[int, bytes]:
    """The least value, and the distances from it in as few bytes each as hold the longest."""
    base = values.min()
    rest = (values - base).view(np.uint64)
    longest = int(rest.max())
    width = next(w for w in (1, 2, 4, 8) if longest < 1 << 8 * w)
    return int(base), rest.astype(f"<u{width}").tobytes()


def loosened(base: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.uint64).view(np.int64) + np.int64(base)


def bucket_bits(items: DataFrame) -> int:
    """Lowest bits of the tokens that tell buckets of about ``BUCKET_TOKENS`` postings apart."""
    total = items.agg(F.sum(F.size("tokens"))).first()[0] or 1
    return max(LEAST_BITS, (total // BUCKET_TOKENS).bit_length())


def packed(items: DataFrame, names: Sequence[str], bits: int, short: bool) -> DataFrame:
    """The postings of ``items`` (long columns ``names``, tokens) by bucket; ``short`` cuts tokens to 32 more bits."""
    columns = [*names, "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            lists = batch.column(len(names))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_TOKENS)))
                lengths = np.diff(np.concatenate([[done], ends[start:stop]]))
                tokens = lists.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                made = _dealt(batch, names, start, lengths, tokens, mask, bits, short)
                if made is not None:
                    yield made
                start = stop

    schema = "bucket long, n long, " + ", ".join(f"{c}_base long, {c}_data binary" for c in columns)
    return items.select(*names, "tokens").mapInArrow(run, schema)


def _dealt(batch, names, start, lengths, tokens, mask, bits, short) -> pa.RecordBatch | None:
    if not len(tokens):
        return None
    of_bucket = (tokens & mask).astype(np.int64)
    order = np.argsort(of_bucket, kind="stable")
    of_bucket = of_bucket[order]
    rest = tokens[order] >> np.uint64(bits)
    if short:
        rest &= np.uint64(0xFFFFFFFF)
    at = np.repeat(np.arange(start, start + len(lengths)), lengths)[order]
    values = [batch.column(k).to_numpy(zero_copy_only=False)[at] for k in range(len(names))] + [rest.view(np.int64)]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of_bucket)) + 1, [len(of_bucket)]])
    out: list[list] = [of_bucket[cuts[:-1]].tolist(), np.diff(cuts).tolist()]
    for column in values:
        parts = [squeezed(column[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        out += [[p[0] for p in parts], [p[1] for p in parts]]
    kinds = [pa.int64(), pa.int64(), *[pa.int64(), pa.binary()] * len(values)]
    fields = ["bucket", "n", *[f"{c}_{part}" for c in (*names, "token") for part in ("base", "data")]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], fields)


def met(
    items: DataFrame, names: Sequence[str], bits: int, short: bool,
    look: Callable[..., Sequence[np.ndarray]], schema: str,
) -> DataFrame:
    """``look(token, *names)`` over all postings of a bucket, as arrays; it gives the columns of ``schema``."""
    columns = [*names, "token"]

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_pylist()
        read = lambda c: np.concatenate([
            loosened(base, data, n)
            for base, data, n in zip(group.column(f"{c}_base").to_pylist(), group.column(f"{c}_data").to_pylist(), sizes)
        ])
        values = {c: read(c) for c in columns}
        token = values["token"] << bits | group.column("bucket")[0].as_py()
        found = look(token, *[values[c] for c in names])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(out, found)})

    out = [part.split()[0] for part in schema.split(", ")]
    return packed(items, names, bits, short).groupBy("bucket").applyInArrow(run, schema)


def several_labels(token: np.ndarray, label: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Which postings have a token that postings of another label hold too (of the same ``within``)."""
    keys = (label, token) if within is None else (label, token, within)
    order = np.lexsort(keys)
    change = np.concatenate([[True], np.any([np.diff(k[order]) != 0 for k in keys[1:]], axis=0)])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(order)]]) - 1
    sorted_label = label[order]
    out = np.empty(len(order), bool)
    out[order] = np.repeat(sorted_label[first] != sorted_label[last], last - first + 1)
    return out
