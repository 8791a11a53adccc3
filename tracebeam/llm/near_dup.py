"""Near-duplicate components by trees of MinHash prefixes, confirmed on full sets.

Texts with equal shingle sets are folded first. A signature holds ``TREES`` sequences of ``DEPTH``
min-hashes; in each tree, signatures that agree in the first ``LEAST_DEPTH`` values form a region, whose
members are candidates. Where a region is dense, members also look for partners that agree in all
``DEPTH`` values. Regions are equal prefixes of these two depths: the signatures are not sorted and no
longest common prefixes are measured, as in a forest with free depth (the README says why).

Round 1 confirms each text against the few region leaders it meets most often, and links what it
confirms into components. Round 2 (``crowds``) takes the texts of regions that still hold more than one
component: what their sets could share with another component decides who stays, and the rest meet in
blocks that count all overlaps of full sets and name only the components that a link joins. Pairs inside
a component cannot change the result and are never made, and no pair is written in round 2, however
many texts of a crowd are alike. A pair of similarity 0.8 shares no region with probability
(1 - 0.8^4)^24 = 3e-6; nothing else is left out.

No task holds a region. Texts are shuffled only if they are candidates.

Null and wordless texts have empty sets, link with nothing and stay. Rows that share a doc_id are one
document: if one is linked all are. Rows without a doc_id are returned with a null component and
stay. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.llm.common import components, salted_lookup
from tracebeam.llm.crowds import block_links, open_items
from tracebeam.llm.shingles import (  # noqa: F401  (shingle_set is used by callers)
    ODD,
    confirmed,
    mixed,
    set_sum,
    shingle_hashes,
    shingle_set,
    word_list,
)
from tracebeam.session import materialize

SHINGLE = 5
PERCENT = 80
TREES, LEAST_DEPTH, DEPTH = 24, 4, 8
VALUE_BYTES = 2
DENSE = 32
BLOCK = 256
LEADERS = 2

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_values(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, folded into the lower 16 bits, one for each of ``a``, ``b``."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        values = low[at : at + 512, None] * a + high[at : at + 512, None] * b
        np.minimum(least, values.min(axis=0), out=least)
    return least ^ (least >> np.uint32(16))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, two bytes each, for all places of all trees."""
    return least_values(hashes, _A, _B).astype(">u2")


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig): set size, two order-free sums that name the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for value in batch.column(1):
                words = word_list(value.as_py())
                if not words:
                    n.append(0), hi.append(0), lo.append(0), sig.append(None)
                    continue
                hashes = shingle_hashes(words, shingle, hash_of)
                n.append(len(hashes))
                hi.append(set_sum(hashes))
                lo.append(int(mixed(hashes + ODD[9]).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "hi", "lo", "sig"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, hi long, lo long, sig binary"
    )


def regions(heads: DataFrame) -> DataFrame:
    """(tree, near, deep, id, leader, n): members of all regions of two or more.

    The sizes are written out first, so that both sides of the join are plain shuffles (or the sizes
    are broadcast) and adaptive execution can split a region that holds a large share of the rows.
    """
    tree_bytes = DEPTH * VALUE_BYTES
    rows = heads.select(
        F.col("doc_id").alias("id"), "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    ).select(
        "tree", "id",
        F.col("sig").substr(F.col("tree") * tree_bytes + 1, F.lit(LEAST_DEPTH * VALUE_BYTES)).alias("near"),
        F.col("sig").substr(F.col("tree") * tree_bytes + 1, F.lit(tree_bytes)).alias("deep"),
    )
    size = rows.groupBy("tree", "near").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
    return rows.join(materialize(size.where("n > 1"), "region-sizes"), ["tree", "near"])


def leader_pairs(members: DataFrame, leaders: int, dense: int) -> DataFrame:
    """(a, b): each text with the leaders that most of its regions have in common with it."""
    # written first, as the sizes in ``regions``, so that adaptive execution can split a hot region
    deep = materialize(
        members.where(F.col("n") > dense).groupBy("tree", "deep").agg(F.min("id").alias("leader")), "deep-leaders"
    )
    votes = (
        members.select("id", "leader")
        .union(members.where(F.col("n") > dense).select("tree", "deep", "id")
               .join(deep, ["tree", "deep"]).select("id", "leader"))
        .where("id <> leader")
        .groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    )
    # at most two leaders per tree and text, so the list is short
    best = votes.groupBy("id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "leader"))), 1, leaders)
        .alias("best")
    )
    return best.select(F.explode("best.leader").alias("a"), F.col("id").alias("b"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
    leaders: int = LEADERS, dense: int = DENSE, block: int = BLOCK,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked doc_id), kept."""
    sets = materialize(signatures(docs, shingle), "signatures")
    names = ["hi", "lo", "n_shingles"]
    copies = (
        sets.where("n_shingles > 0 and doc_id is not null").groupBy(*names)
        .agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").drop("copies")
    )
    placed = salted_lookup(sets, materialize(copies, "copies"), names, ["doc_id", "hi"]).withColumn(
        "head", F.coalesce("head", "doc_id")
    )
    heads = placed.where("n_shingles > 0 and doc_id = head").select("doc_id", "hi", "n_shingles", "sig")
    members = materialize(regions(heads), "regions")

    ids = materialize(members.select(F.col("id").alias("_id")).distinct(), "candidates")
    texts = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(ids, F.col("doc_id") == F.col("_id"), "left_semi"),
        "candidate-texts",
    )
    tried = materialize(leader_pairs(members, leaders, dense), "leader-pairs")
    linked = materialize(confirmed(tried, texts, shingle, percent), "linked")
    labels = components(linked)
    signed = members.select(F.xxhash64("tree", "near").alias("sig"), "id", F.lit(0).alias("rim"))
    more = block_links(open_items(signed, labels, texts, shingle, percent), percent, block)
    labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    named = salted_lookup(
        placed.select("doc_id", "n_shingles", "head"), labels.withColumnRenamed("node", "head"), "head", ["doc_id"]
    ).withColumn("component_id", F.coalesce("component", "head"))
    return named.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def near_dup_stage(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id (rows without one come last).

    Every row is a text of its own here, whatever other rows have its doc_id: of several rows of one id
    each is judged by its text, and exact copies under one id, or without any, fold to one row. The rows
    are written once under a key; texts without words stay.
    """
    mine = [f"_in_{k}" for k in range(len(docs.columns))]
    keyed = materialize(
        docs.select(*[docs[c].alias(m) for c, m in zip(docs.columns, mine)])
        .withColumn("_row", F.monotonically_increasing_id()),
        "stage-rows",
    )
    held = dict(zip(docs.columns, mine))
    found = near_duplicates(
        keyed.select(F.col("_row").alias("doc_id"), F.col(held["text"]).alias("text")), shingle, percent
    ).select(F.col("doc_id").alias("_row"), "component_id")
    # most texts are alone; a group of copies is reduced to its first row before the shuffle
    groups = materialize(
        found.where("component_id <> _row").select("component_id").distinct(), "stage-groups"
    )
    members = found.join(groups, "component_id").join(
        keyed.select("_row", F.col(held["doc_id"]).cast("long").alias("doc_id")), "_row"
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = members.groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    gone = members.join(materialize(first.select("_row"), "stage-first"), "_row", "left_anti").select("_row")
    kept = keyed.join(materialize(gone, "stage-gone"), "_row", "left_anti")
    return kept.select(*[F.col(m).alias(c) for m, c in zip(mine, docs.columns)])
