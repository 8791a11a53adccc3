"""Exact links between components among texts that share a signature, without a row for each pair.

Only texts whose signatures still hold several components are looked at: a token that no other component
holds cannot be shared with one, which drops most texts. The rest form clusters by their signatures, are
tested in the same way within these, and meet in blocks whose overlaps are counted by matrix products over
token columns. No pair is emitted but the few that join two components, so a crowd of near copies costs
arithmetic, not rows, and no link between texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.llm.common import components, sized
from tracebeam.llm.postings import bucket_bits, met, several_labels
from tracebeam.llm.shingles import shingle_hashes, word_list
from tracebeam.session import forget, materialize

BLOCK_TOKENS = 4_000_000
COLUMNS = 8192


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def meetings(signed: DataFrame) -> DataFrame:
    """(id, leader, n): in how many signatures a text meets the most central text of the signature."""
    central = signed.groupBy("sig").agg(F.min(F.struct("rim", "id")).alias("leader"), F.count(F.lit(1)).alias("n"))
    groups = materialize(central.where("n > 1").select("sig", "leader.id").withColumnRenamed("id", "leader"), "signature-groups")
    return (
        signed.join(groups, "sig").where("id <> leader")
        .groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    )


def open_texts(signed: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(key, id, label, n, tokens) of texts that meet a text of another component in a signature."""
    labelled = signed.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "sig", "id", F.coalesce("component", "id").alias("label")
    )
    several = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    undecided = materialize(
        labelled.join(materialize(several.select("sig"), "open-signatures"), "sig")
        .select(F.col("id").alias("doc_id"), "label").distinct(),
        "undecided",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                words = [word_list(t.as_py()) for t in part.column(2)]
                sets = [
                    (shingle_hashes(w, shingle, xxhash.xxh3_64_intdigest) if w else np.empty(0, np.uint64)).view(np.int64)
                    for w in words
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), lists(sets)],
                    ["id", "label", "n", "tokens"],
                )

    return materialize(
        texts.join(undecided, "doc_id").select("doc_id", "label", "text")
        .mapInArrow(run, "id long, label long, n long, tokens array<long>")
        .withColumn("key", F.monotonically_increasing_id()),
        "open-items",
    )


def able_texts(items: DataFrame, percent: int) -> DataFrame:
    """``items`` that can still be similar to one of another component, with all their tokens.

    A token speaks for a text if a text of another component holds it; bits that tell the tokens apart are
    enough here, as one that is taken for another only keeps a text.
    """

    def foreign(token: np.ndarray, key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        return np.unique(key[several_labels(token, label)], return_counts=True)

    found = met(items, ["key", "label"], bucket_bits(items), True, foreign, "key long, common long")
    sums = found.groupBy("key").agg(F.sum("common").alias("common"))
    # joined without the tokens first: few are left, and the lists need no shuffle to meet them
    enough = items.select("key", "n").join(sums, "key").where(F.lit(100) * F.col("common") >= percent * F.col("n"))
    return materialize(items.join(sized(enough.select("key"), "able-keys"), "key", "left_semi"), "able-texts")


def able_in_clusters(items: DataFrame, percent: int) -> DataFrame:
    """``items`` that can still be similar to one of another component of their cluster, with the tokens that
    such ones hold too."""

    def foreign(token: np.ndarray, key: np.ndarray, label: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, ...]:
        common = several_labels(token, label, cluster)
        return key[common], token[common]

    found = met(items, ["key", "label", "cluster"], bucket_bits(items), False, foreign, "key long, token long")
    common = found.groupBy("key").agg(F.collect_list("token").alias("tokens"))
    return materialize(
        items.drop("tokens").join(common, "key").where(F.lit(100) * F.size("tokens") >= percent * F.col("n")),
        "open-tokens",
    )


def open_items(
    signed: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """(key, cluster, label, n, tokens) of texts that may still be similar to one of another component.

    Clusters are made of the texts that are left once those without enough tokens in common with any
    other component are gone, so passages that many texts share do not tie them together.
    """
    opened = open_texts(signed, labels, texts, shingle)
    left = able_texts(opened, percent)
    forget(opened)
    ids = materialize(left.select("id").distinct(), "able-ids")
    pairs = meetings(signed.join(ids, "id", "left_semi"))
    clusters = components(pairs.select(F.col("id").alias("a"), F.col("leader").alias("b")), "clusters")
    placed = left.join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    return able_in_clusters(placed, percent)


def overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of all intersections of sets of ``one`` with sets of ``two``, ``columns`` tokens at a time."""
    sides = []
    for sets in (one, two):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((rows, np.concatenate(sets)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(one), len(two)), np.int64)
    placed = []
    for rows, tokens in sides:
        at = np.searchsorted(both, tokens)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == tokens) if len(both) else np.zeros(len(tokens), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((rows[hit][order], at[hit][order]))
    for lo in range(0, len(both), columns):
        dense = []
        for (rows, at), sets in zip(placed, (one, two)):
            a, b = np.searchsorted(at, (lo, lo + columns))
            m = np.zeros((len(sets), min(columns, len(both) - lo)), np.float32)
            m[rows[a:b], at[a:b] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def joins(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that a link between two blocks joins; no more than it takes to connect them."""
    (labels_a, n_a, sets_a), (labels_b, n_b, sets_b) = one, two
    labels_a, labels_b = np.array(labels_a), np.array(labels_b)
    if len(np.unique(np.concatenate([labels_a, labels_b]))) < 2:
        return []
    both = overlaps(sets_a, sets_b)
    union = np.array(n_a)[:, None] + np.array(n_b)[None, :] - both
    i, j = np.nonzero((100 * both >= percent * union) & (labels_a[:, None] != labels_b[None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    pairs = np.unique(np.stack([np.minimum(labels_a[i], labels_b[j]), np.maximum(labels_a[i], labels_b[j])]), axis=1)
    for a, b in pairs.T.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def block_links(items: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): labels of different components of a cluster that a similar pair of texts joins."""
    # the texts of a cluster's commonest component need not meet one another: they are side 0
    parts = items.groupBy("cluster", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("tokens")).alias("tokens")
    )
    of_cluster = parts.groupBy("cluster").agg(
        F.max(F.struct("rows", "label")).alias("most"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("labels"),
    ).where("labels > 1")
    main = parts.withColumnRenamed("label", "main").select("cluster", "main", F.col("tokens").alias("main_tokens"))
    in_blocks = lambda rows, tokens: F.greatest(
        F.ceil(rows / block), F.ceil(tokens / BLOCK_TOKENS)
    ).cast("int")
    sizes = of_cluster.select("cluster", F.col("most.label").alias("main"), "most.rows", "tokens", F.col("rows").alias("all")).join(
        main, ["cluster", "main"]
    ).select(
        "cluster", "main", in_blocks(F.col("rows"), F.col("main_tokens")).alias("main_blocks"),
        in_blocks(F.col("all") - F.col("rows"), F.col("tokens") - F.col("main_tokens")).alias("blocks"),
    )
    cut = items.join(materialize(sizes, "cluster-blocks"), "cluster").withColumn(
        "mine", F.when(
            F.col("label") == F.col("main"), F.pmod(F.xxhash64("key"), F.col("main_blocks")).cast("int") + F.col("blocks")
        ).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")),
    )
    # blocks of other components meet each other and those of the commonest, which come after them
    placed = cut.select(
        "cluster", F.explode(F.sequence(F.lit(0), F.when(F.col("mine") < F.col("blocks"), F.col("blocks") + F.col("main_blocks")).otherwise(F.col("blocks")) - 1)).alias("other"),
        "mine", "label", "n", "tokens",
    ).select(
        "cluster", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "label", "n",
        "tokens",
    )
    keys = ["cluster", "x", "y"]
    grouped = placed.repartition(*keys).sortWithinPartitions(*keys, "mine")

    def links_of(group: tuple, held: dict) -> list[tuple[int, int]]:
        one = held.get(group[1])
        two = held.get(group[2])
        return joins(one, two, percent) if one and two else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple = ()
        held: dict[int, tuple[list, list, list]] = {}
        found: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *key, mine, label, n, tokens in zip(*columns, batch.column(6)):
                if tuple(key) != group:
                    if group:
                        found += links_of(group, held)
                    group, held = tuple(key), {}
                of_block = held.setdefault(mine, ([], [], []))
                of_block[0].append(label)
                of_block[1].append(n)
                of_block[2].append(tokens.values.to_numpy())
        if group:
            found += links_of(group, held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]
        )

    return grouped.mapInArrow(run, "a long, b long").distinct()
