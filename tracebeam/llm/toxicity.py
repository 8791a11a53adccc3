"""Classifier chains over toxicity categories, trained with out-of-fold predictions.

Categories are predicted in a fixed order by linear (logistic) models over hashed word features; each
model also sees the log-odds of all earlier categories. In training these are out-of-fold: the sample
is dealt into folds by a hash of doc_id, each fold is predicted by a model fitted on the others, so a
later model never sees an earlier one's memory of its own rows.

The classifier is fitted on a sample of labelled rows of documented size (``SAMPLE`` rows: all of
them if there are fewer, else those whose hash of doc_id falls below a bound), in one task whose
memory that size bounds. Scoring runs over every row and whole text with the broadcast weights
(categories x ``FEATURES`` numbers).

A null or empty text has no words: only the intercepts speak. A null label is no label; several
labels of one doc_id each count. A category with one class only gets that class's smoothed rate. No
labels at all: every probability is 0.5 and nothing is toxic. Rows are scored one by one, repeated
rows stay repeated. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.session import materialize

SAMPLE = 20_000
FEATURES = 1 << 18
FOLDS = 4
EPOCHS = 80
RIDGE = 1e-4
CHI_SQUARED = 10.8  # one in a thousand by chance
SIGNS = tuple(b"%c" % c for c in b"!#$%&*<>=@|")
WORD_BOUNDARY = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def features(text: str | None, crc) -> np.ndarray:
    """Hashed distinct words and signs of a whole text; letters and digits make words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = set(raw.translate(WORD_BOUNDARY).split())
    found.update(s for s in SIGNS if s in raw)
    return np.unique(np.fromiter(map(crc, found), np.int64, len(found)) % FEATURES).astype(np.int32)


class Design:
    """Rows of hashed features in flat arrays, with extra dense columns."""

    def __init__(self, rows: list[np.ndarray], extra: np.ndarray):
        self.n = len(rows)
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.extra = extra

    def linear(self, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n) + dense[0] + self.extra @ dense[1:]

    def part(self, keep: np.ndarray, of_features: np.ndarray | None = None) -> Design:
        """The rows ``keep``, with all features or those marked in ``of_features``."""
        out = object.__new__(Design)
        chosen = keep[self.row]
        if of_features is not None:
            chosen &= of_features[self.flat]
        out.n, out.flat = int(keep.sum()), self.flat[chosen]
        out.row = (np.cumsum(keep) - 1)[self.row[chosen]]
        out.extra = self.extra[keep]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(design: Design, target: np.ndarray) -> np.ndarray:
    """Features whose presence depends on the category (chi-squared above CHI_SQUARED)."""
    n, p = design.n, target.sum()
    seen = np.bincount(design.flat, minlength=FEATURES).astype(float)
    hits = np.bincount(design.flat, target[design.row], FEATURES)
    spread = np.maximum(seen * (n - seen) * p * (n - p), 1e-9)
    return n * (hits * n - seen * p) ** 2 / spread > CHI_SQUARED


def fit(design: Design, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a ridge logistic regression on the telling features, by AdaGrad."""
    w, dense = np.zeros(FEATURES), np.zeros(1 + design.extra.shape[1])
    positives = target.sum()
    if design.n == 0:
        return w, dense
    if positives in (0, design.n):
        dense[0] = np.log((positives + 0.5) / (design.n - positives + 0.5))
        return w, dense
    design = design.part(np.ones(design.n, bool), telling(design, target))
    used, design.flat = np.unique(design.flat, return_inverse=True)
    v, sum_v = np.zeros(len(used)), np.full(len(used), 1e-12)
    sum_d = np.full(len(dense), 1e-12)
    # both classes weigh alike
    balance = np.where(target > 0, 0.5 / positives, 0.5 / (design.n - positives))
    for _ in range(EPOCHS):
        error = (sigmoid(design.linear(v, dense)) - target) * balance
        step_v = np.bincount(design.flat, error[design.row], len(used)) + RIDGE * v
        step_d = np.concatenate([[error.sum()], design.extra.T @ error])
        sum_v += step_v**2
        sum_d += step_d**2
        v -= 0.3 * step_v / np.sqrt(sum_v)
        dense -= 0.3 * step_d / np.sqrt(sum_d)
    w[used] = v
    return w, dense


def best_cut(score: np.ndarray, target: np.ndarray) -> float:
    """Log-odds above which out-of-fold rows count as positive: highest F1, ties to the higher cut."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + target.sum())
    # a cut lies between two different scores
    last = np.append(score[order][1:] < score[order][:-1], True)
    f1[~last] = -1
    best = int(np.argmax(f1))
    below = score[order][best + 1] if best + 1 < len(order) else score[order][best] - 1
    return float((score[order][best] + below) / 2)


def fit_chain(rows: list[np.ndarray], targets: np.ndarray, fold: np.ndarray) -> list[tuple]:
    """Per category: weights, dense weights (intercept, earlier log-odds), cut."""
    extra = np.zeros((len(rows), 0))
    chain = []
    for k in range(targets.shape[1]):
        design, target = Design(rows, extra), targets[:, k]
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            held = fold == f
            if held.any():
                w, dense = fit(design.part(~held), target[~held])
                unseen[held] = design.part(held).linear(w, dense)
        cut = best_cut(unseen, target) if 0 < target.sum() < len(target) else np.inf
        chain.append((*fit(design, target), cut))
        extra = np.column_stack([extra, np.clip(unseen, -10, 10) / 10])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], most: int) -> DataFrame:
    """(fold, features, categories...) of about ``most`` labelled documents, at most 1.1 x."""
    clean = labels.dropna(subset=["doc_id", *categories]).select(
        F.col("doc_id").cast("long").alias("_id"), *[F.col(c).cast("double").alias(c) for c in categories]
    )
    total = clean.count()
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    share = most / max(total, 1)
    drawn = clean.where(draw < int((1 << 20) * share)) if share < 1 else clean
    # of a size proven above: a few numbers for each sampled row
    sample = F.broadcast(drawn)
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(sample, "_id").select(
        F.pmod(F.xxhash64(F.col("_id") + 1), F.lit(FOLDS)).cast("int").alias("fold"), "text", *categories
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            found = pa.array([features(t.as_py(), crc32) for t in batch.column(1)], pa.list_(pa.int32()))
            rest = [batch.column(k + 2) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), found, *rest], ["fold", "features", *categories]
            )

    fields = ", ".join(f"`{c}` double" for c in categories)
    return joined.mapInArrow(run, f"fold int, features array<int>, {fields}")


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], most: int = SAMPLE) -> list[tuple]:
    """Fit the chain in one task on the bounded sample and bring back its weights."""
    sample = materialize(labelled_sample(docs, labels, categories, most), "toxicity-sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        data = pd.concat(got, ignore_index=True)
        rows = [np.asarray(r, np.int32) for r in data["features"]]
        chain = fit_chain(rows, data[list(categories)].to_numpy(), data["fold"].to_numpy())
        for k, (w, dense, cut) in enumerate(chain):
            used = np.flatnonzero(w)
            yield pd.DataFrame(
                {"k": [k], "at": [used], "w": [w[used]], "dense": [dense], "cut": [float(cut)]}
            )

    schema = "k int, at array<int>, w array<double>, dense array<double>, cut double"
    # the order of rows must not change the sums
    one = sample.repartition(1).sortWithinPartitions(*sample.columns)
    fitted = sorted(one.mapInPandas(run, schema).collect())
    chain = []
    for row in fitted:
        w = np.zeros(FEATURES, np.float32)
        w[row["at"]] = row["w"]
        chain.append((w, np.array(row["dense"]), row["cut"]))
    return chain


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"),
    most: int = SAMPLE,
) -> DataFrame:
    """Per row: doc_id, p_<category> and <category> (boolean) for each category of the chain."""
    chain = train(docs, labels, categories, most)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        model = sent.value
        for batch in batches:
            odds = np.zeros((batch.num_rows, len(categories)))
            for i, value in enumerate(batch.column(1)):
                at = features(value.as_py(), crc32)
                for k, (w, dense, _) in enumerate(model):
                    earlier = np.clip(odds[i, :k], -10, 10) / 10
                    odds[i, k] = w[at].sum(dtype=np.float64) + dense[0] + earlier @ dense[1:]
            out = [batch.column(0)]
            for k in range(len(categories)):
                cut = model[k][2] if model else np.inf
                out += [pa.array(sigmoid(odds[:, k])), pa.array(odds[:, k] > cut)]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", *[n for c in categories for n in (f"p_{c}", c)]]
    fields = ", ".join(f"p_{c} double, {c} boolean" for c in categories)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {fields}")
