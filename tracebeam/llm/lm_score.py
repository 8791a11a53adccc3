"""Language-model scores: prediction by partial matching over bytes, beside a unigram base score.

The model is a trie of byte contexts up to ``order`` bytes long. Spark counts (context, next byte) over all
texts and sums the shorter contexts from the longest. Escape probabilities follow method C: a context
seen T times with q different followers gives c / (T + q) to a follower and q / (T + q) to the escape.
After an escape the shorter context is asked without the symbols the longer one has already offered
(exclusion), down to all bytes alike. Whatever follows a context also follows its shorter one, so what is
excluded is always the followers of the context just left: a sum and a number for each context say it all.
As training counts do not change while scoring, the log-probability of every (context, byte) that any
text holds is worked out once, by joins from the longest context down, and documents look them up. The
trie is a table and may grow with the corpus; the most frequent entries (a bounded list) are sent to the
tasks, all others meet their documents in a join. Starts and ends of texts are the bytes 254 and 255,
which no UTF-8 text holds.

Word counts are an ordinary aggregation. To score, the most frequent words (a bounded list) are sent
to the tasks; all other words meet their counts in a join, so no vocabulary has to fit in memory and
no frequent word is shuffled.

Null texts count as empty: one end token, and the model's probability of an end at once. Held-out
rows score with the same counts. Rows that repeat as a whole are scored each. An empty table gives an
empty result; with no training rows the base score is that of N = V = 0. A null doc_id is in training
(its remainder is unknown, so not 2). Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.session import materialize

HEAD_WORDS = 400_000
HEAD_GRAMS = 1_000_000
ORDER = 5
START, END = 254, 255
FOLDS, HELD_FOLD = 7, 2
CHUNK_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def held_out(doc_id):
    return F.coalesce(
        F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False)
    )


# -- byte model -----------------------------------------------------------------------------------


def pieces(raws: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, gram) of every byte and end, about a megabyte at a time: its text, and context and byte as one number."""
    edge, owners, parts, size = bytes([START]) * order, [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        symbols = np.frombuffer(b"".join(parts), np.uint8)
        n = len(symbols) - order
        codes = np.zeros(n, np.int64)
        for k in range(order + 1):
            codes = codes << 8 | symbols[k : k + n]
        # each part begins with ``order`` bytes of context, so no context reaches into the part before
        begins = np.cumsum([0, *map(len, parts[:-1])])
        inside = np.ones(len(symbols), bool)
        inside[(begins[:, None] + np.arange(order)).ravel()] = False
        return np.repeat(owners, [len(p) - order for p in parts]), codes[inside[order:]]

    for k, raw in enumerate(raws):
        whole = edge + raw + bytes([END])
        for lo in range(0, len(raw) + 1, CHUNK_BYTES):
            parts.append(whole[lo : lo + CHUNK_BYTES + order])
            owners.append(k)
            size += len(parts[-1])
            if size >= CHUNK_BYTES:
                yield out()
                owners, parts, size = [], [], 0
    if parts:
        yield out()


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(gram, n, trained): how often each byte follows each context in all texts and in those to learn from."""
    if not 0 <= order <= 6:
        raise ValueError(f"order must be 0 to 6: {order}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(cells >> 1), pa.array(cells & 1 == 1), pa.array(counts)], ["gram", "held", "n"]
            )

        for batch in batches:
            held = np.array(batch.column(0).to_pylist(), np.int64)
            for owner, codes in pieces([lowered(t.as_py()) for t in batch.column(1)], order):
                new, n = np.unique(codes << 1 | held[owner], return_counts=True)
                keys, at = np.unique(np.concatenate([cells, new]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, np.concatenate([counts, n]))
                cells, counts = keys, sums
                if len(cells) > HEAD_GRAMS:
                    yield out()
                    cells, counts = cells[:0], counts[:0]
        yield out()

    found = rows.select(held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(
        run, "gram long, held boolean, n long"
    )
    return found.groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("trained")
    )


def gram_logs(counted: DataFrame, order: int) -> DataFrame:
    """(gram, n, log): log10 probability of the byte after its context, for every gram of ``counted``."""
    shorter = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
    cells = counted.where("trained > 0").select("gram", F.col("trained").alias("c"))
    # what the context just left has offered: its followers' count here, and their number
    rows = counted.select(
        "gram", "n", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds")
    )
    done = []
    for k in range(order, -1, -1):
        below = materialize(cells.groupBy(shorter(k - 1).alias("gram")).agg(F.sum("c").alias("c")), "grams") if k else None
        followers = cells.withColumn("context", F.shiftright("gram", 8))
        if k:
            followers = followers.withColumn("gram", shorter(k - 1)).join(below.withColumnRenamed("c", "shorter"), "gram")
        contexts = followers.groupBy("context").agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"),
            (F.sum("shorter") if k else F.lit(0).cast("long")).alias("offered"),
        )
        met = materialize(
            rows.withColumn("here", shorter(k)).withColumn("context", F.shiftright("here", 8))
            .join(cells.withColumnRenamed("gram", "here"), "here", "left").join(contexts, "context", "left"),
            "gram-logs",
        )
        total, kinds = F.col("total") - F.col("gone"), F.col("kinds") - F.col("gone_kinds")
        # after all 256 symbols there is nothing to escape to
        followed = F.log10(F.col("c") / (total + F.when(F.col("kinds") < 256, kinds).otherwise(0)))
        escape = F.when(kinds > 0, F.log10(kinds / (total + kinds))).otherwise(0.0)
        done.append(met.where("c is not null").select("gram", "n", (F.col("log") + followed).alias("log")))
        rows = met.where("c is null").select(
            "gram", "n", (F.col("log") + escape).alias("log"), F.coalesce("offered", F.lit(0)).alias("gone"),
            F.coalesce("kinds", F.lit(0)).alias("gone_kinds"),
        )
        cells = below
    out = rows.select("gram", "n", (F.col("log") - F.log10(256 - F.col("gone_kinds"))).alias("log"))
    for part in done:
        out = out.union(part)
    return materialize(out, "gram-table")


class ByteModel:
    """Log10 probabilities of a byte after its two predecessors, by PPM with exclusion, as one array.

    For callers that hold the cells of order two (24 bits) themselves; ``score`` uses ``gram_logs``.
    """

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order].astype(np.int64), counts[order].astype(np.float64)
        one = np.zeros((256, 256))  # after one byte
        np.add.at(one, ((cells >> 8) & 255, cells & 255), counts)
        zero = one.sum(axis=0)
        flat = np.ones(256)
        contexts, starts = np.unique(cells >> 8, return_index=True)
        ends = np.append(starts[1:], len(cells))
        # row of the table for each two-byte context; unseen ones use their last byte alone
        self.row = (np.arange(65536) & 255).astype(np.int32)
        table = np.empty((256 + len(contexts), 256), np.float32)
        for last in range(256):
            table[last] = np.log10(self.mix([one[last], zero, flat]))
        for k, (context, lo, hi) in enumerate(zip(contexts, starts, ends)):
            two = np.zeros(256)
            two[cells[lo:hi] & 255] = counts[lo:hi]
            table[256 + k] = np.log10(self.mix([two, one[context & 255], zero, flat]))
            self.row[context] = 256 + k
        self.table = table.reshape(-1)

    @staticmethod
    def mix(levels: list[np.ndarray]) -> np.ndarray:
        """Probabilities of all 256 bytes from counts of the longest context to the shortest."""
        out = np.zeros(256)
        left, excluded = 1.0, np.zeros(256, bool)
        for depth, counts in enumerate(levels):
            allowed = np.where(excluded, 0.0, counts)
            total, kinds = allowed.sum(), np.count_nonzero(allowed)
            if not kinds:
                continue
            if depth == len(levels) - 1 or kinds + np.count_nonzero(excluded) == 256:
                out += left * allowed / total  # nothing to escape to
                break
            out += left * allowed / (total + kinds)
            left *= kinds / (total + kinds)
            excluded |= allowed > 0
        return out

    def score(self, raw: bytes) -> float:
        total = 0.0
        for lo in range(0, len(raw) + 1, CHUNK_BYTES):
            # two bytes of context from the part before
            hi = min(len(raw), lo + CHUNK_BYTES)
            before = (b"\0\0" + raw[max(0, lo - 2) : lo])[-2:]
            part = before + raw[lo:hi] + (b"\0" if hi == len(raw) else b"")
            p = np.frombuffer(part, np.uint8).astype(np.int32)
            rows = self.row[p[:-2] << 8 | p[1:-1]]
            total += float(self.table[rows * 256 + p[2:]].sum(dtype=np.float64))
            if hi == len(raw):
                break
        return total


# -- words ----------------------------------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts; each task adds up its own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary())
            n = pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, n], ["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                for word in lowered(value.as_py()).split():
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > HEAD_WORDS:
                yield out()
        yield out()

    return (
        training.select("text").mapInArrow(run, "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("c"))
    )


def head_count(counts: DataFrame, head_words: int) -> int:
    """Smallest count (on a grid of eighths of a doubling) that at most ``head_words`` words reach."""
    step = F.floor(8 * F.log2(F.col("c"))).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, seen = 1 << 62, 0
    for row in sorted(histogram, reverse=True):
        seen += row["n"]
        if seen > head_words:
            break
        least = int(np.ceil(2 ** (row["step"] / 8)))
    return least


def score(
    docs: DataFrame, head_words: int = HEAD_WORDS, order: int = 2, head_grams: int = HEAD_GRAMS
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is the longest context in bytes, at most 6.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = rows.where(~held_out(F.col("doc_id")))

    counts = materialize(word_counts(training), "word-counts")
    of_words = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = training.count()
    tokens = int(of_words["n"] or 0) + ends
    kinds = int(of_words["v"]) + (1 if ends else 0)
    per_token = float(np.log10(tokens + kinds + 1))

    head = counts.where(F.col("c") >= head_count(counts, head_words)).toArrow()
    grams = gram_logs(materialize(gram_counts(rows, order), "gram-counts"), order)
    least = head_count(grams.select(F.col("n").alias("c")), head_grams)
    frequent = grams.where(F.col("n") >= least).select("gram", "log").toArrow()
    at = np.argsort(frequent.column(0).to_numpy())
    sent = spark.sparkContext.broadcast(
        (
            dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist())),
            frequent.column(0).to_numpy()[at], frequent.column(1).to_numpy()[at],
        )
    )
    end_log, end_known = float(np.log10(ends + 1)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, known_grams, gram_log = sent.value
        logs = {word: float(np.log10(c + 1)) for word, c in known.items()}
        for batch in batches:
            raws = [lowered(value.as_py()) for value in batch.column(1)]
            totals = np.zeros(len(raws))
            rare_owner, rare_gram, rare_times = [], [], []
            for owner, codes in pieces(raws, order):
                distinct, where = np.unique(codes, return_inverse=True)
                near = np.searchsorted(known_grams, distinct)
                hit = np.zeros(len(distinct), bool)
                if len(known_grams):
                    near = np.minimum(near, len(known_grams) - 1)
                    hit = known_grams[near] == distinct
                logs_here = np.zeros(len(distinct))
                logs_here[hit] = gram_log[near[hit]]
                totals += np.bincount(owner, logs_here[where], minlength=len(raws))
                if not hit.all():
                    missed = ~hit[where]
                    pairs, n = np.unique(owner[missed] * len(distinct) + where[missed], return_counts=True)
                    rare_owner.append(pairs // len(distinct))
                    rare_gram.append(distinct[pairs % len(distinct)])
                    rare_times.append(n)
            ids: list = []
            marks: list[int] = []
            keys: list[bytes] = []
            times: list[int] = []
            n_tokens: list = []
            n_known: list = []
            partial: list = []
            scores: list = []
            own_marks: list[int] = []
            doc_ids = batch.column(0).to_pylist()
            for doc_id, raw, total in zip(doc_ids, raws, totals.tolist()):
                words = raw.split()
                mark = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                own_marks.append(mark)
                base, seen = end_log, end_known
                rest: dict[bytes, int] = {}
                for word in words:
                    log = logs.get(word)
                    if log is None:
                        rest[word] = rest.get(word, 0) + 1
                    else:
                        base += log
                        seen += 1
                fresh = [b" %d" % (mark & 0xFFFF), *rest]
                ids += [doc_id] * len(fresh)
                marks += [mark] * len(fresh)
                keys += fresh
                times += [1, *rest.values()]
                blank = [None] * len(rest)
                n_tokens += [len(words) + 1, *blank]
                n_known += [seen, *blank]
                partial += [base, *blank]
                scores += [total, *blank]
            if rare_owner:
                of = np.concatenate(rare_owner).tolist()
                blank = [None] * len(of)
                ids += [doc_ids[k] for k in of]
                marks += [own_marks[k] for k in of]
                keys += [b" g%d" % g for g in np.concatenate(rare_gram).tolist()]
                times += np.concatenate(rare_times).tolist()
                for column in (n_tokens, n_known, partial, scores):
                    column += blank
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(times, pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array(n_known, pa.int64()), pa.array(partial, pa.float64()),
                    pa.array(scores, pa.float64()),
                ],
                ["doc_id", "mark", "word", "times", "n_tokens", "n_known", "base", "score"],
            )

    scored = rows.mapInArrow(
        run,
        "doc_id long, mark long, word binary, times long, n_tokens long, n_known long, base double, "
        "score double",
    )
    # rows of the texts themselves and of grams carry keys that no word has, as they begin with a space;
    # rare words meet their counts, rare grams their logarithms
    of_grams = grams.where(F.col("n") < least).select(
        F.concat(F.lit(" g"), F.col("gram").cast("string")).cast("binary").alias("word"),
        F.lit(None).cast("long").alias("c"), "log",
    )
    entries = counts.select("word", "c", F.lit(None).cast("double").alias("log")).union(of_grams)
    joined = scored.join(entries, "word", "left")
    rare = F.col("base").isNull() & F.col("log").isNull()
    summed = joined.groupBy("doc_id", "mark").agg(
        F.count("base").alias("copies"),
        F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.max("base").alias("head"),
        F.sum(F.when(F.col("log").isNotNull(), F.col("times") * F.col("log")).otherwise(0.0)).alias("rare_score"),
        F.max("n_known").alias("known_head"),
        F.sum(F.when(rare & F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(
            F.when(rare, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).otherwise(0.0)
        ).alias("rare"),
    )
    return summed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known_head") + F.expr("known_rare div copies")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("rare") / F.col("copies") - F.col("n_tokens") * F.lit(per_token)).alias(
            "base_score"
        ),
        (F.col("score") + F.col("rare_score") / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
