"""A stored index for exact cosine search: vectors in cells, written once, read by the cells in reach.

Centres are stored vectors themselves, one in about ``cell_rows`` by a hash of the id, so their number
grows with the store. A vector goes to the nearest of its scope's coarse centres and then to the nearest
centre below that one. The cells' rows lie together, in order of scope and cell; a table of cells keeps
each centre and the widest angle of a member. A question is held against the cells of its scope (a small
table); a cell whose centre is ``a`` away and whose widest member is ``r`` away holds nothing nearer than
``a - r``. The nearest cells are read first, the k-th similarity found there bounds which others are read
at all. A bounded set of questions travels to the rows; the rows are never shuffled.

Vectors that are null, all zero or of another size than the index are kept in a table of rejects.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebeam.operators.nearest import nearest
from tracebeam.operators.skew import first_per_key
from tracebeam.session import materialize

CELL_ROWS = 4096
FANOUT = 64  # centres below a coarse one, about
ASSIGN_ROWS = 65536
MOST_QUESTIONS = 10_000
FIRST_CELLS = 4
SLACK = 1e-6  # radians / similarity, covers rounding of single-precision input
ALL = "(all)"


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assigned(rows: DataFrame, centres: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` (keys, _id, _vector, ...) with ``out``, the nearest of the ``centres`` (keys, cell, centre)
    of their key, and the angle to it. Keys with many rows are cut into blocks of bounded size."""
    # fresh column identities: both sides may come from the same table
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    centres = centres.select(*[F.col(c).alias(c) for c in centres.columns])
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ASSIGN_ROWS).cast("int").alias("_blocks"))
    blocks = materialize(blocks, "index-blocks")
    left = rows.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks").cast("long")).cast("int")).drop("_blocks")
    right = centres.join(blocks, keys).select(
        *keys, "cell", "centre", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    )
    columns = rows.columns

    def nearest_centre(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("cell")
        units, centre = _units(mine.column("_vector")), _units(theirs.column("centre"))
        at, angle = np.empty(len(units), np.int64), np.empty(len(units))
        for lo in range(0, len(units), 4096):
            near = units[lo : lo + 4096] @ centre.T
            at[lo : lo + 4096] = near.argmax(1)
            angle[lo : lo + 4096] = np.arccos(np.clip(near.max(1), -1.0, 1.0))
        cells = theirs.column("cell").take(pa.array(at)) if len(at) else pa.chunked_array([[]], pa.int64())
        chosen = mine.select(columns)
        return chosen.append_column(out, cells).append_column(f"{out}_angle", pa.array(angle))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    on = [*keys, "_block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(
        nearest_centre, f"{fields}, `{out}` long, `{out}_angle` double"
    )


def build_index(
    store: DataFrame, path: str, scope: str | None = "repo_key", id_col: str = "id", vector_col: str = "vector",
    cell_rows: int = CELL_ROWS, dim: int | None = None,
) -> None:
    """Write the index of ``store`` to ``path``: folders rows, cells and rejects.

    ``dim`` is the size of the vectors (the commonest one if not given); a null scope is one of its own.
    """
    named = store.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope") if scope else F.lit(ALL).alias("scope"),
        F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"),
    )
    named = materialize(named, "index-input")
    if dim is None:
        dim = named.where("_vector is not null").agg(F.mode(F.size("_vector"), True)).first()[0] or 0
    fits = F.coalesce((F.size("_vector") == dim) & F.exists("_vector", lambda x: x != 0), F.lit(False))
    named.where(~fits).write.mode("overwrite").parquet(f"{path}/rejects")
    rows = named.where(fits)
    code = F.pmod(F.xxhash64("_id"), F.lit(cell_rows * FANOUT))
    # scopes without a centre by chance, or without a coarse one, take the vector of the smallest hash
    first = rows.groupBy("scope").agg(F.min_by(F.struct("_id", "_vector"), F.struct(F.xxhash64("_id"), "_id")).alias("f"))
    first = first.select("scope", "f.*").withColumn("coarse", F.lit(True))
    drawn = rows.where(code % cell_rows == 0).select("scope", "_id", "_vector", (code == 0).alias("coarse"))
    centres = drawn.union(first.select("scope", "_id", "_vector", "coarse")).groupBy("scope", "_id").agg(
        F.first("_vector").alias("_vector"), F.max("coarse").alias("coarse")
    )
    centres = materialize(centres.withColumn("cell", F.monotonically_increasing_id()), "index-centres")
    coarse = centres.where("coarse").select("scope", "cell", F.col("_vector").alias("centre"))
    fine = _assigned(centres.select("scope", "_id", "_vector", F.col("cell").alias("own")), coarse, ["scope"], "above")
    fine = materialize(fine.select("scope", "above", F.col("own").alias("cell"), F.col("_vector").alias("centre")), "index-fine")
    placed = _assigned(rows, coarse, ["scope"], "above").select("scope", "above", "_id", "_vector")
    placed = materialize(_assigned(placed, fine, ["scope", "above"], "cell"), "index-rows")
    sizes = placed.groupBy("scope", "cell").agg(F.max("cell_angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
    fine.join(sizes, ["scope", "cell"]).select("scope", "cell", "centre", "radius", "rows").write.mode(
        "overwrite"
    ).parquet(f"{path}/cells")
    # rows of a cell lie together: Parquet's statistics then skip the other cells
    placed.select("scope", "cell", F.col("_id").alias("id"), F.col("_vector").alias("vector")).repartitionByRange(
        "scope", "cell"
    ).sortWithinPartitions("scope", "cell", "id").write.mode("overwrite").parquet(f"{path}/rows")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rejects").select("scope", F.col("_id").alias("id"), F.col("_vector").alias("vector"))


def search_index(
    questions: DataFrame, path: str, k: int = 10, scope: str | None = "repo_key", query_id: str = "query_id",
    vector_col: str = "vector", floor: float = -1.0,
) -> DataFrame:
    """Top ``k`` indexed vectors per question, as ``nearest`` gives them: query_id, id, similarity, rank.

    Questions whose vector is null, zero or of another size find nothing. More than ``MOST_QUESTIONS`` at
    once are searched by ``nearest``, block against block, instead of being sent to the rows.
    """
    spark = questions.sparkSession
    rows, cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells")
    asked = questions.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope") if scope else F.lit(ALL).alias("scope"),
        F.col(query_id).alias("query_id"), F.col(vector_col).alias("vector"),
    )
    some = asked.limit(MOST_QUESTIONS + 1).collect()
    if len(some) > MOST_QUESTIONS:
        found = nearest(asked, rows, k, ("scope",), "query_id", "id", "vector", floor)
        return found.withColumnRenamed("query_id", query_id)
    sample = cells.select("centre").first()
    dim = len(sample["centre"]) if sample else 0
    usable = [q for q in some if q["vector"] is not None and len(q["vector"]) == dim and any(q["vector"])]
    by_scope: dict[str, list[int]] = {}
    for at, q in enumerate(usable):
        by_scope.setdefault(q["scope"], []).append(at)
    units = np.array([q["vector"] for q in usable], np.float64).reshape(len(usable), dim)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    names = spark.createDataFrame(
        [(at, q["query_id"]) for at, q in enumerate(usable)], f"at int, {query_id} {asked.schema['query_id'].dataType.simpleString()}"
    )
    if not usable:
        return rows.limit(0).select(
            F.lit(None).cast(asked.schema["query_id"].dataType).alias(query_id), "id",
            F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank"),
        )
    sent = spark.sparkContext.broadcast((by_scope, units))
    first = materialize(
        first_per_key(_in_reach(cells, sent, None), ["at"], [F.asc("least"), F.asc("cell")], FIRST_CELLS).select("at", "scope", "cell", "least"),
        "index-first",
    )
    found = materialize(_search_cells(rows, first, sent, k, floor), "index-found")
    best = first_per_key(found, ["at"], [F.desc("similarity"), F.asc("id")], k)
    bounds = {r["at"]: r["least"] for r in best.groupBy("at").agg(
        F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("least")
    ).collect()}  # one row per question
    reach = np.array([
        np.arccos(np.clip(max(floor, -1.0 if bounds.get(at) is None else bounds[at]) - SLACK, -1.0, 1.0))
        for at in range(len(usable))
    ])
    others = _in_reach(cells, sent, reach + SLACK).select("at", "scope", "cell").join(
        first.select("at", "cell"), ["at", "cell"], "left_anti"
    )
    more = _search_cells(rows, materialize(others, "index-others"), sent, k, floor)
    ranked = first_per_key(found.union(more), ["at"], [F.desc("similarity"), F.asc("id")], k, rank="rank")
    return ranked.join(F.broadcast(names), "at").select(query_id, "id", "similarity", "rank")


def _in_reach(cells: DataFrame, sent, reach: np.ndarray | None) -> DataFrame:
    """(at, scope, cell, least): cells that can hold something within ``reach`` of a question (all if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_scope, units = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scopes, centre = np.array(batch.column(0).to_pylist(), object), _units(batch.column(2))
            radius = batch.column(3).to_numpy()
            for name in set(scopes.tolist()) & set(by_scope):
                mine, ask = np.flatnonzero(scopes == name), np.array(by_scope[name])
                angle = np.arccos(np.clip(units[ask] @ centre[mine].T, -1.0, 1.0))
                least = np.maximum(angle - radius[mine] - SLACK, 0.0)
                near = np.ones(least.shape, bool) if reach is None else least <= reach[ask][:, None]
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ask[i], pa.int32()), pa.array([name] * len(i), pa.string()),
                     batch.column(1).take(pa.array(mine[j])), pa.array(least[i, j])],
                    ["at", "scope", "cell", "least"],
                )

    return cells.select("scope", "cell", "centre", "radius").mapInArrow(
        run, "at int, scope string, cell long, least double"
    )


MOST_NAMED_CELLS = 2000
MOST_SENT_VISITS = 1_000_000


def _search_cells(rows: DataFrame, visits: DataFrame, sent, k: int, floor: float) -> DataFrame:
    """(at, id, similarity): the best ``k`` of each question in every part of the rows of its cells.

    ``visits`` (at, scope, cell) is counted and sent to the rows; only if questions reach more cells than
    that do the rows of these cells shuffle. The cells are also named in a filter (if they are not too
    many), so that only their part of the files is read.
    """
    named = [r["cell"] for r in visits.select("cell").distinct().limit(MOST_NAMED_CELLS + 1).collect()]
    near = rows.where(F.col("cell").isin(named)) if len(named) <= MOST_NAMED_CELLS else rows
    asked = visits.groupBy("scope", "cell").agg(F.collect_list("at").alias("ask"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, stored = batch.column(0).to_numpy(), _units(batch.column(2))
            asks = batch.column(3)
            for cell in np.unique(cells):
                mine = np.flatnonzero(cells == cell)
                ask = np.array(asks[int(mine[0])].as_py())
                sims = np.round(units[ask] @ stored[mine].T, 9)
                if len(mine) > k:  # ties at the k-th place stay, ids decide later
                    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero((sims >= np.maximum(least, floor)[:, None]))
                else:
                    i, j = np.nonzero(sims >= floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ask[i], pa.int32()), batch.column(1).take(pa.array(mine[j])), pa.array(sims[i, j])],
                    ["at", "id", "similarity"],
                )

    asked = F.broadcast(asked) if visits.count() <= MOST_SENT_VISITS else asked
    joined = near.join(asked, ["scope", "cell"]).select("cell", "id", "vector", "ask")
    return joined.mapInArrow(run, f"at int, id {id_type}, similarity double")
