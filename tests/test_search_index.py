"""The stored search index against comparing everything, and what a single question reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracebeam.operators import search_index as si


def vectors(spark, n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for k in range(n):
        v = (centres[k % 6] + rng.normal(0, 0.3, dim)).tolist()
        rows.append((k, ["a", "a", "a", "b", None][k % 5], [float(np.float32(x)) for x in v]))
    rows += [(n + k, "a", rows[0][2]) for k in range(5)]  # copies: ties by id
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, repo_key string, vector array<float>")


def brute(asked, stored, k):
    out = []
    for q, repo, v in asked:
        found = []
        for i, other, w in stored:
            if other == repo and w and v and len(w) == len(v) == 8 and any(w) and any(v):
                x, y = np.array(v), np.array(w)
                found.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 7), i))
        out += [(q, r + 1, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def same_rows(got, want):
    got = sorted((r["query_id"], r["rank"], r["similarity"]) for r in got)
    assert len(got) == len(want) > 0 and np.allclose(got, want, atol=1e-6)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    rows = vectors(spark, 400, 1) + [(900, "a", None), (901, "a", [0.0] * 8), (902, "a", [1.0] * 3), (903, "small", [1.0] * 8)]
    si.build_index(frame(spark, rows), path, cell_rows=8)
    return path, rows


def test_equals_brute_force(spark, index):
    path, rows = index
    asked = vectors(spark, 40, 2)[:40] + [(50, "small", [1.0] + [0.0] * 7), (51, "none", [1.0] * 8), (52, "a", None), (53, "a", [1.0] * 3)]
    questions = frame(spark, asked).withColumnRenamed("id", "query_id")
    got = si.search_index(questions, path, 7).collect()
    same_rows(got, brute(asked, rows, 7))
    one = next(r for r in rows if r[0] == 0)
    same = si.search_index(frame(spark, [one]).withColumnRenamed("id", "query_id"), path, 4).orderBy("rank").collect()
    assert [r["id"] for r in same] == [0, 400, 401, 402]
    assert si.search_index(questions.limit(0), path).count() == 0


def test_rejects_and_cells(spark, index):
    path, rows = index
    assert sorted(r["id"] for r in si.read_rejects(spark, path).collect()) == [900, 901, 902]
    cells = spark.read.parquet(f"{path}/cells")
    assert cells.count() > 20 and cells.agg(F.sum("rows")).first()[0] == len(rows) - 3


def test_one_question_reads_few_cells_and_shuffles_no_vector(spark, index, monkeypatch):
    path, rows = index
    plans, visits = [], []
    search = si._search_cells

    def watched(stored, asked, *rest):
        out = search(stored, asked, *rest)
        visits.append(asked.count())
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(si, "_search_cells", watched)
    question = frame(spark, [rows[3]]).withColumnRenamed("id", "query_id")
    assert si.search_index(question, path, 1).first()["id"] == rows[3][0]
    read = [plan for plan, cells in zip(plans, visits) if cells]
    for plan in read:
        # the only exchange sends the question's cells out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert "In(cell" in plan or "EqualTo(cell" in plan
    assert read
    assert sum(visits) < spark.read.parquet(f"{path}/cells").where("scope = 'b'").count()


def test_many_questions_take_the_block_search(spark, index, monkeypatch):
    path, rows = index
    monkeypatch.setattr(si, "MOST_QUESTIONS", 3)
    asked = vectors(spark, 10, 3)[:10]
    got = si.search_index(frame(spark, asked).withColumnRenamed("id", "query_id"), path, 3).collect()
    same_rows(got, brute(asked, rows, 3))


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    si.build_index(frame(spark, []), path)
    assert si.search_index(frame(spark, [(1, "a", [1.0])]).withColumnRenamed("id", "query_id"), path).count() == 0
