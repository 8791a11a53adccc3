"""Replacing scopes of stored tables: only what is touched is rewritten, and nothing is lost half-way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracebeam.operators import tables as tb

SCHEMA = "env string, id long, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def scopes(spark, *values):
    return spark.createDataFrame(list(values), "env string, id long")


def stored(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).select("env", "id", "v").collect()), key=repr)


def files(folder):
    return sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*.parquet"))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    start = rows(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 7, "n"), ("c d/e=%", 3, "odd"))
    tb.replace_scopes(start, path, start.select("env", "id"), ["env"])
    return path


def test_untouched_partitions_keep_their_files(spark, table, tmp_path):
    before = files(tmp_path / "t")
    tb.replace_scopes(rows(spark, ("a", 1, "new")), table, scopes(spark, ("a", 1)), ["env"])
    after = files(tmp_path / "t")
    assert [f for f in before if "env=a" not in f] == [f for f in after if "env=a" not in f]
    assert ("a", 1, "new") in stored(spark, table) and ("a", 2, "y") in stored(spark, table)
    assert len(stored(spark, table)) == 5


def test_emptied_partitions_go(spark, table, tmp_path):
    gone = scopes(spark, ("b", 1), (None, 7), ("c d/e=%", 3), ("never", 1))
    tb.replace_scopes(rows(spark), table, gone, ["env"])
    assert stored(spark, table) == [("a", 1, "x"), ("a", 2, "y")]
    assert {f.split("/")[0] for f in files(tmp_path / "t")} == {"env=a"}
    tb.delete_scopes(spark, table, rows(spark).schema, scopes(spark, ("a", 1), ("a", 2)), ["env"])
    assert tb.read_stored(spark, table, rows(spark).schema).count() == 0


def test_scopes_without_the_partition_column(spark, table):
    tb.replace_scopes(rows(spark, ("b", 5, "moved")), table, spark.createDataFrame([(1,)], "id long"), ["env"])
    assert stored(spark, table) == sorted(
        [("a", 2, "y"), ("b", 5, "moved"), (None, 7, "n"), ("c d/e=%", 3, "odd")], key=repr
    )


def test_many_touched_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "MOST_PREDICATES", 2)
    path = str(tmp_path / "t")
    start = rows(spark, *[(f"e{k}", k, "old") for k in range(6)])
    tb.replace_scopes(start, path, start.select("env", "id"), ["env"])
    tb.replace_scopes(rows(spark, ("e1", 1, "new")), path, scopes(spark, *[(f"e{k}", k) for k in range(5)]), ["env"])
    assert stored(spark, path) == [("e1", 1, "new"), ("e5", 5, "old")]


def test_an_interrupted_replacement_is_finished_later(spark, table, monkeypatch):
    def cut_off(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(tb, "discard", cut_off)  # after the new files are in place, before the end
        with pytest.raises(RuntimeError):
            tb.replace_scopes(rows(spark, ("a", 1, "new")), table, scopes(spark, ("a", 1), ("b", 1)), ["env"])
    finish = tb.finish_replacement
    with monkeypatch.context() as patch:
        patch.setattr(tb, "finish_replacement", lambda *_: False)  # pointer written, nothing in place
        tb.replace_scopes(rows(spark, ("a", 2, "newer")), table, scopes(spark, ("a", 2), (None, 7)), ["env"])
    assert (None, 7, "n") in stored(spark, table)
    got = tb.read_stored(spark, table, rows(spark).schema)
    want = [("a", 1, "new"), ("a", 2, "newer"), ("c d/e=%", 3, "odd")]
    assert sorted(map(tuple, got.select("env", "id", "v").collect()), key=repr) == want
    assert not finish(spark, table)


def test_without_partitions(spark, tmp_path):
    path = str(tmp_path / "flat")
    for v in ("one", "two"):
        tb.replace_scopes(rows(spark, ("a", 1, v), (None, 2, v)), path, scopes(spark, ("a", 1), (None, 2)))
    assert stored(spark, path) == [("a", 1, "two"), (None, 2, "two")]


def test_link_store_holds_no_row_per_link(spark, tables, tmp_path):
    """Links are read back whole, although the store grows only with incidents and events."""
    from tracebeam.operators import causality as ca
    from tracebeam.operators import link_store

    path, columns = str(tmp_path / "links"), ["env_key", "incident_id", "kind", "event_key", "at", "derivation"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()), key=repr)
    # every event five times at one instant: five times the links of each incident
    events = tables.causes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "event_key", F.concat("event_key", F.lit("#"), "copy")
    ).drop("copy")
    link_store.store_links(tables.incidents, events, path)
    expected = rows(ca.link_incidents(tables.incidents, events))
    assert rows(link_store.read_links(spark, path)) == expected
    one = tables.incidents.where(F.col("id") == expected[0][1])
    link_store.store_links(one, tables.causes, path, min_confidence=0.5)
    again = rows(ca.link_incidents(one, tables.causes, min_confidence=0.5))
    left = [r for r in expected if r[1] != expected[0][1]] + again
    assert rows(link_store.read_links(spark, path)) == sorted(left, key=repr)
    link_store.store_links(tables.incidents.where("env_key = 'env1'"), events.limit(0), path)
    assert rows(link_store.read_links(spark, path)) == sorted([r for r in left if r[0] != "env1"], key=repr)
    assert not (tmp_path / "links" / "incidents" / "env_key=env1").exists()


def test_relink_queries_store_no_links(spark, monkeypatch):
    from benchmark_tables import SF_DIR
    from tracebeam.operators import causality as ca
    from tracebeam.plans import registry

    def refused(*args, **kwargs):
        raise AssertionError("links stored row by row")

    registry.load()
    monkeypatch.setattr(ca, "write_links", refused)
    assert registry.run("relink_one_incident", spark, SF_DIR).count() > 0
    assert registry.run("relink_to_nothing", spark, SF_DIR).count() > 0
