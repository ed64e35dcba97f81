"""Versioned tables: commits in one step, broken writes, concurrent jobs, appends."""

from __future__ import annotations

import pytest

from curdline.sources import tables

DDL = "id int, name string, file_year int, file_month int"


@pytest.fixture
def rows(spark):
    return lambda *given: spark.createDataFrame([(i, name, 2025, month) for i, name, month in given], DDL)


def content(spark, path, version=None):
    schema = spark.createDataFrame([], DDL).schema
    return sorted(tuple(r)[:2] + (r["file_month"],) for r in tables.read_table(spark, path, schema, version).collect())


def test_a_write_that_dies_before_the_switch_changes_nothing(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "cases")
    assert tables.upsert(spark, path, rows((1, "open", 1), (2, "open", 1), (3, "open", 2)), ["id"]) == 1
    before = content(spark, path)

    def killed(self, version, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables.VersionedTable, "switch", killed)
        with pytest.raises(KeyboardInterrupt):
            tables.upsert(spark, path, rows((1, "confirmed", 1)), ["id"])
    assert content(spark, path) == before == [(1, "open", 1), (2, "open", 1), (3, "open", 2)]
    # the same work again, and what was left behind goes
    assert tables.upsert(spark, path, rows((1, "confirmed", 1)), ["id"]) == 2
    assert content(spark, path) == [(1, "confirmed", 1), (2, "open", 1), (3, "open", 2)]
    assert content(spark, path, 1) == before
    table = tables.VersionedTable(spark, path, rows((0, "", 1)).schema)
    assert table.vacuum(keep=2) == 1 and content(spark, path, 1) == before
    assert table.vacuum() == 1 and table.versions() == [2]
    assert content(spark, path) == [(1, "confirmed", 1), (2, "open", 1), (3, "open", 2)]
    with pytest.raises(ValueError, match="no version 1"):
        content(spark, path, 1)


def test_the_second_of_two_jobs_is_told(spark, rows, tmp_path):
    path = str(tmp_path / "flags")
    tables.upsert(spark, path, rows((1, "a", 1)), ["id"])
    table = tables.VersionedTable(spark, path, rows((0, "", 1)).schema)
    seen, state = table.state()
    tables.upsert(spark, path, rows((2, "b", 1)), ["id"])
    with pytest.raises(tables.ConcurrentCommit):
        table.switch(seen, state)
    assert content(spark, path) == [(1, "a", 1), (2, "b", 1)] and table.versions() == [1, 2]


def test_replaced_months_go_when_nothing_is_left(spark, rows, tmp_path):
    path = str(tmp_path / "stats")
    assert content(spark, path) == []
    tables.upsert(spark, path, rows((1, "a", 1), (2, "b", 2)), ["id"])
    months = rows((0, "", 1)).select("file_year", "file_month")
    tables.upsert(spark, path, rows((1, "a", 1)).where("id > 9"), ["id"], months=months, keep=lambda old: old.where("id > 9"))
    assert content(spark, path) == [(2, "b", 2)]
    plan = tables.read_table(spark, path, rows((0, "", 1)).schema)._jdf.queryExecution().executedPlan().toString()
    assert "file_month=1" not in plan


def test_a_repeated_append_adds_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "audit")
    assert tables.append_once(spark, path, rows((1, "a", 1), (1, "a", 1)), "run one")
    assert tables.append_once(spark, path, rows((1, "a", 1), (2, "b", 3)), "run two")
    assert not tables.append_once(spark, path, rows((1, "a", 1), (1, "a", 1)), "run one")
    assert content(spark, path) == [(1, "a", 1)] * 3 + [(2, "b", 3)]
    with pytest.raises(tables.ConcurrentCommit):
        tables.VersionedTable(spark, path, rows((0, "", 1)).schema).switch(1, {"months": {}, "runs": []})
