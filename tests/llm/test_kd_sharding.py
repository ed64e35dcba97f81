from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from curdline.llm import kd_sharding as op
from curdline.llm.queries import op2_kd_tree_shards
from tests.llm.helpers import DOCUMENTS, docs, prose

NAMES = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def checked(rows, out, shards, most):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= most, sizes


def test_equal_bytes_with_a_hot_source_and_copies(spark):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(1500)] + [(2000 + i, prose(3, 60)) for i in range(800)]
    given = docs(spark, rows).selectExpr("doc_id", "text", "IF(doc_id % 3 = 0, 'de', lang) AS lang",
                                         "IF(doc_id % 2 = 0, 'hot', concat('s', doc_id % 40)) AS source", "n_chars", "1 AS shard", "2 AS size")
    out = op.sharded(given)
    assert out.columns == NAMES
    checked(rows, out.collect(), 40, 3 * 650)


def test_leaves_are_boxes(spark):
    given = docs(spark, [(i, prose(i, 5 + i % 90)) for i in range(400)])
    rows = op.metadata(given)
    root = op.tree(rows, 5)
    assert root.leaves == 5 and root.left.leaves == 2 and root.right.leaves == 3
    assert root.dimension == "by_length"
    assert rows.filter(f"{root.dimension} <= {root.key}").agg({"size": "sum"}).first()[0] == pytest.approx(
        rows.agg({"size": "sum"}).first()[0] * 2 / 5, abs=600)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "")]])
def test_few_odd_rows(spark, rows):
    given = docs(spark, rows) if rows else spark.createDataFrame([], DOCUMENTS)
    checked(rows, op.sharded(given).collect(), 40, 100)
    nulls = given.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source")
    checked(rows, op.sharded(nulls).collect(), 40, 100)


def test_any_script_and_equal_texts(spark):
    """Languages of any script are placed; equal texts with equal metadata share a shard unless a split falls among them."""
    rows = [(i, prose(i // 3, 20)) for i in range(600)]
    given = docs(spark, rows).selectExpr("doc_id", "text", "element_at(array('中文', 'éééé', '', 'zz'), CAST(doc_id DIV 3 % 4 AS INT) + 1) AS lang",
                                         "'one' AS source")
    out = op.sharded(given, 8).collect()
    checked(rows, out, 8, 3 * 120)
    shards = defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # one for each split at most
    copies = [(i, "the same text") for i in range(400)]
    checked(copies, op.sharded(docs(spark, copies), 8).collect(), 8, 2 * 29)


def test_query_is_native(spark):
    plan = op2_kd_tree_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_tree_is_data_not_code(spark, monkeypatch):
    """A pass that compares rows with a tree of literals is a new plan, and compiled classes, for the driver each time."""
    sizes, inside = [], op._inside

    def seen(rows, boxes, **columns):
        out = inside(rows, boxes, **columns)
        joined = out._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((len(boxes), len(joined)))
        assert "CASE WHEN" not in joined
        return out

    monkeypatch.setattr(op, "_inside", seen)
    rows = [(i, prose(i, 5 + i % 90)) for i in range(300)]
    checked(rows, op.sharded(docs(spark, rows)).collect(), 40, 3 * 650)
    assert max(n for n, _ in sizes) == 40 and len(sizes) < 32
    assert max(size for _, size in sizes) < 2 * min(size for _, size in sizes)
