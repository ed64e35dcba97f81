from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from curdline.llm import line_dedup as op
from curdline.sources.tables import materialized, shared_folder
from tests.llm.helpers import DOCUMENTS, docs, prose

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def key_of(line):
    key = line.strip(SPACE).translate(LOWER)
    return key if len(key) >= 20 else None


def brute_force(rows, batches=None):
    """Per row: doc_id, lines, dropped lines, digest."""
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key_of(line):
                held[key_of(line)].add(float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = float("-inf") if i is None else i
        kept = [x for x in lines if not (key_of(x) and len(held[key_of(x)]) >= 3 and own < max(held[key_of(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    pool = [prose(i, 5) for i in range(30)] + ["ÉCOLE É" * 4, "école É" * 4, "É" * 19, "É" * 20, "x" * 19, "x" * 20, "", "  ", "nbsp " * 6]
    rows = []
    for i in range(160):
        lines = [rng.choice([str.upper, str, str])(rng.choice(pool)) for _ in range(rng.randrange(6))]
        lines = [rng.choice(["", " ", "\t\v", "\r"]) + x + rng.choice(["", "\f ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines + lines[:1] + ["a line that nearly every document has"] * (i % 5 > 0))))
    rows += [(None, rows[7][1]), (None, None), (None, "a line that nearly every document has"), (500, None), (501, ""), (3, rows[9][1]),
             (3, rows[9][1]), (502, "\n\n"), (503, "\n".join(prose(k, 8) for k in range(20_000))), (504, prose(1, 5) + "\n" + prose(3, 50_000))]
    return rows


def key(row):
    return str(row)


def test_equals_brute_force(spark):
    rows = corpus()
    out = op.digests(docs(spark, rows))
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute_force(rows), key=key)
    assert sum(r[2] for r in brute_force(rows)) > 100


def test_texts_lose_lines_and_columns_are_kept(spark):
    shared = "Boilerplate at the end of each page"
    rows = [(1, f"one\n {shared} "), (2, f"{shared.upper()}\ntwo\n{shared}"), (3, f"three\n{shared}\n{shared}"), (4, None), (5, "five\r\n")]
    given = docs(spark, rows).selectExpr("*", "1 AS drops", "2 AS copy", "3 AS rest", "4 AS h", "5 AS `a.b c`", "doc_id * 2 AS last")
    out = op.deduplicated(given, batches=2)
    assert out.schema == given.schema
    assert {r.doc_id: (r.text, r.copy, r["a.b c"], r.last) for r in out.collect()} == {
        1: ("one", 2, 5, 2), 2: ("two", 2, 5, 4), 3: (f"three\n{shared}\n{shared}", 2, 5, 6), 4: (None, 2, 5, 8), 5: ("five\r\n", 2, 5, 10)}


def test_runs_are_levelled_and_totals_do_not_depend_on_batches(spark):
    rows = [(i, f"{prose(i % 7, 6)}\n{prose(i, 6)}") for i in range(60)]
    pairs = op.line_keys(docs(spark, rows)).cache()
    wanted = {(r.h, r.g): (r.docs, r.last) for r in pairs.groupBy("h", "g").agg({"*": "count", "doc_id": "max"}).toDF("h", "g", "docs", "last").collect()}
    levels = []
    store = op.LineRuns(spark, f"{shared_folder(spark)}/test_runs_{random.random()}", buckets=3, fanout=3)
    assert store.entries().collect() == [] and store.fresh(pairs).count() == pairs.count()
    for batch in range(10):
        store.add(pairs.where(f"doc_id % 10 = {batch}"))
        levels.append([level for level, _ in store.runs])
    assert levels == [[0], [0, 0], [1], [1, 0], [1, 0, 0], [1, 1], [1, 1, 0], [1, 1, 0, 0], [2], [2, 0]]
    found = store.entries().collect()
    assert len(found) == len(wanted) and {(r.h, r.g): (r.docs, r.last) for r in found} == wanted
    again = op.LineRuns.opened(spark, store.path)
    assert again.runs == store.runs and again.buckets == 3 and again.version == 9
    again.add(spark.createDataFrame([(900, 0, 1, 2)], "doc_id bigint, copy bigint, h bigint, g bigint"))
    assert again.entries().count() == len(wanted) + 1
    pairs.unpersist()


def test_joins_with_runs_shuffle_the_batch_alone(spark):
    store, pairs = op.stored(docs(spark, [(i, f"{prose(i, 9)}\n{prose(1000, 9)}") for i in range(60)]), batches=5)
    assert len(store.runs) == 3
    own = materialized(pairs.selectExpr("h", "g", "CAST(1 AS BIGINT) AS docs", "doc_id AS last").union(
        spark.createDataFrame([(5, 6, 1, 1)], "h bigint, g bigint, docs bigint, last bigint")), "own")
    for joined in (store.fresh(own.repartition(store.buckets, "h", "g")), store.totals(own.repartition(store.buckets, "h", "g"))):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3
    assert [tuple(r)[:2] for r in store.fresh(own).collect()] == [(5, 6)]
    assert store.totals(own).where("docs = 61").count() == 60  # the line of all documents, found once more by each


def test_hot_keys_give_the_same_rows(spark):
    store, pairs = op.stored(docs(spark, corpus()), batches=3)
    few, all_ = (
        {(r.doc_id, r.copy, tuple(sorted((d.h, d.g) for d in r.drops))) for r in op.judged(pairs, store, hot_keys=n).collect()}
        for n in (1, 100_000)
    )
    assert few == all_ and few


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert op.digests(empty).collect() == [] and op.deduplicated(empty).collect() == []
