from __future__ import annotations

import random
import re
import time

import pyarrow as pa

from curdline.llm import decontamination as op
from tests.llm.helpers import DOCUMENTS, docs, prose


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition, quadratic."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and i + n not in used_i and d + n not in used_d):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
        if not best:
            return tiles
        n, i, d = best
        tiles.append((d, i, n))
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))


def brute_force(documents, items):
    out = set()
    for i, t in documents:
        for j, b in items:
            w, v = words(t), words(b)
            if len(v) < op.LEAST_WORDS:
                continue
            tiles = brute_tiles(w, v, min(len(v), op.SEED_WORDS))
            covered = sum(n for _, _, n in tiles)
            if covered >= op.COVERAGE * len(v):
                out.add((i, j, covered, len(v), len(tiles)))
    return out


def corpus():
    rng = random.Random(3)
    items = [(j, prose(j, rng.randrange(14, 50))) for j in range(12)] + [(20, "tiny one"), (21, "alpha beta gamma"), (22, None), (None, "x y z x y z x")]
    rows = []
    for i in range(40):
        parts = [prose(900 + i, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items[:12])[1]).split()
            cut = rng.randrange(0, len(w))
            kind = rng.randrange(4)
            if kind == 1:
                w = w[cut:] + ["Between,"] + w[:cut]
            elif kind == 2:
                w = w[: len(w) // 2]
            elif kind == 3:
                w[cut] = "other"
            parts += [" ".join(w).upper(), prose(700 + i, 8)]
        rows.append((i, "!\n".join(parts)))
    return [*rows, (50, None), (51, ""), (52, "Alpha, beta. GAMMA"), (53, "x y z " * 30), (None, items[0][1]), (2, rows[2][1])], items


def test_equals_brute_force(spark):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = op.contained_items(docs(spark, rows), benchmark).collect()
    assert {tuple(r)[:5] for r in found} == brute_force(rows, items)
    assert {(r.item_id, r.doc_id) for r in found} >= {(0, None), (21, 52)}
    assert all(abs(r.coverage - r.covered / r.item_words) < 1e-12 for r in found)


def test_seeds_shared_by_many_items(spark):
    """A passage that all items begin or end with; items that consist of it are found by it."""
    common = prose(1, 20)
    items = [(j, f"{common} {prose(100 + j, 25)}") for j in range(30)] + [(40, common), (41, common), (42, f"{common} more")]
    rows = [(1, common), (2, f"{prose(50, 9)} {common} {prose(107, 25)}"), (3, prose(112, 25)), (4, prose(60, 80))]
    found = op.contained_items(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {tuple(r)[:5] for r in found} == brute_force(rows, items)
    rare = op.rare_seeds(op.item_seeds(spark.createDataFrame(items, "item_id bigint, text string")))
    assert rare.groupBy("seed").count().agg({"count": "max"}).first()[0] <= 2  # of 32 items with the passage


def test_repetitive_texts_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(j, " ".join(rng.choice("ab") for _ in range(rng.randrange(3, 30)))) for j in range(12)]
    rows = [(i, " ".join(rng.choice("aab") for _ in range(rng.randrange(0, 60)))) for i in range(25)]
    found = op.contained_items(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {tuple(r)[:5] for r in found} == brute_force(rows, items)


def seeds(text, least):
    """Places and hashes of all runs of ``least`` words."""
    held = op.words_of(pa.array([text]), op.PLAIN)
    return held.runs(least)


def test_one_word_repeated_is_cheap():
    place, doc = seeds("again " * 20_000, 5)
    begin = time.perf_counter()
    assert op.tiling(place, doc, seeds("again " * 400, 5)[1], 5) == [(0, 0, 400)]
    assert time.perf_counter() - begin < 1


def test_tiling_equals_brute_force_in_order():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abc"[: rng.randrange(1, 4)]
        doc, item = ([rng.choice(letters) for _ in range(rng.randrange(5, 40))] for _ in range(2))
        at, hashes = seeds(" ".join(doc), 5)
        assert op.tiling(at, hashes, seeds(" ".join(item), 5)[1], 5) == brute_tiles(doc, item, 5)


def test_clean_documents_stay(spark):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    given = docs(spark, rows).selectExpr("*", "1 as item_id", "'t' as covered")
    kept = op.decontaminated(given, benchmark)
    dirty = {r[0] for r in brute_force(rows, items)}
    assert kept.columns == given.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert op.contained_items(docs(spark, [(1, "a b c d e f")]), none).collect() == []
    assert op.contained_items(spark.createDataFrame([], DOCUMENTS), some).collect() == []
    assert op.decontaminated(docs(spark, [(1, "a b c")]), none).count() == 1


def test_tiles_do_not_overlap():
    place, doc = seeds("one " * 34, 5)  # one word repeated in both
    assert op.tiling(place, doc, seeds("one " * 14, 5)[1], 5) == [(0, 0, 14)]
