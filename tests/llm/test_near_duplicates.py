from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from curdline.llm import bag_minhash as bm
from curdline.llm import near_duplicates as op
from curdline.llm.components import components
from tests.llm.helpers import DOCUMENTS, docs, prose


def bag(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def weighted_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_force(rows):
    """Classes by all pairs of texts."""
    texts = [(i, t, bag(t)) for i, t in rows if i is not None and t is not None]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(texts)), 2):
        a, b = texts[x], texts[y]
        near = a[1] == b[1] if not a[2] or not b[2] else weighted_jaccard(a[2], b[2]) >= op.LIKENESS
        if near and find(x) != find(y):
            root[find(x)] = find(y)
    least = defaultdict(lambda: 10**9)
    for x, (i, _, _) in enumerate(texts):
        least[find(x)] = min(least[find(x)], i)
    return {(i, t): least[find(x)] for x, (i, t, _) in enumerate(texts)}


def edited(rng, text, share):
    words = text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(11)
    rows = []
    for base in range(10):
        text = prose(base, rng.randrange(60, 300))
        rows.append((100 * base + 50, text))
        for k in range(12):
            rows.append((100 * base + k, edited(rng, text, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    rows += [(2000 + i, prose(500 + i, 80)) for i in range(40)]
    chain = prose(77, 200).split()  # each is near the next, the ends are not near each other
    rows += [(3000 + i, " ".join(chain[6 * i :] + prose(78, 200).split()[: 6 * i])) for i in range(12)]
    repeats = "alpha beta gamma delta epsilon zeta "
    rows += [(4000 + n, repeats * n) for n in (1, 2, 19, 20, 23, 24, 40)]
    return [*rows, (5000, ""), (5001, ""), (5002, "?!"), (5003, "?!"), (5004, "One two"), (5005, "one, TWO"), (5006, None),
            (None, rows[0][1]), (50, rows[0][1]), (5007, rows[3][1].upper() + "!"), (5008, prose(9999, 30_000))]


def test_equals_brute_force(spark):
    rows = corpus()
    wanted = brute_force(rows)
    ours = op.labelled(docs(spark, rows)).collect()
    assert len(ours) == len(rows)
    classes = {r.doc_id: r.class_id for r in ours if r.doc_id is not None}
    assert classes == {i: c for (i, _), c in wanted.items()} | {5006: 5006}
    assert {r.kept for r in ours if r.doc_id is None} == {True}


def test_one_of_each_class_stays(spark):
    rows = corpus()
    wanted = brute_force(rows)
    given = docs(spark, rows).selectExpr("*", "1 as bag", "2 as copy", "3 as class_id")
    kept = op.deduplicated(given)
    assert kept.columns == given.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(wanted.values())), "5006", "None"])


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3)
    rows = corpus()
    classes = {r.doc_id: r.class_id for r in op.labelled(docs(spark, rows)).collect()}
    assert {i: classes[i] for i, _ in brute_force(rows)} == {i: c for (i, _), c in brute_force(rows).items()}


def test_signatures_estimate_without_bias():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        a = Counter({k: rng.randrange(1, 9) for k in range(120)})
        b = Counter({k: rng.randrange(1, 9) for k in range(rng.randrange(60), 150)})
        pools = [(np.array(sorted(x)), x) for x in (a, b)]
        bags = bm.Bags(
            2, np.repeat([0, 1], [len(a), len(b)]),
            np.concatenate([bm.mixed(k.astype(np.uint64) + np.uint64(rng.randrange(2**32)) * np.uint64(0)) for k, _ in pools]),
            np.concatenate([[x[int(k)] for k in ks] for ks, x in pools]),
        )
        s = bm.signatures(bags)
        errors.append((s[0] == s[1]).mean() - weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_bag_keys_ignore_order():
    a, b, c = (bm.bag_keys(bm.bags_of(pa.array([t])))[0] for t in ("a b c d e f a b c d e", "f a b c d e f a b c d e", "a b c d e f a b c d e"))
    assert a == c != b


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 8), (7, 8), (8, 7), (9, 9)] + [(i, i + 1) for i in range(1000, 1100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_clashing_columns_are_kept(spark):
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(2, 60)), (4, None)]
    given = docs(spark, rows).selectExpr("*", "doc_id * 7 AS _n", "'c' AS _class", "5 AS _kept_doc_id", "6 AS copy", "7 AS `ROW`",
                                         "8 AS class_id", "9 AS place", "10 AS `a b.c`")
    out = op.deduplicated(given)
    assert out.columns == given.columns
    assert sorted((r.doc_id, r._n, r._class, r.copy, r.ROW, r.class_id, r["a b.c"]) for r in out.collect()) == [
        (i, 7 * i, "c", 6, 7, 8, 10) for i in (1, 3, 4)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert op.labelled(empty).collect() == [] and op.deduplicated(empty).collect() == []
