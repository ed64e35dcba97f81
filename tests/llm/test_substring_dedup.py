from __future__ import annotations

import hashlib
import random
import re

from curdline.llm import substring_dedup as op
from tests.llm.helpers import DOCUMENTS, docs, prose


def brute_force(rows):
    found = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for p in range(len(w) - op.WINDOW + 1):
            key = tuple(w[p : p + op.WINDOW])
            if i is not None:
                found[key] = min(found.get(key, i), i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for p in range(len(w) - op.WINDOW + 1):
            if i is not None and found[tuple(w[p : p + op.WINDOW])] < i:
                gone.update(range(p, p + op.WINDOW))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def corpus():
    rng = random.Random(5)
    passages = [prose(s, 90) for s in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages).split()
            a, b = rng.randrange(0, 30), rng.randrange(55, 91)
            cut = p[a:b]
            if rng.random() < 0.4:
                cut[rng.randrange(len(cut))] = "changed"
            parts += [" ".join(cut), prose(1000 + rng.randrange(10**6), rng.randrange(0, 30))]
        rows.append((i * 3, "\n".join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (2, "x " * 170), (4, "x " * 120), (5, "a b " * 90 + "x " * 60)]
    rows += [(7, None), (8, ""), (None, rows[4][1]), (None, None), (9, rows[9][1]), (9, rows[9][1]), (10, "é ß " * 80),
             (11, "é ß\t" * 70 + "q"), (12, prose(77, 30_000)), (13, prose(78, 400) + " " + prose(77, 30_000))]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    ours = [tuple(r) for r in op.digests(docs(spark, rows)).collect()]
    assert sorted(ours, key=key) == sorted(brute_force(rows), key=key)
    assert sum(r[2] for r in ours) > 1000


def test_texts_are_cut_and_columns_kept(spark):
    shared = prose(1, 60)
    rows = [(1, f"{shared} tail one"), (2, f"head two\n{shared} end"), (3, shared), (4, "short  one"), (5, None)]
    given = docs(spark, rows).selectExpr("*", "1 as CUTS", "9 as cuts_", "'x' as _cuts", "2 as at", "3 as row", "4 as copy")
    result = op.deduplicated(given)
    assert result.columns == given.columns
    kept = {r.doc_id: (r.text, r.n_chars) for r in result.collect()}
    assert kept == {1: (f"{shared} tail one", len(f"{shared} tail one")), 2: ("head two end", 12), 4: ("short  one", 10), 5: (None, None)}


def test_empty_table(spark):
    assert op.digests(spark.createDataFrame([], DOCUMENTS)).collect() == []
    assert op.deduplicated(spark.createDataFrame([], DOCUMENTS)).collect() == []
