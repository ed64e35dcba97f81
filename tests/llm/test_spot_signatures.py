from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from curdline.llm import spot_signatures as op
from curdline.llm.queries import op3_spot_signatures
from tests.llm.helpers import DOCUMENTS, docs


def brute_spots(text):
    """Spots by walking over the words."""
    words = ["^", *re.findall(r"[^\W_]+", (text or "").lower())]
    found = set()
    for i, w in enumerate(words):
        if w in op.ANCHORS or i == 0:
            chain, skipped = [], 0
            for x in words[i + 1 :]:
                if x in op.ANCHORS:
                    skipped += 1
                    if skipped > op.REACH:
                        break
                else:
                    chain.append(x)
                    skipped = 0
                    if len(chain) == op.CHAIN:
                        break
            if chain:
                found.add((w, *chain))
    return found or ({text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(op.ANCHORS[:6]) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(n))


def corpus():
    rows = [(i, sentence(i, 3 + i * 7 % 150).capitalize()) for i in range(60)]
    return [*rows, (100, rows[5][1]), (101, None), (102, ""), (103, "!?! ..."), (104, "the of and"), (105, "the " * 40 + "end"),
            (106, "Über die Straße, É — x"), (None, "no id the one"), (107, rows[5][1]), (107, "other"), (107, "other"), (108, sentence(9, 20_000))]


def expected(rows):
    ordered = sorted(rows, key=lambda r: r[1] or "", reverse=True)
    ordered.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, follows = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + follows[:third]
        own = brute_spots(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, brute_spots(edited)), jaccard(own, brute_spots(follows))))
    return out


def key(r):
    return str((r[0], r[1], r[2]))


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_equals_brute_force(spark, monkeypatch, partitions):
    rows = corpus()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    found = op.digests(docs(spark, rows).selectExpr("*", "1 as spots", "2 as bucket")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    ours = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]
    assert sorted(ours, key=key) == sorted(expected(rows), key=key)
    by_text = {}
    texts = {(i, len(t or "")): t or "" for i, t in rows}
    for r in found:
        assert by_text.setdefault(texts[r.doc_id, r.n_chars], r.fingerprint) == r.fingerprint


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for base in range(8):
        words = sentence(base, 120).split()
        for k in range(8):
            own = list(words)
            for _ in range(k // 2):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * base + k, " ".join(own)))
    members, pairs = op.near_pairs(docs(spark, rows))
    of = {r.doc_id: r.fingerprint for r in members.collect()}
    found = {(r.a, r.b): r.likeness for r in pairs.collect()}
    sets = {i: brute_spots(t) for i, t in rows}
    wanted = {}
    for x, y in itertools.combinations(of, 2):
        if of[x] != of[y] and jaccard(sets[x], sets[y]) >= op.LIKENESS:
            wanted[tuple(sorted((of[x], of[y])))] = jaccard(sets[x], sets[y])
    assert found == pytest.approx(wanted) and len(wanted) > 50


def test_query_is_native_and_empty_tables_work(spark):
    plan = op3_spot_signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = spark.createDataFrame([], DOCUMENTS)
    assert op.digests(empty).collect() == [] and op.near_pairs(empty)[1].collect() == []
    one = op.digests(docs(spark, [(4, "only the one text")])).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 17)]
