from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curdline.llm import collocations as op
from curdline.llm import double_array
from tests.llm.helpers import DOCUMENTS, prose

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_force(rows, least, ranks):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    scores = {}
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scores[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)
    inside = {
        (lang, p[i : i + m]) for (lang, p), a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
        if 100 * a >= 80 * found[lang, p[i : i + m]]
    }
    out = []
    for lang in totals:
        own = [(-s[3], -s[0], " ".join(p).encode(), s) for (x, p), s in scores.items() if x == lang and (x, p) not in inside]
        out += [(lang, r, phrase.decode(), *s[:3], totals[lang], s[3]) for r, (_, _, phrase, s) in enumerate(sorted(own)[:ranks], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    fixed = ["new york city hall", "New York", "of the", "à la carte", "É É É É É", "a a a", "hot\tdog stand", "in spite of", " odd space x"]
    rows = []
    for i in range(260):
        words = [rng.choice(fixed) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "en", "fr", None, "und", "", "zz"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for w in words)))
    return rows + [("en", None), ("en", ""), ("en", "..,;\n \t"), ("fr", rows[0][1]), ("fr", rows[0][1]), ("zz", "rare words only"), ("de", prose(4, 40_000, 60))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], DOCUMENTS).repartition(3).selectExpr(
        "*", "1 AS id", "2 AS h", "3 AS words", "4 AS n", "5 AS part")


@pytest.mark.parametrize("part", [500_000, 40])
def test_equals_brute_force(spark, part):
    rows = corpus()
    out = op.collocations(frame(spark, rows), min_count=12, ranks=60, part=part)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    ours = sorted(map(tuple, out.collect()))
    assert ours == brute_force(rows, 12, 60)
    assert len(ours) > 100 and any(len(r[2].split(" ")) == 4 for r in ours)


def test_small_slabs_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    """Texts are never cut; a bitmap whose bits are mostly shared adds candidates only."""
    rows = corpus()[:120]
    monkeypatch.setattr(op, "SLAB", 50)
    monkeypatch.setattr(op, "FILTER_BITS", 64)
    ours = sorted(map(tuple, op.collocations(frame(spark, rows), min_count=8, ranks=40).collect()))
    assert ours == brute_force(rows, 8, 40)


def test_shared_ids_are_made_anew(spark, monkeypatch):
    real, seen = op.word_id, []

    def clashing(word, lang, seed):
        return real(word[:1] if seed == 0 else word, lang, seed)

    monkeypatch.setattr(op, "word_id", clashing)
    ids = op.with_ids
    monkeypatch.setattr(op, "with_ids", lambda words, seed, *more: (seen.append(seed), ids(words, seed, *more))[1])
    rows = corpus()[:80]
    ours = sorted(map(tuple, op.collocations(frame(spark, rows), min_count=6, ranks=30).collect()))
    assert seen == [0, 0, 1, 1] and ours == brute_force(rows, 6, 30)


def test_shared_buckets_are_made_anew(spark, monkeypatch):
    """Hashes of which most phrases share one: a level whose buckets hold more than their phrase is repeated."""
    real, factors = op.candidates, []

    def sharing(texts, k, shorter, min_count, part, factor, word_ids):
        factors.append((k, factor))
        return real(texts, k, shorter, min_count, part, 0 if k == 2 and len(factors) == 1 else factor, word_ids)

    monkeypatch.setattr(op, "candidates", sharing)
    rows = corpus()[:80]
    ours = sorted(map(tuple, op.collocations(frame(spark, rows), min_count=6, ranks=30).collect()))
    assert [k for k, _ in factors] == [2, 2, 3, 4] and ours == brute_force(rows, 6, 30)


@pytest.mark.parametrize("most", [1 << 20, 300, 100, 40])
def test_slabs_of_a_task_are_added_up(most):
    """A phrase found in many slabs is one row, unless there are more phrases than a worker holds."""
    rng = np.random.default_rng(3)
    slabs = []
    for i in range(60):
        hashes, counts = np.unique(rng.integers(0, 60 if i % 20 else 250, 50 if i % 7 else 0), return_counts=True)
        slabs.append([hashes, counts, (hashes * 3).astype(np.int32)])
    wanted = Counter()
    for hashes, counts, _ in slabs:
        wanted.update(dict(zip(hashes.tolist(), counts.tolist(), strict=True)))
    out, sums = list(op._added_up(iter(slabs), most)), Counter()
    for hashes, counts, half in out:
        assert len(hashes) <= most + 60 and len(set(hashes.tolist())) == len(hashes) and (half == hashes * 3).all()
        sums.update(dict(zip(hashes.tolist(), counts.tolist(), strict=True)))
    assert sums == wanted
    if most >= 300:
        assert sum(len(c[0]) for c in out) <= len(wanted) * (1 if most > 300 else 3) < sum(len(c[0]) for c in slabs)


def test_last_words_follow_from_hashes():
    columns = [np.random.default_rng(i).integers(1, 1 << 62, 1000) for i in range(4)]
    assert (op._unmixed(op.mixed(columns[0].view(np.uint64))) == columns[0].view(np.uint64)).all()


def test_empty_table(spark):
    assert op.collocations(spark.createDataFrame([], DOCUMENTS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 400), st.integers(0, 300), st.integers(0, 10**6))
def test_trie_counts_equal_brute_force(length, alphabet, n, seed):
    rng = np.random.default_rng(seed)
    sequences = np.unique(rng.integers(1, alphabet + 1, (n, length)) * 7919, axis=0)
    sequences = sequences[rng.permutation(len(sequences))]
    text = rng.integers(0, alphabet + 3, 500) * 7919
    counts = Counter(tuple(text[i : i + length].tolist()) for i in range(len(text) - length + 1))
    assert double_array.build(sequences).counts(text).tolist() == [counts[tuple(s)] for s in sequences.tolist()]


def test_trie_stays_dense():
    rng = np.random.default_rng(1)
    sequences = np.unique((rng.zipf(1.3, (60_000, 3)) % 40_000).astype(np.int64), axis=0)
    trie = double_array.build(sequences)
    assert len(trie.base) < 8 * len(sequences)
    assert (trie.counts(sequences.ravel()) > 0).all()
