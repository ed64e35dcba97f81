from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from curdline.llm import source_audit as op
from tests.llm.helpers import DOCUMENTS

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_force(rows, least, ranks):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for x, s in counts if x == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows_ in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(rows_, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Apfel", "é", "x", "日本", "Zz") for b in "abcdefghijkl"]
    rows = []
    for _ in range(500):
        lang, source = rng.choice(["en", "en", "en", "fr", None, ""]), f"s{int(rng.paretovariate(0.6)) % 23}"
        own = words[hash(source) % 7 :: 2] if rng.random() < 0.5 else words
        rows.append((lang, source, "".join(rng.choice(own) + rng.choice([" ", "1", "\n", "-", " "]) for _ in range(rng.randrange(25)))))
    rows += [("en", None, "apfela " * 30), ("en", "", None), ("en", "only rare", "qqq"), ("en", "no terms", "123 ..."), ("xx", "alone", "a b"),
             ("yy", "a", "rare"), ("yy", "b", None), ("en", "s1", "apfelb " * 20_000), ("en", "ß", rows[0][2]), ("en", "ß", rows[0][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1) for i, (lang, s, t) in enumerate(rows)], DOCUMENTS).repartition(4).selectExpr(
        "*", "1 AS term", "2 AS n", "3 AS docs", "4 AS item")


def test_equals_brute_force(spark):
    rows = corpus()
    out = op.audited(frame(spark, rows), 12, 9)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute_force(rows, 12, 9)


def test_any_blocks_give_the_same_divergences(spark, monkeypatch):
    """Cells of two groups and three terms: every pair meets in one cell of each term block."""
    monkeypatch.setattr(op, "PARTIAL_ROWS", 20)
    rows = corpus()
    held, groups = op.shares(frame(spark, rows), 12)
    wanted = sorted(map(tuple, op.pair_divergences(held, groups).collect()))
    small = op.pair_divergences(held, groups, groups_per_block=2, terms_per_block=3).collect()

    def ordered(found):
        return sorted((lang, *sorted((a, b)), v) for lang, a, b, v in found)

    assert ordered(map(tuple, small)) == ordered(wanted) and len(wanted) > 200


def test_large_counts_are_exact(spark):
    p = spark.range(1).selectExpr(f"{op._share('CAST(4000000000000 AS BIGINT)', '9000000000000L', '100000L')} AS p").first()["p"]
    assert p == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 5 * 100_000)


def test_empty_table(spark):
    assert op.audited(spark.createDataFrame([], DOCUMENTS)).collect() == []
