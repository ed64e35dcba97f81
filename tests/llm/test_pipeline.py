from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from curdline.llm import packing, substring_dedup, toxicity
from tests.llm import test_decontamination, test_near_duplicates
from tests.llm.helpers import docs, prose
from tests.llm.test_tokens import ids_of

ITEMS = [(j, prose(7000 + j, 25)) for j in range(3)]


def corpus():
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randrange(80, 260))) for i in range(30)]
    shared = prose(900, 70)
    rows += [(100 + i, prose(100 + i, 40) + "\n" + shared + " " + prose(200 + i, 40)) for i in range(5)]
    rows += [(200 + i, test_near_duplicates.edited(rng, rows[i][1], 0.01)) for i in range(4)]
    rows += [(210 + i, rows[5][1]) for i in range(3)]
    rows += [(300 + j, prose(300 + j, 50) + ". " + " ".join(t.split()[12:] + ["and"] + t.split()[:12])) for j, t in ITEMS]
    rows += [(400 + i, prose(400 + i, 20) + ". You are a stupid worthless idiot. I will kill you, you idiot.") for i in range(4)]
    # a text that is a passage of an earlier, much longer one
    rows += [(500, " ".join(rows[0][1].split()[:60]))]
    return rows + [(600, None), (601, ""), (None, prose(601, 30)), (602, prose(602, 3000)), (603, "a b c"), (604, "a b c")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs(spark, corpus()).selectExpr("*", "doc_id AS copy", "1 AS bag", "'x' AS _cuts_").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(
        [(i, int(400 <= i < 404)) for i, _ in corpus() if i is not None], "doc_id bigint, toxic int"
    ).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def cut(rows):
    """Substring dedup by its definition; what is left of cut texts, joined by single spaces."""
    source = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    windows = [(i, [tuple(w[p : p + substring_dedup.WINDOW]) for p in range(len(w) - substring_dedup.WINDOW + 1)]) for i, w in words]
    for i, found in windows:
        for w in found if i is not None else []:
            source[w] = min(source.get(w, i), i)
    out = []
    for (i, t), (_, w), (_, found) in zip(rows, words, windows, strict=True):
        gone = {q for p, x in enumerate(found) if i is not None and source[x] < i for q in range(p, p + substring_dedup.WINDOW)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        if left or not gone:
            out.append((i, left))
    return out


def test_stages_equal_brute_force(spark, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(given, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in corpus() if model.score(r[1]) < 0.5]
    assert {i for i, _ in corpus()} - {i for i, _ in rows} == {400, 401, 402, 403}
    wanted = [rows]
    classes = test_near_duplicates.brute_force(rows)
    wanted.append([(i, t) for i, t in rows if i is None or t is None or classes[i, t] == i])
    wanted.append(cut(wanted[-1]))
    found = test_decontamination.brute_force(wanted[-1], ITEMS)
    wanted.append([r for r in wanted[-1] if r[0] not in {f[0] for f in found}])
    assert [len(w) for w in wanted] == [len(corpus()) - 4, len(corpus()) - 4 - 8, len(corpus()) - 13, len(corpus()) - 16]

    held = given
    for (_, stage), rows in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        held = stage(spark, held, folder)
        assert held.columns == given.columns
        kept = held.collect()
        assert sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in kept) == sorted((i is None, i, t is None, t) for i, t in rows)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)

    pieces = corpus_pipeline.run(spark, folder).collect()
    lengths, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        lengths[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert dict(lengths) == {i: len(ids_of(t)) for i, t in wanted[-1]}
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(parts)] and ends[-1] <= packing.CAPACITY


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
