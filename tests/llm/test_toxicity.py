from __future__ import annotations

import random
import zlib

import pytest

from curdline.llm import toxicity as op
from tests.llm.helpers import DOCUMENTS, docs, prose

LABELS = "doc_id bigint, quality int, toxic int"


def kinds(text, lexicon=None):
    lexicon = lexicon or op.Lexicon()
    return {k: round(v / op.SEED_WEIGHT, 3) for k, v in zip(op.KINDS, op.evidence(text, lexicon), strict=True) if v}


@pytest.mark.parametrize(("text", "wanted"), [
    ("You are an idiot.", {"insult_aimed": 1}),
    ("an idiot, as all of us know well, is what you are", {"insult_plain": 1}),
    ("Idiot! You there.", {"insult_plain": 1}),
    ("idiot you", {"insult_aimed": 1}),
    ("not an idiot", {"insult_negated": 1}),
    ("not that it matters here but an idiot", {"insult_plain": 1}),
    ("someone said the man was an idiot", {"insult_reported": 1}),
    ("I will kill them. Scum; trash", {"threat_aimed": 1, "insult_plain": 2}),
    ("the weather is fine", {}), ("", {}), (None, {}),
])
def test_clauses(text, wanted):
    assert kinds(text) == wanted


def test_context_changes_the_score():
    model = op.Model(op.Lexicon(), *op._fitted_weights([]))
    aimed, plain, reported, negated = map(model.score, ("you are a moron", "a moron", "he wrote moron", "not a moron"))
    assert aimed > plain > reported > negated > model.score("a day") == model.score(None) == model.score("")


def test_learned_words_separate_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(i, 60, 3000).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["zorgel", "vikkra"]) + rng.choice(["ta", "mo", "xi", "lu"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    documents = docs(spark, rows).selectExpr("*", "1 as toxic", "0 as score")
    model = op.fit(documents, spark.createDataFrame([*labels, labels[0], (None, 0, 1), (5, 1, None)], LABELS))
    out = {r.doc_id: r for r in op.scored(documents, model).collect()}
    assert {i: r.held_out for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in out}
    assert all(r.predicted == (i % 6 == 0) == (r.score >= 0.5) for i, r in out.items() if r.held_out)
    assert op.clean(documents, model).count() == 750
    assert op.clean(documents, model).columns == documents.columns


def test_held_out_labels_are_not_used(spark):
    rows = [(i, f"common words w{i} " + ("quarkle" if i % 2 else "")) for i in range(200)]
    other = [(i, 1, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i, _ in rows]
    same = [(i, 1, i % 2) for i, _ in rows]
    models = [op.fit(docs(spark, rows), spark.createDataFrame(x, LABELS)) for x in (other, same)]
    assert (models[0].weights == models[1].weights).all() and models[0].intercept == models[1].intercept
    assert models[0].lexicon.words == models[1].lexicon.words and "quarkle" in models[0].lexicon.words


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    given = docs(spark, [(1, None), (2, ""), (None, "you idiot"), (3, "idiot " * 50_000), (3, "idiot " * 50_000)])
    model = op.fit(given, none)
    scores = [(r.doc_id, r.predicted, r.held_out) for r in op.scored(given, model).collect()]
    assert sorted(scores, key=str) == sorted([(1, 0, False), (2, 0, False), (None, 1, False), (3, 1, False), (3, 1, False)], key=str)
    empty = spark.createDataFrame([], DOCUMENTS)
    assert op.scored(empty, op.fit(empty, none)).collect() == [] and op.clean(empty, model).collect() == []
