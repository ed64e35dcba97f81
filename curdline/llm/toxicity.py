"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Words are mapped to classes by a lexicon: insults, threats, targets, negations, reporting verbs. One transducer for
each class reads the words of a clause and writes marks; their composition (:func:`clause_marks`) reads all marks
at once and holds a small state: how long a negation, a target or a reporting verb still reaches. A hit (an insult
or a threat) leaves the clause as one of ten kinds of evidence: insult or threat, aimed at someone or not, and
then negated ("not an idiot"), reported ("she said he is an idiot") or plain. The weight of a hit is that of its
lexicon arc; a clause counts its weights by kind, so the same word counts for more or less by what stands around it.

The lexicon holds fixed seed words and what labelled rows teach: word beginnings of ``STEMS`` letters and whole
words that stand in toxic documents far oftener than in others (log odds, one count for each document). The
weights of the kinds are a logistic regression over documents, fitted to cells of equal clipped counts, so the
fit is over few rows however many documents there are.

Both are fitted on at most ``FIT_ROWS`` labelled documents of each label (those with the least hash of the id), a
stated sample; scoring covers every document and its whole text. Fitting uses no label of a held-out row.

Cases: null or empty text: no evidence, the score is that of a clean text. Repeated rows: each is scored. Null
doc_id: scored, not held out. No labels, or labels of one kind: the seed words and prior weights alone. Empty table:
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curdline.llm.words import in_small_batches

FIT_ROWS = 20_000
STEMS = (5, 6)
#: Toxic documents that must hold a learned word or stem, and its least log odds.
LEAST_SUPPORT = 5
LEAST_LOG_ODDS = 4.0
#: Learned entries, by log odds and then support; bounds what is collected and sent to executors.
LEXICON_ENTRIES = 50_000

# Seed words of the classes in English, German, French and Spanish.
INSULTS = ("idiot moron stupid loser worthless pathetic scum trash disgusting clown imbecile dumb fool filthy vermin "
           "dummkopf trottel abschaum widerlich imbécile crétin ordure débile imbécil estúpido basura asqueroso")
THREATS = "kill hurt destroy beat shoot stab burn punish umbringen töten schlagen tuer frapper matar golpear"
TARGETS = ("you your yours u he she they him her them his their these those people du dich dir ihr euch sie tu toi "
           "vous te ils elles tú usted ustedes ellos")
NEGATIONS = "not never no isn aren wasn don doesn nicht kein keine nie pas jamais nunca jamás"
REPORTS = "said says say wrote writes called claims reported quoted sagte sagt schrieb dit disait écrit dijo dice escribió"
_INSULT, _THREAT, _TARGET, _NEGATION, _REPORT = range(1, 6)
_SEEDS = {w: c for c, ws in ((_TARGET, TARGETS), (_NEGATION, NEGATIONS), (_REPORT, REPORTS), (_THREAT, THREATS),
                             (_INSULT, INSULTS)) for w in ws.split()}
SEED_WEIGHT = 3.0
#: Words over which a negation, a target and a reporting verb reach.
REACH = {_NEGATION: 3, _TARGET: 4, _REPORT: 6}

KINDS = [f"{a}_{b}" for a in ("insult", "threat") for b in ("plain", "aimed", "negated", "reported")]
# Prior weights of the kinds and of a clean text, and how strongly they hold without evidence.
PRIOR = dict(zip(KINDS, (2.0, 2.5, 0.5, 0.8, 0.8, 2.0, 0.0, 0.2), strict=True))
PRIOR_INTERCEPT = -2.0
MOST_LEVEL = 6

_WORD_OR_STOP = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    """Word classes with weights; learned stems stand for all words that begin with them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def arc(self, word: str) -> tuple[int, float]:
        """(class, weight) of a lower-case word; class 0: none."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:  # a memory of what was looked up, not a limit of the lexicon
                self.known.clear()
            kind = _SEEDS.get(word, 0)
            learned = max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), 0.0)
            if learned and kind in (0, _INSULT):
                found = (_INSULT, max(learned, SEED_WEIGHT if kind else 0.0))
            else:
                found = (kind, SEED_WEIGHT if kind else 0.0)
            self.known[word] = found
        return found

    def without_memory(self) -> Lexicon:
        return Lexicon(self.words, self.stems)


def clause_marks(clause: list[str], lexicon: Lexicon) -> Iterator[tuple[str, float]]:
    """The composed transducer: (kind, weight) of every hit of one clause."""
    negated = aimed = reported = 0
    waiting = []  # hits that a later target in reach would aim
    for place, word in enumerate(clause):
        kind, weight = lexicon.arc(word)
        if kind in (_INSULT, _THREAT):
            what = "insult" if kind == _INSULT else "threat"
            how = "negated" if negated else "reported" if reported else "aimed" if aimed else "plain"
            if how == "plain":
                waiting.append((place, what, weight))
            else:
                yield f"{what}_{how}", weight
        elif kind == _TARGET:
            for at, what, weight in waiting:
                yield f"{what}_{'aimed' if place - at <= REACH[_TARGET] else 'plain'}", weight
            waiting = []
        negated, aimed, reported = (
            REACH[c] if kind == c else max(0, n - 1)
            for c, n in ((_NEGATION, negated), (_TARGET, aimed), (_REPORT, reported))
        )
    for _, what, weight in waiting:
        yield f"{what}_plain", weight


def evidence(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """The weights of all hits of a text, summed by kind."""
    sums = np.zeros(len(KINDS))
    lower = (text or "").lower()
    if not any(lexicon.arc(w)[0] in (_INSULT, _THREAT) for w in set(_WORD.findall(lower))):
        return sums
    clause: list[str] = []
    for token in [*_WORD_OR_STOP.findall(lower), "."]:
        if token in ".!?;:\n":
            for kind, weight in clause_marks(clause, lexicon):
                sums[KINDS.index(kind)] += weight
            clause = []
        else:
            clause.append(token)
    return sums


def levels(sums: np.ndarray) -> np.ndarray:
    """Sums of weights as levels 0 to MOST_LEVEL; one hit of a seed word is level 1."""
    return np.minimum(np.round(sums / SEED_WEIGHT), MOST_LEVEL).astype(np.int32)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights @ levels(evidence(text, self.lexicon)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.expr(f"crc32(encode(CAST({doc_id} AS STRING), 'UTF-8')) % 5 = 0"), F.lit(False))


def _learned_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems of insults from labelled texts: one count for each document, summed before they are collected."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            found = []
            for label, text in zip(toxic, batch.column("text").to_pylist(), strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
                found += [(w, False, label) for w in words] + [(s, True, label) for s in {w[:n] for n in STEMS for w in words if len(w) >= n}]
            entry, stem, label = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry, pa.string()), pa.array(stem, pa.bool_()), pa.array(label, pa.int32())],
                names=["entry", "stem", "toxic"],
            )

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    counts = rows.mapInArrow(entries, "entry string, stem boolean, toxic int").groupBy("entry", "stem").agg(
        F.sum("toxic").alias("t"), F.expr("sum(1 - toxic)").alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    best = counts.filter(F.col("t") >= LEAST_SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS)
    lexicon = Lexicon()
    for r in best.orderBy(F.desc("odds"), F.desc("t"), "entry", "stem").limit(LEXICON_ENTRIES).collect():
        if r.entry not in _SEEDS or _SEEDS[r.entry] in (_INSULT, _THREAT):
            (lexicon.stems if r.stem else lexicon.words)[r.entry] = min(float(r.odds), 8.0)
    return lexicon


def _fitted_weights(cells: list[tuple]) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with Gaussian priors; cells are (levels..., toxic, count)."""
    prior = np.array([PRIOR[k] for k in KINDS] + [PRIOR_INTERCEPT])
    if not cells:
        return prior[:-1], float(prior[-1])
    table = np.array(cells, float)
    x, y, n = np.column_stack([table[:, : len(KINDS)], np.ones(len(table))]), table[:, -2], table[:, -1]
    beta, hold = prior.copy(), np.array([1.0] * len(KINDS) + [0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - hold * (beta - prior)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from labelled rows that are not held out."""
    spark = documents.sparkSession
    train = labels.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(toxic AS INT) AS toxic").filter(
        ~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    ).dropDuplicates(["doc_id"])
    sample = [r for label in (0, 1) for r in train.filter(F.col("toxic") == label).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()]  # at most 2 x FIT_ROWS pairs of numbers
    if not sample:
        return Model(Lexicon(), *_fitted_weights([]))
    chosen = F.broadcast(spark.createDataFrame([tuple(r) for r in sample], "doc_id bigint, toxic int"))
    rows = in_small_batches(documents).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(chosen, "doc_id").select("text", "toxic")
    lexicon = _learned_lexicon(rows)
    shipped = spark.sparkContext.broadcast(lexicon.without_memory())
    names = ", ".join(f"{k} int" for k in KINDS)

    def leveled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            found = np.array([levels(evidence(t, own)) for t in batch.column("text").to_pylist()], np.int32).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(found[:, k]) for k in range(len(KINDS))), batch.column("toxic")], names=[*KINDS, "toxic"]
            )

    cells = rows.mapInArrow(leveled, f"{names}, toxic int").groupBy(*KINDS, "toxic").agg(F.count("*").alias("n")).collect()
    return Model(lexicon.without_memory(), *_fitted_weights([tuple(r) for r in cells]))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; only the text enters the score."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.score
        for batch in batches:
            found = np.array([score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns kept, that the model does not reject."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_()))

    return in_small_batches(documents).mapInArrow(run, documents.schema)
