"""Phrases whose words belong together: frequent phrases of 2 to 4 words, scored by exact counts.

1. *Words.* Texts are cut into pieces and words; Spark counts the words of every language. A word's id is a 63-bit hash
   seeded by its language; if two words share the id of a frequent one, all ids are made anew from another seed. So ids stand for words exactly.
2. *Ids.* Each text becomes an array of ids, 0 standing between pieces and for words that are too rare to be in any
   candidate. The arrays are written once; all later passes read only them.
3. *Candidates* of length k, level by level. A phrase is a candidate if both its phrases of k-1 words are frequent, and
   if the bucket of its 64-bit hash holds ``MIN_COUNT`` occurrences of such phrases: both hold for every phrase with
   MIN_COUNT occurrences. Frequent phrases are known by a bitmap of fixed size; a bit that two phrases share only adds
   candidates. A bucket hands on one phrase; if the trie counts fewer occurrences of it than the bucket holds, another
   phrase is in the bucket, and the level is done anew with other hashes. So no phrase is missed.
4. *Counts.* Candidates are dealt to parts of about ``PART`` by hash. A part becomes a double-array trie
   (:mod:`curdline.llm.double_array`), some tens of megabytes whatever the corpus, and is broadcast. Each task walks its
   shard of the texts through the trie, all positions at once and level by level, counts the accepting states with one
   ``bincount``, and Spark sums the shards' counts. What is held by a trie grows with PART only; a larger corpus has
   more parts, one after the other.
5. *Scores.* Spark joins the counts of a phrase's two sides for each cut, takes the lowest score, leaves out phrases
   inside longer ones and ranks. Products are decimals of 38 digits.

Cases: null text: empty; null lang: ``und``. Empty pieces hold no words. Rows that repeat a text or doc_id count each
time; doc_id and other columns are not read. Ties are settled by the contract: scores after flooring to the smallest
cut, ranks by count, then by the phrase's UTF-8 bytes. A language without candidates has no rows. Empty table: empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curdline.llm import double_array
from curdline.llm.words import in_small_batches, mixed, sliced
from curdline.sources.tables import materialized

MIN_COUNT = 30
LONGEST = 4
RANKS = 2000
SCALE = 2_000_000
#: A longer phrase with this percentage of a candidate's occurrences stands for it.
COVER = 80
#: Candidates of one trie.
PART = 500_000
#: Bits of the bitmap of frequent words or phrases.
FILTER_BITS = 1 << 25
#: Positions that a task looks at together.
SLAB = 1 << 21
#: Phrases a worker adds up before it hands them on; bounds memory, not results.
HELD_PHRASES = 1 << 20
#: Words a worker remembers or counts before it hands them on; bounds memory, not results.
KNOWN_WORDS = 500_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+").findall
_FACTOR = 0xD1342543DE82EF95


def word_id(word: bytes, lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, zlib.crc32(lang.encode()) + (seed << 32)) >> 1 or 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Of each row its language, and its words and the marks between pieces."""
    for batch in sliced(batches, "text"):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            yield lang, _TOKENS(text.lower())  # bytes: A-Z only


def _texts(documents: DataFrame) -> DataFrame:
    return in_small_batches(documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    ))


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) of every word of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def partial() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                for mark in _BREAKS:
                    found.pop(bytes([mark]), None)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(found), pa.string()), pa.array([w.decode() for w in found], pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ], names=["lang", "word", "n"])
            counts.clear()

        for lang, tokens in _tokens(batches):
            counts.setdefault(lang, Counter()).update(tokens)
            if sum(map(len, counts.values())) > KNOWN_WORDS:
                yield from partial()
        yield from partial()

    return _texts(documents).mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame, seed: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """(lang, word, id, n); with a bitmap only words whose id it may hold."""
    shipped = words.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = batch.column("lang").to_pylist(), batch.column("word").cast(pa.binary()).to_pylist()
            ids = np.array([word_id(w, lang, seed) for lang, w in zip(langs, names, strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), pa.array(ids), batch.column("n")], names=["lang", "word", "id", "n"])
            yield out if shipped.value is None else out.filter(pa.array(_has(shipped.value, ids)))

    return words.mapInArrow(run, "lang string, word string, id bigint, n bigint")


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The bits of some ids, at most FILTER_BITS / 64 rows of them, as bytes."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    rows = ids.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, CAST(pmod({column}, 64) AS INT))").alias("bits"))
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, "<i8")
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def _has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids.astype(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Known(dict):
    """Ids of the words of one language; 0 for marks and for words that are not frequent."""

    def __init__(self, lang: str, seed: int, bitmap: np.ndarray) -> None:
        super().__init__({bytes([b]): 0 for b in _BREAKS})
        self.lang, self.seed, self.bitmap = lang, seed, bitmap

    def __missing__(self, word: bytes) -> int:
        number = word_id(word, self.lang, self.seed)
        bit = number & (8 * len(self.bitmap) - 1)
        self[word] = number = number if self.bitmap[bit >> 3] >> (bit & 7) & 1 else 0
        return number


def id_arrays(documents: DataFrame, frequent: np.ndarray, seed: int) -> DataFrame:
    """(ids): of each text 0, then the ids of its words, 0 between pieces and for words not in the bitmap."""
    shipped = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Known] = {}
        for batch in batches:
            lists = []
            for lang, tokens in _tokens(iter([batch])):
                if lang not in known:
                    known[lang] = _Known(lang, seed, shipped.value)
                row = np.zeros(len(tokens) + 1, np.int64)
                row[1:] = np.fromiter(map(known[lang].__getitem__, tokens), np.int64, len(tokens))
                lists.append(row)
            ends = np.cumsum([0, *map(len, lists)])
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], names=["ids"])
            if sum(map(len, known.values())) > KNOWN_WORDS:
                known.clear()

    return _texts(documents).mapInArrow(run, "ids array<bigint>")


def _slabs(batches: Iterator[pa.RecordBatch], slab: int) -> Iterator[np.ndarray]:
    """The ids of whole texts, one after the other, in arrays of ``slab`` positions or a little more."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(pc.list_flatten(batch.column("ids")).to_numpy())
        if sum(map(len, held)) >= slab:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`curdline.llm.words.mixed`."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _hashes(columns: list[np.ndarray], factor: int) -> np.ndarray:
    """Of word sequences, given by their columns. Sequences that differ in the last word alone never share one."""
    hashes = columns[0].view(np.uint64)
    for c in columns[1:]:
        hashes = mixed(hashes * np.uint64(factor) + c.view(np.uint64))
    return hashes.view(np.int64)


def _phrases(ids: np.ndarray, k: int, shorter: np.ndarray | None, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases of k words both whose shorter phrases are frequent, by a bitmap of these."""
    n = max(len(ids) - k + 1, 0)
    valid = ids != 0
    valid = np.all([valid[j : j + n] for j in range(k)], axis=0)
    at = np.flatnonzero(valid)
    if shorter is not None:
        before = _has(shorter, _hashes([ids[at + j] for j in range(k - 1)], _FACTOR))
        at = at[before]
        at = at[_has(shorter, _hashes([ids[at + j] for j in range(1, k)], _FACTOR))]
    return at, _hashes([ids[at + j] for j in range(k)], factor)


def _added_up(slabs: Iterator[list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of distinct hashes, their counts and more, those of many slabs added up: at most about ``most`` rows are held."""
    held: list[list[np.ndarray]] = []

    def together() -> list[np.ndarray]:
        hashes, counts, *more = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return [hashes[first], np.add.reduceat(counts[order], first), *[c[order[first]] for c in more]]

    for columns in slabs:
        if 2 * len(columns[0]) > most:  # as good as it gets
            yield columns
        elif len(columns[0]):
            held.append(columns)
        if sum(len(c[0]) for c in held) > most:
            held = [together()]
            if 2 * len(held[0][0]) > most:
                yield held.pop()
    if held:
        yield together()


def candidates(
    texts: DataFrame, k: int, shorter: np.ndarray | None, min_count: int, part: int, factor: int, word_ids: DataFrame
) -> DataFrame:
    """(w1 .. wk, most, part): phrases of k words whose bucket holds ``most`` occurrences, min_count or more.

    Buckets hand on half of each word's id but the last's, which keeps the shuffle small; ``word_ids`` (id), the frequent
    words, complete them. Words that share a half give candidates more, which no text holds.
    """
    spark, slab, held = texts.sparkSession, SLAB, HELD_PHRASES
    shipped = spark.sparkContext.broadcast(shorter)
    words = [f"w{i}" for i in range(1, k + 1)]
    halves = [f"half{i}" for i in range(1, k)]

    def slab_buckets(ids: np.ndarray) -> list[np.ndarray]:
        at, hashes = _phrases(ids, k, shipped.value, factor)
        hashes, example, counts = np.unique(hashes, return_index=True, return_counts=True)
        return [hashes, counts, *[ids[at[example] + j].astype(np.int32) for j in range(k - 1)]]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _added_up(map(slab_buckets, _slabs(batches, slab)), held):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "most", *halves])

    def last_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last word follows from the others and the hash."""
        for batch in batches:
            first = [batch.column(w).to_numpy() for w in words[:-1]]
            before = _hashes(first, factor).view(np.uint64) * np.uint64(factor)
            last = _unmixed(batch.column("h").to_numpy().view(np.uint64)) - before
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*first, last.view(np.int64))] + [batch.column("most")], names=[*words, "most"])

    # longer phrases repeat from slab to slab; pairs hardly do
    shards = texts if k == 2 else texts.coalesce(spark.sparkContext.defaultParallelism)
    found = shards.mapInArrow(buckets, ", ".join(["h bigint", "most bigint", *(f"{c} int" for c in halves)]))
    # nearly all rows of a task are distinct, so they are dealt first and added up once
    heavy = found.repartition("h").groupBy("h").agg(F.sum("most").alias("most"), *[F.first(c).alias(c) for c in halves])
    heavy = materialized(heavy.where(F.col("most") >= min_count), f"heavy_{k}")
    for word, half in zip(words, halves, strict=False):
        heavy = heavy.join(word_ids.select(F.col("id").alias(word), F.expr("CAST(shiftright(shiftleft(id, 32), 32) AS INT)").alias(half)), half)
    kept = materialized(heavy.select("h", "most", *words[:-1]).mapInArrow(last_words, ", ".join(f"{c} bigint" for c in [*words, "most"])), f"candidates_{k}")
    parts = max(-(-kept.count() // part), 1)
    return kept.withColumn("part", F.expr(f"CAST(pmod(xxhash64({', '.join(words)}), {parts}) AS INT)"))


def trie_counts(texts: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The candidates with their number of occurrences ``n``, counted part by part with a broadcast trie."""
    spark, slab = texts.sparkSession, SLAB
    words = [f"w{i}" for i in range(1, k + 1)]
    order = Window.partitionBy("part").orderBy(*words)
    # one shard for each core: the shards' sums are as many as cores times candidates, however long the texts
    shards = texts.coalesce(spark.sparkContext.defaultParallelism)
    numbered = materialized(found.withColumn("number", F.row_number().over(order) - 1), f"numbered_{k}")
    counted = None
    for part in range((numbered.agg(F.max("part")).first()[0] or 0) + 1):
        own = numbered.where(F.col("part") == part)
        table = own.select("number", *words).toArrow().sort_by("number")  # about PART rows
        trie = double_array.build(np.column_stack([table.column(w).to_numpy() for w in words]))
        shipped = spark.sparkContext.broadcast(trie)

        def shard(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shipped.value.sequences, np.int64)
            for ids in _slabs(batches, slab):
                total += shipped.value.counts(ids)
            number = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(total[number])], names=["number", "n"])

        sums = shards.mapInArrow(shard, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))
        rows = materialized(own.join(sums, "number").select(*words, "most", "n"), f"counts_{k}")
        shipped.unpersist()
        counted = rows if counted is None else counted.union(rows)
    return counted


def _with_hash(phrases: DataFrame, k: int) -> DataFrame:
    """(h): the hashes of phrases, by which later levels know them."""
    words = [f"w{i}" for i in range(1, k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes([batch.column(w).to_numpy() for w in words], _FACTOR))], names=["h"])

    return phrases.select(*words).mapInArrow(run, "h bigint")


def frequent_phrases(documents: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words per language (lang, n), frequent words (lang, word, id, n), all frequent words and phrases (words array<bigint>, f)."""
    words = materialized(word_counts(documents), "words")
    seed = 0
    while True:
        frequent = materialized(with_ids(words.where(F.col("n") >= min_count), seed), "frequent_words")
        bitmap = _bitmap(frequent, "id")
        held = with_ids(words, seed, bitmap)  # the frequent words, and few others
        if held.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    texts = materialized(id_arrays(documents, bitmap, seed), "word_ids")
    found = frequent.select(F.array("id").alias("words"), F.col("n").alias("f"))
    shorter = None
    for k in range(2, longest + 1):
        factor = _FACTOR
        while True:
            counted = trie_counts(texts, candidates(texts, k, shorter, min_count, part, factor, frequent), k)
            if counted.where("n < most").isEmpty():
                break
            factor += 2  # odd, like the first
        found = found.union(counted.select(F.array(*[f"w{i}" for i in range(1, k + 1)]).alias("words"), F.col("n").alias("f")))
        shorter = _bitmap(_with_hash(counted, k), "h")
    return words.groupBy("lang").agg(F.sum("n").alias("n")), frequent, materialized(found, "frequent_phrases")


def scored(phrases: DataFrame) -> DataFrame:
    """(words, a, l, r, score) of the phrases of two words and more that no longer phrase stands for."""
    size = F.size("words")
    own = phrases.where(size > 1).withColumnRenamed("f", "a")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({
        "first": F.expr("slice(words, 1, cut)"), "rest": F.expr("slice(words, cut + 1, size(words) - cut)"),
    })
    sides = cuts.join(phrases.toDF("first", "l"), "first").join(phrases.toDF("rest", "r"), "rest")
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(38, 0)) * a) DIV CAST(l + r AS DECIMAL(38, 0))")
    lowest = sides.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = (
        own.where(size > 2).withColumn("length", F.explode(F.sequence(F.lit(2), size - 1)))
        .withColumn("start", F.explode(F.expr("sequence(1, size(words) - length + 1)")))
        .groupBy(F.expr("slice(words, start, length)").alias("words")).agg(F.max("a").alias("longer"))
    )
    covered = F.expr(f"CAST(100 AS DECIMAL(38, 0)) * longer >= CAST({COVER} AS DECIMAL(38, 0)) * a")
    return lowest.join(inner, "words", "left").where(~F.coalesce(covered, F.lit(False))).select(
        "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")
    )


def collocations(
    documents: DataFrame, min_count: int = MIN_COUNT, ranks: int = RANKS, part: int = PART
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    totals, frequent, phrases = frequent_phrases(documents, min_count, LONGEST, part)
    names = frequent.select("id", "lang", "word")
    spelt = (
        scored(phrases).select("*", F.posexplode("words").alias("place", "id"))
        .join(names, "id").groupBy("words", "a", "l", "r", "score", "lang")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = spelt.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= ranks)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
