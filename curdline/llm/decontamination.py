"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set, all documents are searched. Runs of ``SEED_WORDS`` words of the benchmark items are
the seeds; a document meets an item where they share one. For every such pair the longest common runs are marked
again and again, longest first and never overlapping, neither in the document nor in the item, until none of at
least ``SEED_WORDS`` words is left: tiles. An item whose words are covered by tiles to ``COVERAGE`` or more counts
as contained, however its parts are ordered.

Seeds are joined in Spark. One pass over the documents hashes their words and keeps the places whose run may be a
seed, by a bitmap of ``FILTER_BITS`` bits of the items' seeds, the only thing that is broadcast; a larger benchmark
makes the bitmap fuller and the join larger, the result stays. What the pass finds is stored and never holds a text.
An item is looked up by its rarer seeds alone: the seeds that more items share are left out of the join as long
as they cover less than ``COVERAGE`` of its words, as a document that contains the item must then share one of the
others, too. So a passage common to many items meets only those that consist of it. Of the pairs found, those whose
shared seeds cannot reach ``COVERAGE`` are dropped; the rest are tiled one by one.

Tiling is running Karp-Rabin over the seeds: the longest common run of open words is found by bisecting its length,
each trial comparing rolling hashes of that length, and all runs of that length are marked in order. No list of all
equal places is made, so texts that repeat one word, or one verse, cost no more than others.

Words are runs of letters and digits without regard to ASCII case, so that punctuation and line breaks between
them do not hide a passage. Items of under ``SEED_WORDS`` words cannot be tiled; they are compared as a whole run
of their own length if they have ``LEAST_WORDS`` words.

Cases: null or empty texts and items: never contained. Null ids: rows are judged by their own text. Repeated rows:
each is judged. Empty table or benchmark: no pair, all documents kept. Ties: of equally long tiles the first in
the item, then in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curdline.llm.words import PLAIN, in_small_batches, sequence_hashes, sliced, words_of
from curdline.sources.tables import materialized

SEED_WORDS = 5
LEAST_WORDS = 3
COVERAGE = 0.6
FILTER_BITS = 26

ITEMS = "item_key binary, words int, seeds array<bigint>"
FOUND = "doc_id bigint, text_key binary, places array<int>, seeds array<bigint>"
TILED = "doc_id bigint, text_key binary, item_key binary, covered int, item_words int, tiles int"


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_key, words, seeds) of each distinct item text that can be contained; its seeds in the order of its words."""
    texts = in_small_batches(benchmark).where("text IS NOT NULL").select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), PLAIN)
            counts = words.counts()
            rows, seeds = [], []
            for row in np.flatnonzero(counts >= LEAST_WORDS):
                size = min(SEED_WORDS, int(counts[row]))
                at = np.arange(words.first[row], words.first[row + 1] - size + 1)
                rows.append(row)
                seeds.append(words.range_hashes(at, at + size).view(np.int64))
            if rows:
                first = np.concatenate([[0], np.cumsum([len(s) for s in seeds])])
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_key").take(pa.array(rows)), pa.array(counts[rows], pa.int32()),
                    _lists(np.concatenate(seeds), first, pa.int64()),
                ], names=["item_key", "words", "seeds"])

    return texts.withColumn("item_key", _text_key(F.col("text"))).mapInArrow(run, ITEMS)


def _places(items: DataFrame) -> DataFrame:
    """One row per place of a seed in an item."""
    size = F.least(F.col("words"), F.lit(SEED_WORDS)).alias("size")
    return items.select("item_key", "words", size, F.posexplode("seeds").alias("at", "seed"))


def rare_seeds(items: DataFrame) -> DataFrame:
    """The places of the seeds by which items are looked up, with ``common``: the words that the others cover.

    A word is as common as the most common seed over it. With the words from the most common one on, the seeds above
    the word at COVERAGE of the item's words cover less than that.
    """
    places = _places(items)
    spread = places.groupBy("seed").agg(F.count_distinct("item_key").alias("spread"))
    places = places.join(spread, "seed")
    words = places.withColumn("word", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)))
    words = words.groupBy("item_key", "words", "word").agg(F.max("spread").alias("spread"))
    order = Window.partitionBy("item_key").orderBy(F.desc("spread"), "word")
    limits = (
        words.withColumn("n", F.row_number().over(order)).where(F.col("n") == F.ceil(F.lit(COVERAGE) * F.col("words")))
        .select("item_key", F.col("spread").alias("limit"))
    )
    above = words.join(limits, "item_key").groupBy("item_key", "limit").agg(
        F.count_if(F.col("spread") > F.col("limit")).alias("common")
    )
    return places.join(above, "item_key").where("spread <= limit").select("seed", "item_key", "words", "size", "at", "common")


def _bitmap(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The items' seeds as a packed bitmap over their first FILTER_BITS bits (8 MB), and the seeds' lengths, at most three."""
    places = _places(items).withColumn("bit", F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1)
    parts = places.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"), F.collect_set("size").alias("sizes")
    ).collect()
    packed = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts:
        begin = (r["part"] - 1) * len(r["bits"])
        packed[begin : begin + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return packed, sorted({s for r in parts for s in r["sizes"]})


def found_places(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, places, seeds): for each document the places whose run may be a seed; none, no row."""
    packed, sizes = _bitmap(items)
    shipped = documents.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), PLAIN)
            place, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for size in sizes:
                at, hashes = words.runs(size)
                bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                likely = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                place.append(at[likely])
                seed.append(hashes[likely])
            place, seed = np.concatenate(place), np.concatenate(seed)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, seed = place[order], seed[order]
            row = np.searchsorted(words.first, place, "right") - 1
            rows, begin = np.unique(row, return_index=True)
            first = np.append(begin, len(place))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(rows)) for c in ("doc_id", "text_key")],
                _lists(place - words.first[row], first, pa.int32()), _lists(seed.view(np.int64), first, pa.int64()),
            ], names=["doc_id", "text_key", "places", "seeds"])

    texts = in_small_batches(documents).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key")
    )
    return texts.mapInArrow(run, FOUND)


def candidates(found: DataFrame, rare: DataFrame) -> DataFrame:
    """(uid, item_key) of the documents and items whose shared seeds may cover enough of the item."""
    met = found.select("uid", F.explode(F.array_distinct("seeds")).alias("seed")).join(rare, "seed")
    pairs = met.groupBy("uid", "item_key", "words", "size", "common").agg(F.sort_array(F.collect_set("at")).alias("at"))
    reach = "size + aggregate(sequence(1, size(at) - 1, 1), 0, (acc, i) -> acc + least(size, at[i] - at[i - 1]))"
    reach = f"CASE WHEN size(at) = 1 THEN size ELSE {reach} END"
    return pairs.where(F.expr(reach) + F.col("common") >= F.lit(COVERAGE) * F.col("words")).select("uid", "item_key")


def _windows(values: np.ndarray, shut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of n values none of which is shut."""
    gone = np.concatenate([[0], np.cumsum(shut)])
    at = np.flatnonzero(gone[n:] == gone[:-n])
    return at, sequence_hashes(values, at, at + n)


def _longest(item: np.ndarray, item_shut: np.ndarray, doc: np.ndarray, doc_shut: np.ndarray, most: int) -> int:
    """The most seeds, up to ``most``, of a run that both have; a part of a common run is common, so bisection finds it."""
    low, high = 0, most
    while low < high:
        n = (low + high + 1) // 2
        a, b = _windows(item, item_shut, n)[1], _windows(doc, doc_shut, n)[1]
        if len(a) and len(b) and np.isin(a, b).any():
            low = n
        else:
            high = n - 1
    return low


def tiling(places: np.ndarray, seeds: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words), longest first.

    ``places`` and ``seeds``: where runs of ``least`` words begin in the document, ascending, and their hashes;
    ``item``: the hashes of all such runs of the item, in order.
    """
    known = np.isin(seeds, item)
    places, seeds = places[known], seeds[known]
    if not len(places):
        return []
    # places are moved together where nothing between them can be shared; runs that overlap still do
    spot = np.concatenate([[0], np.cumsum(np.minimum(np.diff(places), least))])
    doc = np.zeros(int(spot[-1]) + least, np.uint64)
    doc_shut = np.ones(len(doc), bool)
    origin = np.zeros(len(doc), np.int64)
    doc[spot], doc_shut[spot], origin[spot] = seeds, False, places
    item_shut = np.zeros(len(item), bool)
    tiles = []
    most = min(len(item), len(doc))
    while most := _longest(item, item_shut, doc, doc_shut, most):
        n = most + least - 1
        at, key = _windows(item, item_shut, most)
        there, there_key = _windows(doc, doc_shut, most)
        order = np.lexsort((there, there_key))
        there, there_key = there[order], there_key[order]
        low, high = np.searchsorted(there_key, key), np.searchsorted(there_key, key, "right")
        taken = np.zeros(len(doc) + n, bool)
        following: dict[int, int] = {}
        item_end = 0
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            if i < item_end or a == b:
                continue
            k = following.get(a, a)
            while k < b and (taken[there[k]] or taken[there[k] + n - 1]):  # marks of one round are equally long
                k += 1
            following[a] = k
            if k == b:
                continue
            d = int(there[k])
            tiles.append((int(origin[d]), i, n))
            taken[d : d + n] = True
            item_end = i + n
            item_shut[max(0, i - least + 1) : i + n] = True
            doc_shut[max(0, d - least + 1) : d + n] = True
    return tiles


def _tiled(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and distinct item text that it contains."""
    items = materialized(item_seeds(benchmark), "item_seeds")
    found = materialized(
        found_places(documents, items).withColumn("uid", F.monotonically_increasing_id()), "found_places"
    )
    pairs = candidates(found, rare_seeds(items)).join(found, "uid").join(
        items.withColumnRenamed("seeds", "item"), "item_key"
    ).select("doc_id", "text_key", "item_key", "words", "places", "seeds", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, covered, count = [], [], []
            column = {c: batch.column(c) for c in ("words", "places", "seeds", "item")}
            for row in range(batch.num_rows):
                places, seeds, item = (
                    column[c][row].values.to_numpy(zero_copy_only=False) for c in ("places", "seeds", "item")
                )
                words = column["words"][row].as_py()
                tiles = tiling(places.astype(np.int64), seeds.view(np.uint64), item.view(np.uint64), min(words, SEED_WORDS))
                total = sum(n for _, _, n in tiles)
                if total >= COVERAGE * words:
                    rows.append(row)
                    covered.append(total)
                    count.append(len(tiles))
            if rows:
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([
                    *[taken.column(c) for c in ("doc_id", "text_key", "item_key")], pa.array(covered, pa.int32()),
                    taken.column("words"), pa.array(count, pa.int32()),
                ], names=["doc_id", "text_key", "item_key", "covered", "item_words", "tiles"])

    return in_small_batches(pairs).mapInArrow(run, TILED)


def contained_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, item_words, tiles, coverage): the items that documents contain, and only those."""
    ids = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), _text_key(F.col("text")).alias("item_key"))
    return _tiled(documents, benchmark).join(ids, "item_key").select(
        "doc_id", "item_id", "covered", "item_words", "tiles", (F.col("covered") / F.col("item_words")).alias("coverage")
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that contain no item."""
    key = "k" + "_" * max(map(len, documents.columns))  # no column has so long a name
    dirty = materialized(_tiled(documents, benchmark).select(F.col("text_key").alias(key)).distinct(), "dirty_texts")
    return documents.join(dirty, _text_key(documents["text"]) == dirty[key], "left_anti")
