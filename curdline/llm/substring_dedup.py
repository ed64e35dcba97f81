"""Substring dedup by De Bruijn compaction: words covered by a window that an earlier document also has go.

The edges of the graph are the runs of ``WINDOW`` words. They are dealt by their minimizer, the smallest hash of
the ``SEED`` word runs inside an edge, which depends on the edge alone: equal edges meet, wherever they stand.
Consecutive edges of one document with one minimizer form a path. Only a path is stored: its minimizer, a hash of
all its words, and its source coordinates (document, first word, number of edges).

1. A minimizer that only one document has cannot lie in a repeated edge; its paths end there (a join drops them).
2. A path with the same words as one of a smaller document is repeated as a whole: nonbranching, settled at once.
3. A minimizer with several distinct paths is a branching place. There, the first source of each distinct path is
   opened into its single edges, read again from its text; each edge gets the smallest document that has it.
4. The covered words of all found edges are cut from the texts, which join the coordinates by document.

A match needs equal minimizer and equal path or edge hash, 128 bits in all. Every row has the same treatment at
every size: nothing is capped or sampled, and all groupings are sums or joins that Spark can split.

Cases: null text: no words. Null doc_id: its row stays whole and is no source. Rows that share a doc_id are no
sources of each other. Texts under ``WINDOW`` words stay. Empty table: empty result. Other columns are kept by
:func:`deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from curdline.llm.words import in_small_batches, sliced, words_of
from curdline.sources.tables import materialized

WINDOW = 50
SEED = 16

_PATHS = "doc_id bigint, copy bigint, seed bigint, path bigint, at int, edges int"


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _edge_seeds(words) -> tuple[np.ndarray, np.ndarray]:
    """Of all edges: the first word and the minimizer."""
    n = len(words.hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - SEED + 1)
    least = _sliding_min(words.range_hashes(at, at + SEED), WINDOW - SEED + 1)
    inside = np.repeat(words.first[1:], words.counts())[: len(least)] - WINDOW >= np.arange(len(least))
    edges = np.flatnonzero(inside)
    return edges, least[edges]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        words = words_of(batch.column("text"))
        edges, seeds = _edge_seeds(words)
        row = np.repeat(np.arange(batch.num_rows), words.counts())[edges]
        new = np.ones(len(edges), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(edges)))
        first, row = edges[begin], row[begin]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(row)),
            batch.column("copy").take(pa.array(row)),
            pa.array(seeds[begin].view(np.int64)),
            pa.array(words.range_hashes(first, first + count + WINDOW - 1).view(np.int64)),
            pa.array((first - words.first[row]).astype(np.int32)),
            pa.array(count.astype(np.int32)),
        ], names=["doc_id", "copy", "seed", "path", "at", "edges"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single edges of the listed paths of each text."""
    for batch in sliced(batches, "text"):
        words = words_of(batch.column("text"))
        listed = batch.column("cuts")
        row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
        cuts = listed.flatten()
        at, count = cuts.field("at").to_numpy(), cuts.field("edges").to_numpy()
        which = np.repeat(np.arange(len(row)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        place = at[which] + step
        first = words.first[row[which]] + place
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(row[which])),
            batch.column("copy").take(pa.array(row[which])),
            cuts.field("seed").take(pa.array(which)),
            pa.array(words.range_hashes(first, first + WINDOW).view(np.int64)),
            pa.array(place.astype(np.int32)),
        ], names=["doc_id", "copy", "seed", "edge", "at"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, cuts): runs of edges, by first word and number, that a smaller document has too.

    ``copy`` is a hash of the text, as rows with one doc_id may hold several.
    """
    texts = in_small_batches(documents).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "xxhash64(text) AS copy").filter(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    paths = materialized(texts.mapInArrow(_paths, _PATHS), "paths")
    # what is joined below is written first: then both sides are plain shuffles, and Spark splits a hot key
    shared = materialized(
        paths.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high").select("seed"), "shared_seeds"
    )
    met = materialized(paths.join(shared, "seed", "left_semi"), "met_paths")
    kinds = materialized(met.groupBy("seed", "path").agg(F.min("doc_id").alias("source")), "kinds")
    branching = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("seed")
    sources = materialized(kinds.join(branching.withColumn("open", F.lit(True)), "seed", "left"), "sources")
    placed = materialized(met.join(sources, ["seed", "path"]), "placed_paths")
    whole = placed.filter("doc_id > source").select("doc_id", "copy", "at", "edges")

    opened = (
        placed.filter("open AND doc_id = source").groupBy("doc_id", "copy")
        .agg(F.collect_list(F.struct("at", "edges", "seed")).alias("cuts"))
    )
    edges = materialized(
        texts.join(opened, ["doc_id", "copy"]).mapInArrow(
            _edges, "doc_id bigint, copy bigint, seed bigint, edge bigint, at int"
        ), "edges"
    )
    least = materialized(
        edges.groupBy("seed", "edge").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
        .filter("source < last").drop("last"), "shared_edges"
    )
    single = edges.join(least, ["seed", "edge"]).filter("doc_id > source").select(
        "doc_id", "copy", "at", F.lit(1).alias("edges")
    )
    return whole.union(single).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "edges")).alias("cuts"))


def _kept_mask(n_words: int, cuts: list[tuple[int, int]]) -> np.ndarray:
    depth = np.zeros(n_words + 1, np.int64)
    for at, edges in cuts:
        depth[at] += 1
        depth[at + edges + WINDOW - 1] -= 1
    return np.cumsum(depth[:-1]) == 0


def _texts_with_cuts(batch: pa.RecordBatch, cuts_name: str) -> Iterator[tuple[list[bytes] | None, list | None]]:
    for text, cuts in zip(batch.column("text"), batch.column(cuts_name), strict=True):
        words = text.as_py().encode().split() if text.is_valid else None
        yield words, [(c["at"], c["edges"]) for c in cuts.as_py()] if cuts.is_valid else None


def _free(name: str, columns: list[str]) -> str:
    """The name, or a longer one that no column has (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _with_cuts(documents: DataFrame, cuts: str) -> DataFrame:
    """Whole rows beside their cuts, a column of that name; rows without any join too, null ids included."""
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"),
    )
    found = repeated_spans(documents).withColumnRenamed("cuts", cuts)
    return rows.join(found, ["doc_id", "copy"], "left").select("row.*", cuts)


def digests(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            counts, removed, hashes = [], [], []
            for words, cuts in _texts_with_cuts(batch, "cuts"):
                words = words or []
                kept = words
                if cuts:
                    mask = _kept_mask(len(words), cuts)
                    kept = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = _with_cuts(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "cuts")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, with the repeated words cut from ``text`` and ``n_chars`` counted anew.

    A text from which nothing is cut stays as it is; what is left of another is joined by single spaces. A
    document of which nothing is left goes, as it adds nothing to the corpus.
    """
    columns = documents.columns
    cuts_name = _free("cuts", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = []
            for text, (words, cuts) in zip(batch.column("text"), _texts_with_cuts(batch, cuts_name), strict=True):
                if cuts:
                    mask = _kept_mask(len(words), cuts).tolist()
                    texts.append(b" ".join(w for w, k in zip(words, mask, strict=True) if k).decode())
                else:
                    texts.append(text.as_py())
            place = batch.schema.get_field_index("text")
            keep = pa.array([not c.is_valid or bool(t) for t, c in zip(texts, batch.column(cuts_name), strict=True)])
            batch = batch.set_column(place, "text", pa.array(texts, pa.string())).select(columns)
            yield batch.filter(keep).cast(schema)

    schema = to_arrow_schema(documents.schema)
    cut = _with_cuts(documents, cuts_name).mapInArrow(run, documents.schema)
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return cut
