"""How far sources differ in their words: exact divergences between all sources of a language, by a cube of cells.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that at least
``MIN_DOCUMENTS`` of its documents hold. Each (lang, source) group, and each language as a whole, gives every kept
term the share ``p = 1 + SCALE * (count + 5) div (N + 5 * V)``, N being the group's occurrences of kept terms and V the
number of kept terms; all of it in whole numbers.

1. *Counts.* Each task counts its documents' terms by language and source, then Spark adds the partial counts up. A
   source that holds a third of all rows is one partial row per term and task.
2. *Cube.* The pairs of groups of a language and the terms span a cube. Groups are dealt to blocks of about
   ``GROUPS_PER_BLOCK``, terms to blocks of about ``TERMS_PER_BLOCK``. A cell (group block, group block, term block) is
   one row group of the shuffle: the slice of a group in a term block, with its shares, is sent to each cell of its
   group block, so a cell holds two dense matrices of bounded size and gives the partial sums of all its pairs.
3. *Reduction.* The partial sums of a pair are added along the term axis. Terms that neither group of a pair holds in
   a cell's matrices add the difference of the two empty shares, as often as there are such terms.

Cases: null text, lang and source count as empty strings, so rows without a source are a group of their own. A
document is a row, also if rows share a doc_id or a text. A group without terms has shares like any other. V = 0: the
values of all pairs are 0 and there are no term rows. A single source of a language has no pairs. Ties: the item that
comes first in UTF-8 bytes. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curdline.llm.words import in_small_batches, sliced
from curdline.sources.tables import materialized

MIN_DOCUMENTS = 30
SCALE = 1_000_000_000
PSEUDO = 5
TERM_RANKS = 50
GROUPS_PER_BLOCK = 32
TERMS_PER_BLOCK = 4096
#: Partial counts a task holds before it hands them on; this bounds memory, not results.
PARTIAL_ROWS = 300_000

GROUP = ["lang", "source"]
# the characters that are no ASCII other than letters, as bytes
_TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(partial_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial counts of occurrences and documents by lang, source and term; '' stands for a document without terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = {}
        documents: dict[tuple[str, str], Counter] = {}

        def partial() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), counts in occurrences.items():
                held = documents[lang, source]
                columns[0] += [lang] * len(counts)
                columns[1] += [source] * len(counts)
                columns[2] += [t.decode() for t in counts]
                columns[3] += counts.values()
                columns[4] += [held[t] for t in counts]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(columns)],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in sliced(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                terms = _TERMS(text.lower()) or [b""]  # bytes: A-Z only
                occurrences.setdefault((lang, source), Counter()).update(terms)
                documents.setdefault((lang, source), Counter()).update(set(terms))
            if sum(map(len, occurrences.values())) > partial_rows:
                yield partial()
                occurrences.clear()
                documents.clear()
        if occurrences:
            yield partial()

    return run


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), and a row with an empty term for the documents without terms of a group."""
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = in_small_batches(texts).mapInArrow(_counted(PARTIAL_ROWS), _COUNTS)
    return partial.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> str:
    """In decimals of 38 digits, as the product may pass 64 bits."""
    return f"1 + (CAST({SCALE} AS DECIMAL(38, 0)) * ({count} + {PSEUDO})) DIV CAST({total} + {PSEUDO} * {terms} AS DECIMAL(38, 0))"


def shares(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Per group and kept term it holds: lang, source, term, n, p, q. Per group: lang, source, terms, total, empty (p of a count of 0)."""
    counts = materialized(term_counts(documents), "term_counts")
    kept = materialized(
        counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= min_documents).select("lang", "term", "lang_n"), "kept_terms"
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = materialized(counts.join(kept, ["lang", "term"]).drop("docs"), "held_terms")
    totals = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = materialized(
        counts.select(*GROUP).distinct().join(totals, GROUP, "left").join(langs, "lang", "left").select(
            *GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        ).withColumn("empty", F.expr(f"IF(terms = 0, 0L, {_share('0', 'total', 'terms')})")), "groups"
    )
    p, q = F.expr(_share("n", "total", "terms")), F.expr(_share("lang_n", "lang_total", "terms"))
    return held.join(groups, GROUP).select(*GROUP, "term", "n", p.alias("p"), q.alias("q")), groups


def _cell(keys: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of one cell: rows (source, share) of two group blocks in one term block."""
    sources, owner = np.unique(np.array(table.column("source").to_pylist(), object), return_inverse=True)
    lefts, rights = (np.zeros(len(sources), bool) for _ in range(2))
    own_block = table.column("own").to_numpy()
    first, second = keys[1].as_py(), keys[2].as_py()
    lefts[owner[own_block == first]] = True
    rights[owner[own_block == second]] = True
    empty = np.zeros(len(sources), np.int64)
    empty[owner] = table.column("empty").to_numpy()
    marker = np.array(table.column("term").is_null())
    terms, place = np.unique(np.array(table.column("term").filter(pa.array(~marker)).to_pylist(), object), return_inverse=True)
    matrix = np.repeat(empty[:, None], len(terms), 1)
    matrix[owner[~marker], place] = table.column("p").to_numpy(zero_copy_only=False)[~marker]
    out_a, out_b, out_f = [], [], []
    for a in np.flatnonzero(lefts):
        # within one block each pair once
        others = np.flatnonzero(rights & (np.arange(len(sources)) > a)) if first == second else np.flatnonzero(rights)
        out_a += [sources[a]] * len(others)
        out_b += sources[others].tolist()
        out_f += np.abs(matrix[others] - matrix[a]).sum(axis=1).tolist()
    return pa.table({
        "lang": pa.array([keys[0].as_py()] * len(out_a), pa.string()), "a": pa.array(out_a, pa.string()),
        "b": pa.array(out_b, pa.string()), "f": pa.array(out_f, pa.int64()),
        "present": pa.array([len(terms)] * len(out_a), pa.int64()),
    })


def pair_divergences(
    held: DataFrame, groups: DataFrame, groups_per_block: int = GROUPS_PER_BLOCK, terms_per_block: int = TERMS_PER_BLOCK
) -> DataFrame:
    """(lang, a, b, value) of every two groups of a language, a before b or in an earlier block."""
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / groups_per_block).cast("int").alias("group_blocks"),
        F.greatest(F.ceil(F.max("terms") / terms_per_block), F.lit(1)).cast("int").alias("term_blocks"),
    )
    placed = groups.join(blocks, "lang").withColumn("own", F.expr("CAST(pmod(xxhash64(source), group_blocks) AS INT)"))
    dealt = placed.select(*GROUP, "empty", "own", "group_blocks", "term_blocks")
    slices = held.join(dealt, GROUP).withColumn("c", F.expr("CAST(pmod(xxhash64(term), term_blocks) AS INT)"))
    # a marker for each group and term block: a cell knows all groups of its blocks, also those without terms there
    markers = dealt.withColumns({
        "c": F.explode(F.expr("sequence(0, term_blocks - 1)")), "term": F.lit(None).cast("string"), "p": F.lit(None).cast("bigint")
    })
    columns = [*GROUP, "term", "p", "empty", "own", "c", F.explode(F.expr("sequence(0, group_blocks - 1)")).alias("other")]
    replicated = slices.select(*columns).union(markers.select(*columns)).select(
        "lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "source", "term", "p", "empty", "own"
    )
    partial = replicated.groupBy("lang", "i", "j", "c").applyInArrow(_cell, "lang string, a string, b string, f bigint, present bigint")
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("present").alias("present"))
    ends = [groups.select("lang", F.col("source").alias(s), "terms", F.col("empty").alias(f"empty_{s}")) for s in ("a", "b")]
    return summed.join(ends[0], ["lang", "a"]).join(ends[1].drop("terms"), ["lang", "b"]).select(
        "lang", "a", "b", (F.col("f") + (F.col("terms") - F.col("present")) * F.abs(F.col("empty_a") - F.col("empty_b"))).alias("value")
    )


def audited(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module's text."""
    held, groups = shares(documents, min_documents)
    pairs = materialized(pair_divergences(held, groups), "pairs")
    pair = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        pairs.select("lang", "b", "a", "value")
    )
    term = held.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    return (
        pair.select(*GROUP, F.lit("pair").alias("part"), "item", "value", ranked)
        .union(term.select(*GROUP, F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= term_ranks))
    )
