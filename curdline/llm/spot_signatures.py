"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is reduced to lower-case words. Every anchor (a common word, or the text's beginning) starts a spot: the next
``CHAIN`` content words after it, anchors between them being skipped (``REACH`` at most each time; near the end of a
text a chain may be shorter). The hashes of all spots, as a set, are the fingerprint. Boilerplate has few common
words in running order, so the body of a text decides.

:func:`near_pairs` compares sets exactly: they are partitioned by size, as sets of likeness t differ in size by a
factor of at most 1/t, and only sets that share one of their rarest spots (the prefix that a near set cannot miss)
within one or two neighbouring partitions meet.

Only DataFrame and SQL functions are used; a regular expression finds all spots of a text in one pass. Its loops are
bounded or possessive, so long texts need no deep stack.

Cases: null or empty text: no spots; two such are alike (1.0), one and any other are not (0.0). A text without words
has its own hash as the only spot, so has one of anchors alone. Repeated rows follow each other. Null doc_id: after
all others. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curdline.sources.tables import materialized

CHAIN = 3
REACH = 8
LIKENESS = 0.8
#: Common words of English, German, French and Spanish; ^ is a text's beginning.
ANCHORS = ("the of and to in is a that it der die und das ein nicht zu mit le la les et des un une que el los y en con "
           "por para de").split()

_ANCHOR = rf"(?:{'|'.join(ANCHORS)})(?= )"
# an anchor and its chain, read from where the anchor stands without moving on, so that chains may overlap
_SPOT = rf"(?<= )(?=((?:\^|{_ANCHOR})(?:(?: {_ANCHOR}){{0,{REACH}}}+ (?!{_ANCHOR})[^ ]+){{1,{CHAIN}}}))"
_INNER_ANCHOR = rf"(?<= ){_ANCHOR} "


def spots(text: Column) -> Column:
    """The set of spot hashes of a text that is not null, sorted."""
    words = F.concat(F.lit(" ^ "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    lines = F.array_join(F.regexp_extract_all(words, F.lit(_SPOT), 1), "\n")
    chains = F.filter(F.split(F.regexp_replace(lines, _INNER_ANCHOR, ""), "\n"), lambda c: c != "")
    found = F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c))))
    return F.when(lines != "", found).when(text != "", F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(found: Column) -> Column:
    """The number of spots and 128 bits of their set, as text."""
    halves = [F.lpad(F.lower(F.hex(F.xxhash64(found, F.lit(i)))), 16, "0") for i in (0, 1)]
    return F.concat(F.size(found).cast("string"), F.lit("-"), *halves)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of spots; of two empty ones 1."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def _bucket_bounds(documents: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 doc_ids that cut the table into parts of about equal numbers of rows."""
    shares = [i / buckets for i in range(1, buckets)]
    found = documents.agg(F.percentile_approx("doc_id", shares, 20 * buckets)).first()[0]
    return sorted(set(found or []))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie below, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) < doc_id, at + step).otherwise(at)
    )


def with_next(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, spots and next_text, next_spots of the row that follows in descending order of doc_id.

    After the last row comes the first. The order runs through ``buckets`` ranges of doc_id; the first row of each is
    also sent to the range before it. Only texts in one range are sorted together.
    """
    spark = documents.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.withColumn("bucket", _bucket(F.col("doc_id"), _bucket_bounds(texts, buckets)))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one row for each bucket
    first = rows.join(F.broadcast(tops), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(
        F.max("text").alias("text"), F.max("doc_id").alias("doc_id")
    )
    around = Window.orderBy(F.desc("bucket"))  # over one row for each bucket
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tops.select("bucket", F.coalesce(F.lag("bucket").over(around), F.last("bucket").over(whole)).alias("goes_to"))
    guests = first.join(F.broadcast(before), "bucket").selectExpr("doc_id", "text", "goes_to AS bucket", "true AS guest")
    placed = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    spotted = placed.withColumn("spots", spots(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    following = F.lead(F.struct("text", "spots")).over(order).alias("following")
    return spotted.select("doc_id", "text", "spots", "guest", following).filter("NOT guest").selectExpr(
        "doc_id", "text", "spots", "following.text AS next_text", "following.spots AS next_spots"
    )


def digests(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness; see the columns."""
    third = F.floor(F.length("text") / 3).cast("int")
    edited = with_next(documents).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)
    ))
    both = edited.withColumn("edited_spots", spots(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def near_pairs(documents: DataFrame, least: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and fingerprint of all rows; fingerprints a < b of likeness ``least`` or more."""
    members = materialized(documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), spots(F.coalesce("text", F.lit(""))).alias("spots")
    ).withColumn("fingerprint", fingerprint(F.col("spots"))), "spots")
    sets = materialized(members.filter("size(spots) > 0").groupBy("fingerprint").agg(F.first("spots").alias("spots")), "sets")
    sets = sets.withColumn("n", F.size("spots")).withColumn("partition", F.expr(f"CAST(floor(log(n) / {-math.log(least)}) AS INT)"))
    single = sets.select("fingerprint", "n", "partition", F.explode("spots").alias("spot"))
    common = materialized(single.groupBy("spot").agg(F.count("*").alias("sets")).filter("sets > 1"), "common_spots")
    # spots of one set alone stand first in the order of rareness, and match nothing
    rank = Window.partitionBy("fingerprint").orderBy(F.desc("sets"), F.desc("spot"))
    prefix = single.join(common, "spot").withColumn("from_end", F.row_number().over(rank)).filter(
        f"from_end >= ceil({least} * n - 1e-9)"
    )
    prefix = materialized(prefix.select("fingerprint", "n", "partition", "spot"), "prefixes")
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.expr("sequence(partition - 1, partition + 1)")).alias("partition"))
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "spot", "partition")
    met = left.join(right, ["spot", "partition"]).filter(f"a < b AND least(na, nb) >= {least} * greatest(na, nb) - 1e-9")
    pairs = met.select("a", "b").distinct()
    compared = pairs.join(sets.selectExpr("fingerprint AS a", "spots AS sa"), "a").join(sets.selectExpr("fingerprint AS b", "spots AS sb"), "b")
    near = compared.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(f"likeness >= {least}")
    return members.select("doc_id", "fingerprint"), near
