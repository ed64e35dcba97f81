"""Near-duplicate documents: BagMinHash signatures, bands, and exact checks of the multiset overlap.

1. Every text becomes a bag of word shingles and a signature (see :mod:`curdline.llm.bag_minhash`). Texts with one
   bag are one node from here on, so copies cost nothing more, however many there are.
2. Nodes that agree in a band share a bucket. Each is linked to the bucket's first node, not to all others. The
   components of these links are the clusters: no pair across clusters can be near.
3. The links are checked exactly: multiset Jaccard of the bags of at least ``LIKENESS``. In each cluster, the nodes
   that are near its hub (the node with most checked links) are settled, as they are one component.
4. The nodes left are compared with all nodes of their cluster, in blocks of about ``BLOCK`` nodes, each pair of
   blocks in a task of its own: a pair whose signatures agree in ``AGREEING`` of the places or more is checked
   exactly. (A near pair fails this with a probability below 1 in 10,000.) Only links that join something are
   returned. Nothing is dropped or capped, and no list of all pairs arises.
5. Components of all checked links are the classes, named by their smallest doc_id.

Cases: words are runs of letters and digits, ASCII case ignored. A text of fewer than five words is one shingle; a
text without words is near equal texts only. Null text or doc_id: never compared, class_id is the row's own doc_id.
Rows that share a doc_id are compared like any others. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curdline.llm.bag_minhash import BANDS, SIGNATURE, bag_keys, bags_of, band_keys, likeness, signatures
from curdline.llm.components import components
from curdline.llm.words import in_small_batches, sliced
from curdline.sources.tables import materialized

LIKENESS = 0.8
AGREEING = 0.66
BLOCK = 256

_SIGNED = "doc_id bigint, copy bigint, bag bigint, wordless boolean, bands array<bigint>, places binary"
_BAGS = "bag bigint, shingles array<bigint>, weights array<int>, places binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        bags = bags_of(batch.column("text"))
        signature = signatures(bags)
        keys, wordless = bag_keys(bags), np.isinf(signature[:, 0])
        copies = batch.column("copy").to_numpy(zero_copy_only=False)
        folded = (signature.view(np.uint64) >> np.uint64(20)).astype(np.uint8)
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("copy"),
            pa.array(np.where(wordless, copies, keys.view(np.int64))), pa.array(wordless),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(signature).view(np.int64).ravel())),
            pa.array([row.tobytes() for row in folded], pa.binary()),
        ], names=["doc_id", "copy", "bag", "wordless", "bands", "places"])


def _with_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        bags = bags_of(batch.column("text"))
        offsets = pa.array(bags.bounds().astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("bag"),
            pa.ListArray.from_arrays(offsets, pa.array(bags.shingle.view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(bags.weight.astype(np.int32))),
            batch.column("places"),
        ], names=["bag", "shingles", "weights", "places"])


def _bags(shingles: pa.Array, weights: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    bounds = np.asarray(shingles.offsets)
    bounds = bounds - bounds[0]
    shingle, weight = shingles.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy()
    return [(shingle[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    less, more = sorted((int(a[1].sum()), int(b[1].sum())))
    return less >= LIKENESS * more and likeness(a, b) >= LIKENESS


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(
            _bags(batch.column("shingles"), batch.column("weights")),
            _bags(batch.column("hub_shingles"), batch.column("hub_weights")), strict=True,
        )
        near = pa.array([_near(a, b) for a, b in pairs], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the left nodes and all nodes of two blocks, as few as connect what is near."""
    table = table.combine_chunks()
    node = table.column("bag").to_numpy()
    left = np.asarray(table.column("left").to_numpy())
    places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    bags = _bags(
        *(pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
          for c in ("shingles", "weights"))
    )
    root = {n: n for n in node.tolist()}

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    links = []
    others = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        agree = (places[others] == places[i]).sum(axis=1)
        for j in others[agree >= AGREEING * SIGNATURE]:
            a, b = find(int(node[i])), find(int(node[j]))
            if a != b and _near(bags[i], bags[j]):
                root[a] = b
                links.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _signed_rows(documents: DataFrame) -> DataFrame:
    rows = in_small_batches(documents).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "xxhash64(text) AS copy")
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")


def near_links(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """Checked links (a, b) between bags, enough of them to connect all that are near."""
    nodes = signed.filter("NOT wordless").groupBy("bag").agg(
        F.min(F.struct("doc_id", "copy")).alias("first"), F.first("bands").alias("bands"), F.first("places").alias("places")
    )
    nodes = materialized(nodes.selectExpr("bag", "first.doc_id", "first.copy", "bands", "places"), "nodes")
    members = nodes.select("bag", "doc_id", F.explode("bands").alias("bucket"))
    heads = materialized(
        members.groupBy("bucket").agg(F.min(F.struct("doc_id", "bag")).alias("head"), F.count("*").alias("n"))
        .filter("n > 1").selectExpr("bucket", "head.bag AS b"), "buckets",
    )
    pairs = materialized(
        members.join(heads, "bucket").filter("bag <> b").selectExpr("bag AS a", "b").distinct(), "band_pairs"
    )
    cluster = materialized(components(pairs), "clusters")
    wanted = nodes.join(cluster.select(F.col("node").alias("bag")), "bag", "left_semi").select("bag", "doc_id", "copy", "places")
    texts = _signed_rows(documents).join(wanted, ["doc_id", "copy"]).dropDuplicates(["bag"])
    bags = materialized(texts.select("bag", "text", "places").mapInArrow(_with_bags, _BAGS), "bags")

    first = pairs.join(bags.selectExpr("bag AS a", "shingles", "weights"), "a")
    both = first.join(bags.selectExpr("bag AS b", "shingles AS hub_shingles", "weights AS hub_weights"), "b")
    checked = materialized(both.mapInArrow(_checked, "b bigint, a bigint").select("a", "b"), "checked")

    size = cluster.groupBy("root").agg(F.count("*").alias("nodes"))
    degree = checked.join(cluster.withColumnRenamed("node", "b"), "b").groupBy("root", "b").agg(F.count("*").alias("links"))
    hub = degree.groupBy("root").agg(F.max(F.struct("links", F.col("b").alias("hub"))).alias("top")).selectExpr("root", "top.hub")
    near_hub = checked.join(hub.select(F.col("hub").alias("b")), "b", "left_semi").selectExpr("a AS node").union(hub.selectExpr("hub"))
    left = cluster.join(near_hub.distinct().withColumn("settled", F.lit(True)), "node", "left")
    counts = materialized(
        left.groupBy("root").agg(F.expr("count_if(settled IS NULL)").alias("open")).filter("open > 0").join(size, "root"),
        "open_clusters",
    )
    placed = left.join(counts, "root").selectExpr(
        "node AS bag", "root", "settled IS NULL AS open_node", "CAST(ceil(open / {0}) AS INT) AS open_blocks".format(BLOCK),
        "CAST(ceil(nodes / {0}) AS INT) AS all_blocks".format(BLOCK),
    )
    rows = bags.join(placed, "bag")
    payload = ["bag", "root", "shingles", "weights", "places"]
    queries = rows.filter("open_node").select(
        *payload, F.lit(True).alias("left"), F.expr("pmod(xxhash64(bag, 1), open_blocks)").alias("i"),
        F.explode(F.expr("sequence(0, all_blocks - 1)")).alias("j"),
    )
    targets = rows.select(
        *payload, F.lit(False).alias("left"), F.explode(F.expr("sequence(0L, open_blocks - 1L)")).alias("i"),
        F.expr("CAST(pmod(xxhash64(bag, 2), all_blocks) AS INT)").alias("j"),
    )
    found = queries.union(targets).groupBy("root", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")
    return checked.union(found)


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), class_id: one row per document."""
    signed = materialized(_signed_rows(documents).mapInArrow(_signed, _SIGNED), "signed")
    links = components(near_links(documents, signed))
    # a node in no link is its own class
    own = signed.groupBy("bag").agg(F.min("doc_id").alias("least"))
    grouped = own.join(links.withColumnRenamed("node", "bag"), "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    grouped = materialized(grouped, "grouped")
    named = materialized(grouped.groupBy("root").agg(F.min("least").alias("class_id")), "named")
    names = materialized(grouped.join(named, "root").select("bag", "class_id"), "class_names")
    return signed.select("doc_id", "copy", "bag").join(names, "bag").select("doc_id", "copy", "class_id")


def labelled(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, kept (it is the one that stays of its class)."""
    judged = classes(documents).select("doc_id", "class_id", F.expr("doc_id = class_id").alias("kept"))
    rest = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").filter("doc_id IS NULL OR text IS NULL")
    return judged.union(rest.selectExpr("doc_id", "doc_id", "true"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept: of each class the one with the smallest doc_id, once."""
    judged = classes(documents).filter("doc_id = class_id").distinct()
    # whole rows travel as one struct, so no column of theirs can clash with ours
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").isNull().alias("no_text"),
    )
    kept = rows.join(judged, ["doc_id", "copy"])
    first = Window.partitionBy("class_id").orderBy("copy")
    once = kept.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
    return once.union(rows.filter("doc_id IS NULL OR no_text").select("row.*"))
