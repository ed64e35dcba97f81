"""Shards of near equal bytes by a k-d tree over document metadata.

The space has three dimensions: text length (logarithmic), language and source. A node of the tree is split along
its widest dimension, widths being shares of the whole table's range, at the weighted median: so many bytes go left
as the leaves there are to hold. Leaves are the shards. All nodes of a level are split together.

The medians are distributed: a split looks for its place in a histogram of ``BUCKETS`` equal intervals of the node's
range, whose sums of bytes Spark aggregates, then in the interval that holds it, until that holds less than
``TOLERANCE`` of a shard or a single key. The driver sees only those sums, at most shards x BUCKETS numbers, and
keeps the tree, one split for each shard but one. Nodes are boxes of the space, rows of a small table that is joined to
the documents: the tree is data, so all passes have the same few plans and the driver compiles them once. Keys end in bits of a hash of the text, then of the document, so
rows with equal metadata can be split, however many they are. Equal texts with equal metadata stay side by side: they
share a shard unless a split falls among them, and one text held by more rows than a shard takes is spread over
neighbouring shards. Languages and sources are placed by hashes, so any script will do.

Only DataFrame and SQL functions are used. Texts are read once, for their sizes; the splits work on a narrow table.

Cases: null text: no bytes, size ``ROW_BYTES``, checksum 0. Null language or source: below all others. Null doc_id
and repeated rows are rows like any others. Fewer rows than shards: some shards are empty. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curdline.sources.tables import materialized

SHARDS = 40
ROW_BYTES = 16
BUCKETS = 2048
TOLERANCE = 0.001
#: A shard's rows are numbered in so many parts at once.
SLOT_PARTS = 32

_TIE_BITS = 24
_LAST_KEY = (1 << 62) - 1
_DIMENSIONS = ("by_length", "by_lang", "by_source")


@dataclass
class Node:
    """A part of the space: from ``first`` on, ``leaves`` shards."""

    first: int
    leaves: int
    dimension: str | None = None
    key: int | None = None  # rows with a greater key go right
    left: Node | None = None
    right: Node | None = None


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a 62-bit key for each dimension."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    half = _TIE_BITS // 2
    tie = F.expr(
        f"shiftleft(shiftrightunsigned(xxhash64(text_crc32, size), {64 - half}), {half})"
        f" + shiftrightunsigned(xxhash64(doc_id), {64 - half})"
    )
    coordinates = {
        "by_length": F.expr("CAST(floor(log2(size) * 1048576) AS BIGINT)"),
        "by_lang": F.expr("IF(lang IS NULL, 0L, shiftrightunsigned(xxhash64(lang), 32) + 1)"),
        "by_source": F.expr("IF(source IS NULL, 0L, shiftrightunsigned(xxhash64(source), 32) + 1)"),
    }
    keys = [(F.least(c, F.lit((1 << 38) - 1)) * (1 << _TIE_BITS) + tie).alias(d) for d, c in coordinates.items()]
    return rows.select("doc_id", "size", "text_crc32", *keys)


def _boxes(node: Node, box: dict[str, tuple[int, int]] | None = None) -> dict[int, dict[str, tuple[int, int]]]:
    """The box of each leaf: the first and last key it takes in each dimension. Together they are the whole space."""
    box = box or dict.fromkeys(_DIMENSIONS, (0, _LAST_KEY))
    if node.left is None:
        return {node.first: box}
    low, high = box[node.dimension]
    return _boxes(node.left, box | {node.dimension: (low, node.key)}) | _boxes(node.right, box | {node.dimension: (node.key + 1, high)})


def _inside(rows: DataFrame, boxes: dict[int, dict[str, tuple[int, int]]], **columns: dict[int, int]) -> DataFrame:
    """The rows in boxes, with their node and further columns given by node; at most one box holds a row."""
    values = ", ".join(
        "(" + ", ".join([f"{i}", *(f"{k}L" for d in _DIMENSIONS for k in box[d]), *(f"{c[i]}L" for c in columns.values())]) + ")"
        for i, box in boxes.items()
    )
    names = ["node", *(f"{d}_{end}" for d in _DIMENSIONS for end in ("first", "last")), *columns]
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS boxes({', '.join(names)})")
    held = F.expr(" AND ".join(f"{d} BETWEEN {d}_first AND {d}_last" for d in _DIMENSIONS))
    return rows.join(F.broadcast(table), held).select(*rows.columns, "node", *columns)


def _widest(row, whole) -> str:
    def width(d: str) -> float:
        range_ = (whole[f"{d}_high"] - whole[f"{d}_low"]) >> _TIE_BITS
        return ((row[f"{d}_high"] - row[f"{d}_low"]) >> _TIE_BITS) / range_ if range_ else 0.0

    return max(_DIMENSIONS, key=lambda d: (width(d), row[f"{d}_high"] - row[f"{d}_low"]))


def _split(
    rows: DataFrame, nodes: dict[int, Node], boxes: dict[int, dict[str, tuple[int, int]]], found: dict[int, object], whole, leaf_bytes: float
) -> None:
    """Set the dimension and key of all nodes at their weighted medians."""
    low, high, before, wanted = {}, {}, {}, {}
    for i, n in nodes.items():
        n.dimension = _widest(found[i], whole)
        low[i], high[i] = found[i][f"{n.dimension}_low"], found[i][f"{n.dimension}_high"]
        before[i], wanted[i] = 0, found[i]["size"] * (n.leaves // 2) / n.leaves
    searching = dict(nodes)
    while searching:
        width = {i: (high[i] - low[i]) // BUCKETS + 1 for i in searching}
        inside = _inside(
            rows, {i: boxes[i] | {n.dimension: (low[i], high[i])} for i, n in searching.items()},
            along={i: _DIMENSIONS.index(n.dimension) for i, n in searching.items()}, low={i: low[i] for i in searching}, width=width,
        ).withColumn("key", F.expr(f"element_at(array({', '.join(_DIMENSIONS)}), CAST(along AS INT) + 1)"))
        sums: dict[int, list[tuple[int, int, bool]]] = {i: [] for i in searching}
        totals = [F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single")]
        for r in inside.groupBy("node", F.expr("(key - low) DIV width").alias("bucket")).agg(*totals).collect():
            sums[r["node"]].append((r["bucket"], r["size"], r["single"]))
        for i, n in list(searching.items()):
            total = before[i]
            for bucket_, size, single in sorted(sums[i]):
                if total + size >= wanted[i]:
                    break
                total += size
            end = min(low[i] + (bucket_ + 1) * width[i] - 1, high[i])
            if single or size <= TOLERANCE * leaf_bytes:
                # the end of the interval that is nearer to the wanted sum
                n.key = end if total + size - wanted[i] <= wanted[i] - total else low[i] + bucket_ * width[i] - 1
                del searching[i]
            else:
                before[i], low[i], high[i] = total, low[i] + bucket_ * width[i], end


def tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The k-d tree over :func:`metadata` rows."""
    root = Node(0, shards)
    level, whole = {0: root} if shards > 1 else {}, None
    while level:
        bounds = [f(d).alias(f"{d}_{name}") for d in _DIMENSIONS for f, name in ((F.min, "low"), (F.max, "high"))]
        boxes = _boxes(root)
        found = {r["node"]: r for r in _inside(rows, boxes).groupBy("node").agg(F.sum("size").alias("size"), *bounds).collect()}
        if whole is None:
            whole = found.get(0)
        held = {i: n for i, n in level.items() if i in found}  # no rows, no split
        if held:
            _split(rows, held, boxes, found, whole, whole["size"] / shards)
        level = {}
        for n in held.values():
            half = n.leaves // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.leaves - half)
            level |= {c.first: c for c in (n.left, n.right) if c.leaves > 1}
    return root


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each document."""
    rows = materialized(metadata(documents), "metadata")
    placed = _inside(rows, _boxes(tree(rows, shards))).withColumnRenamed("node", "shard").withColumn(
        "part", F.expr(f"CAST(pmod(xxhash64(doc_id, text_crc32, 7), {SLOT_PARTS}) AS INT)")
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x SLOT_PARTS rows
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.join(F.broadcast(base), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(own) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
