"""Sharding by a hierarchical weighted hash tree, on DataFrame functions.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, with u from a hash
of the row's key and the child's name, and the least draw wins; a child's share is its weight's. A node's
weight is the sum of its shards' weights, so a changed weight moves rows only into or out of subtrees whose
weights changed. A shard that is added in a region of its own takes rows from all others, evenly, and no
row moves between the others.

Defined results: rows with equal keys go to the same shard, null keys too (as the text '\\0null'); a null
text has no bytes; an empty table gives no rows; slots of rows that are equal in key and text are dealt in
any order among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, once

#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A subtree (children) or a shard (number)."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(shards: int, regions: int = 2, racks: int = 3) -> Node:
    """Shards dealt evenly over regions and racks."""
    deal = [[[] for _ in range(racks)] for _ in range(regions)]
    for s in range(shards):
        deal[s % regions][s // regions % racks].append(Node(f"shard{s}", shard=s))
    return Node("root", tuple(Node(f"region{i}", tuple(Node(f"region{i}/rack{j}", tuple(x)) for j, x in enumerate(r) if x)) for i, r in enumerate(deal) if any(r)))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    name = f"region+{shard}"
    return Node(tree.name, (*tree.children, Node(name, (Node(f"{name}/rack0", (Node(f"shard{shard}", shard=shard, own_weight=weight),)),))))


def levels(node: Node) -> int:
    return 1 + max(map(levels, node.children)) if node.children else 0


def literal(node: Node, depth: int) -> Column:
    """A subtree as a value: name, weight, shard and, down to `depth` levels, children."""
    own = [F.lit(node.name).alias("name"), F.lit(float(node.weight)).alias("weight"), F.lit(node.shard).alias("shard")]
    if not depth:
        return F.struct(*own)
    below = node.children or (node,)  # a shard above the last level stands for itself
    return F.struct(*own, F.array(*[literal(c, depth - 1) for c in below]).alias("children"))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that a key's draws lead to."""

    def winner(children):
        def drawn(c, i):
            u = F.conv(F.substring(F.md5(F.concat(c["name"], F.lit(":"), key)), 1, 13), 16, 10).cast("double")
            return F.struct((-F.log((u + 0.5) / float(1 << 52)) / c["weight"]).alias("d"), i.alias("i"))

        return F.get(children, F.array_min(F.transform(children, drawn))["i"])

    def down(children, depth):
        return once(winner(children), lambda n: n["shard"] if depth == 1 else down(n["children"], depth - 1))

    depth = levels(tree)
    return once(literal(tree, depth)["children"], lambda children: down(children, depth))


def place(docs: DataFrame, tree: Node, more: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots are numbered within hash buckets of a shard, whose offsets come from the buckets' counts, so no
    task sorts a whole shard.
    """
    spark = docs.sparkSession
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    named = F.coalesce(F.col("key").cast("string"), F.lit("\0null"))
    rows = rows.withColumns({"shard": shard_of(named, tree), "grown_shard": shard_of(named, more)})
    rows = materialise(rows, spark)
    buckets = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    offsets = counts.withColumn("offset", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.col("grown_shard").cast("int")
    )
