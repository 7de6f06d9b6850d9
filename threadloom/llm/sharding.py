"""Hierarchical weighted hash tree: place rows by descending region, rack and shard.

At each level every child draws ``-weight / ln(u)`` with ``u`` hashed from the
key and the child's name, and the largest draw wins, so a child gets keys in
proportion to its weight. A draw depends on the key, the child's name and the
child's weight alone: when weights change below one child, keys move only into
or out of that child. Growth hangs the new shard in a region of its own, so
every other subtree keeps its weight and rows move only into the new shard.

Defined cases: a null key counts as the empty key; a null text as no text;
equal keys go to one shard; other columns pass through only if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REGIONS, RACKS = 2, 3
#: Rows of one shard are numbered in so many independent parts at most.
PARTS = 1024


@dataclass(frozen=True)
class Node:
    """A subtree: its name enters the hash, its weight is the sum of its shards' weights."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def node(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def topology(shards: int, weights: list[float] | None = None, regions: int = REGIONS, racks: int = RACKS) -> list[Node]:
    """Regions of racks of shards, shards dealt evenly in order."""
    w = weights or [1.0] * shards
    leaves = [Node(f"shard{i}", w[i], (), i) for i in range(shards)]
    cells = regions * racks
    runs = [leaves[shards * i // cells : shards * (i + 1) // cells] for i in range(cells)]
    racked = [node(f"rack{i}", run) for i, run in enumerate(runs)]
    grouped = [node(f"region{r}", [x for x in racked[r * racks : (r + 1) * racks] if x.children]) for r in range(regions)]
    return [g for g in grouped if g.children]


def grown(tree: list[Node], shard: int, weight: float = 1.0) -> list[Node]:
    """The tree with one more shard, in a region and rack of its own."""
    leaf = Node(f"shard{shard}", weight, (), shard)
    return [*tree, node(f"region-of-{shard}", [node(f"rack-of-{shard}", [leaf])])]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-weight / ln(u), with u in (0, 1) from 52 bits of a hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 12)
    return -weight / F.log((bits.cast("double") + 0.5) * F.lit(2.0**-52))


def winner(key: Column, children: Column) -> Column:
    """Number of the child with the largest draw; ties go to the larger number."""
    drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), c["id"].alias("id")))
    return F.array_max(drawn)["id"]


def place(key: Column, tree: list[Node]) -> Column:
    """The shard of a key. All shards lie equally deep; no shuffle, one expression."""
    level, chosen = [tuple(tree)], F.lit(0)
    while True:
        start, rows, below = 0, [], []
        for children in level:
            rows.append(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(start + i if c.children else c.shard).alias("id")) for i, c in enumerate(children)]))
            start += len(children)
            below += [c.children for c in children if c.children]
        # the level's table of child lists is a constant; the choice so far is used once
        chosen = winner(key, F.get(F.array(*rows), chosen))
        if not below:
            return chosen
        level = below


def numbered(df: DataFrame, shard: str, order: list[str], out: str = "slot", parts: int = PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows of a shard are cut by hash into parts that are numbered apart; a
    table of at most shards x parts counts (broadcast: its size is bounded by
    these two constants) gives each part its first number.
    """
    parted = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = parted.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col(shard).alias("__shard"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(shard, "__part").orderBy(*order))
    ranked = parted.withColumn(out, rank.cast("long") - 1)
    joined = ranked.join(F.broadcast(firsts), (ranked[shard] == firsts["__shard"]) & (ranked["__part"] == firsts["__p"]))
    return joined.withColumn(out, F.col(out) + F.col("__first")).drop("__part", "__shard", "__p", "__first")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", tree: list[Node] | None = None) -> DataFrame:
    """Shard, slot and the shard after growth by one, of every row, under the law ``key``.

    Only the key, the text's size and its checksum are shuffled, never a text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    base = tree or topology(shards)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = narrow.withColumns({"shard": place(name, base), "grown_shard": place(name, grown(base, shards))})
    slots = numbered(placed, "shard", ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read(spark, sf_dir, "documents"))
