"""Sharding by a hierarchical weighted hash tree (law ``key``).

Shards are leaves of racks, racks of regions. A row descends level by level:
at each node every child draws a number from a hash of the row's key and the
child's name, divided by the child's weight (exponential race: the smallest
-ln(u) / weight wins, which a child does with probability weight / sum of
weights). The weight of an inner node is the sum of its leaves' weights.

Draws depend on nothing but key, name and weight, so a change of weights moves
rows only into or out of the subtrees whose weights change; the other children
keep their order among themselves. A shard that is added as a region of its
own therefore takes rows only into itself. ``layout`` adds every shard beyond
its planned size in this way.

Rows go by key alone: equal texts under different keys may part.

Defined results: the key of a null id is the text 'null'; a null text has
size 16 and the crc32 of no bytes, 0; rows that repeat an id share its shard
and take slots next to each other; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import gapless_rank, pick, stored

RACKS, SHARDS = 2, 4  # racks of a region, shards of a rack
HEADER_BYTES = 16


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float


def layout(shards: int, planned: int | None = None, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Leaves of a tree with ``shards`` shards; those from ``planned`` on have a region of their own each."""
    planned = shards if planned is None else planned
    weights = weights or {}
    out = []
    for s in range(shards):
        rack = s // SHARDS
        region, rack = (f"r{rack // RACKS}", f"k{rack}") if s < planned else (f"r+{s}", f"k+{s}")
        out.append(Leaf(region, rack, s, weights.get(s, 1.0)))
    return out


def draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5 of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(16 ** 13))) / F.lit(float(weight))


def _descend(key: Column, leaves: list[Leaf], level: int = 0) -> Column:
    """The shard below a node: the child with the smallest draw, then down from there."""
    if level == 2:
        children = {f"s{x.shard}": [x] for x in leaves}
    else:
        children = {}
        for x in leaves:
            children.setdefault(x[level], []).append(x)
    if len(children) == 1 and level < 2:
        return _descend(key, leaves, level + 1)
    if len(leaves) == 1:
        return F.lit(leaves[0].shard)
    names = sorted(children)
    draws = F.array(*[F.struct(draw(key, n, sum(x.weight for x in children[n])).alias("d"), F.lit(i).alias("i"))
                      for i, n in enumerate(names)])
    best = F.array_min(draws)["i"]
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        out = F.when(best == i, _descend(key, children[n], level + 1)).otherwise(out)
    return out


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key (any type) in a tree of leaves."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), leaves).cast("int")


def shards(documents: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, crc32 of the text, shard, slot in it, and the shard after one is added.

    Slots follow the ids' order within a shard. Rows are dealt by ranges of
    (shard, id), so a shard of any size spreads over many tasks, and every
    range adds the rows before it.
    """
    raw = F.encode(F.coalesce(documents[text_col], F.lit("")), "UTF-8")
    rows = pick(documents, doc_id=id_col, size=(F.length(raw) + HEADER_BYTES).cast("long"), text_crc32=F.crc32(raw))
    now, grown = layout(n_shards), layout(n_shards + 1, planned=n_shards)
    placed = stored(rows.withColumn("shard", shard_of(F.col("doc_id"), now))
                    .withColumn("grown_shard", shard_of(F.col("doc_id"), grown)), "placed")
    order = ["shard", "doc_id", "text_crc32", "size"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
                   "dealt")
    return gapless_rank(dealt, "shard", "slot", "_part", "_at").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
