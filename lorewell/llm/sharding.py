"""Sharding by a hierarchical weighted hash tree.

A tree has regions, their racks, and the racks' shards with weights. A key
descends level by level: every region draws an exponential time -ln(u) / weight
from a hash of (key, level, region), its weight being the sum of the weights
below it, and the region with the smallest draw takes the key; in that region
the racks draw in the same way, and in that rack the shards. So at each level a
child is drawn in proportion to the weight below it, and a key draws once for
each child of the nodes on its way, not for every shard of the tree.

A draw depends on nothing but the key, the node and the node's weight. Among
siblings a heavier node, or a new one, takes keys only into itself and a lighter
one gives only its own away; a node none of whose weights change keeps the keys
it has among its own children. So movement is confined to the subtrees whose
weights change and to what they take in or give away. A shard that opens a
region of its own takes keys only into itself; one added to a rack that has
others raises the weight of the rack and its region, and some of the keys those
take in go to its siblings. All of this is column arithmetic in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorewell.scratch import materialize


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """The usual tree: shards in order, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Shard(i // (per_rack * racks), i // per_rack, i) for i in range(shards)]


def _draw(key: Column, level: int, node: int, weight: float) -> Column:
    # 52 bits of the hash as u in (0, 1); a node draws the same wherever else the tree changes
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _child(key: Column, level: int, weights: dict[int, float]) -> Column:
    """The child with the smallest draw; of equal ones the smaller number."""
    draws = [F.struct(_draw(key, level, node, w).alias("draw"), F.lit(node).alias("node")) for node, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["node"]


def _below(node: Column, choices: dict[int, Column]) -> Column:
    """The choice of the node that was taken; the others aren't computed."""
    out = None
    for k, choice in choices.items():
        out = F.when(node == k, choice) if out is None else out.when(node == k, choice)
    return out


def assign(df: DataFrame, key: Column, tree: Sequence[Shard], name: str) -> DataFrame:
    """Add struct column ``name`` (region, rack, shard). A null key is one key of its own.

    Numbers of regions, racks and shards are each unique in the tree.
    """
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for x in tree:
        if x.weight > 0:
            regions.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    racks = {r: shards for own in regions.values() for r, shards in own.items()}
    total = lambda own: sum(sum(shards.values()) for shards in own.values())
    region = _child(key, 0, {g: total(own) for g, own in regions.items()})
    rack = _below(F.col("_region"), {g: _child(key, 1, {r: sum(s.values()) for r, s in own.items()}) for g, own in regions.items()})
    shard = _below(F.col("_rack"), {r: _child(key, 2, shards) for r, shards in racks.items()})
    out = df.withColumn("_region", region).withColumn("_rack", rack).withColumn("_shard", shard)
    at = F.struct(F.col("_region").alias("region"), F.col("_rack").alias("rack"), F.col("_shard").alias("shard"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], at.alias(name))


def shard_documents(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    doc_id and the tree alone decide the shard (law ``key``); rows that repeat
    a doc_id, or have none, share a shard, and equal texts under different
    doc_ids needn't. Texts of any length only give their size. ``size`` is the UTF-8 bytes of the
    text (null: none) plus 1. ``slot`` is the row's place in its shard, gapless
    from 0: rows are numbered within (input partition, shard) and offset by the
    counts of the partitions before, so no shard is ever gathered in one task.
    ``grown_shard`` is the shard in the ``grown`` tree. An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(narrow, F.col("doc_id"), tree, "_at")
    placed = assign(placed, F.col("doc_id"), grown, "_grown") if grown else placed.withColumn("_grown", F.lit(None).cast("struct<shard:int>"))
    base = materialize(
        placed.select(
            "doc_id", "size", "text_crc32", F.col("_at.shard").alias("shard"), F.col("_grown.shard").alias("grown_shard"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid"),
        ),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy("shard", "part").count()
    offsets = materialize(counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "offsets")
    # a hash of (part, shard) group: at most the rows of one input partition meet in a task
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return base.withColumn("local", local).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("local") + F.col("offset")).cast("long").alias("slot"), "grown_shard",
    )
