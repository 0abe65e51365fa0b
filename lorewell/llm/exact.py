"""Exact dedup against immutable snapshots screened by binary-fuse filters.

A snapshot is a fixed set of text digests: a table of exact buckets (one row
per digest: the row that stays and the number of rows) and one binary-fuse
filter per shard of the digest space. A new batch is first grouped by its own
digests, so a text that a third of the rows share is one row from then on. Its
distinct digests are screened by the filter of their shard. Only positives join
the exact buckets, and each match is confirmed byte by byte on the texts.
Filters and buckets are sharded, never broadcast and never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm import fuse
from lorewell.llm.rows import Rows
from lorewell.scratch import materialize

#: Digests in one filter shard, about; bounds the memory of one filter task.
SHARD_KEYS = 50_000


def digests(table: Rows, batches: int = 1) -> DataFrame:
    """One narrow row per document: uid, doc_id, digest (32 bytes), batch.

    A null text counts as empty. ``uid`` tells repeated rows apart.
    """
    return table.pick(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )


def group_batch(rows: DataFrame) -> DataFrame:
    """digest, keep (doc_id and uid of the row that stays), n. Partial sums run before the shuffle."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "little") for x in column.to_pylist()], np.uint64)


def _build(table: pa.Table) -> pa.Table:
    return pa.table({"shard": table["shard"][:1], "filter": pa.array([fuse.build(_keys(table["digest"]))], pa.binary())})


def _screen(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "maybe": pa.array([], pa.bool_())})
    blobs = right["filter"].to_pylist()
    maybe = fuse.contains(blobs[0], _keys(left["digest"])) if blobs else np.zeros(left.num_rows, bool)
    return pa.table({"digest": left["digest"].cast(pa.binary()), "maybe": pa.array(maybe)})


class Snapshot:
    """An immutable set of digests: exact ``buckets`` (digest, keep, n) and sharded ``filters`` (shard, filter)."""

    def __init__(self, buckets: DataFrame):
        self.buckets = materialize(buckets, "buckets")
        self.shards = max(1, -(-self.buckets.count() // SHARD_KEYS))
        keyed = self.buckets.select(_shard(self.shards), "digest")
        self.filters = materialize(keyed.groupBy("shard").applyInArrow(_build, "shard int, filter binary"), "filters")

    def screen(self, groups: DataFrame) -> DataFrame:
        """digest, maybe: False means that no row of the snapshot has this digest."""
        keyed = groups.select(_shard(self.shards), "digest")
        return keyed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_screen, "digest binary, maybe boolean")


def confirm(table: Rows, pairs: DataFrame) -> DataFrame:
    """The digests of ``pairs`` (digest, a, b: uids) whose two texts have equal bytes; only those texts move."""
    wanted = pairs.select("digest", F.explode(F.array("a", "b")).alias("uid"))
    found = wanted.join(table.only(wanted, F.coalesce("text", F.lit("")).cast("binary").alias("bytes")), "uid")
    same = found.groupBy("digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.count(F.lit(1)).alias("n"))
    return same.where("lo = hi and n = 2").select("digest")


def admit(table: Rows, snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: digest, keep, n.

    ``batch`` has digest, keep, n of the new rows, grouped separately. A digest
    that the filter rejects needs no join; a positive joins the exact buckets
    and counts as the same text only if the bytes agree.
    """
    screened = materialize(batch.join(snapshot.screen(batch), "digest"), "screened")
    old = snapshot.buckets.select("digest", F.col("keep").alias("keep0"), F.col("n").alias("n0"))
    hits = materialize(screened.where("maybe").join(old, "digest"), "hits")
    sure = confirm(table, hits.select("digest", F.col("keep.uid").alias("a"), F.col("keep0.uid").alias("b")))
    matched = materialize(hits.join(sure, "digest"), "matched").select("digest", F.col("keep").alias("keep1"), F.col("n").alias("n1"))
    grown = snapshot.buckets.join(matched, "digest", "left").select(
        "digest", F.greatest("keep", F.coalesce("keep1", "keep")).alias("keep"), (F.col("n") + F.coalesce("n1", F.lit(0))).alias("n")
    )
    fresh = screened.join(matched, "digest", "left_anti").select("digest", "keep", "n")
    return grown.unionByName(fresh)


def exact_dedup(docs: DataFrame | Rows, batches: int = 2) -> DataFrame:
    """Mark copies: uid, doc_id, keep_id, group_size, kept, digest; one row per input row.

    The rows arrive in ``batches`` by a hash of doc_id; each batch is held
    against the immutable snapshot of all before it. Texts are equal when
    identical byte by byte; null counts as empty. The row with the largest
    doc_id stays; among rows that repeat that doc_id one stays. A null doc_id
    is smaller than any other. Texts of any length are digested whole where
    they lie. An empty table gives an empty result; other columns of ``docs``
    are not read.
    """
    table = docs if isinstance(docs, Rows) else Rows(docs)
    rows = materialize(digests(table, batches), "digests")
    groups = group_batch(rows.where("batch = 0"))
    for k in range(1, batches):
        groups = admit(table, Snapshot(groups), group_batch(rows.where(F.col("batch") == k)))
    groups = materialize(groups, "groups")
    return rows.join(groups, "digest").select(
        "uid", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"), "digest",
    )


def keep_one(docs: DataFrame, batches: int = 2) -> DataFrame:
    """The documents without their exact copies, with all columns of ``docs``.

    Which row of a group stays, and what null, empty, repeated and long texts
    and an empty table give, is as in ``exact_dedup``; no column can clash.
    """
    table = Rows(docs)
    return table.keep(exact_dedup(table, batches).where("kept"))
