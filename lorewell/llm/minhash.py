"""MinHash near-dedup with b-bit signatures.

Each document's set of word shingles gives PERMUTATIONS minima. Bands of ROWS
minima are the candidate buckets; only the low BITS of each minimum are kept, a
packed signature of 80 bytes. A candidate pair's similarity is estimated from
the number of equal low bits, corrected for chance agreement, and pairs that
may reach the threshold are confirmed on the full shingle sets. An estimate may
be SLACK standard errors too low, which loses a pair at the threshold with a
probability of about 1e-9.

With 32 bands of 5 rows a pair at similarity 0.85 shares no bucket with a
probability below 1e-8.

Documents with equal sets are one node from the start. In a bucket every member
is first held against its smallest member only (a star, not all pairs); after
the components of those links are known, only buckets that still hold several
components go on. Of their members those stay whose sets allow a link at all,
and each bucket (a large one in tiles) is settled in one matrix product, which
yields no more links than it takes to join its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm import shingles
from lorewell.llm.arrow import let_go, map_batches, texts
from lorewell.llm.components import components
from lorewell.llm.rows import Rows
from lorewell.scratch import materialize

BANDS, ROWS, BITS = 32, 5, 4
PERMUTATIONS = BANDS * ROWS
#: Shingles hashed at once, for memory.
CHUNK = 4096
#: Standard errors below the threshold at which an estimate still counts as possible.
SLACK = 6.0
#: Members of an unsettled bucket in one tile, and cells of a matrix of members and shingles.
TILE, CELLS = 1024, 1 << 24

_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles.

    A-Z are lower-cased; words are what stands between ASCII white space. Fewer
    than k words make one shingle of all, no words an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    return np.unique(shingles.mix(shingles.rolling(shingles.hash_words(words), k) + np.uint64(k)))


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of a non-empty set under each permutation."""
    low = None
    for i in range(0, len(s), CHUNK):
        v = np.multiply.outer(s[i : i + CHUNK], _A)
        v += _B
        m = v.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    h = (shingles.mix(low) * _C).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return shingles.mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(shingles.BASES[1])).view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The signature: BITS of each minimum, two to a byte."""
    bits = (shingles.mix(low) >> np.uint64(40)).astype(np.uint8) & np.uint8(15)
    return (bits[0::2] | bits[1::2] << np.uint8(4)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of signatures (n, 80): share of equal low bits, corrected for chance agreement."""
    x = a ^ b
    equal = ((x & np.uint8(15)) == 0).sum(axis=1) + ((x >> np.uint8(4)) == 0).sum(axis=1)
    chance = 2.0**-BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def possible(threshold: float) -> float:
    """Estimates below this can't belong to a pair at the threshold, but for a chance of about 1e-9."""
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SLACK * (agree * (1 - agree) / PERMUTATIONS) ** 0.5 / (1 - chance)


def signatures(table: Rows, k: int) -> DataFrame:
    """uid, doc_id, n_shingles, fp1, fp2 (a fingerprint of the set), keys, sig; keys and sig are null for an empty set."""

    def make():
        let_go()

        def each(b: pa.RecordBatch) -> list:
            n, fp1, fp2, keys, sig = [], [], [], [], []
            for text in texts(b):
                s = shingle_set(text, k)
                n.append(len(s))
                if not len(s):
                    for c in (fp1, fp2):
                        c.append(0)
                    for c in (keys, sig):
                        c.append(None)
                    continue
                fp1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                fp2.append(int(np.bitwise_xor.reduce(s * np.uint64(shingles.BASES[0])).view(np.int64)))
                low = minima(s)
                keys.append(band_keys(low).tolist())
                sig.append(packed(low))
            return [b.column("uid"), b.column("doc_id"), n, fp1, fp2, keys, sig]

        return each

    rows = table.pick(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_batches(rows, make, "uid long, doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, sig binary")


def _sets(table: Rows, nodes: DataFrame, k: int) -> DataFrame:
    """uid, set (packed hashes) of the nodes (uid), made where their texts lie."""
    found = table.only(nodes, F.col("text"))

    def make():
        return lambda b: [b.column("uid"), [shingle_set(x, k).tobytes() for x in texts(b)]]

    return materialize(map_batches(found, make, "uid long, set binary"), "sets")


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures allow the threshold."""
    sig = nodes.select("uid", "sig")
    wide = pairs.join(sig.withColumnsRenamed({"uid": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"uid": "b", "sig": "sb"}), "b")
    least = possible(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array(estimate(sa, sb) >= least))

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    wide = pairs.join(sets.withColumnsRenamed({"uid": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"uid": "b", "set": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _reachable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (key, uid, label) that can have a link to one of another component at all.

    Shingles that no other member has count against every partner: with u of n
    such shingles no similarity exceeds (n - u) / n. That drops strongly edited
    copies exactly, and at a cost in proportion to the sets.
    """
    kind = pa.schema([("uid", pa.int64()), ("shingle", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, v in zip(b.column("uid").to_pylist(), b.column("set")):
                s = np.frombuffer(v.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), uid)), pa.array(s)], schema=kind)

    one = sets.mapInArrow(spread, "uid long, shingle long").groupBy("shingle").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"))
    lone = one.where("n = 1").groupBy("uid").agg(F.count(F.lit(1)).alias("u"))
    n = (F.octet_length("set") / 8).cast("long")
    hopeless = sets.select("uid", n.alias("n")).join(lone, "uid").where(100 * (F.col("n") - F.col("u")) < percent * F.col("n"))
    return members.join(hopeless.select("uid"), "uid", "left_anti")


def _open(members: DataFrame) -> DataFrame:
    """The members (key, uid, label) of buckets that hold several components."""
    keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    return materialize(members.join(keys.select("key", "n"), "key"), "open")


def _hopeful(sig: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of a tile are of different components and have signatures that allow the threshold."""
    bits = np.stack([sig & np.uint8(15), sig >> np.uint8(4)], axis=2).reshape(len(sig), -1)
    equal = np.zeros((len(sig), len(sig)), np.float32)
    for value in range(1 << BITS):
        same = (bits == value).astype(np.float32)
        equal += same @ same.T
    chance = 2.0**-BITS
    return ((equal / PERMUTATIONS - chance) / (1 - chance) >= least) & (label[:, None] != label[None, :])


def _merging(percent: int):
    """Links between components within a tile of a bucket, as many as it takes to join them.

    The signatures decide which pairs are held against each other at all; the
    members without any such partner drop out.
    """
    least, none = possible(percent / 100), pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        hope = _hopeful(sig, table["label"].to_numpy(), least)
        some = np.flatnonzero(hope.any(axis=1))
        if not len(some):
            return none
        table, hope = table.take(pa.array(some)), hope[np.ix_(some, some)]
        uid, label = table["uid"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table["set"].chunks for x in c]
        size = np.array([len(s) for s in sets])
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column, often = np.unique(every, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        width = int(column.max()) + 1 if len(column) else 0
        root = {x: x for x in label.tolist()}
        found: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        step = max(1, CELLS // max(1, width))
        blocks = range(0, len(sets), step)

        def matrix(k: int) -> np.ndarray:
            m = np.zeros((min(step, len(sets) - k), width), np.float32)
            own = (row >= k) & (row < k + step)
            m[row[own] - k, column[own]] = 1
            return m

        for i in blocks if width else ():
            x = matrix(i)
            for j in blocks:
                if j < i:
                    continue
                both = x @ (x if j == i else matrix(j)).T
                n = size[i : i + step, None] + size[None, j : j + step]
                linked = 100 * both >= percent * (n - both)
                linked &= hope[i : i + step, j : j + step]
                for a, b in zip(*np.nonzero(linked)):
                    p, q = top(int(label[i + a])), top(int(label[j + b]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        found.append((int(uid[i + a]), int(uid[j + b])))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in a bucket's members (key, uid, label, n); large buckets in tiles, so a task stays bounded.

    ``sets``: uid, set, sig.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("lo"), F.greatest(t, F.col("own")).alias("hi")))
    rows = members.withColumn("tiles", tiles).withColumn("own", own).select("key", "uid", "label", F.explode(pair).alias("t")).select("key", "uid", "label", "t.lo", "t.hi")
    return rows.join(sets, "uid").groupBy("key", "lo", "hi").applyInArrow(_merging(percent), "a long, b long")


def link(table: Rows, percent: int = 85, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """All documents (uid, doc_id, n_shingles, rep) and the confirmed links (a, b) between representatives of equal sets."""
    threshold = percent / 100
    rows = materialize(signatures(table, k), "signatures")
    some = rows.where("n_shingles > 0")
    classes = materialize(some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("uid").alias("rep")), "classes")
    every = some.select("uid", "doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"]).select("uid", "doc_id", "n_shingles", "rep")
    every = every.unionByName(rows.where("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("uid").alias("rep")))
    nodes = materialize(some.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "sig", "keys"), "nodes")

    placed = nodes.select(F.explode("keys").alias("key"), "uid")
    buckets = materialize(placed.groupBy("key").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "buckets")
    members = materialize(placed.join(buckets, "key"), "members")
    stars = members.where("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    stars = materialize(_estimated(stars, nodes, threshold), "stars")
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = _sets(table, ids(stars), k)
    links = materialize(_confirmed(stars, sets, percent), "links")

    # what stars can't settle: buckets whose members are in several components
    label = components(links)
    labelled = members.join(label.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", F.coalesce("root", "uid").alias("label"))
    rest = _open(materialize(labelled, "labelled"))
    more = _sets(table, rest, k)
    rest = _open(_reachable(rest.select("key", "uid", "label"), more, percent))
    links = links.unionByName(materialize(_across(rest, more.join(nodes.select("uid", "sig"), "uid"), percent), "links"))
    return every, links


def near_dedup(docs: DataFrame | Rows, percent: int = 85, k: int = 5) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept; one row per input row.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable. A null or empty
    text, or one of white space alone, has an empty set and is linked with
    nothing. Repeated rows have equal sets and are in one component; a null
    doc_id counts as larger than any other, and a component without any doc_id
    has a null component_id. ``kept`` is true for one row of each component.
    Texts of any length are shingled whole; an empty table gives an empty
    result, and other columns aren't read.
    """
    every, links = link(docs if isinstance(docs, Rows) else Rows(docs), percent, k)
    label = components(links)
    rooted = every.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("uid", "doc_id", "n_shingles", F.coalesce("root", "rep").alias("root"))
    rooted = materialize(rooted, "rooted")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    heads = materialize(rooted.groupBy("root").agg(F.min(first).alias("head")), "heads")
    return rooted.join(heads, "root").select(
        "uid", "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("uid") == F.col("head.uid")).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """The documents with one of each group of near copies, with all columns of ``docs``.

    The row with the smallest doc_id stays; what null, empty, repeated and long
    texts and an empty table give is as in ``near_dedup``; no column can clash.
    """
    table = Rows(docs)
    return table.keep(near_dedup(table, percent, k).where("kept"))
