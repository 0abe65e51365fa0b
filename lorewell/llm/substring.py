"""Substring dedup: words of windows that occur earlier are removed.

First pass, a count-min sketch: every window of WINDOW words has one minimizer,
its smallest GRAM-word hash, and equal windows have equal minimizers. Each task
counts the minimizers of its texts, each occurrence once, in a sketch; the
sketches are merged slice by slice into counters that stop at two. A counter is
at least the number of occurrences of any window it stands for.

Second pass: only windows whose counters say "repeated" are grouped exactly, by
a 96-bit hash, so none is lost. Before the shuffle each run of documents keeps
one entry per window, its earliest; the others are known to be copies at once.
A passage that a third of the documents share is thus a few entries a task.

The sketch has a fixed upper size (MAX_BITS); past it more windows are grouped
without need, with the same result.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, functions as F

from lorewell.llm import shingles
from lorewell.llm.arrow import batch, let_go, map_arrow, map_batches
from lorewell.llm.rows import Rows
from lorewell.scratch import materialize

WINDOW, GRAM = 20, 10
#: Hash functions of the sketch, slices by which it is merged, sketches merged at once, counters per minimizer, the least and most counters.
DEPTH, SLICES, FAN_IN, PER_KEY, MIN_BITS, MAX_BITS = 2, 64, 64, 16, 1 << 18, 1 << 29
#: Words whose windows are grouped locally before the shuffle, and windows in a group of the exact pass, about.
RUN, GROUP = 1_000_000, 2_000_000
LAST = (1 << 63) - 1
COUNTED = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("places", pa.binary())])
FOUND = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("entries", pa.binary())])
COVERED = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
HEAD = struct.Struct("<II")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def minimizers(h: np.ndarray) -> np.ndarray:
    """For each window the smallest gram hash in it, the leftmost of equal ones; the low 16 bits hold its place, so a new occurrence is a new value.

    Places are counted anew in every stretch of windows whose grams 16 bits can
    number; an occurrence used on both sides of a border counts twice.
    """
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    g = shingles.mix(shingles.rolling(h, GRAM)) & np.uint64(~0xFFFF & shingles.MASK)
    more = WINDOW - GRAM
    stretch = (1 << 16) - more
    return np.concatenate([_smallest(g[k : k + stretch + more]) for k in range(0, len(g) - more, stretch)])


def _smallest(g: np.ndarray) -> np.ndarray:
    low = g | np.arange(len(g), dtype=np.uint64)
    n, have = WINDOW - GRAM + 1, 1
    while have < n:
        step = min(have, n - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _places(m: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each minimizer in each row of the sketch; a row is its own part of the counters."""
    row = bits // DEPTH
    keys = shingles.mix(m | np.uint64(0xFFFF))
    return [((keys if i == 0 else shingles.mix(keys + np.uint64(i))) % np.uint64(row) + np.uint64(i * row)).astype(np.int64) for i in range(DEPTH)]


def _pack(once: np.ndarray, twice: np.ndarray, base: int) -> bytes:
    """Sorted counters at one and at two or more, by their differences."""
    parts = [np.diff(x, prepend=base).astype("<u4").tobytes() for x in (once, twice)]
    return zlib.compress(HEAD.pack(len(once), len(twice)) + b"".join(parts), 1)


def _unpack(blob: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(blob)
    n, _ = HEAD.unpack_from(data)
    steps = np.frombuffer(data, "<u4", offset=HEAD.size).astype(np.int64)
    return base + np.cumsum(steps[:n]), base + np.cumsum(steps[n:])


def _split(values: np.ndarray, width: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(values, np.arange(1, SLICES) * width))


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        held, size, once, twice = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            places = [p for m in held for p in _places(m, bits)]
            return _sum([*places, once, twice, twice])

        for b in batches:
            for text in b.column("text"):
                m = minimizers(shingles.hash_words(_words(text.as_py())))
                if len(m):
                    m = m[np.append(True, m[1:] != m[:-1])]
                    held.append(m)
                    size += len(m)
                if size > 2 * RUN:
                    once, twice = merged()
                    held, size = [], 0
        once, twice = merged()
        width, part = bits // SLICES, TaskContext.get().partitionId()
        for k, (x, y) in enumerate(zip(_split(once, width), _split(twice, width))):
            yield batch(COUNTED, [[k], [part], [_pack(x, y, k * width)]])

    return run


def _sum(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters met once, and those met more often."""
    values, n = np.unique(np.concatenate(places), return_counts=True)
    return values[n == 1], values[n > 1]


def _merge(bits: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        k = table["slice"][0].as_py()
        base = k * (bits // SLICES)
        both = [_unpack(x, base) for x in table["places"].to_pylist()]
        once, twice = _sum([v for x, y in both for v in (x, y, y)])
        if last:
            flags = np.zeros(bits // SLICES, bool)
            flags[twice - base] = True
            blob = zlib.compress(np.packbits(flags).tobytes(), 1)
        else:
            blob = _pack(once, twice, base)
        return pa.Table.from_batches([batch(COUNTED, [[k], [table["part"][0].as_py() // FAN_IN], [blob]])])

    return run


def sketch(docs: DataFrame, bits: int) -> bytes:
    """One bit a counter: whether it reached two; at most MAX_BITS / 8 bytes."""
    schema = "slice int, part long, places binary"
    level = materialize(map_arrow(docs.select("text"), _count(bits), schema), "sketches")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN_IN:
        level = materialize(level.groupBy("slice", F.floor(F.col("part") / FAN_IN)).applyInArrow(_merge(bits, False), schema), "sketches")
        parts = -(-parts // FAN_IN)
    rows = level.groupBy("slice").applyInArrow(_merge(bits, True), schema).collect()  # SLICES rows of fixed size
    found = {r["slice"]: zlib.decompress(bytes(r["places"])) for r in rows}
    return b"".join(found.get(k, bytes(bits // SLICES // 8)) for k in range(SLICES))


def _runs(uid: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """uid, start and stop (words) of runs of consecutive windows, from windows in order of (uid, pos)."""
    if not len(uid):
        return [np.zeros(0, np.int64)] * 3
    new = np.append(True, (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1] + 1))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(uid) - 1)
    return [uid[new], pos[new], pos[ends] + WINDOW]


def _encode(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> bytes:
    used, doc = np.unique(doc, return_inverse=True)
    steps = [np.diff(doc, prepend=0).astype("<i4").tobytes(), np.diff(pos, prepend=0).astype("<i4").tobytes()]
    return HEAD.pack(len(h1), len(used)) + ids[used].tobytes() + uids[used].tobytes() + h1.tobytes() + h2.tobytes() + zlib.compress(b"".join(steps), 1)


def _decode(blob: bytes) -> tuple[np.ndarray, ...]:
    n, d = HEAD.unpack_from(blob)
    at = HEAD.size
    ids, uids = np.frombuffer(blob, "<i8", d, at), np.frombuffer(blob, "<i8", d, at + 8 * d)
    at += 16 * d
    h1, h2 = np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<u4", n, at + 8 * n)
    steps = np.frombuffer(zlib.decompress(blob[at + 12 * n :]), "<i4")
    doc, pos = np.cumsum(steps[:n]), np.cumsum(steps[n:])
    return h1, h2, ids[doc], uids[doc], pos.astype(np.int64)


def _entries(rows: list[tuple[int, int, np.ndarray]], flags: np.ndarray, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows estimated repeated of a run of documents: the copies among them, and one entry for each other window."""
    rows.sort(key=lambda r: r[:2])
    ids, uids = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    h1s, h2s, docs, at, keys = [], [], [], [], []
    for k, (_, _, h) in enumerate(rows):
        m = minimizers(h)
        if not len(m):
            continue
        hit = np.logical_and.reduce([flags[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 == 1 for p in _places(m, bits)])
        pos = np.flatnonzero(hit)
        if len(pos):
            h1s.append(shingles.mix(shingles.rolling(h, WINDOW))[pos])
            h2s.append((shingles.rolling(shingles.mix(h), WINDOW, shingles.BASES[1])[pos] >> np.uint64(32)).astype("<u4"))
            docs.append(np.full(len(pos), k, np.int64))
            at.append(pos)
            keys.append(m[pos] >> np.uint64(16))
    if not h1s:
        return
    h1, h2, doc, pos, key = map(np.concatenate, (h1s, h2s, docs, at, keys))
    order = np.lexsort((h2, h1))  # stable: equal windows stay in the order of their documents and places
    new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
    first = np.zeros(len(h1), bool)
    first[order[new]] = True
    bucket = (shingles.mix(key) % np.uint64(buckets)).astype(np.int32)
    uid, start, stop = _runs(uids[doc[~first]], pos[~first])
    if len(uid):
        yield batch(FOUND, [(uid % buckets).astype(np.int32), uid, start, stop, pa.nulls(len(uid), pa.binary())])
    h1, h2, doc, pos, bucket = h1[first], h2[first], doc[first], pos[first], bucket[first]
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
    for part in np.split(order, cuts[1:]):
        blob = _encode(h1[part], h2[part], doc[part], pos[part], ids, uids)
        yield batch(FOUND, [[int(bucket[part[0]])], [None], [None], [None], [blob]])


def _find(flags, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, rows, size = np.frombuffer(flags.value, np.uint8), [], 0
        for b in batches:
            for uid, doc, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                h = shingles.hash_words(_words(text.as_py()))
                rows.append((LAST if doc is None else doc, uid, h))
                size += len(h)
                if size >= RUN:
                    yield from _entries(rows, known, bits, buckets)
                    rows, size = [], 0
        yield from _entries(rows, known, bits, buckets)

    return run


def _group(table: pa.Table) -> pa.Table:
    """Of each window the earliest entry stays; the others are copies. Runs that are known already pass through."""
    sure = table.filter(pa.compute.is_null(table["entries"])).select(["uid", "start", "stop"])
    blobs = table["entries"].drop_null()
    if not len(blobs):
        return sure
    h1, h2, doc, uid, pos = map(np.concatenate, zip(*(_decode(x.as_buffer().to_pybytes()) for x in blobs)))
    order = np.lexsort((pos, uid, doc, h2, h1))
    h1, h2 = h1[order], h2[order]
    copy = np.append(False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]))
    copies = order[copy]
    copies = copies[np.lexsort((pos[copies], uid[copies]))]
    found = pa.Table.from_batches([batch(COVERED, _runs(uid[copies], pos[copies]))])
    return pa.concat_tables([sure, found])


def covered(rows: DataFrame) -> DataFrame:
    """uid, spans (start and stop of covered words, in no order) of the rows (uid, doc_id, text) that have any."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = total / 6 + 1
    # a minimizer stands for (WINDOW - GRAM + 2) / 2 windows
    keys = words * 2 / (WINDOW - GRAM + 2)
    bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(keys * PER_KEY))))
    buckets = max(64, int(words / GROUP))
    flags = spark.sparkContext.broadcast(sketch(rows, bits))
    found = map_arrow(rows, _find(flags, bits, buckets), "bucket int, uid long, start long, stop long, entries binary")
    spans = found.groupBy("bucket").applyInArrow(_group, "uid long, start long, stop long")
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _keep(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    words = _words(text)
    if not spans:
        return len(words), 0, b" ".join(words).decode()
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, [s["start"] for s in spans], 1)
    np.add.at(steps, [s["stop"] for s in spans], -1)
    left = np.cumsum(steps[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(left)]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text in struct ``row``, with n_words, n_removed and ``kept`` (the words left, joined by one space).

    A window is WINDOW consecutive words of one document; every word in a window
    whose words also start earlier (in a smaller doc_id, or earlier in the same
    document) is removed. Windows are judged on the input. A null text has no
    words. Rows that repeat a doc_id count in the order of the table, and a null
    doc_id comes after all others. Texts of any length are read whole; an empty
    table gives an empty result. No column can clash. Only texts with words to
    remove are moved, to where their spans are.
    """
    table = Rows(docs)
    spans = materialize(covered(table.pick(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))), "spans")
    whole = table.marked(spans, table.whole("text").alias("row"), F.col("text"))
    same = whole.where("not marked").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    joined = same.unionByName(whole.where("marked").join(spans, "uid"))

    def make():
        def each(b: pa.RecordBatch) -> list:
            out = [_keep(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            n, removed, kept = zip(*out) if out else ([], [], [])
            return [b.column("row"), n, removed, kept]

        return each

    kind = whole.schema["row"].dataType.simpleString()
    return map_batches(joined.select("row", "text", "spans"), make, f"row {kind}, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the words left as their text, with all columns of ``docs``; n_chars, if there, is counted anew.

    Every row stays, even without words; what null, empty, repeated and long
    texts and an empty table give is as in ``remove_repeats``.
    """
    out = remove_repeats(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
