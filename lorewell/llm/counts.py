"""Token counts by a two-tier lookup on the map side.

A piece vocabulary in which no piece has a space after another character
splits every text exactly into pre-tokens (the spaces before a word and the
word), whose lengths in tokens add up. Tier one is a broadcast table with the
lengths of the most frequent pre-tokens; what it lacks is encoded once and kept
in a bounded cache of the worker. Pre-tokens are never shuffled: to find the
frequent ones, every task reduces all its texts to one summary of bounded size,
and the summaries are merged in a tree. The table is a speed-up only; counts
are the same whatever it holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.arrow import batch, map_batches, texts
from lorewell.scratch import materialize

#: Pre-tokens in the broadcast table, entries of a task's counter before it is cut, summaries merged at once.
TABLE, COUNTER, FAN_IN = 1 << 14, 200_000, 32
#: Entries of a worker's cache, and the longest pre-token kept there.
CACHE, CACHED_CHARS = 500_000, 64
UNITS = re.compile(r" *[^ ]+| +")
SPACE = "▁"
SUMMARY = "part long, words binary, counts array<long>"
SUMMARY_ARROW = pa.schema([("part", pa.int64()), ("words", pa.binary()), ("counts", pa.list_(pa.int64()))])


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece reaches over a word's end; texts can't be split at spaces")
    return model


def _split(text: str) -> list[str]:
    """Pre-tokens without the one space that stands before each."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    units = text.split(" ")
    return [m[1:] for m in UNITS.findall(" " + text)] if "" in units else units


class _Lengths(dict):
    def __init__(self, frequent: dict[str, int], path: str):
        self.model = _processor(path)
        # a last space alone is the piece of one space; the model would add none before an empty string
        self.frequent = frequent | {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}
        super().__init__(self.frequent)

    def __missing__(self, unit: str) -> int:
        n = len(self.model.encode(unit))
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[unit] = n
        return n


def _pack(counts: Counter) -> tuple[bytes, list[int]]:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE]
    return zlib.compress("\n".join(w for w, _ in top).encode()), [n for _, n in top]


def _unpack(words: bytes, counts: list[int]) -> dict[str, int]:
    return dict(zip(zlib.decompress(words).decode().split("\n"), counts)) if counts else {}


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts: Counter = Counter()
    for b in batches:
        for text in texts(b):
            counts.update(_split(text))
            if len(counts) > COUNTER:
                counts = Counter(dict(counts.most_common(COUNTER // 2)))
    short = Counter({w: n for w, n in counts.items() if len(w) <= CACHED_CHARS and "\n" not in w})
    words, n = _pack(short)
    yield batch(SUMMARY_ARROW, [[TaskContext.get().partitionId()], [words], [n]])


def _merge(table: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for words, n in zip(table["words"].to_pylist(), table["counts"].to_pylist()):
        counts.update(_unpack(words, n))
    words, n = _pack(counts)
    return pa.Table.from_batches([batch(SUMMARY_ARROW, [[table["part"][0].as_py() // FAN_IN], [words], [n]])])


def frequent_pre_tokens(docs: DataFrame) -> list[str]:
    """At most TABLE of the most frequent pre-tokens of all texts, most frequent first."""
    level = materialize(docs.select("text").mapInArrow(_summarise, SUMMARY), "summaries")
    while level.count() > 1:
        level = materialize(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_merge, SUMMARY), "summaries")
    rows = level.collect()  # one row of bounded size
    return list(_unpack(rows[0]["words"], rows[0]["counts"])) if rows else []


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row.

    Tokens are those of the sentencepiece model at ``path`` without begin and
    end; a null text counts as empty (0 tokens). Beyond the frequency summaries
    nothing is shuffled, so repeated rows and long texts need nothing special;
    an empty table gives an empty result and other columns aren't read.
    """
    frequent = frequent_pre_tokens(docs)
    model = _processor(path)
    lengths = [len(x) for x in model.encode(frequent)] if frequent else []
    table = docs.sparkSession.sparkContext.broadcast((zlib.compress("\n".join(frequent).encode()), lengths))

    def make():
        lookup = _worker_lookup(path, table)

        def each(b: pa.RecordBatch) -> list:
            found = texts(b)
            n = [sum(map(lookup.__getitem__, _split(x))) if x else 0 for x in found]
            return [b.column("doc_id"), [len(x) if x.isascii() else len(x.encode()) for x in found], n, [x > limit for x in n]]

        return each

    return map_batches(
        docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


_worker: dict = {}


def _worker_lookup(path: str, table) -> _Lengths:
    """The lookup of this worker process; it outlives a task."""
    if _worker.get("key") != (path, table.id if hasattr(table, "id") else id(table)):
        words, lengths = table.value
        _worker["key"] = (path, table.id if hasattr(table, "id") else id(table))
        _worker["lookup"] = _Lengths(_unpack(words, lengths), path)
    return _worker["lookup"]
