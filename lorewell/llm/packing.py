"""Sum-of-squares packing of tokenized documents into sequences.

Let N(g) be the number of open sequences with a gap of g tokens. Each piece
goes where the sum of N(g) squared over all gaps becomes smallest: into a
sequence of gap g it changes the sum by 2 (N(g - s) - N(g)) + 2, into a new one
by 2 N(C - s) + 1. That keeps gaps of all sizes in stock instead of many alike
that nothing fits. Pieces come longest first, so the last ones are small enough
to close what is open.

Pieces are dealt by a hash of their row into blocks of bounded size, packed
block by block; sequences left with much room are taken apart and packed again
together with those of other blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.arrow import batch, kept
from lorewell.scratch import materialize

#: Pieces in a block, about; blocks whose loose sequences are packed together; free tokens from which a sequence is loose.
BLOCK, TOGETHER, LOOSE = 4096, 32, 16
#: Entries of a generation of a worker's caches of the ids of odd words and of plain pieces, the longest one kept there, texts encoded together, and bytes of them at once.
CACHE, CORES, CACHED_CHARS, TEXTS, STRETCH = 100_000, 200_000, 64, 1024, 1 << 20
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")])
PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, block long, sequence long, offset long, free long"


#: Words on which a vocabulary has to show that its model, given a word's bytes as letters, yields what the whole tokenizer does.
PROBES = ("a", "the", "bakers", "straße", "überraschung", "naïveté", "żółw", "zzqxjkv")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


LETTERS = _byte_letters()
#: A word of Latin letters with ASCII marks (no apostrophe) before and after: three pieces of the pre-tokenizer.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: What a byte is: between words, part of a letter, a mark, or odd.
SPACE, LETTER, MARK, ODD = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte what it is and its small letter; of each character of two bytes whether it is a letter of PLAIN, and its small letter."""
    kinds, small = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    letters, lower = np.zeros(2048, bool), np.arange(2048, dtype=np.uint16)
    kinds[[0x20, 0x0A]] = SPACE
    for c in range(0x21, 2048):
        found = PLAIN.fullmatch(chr(c)) if c >= 0x80 or chr(c).isalpha() else None
        if c < 0x7F and PLAIN.fullmatch(chr(c) + "a"):
            kinds[c] = LETTER if found else MARK
            small[c] = ord(chr(c).lower())
        elif found and len(chr(c).lower().encode()) == 2:
            letters[c], lower[c] = True, ord(chr(c).lower())
    return kinds, small, letters, lower


KINDS, SMALL, LETTERS_2, SMALL_2 = _tables()


class _Kept:
    """A bounded cache in two generations: what is still in use moves on when the younger one is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def fill(self, keys: list[str], find) -> list[bytes]:
        """What belongs to each of distinct keys; ``find`` gives it for those not kept."""
        out, new = [*map(self.young.get, keys)], []
        for n in [n for n, found in enumerate(out) if found is None]:
            out[n] = self.old.get(keys[n])
            if out[n] is None:
                new.append(n)
            else:
                self.young[keys[n]] = out[n]
        for n, found in zip(new, find([keys[n] for n in new])):
            out[n] = found
            if len(keys[n]) <= CACHED_CHARS:
                self.young[keys[n]] = found
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return out


class Words:
    """Ids of texts by what stands between spaces and line ends, over which no token reaches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.words, self.cores = _Kept(CACHE), _Kept(CORES)
        self.bpe = self.model.model
        self.direct = type(self.bpe).__name__ == "BPE" and all(self._letters(w) == self._one(w) for w in PROBES)

    def _one(self, word: str) -> bytes:
        return np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """The ids of a word of small Latin letters, which normalizer and pre-tokenizer leave whole, by the model alone."""
        found = self.bpe.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _many(self, words: list[str]) -> list[bytes]:
        """The ids of words that are a piece each."""
        if self.direct:
            return [self._letters(w) if w.islower() else self._one(w) for w in words]
        return self._joined(words)

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words that are a piece each, encoded as one text."""
        if not words:
            return []
        found = self.model.encode(" ".join(words), add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1)) * 4
        if found.word_ids[-1] != len(words) - 1:
            return [self._one(w) for w in words]
        ids = np.array(found.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """What texts in UTF-8 consist of, which of it is odd, and how much of it comes before each of ``ends``, where texts end.

        A word of Latin letters and ASCII marks falls into runs of either, as
        the pre-tokenizer parts it, with letters made small; any other word is
        odd and left whole, as is one with what special strings begin with.
        """
        kind, small = KINDS[data], SMALL[data]
        two = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        if len(two):
            c = (data[two] & 0x1F).astype(np.uint16) << 6 | data[two + 1] & 0x3F
            is_letter = LETTERS_2[c]
            two, c = two[is_letter], SMALL_2[c[is_letter]]
            small[two], small[two + 1] = 0xC0 | c >> 6, 0x80 | c & 0x3F
            kind[two] = kind[two + 1] = LETTER
        kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = ODD
        first = np.zeros(len(data) + 1, bool)
        first[0] = first[ends] = True
        first = first[:-1]
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            edges = np.append(np.flatnonzero(first | (kind == SPACE)), len(data))
            k = np.searchsorted(edges, odd, "right")
            k = k[np.append(True, k[1:] != k[:-1])]
            change = np.zeros(len(data) + 1, np.int8)
            change[edges[k - 1]] += 1
            change[edges[k]] -= 1
            whole = (np.cumsum(change[:-1], dtype=np.int8) > 0) & (kind != SPACE)
            kind[whole], small[whole] = ODD, data[whole]
        word = kind != SPACE
        first[1:] |= kind[1:] != kind[:-1]
        first &= word
        at = np.flatnonzero(first)
        offsets = np.append(np.flatnonzero(first[word]), np.count_nonzero(word)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(small[word]))
        return pieces, kind[at] == ODD, np.searchsorted(at, ends)

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of runs of letters and of marks."""
        letters = iter(self._many([p for p in pieces if p[0].isalpha()]))
        return [next(letters) if p[0].isalpha() else self._one(p) for p in pieces]

    def _stretch(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in UTF-8, and how many come before each of ``ends``, where texts end."""
        pieces, odd, before = self._pieces(data, ends)
        found = pieces.dictionary_encode()
        which, keys = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False)
        is_odd = np.zeros(len(keys), bool)
        is_odd[which[odd]] = True
        ids = np.empty(len(keys), object)
        ids[~is_odd] = self.cores.fill(keys[~is_odd].tolist(), self._plain)
        ids[is_odd] = self.words.fill(keys[is_odd].tolist(), lambda words: [self._one(w) for w in words])
        ids = ids.tolist()
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        length = length[which]
        upto = np.append(0, np.cumsum(length))
        place = np.repeat(start[which] - upto[:-1], length) + np.arange(upto[-1])
        return np.frombuffer(b"".join(ids), "<u4")[place], upto[before]

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """The ids of whole texts (null: none) as little-endian unsigned 32-bit integers."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("").cast(pa.large_string())
        if not len(texts):
            return []
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends[1:] - ends[0]
        out, count, done, total, at = [], np.zeros(len(ends) + 1, np.int64), 0, 0, 0
        while at < len(data):
            stop = self._stop(data, ends, at)
            last = int(np.searchsorted(ends, stop, "right"))
            ids, before = self._stretch(data[at:stop], ends[done:last] - at)
            count[done + 1 : last + 1] = total + before
            out.append(ids.tobytes())
            done, total, at = last, total + len(ids), stop
        ids, count = b"".join(out), (4 * count).tolist()
        return [ids[a:b] for a, b in zip(count[:-1], count[1:])]

    @staticmethod
    def _stop(data: np.ndarray, ends: np.ndarray, at: int) -> int:
        """Where a stretch of texts from ``at`` on may end: with a text or before a space or line end."""
        size = STRETCH
        while at + size < len(data):
            k = int(np.searchsorted(ends, at + size, "right"))
            if k and ends[k - 1] > at:
                return int(ends[k - 1])
            spaces = np.flatnonzero(KINDS[data[at + 1 : at + size]] == SPACE)
            if len(spaces):
                return at + 1 + int(spaces[-1])
            size *= 2
        return len(data)


def _words(path: str) -> Words:
    return kept(("words", path), lambda: Words(path))


def token_ids(text: str, path: str) -> bytes:
    return _words(path).encode([text])[0]


def cut(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Tokenize every text (null: empty), add the id ``end``, and cut what is longer than ``capacity``."""

    def run(batches):
        stop, step = end.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                for uid, doc, ids in zip(some.column("uid").to_pylist(), some.column("doc_id").to_pylist(), _words(path).encode(some.column("text"))):
                    ids += stop
                    for k in range(0, len(ids), step):
                        part = ids[k : k + step]
                        rows.append((uid, doc, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            yield batch(PIECES_ARROW, list(zip(*rows)) if rows else [[]] * len(PIECES_ARROW))

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the free room of each sequence. Ties go to the smallest gap."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one isn't open
    offer = np.full(capacity + 1, -(1 << 40), np.int64)  # the same, and out of the question where there is none
    free: list[int] = []
    for i in order.tolist():
        s = int(lengths[i])
        change = count[: capacity - s + 1] - offer[s:]
        j = int(change.argmin())
        if s == capacity or count[capacity - s] <= change[j]:
            gap, k = capacity, len(free)
            free.append(capacity)
        else:
            gap = s + j
            k = stock[gap].pop()
            count[gap] -= 1
            offer[gap] = count[gap] or -(1 << 40)
        sequence[i], offset[i] = k, capacity - gap
        rest = free[k] = gap - s
        if rest:
            stock[rest].append(k)
            count[rest] += 1
            offer[rest] = count[rest]
    return sequence, offset, np.array(free, np.int64)


def _packer(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending"), ("piece", "ascending")])
        sequence, offset, free = sum_of_squares(table["length"].to_numpy(), capacity)
        names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "block"]
        columns = {n: table[n] for n in names} | {"sequence": pa.array(sequence), "offset": pa.array(offset), "free": pa.array(free[sequence])}
        return pa.table(columns)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, uid; one row per piece.

    A null or empty text gives one piece with the end id alone. Repeated rows
    are packed each for itself; a very long text only gives more pieces. An
    empty table gives an empty result and other columns aren't read.
    """
    pieces = materialize(cut(docs, path, capacity, end), "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("uid", "piece"), F.lit(blocks)))
    first = materialize(dealt.groupBy("block").applyInArrow(_packer(capacity), PACKED), "packed")
    loose = F.col("free") >= LOOSE
    again = first.where(loose).withColumn("block", F.floor(F.col("block") / TOGETHER)).select(*pieces.columns, "block")
    again = again.groupBy("block").applyInArrow(_packer(capacity), PACKED)
    out = first.where(~loose).withColumn("again", F.lit(0)).unionByName(again.withColumn("again", F.lit(1)))
    number = F.shiftleft(F.col("again").cast("long"), 60) + F.shiftleft(F.col("block"), 24) + F.col("sequence")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", "uid")
