"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

From the merge list alone ``sufficient_lookahead`` derives how many symbols to
the right of a token can still change it. A window of the input is merged, the
tokens that end at least that far before the window's end are emitted, and the
rest stays in the buffer: memory is constant however long a piece is. Every
piece goes through that transducer; what it gave for short ones is remembered.

Texts are encoded in stretches that end where no token can reach over, and ids
go on as they settle, so beside the text itself nothing grows with its length.

The argument: a merge (u, v) of some rank happens at a place unless v is taken
first by a merge (v, w) of lower rank. Whether that one happens depends in turn
on what follows w and on merges of yet lower rank, so the distance over which
decisions reach is found by one pass over the merges in rank order.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lorewell.llm.arrow import map_batches, texts

#: Fixed: the public pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space and the word after it; pieces never reach over the end of such a unit.
UNITS = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
ODD_SPACE = regex.compile(r"\s|\p{White_Space}")
#: Where no piece reaches over: between what isn't white space and a space or line end.
BREAK = regex.compile(r"[^\s\p{White_Space}](?=[ \n])")
#: Characters of a text encoded at once, about, if there are breaks.
STRETCH = 1 << 15
#: Entries of a worker's cache, and the longest unit kept there.
CACHE, CACHED_CHARS = 400_000, 64
NO_MERGE = 1 << 62
LITTLE = sys.byteorder == "little"
DECODE_IDS = 1 << 16


def sufficient_lookahead(merges: list[tuple[str, str]], width=len) -> int:
    """Symbols after a token's end that settle it, from the merges in rank order."""
    formed: dict[str, int] = {}  # beyond a token's end: enough to know that it forms
    taken: dict[str, int] = {}  # beyond a token's end: enough to know whether a merge with what follows takes it
    for u, v in merges:
        t = u + v
        formed[t] = max(formed.get(t, 0), formed.get(u, 0) - width(v), formed.get(v, 0), taken.get(v, 0))
        taken[u] = max(taken.get(u, 0), width(v) + formed[t])
    return max([1, *formed.values(), *taken.values()])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


def _le(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if not LITTLE:
        out.byteswap()
    return out.tobytes()


class _Odd(Exception):
    """The text isn't plain words parted by single spaces or line ends."""


class _Kept(dict):
    """A bounded cache in two generations: what is still in use moves on when the younger one is full."""

    def __init__(self, find, size: int = CACHE // 2):
        super().__init__()
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Transducer:
    """Encodes one piece that arrives in parts; ``feed`` returns the ids that are settled.

    A window holds four times the lookahead or the longest token, whichever is
    more, so the first token always ends where it is settled.
    """

    def __init__(self, model: ByteBpe):
        self.model, self.symbols = model, []

    def feed(self, data: bytes) -> list[int]:
        self.symbols += map(self.model.byte_id.__getitem__, data)
        ahead, out = self.model.reach, []
        while len(self.symbols) >= 4 * ahead:
            window = self.symbols[: 4 * ahead]
            end, settled = 0, 0
            for t in self.model.merge(window):
                end += self.model.token_length[t]
                if end > 3 * ahead:
                    break
                out.append(t)
                settled = end
            del self.symbols[:settled]
        return out

    def finish(self) -> list[int]:
        symbols, self.symbols = self.symbols, []
        return self.model.merge(symbols)


class ByteBpe:
    """Encoder and decoder for a ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        names = byte_symbols()
        back = {c: b for b, c in enumerate(names)}
        self.byte_id = [vocab[c] for c in names]
        self.ranks = {vocab[u] << 32 | vocab[v]: rank << 32 | vocab[u + v] for rank, (u, v) in reversed([*enumerate(merges)])}
        self.lookahead = sufficient_lookahead(merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.token_length = [len(x) for x in self.token_bytes]
        self.reach = max(self.lookahead, *(self.token_length[i] for i in vocab.values()))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.after_space = _Kept(self.piece_ids), _Kept(self.chunk)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is left."""
        get = self.ranks.get
        ids = list(ids)
        keys = [get(a << 32 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while keys and (best := min(keys)) != NO_MERGE:
            i = keys.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del keys[i]
            if i:
                keys[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_MERGE)
            if i < len(keys):
                keys[i] = get(ids[i] << 32 | ids[i + 1], NO_MERGE)
        return ids

    def piece(self, piece: str) -> Iterator[list[int]]:
        """The ids of one piece of the pre-tokenizer, as they settle."""
        run = Transducer(self)
        for k in range(0, len(piece), 1024):
            yield run.feed(piece[k : k + 1024].encode())
        yield run.finish()

    def piece_ids(self, piece: str) -> bytes:
        return b"".join(map(_le, self.piece(piece)))

    def unit(self, unit: str) -> bytes:
        """The ids of white space and a word, in which the pre-tokenizer finds its pieces."""
        return b"".join([self.pieces[p[0]] for p in PIECES.finditer(unit)])

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands after a space, with that space; after a line end, with that."""
        line = chunk[:1] == "\n"
        if not chunk or ODD_SPACE.search(chunk, 1 if line else 0) or line and len(chunk) == 1:
            raise _Odd
        return self.unit(chunk if line else " " + chunk)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *chunks = text.replace("\n", " \n").split(" ")
        try:
            if first and ODD_SPACE.search(first):
                raise _Odd
            return self.unit(first) + b"".join(map(self.after_space.__getitem__, chunks))
        except _Odd:
            return b"".join([self.unit(m[0]) for m in UNITS.finditer(text)])

    def _settled(self, text: str) -> Iterator[bytes]:
        """The ids of a stretch without breaks, as they settle."""
        for m in UNITS.finditer(text):
            for p in PIECES.finditer(m[0]):
                if p.end() - p.start() <= CACHED_CHARS:
                    yield self.pieces[p[0]]
                else:
                    yield from map(_le, self.piece(p[0]))

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text in parts, as little-endian unsigned 32-bit integers; special strings count as their tokens."""
        special = any(s in text for s in self.special)
        for part in self.split_special.splititer(text) if special else (text,):
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                found = BREAK.search(part, at + STRETCH)
                end = found.end() if found else len(part)
                if end - at <= 2 * STRETCH:
                    yield self._plain(part[at:end])
                else:
                    yield from self._settled(part[at:end])
                at = end

    def encode(self, text: str) -> bytes:
        """The ids of a whole text at once."""
        return b"".join(self.stream(text))

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of encoded ids in parts."""
        machine = Decoder(self)
        for k in range(0, len(ids), 4 * DECODE_IDS):
            yield machine.feed(ids[k : k + 4 * DECODE_IDS])
        yield machine.finish()


class Decoder:
    """Ids to text by an incremental byte-to-text state machine.

    The machine's state is at most three bytes of an unfinished character;
    bytes that can't be a character become U+FFFD.
    """

    def __init__(self, model: ByteBpe):
        self.token_bytes, self.machine = model.token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.machine.decode(b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One model a worker process and path."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ``ids`` (little-endian unsigned 32-bit) of every row; a null text gives no ids."""

    def make():
        model = load(path)
        return lambda b: [b.column("doc_id"), b.column("text"), [model.encode(x) for x in texts(b)]]

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, text string, ids binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip; one row per input row.

    A null text counts as empty (no tokens). Nothing is shuffled and no text
    leaves its task, so repeated rows need nothing special; ids are digested and
    decoded as they settle, so a long text is never held as ids. An empty table
    gives an empty result and other columns aren't read.
    ``round_trip`` tells whether the decoded text equals the text.
    """

    def make():
        model = load(path)

        def each(b: pa.RecordBatch) -> list:
            n, ids_hash, text_hash, same = [], [], [], []
            for text in texts(b):
                count, of_ids, own, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(model)
                for ids in model.stream(text):
                    count += len(ids) // 4
                    of_ids.update(ids)
                    own.update(decoder.feed(ids).encode())
                own.update(decoder.finish().encode())
                n.append(count)
                ids_hash.append(of_ids.hexdigest())
                text_hash.append(own.hexdigest())
                same.append(own.digest() == hashlib.sha256(text.encode()).digest())
            return [b.column("doc_id"), n, ids_hash, text_hash, same]

        return each

    return map_batches(
        docs.selectExpr("cast(doc_id as long) doc_id", "text"), make,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean",
    )
