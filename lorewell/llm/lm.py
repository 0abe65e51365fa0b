"""LM scoring by prediction by partial matching (PPM) over bytes.

A trie of byte contexts up to ORDER counts what followed each context. A symbol
is coded in its longest known context; if it never followed there, an escape is
coded (method C: as likely as the number of distinct symbols seen) and the next
shorter context is tried, without the symbols that the longer one has already
ruled out (symbol exclusion), down to a uniform order -1. The byte 0xFF, which
UTF-8 never uses, stands before a text as its first contexts and after it as its
end, so the scores of all texts are one probability distribution.

``Ppm`` is that model as such, static (pretrained) or adaptive (it learns each
text as it codes it). Over a corpus the pretrained model is a table: counts of
all contexts of the training texts are gathered by a shuffle, and the log
probability of every symbol in every context follows from them with numpy, so a
text is scored by table look-ups. Workers hold the MAX_CONTEXTS most frequent
contexts of the highest order and all shorter ones; the other contexts of the
highest order stay a distributed table, to which the texts' symbols are joined.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm.arrow import batch, map_batches, texts
from lorewell.llm.rows import Rows
from lorewell.scratch import materialize

ORDER, END = 3, 0xFF
#: Contexts of the highest order in a worker's table: 64 MB. The others are joined.
MAX_CONTEXTS = 1 << 16
#: Words in the broadcast table, distinct words a task holds before it passes them on, bytes scored at once, rows passed on at once.
FREQUENT, HELD, CHUNK, ROWS = 1 << 18, 400_000, 1 << 22, 1 << 17
#: Longer words are counted by a digest.
WORD_BYTES = 16
GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
MISSES = pa.schema([("uid", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
BEYOND = pa.schema([("uid", pa.int64()), ("gram", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("onward", pa.float64()), ("seen", pa.bool_())])


class Ppm:
    """The model itself, one symbol at a time."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, Counter] = defaultdict(Counter)

    def learn(self, text: bytes) -> None:
        padded = bytes([END]) * self.order + text + bytes([END])
        for i in range(self.order, len(padded)):
            for k in range(self.order + 1):
                self.counts[padded[i - k : i]][padded[i]] += 1

    def symbol(self, context: bytes, s: int) -> float:
        """log10 of the probability of a symbol after a context of ``order`` bytes."""
        score, out = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            here = {x: n for x, n in seen.items() if x not in out} if seen else {}
            if not here:
                continue
            total, distinct = sum(here.values()), len(here)
            if s in here:
                return score + math.log10(here[s] / (total + distinct))
            score += math.log10(distinct / (total + distinct))
            out |= here.keys()
        return score - math.log10(256 - len(out))

    def score(self, text: bytes, adapt: bool = False) -> float:
        """log10 of the probability of a text and its end; with ``adapt`` each symbol is learned after it is coded."""
        padded, total = bytes([END]) * self.order + text + bytes([END]), 0.0
        for i in range(self.order, len(padded)):
            total += self.symbol(padded[i - self.order : i], padded[i])
            if adapt:
                for k in range(self.order + 1):
                    self.counts[padded[i - k : i]][padded[i]] += 1
        return total


def _grams(text: bytes) -> np.ndarray:
    """The four bytes (context and symbol) at each symbol of a text, as one number."""
    b = np.frombuffer(bytes([END]) * ORDER + text + bytes([END]), np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def _dense(contexts: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts by context (row, sorted contexts) and symbol."""
    out = np.zeros((len(contexts), 256))
    np.add.at(out, (np.searchsorted(contexts, grams >> 8), grams & 255), n)
    return out


def _layer(count: np.ndarray, lower: np.ndarray, lower_p: np.ndarray, lower_escape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all symbols in contexts, and of the escape, from the next shorter context's (same rows)."""
    seen = count > 0
    total, distinct = count.sum(1), seen.sum(1)
    escape = distinct / (total + distinct)
    rest = np.where(seen, 0, lower)
    rest_total, rest_distinct = rest.sum(1), (rest > 0).sum(1)
    weight = np.maximum(rest_total + rest_distinct, 1)
    onward = np.where(rest_distinct > 0, rest_distinct / weight, 1.0)
    below = np.where(lower > 0, rest / weight[:, None], onward[:, None] * lower_p / lower_escape[:, None])
    return np.where(seen, count / (total + distinct)[:, None], escape[:, None] * below), escape


class Table:
    """log10 probability by row of context and symbol, and the row of every context of three bytes."""

    def __init__(self, low_grams: np.ndarray, low_n: np.ndarray, grams: np.ndarray, n: np.ndarray):
        """``low_grams``: two bytes of context and a symbol, all of them; ``grams``: three bytes and a symbol, of the contexts held."""
        none = np.zeros((1, 256))
        count0 = none.copy()
        np.add.at(count0[0], low_grams & 255, low_n)
        if not len(low_grams):
            self.logs, self.rows = np.full((1, 256), math.log10(1 / 256), np.float32), np.zeros(1 << 24, np.int32)
            self.two, self.three = 1, 1
            return
        p0, e0 = _layer(count0, none, np.full((1, 256), 1 / max(1, 256 - int((count0 > 0).sum()))), np.ones(1))
        c1 = np.unique(low_grams >> 8 & 255)
        count1 = _dense(c1, low_grams & 0xFFFF, low_n)
        same = np.zeros(len(c1), np.int64)
        p1, e1 = _layer(count1, count0[same], p0[same], e0[same])
        c2 = np.unique(low_grams >> 8)
        count2 = _dense(c2, low_grams, low_n)
        up = np.searchsorted(c1, c2 & 255)
        p2, e2 = _layer(count2, count1[up], p1[up], e1[up])
        # of the contexts of two bytes: their first row and the one after; what a longer context needs of them
        self.two, self.three = 1 + len(c1), 1 + len(c1) + len(c2)
        self.seen = np.packbits(count2 > 0, axis=1)
        self.log_total, self.log_escape = np.log10(count2.sum(1) + (count2 > 0).sum(1)), np.log10(e2)
        c3 = np.unique(grams >> 8)
        logs = [np.log10(p).astype(np.float32) for p in (p0, p1, p2)]
        starts = np.searchsorted(grams, c3 << 8)
        for k in range(0, len(c3), 4096):
            part = c3[k : k + 4096]
            a, b = starts[k], starts[k + 4096] if k + 4096 < len(c3) else len(grams)
            up = np.searchsorted(c2, part & 0xFFFF)
            logs.append(np.log10(_layer(_dense(part, grams[a:b], n[a:b]), count2[up], p2[up], e2[up])[0]).astype(np.float32))
        self.logs = np.concatenate(logs)
        one = np.zeros(256, np.int32)
        one[c1] = 1 + np.arange(len(c1), dtype=np.int32)
        two = np.tile(one, 256)
        two[c2] = 1 + len(c1) + np.arange(len(c2), dtype=np.int32)
        self.rows = np.tile(two, 256)
        self.rows[c3] = 1 + len(c1) + len(c2) + np.arange(len(c3), dtype=np.int32)

    def score(self, text: bytes) -> float:
        g, total = _grams(text), 0.0
        for k in range(0, len(g), CHUNK):
            part = g[k : k + CHUNK]
            total += float(self.logs[self.rows[part >> np.uint32(8)], part & np.uint32(255)].sum(dtype=np.float64))
        return total

    def beyond(self, text: bytes) -> Iterator[list[np.ndarray]]:
        """gram, n, low, onward, seen of the symbols whose context of three bytes isn't held although that of two bytes is known.

        ``low`` is how ``score`` counts the symbol; ``onward`` is the part of its
        score after an escape from three bytes that doesn't depend on them: the
        log10 of its count after two bytes if it was ``seen`` there, else of its
        probability after a second escape.
        """
        g = _grams(text)
        for k in range(0, len(g), CHUNK):
            part = g[k : k + CHUNK]
            row = self.rows[part >> np.uint32(8)]
            grams, n = np.unique(part[(row >= self.two) & (row < self.three)], return_counts=True)
            row, symbol = self.rows[grams >> np.uint32(8)], grams & np.uint32(255)
            two = row - self.two
            low = self.logs[row, symbol].astype(np.float64)
            seen = (self.seen[two, symbol >> np.uint32(3)] >> (7 - (symbol & np.uint32(7))) & 1).astype(bool) if len(grams) else np.zeros(0, bool)
            onward = low + np.where(seen, self.log_total[two], -self.log_escape[two]) if len(grams) else low
            yield [grams.astype(np.int64), n, low, onward, seen]


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    """Whether a document isn't learned from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        both, place = np.unique(np.concatenate([total, values.astype(np.int64)]), return_inverse=True)
        out = np.zeros(len(both), np.int64)
        np.add.at(out, place, np.concatenate([n, counts]))
        return both, out

    for b in batches:
        for text in texts(b):
            held.append(_grams(text.encode()))
            size += len(held[-1])
            if size >= CHUNK:
                total, n = merged()
                held, size = [], 0
                if len(total) > 4 * CHUNK:
                    yield batch(GRAMS, [total, n])
                    total, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, n = merged()
    yield batch(GRAMS, [total, n])


def _key(word: bytes) -> bytes:
    return word if len(word) <= WORD_BYTES else b"\0" + xxhash.xxh3_128_digest(word)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for text in texts(b):
            counts.update(text.encode().lower().split())
            if len(counts) > HELD:
                yield batch(WORDS, [[_key(w) for w in counts], list(counts.values())])
                counts = Counter()
    yield batch(WORDS, [[_key(w) for w in counts], list(counts.values())])


def train_table(train: DataFrame) -> tuple[tuple[np.ndarray, ...], DataFrame | None]:
    """The arguments of ``Table``, of bounded size, and the contexts beyond them (None: there are none), from all texts of ``train``."""
    counted = train.select("text").mapInArrow(_count_grams, "gram long, n long")
    grams = materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    context = F.shiftright("gram", 8)
    contexts = grams.groupBy(context.alias("c")).agg(F.sum("n").alias("m"))
    held = materialize(contexts.orderBy(F.desc("m"), "c").limit(MAX_CONTEXTS).select("c"), "contexts")
    low_grams = materialize(grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")), "low")
    high, low = grams.join(F.broadcast(held), context == F.col("c"), "left_semi").toPandas(), low_grams.toPandas()
    high, low = high.sort_values("gram"), low.sort_values("gram")
    more = contexts.count() > MAX_CONTEXTS
    rare = _rare_contexts(grams.join(F.broadcast(held), context == F.col("c"), "left_anti"), low_grams) if more else None
    return tuple(x.to_numpy(np.int64) for x in (low["gram"], low["n"], high["gram"], high["n"])), rare


def _rare_contexts(grams: DataFrame, low: DataFrame) -> DataFrame:
    """c, logs, escaped_seen, escaped: what ``_layer`` needs of each context of three bytes, as log10.

    ``logs``: by symbol that followed; the others get ``escaped_seen`` or
    ``escaped``, if they followed the last two bytes or not, and ``onward``.
    """
    gram, n, zero = F.col("gram"), F.col("n"), F.lit(0)
    below = low.select(F.col("gram").alias("below"), F.col("n").alias("n2"))
    two = low.groupBy(F.shiftright("gram", 8).alias("c2")).agg(F.sum("n").alias("total2"), F.count(F.lit(1)).alias("distinct2"))
    pairs = F.collect_list(F.struct(gram.bitwiseAND(255).cast("int").alias("s"), F.log10(n).alias("log")))  # 256 at most
    sums = grams.withColumn("below", gram.bitwiseAND(0xFFFFFF)).join(below, "below").groupBy(F.shiftright("gram", 8).alias("c"))
    sums = sums.agg(pairs.alias("pairs"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("n2").alias("ruled_out"))
    sums = sums.withColumn("c2", F.col("c").bitwiseAND(0xFFFF)).join(two, "c2")
    log_all = F.log10(F.col("total") + F.col("distinct"))
    rest = F.col("distinct2") - F.col("distinct")
    weight = F.log10(F.greatest(F.col("total2") - F.col("ruled_out") + rest, F.lit(1)))
    escape = F.log10("distinct") - log_all
    logs = F.map_from_entries(F.transform("pairs", lambda x: F.struct(x["s"], x["log"] - log_all)))
    onward = F.when(rest > 0, F.log10(F.greatest(rest, F.lit(1))) - weight).otherwise(zero.cast("double"))
    return materialize(sums.select("c", logs.alias("logs"), (escape - weight).alias("escaped_seen"), (escape + onward).alias("escaped")), "rare")


def train_words(train: DataFrame) -> DataFrame:
    """word, c of all texts of ``train`` (the end of a text isn't among them)."""
    counted = train.select("text").mapInArrow(_count_words, "word binary, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "words")


def frequent_words(words: DataFrame) -> dict[bytes, int]:
    """The words whose count reaches the smallest power of two that at most FREQUENT words reach."""
    level = F.floor(F.log2("c")).alias("level")
    left, least = FREQUENT, None
    for r in words.groupBy(level).count().orderBy(F.desc("level")).collect():  # at most 64 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return {}
    rows = words.where((F.col("c") >= 2**least) & (F.octet_length("word") <= WORD_BYTES)).toPandas()
    return dict(zip(map(bytes, rows["word"]), rows["c"].tolist()))


_worker: dict = {}


def _of_worker(name: str, shared, make):
    """What a worker process has built from a broadcast value; it outlives a task."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else getattr(shared, "_path", id(shared))
    if _worker.get(name, (None,))[0] != key:
        _worker.pop(name, None)
        _worker[name] = key, make(shared.value)
    return _worker[name][1]


def score_documents(docs: DataFrame, fold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learned from are the documents with crc32(doc_id as text) mod ``folds`` not
    ``fold``. Tokens are the words of the text with A-Z lower-cased, and one end;
    base_score sums log10((c + 1) / (N + V + 1)) over them. score is the PPM
    model's log10 probability of the whole text in bytes. A null text is empty:
    an end alone. Repeated rows count as often as they occur. An empty table
    gives an empty result; without training texts all bytes are equally likely.
    Texts of any length are scored whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = Rows(docs).pick(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), fold, folds))
    train = rows.where(~F.col("held_out"))
    held, rare_contexts = train_table(train)
    table = spark.sparkContext.broadcast(held)
    words = train_words(train)
    ends = train.count()
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    frequent = spark.sparkContext.broadcast(frequent_words(words))
    log_end, end_known = math.log10(ends + 1), int(ends > 0)

    def make():
        model = _of_worker("table", table, lambda x: Table(*x))
        logs = _of_worker("frequent", frequent, lambda x: {w: math.log10(c + 1) for w, c in x.items()})

        def each(b: pa.RecordBatch) -> list:
            n, known, base, score = [], [], [], []
            for text in texts(b):
                data = text.encode()
                own = data.lower().split()
                found = [x for x in map(logs.get, own) if x is not None]
                n.append(len(own) + 1)
                known.append(len(found) + end_known)
                base.append(math.fsum(found) + log_end)
                score.append(model.score(data))
            return [b.column("uid"), b.column("doc_id"), b.column("held_out"), n, known, base, score]

        return each

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), texts(b)):
                rare = Counter(w for w in text.encode().lower().split() if w not in known)
                if rare:
                    yield batch(MISSES, [[uid] * len(rare), [_key(w) for w in rare], list(rare.values())])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, size = _of_worker("table", table, lambda x: Table(*x)), [], 0

        def passed_on() -> pa.RecordBatch:
            return batch(BEYOND, [pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*found), BEYOND)])

        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), texts(b)):
                for columns in model.beyond(text.encode()):
                    found.append([np.full(len(columns[0]), uid, np.int64), *columns])
                    size += len(columns[0])
                    if size >= ROWS:
                        yield passed_on()
                        found, size = [], 0
        if found:
            yield passed_on()

    first = map_batches(rows, make, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    rare = rows.select("uid", "text").mapInArrow(misses, "uid long, word binary, n long")
    rare = rare.join(words, "word").groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("sum"))
    zero, score = F.lit(0), F.col("score")
    out = first.join(rare, "uid", "left")
    if rare_contexts is not None:
        symbols = rows.select("uid", "text").mapInArrow(beyond, "uid long, gram long, n long, low double, onward double, seen boolean")
        own = F.try_element_at("logs", F.col("gram").bitwiseAND(255).cast("int"))
        log = F.coalesce(own, F.when(F.col("seen"), F.col("escaped_seen")).otherwise(F.col("escaped")) + F.col("onward"))
        symbols = symbols.withColumn("c", F.shiftright("gram", 8)).join(rare_contexts, "c")
        out = out.join(symbols.groupBy("uid").agg(F.sum(F.col("n") * (log - F.col("low"))).alias("change")), "uid", "left")
        score = score + F.coalesce("change", zero.cast("double"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("sum", zero.cast("double")) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"), score.alias("score"),
    )
