"""The parts of the operators by themselves."""

import collections
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lorewell.llm import arrow, bpe, components, fuse, lm, minhash, packing, quality, rows as rows_of, sharding, shingles, substring

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return bpe.load(P.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab \n\t'sé漢🙂12!<|>endoftx\r　", "<|endoftext|>", "  "]), max_size=60).map("".join))
def test_bpe_equals_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ids = bpe.load(path).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert "".join(bpe.load(path).decode(ids)) == text


@pytest.mark.parametrize("seed", range(6))
def test_transducer_settles_tokens_before_the_end(model, seed):
    rng = random.Random(seed)
    data = "".join(rng.choice(["a", "the", "ing", "=", "-", "er", "x"]) for _ in range(4000)).encode()
    whole = model.merge([model.byte_id[b] for b in data])
    run, out, held = bpe.Transducer(model), [], 0
    for k in range(0, len(data), 37):
        out += run.feed(data[k : k + 37])
        held = max(held, len(run.symbols))
    assert out + run.finish() == whole and out and held < 4 * model.reach + 37


class Merges(bpe.ByteBpe):
    """A model of single letters and a merge list."""

    def __init__(self, letters, merges):
        tokens = [*letters, *dict.fromkeys(u + v for u, v in merges)]
        number = {t: i for i, t in enumerate(tokens)}
        self.byte_id = {ord(c): number[c] for c in letters}
        self.ranks = {number[u] << 32 | number[v]: r << 32 | number[u + v] for r, (u, v) in reversed([*enumerate(merges)])}
        self.token_length = [len(t) for t in tokens]
        self.lookahead = bpe.sufficient_lookahead(merges)
        self.reach = max(self.lookahead, *self.token_length)


def test_transducer_ends_with_tokens_longer_than_the_lookahead():
    model = Merges("abcd", [("a", "b"), ("ab", "c"), ("abc", "d")])
    run = bpe.Transducer(model)
    assert model.lookahead == 1 and run.feed(b"abcdabcd" * 9) + run.finish() == [model.token_length.index(4)] * 18


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_transducer_equals_the_whole_merge_for_any_merge_list(data):
    tokens, merges = list("abc"), []
    for _ in range(data.draw(st.integers(1, 12))):
        pair = data.draw(st.tuples(st.sampled_from(tokens), st.sampled_from(tokens)))
        if pair not in merges and len(pair[0] + pair[1]) < 12:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    model = Merges("abc", merges)
    text = data.draw(st.text("abc", max_size=400)).encode()
    run, out = bpe.Transducer(model), []
    for k in range(0, len(text), 29):
        out += run.feed(text[k : k + 29])
    assert out + run.finish() == model.merge([model.byte_id[b] for b in text])


@pytest.mark.parametrize("seed", range(4))
def test_bpe_in_stretches_equals_the_library(seed, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "STRETCH", 40)
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "\n\n", "x" * 300, "é漢", "\x1c", "\u3000", " a", "<|endoftext|>", "=" * 90, " " * 200, "'ll"]) for _ in range(400))
    path = P.path("byte_bpe_50k.json")
    model = bpe.load(path)
    parts = list(model.stream(text))
    assert np.frombuffer(b"".join(parts), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert "".join(model.decode(b"".join(parts))) == text and len(parts) > 100


def test_lookahead_of_small_merge_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # whether "a" is merged with a following "b" depends on the "c" after that, and that on a "d"
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_decoder_replaces_broken_bytes(model):
    ids = np.array([model.byte_id[0xE6], model.byte_id[0x41], model.byte_id[0xC3]], "<u4").tobytes()
    assert "".join(model.decode(ids)) == "�A�"


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_fuse_filter_has_no_false_negatives(n, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    if n > 1000:
        assert fuse.contains(blob, rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01 and len(blob) < 2 * n


def test_rolling_hash():
    h = shingles.hash_words([b"a", b"b", b"c", b"a", b"b", b"c"])
    for k in (1, 2, 3, 5, 6):
        want = [sum(int(x) * pow(shingles.BASES[0], k - 1 - j, 1 << 64) for j, x in enumerate(h[i : i + k])) % (1 << 64) for i in range(len(h) - k + 1)]
        assert shingles.rolling(h, k).tolist() == want
    assert len(shingles.rolling(h, 7)) == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.85):
        guesses = []
        for _ in range(20):
            own = rng.permutation(pool)[: int(600 / (0.5 + share / 2) * 1)]
            both = int(len(own) * share)
            rest = (len(own) - both) // 2
            a, b = np.sort(own[: both + rest]), np.sort(np.concatenate([own[:both], own[both + rest :]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sa, sb = (np.frombuffer(minhash.packed(minhash.minima(x)), np.uint8)[None] for x in (a, b))
            guesses.append(minhash.estimate(sa, sb)[0] - j)
        assert abs(np.mean(guesses)) < 0.03 and max(map(abs, guesses)) < 0.2


def test_bands_miss_no_pair_at_the_threshold():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(100):
        own = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = own[:370], own[30:]  # 340 of 400
        missed += not set(minhash.band_keys(minhash.minima(a)).tolist()) & set(minhash.band_keys(minhash.minima(b)).tolist())
    assert missed == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2400)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}


def test_unsettled_bucket_is_settled_without_all_pairs(spark, tmp_path, monkeypatch):
    """A chain of near copies in which no copy is near them all."""
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = random.Random(6)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(text)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for _, t in rows]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(spark.read.parquet(path)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < 10


def test_minimizers_are_those_of_the_windows():
    h = shingles.hash_words([b"w%d" % (i % 17) for i in range(100)])
    m = substring.minimizers(h)
    g = shingles.mix(shingles.rolling(h, substring.GRAM)) >> np.uint64(16)
    n = substring.WINDOW - substring.GRAM + 1
    assert (m >> np.uint64(16)).tolist() == [int(g[i : i + n].min()) for i in range(len(h) - substring.WINDOW + 1)]


@pytest.mark.parametrize("before", [*range(0, 31, 3), 65_536])
def test_sketch_counts_every_repeat_of_a_run_across_a_border_of_places(before):
    """A window in a run of one word, wherever the run lies, is counted at least as often as it occurs."""
    rng = np.random.default_rng(before)
    h = rng.integers(0, 1 << 63, 2 * 65_536 + 100).astype(np.uint64)
    start = 65_536 - before
    h[start : start + 26] = 7
    m = substring.minimizers(h)
    new = m[np.append(True, m[1:] != m[:-1])]
    own = m[start : start + 7] | np.uint64(0xFFFF)
    assert len(m) == len(h) - substring.WINDOW + 1 and len(set(own.tolist())) == 1
    assert np.count_nonzero(new | np.uint64(0xFFFF) == own[0]) >= 7


def test_words_are_kept_until_another_operator_needs_the_memory():
    path = P.path("word_bpe_49k.json")
    first = packing._words(path)
    ids = first.encode(["one more, one\nmore"])
    assert packing._words(path) is first
    arrow.let_go()
    assert packing._words(path) is not first and packing._words(path).encode(["one more, one\nmore"]) == ids


def test_sum_of_squares_packing():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 400, 3000)
    sequence, offset, free = packing.sum_of_squares(lengths, 1000)
    for k in range(len(free)):
        own = np.flatnonzero(sequence == k)
        parts = sorted(zip(offset[own], lengths[own]))
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) + free[k] == 1000
    assert len(free) <= -(-lengths.sum() // 1000) + 1


def test_ppm_is_a_distribution_and_equals_the_table():
    texts = [b"the cat sat", b"the hat", b"a cat", "é".encode()]
    model = lm.Ppm()
    for t in texts:
        model.learn(t)
    for context in (b"\xff\xff\xff", b"the", b"qqq", b" ca", b"qhe"):
        assert sum(10 ** model.symbol(context, s) for s in range(256)) == pytest.approx(1)
    grams, n = np.unique(np.concatenate([lm._grams(t) for t in texts]).astype(np.int64), return_counts=True)
    low = collections.Counter()
    for g, k in zip(grams.tolist(), n.tolist()):
        low[g & 0xFFFFFF] += k
    keys = np.array(sorted(low))
    table = lm.Table(keys, np.array([low[k] for k in keys.tolist()]), grams, n)
    for t in [*texts, b"", b"zebra cat", b"qq\x00", b"xthe h"]:
        assert table.score(t) == pytest.approx(model.score(t), rel=1e-5)
    before = model.score(b"new words new words")
    assert model.score(b"new words new words", adapt=True) > before


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (200, 0.01), (57, 0.9)):
        for k in range(0, n + 1, max(1, n // 7)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_cutoffs_keep_the_risk():
    """The share of runs in which a cutoff rejects more good documents than allowed stays below the level."""
    rng = np.random.default_rng(8)
    alpha, level, failed = 0.02, 0.1, 0
    for _ in range(200):
        share = np.linspace(0, 0.1, quality.STEPS + 1)  # true share of good documents that each cutoff rejects
        good = np.bincount(np.searchsorted(share, rng.random(2000) * 1.0).clip(0, quality.STEPS + 1), minlength=quality.STEPS + 2)
        bad = np.full(quality.STEPS + 2, 5)
        step = quality.choose_step(good.tolist(), bad.tolist(), alpha, level)
        failed += step is not None and share[step] > alpha
    assert failed <= 200 * level
    assert quality.choose_step([0] * 42, [1] * 42, alpha, level) is None  # without good labels nothing is shown


def test_movement_is_confined_to_what_a_changed_weight_touches(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = sharding.layout(16)
    heavier = [sharding.Shard(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    rows = sharding.assign(sharding.assign(keys, keys["k"], tree, "a"), keys["k"], heavier, "b").select("a.*", *[F.col("b")[c].alias(f"{c}2") for c in ("region", "rack", "shard")]).toPandas()
    assert (rows.shard // 4 == rows["rack"]).all() and (rows.shard // 8 == rows.region).all()
    assert (rows.shard2 // 4 == rows.rack2).all() and (rows.shard2 // 8 == rows.region2).all()
    assert set(rows[rows.region != rows.region2].region2) == {0}
    stay = rows[rows.region == rows.region2]
    assert set(stay[stay["rack"] != stay.rack2].rack2) == {1}
    stay = stay[stay["rack"] == stay.rack2]
    assert set(stay[stay.shard != stay.shard2].shard2) == {5} and (rows.shard != rows.shard2).mean() < 0.15
    assert abs((rows.shard2 == 5).mean() - 2 / 17) < 0.01 and rows.shard.value_counts().std() < 60


def placed_by_hand(doc_id, tree):
    """The placement spelled out: 64-bit xxHash of the key, then of level and node, seeds chained; -ln(u) / weight; smallest first."""
    own = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)

    def draw(level, node, weight):
        h = own
        for x in (level, node):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return -math.log(((h >> 12) + 0.5) / 2**52) / weight

    level, left = 0, tree
    for name in ("region", "rack", "shard"):
        weights = collections.Counter()
        for x in left:
            weights[getattr(x, name)] += x.weight
        taken = min(weights, key=lambda node: draw(level, node, weights[node]))
        left, level = [x for x in left if getattr(x, name) == taken], level + 1
    return left[0].shard


def test_placement_equals_brute_force(spark):
    ids = [None, *range(-50, 3000), 2**62]
    docs = spark.createDataFrame([(i, "x" * (n % 7) if n % 5 else None) for n, i in enumerate(ids)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, sharding.layout(16), sharding.layout(17)).collect()
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in rows}
    assert got == {i: (placed_by_hand(i, sharding.layout(16)), placed_by_hand(i, sharding.layout(17))) for i in ids}
    assert {a for a, b in got.values() if a != b} == set(range(16)) and {b for a, b in got.values() if a != b} == {16}
    for k in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


@pytest.mark.parametrize("blocks", [8192, 0])
def test_rows_keep_their_identity_however_a_scan_is_split(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(rows_of, "BLOCKS", blocks)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i % 900, f"text {i % 700}" if i % 50 else None, 1) for i in range(1000)], "doc_id long, text string, uid int").repartition(6).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        seen, kept = [], []
        for n in ("8", "4", "1"):
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            table = rows_of.Rows(spark.read.parquet(path))
            picked = table.pick(F.col("doc_id"), F.col("text"))
            seen.append(sorted(map(tuple, picked.collect()), key=str))
            spark.conf.set("spark.sql.files.minPartitionNum", str(9 - int(n)))
            kept.append(sorted(map(tuple, table.keep(picked.where("doc_id % 3 = 1")).collect()), key=str))
        assert seen[0] == seen[1] == seen[2] and len({r[0] for r in seen[0]}) == 1000
        assert kept[0] == kept[1] == kept[2] and len(kept[0]) == sum(i % 900 % 3 == 1 for i in range(1000)) and {r[0] % 3 for r in kept[0]} == {1}
    finally:
        for k in ("minPartitionNum", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")
