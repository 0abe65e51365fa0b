"""Every operator over a table with nulls, empty and long texts, repeated rows and clashing columns, and over an empty one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import bpe, chat, counts, exact, lm, minhash, packing, quality, sharding, substring
from lorewell.llm.rows import Rows

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

CLASHING = "uid long, row string, label string, key string, part int, shard int, kept boolean, n_words int, _c int, text_key int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
FILL = (1, "r", "l", "k", 2, 3, False, 4, 5, 6)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(n))


BASE = words(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[60], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "a"), (8, "a"), (8, "a"),
    (None, BASE), (None, None), (9, "word " * 5000), (10, words(30_000, 2)), (11, "x" * 30_000), (12, "a b\n\nc  d\r\ne <|endoftext|> </s> ▁ 　f"),
    (13, words(25, 3) + " " + " ".join(BASE.split()[10:50])), (14, "é̀ ﬁ 🙂\x00\x1c z"), (15, "A B C"), (16, "a b c"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(i, t, None if i == 3 else "en", None, None, *FILL) for i, t in TEXTS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1), (9, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_documents(docs, path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
    rows = bpe.round_trip_digests(docs, path).collect()
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows)
    assert bpe.round_trip_digests(empty, path).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in TEXTS)
    got = counts.count_tokens(docs, path).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and counts.count_tokens(empty, path).count() == 0


def test_packing_is_whole_and_gapless(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 512).collect()
    got = {}
    for r in rows:
        got.setdefault(r["uid"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = []
    for _, t in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [np.array(ids[k : k + 512], "<u4").tobytes() for k in range(0, len(ids), 512)]
        want.append([(n, 512 * n, len(p) // 4, zlib.crc32(p)) for n, p in enumerate(parts)])
    assert sorted(sorted(x) for x in got.values()) == sorted(want)
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in rows)
    assert len(filled) <= -(-total // 512) + 1 and packing.pack(empty, path).count() == 0


def test_exact_dedup_keeps_the_largest(docs, empty):
    rows = exact.exact_dedup(docs, 3).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    biggest = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted((str(i), str(biggest(groups[t or ""])), len(groups[t or ""])) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups) and exact.exact_dedup(empty).count() == 0
    out = exact.keep_one(docs)
    assert out.columns == docs.columns and out.count() == len(groups) and out.where("row <> 'r' or uid <> 1").count() == 0


def test_near_dedup_equals_brute_force(docs, empty):
    rows = minhash.near_dedup(docs).collect()
    sets = [(i, frozenset(shingle_words(t))) for i, t in TEXTS]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    first = {}
    for r, (i, _) in zip(root, sets):
        first.setdefault(r, []).append(i)
    want = sorted((str(i), len(s), str(min((x for x in first[r] if x is not None), default=None))) for r, (i, s) in zip(root, sets))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(first) and minhash.near_dedup(empty).count() == 0
    assert minhash.keep_one(docs).count() == len(first)


def shingle_words(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def removed(rows):
    """Brute force over (doc_id, text) in order: words left of each."""
    seen, out = set(), []
    for i, t in rows:
        found = (t or "").encode().split()
        gone = [False] * len(found)
        for j in range(len(found) - 19):
            window = tuple(found[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(window)
        out.append((i, len(found), sum(gone), b" ".join(w for w, g in zip(found, gone) if not g).decode()))
    return out


def test_substring_dedup_equals_brute_force(docs, empty):
    got = substring.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed(order)))
    assert substring.remove_repeats(empty).count() == 0
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0


def test_lm_scores_equal_the_trie(docs, empty):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = lm.Ppm()
    for i, t in TEXTS:
        if not held(i):
            model.learn((t or "").encode())
    want = sorted((str(i), held(i), len((t or "").split()) if not t or t.isascii() else len(t.encode().split())) for i, t in TEXTS)
    rows = lm.score_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"] - 1) for r in rows) == want
    score = {str(i): model.score((t or "").encode()) for i, t in TEXTS if i in (4, 7, 12, 13, 15)}
    assert {str(r["doc_id"]): r["score"] for r in rows if str(r["doc_id"]) in score} == pytest.approx(score, rel=1e-5)
    assert lm.score_documents(empty).count() == 0


@pytest.mark.parametrize("held", [1, 20])
def test_lm_keeps_contexts_beyond_the_table_of_a_worker(docs, monkeypatch, held):
    monkeypatch.setattr(lm, "MAX_CONTEXTS", held)
    model = lm.Ppm()
    for i, t in TEXTS:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            model.learn((t or "").encode())
    score = {str(i): model.score((t or "").encode()) for i, t in TEXTS if i in (1, 3, 4, 7, 12, 13, 14, 15, 16)}
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {str(r["doc_id"]): r["score"] for r in rows if str(r["doc_id"]) in score} == pytest.approx(score, rel=1e-5)


def test_quality_rules(docs, empty, labels):
    rows = {str(r["doc_id"]): r for r in quality.verdicts(docs, labels).collect()}
    assert rows["4"]["n_words"] == 0 and rows["4"]["base_failed"] and not rows["4"]["kept"]
    assert rows["9"]["n_repeat_words"] == 5000 and rows["9"]["base_failed"] and rows["1"]["kept"]
    assert quality.verdicts(docs, labels).count() == len(TEXTS) and quality.verdicts(empty, labels).count() == 0
    out = quality.keep_good(docs, labels.where("false"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {1, 2, 3, None, 10, 13}


def test_every_language_is_judged_by_its_own_labels(spark):
    """Of 61 labelled languages, one with long words and few labels, all good, loses no document to cutoffs learned from others."""
    short, long = " ".join(f"w{i:03}" for i in range(60)), " ".join(f"longwordoftwentyfour{i:04}" for i in range(60))
    bad = " ".join(f"badwordoftwentythree{i:03}" for i in range(60))
    texts = [("l00", short, 1, 4000), ("l00", bad, 0, 50), *[(f"l{k:02}", short, 1, 250) for k in range(1, 60)], ("l55", bad, 0, 9), ("zz", long, 1, 5), *[(f"l{k:02}", short, 1, 50) for k in range(1, 40)]]
    rows = [(lang, text, q) for lang, text, q, n in texts for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t, _) in enumerate(rows)] + [(len(rows), long, "none"), (-1, None, "l00")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(rows)], "doc_id long, quality int")
    for out in (quality.verdicts(docs, labels).where("kept").select(F.col("stratum").alias("lang")), quality.keep_good(docs, labels)):
        kept = {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}
        assert kept["zz"] == 5 and kept["none"] == 1  # too few labels, or none: no cutoff
        assert kept["l00"] == 4000 and kept["l55"] == 259 and kept["l39"] == 300


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, sharding.layout(16), sharding.layout(17)).collect()
    assert len(rows) == len(TEXTS) and all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard_documents(empty, sharding.layout(16)).count() == 0


def test_chat_rotation(spark, tmp_path):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yes"), (1, 2, "bob", "yes"), (1, None, "ann", None), (1, 3, None, "who"),
        (None, 0, "ann", "lost"), (2, 0, "system", "alone"), *[(3, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(300)],
        *[(4, 5, "ann", "same")] * 200,
    ]
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([(*t, "x", 9) for t in turns], "conv_id long, turn long, role string, text string, part string, rank int").repartition(3).write.parquet(path)
    rows = chat.rotate(spark.read.parquet(path)).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        whole.setdefault((r["conv_id"], r["speaker"]), []).append(r)
        for span in filter(None, r["mask"].split(";")):
            a, b = map(int, span.split(":"))
            assert r["text"][:a].endswith("<|start|>assistant\n") and r["text"][a:b].endswith("<|end|>\n")
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, ""), (None, "ann"), (3, "ann"), (3, "bob"), (4, "ann")}
    assert whole[1, "ann"][0]["text"] == (
        "<|start|>assistant\n<|end|>\n<|start|>system\nBe kind.<|end|>\n<|start|>assistant\nhi <\\|end|><|end|>\n"
        "<|start|>user name=bob\nyes<|end|>\n<|start|>user name=bob\nyes<|end|>\n<|start|>user name=\nwho<|end|>\n"
    )
    long = whole[3, "ann"]
    assert [r["n_turns"] for r in long] == [64, 64, 64, 64, 44] and sum(r["n_masked"] for r in long) == 150
    assert [line for r in long for line in r["text"].split("\n") if line.startswith("turn")] == [f"turn {i}<|end|>" for i in range(300)]
    assert sum(r["n_turns"] for r in whole[4, "ann"]) == 200
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_digests_are_of_the_text(docs):
    got = {r["digest"].hex() for r in exact.digests(Rows(docs)).withColumn("digest", F.col("digest")).collect()}
    assert got == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS}
