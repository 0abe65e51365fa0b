"""The corpus pipeline stage by stage, and the base columns of LM scoring, against brute force."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lorewell.llm import lm
from lorewell.scratch import materialize

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402


def text(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{seed}x{i}" for i in range(n)]


def changed(words, *places):
    return [f"new{i}" if i in places else w for i, w in enumerate(words)]


BASE, OTHER, FAR = text(100, 1), text(100, 2), text(100, 3)
#: Similarity to BASE: 0.90 (one word), 0.81 (two), 0.73 (three); 40 words of OTHER come again in 20.
WORDS = {
    1: BASE, 2: BASE, 3: changed(BASE, 50), 4: changed(BASE, 20, 80), 5: changed(BASE, 10, 40, 70), 6: OTHER, 7: text(49, 4), 8: text(50, 5),
    9: ["again"] * 80, 10: [], 11: changed(FAR, 30), 12: FAR, 20: text(60, 6) + OTHER[10:50], 21: text(6000, 7),
}
DOCS = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in WORDS.items()]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def good(words):
    runs = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k, run in enumerate(zip(words, words[1:], words[2:])) if runs[run] > 1 for j in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def one_of_near(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in docs.items()}
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: w for i, w in docs.items() if root[i] == i}


def without_repeats(docs):
    seen, out = set(), {}
    for i, w in sorted(docs.items()):
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_every_stage_equals_brute_force(spark, sf_dir):
    want = dict(WORDS)
    steps = [
        lambda d: {i: w for i, w in d.items() if good(w)},
        lambda d: {max(j for j, v in d.items() if v == w): w for w in d.values()},
        one_of_near,
        without_repeats,
    ]
    docs, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs, want = materialize(stage(spark, docs, sf_dir), name), step(want)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: " ".join(w) for i, w in want.items()}, name
        sizes.append(len(want))
    assert sizes == [11, 10, 7, 7] and len(want[20]) == 60  # each stage has work to do
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ends, places = collections.Counter(), collections.defaultdict(list)
    for r in pieces:
        ends[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert ends == {i: len(model.encode(" ".join(w), add_special_tokens=False).ids) + 1 for i, w in want.items()}
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_base_columns_of_lm_scoring(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in WORDS}
    count = collections.Counter(x for i, w in WORDS.items() if not held[i] for x in w)
    ends = sum(not h for h in held.values())
    total, distinct = sum(count.values()) + ends, len(count) + 1
    rows = {r["doc_id"]: r for r in lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert set(rows) == set(WORDS) and any(held.values())
    for i, w in WORDS.items():
        base = sum(math.log10(c + 1) for c in [*(count[x] for x in w), ends]) - (len(w) + 1) * math.log10(total + distinct + 1)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(w) + 1, sum(x in count for x in w) + 1, total)
        assert rows[i]["base_score"] == pytest.approx(base, rel=1e-9)
