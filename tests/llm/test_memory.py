"""What workers keep between texts, and what it costs to make again."""

import pyarrow as pa
import pytest

from lorewell.llm import packing, shingles

import public_tokenizers as P

PATH = P.path("word_bpe_49k.json")


def test_letters_stay_known_when_the_words_around_them_go(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 2)
    words = packing.Words(PATH)
    assert words.direct
    made, one = [], words._letters
    monkeypatch.setattr(words, "_letters", lambda w: made.append(w) or one(w))
    for mark in ".,;:!?":
        text = f"Stone{mark} Überall{mark} lakeside{mark}"
        assert words.encode([text])[0] == words._one(text)
    assert sorted(made) == ["lakeside", "stone", "überall"]  # once each, however many words they are in


def test_ids_by_the_model_alone_are_those_of_the_tokenizer():
    words = packing.Words(PATH)
    letters = [chr(c) for c in range(0x41, 0x250) if packing.PLAIN.fullmatch(chr(c)) and chr(c).isalpha()]
    for c in letters:
        for w in (c, c + c, f"ab{c}cd", f"({c}x),", c.lower(), c.upper()):
            assert words.encode([w])[0] == words._one(w), w
    words.direct = False
    text = "Straße (naïve) Żółw zzqxj Lakeside, ǅ İx"
    assert words.encode([text])[0] == words._one(text)


def test_the_whole_tokenizer_sees_only_marks_and_odd_words(monkeypatch):
    words = packing.Words(PATH)
    made, one = [], words._one
    text = "Stone-baker, (lakeside)/stone; STONE!\nÉcole... école, don't\u00a0so <|x 4.0"
    want = one(text)
    monkeypatch.setattr(words, "_one", lambda w: made.append(w) or one(w))
    assert words.encode([text])[0] == want
    assert sorted(made) == sorted(["-", ",", "(", ")/", ";", "!", "...", "don't\u00a0so", "<|x", "4.0"])


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_texts_are_encoded_in_stretches_of_bounded_size(monkeypatch, stretch):
    texts = ["Ünder the bridge,\n\n it's <|endoftext|> A.B  né\u0301e", None, "", " ", "x" * 99, "中文 " * 20 + "Żółw/ÀÉ×", "\u0301a"]
    monkeypatch.setattr(packing, "STRETCH", stretch)
    words = packing.Words(PATH)
    seen, whole = [], words._stretch
    monkeypatch.setattr(words, "_stretch", lambda data, ends: seen.append(len(data)) or whole(data, ends))
    got = words.encode(pa.array(["left out", *texts]).slice(1))
    assert got == [words._one(t or "") for t in texts]
    assert max(seen) <= max(stretch, 128) or len(seen) == 1  # a word of 99 bytes is in one


def test_a_full_cache_of_word_hashes_stays_small():
    words = [b"w%d" % i for i in range(shingles.CACHE + 10)]
    found = shingles.hash_words(words)
    assert len(shingles._hashes) <= shingles.CACHE <= 100_000  # some 13 MB a worker
    assert (found[:5] == shingles.hash_words(words[:5])).all()
