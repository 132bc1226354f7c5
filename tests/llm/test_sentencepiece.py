import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from postsignal.llm import sentencepiece_bpe as B

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def words():
    return B.Vocabulary(B.read_model(PATH))


def test_encoding_and_decoding_equal_the_library(words, library):
    rnd = random.Random(1)
    parts = list(" \n\t▁  abcdefthernin.!?|*éèüßñ中文字🙂‍\x00\xa0　\x85\r<>ΩЖाहि") + ["the", "tion", "ing", "  ", "\n\n", "▁▁▁", "</s>", "<0x41>"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))
        ids = np.frombuffer(words.encode(text), np.int32).tolist()
        assert ids == library.encode(text), text
        assert words.decode([*ids, 2]) == library.decode([*ids, 2]), text


def test_decoding_of_any_ids(words, library):
    rnd = random.Random(2)
    for _ in range(4000):
        ids = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), rnd.randrange(259, 32000), 29871]) for _ in range(rnd.randrange(9))]
        assert words.decode(ids) == library.decode(ids), ids


def test_backtracking_is_needed_and_linear(words, library):
    greedy = 0
    for text in ("▁therealization", "▁unbelievablethings", "▁antidisestablishment", "▁xthex"):
        longest, at = [], 0
        while at < len(text):
            piece = next(text[at:e] for e in range(len(text), at, -1) if text[at:e] in words.ids or e == at + 1)
            longest.append(piece)
            at += len(piece)
        greedy += longest != words.pieces(text)
        assert words.pieces(text) == words.merged(text)
    assert greedy
    text = "ab" * 40_000 + "x" * 40_000 + "é" * 500
    assert np.frombuffer(words.encode(text), np.int32).tolist() == library.encode(text)


def test_caches_stay_bounded(words, monkeypatch):
    cache = B.Recent(lambda k: k * 2, 5)
    assert [cache[i % 9] for i in range(100)] == [i % 9 * 2 for i in range(100)]
    assert len(cache) <= 5 and len(cache.old) <= 5


def test_rows(spark, messy, none, library):
    keep = [c for c in messy.columns if c != "ids"]
    coded = B.decode_ids(B.encode_texts(messy, PATH, keep=messy.columns), PATH)
    assert coded.columns == [*[c for c in keep if c != "decoded"], "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == messy.count()
    for r in rows:
        ids = [*library.encode(r.text or ""), 2]
        assert r.ids == ids and r.decoded == library.decode(ids)
    both = B.encode_texts(messy, PATH, decoded=True)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both.collect()) == sorted((str(r.doc_id), r.ids, r.decoded) for r in rows)
    assert B.decode_ids(B.encode_texts(none, PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in B.decode_ids(nulls, PATH).collect()} == {1: None, 2: ""}


def test_shorter_pieces_are_what_the_longest_one_starts_with(words):
    """From the longest piece at a place down to the character, nothing that comes back when merged anew is left out."""
    words.pieces("▁xthex")
    for piece in [p for p in words.ids if len(p) > 1 and words.merged(p) == [p]][::40]:
        chain = [piece]
        while (last := words.shorter.get(chain[-1])) is not None:
            chain.append(last)
        starts = [piece[:n] for n in range(len(piece), 0, -1)]
        assert chain == [p for p in starts if len(p) == 1 or (p in words.ids and words.merged(p) == [p])]
