import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postsignal.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_rows_equal_the_library(messy, none, library, monkeypatch):
    got = T.count_tokens(messy, PATH, 2048)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in messy.collect()
    )
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and {r.over_limit for r in rows} == {True, False}
    assert T.count_tokens(none, PATH, 10).count() == 0


def test_parts_and_bounds(library, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 50)
    monkeypatch.setattr(T, "GROUP_BYTES", 64)
    counter = T.Counter(open(PATH, encoding="utf-8").read())
    assert counter.by_parts
    rnd = random.Random(4)
    parts = list(" \n\t abcABC'sdt!?|*éèüßñ中文字🙂‍\x00\xa0　\x85\x1c\x0bΣσςİहि̈́") + ["the", "<|endoftext|>", "<|startoftext|>", "'ll", "<|end"]
    for _ in range(40):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(50))) for _ in range(30)]
        want = [len(library.encode(x, add_special_tokens=False)) for x in texts]
        assert counter.counts([x.encode() for x in texts]) == want
        assert len(counter.known) < 50 + 30 * 50


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = open(path, encoding="utf-8").read()
    assert not T.cuts_at_spaces(json.loads(model))
    texts = ["", "two  spaces ", "a\nb <|endoftext|>"]
    library = Tokenizer.from_file(path)
    assert T.Counter(model).counts([x.encode() for x in texts]) == [len(library.encode(x, add_special_tokens=False)) for x in texts]
