"""Fill-in-middle against the rule spelled out on Python strings."""

import hashlib
import re

import pytest

from postsignal.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("most", [1, 7, 64, M.FRAME_BYTES])
def test_texts_equal_the_rule(spark, messy, most):
    got = M.texts(M.transformed(M.framed(messy, most=most)))
    rows = [tuple(r[c] for c in "doc_id n form prefix_chars middle_chars output restored".split()) for r in got.collect()]
    want = [brute(r.doc_id, r.text) for r in messy.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert {"plain", "spm", "psm"} <= {r[2] for r in rows}


def test_markers_and_borders(spark):
    texts = [" ", "a", "a ", " a", "<P>", "x<M>y", "<S", "P> <", "\x0b\x0c\r\n", "é 中 文 🙂", "\x00 \x00", "a b c", "w" * 300]
    rows = [(i * 100 + k, t) for k, t in enumerate(texts) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.texts(M.transformed(M.framed(docs, most=3))).collect()
    assert sorted(tuple(r[c] for c in "doc_id n form prefix_chars middle_chars output restored".split()) for r in got) == sorted(brute(*r) for r in rows)


def test_frames_are_independent_and_counted():
    import zstandard

    data = ("word  über\n" * 5000 + "  ").encode()
    frames, units, chars = M.packed(data, zstandard.ZstdCompressor().compress, 1000)
    parts = [zstandard.ZstdDecompressor().decompress(f) for f in frames]
    assert b"".join(parts) == data and len(frames) > 40 and max(map(len, parts)) <= 1000
    assert units[-1] == len(UNIT.findall(data.decode())) == 10_001 and chars[-1] == len(data.decode())
    for part, upto in zip(parts, units):
        assert len(UNIT.findall(b"".join(parts[: parts.index(part) + 1]).decode())) == upto or parts.count(part) > 1


def test_only_cut_frames_are_opened():
    import zstandard

    opened = []
    compress, plain = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    data = b" ".join(b"w%d" % i for i in range(20_000))
    frames, units, _ = M.packed(data, compress, 2000)
    parts = M._split(frames, units, [150, 9_000], compress, lambda f: opened.append(f) or plain(f))
    assert len(opened) == 2 and [sum(len(M.unit_ends(plain(f))) for f in p) for p in parts] == [150, 8_850, 11_000]


def test_empty_table(spark, none):
    assert M.digested(M.transformed(M.framed(none))).count() == 0
