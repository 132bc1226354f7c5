"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is reference text for the documents with a larger id. Its text is cut into blocks
whose borders the content decides: the window of 50 words that starts at a word belongs to the block
of its minimizer, the smallest hash among the 12-word phrases inside it. Equal windows have equal
minimizers, wherever they are, so a document is parsed against every reference block that can hold
one of its windows, and against no other: the index is keyed by the minimizer.

1. *Index.* Documents send one row per block (about one for every twenty words): minimizer, hash of
   the block's words, id, place. Equal blocks are one reference block, at a place in the document
   with the smallest id. A text that a third of all rows repeat is one reference per block.
2. *Matches.* A block of another document that equals a reference block matches as a whole, with
   that place.
3. *Factor boundaries.* Where a passage begins or ends its repetition, blocks with the same minimizer
   differ, and a factor ends inside a block. These places only are checked window by window: the
   first document of each such block sends its windows, the smallest id of each window answers with
   its place.
4. *Parse.* Each document is read from left to right. A factor starts at the first matching word that
   is not yet read and goes on, over blocks and windows, as long as the next match lies in the same
   reference, right behind the last one. Where it does not, the factor is as long as the index can make
   it, and the next one starts. Words without a match are literals.
5. *Spans.* A factor has at least 50 words, as one window has. Factors that touch or overlap are joined
   to spans, and the words they cover are removed.

Blocks are compared by their minimizer and a second 64-bit hash, windows by their minimizer and
another one: 128 independent bits, so a wrong match among 10^12 windows has a chance below 10^-14.
Only minima are aggregated (combined on the map side); nothing makes pairs of documents. The scan
holds about ``PIECE`` words of a text at a time: longer texts are cut with an overlap of a window,
which moves block borders, not results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import stored, text_bytes, text_key, text_slices, worker_state

WINDOW = 50
PHRASE = 12
#: Words of a text that are worked on at once.
PIECE = 1 << 18
#: Bytes of text that are Python objects at once.
BATCH_BYTES = 1 << 21
#: Words whose hashes a worker keeps.
KEPT = 200_000
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _word_hashes(words: list[bytes]):
    """64-bit hash of each word; a worker keeps the hashes of frequent words, up to a bound."""
    import numpy as np
    from xxhash import xxh64_intdigest

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > KEPT:
                self.clear()
            value = self[word] = xxh64_intdigest(word, 7)
            return value

    known = worker_state(("substring", "hashes"), Hashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _powers(n: int):
    """Powers of both bases and of their inverses modulo 2^64, at least ``n`` of each."""
    import numpy as np

    def make():
        return {"n": 0}

    held = worker_state(("substring", "powers"), make)
    if held["n"] < n:
        with np.errstate(over="ignore"):
            for name, base in (("a", BASE), ("b", BASE2)):
                for kind, value in (("", base), ("i", pow(base, -1, 1 << 64))):
                    steps = np.full(n, value, np.uint64)
                    steps[0] = 1
                    held[name + kind] = np.cumprod(steps, dtype=np.uint64)
        held["n"] = n
    return held


def _mix(x):
    """Spread the bits of a polynomial hash, so that its order is as good as random."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Text:
    """Polynomial hashes of the word ranges of a text."""

    def __init__(self, words: list[bytes]):
        import numpy as np

        hashes = _word_hashes(words)
        self.powers = _powers(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = {
                k: np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[k][: len(words)], dtype=np.uint64)])
                for k in ("a", "b")
            }

    def ranges(self, start, stop, kind: str):
        import numpy as np

        with np.errstate(over="ignore"):
            return _mix((self.sums[kind][stop] - self.sums[kind][start]) * self.powers[kind + "i"][start])


def _sliding_min(x, width: int):
    """Minimum of every ``width`` neighbours."""
    import numpy as np

    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(words: list[bytes]):
    """Blocks of a text: arrays (minimizer, content hash, first window, number of windows).

    Neighbouring windows with the same minimizer value form a block.
    """
    import numpy as np

    n = len(words) - WINDOW + 1
    text = Text(words)
    starts = np.arange(len(words) - PHRASE + 1)
    least = _sliding_min(text.ranges(starts, starts + PHRASE, "a"), WINDOW - PHRASE + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(first, append=n)
    with np.errstate(over="ignore"):
        content = text.ranges(first, first + size + WINDOW - 1, "b") ^ _mix(size.astype(np.uint64))
    return least[first], content, first, size


def _pieces(words: list[bytes]):
    """(offset, words) of overlapping parts; every window lies in exactly one."""
    for at in range(0, max(1, len(words) - WINDOW + 1), PIECE):
        yield at, words[at : at + PIECE + WINDOW - 1]


def _index(batches):
    """Texts to blocks; each distinct block of a document once, as its places come later."""
    import numpy as np
    import pyarrow as pa

    names = ["anchor", "content", "doc_id", "text_key", "start", "size"]
    for batch in batches:
        held, rows = [], 0

        def flush(held):
            columns = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, own, text in ((docs[a + i], keys[a + i], x) for a, _, texts in text_slices(batch.column(2), BATCH_BYTES) for i, x in enumerate(texts)):
            words = text.split()
            if len(words) < WINDOW or doc is None:
                continue
            for at, part in _pieces(words):
                anchor, content, first, size = blocks(part)
                held.append((anchor.view(np.int64), content.view(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), own, np.int64), (first + at).astype(np.int64), size.astype(np.int32)))
                rows += len(first)
                if rows > 200_000:
                    yield flush(held)
                    held, rows = [], 0
        if held:
            yield flush(held)


def _windows(batches):
    """(doc_id, text_key, text, places) to the windows of the given blocks: anchor, window hash, id, text key, start."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        docs, keys, texts, places = (batch.column(i) for i in range(4))
        for doc, own, text, held in zip(docs.to_pylist(), keys.to_pylist(), text_bytes(texts), places):
            words = text.split()
            flat = held.values
            anchors, starts, sizes = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            order = np.argsort(starts)
            anchors, starts, sizes = anchors[order], starts[order], sizes[order]
            for at, part in _pieces(words):
                here = slice(*np.searchsorted(starts, [at, at + PIECE]))
                if here.start == here.stop:
                    continue
                size = sizes[here]
                first = np.repeat(starts[here] - at, size)
                window = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
                found = Text(part).ranges(window, window + WINDOW, "b").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchors[here], size)), pa.array(found), pa.array(np.full(len(window), doc, np.int64)),
                     pa.array(np.full(len(window), own, np.int64)), pa.array(window + at)],
                    names=["anchor", "window", "doc_id", "text_key", "start"],
                )


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, size, reference, place): runs of windows and where the index holds them.

    ``docs`` has doc_id, text_key and text. A run of ``size`` windows from word ``start`` on equals that
    from word ``place`` on in the document ``reference``, whose id is smaller. Runs of one text may touch,
    not overlap. If a reference holds the same words several times, any of the places is named.
    """
    index = stored(docs.mapInArrow(_index, "anchor long, content long, doc_id long, text_key long, start long, size int"), "blocks")
    key = ["anchor", "content"]
    references = stored(index.groupBy(*key).agg(F.min("doc_id").alias("reference"), F.min_by("start", "doc_id").alias("place"), F.max("doc_id").alias("last")), "references")
    # whole blocks: equal to a block of a smaller id
    shared = references.filter("reference < last").select(*key, "reference", "place")
    run = ["doc_id", "text_key", "start", "size", "reference", "place"]
    whole = index.join(shared, key).filter("doc_id > reference").select(*run)
    # factor boundaries: other blocks under the same minimizer
    several = stored(references.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "boundary-anchors")
    boundary = stored(references.join(several, "anchor").select(*key, "reference"), "boundary-blocks")
    open_blocks = index.join(boundary, key).filter("doc_id = reference").select("doc_id", "text_key", "anchor", "start", "size")
    places = open_blocks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("anchor", "start", "size")).alias("places"))
    sent = docs.join(places, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "places")
    windows = stored(sent.mapInArrow(_windows, "anchor long, window long, doc_id long, text_key long, start long"), "boundary-windows")
    answers = stored(
        windows.groupBy("anchor", "window")
        .agg(F.min("doc_id").alias("reference"), F.min_by("start", "doc_id").alias("place"), F.max("doc_id").alias("last"))
        .filter("reference < last"),
        "window-references",
    )
    single = windows.join(answers, ["anchor", "window"]).filter("doc_id > reference").withColumn("size", F.lit(1)).select(*run)
    return whole.unionByName(single)


def parse(starts, sizes, references, places):
    """Factors of a text from its matches: arrays (start, stop, reference, place), from left to right.

    Neighbouring windows of a text share all their words but one, so matches that lie side by side in the
    text and in one reference are one factor.
    """
    import numpy as np

    order = np.argsort(starts)
    starts, sizes, references, places = (x[order] for x in (starts, sizes, references, places))
    ends = starts + sizes
    goes_on = (starts[1:] == ends[:-1]) & (references[1:] == references[:-1]) & (places[1:] - places[:-1] == sizes[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], ends[last] + WINDOW - 1, references[first], places[first]


def _cut(batches):
    """Texts and matches to factors, spans and kept words."""
    import numpy as np
    import pyarrow as pa

    from itertools import compress

    for batch in batches:
        rows = []
        for doc, text, runs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)):
            words = text.split()
            spans, factors = [], []
            if runs.is_valid and len(runs.values):
                found = parse(*(runs.values.field(i).to_numpy().astype(np.int64) for i in range(4)))
                factors = [dict(zip(("start", "stop", "reference", "place"), f)) for f in zip(*(x.tolist() for x in found))]
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, found[0], 1)
                np.add.at(edges, found[1], -1)
                covered = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans = [{"start": int(a), "stop": int(b)} for a, b in turns]
                kept = list(compress(words, (~covered).tolist()))
            else:
                kept = words
            rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans, factors))
            if sum(len(r[3]) for r in rows[-1:]) > 1 << 22 or len(rows) >= 2000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


def _rows(rows):
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    factor = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop", "reference", "place")]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, factor)
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept", "spans", "factors"]
    )


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text), spans (word ranges cut), factors.

    A factor names the words from ``start`` to before ``stop`` and the document and word of that document
    (``reference``, ``place``) from which on the same words stand. Factors of a text may overlap by less than a window.

    A word goes when a window of 50 consecutive words that covers it also starts in a document with a
    smaller id. Words are what ASCII white space separates. Null texts have no words; documents of
    fewer than 50 words lose none; rows with null ids are parsed against nothing and serve as no
    reference. Rows that share an id but not the text are told apart by the text, and
    neither is a reference for the other; repeated rows come back repeated. Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    # a set, as repeated rows send equal matches
    found = matches(rows).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size", "reference", "place")).alias("runs"))
    joined = rows.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(
        _cut,
        "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, stop: long>>, "
        "factors array<struct<start: long, stop: long, reference: long, place: long>>",
    )
