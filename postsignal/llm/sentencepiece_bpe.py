"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

Merging from single characters is defined by order of scores; the result is also the only sequence of
pieces in which every piece, and every two neighbours, come back unchanged when their own text is
merged anew. So an encoder need not merge: an Aho-Corasick automaton finds all pieces in the text, the
longest one at the current position is tried first, a pair check against the piece before it (by
re-merging the text of the two, remembered) accepts or rejects it, the next shorter one follows, and
when none fits the last piece is taken back. The pieces before a position are determined by the
position alone, so a position that failed once is marked in a bitfield and never tried again: time is
linear in the text.

Texts are cut between characters that no piece of the vocabulary holds side by side: before a space
mark that follows another character, around line ends, before most punctuation. Parts repeat, so each
worker keeps a bounded number of them. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from postsignal.llm.common import Recent, by_bytes, text_slices, worker_state

MARK = "▁"
#: Parts (twice as many) and pairs that a worker keeps, and bytes of text per result batch.
KEPT, PAIRS, BATCH_BYTES = 100_000, 200_000, 1 << 21


class Vocabulary:
    """Pieces, scores and special ids of a model, and the encoder and decoder over them."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.vocab_size()
        self.normalize, self.eos = processor.normalize, processor.eos_id()
        self.bytes_at = next((i for i in range(size) if processor.is_byte(i)), None)
        if self.bytes_at is None:
            raise ValueError("the model has no byte pieces")
        special = {i for i in range(size) if processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)}
        plain = [i for i in range(size) if i not in special and not processor.is_byte(i)]
        self.ids = {processor.id_to_piece(i): i for i in plain}
        self.scores = {piece: processor.get_score(i) for piece, i in self.ids.items()}
        self.found_in, self.together, self.shorter = None, {}, {}
        longer = [p for p in self.ids if len(p) > 1]
        # neighbouring characters that some piece holds together
        self.inside = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.cuts_at_marks = not any(pair[1] == MARK and pair[0] != MARK for pair in self.inside)
        self.line_cuts = not any("\n" in pair for pair in self.inside)
        self.spaced = Recent(lambda word: self.joined(MARK + word), KEPT)
        self.bare = Recent(self.packed, KEPT)
        # ASCII bytes are characters of their own; other bytes are put together when decoding
        self.shown = [""] * size
        for piece, i in self.ids.items():
            self.shown[i] = piece.replace(MARK, " ")
        for b in range(128):
            self.shown[self.bytes_at + b] = chr(b)
        self.unknown = processor.unk_id()
        self.shown[self.unknown] = processor.decode([self.unknown])
        self.np = np

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def matches(self):
        """Finds the pieces of two characters or more that come back when merged anew.

        Also notes for each of them the next shorter one that it starts with, its first character if there is none.
        """
        import ahocorasick

        automaton = ahocorasick.Automaton()
        whole = {piece for piece in self.ids if len(piece) > 1 and len(self.merged(piece)) == 1}
        for piece in whole:
            automaton.add_word(piece, (len(piece) - 1, piece))
            self.shorter[piece] = next((piece[:i] for i in range(len(piece) - 1, 1, -1) if piece[:i] in whole), piece[0])
        automaton.make_automaton()
        return automaton.iter

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours come back when their text is merged anew."""
        if len(self.together) > PAIRS:
            self.together.clear()
        known = self.together[left, right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The encoding of a part, by backtracking."""
        n, together, shorter = len(text), self.together.get, self.shorter.get
        self.found_in = self.found_in or self.matches()
        # ends rise, so the longest piece of a start is the last one; all others there are what it starts with
        longest = {end - before: piece for end, (before, piece) in self.found_in(text)}.get
        failed = bytearray(n + 1)
        taken = []
        at, last = 0, None
        while at < n:
            piece = longest(at) or text[at]
            while True:
                while piece is not None:
                    end = at + len(piece)
                    if not failed[end]:
                        if last is None:
                            break
                        known = together((last, piece))
                        if known is None:
                            known = self.fits(last, piece)
                        if known:
                            break
                    piece = shorter(piece)  # after the single character, the last resort, none
                if piece is not None:
                    break
                failed[at] = 1
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else None
                piece = shorter(piece)
            taken.append(piece)
            at, last = end, piece
        return taken

    def packed(self, text: str) -> bytes:
        """Ids of a part as 32-bit integers."""
        pieces = self.pieces(text)
        ids = [*map(self.ids.get, pieces)]
        if None in ids:
            ids = [i for piece, known in zip(pieces, ids) for i in ([known] if known is not None else [self.bytes_at + b for b in piece.encode()])]
        return array("i", ids).tobytes()

    def joined(self, text: str) -> bytes:
        """Ids of a word, cut where no piece reaches across."""
        inside = self.inside
        if inside.issuperset(map(add, text, text[1:])):
            return self.packed(text)
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inside]
        return b"".join([self.bare[text[a:b]] for a, b in zip([0, *cuts], [*cuts, None])])

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers, without an end id."""
        text = self.normalize(text)
        if not text:
            return b""
        if not self.cuts_at_marks:
            return self.packed(text)
        lines = text.split("\n") if self.line_cuts else [text]
        spaced, bare, newline = self.spaced.__getitem__, self.bare.__getitem__, b""
        out = []
        for i, line in enumerate(lines):
            if i:
                newline = newline or self.packed("\n")
                out.append(newline)
            if MARK + MARK in line or line.endswith(MARK):
                out += map(bare, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line))
                continue
            first, *rest = line.split(MARK)
            if first:
                out.append(bare(first))
            out += map(spaced, rest)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces in a row as UTF-8, one leading space mark dropped."""
        np = self.np
        ids = np.asarray(ids)
        high = (ids >= self.bytes_at + 128) & (ids < self.bytes_at + 256)
        shown = self.shown
        if not high.any():
            text = "".join([shown[i] for i in ids.tolist()])
        else:
            parts, run = [], bytearray()
            for i in ids.tolist():
                if self.bytes_at <= i < self.bytes_at + 256:
                    run.append(i - self.bytes_at)
                    continue
                parts += [_utf8(run), shown[i]] if run else [shown[i]]
                run.clear()
            text = "".join([*parts, _utf8(run)])
        first = next((i for i in ids.tolist() if shown[i] or self.bytes_at <= i < self.bytes_at + 256), None)
        marked = first is not None and not self.bytes_at <= first < self.bytes_at + 256 and text.startswith(" ")
        return text[1:] if marked and first != self.unknown else text


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that is part of no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + size]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            at += size
        return "".join(out)


def _vocabulary(model: bytes) -> Vocabulary:
    from hashlib import sha256

    return worker_state(("sentencepiece", sha256(model).digest()), lambda: Vocabulary(model))


def read_model(path: str) -> bytes:
    """A model file on the driver's machine; it travels to the workers with the function."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), end: bool = True, decoded: bool = False
) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``ids``, the ids of each text, with an end id if ``end``.

    With ``decoded`` also the text of these ids, decoded in the same pass. One row per row, in any
    order. Null texts count as empty: no ids but the end id. Columns that are not kept are ignored; a
    kept column with the name of a result gives way. Rows may repeat, an empty table gives an empty
    result.
    """
    names = ["ids", "decoded"] if decoded else ["ids"]
    model, keep = read_model(path), [c for c in keep if c not in names]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = _vocabulary(model)
        last = np.array([words.eos], np.int32).tobytes() if end else b""
        for batch in batches:
            for a, b, texts in text_slices(batch.column(len(keep)), BATCH_BYTES):
                coded = [words.encode(x.decode()) + last for x in texts]
                offsets = np.cumsum([0, *(len(x) // 4 for x in coded)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                found = [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), ids]
                if decoded:
                    found.append(pa.array([words.decode(np.frombuffer(x, np.int32)) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(found, names=[*keep, *names])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")
    return rows.mapInArrow(run, schema)


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (all columns, with ``ids``) and the text of the ids as ``decoded``.

    Null ids give a null text; a column that is already called decoded gives way.
    """
    model, keep = read_model(path), [c for c in coded.columns if c not in ("ids", "decoded")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = _vocabulary(model)
        for batch in batches:
            ids = batch.column(len(keep))
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            valid = ids.is_valid().to_pylist()
            for a, b in by_bytes([range(n) for n in np.diff(offsets).tolist()], BATCH_BYTES // 4):
                texts = [words.decode(values[offsets[i] : offsets[i + 1]]) if valid[i] else None for i in range(a, b)]
                held = [batch.column(i).slice(a, b - a) for i in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(texts, pa.string())], names=[*keep, "ids", "decoded"])

    rows = coded.select(*keep, "ids")
    return rows.mapInArrow(run, coded.select(*keep, "ids").schema.add("decoded", "string"))
