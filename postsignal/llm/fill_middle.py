"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes, cut between units, with
the units and code points up to the end of each frame. A unit is a word with the white space before it;
white space at the end is a unit of its own. Selecting the units that a cut falls on is a search in the
cumulative counts, and only the frames that hold a cut are decompressed. The transformed text is again a
list of frames in its own order: whole frames move as they are, cut frames become two or three, markers are
frames of their own. Digests and texts stream the frames in order, so one frame is decompressed at a time.

All steps are narrow: no shuffle, no state between rows, and a lost task is repeated from its input rows.
Null texts count as empty; an empty text is no unit and has no frame. A unit without white space is never
cut, so a frame may be longer than ``FRAME_BYTES``. Null ids are drawn for like an empty number. Rows
repeated come back repeated, an empty table gives an empty result, and columns of the same names as the
results do no harm as only the named id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import text_slices, worker_state

FRAME_BYTES = 1 << 16
#: Bytes of text that are Python objects at once.
BATCH_BYTES = 1 << 21
LEVEL = 1


@dataclass(frozen=True)
class Middle:
    """Of 100 documents ``plain`` stay as they are; of 100 others ``spm`` put the suffix first."""

    seed: int = 42
    plain: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def unit_ends(data: bytes):
    """Byte positions at which the units of an UTF-8 text end."""
    import numpy as np

    codes = np.frombuffer(data, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(codes)) if len(codes) else ends


def code_points(data: bytes) -> int:
    """Code points of valid UTF-8."""
    import numpy as np

    return int((np.frombuffer(data, np.int8) >= -64).sum())


def _frame_end(data: bytes, start: int, most: int) -> int:
    """End of the frame from ``start``: the last end of a unit within ``most`` bytes, or else the first one."""
    if len(data) - start <= most:
        return len(data)
    ends = unit_ends(data[start : start + most + 1])[:-1]  # the last one is the window's own end
    if len(ends):
        return start + int(ends[-1])
    stop = start + most
    while stop < len(data):  # a unit longer than a frame
        ends = unit_ends(data[stop - 1 : stop + most + 1])[:-1]
        if len(ends):
            return stop - 1 + int(ends[0])
        stop += most
    return len(data)


def packed(data: bytes, compress, most: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int]]:
    """Frames of a text, and the units and code points up to the end of each."""
    frames, units, chars, start = [], [], [], 0
    while start < len(data):
        stop = _frame_end(data, start, most)
        part = data[start:stop]
        frames.append(compress(part))
        units.append(len(unit_ends(part)) + (units[-1] if units else 0))
        chars.append(code_points(part) + (chars[-1] if chars else 0))
        start = stop
    return frames, units, chars


def _compressor():
    import zstandard

    return worker_state(("fill_middle", "in"), lambda: zstandard.ZstdCompressor(level=LEVEL)).compress


def _decompressor():
    import zstandard

    return worker_state(("fill_middle", "out"), zstandard.ZstdDecompressor).decompress


def framed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", middle: Middle = Middle(), most: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, marked, frames, unit_ends, char_ends): every text as frames with cumulative counts.

    ``marked`` tells whether the text holds one of the markers already.
    """
    markers = [m.encode() for m in (middle.prefix, middle.suffix, middle.middle)]

    def run(batches):
        import pyarrow as pa

        compress = _compressor()
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), BATCH_BYTES):
                rows = [packed(x, compress, most) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([any(m in x for m in markers) for x in texts]),
                        pa.array([r[0] for r in rows], pa.list_(pa.binary())),
                        pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "marked", "frames", "unit_ends", "char_ends"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, marked boolean, frames array<binary>, unit_ends array<long>, char_ends array<long>")


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four numbers below 2^32 that the seed and the id decide."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _split(frames, unit_ends_of, cuts, compress, decompress) -> list[list[bytes]]:
    """The frames between the cuts (numbers of units, rising): one more list than there are cuts.

    Frames without a cut inside are passed on compressed.
    """
    out, before, k = [[]], 0, 0
    for frame, upto in zip(frames, unit_ends_of):
        while k < len(cuts) and cuts[k] <= before:
            out.append([])
            k += 1
        inside = []
        while k + len(inside) < len(cuts) and cuts[k + len(inside)] < upto:
            inside.append(cuts[k + len(inside)])
        if not inside:
            out[-1].append(frame)
        else:
            data = decompress(frame)
            ends, start = unit_ends(data), 0
            for cut in inside:
                stop = int(ends[cut - before - 1])
                if stop > start:
                    out[-1].append(compress(data[start:stop]))
                out.append([])
                start = stop
            out[-1].append(compress(data[start:]))
            k += len(inside)
        before = upto
    while k < len(cuts):
        out.append([])
        k += 1
    return out


def transformed(frames: DataFrame, middle: Middle = Middle()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): the frames of each text in their new order.

    ``frames`` is what ``framed`` returns. Form is plain, psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle).
    """

    def one(doc_id, marked, parts, units, chars, compress, decompress):
        n = units[-1] if units else 0
        h = draws(doc_id, middle.seed)
        if not n or marked or h[2] % 100 >= middle.plain:
            return n, "plain", None, None, parts
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        head, centre, tail = _split(parts, units, [first, second], compress, decompress)
        size = lambda some: sum(code_points(decompress(x)) for x in some)
        known = {x: c - (chars[i - 1] if i else 0) for i, (x, c) in enumerate(zip(parts, chars))}
        counted = lambda some: sum(known[x] if x in known else size([x]) for x in some)
        p, s, m = (compress(x.encode()) for x in (middle.prefix, middle.suffix, middle.middle))
        if h[3] % 100 < middle.spm:
            return n, "spm", counted(head), counted(centre), [s, *tail, p, *head, m, *centre]
        return n, "psm", counted(head), counted(centre), [p, *head, s, *tail, m, *centre]

    def run(batches):
        import pyarrow as pa

        compress, decompress = _compressor(), _decompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                columns = [c.slice(i, 512).to_pylist() for c in batch.columns]
                rows = [one(*row, compress, decompress) for row in zip(*columns)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 512), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"],
                )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
    return frames.select("doc_id", "marked", "frames", "unit_ends", "char_ends").mapInArrow(run, schema)


def in_order(frames: list[bytes], form: str, decompress, middle: Middle = Middle()) -> list[bytes]:
    """The frames of the original text, found in those of a transformed one by its markers."""
    if form == "plain":
        return frames
    names = {m.encode(): k for m, k in ((middle.prefix, "p"), (middle.suffix, "s"), (middle.middle, "m"))}
    longest = max(map(len, names))
    parts, at = {}, None
    for frame in frames:
        # a marker is a frame of its own, and no text that holds one was transformed
        name = names.get(decompress(frame)) if len(frame) <= longest + 64 else None
        if name:
            at = parts[name] = []
        else:
            at.append(frame)
    return parts["p"] + parts["m"] + parts["s"]


def _mapped(rows: DataFrame, schema: str, one) -> DataFrame:
    """Columns made from (frames, form) of each row, beside all others."""
    added = [x.split()[0] for x in schema.split(", ")]
    kept = [c for c in rows.columns if c not in (*added, "frames")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches):
        import pyarrow as pa

        decompress = _decompressor()
        for batch in batches:
            last = batch.num_columns - 1
            for i in range(0, batch.num_rows, 512):
                forms = batch.column("form").slice(i, 512).to_pylist()
                made = [one(x, form, decompress) for x, form in zip(batch.column(last).slice(i, 512).to_pylist(), forms)]
                arrays = [pa.array([m[k] for m in made], pa.string()) for k in range(len(added))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 512) for c in range(last)], *arrays], names=[*kept, *added])

    return rows.select(*kept, "frames").mapInArrow(run, f"{types}, {schema}")


def digested(rows: DataFrame, middle: Middle = Middle()) -> DataFrame:
    """SHA-256 of the transformed text and of the text rebuilt from it, frame by frame, in place of the frames."""

    def one(frames, form, decompress):
        import hashlib

        def streamed(some):
            digest = hashlib.sha256()
            for frame in some:
                digest.update(decompress(frame))
            return digest.hexdigest()

        return streamed(frames), streamed(in_order(frames, form, decompress, middle))

    return _mapped(rows, "output_sha256 string, restored_sha256 string", one)


def texts(rows: DataFrame, middle: Middle = Middle()) -> DataFrame:
    """The transformed text and the one rebuilt from it, in place of the frames."""

    def one(frames, form, decompress):
        joined = lambda some: b"".join(map(decompress, some)).decode()
        return joined(frames), joined(in_order(frames, form, decompress, middle))

    return _mapped(rows, "output string, restored string", one)
