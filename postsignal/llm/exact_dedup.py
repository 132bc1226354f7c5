"""Exact deduplication with a Golomb-coded exchange of fingerprints.

1. Every scanning partition cuts its 64-bit text hashes to a universe of about ``SPARE`` values per
   document, sorts them and sends them to the owners of their ranges as Rice-coded differences
   (Golomb codes with a power of two as divisor), about a byte and a half per document.
   An owner only asks whether a value occurs twice, so a batch sends no value more than twice: a text
   that most rows share is two entries a batch.
2. An owner decodes what it got, finds the values that occur twice and answers with a bitmap. The
   bitmaps of all owners together have eight bits a document, at most 2^``MOST_BITS`` (128 MiB): beyond
   10^8 documents they fill up and more texts are suspects, which costs their shuffle and nothing else.
3. Only documents whose bit is set are suspects. Their texts are shuffled and compared byte by byte:
   they are grouped by the text itself, not by its hash. All other texts stay where they are.

Equal texts always meet, since they have equal hashes; an unequal text with the bit of another one
only costs its shuffle. Copies collapse on the map side of the grouping, so a text that a third of
all rows share sends one row per task, and the join that hands the result back splits hot texts
(both of its sides are plain shuffles).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import rows_of, stored, text_key, worker_state

#: Values of the hash universe per document: one in so many documents is a suspect by chance.
SPARE = 256
#: Bits of the answer that every scanning task receives: eight a document between these powers of two.
LEAST_BITS, MOST_BITS, SPARE_BITS = 18, 30, 3
#: Documents whose hashes one owner decodes at once.
OWNED = 1 << 20
BITMAP_BITS = 15  # bits of one bitmap row, fixed by Spark's bitmap functions: 2^15


def rice_encode(values, shift: int) -> tuple[bytes, bytes]:
    """Sorted unsigned integers as differences: unary quotients, then ``shift`` low bits of each."""
    import numpy as np

    gaps = np.diff(values, prepend=values[:1] * 0)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def rice_decode(unary: bytes, low: bytes, count: int, shift: int):
    """The integers that ``rice_encode`` was given."""
    import numpy as np

    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:count]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = quotients << np.uint64(shift)
    if shift:
        bits = np.unpackbits(np.frombuffer(low, np.uint8))[: count * shift].reshape(count, shift)
        gaps |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(shift - 1, -1, -1, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)


def _sender(universe: int, owner_bits: int):
    """Hashes of a partition to one Rice-coded row per owner."""

    def send(batches):
        import numpy as np
        import pyarrow as pa

        worker_state(("exact",), dict)  # nothing is kept
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = np.sort(hashes >> np.uint64(64 - universe))
            values = values[np.concatenate([np.ones(min(2, len(values)), bool), values[2:] != values[:-2]])]
            owners = values >> np.uint64(universe - owner_bits)
            edges = np.flatnonzero(np.diff(owners)) + 1
            rows = {"owner": [], "count": [], "shift": [], "unary": [], "low": []}
            for part in np.split(values, edges) if len(values) else ():
                base = part - (part[0] >> np.uint64(universe - owner_bits) << np.uint64(universe - owner_bits))
                shift = max(0, int(math.log2(max(1.0, 2.0 ** (universe - owner_bits) * 0.7 / len(part)))))
                unary, low = rice_encode(base, shift)
                for k, v in zip(rows, (int(part[0] >> np.uint64(universe - owner_bits)), len(part), shift, unary, low)):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=list(rows),
            )

    return send


def _owner(universe: int, owner_bits: int, filter_bits: int):
    """Values that occur twice or more, as rows of the shared bitmap."""

    def answer(key, frame):
        import numpy as np
        import pandas as pd

        held = [rice_decode(u, w, n, s) for u, w, n, s in zip(frame["unary"], frame["low"], frame["count"], frame["shift"])]
        values = np.sort(np.concatenate(held)) + (np.uint64(key[0]) << np.uint64(universe - owner_bits))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        bits = twice >> np.uint64(universe - filter_bits)
        out = []
        for bucket in np.unique(bits >> np.uint64(BITMAP_BITS)):
            mine = bits[(bits >> np.uint64(BITMAP_BITS)) == bucket] & np.uint64((1 << BITMAP_BITS) - 1)
            marks = np.zeros(1 << BITMAP_BITS, np.uint8)
            marks[mine.astype(np.int64)] = 1
            out.append((int(bucket), np.packbits(marks, bitorder="little").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "bitmap"])

    return answer


def filter_bits(documents: int) -> int:
    """Bits of the hash prefixes that the answer tells apart."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, documents))) + SPARE_BITS))


def duplicate_bitmaps(hashes: DataFrame, documents: int) -> DataFrame:
    """(bucket, bitmap) of hash prefixes seen twice; at most 2^(filter_bits - 15) rows of 4 KiB.

    ``hashes`` has one long column; ``documents`` is the number of its rows, which sets the size of
    the answer, of the hash universe and the number of owners.
    """
    bits = filter_bits(documents)
    universe = min(62, max(bits, math.ceil(math.log2(max(2, documents) * SPARE))))
    owner_bits = max(4, math.ceil(math.log2(max(1, documents) / OWNED + 1)))
    coded = hashes.mapInArrow(
        _sender(universe, owner_bits), "owner long, count int, shift int, unary binary, low binary"
    )
    answers = coded.groupBy("owner").applyInPandas(_owner(universe, owner_bits, bits), "bucket long, bitmap binary")
    return answers.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when their bytes are; a null text counts as empty. The largest id of a group
    stays. Rows repeated with one id and text count in ``group_size`` and all carry ``kept``, as they
    are the same document. Null ids lose against any other; a group of null ids keeps them. Columns
    of ``docs`` other than the two named are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", text_key(F.col("_text")))
    documents = docs.count()
    bits = filter_bits(documents)
    bitmaps = duplicate_bitmaps(rows.select("_hash"), documents)
    # bounded by construction: at most 2^(MOST_BITS - 15) rows of 4 KiB
    answer = F.broadcast(stored(bitmaps, "duplicate-bitmaps"))
    bucket = F.shiftrightunsigned("_hash", 64 - bits + BITMAP_BITS)
    bit = F.shiftrightunsigned("_hash", 64 - bits).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    marked = rows.join(answer, bucket == answer["bucket"], "left")
    marked = marked.withColumn("_suspect", F.coalesce(_is_set(F.col("bitmap"), bit), F.lit(False))).drop("bucket", "bitmap")
    suspects = marked.filter("_suspect").drop("_suspect")
    # byte for byte: the text is the key
    groups = stored(
        suspects.groupBy("_hash", "_text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text_sha256", F.sha2("_text", 256)),
        "equal-texts",
    )
    joined = suspects.join(groups, ["_hash", "_text"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("_hash").alias("text_key")
    )
    single = marked.filter("not _suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.sha2("_text", 256).alias("text_sha256"),
        F.col("_hash").alias("text_key"),
    )
    return single.unionByName(joined)


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all columns."""
    kept = exact_groups(docs, doc_id, text).filter("kept")
    return rows_of(docs, kept, doc_id, text)
