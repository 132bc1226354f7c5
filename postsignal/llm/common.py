"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.runtime import scratch_folder

SPACES = "[^\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back.

    Cuts the lineage like ``checkpoint()``, but column-wise and compressed. Lost executors cost
    nothing: the files are in the folder that all executors share.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """An object kept by a Python worker across its tasks (a model, a bounded cache).

    Functions travel to the workers by value, so their own globals start afresh in each task. ``key``
    begins with the name of an operator; what another operator has left in a reused worker goes.
    """
    kept = sys.modules.setdefault("_postsignal_worker_state", types.ModuleType("_postsignal_worker_state"))
    states = kept.__dict__.setdefault("states", {})
    if key not in states:
        if others := [k for k in states if k[0] != key[0]]:
            for other in others:
                del states[other]
            _give_back()
        states[key] = make()
    return states[key]


def _give_back() -> None:
    """Return freed memory to the machine; a reused worker would hold it until it ends."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_bytes(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges [start, end) holding about ``most`` bytes or characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(column, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, texts as bytes) of consecutive rows of an Arrow column, about ``most`` bytes each.

    Only the rows at hand become Python objects.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most or i + 1 == len(sizes):
            yield start, i + 1, text_bytes(column.slice(start, i + 1 - start))
            start, held = i + 1, 0


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]



def text_key(text: Column) -> Column:
    """Tells the texts under one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rows_of(docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, text_key) names, each once, with all columns.

    The key is a struct of id and text key, so null ids are ids like any other, and rows that share an
    id but not the text are told apart. Join and removal of repeated rows use one shuffle.
    """
    named = kept.select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("text")).alias("_key"))
    ids = stored(named.distinct(), "kept-ids")
    keyed = docs.withColumn("_key", F.struct(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("text")))
    return keyed.join(ids, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


class Recent(dict):
    """A bounded cache of computed values, two generations deep.

    When ``most`` entries are held they become the old generation; old entries that are used again
    move to the new one, and the rest go when the next generation is full.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
