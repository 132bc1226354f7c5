"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "postsignal", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # hash joins instead of sorting both sides, where every partition is measured to be small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
        # keyed stream state on disk instead of the heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run on this machine, may do without one and gets a temporary
    folder. On a cluster that would leave each executor with files of its own, so it is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    folder = context.getCheckpointDir()
    # scratch tables and checkpoints of this application go with it
    atexit.register(remove_folder, context, folder)
    return folder


def remove_folder(context, folder: str) -> None:
    """Delete a scratch folder with its files."""
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; its folder stays for the next cleaning
        return


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage.

    Used where a later step must see exactly the same rows and partition numbers again, or where
    an iteration would grow the plan. The data survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    from uuid import uuid4

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder below the checkpoint folder, and read back.

    Like ``materialize``, for tables of which later steps read some columns or rows.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """What is run inside may join tables that lie together by some of the join's keys, without dealing them out anew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
