"""Upserts, references, cursors and validity, folded from event logs.

Each "current state" is an aggregate over an ordered log. ``max_by``/``min_by`` combine on the map
side, so a key with very many log rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions.ids import snapshot_id
from postsignal.runtime import materialize

FEATURE_KEY = ("owner_type", "owner_id", "feature_name", "feature_version")


def latest_features(
    log: DataFrame, order: Sequence[str] = ("seq",), key: Sequence[str] = FEATURE_KEY,
    kept: Sequence[str] = ("feature_id", "created_at"),
) -> DataFrame:
    """Upsert by key: latest values, first id and creation time."""
    when = F.struct(*[F.col(c) for c in order])
    values = [c for c in log.columns if c not in (*key, *order, *kept)]
    merged = log.groupBy(*key).agg(
        F.min_by(F.struct(*kept), when).alias("_first"), F.max_by(F.struct(*values), when).alias("_last")
    )
    return merged.select(*key, "_first.*", "_last.*")


# Values of an object update that mean "nothing new" (apart from null).
NO_VALUE: Mapping[str, object] = {
    "relative_path": "",
    "byte_size": 0,
    "storage_policy": "metadata",
    "availability": "metadata_only",
}
OBJECT_COLUMNS = (
    "relative_path", "byte_size", "perceptual_hash", "storage_policy", "availability", "source_url",
    "retention_reason", "retention_expires_at", "local_deleted_at", "local_deleted_reason",
)


def merged_objects(updates: DataFrame, order: Sequence[str] = ("updated_at", "seq"), sha: str = "sha") -> DataFrame:
    """State of every media object after all its updates.

    Per column the last update that carries a value wins; columns without any take their
    "nothing" value.
    """
    when = F.struct(*[F.col(c) for c in order])
    aggs: list[Column] = []
    for name in (c for c in OBJECT_COLUMNS if c in updates.columns):
        col = F.col(name)
        if name == "byte_size":
            says = col > 0
        elif name in NO_VALUE:
            says = col != NO_VALUE[name]
        else:
            says = col.isNotNull()
        last = F.max_by(col, F.when(says, when))
        aggs.append((F.coalesce(last, F.lit(NO_VALUE[name])) if name in NO_VALUE else last).alias(name))
    return updates.groupBy(sha).agg(
        *aggs, F.min(order[0]).alias("created_at"), F.max(order[0]).alias("updated_at")
    )


def live_references(
    log: DataFrame, order: Sequence[str] = ("at", "seq"), sha: str = "sha", reference: str = "reference_id"
) -> DataFrame:
    """References whose latest action is ``add``: (sha, reference)."""
    last = log.groupBy(sha, reference).agg(
        F.max_by("action", F.struct(*[F.col(c) for c in order])).alias("action")
    )
    return last.filter("action = 'add'").drop("action")


def reference_counts(objects: DataFrame, live: DataFrame, sha: str = "sha") -> DataFrame:
    """Number of live references per object, zero included."""
    counts = live.groupBy(sha).agg(F.count(F.lit(1)).alias("n"))
    return objects.select(sha).join(counts, sha, "left").select(
        sha, F.coalesce("n", F.lit(0).cast("long")).alias("reference_count")
    )


def release_unnamed(live: DataFrame, releases: DataFrame, sha: str = "sha", reference: str = "reference_id") -> DataFrame:
    """Live references left after ``n`` releases per object that name no reference.

    Each such release takes the greatest remaining reference id. ``releases``: (sha, n).
    """
    from postsignal.operators.ordered import with_position

    total = live.groupBy(sha).agg(F.count(F.lit(1)).alias("_total"))  # combined on the map side
    placed = with_position(live, [sha], [reference], "_at")
    bound = total.join(releases, sha, "left").select(
        sha, (F.col("_total") - F.coalesce("n", F.lit(0))).alias("_keep")
    )
    # written, so that the references of an object with very many can be split in the join
    return placed.join(materialize(bound), sha).filter("_at < _keep").select(sha, reference)


def remote_snapshots(log: DataFrame) -> DataFrame:
    """First report per (trimmed URL, reason, observation time)."""
    from postsignal.operators.dedup import first_per_key

    keyed = log.withColumn("snapshot_id", snapshot_id(F.col("source_url"), F.col("reason"), F.col("observed_at")))
    first = first_per_key(keyed, ["snapshot_id"], ["seq"])
    return first.withColumn("availability", F.lit("remote_unavailable"))


def latest_remote_snapshots(log: DataFrame) -> DataFrame:
    """Last report per trimmed URL."""
    from postsignal.functions.text import strip
    from postsignal.operators.dedup import last_per_key

    keyed = log.withColumn("url_key", F.sha2(strip(F.col("source_url")), 256))
    return last_per_key(keyed, ["url_key"], ["seq"]).withColumn("availability", F.lit("remote_unavailable"))


def with_default_weights(weights: DataFrame, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Existing weights plus a default row for every default key that has none."""
    items = dict(defaults if defaults is not None else lx.DEFAULT_WEIGHTS)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in items.items()]))
    seeds = weights.sparkSession.range(1).select(rows.alias("_r")).select("_r.*")
    missing = seeds.join(weights.select("key"), "key", "left_anti")
    return weights.select("key", "value").unionByName(missing)


def after_cursor(rows: DataFrame, column: str, high_water_mark: object) -> DataFrame:
    """Rows past the mark; the comparison reaches the scan as a pushed filter."""
    return rows if high_water_mark is None else rows.filter(F.col(column) > F.lit(high_water_mark))


def cursor_state(log: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Last advance of every named cursor."""
    values = [c for c in log.columns if c not in ("name", *order)]
    last = F.max_by(F.struct(*values), F.struct(*[F.col(c) for c in order]))
    return log.groupBy("name").agg(last.alias("_v")).select("name", "_v.*")


def next_cursor(rows: DataFrame, name: str, column: str) -> DataFrame:
    """Cursor row after reading all given rows."""
    return rows.agg(F.max(column).alias("high_water_mark"), F.count(F.lit(1)).alias("rows_read")).withColumn(
        "name", F.lit(name)
    )


def valid_entries(
    log: DataFrame, now: int, version: str | Column, order: Sequence[str] = ("written_at",),
    key: Sequence[str] = ("namespace", "cache_key", "version"), invalidations: DataFrame | None = None,
) -> DataFrame:
    """Derived values still usable at ``now``: right version, not expired, not invalidated.

    ``log`` holds every write (key columns, value, written_at, expires_at); the last write per key
    counts. ``invalidations`` holds (namespace, version or null for all, invalidated_at) and
    hits writes made before it.
    """
    values = [c for c in log.columns if c not in key]
    last = F.max_by(F.struct(*values), F.struct(*[F.col(c) for c in order]))
    current = log.groupBy(*key).agg(last.alias("_v")).select(*key, "_v.*")
    current = current.filter(
        (F.col("version") == version) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )
    if invalidations is None:
        return current
    everything = invalidations.filter("version is null").groupBy("namespace").agg(F.max("invalidated_at").alias("_all"))
    single = invalidations.filter("version is not null").groupBy("namespace", "version").agg(
        F.max("invalidated_at").alias("_one")
    )
    marked = current.join(everything, "namespace", "left").join(single, ["namespace", "version"], "left")
    cut = F.greatest(F.coalesce("_all", F.lit(-1)), F.coalesce("_one", F.lit(-1)))
    return marked.filter(F.col("written_at") > cut).drop("_all", "_one")
