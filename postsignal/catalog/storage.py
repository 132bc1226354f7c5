"""Stored objects, upserts, references, cursors, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal.operators import dedup as DD
from postsignal.operators import retention as RT
from postsignal.operators import storage as ST
from postsignal.policies import RetentionPolicy
from postsignal.runtime import materialize
from postsignal.sources import adapters as A
from postsignal.sources.files import content_path


def content_objects(spark, sf):
    return DD.content_objects(A.media_objects(spark, sf))


def reference_counts(spark, sf):
    """Every (event type, user) reference: errors release it, anything else adds it."""
    log = _reference_log(spark, sf)
    return ST.reference_counts(log.select("sha").distinct(), ST.live_references(log))


def _reference_log(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select(
        F.get_json_object("props", "$.k").alias("sha"), F.col("user_id").cast("string").alias("reference_id"),
        F.when(F.col("event_type").isin("error", "click"), "release").otherwise("add").alias("action"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )


def live_references(spark, sf):
    return ST.live_references(_reference_log(spark, sf))


def unnamed_releases(spark, sf):
    """References left after as many unnamed releases per object as it has error events."""
    log = _reference_log(spark, sf)
    e = A.table(spark, sf, "events").filter("event_type = 'error'")
    releases = e.groupBy(F.get_json_object("props", "$.k").alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    return ST.release_unnamed(ST.live_references(log), releases)


def latest_features(spark, sf):
    e = A.table(spark, sf, "events")
    log = e.select(
        F.lit("user").alias("owner_type"), F.col("user_id").cast("string").alias("owner_id"),
        F.col("event_type").alias("feature_name"), F.lit("v1").alias("feature_version"),
        F.concat(F.lit("f"), "event_id").alias("feature_id"), F.col("ts").cast("timestamp").alias("created_at"),
        "value", "props", F.col("event_id").alias("seq"),
    )
    return ST.latest_features(log).drop("feature_version", "owner_type")


def merged_objects(spark, sf):
    e = A.table(spark, sf, "events")
    t = F.col("event_type")
    updates = e.select(
        F.get_json_object("props", "$.k").alias("sha"),
        F.when(t == "view", F.concat(F.lit("p/"), "event_id")).otherwise("").alias("relative_path"),
        F.when(t == "click", F.col("event_id") + 1).otherwise(0).cast("long").alias("byte_size"),
        F.when(t == "signup", F.concat(F.lit("h:"), "user_id")).alias("perceptual_hash"),
        F.when(t == "purchase", F.when(F.col("user_id") % 2 == 0, "thumbnail").otherwise("original")).otherwise("metadata").alias("storage_policy"),
        F.when(t == "view", "local").otherwise("metadata_only").alias("availability"),
        F.when(t == "error", F.concat(F.lit("https://u/"), "user_id")).alias("source_url"),
        F.when(t == "error", F.col("event_id")).alias("retention_expires_at"),
        F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"),
    )
    return ST.merged_objects(updates)


def remote_snapshots(spark, sf):
    return ST.remote_snapshots(_snapshot_log(spark, sf)).select("snapshot_id", "source_url", "reason", "observed_at", "seq", "availability")


def latest_remote_snapshots(spark, sf):
    return ST.latest_remote_snapshots(_snapshot_log(spark, sf)).select("url_key", "reason", "observed_at", "seq")


def _snapshot_log(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select(
        F.concat(F.when(F.col("event_id") % 2 == 0, " ").otherwise(""), F.lit("https://u/"), "user_id").alias("source_url"),
        F.col("event_type").alias("reason"), F.dayofmonth("ts").cast("long").alias("observed_at"), F.col("event_id").alias("seq"),
    )


def default_weights(spark, sf):
    weights = A.feedback(spark, sf).filter("action = 'approved'").groupBy(
        F.concat(F.lit("tone."), F.when(F.col("variant_label") == "reaction", "other").otherwise(F.col("variant_label"))).alias("key")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return ST.with_default_weights(weights)


def after_cursor(spark, sf):
    rows = ST.after_cursor(A.table(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00")
    return rows.select("o_orderkey", "o_custkey")


def next_cursor(spark, sf):
    return ST.next_cursor(A.table(spark, sf, "orders"), "orders", "o_orderkey")


def cursor_states(spark, sf):
    e = A.table(spark, sf, "events")
    log = e.select(F.col("event_type").alias("name"), F.col("user_id").alias("cursor_value"), F.col("value").alias("high_water_mark"), F.col("event_id").alias("seq"))
    return ST.cursor_state(log)


def valid_entries(spark, sf):
    e = A.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    log = e.select(
        F.col("event_type").alias("namespace"), F.col("user_id").alias("cache_key"), F.get_json_object("props", "$.k").alias("version"),
        "value", us.alias("written_at"), F.when(F.col("value") > 5, us + 86_400_000_000 * 10).alias("expires_at"),
    )
    dropped = e.filter("event_type = 'error'").groupBy(F.lit("view").alias("namespace"), F.get_json_object("props", "$.k").alias("version")).agg(
        F.min(us).alias("invalidated_at"))
    every = e.filter("event_type = 'signup'").groupBy(F.lit("click").alias("namespace")).agg(F.min(us).alias("invalidated_at")).withColumn("version", F.lit(None).cast("string"))
    return ST.valid_entries(log, 1_705_900_000_000_000, F.col("version"), invalidations=dropped.unionByName(every))


POLICY = RetentionPolicy(max_bytes=400_000, min_free_bytes=100_000)


def _retained(spark, sf):
    refs = A.media_objects(spark, sf)
    return refs.groupBy("sha").agg(
        F.max("byte_size").alias("byte_size"), F.count_if("referenced").alias("reference_count"),
        F.max("storage_policy").alias("storage_policy"), F.max("last_accessed").alias("last_accessed"), F.max("expires_at").alias("expires_at"),
    )


def retention_plan(spark, sf):
    return RT.retention_plan(_retained(spark, sf), 300, POLICY)


def retention_totals(spark, sf):
    objects = materialize(_retained(spark, sf))
    return RT.retention_totals(objects, RT.retention_plan(objects, 300, POLICY), POLICY)


def retained_objects(spark, sf):
    objects = materialize(_retained(spark, sf))
    return RT.retained_objects(objects, RT.retention_plan(objects, 300, POLICY), 300)


def content_paths(spark, sf):
    """Where the text of a document would be stored, named after its source and language."""
    docs = A.table(spark, sf, "documents")
    name = F.concat(F.lit("/in/"), "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("."), F.upper("lang"))).otherwise(""))
    return docs.select("doc_id", content_path(F.sha2("text", 256), name).alias("path"))


def expiry_times(spark, sf):
    """Documents stored at their id, some with a time to live, some with a negative one."""
    docs = A.table(spark, sf, "documents")
    ttl = F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") - 500)
    return docs.select("doc_id", RT.expiry(F.col("doc_id"), ttl).alias("expires_at"))


QUERIES = {
    "content_objects": content_objects,
    "reference_counts": reference_counts,
    "live_references": live_references,
    "unnamed_releases": unnamed_releases,
    "latest_features": latest_features,
    "merged_objects": merged_objects,
    "remote_snapshots": remote_snapshots,
    "latest_remote_snapshots": latest_remote_snapshots,
    "default_weights": default_weights,
    "after_cursor": after_cursor,
    "next_cursor": next_cursor,
    "cursor_states": cursor_states,
    "valid_entries": valid_entries,
    "retention_plan": retention_plan,
    "retention_totals": retention_totals,
    "retained_objects": retained_objects,
    "expiry_times": expiry_times,
    "content_paths": content_paths,
}

_LOG = """log as (select props->>'$.k' as sha, user_id::varchar as reference_id, case when event_type in ('error', 'click') then 'release' else 'add' end as action, ts as happened, event_id as seq from events),
  live as (select sha, reference_id from log qualify row_number() over (partition by sha, reference_id order by happened desc, seq desc) = 1 and action = 'add')"""
_OBJ = """obj as (select sha256(text) as sha, max(n_chars) as byte_size, count(*) filter (doc_id % 2 = 1) as reference_count,
    max(case when source = 'src0' then 'original' else 'thumbnail' end) as storage_policy, max(doc_id) as last_accessed, max(case when doc_id % 10 = 0 then doc_id end) as expires_at from documents group by 1),
  sized as (select *, coalesce(expires_at <= 300, false) as expired from obj where byte_size > 0),
  cand as (select *, coalesce(sum(byte_size) over (order by (not expired)::int, last_accessed, sha rows between unbounded preceding and 1 preceding), 0) as freed_before
    from sized where expired or (reference_count = 0 and storage_policy <> 'original')),
  plan as (select sha, byte_size, last_accessed, freed_before::bigint as freed_before, case when expired then 'retention_expired' else 'quota_unreferenced' end as reason
    from cand where expired or (select sum(byte_size) from sized) - freed_before > 300000)"""
_SNAP = """snap as (select case when event_id % 2 = 0 then ' ' else '' end || 'https://u/' || user_id as source_url, event_type as reason, day(ts)::bigint as observed_at, event_id as seq, 'https://u/' || user_id as url from events)"""

SQL = {
    "content_objects": "select sha256(text) as sha, max(n_chars) as byte_size, max(doc_id) as last_accessed, count(distinct doc_id) as reference_count from documents group by 1",
    "reference_counts": f"with {_LOG} select sha, (select count(*) from live l where l.sha = s.sha) as reference_count from (select distinct sha from log) s",
    "live_references": f"with {_LOG} select sha, reference_id from live",
    "unnamed_releases": f"""with {_LOG}, rel as (select props->>'$.k' as sha, count(*) as n from events where event_type = 'error' group by 1)
        select sha, reference_id from live left join rel using (sha) qualify row_number() over (partition by sha order by reference_id desc) > coalesce(n, 0)""",
    "latest_features": """select user_id::varchar as owner_id, event_type as feature_name, arg_min('f' || event_id, event_id) as feature_id, arg_min(ts, event_id) as created_at,
        arg_max(value, event_id) as value, arg_max(props, event_id) as props from events group by 1, 2""",
    "merged_objects": """with o as (select *, {'t': ts, 'e': event_id} as w, props->>'$.k' as sha from events)
        select sha, coalesce(arg_max('p/' || event_id, w) filter (event_type = 'view'), '') as relative_path,
          coalesce(arg_max(event_id + 1, w) filter (event_type = 'click'), 0)::bigint as byte_size,
          arg_max('h:' || user_id, w) filter (event_type = 'signup') as perceptual_hash,
          coalesce(arg_max(case when user_id % 2 = 0 then 'thumbnail' else 'original' end, w) filter (event_type = 'purchase'), 'metadata') as storage_policy,
          case when count(*) filter (event_type = 'view') > 0 then 'local' else 'metadata_only' end as availability,
          arg_max('https://u/' || user_id, w) filter (event_type = 'error') as source_url, arg_max(event_id, w) filter (event_type = 'error') as retention_expires_at,
          min(ts) as created_at, max(ts) as updated_at from o group by sha""",
    "remote_snapshots": f"""with {_SNAP} select sha256(url || '|' || reason || '|' || observed_at) as snapshot_id, source_url, reason, observed_at, seq, 'remote_unavailable' as availability
        from snap qualify row_number() over (partition by url, reason, observed_at order by seq) = 1""",
    "latest_remote_snapshots": f"with {_SNAP} select sha256(url) as url_key, reason, observed_at, seq from snap qualify row_number() over (partition by url order by seq desc) = 1",
    "default_weights": """with w as (select 'tone.' || case user_id % 4 when 0 then 'other' when 1 then 'dry_humor' when 2 then 'neutral_short' else 'quote_context' end as key, count(*)::double as value from events where event_type = 'signup' group by 1)
        select * from w union all select k, 1.0::double from (values ('tone.reaction'), ('tone.dry_humor'), ('tone.neutral_short'), ('tone.quote_context')) d(k) where k not in (select key from w)""",
    "after_cursor": "select o_orderkey, o_custkey from orders where o_orderdate > timestamp '1998-01-01'",
    "next_cursor": "select 'orders' as name, max(o_orderkey) as high_water_mark, count(*) as rows_read from orders",
    "cursor_states": "select event_type as name, arg_max(user_id, event_id) as cursor_value, arg_max(value, event_id) as high_water_mark from events group by 1",
    "valid_entries": """with log as (select event_type as namespace, user_id as cache_key, props->>'$.k' as version, value, epoch_us(ts) as written_at, case when value > 5 then epoch_us(ts) + 864000000000 end as expires_at from events),
        cur as (select * from log qualify row_number() over (partition by namespace, cache_key, version order by written_at desc) = 1),
        dropped as (select props->>'$.k' as version, min(epoch_us(ts)) as at from events where event_type = 'error' group by 1)
        select c.* from cur c left join dropped d on c.namespace = 'view' and c.version = d.version
        where (expires_at is null or expires_at > 1705900000000000) and (d.at is null or written_at > d.at)
          and (namespace <> 'click' or written_at > (select min(epoch_us(ts)) from events where event_type = 'signup'))""",
    "retention_plan": f"with {_OBJ} select * from plan",
    "retained_objects": f"""with {_OBJ} select o.sha, reference_count, storage_policy, o.last_accessed, expires_at, case when reason is null then o.byte_size else 0 end as byte_size,
        case when reason is null then 'available' else 'metadata_only' end as availability, reason as deleted_reason, case when reason is not null then 300::bigint end as deleted_at
        from obj o left join plan p using (sha) where reason is null or reference_count > 0""",
    "content_paths": """with d as (select doc_id, sha256(text) as h, case when doc_id % 3 > 0 then '.' || lang else '' end as suffix from documents)
        select doc_id, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || suffix as path from d""",
    "expiry_times": "select doc_id, doc_id + case when doc_id % 3 > 0 then greatest(n_chars - 500, 0) end as expires_at from documents",
    "retention_totals": f"""with {_OBJ}, t as (select sum(byte_size)::bigint as before, count(*) filter (storage_policy = 'original') as protected_files, count(*) as n from sized),
        f as (select coalesce(sum(byte_size), 0)::bigint as freed, count(*) as files, count(*) filter (reason = 'retention_expired') as expired from plan)
        select before as total_bytes_before, before - freed as total_bytes_after, freed as freed_bytes, files as deleted_files, expired as expired_files, files - expired as quota_files,
          protected_files, n as remaining_files, 300000::bigint as target_bytes from t, f""",
}
