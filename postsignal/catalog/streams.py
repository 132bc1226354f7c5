"""Streaming jobs run to completion over the tables, and HTML extraction.

Each stream reads a table as a file source with ``availableNow`` and writes to a folder below the
shared checkpoint folder; the query returns what was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal.catalog import base as b
from postsignal.catalog import capture as CC
from postsignal.catalog import ranking as RK
from postsignal.catalog.scoring import _FEEDBACK
from postsignal.operators import learning as L
from postsignal.operators.capture import parse_payloads
from postsignal.runtime import scratch_folder
from postsignal.sources import adapters as A
from postsignal.sources import pages as PG
from postsignal.sources.sinks import latest_version
from postsignal.streaming import capture as SC
from postsignal.streaming import state as SS


def _run(writer, folder):
    writer.option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


def _append(df, folder):
    _run(df.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return df.sparkSession.read.parquet(f"{folder}/rows")


def _captured(spark, sf):
    folder = scratch_folder(spark, "captures")
    payloads = A.as_payloads(A.table_stream(spark, sf, "documents")).drop("post_id")
    SC.start_capture(payloads, folder, f"{folder}/_checkpoint").awaitTermination()
    return folder


def streamed_captures(spark, sf):
    posts = spark.read.parquet(f"{_captured(spark, sf)}/captured_posts")
    return posts.select("platform_post_id", "canonical_url", "idempotency_key")


def streamed_quarantine(spark, sf):
    rows = spark.read.parquet(f"{_captured(spark, sf)}/quarantine")
    return rows.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def streamed_repeats(spark, sf):
    """Every document delivered twice; each arrives once."""
    folder = scratch_folder(spark, "repeats")
    docs = A.table_stream(spark, sf, "documents")
    payloads = A.as_payloads(docs).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("post_id", "copy")
    once = parse_payloads(_append(SC.drop_repeats(payloads), folder))
    return once.select("captured_at", "url", "author_handle", F.sha2("text", 256).alias("text_sha"), "quoted_text", F.size("media").cast("long").alias("media"))


def streamed_weights(spark, sf):
    folder = scratch_folder(spark, "weights")
    rewarded = L.rewarded_feedback(A.as_feedback(A.table_stream(spark, sf, "events")))
    SS.start_weights(rewarded, folder, f"{folder}/_checkpoint").awaitTermination()
    return latest_version(spark, folder, "weights").select("key", F.round("value", 6).alias("value"), "steps")


def streamed_throttle(spark, sf):
    SS.use_rocksdb(spark)
    folder = scratch_folder(spark, "throttle")
    events = A.table_stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id"
    )
    return _append(SS.throttled(events, RK.THROTTLE), folder).select("event_id", "admitted")


def streamed_failures(spark, sf):
    folder = scratch_folder(spark, "failures")
    failures = A.as_jobs(A.table_stream(spark, sf, "orders")).select(
        "job_id", "attempt", F.when(F.col("resource_class") == "io", "timeout").when(F.col("priority") == 20, "fatal").otherwise("ValueError").alias("error_kind")
    )
    _run(failures.writeStream.foreachBatch(lambda df, batch: SS.store_failures(df, batch, folder)), folder)
    tables = [spark.read.parquet(f"{folder}/{name}").select("job_id", "error_code", "outcome") for name in ("retry", "dead")]
    return tables[0].unionByName(tables[1])


def page_facts(spark, sf):
    f = PG.page_facts(A.text_table(spark, sf, "pages"))
    return f.select("page_id", "url", "title", "lang", F.col("links").cast("long").alias("links"), F.col("paragraphs").cast("long").alias("paragraphs"))


def page_posts(spark, sf):
    posts = PG.page_posts(A.text_table(spark, sf, "pages"))
    return posts.select("page_id", "position", "url", "heading", F.sha2("text", 256).alias("text_sha"), "paragraphs", F.array_join("links", " ").alias("links"))


QUERIES = {
    "streamed_captures": streamed_captures,
    "streamed_quarantine": streamed_quarantine,
    "streamed_repeats": streamed_repeats,
    "streamed_weights": streamed_weights,
    "streamed_throttle": streamed_throttle,
    "streamed_failures": streamed_failures,
    "page_facts": page_facts,
    "page_posts": page_posts,
}

def _visible(html):
    out = rf"regexp_replace({html}, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)[^>]*>', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)<br[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in PG.ENTITIES:
        out = f"replace({out}, {b.lit(entity)}, {b.lit(char)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


SQL = {
    "streamed_captures": f"with {CC._CAP} select platform_post_id, url as canonical_url, idempotency_key from kept",
    "streamed_quarantine": f"with {CC._CAP} select array_to_string(errors, ',') as errors, count(*) as n from val where len(errors) > 0 group by 1",
    "streamed_repeats": f"""with {CC._CAP} select captured_at, url, author_handle, sha256(text) as text_sha, quoted_text,
        (media_url <> '')::bigint as media from cap""",
    "streamed_weights": f"with {_FEEDBACK} select key, round({RK._FOLD.format(start='1.0::double')}, 6) as value, count(*) as steps from rewarded group by key",
    "streamed_throttle": RK.SQL["throttled_events"],
    "streamed_failures": f"select job_id, error_code, outcome from ({RK.SQL['routed_failures']})",
    "page_facts": r"""select page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1) as lang,
        len(regexp_extract_all(html, '(?i)<a\s[^>]*href='))::bigint as links, len(regexp_extract_all(html, '(?i)<p[\s>]'))::bigint as paragraphs from pages""",
    "page_posts": rf"""with cut as (select row_number() over () as row, page_id, url, string_split(regexp_replace(html, '(?i)(<article[\s>]|</article)', chr(1) || '\1', 'g'), chr(1)) as pieces
          from pages where regexp_matches(html, '(?i)<article[\s>]')),
        piece as (select row, page_id, url, unnest(pieces) as piece, generate_subscripts(pieces, 1) as place from cut),
        sums as (select *, regexp_matches(piece, '(?i)^<article[\s>]') as opens, sum(case when regexp_matches(piece, '(?i)^<article[\s>]') then 1 when regexp_matches(piece, '(?i)^</article') then -1 else 0 end) over (partition by row order by place) as sum from piece),
        depths as (select *, (sum - least(0, min(sum) over (partition by row order by place)))::int as depth from sums),
        levels as (select *, unnest(range(1, depth + 1)) as level from depths where depth > 0),
        numbered as (select *, sum((opens and level = depth)::int) over (partition by row, level order by place) as number from levels),
        art as (select row, any_value(page_id) as page_id, any_value(url) as url, min(place) as begins, regexp_replace(string_agg(piece, '' order by place), '(?is)^<article(?:\s[^>]*)?>?', '') as art
          from numbered group by row, level, number),
        p as (select *, row_number() over (partition by row order by begins) - 1 as position, list_filter(list_transform(list_transform(regexp_split_to_array(art, '(?i)<p(?:\s[^>]*)?>')[2:],
          lambda x: regexp_extract(x, '(?is)^(.*?)(?:</p|$)', 1)), lambda x: {_visible('x')}), lambda x: x <> '') as t from art)
        select page_id, position, regexp_replace(trim(url), '(?s)[?#].*$', '') as url, {_visible(r"regexp_extract(art, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1', 1)")} as heading,
          sha256(array_to_string(t, chr(10))) as text_sha, len(t)::bigint as paragraphs,
          array_to_string(list_transform(regexp_extract_all(art, '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1),
            lambda h: case when h[1] in ('"', '''') then h[2:-2] else h end), ' ') as links from p""",
}
