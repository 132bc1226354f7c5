"""Capture parsing, validation, deduplication and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal.catalog import base as b
from postsignal.functions import ids as I
from postsignal.operators import capture as CP
from postsignal.operators import dedup as DD
from postsignal.operators import keywords as K
from postsignal.operators import lookups as J
from postsignal.operators import reports as R
from postsignal.policies import CapturePolicy
from postsignal.runtime import materialize
from postsignal.sources import adapters as A
from postsignal.sources import captures as SC
from postsignal.sources import files as FI
from postsignal.sources import sinks as SK
from postsignal.streaming import capture as ST


def _captures(spark, sf):
    return CP.parse_payloads(A.payloads(spark, sf)).drop("payload")


def _posts(spark, sf):
    return CP.to_posts(_captures(spark, sf))


def _validated(spark, sf):
    return CP.validate(_posts(spark, sf))


def parsed_captures(spark, sf):
    q = F.col("parse_quality")
    return _captures(spark, sf).select(
        "post_id", "platform_post_id", "url", "author_handle", F.sha2("text", 256).alias("text_sha"), "timestamp",
        "quoted_text", "quoted_author", F.array_join(F.col("media")["source_url"], ",").alias("media_urls"),
        F.array_join(F.col("media")["media_scope"], ",").alias("media_scopes"),
        q["has_url"].alias("has_url"), q["has_author"].alias("has_author"), q["has_text"].alias("has_text"),
        q["has_quote"].alias("has_quote"), q["media_count"].cast("long").alias("media_count"), "selector_version",
    )


def capture_flags(spark, sf):
    """Flags that a client sends stay beside the computed ones."""
    d = F.col("doc_id")
    sent = F.create_map(
        F.lit("dom"), F.col("lang"), F.lit("retries"), (d % 3).cast("string"), F.lit("has_url"), F.lit("client says so"),
        F.lit("selector_version"), F.concat(F.lit("s"), (d % 2).cast("string")),
    )
    payload = F.struct("text", F.when(d % 4 > 0, F.concat(F.lit("https://x.com/a/"), d)).alias("url"), F.when(d % 5 > 0, sent).alias("parse_quality"))
    parsed = CP.parse_payloads(A.table(spark, sf, "documents").select(d, F.to_json(payload).alias("payload")))
    flags = F.array_sort(F.transform(F.map_entries("parse_flags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return parsed.select("doc_id", F.array_join(flags, " ").alias("flags"))


def content_digests(spark, sf):
    return FI.content_digests(A.table(spark, sf, "pages"), "page_id", "html")


def extended_posts(spark, sf):
    """Conversation turns as search records that quote the turn before."""
    turns = A.quoted_turns(spark, sf)
    n = F.col("turn")
    picture = lambda i, kind: F.struct(F.concat(F.lit("https://m/"), i.cast("string"), F.lit(kind)).alias("url"))
    user = lambda name: F.struct(name.alias("username"), F.when(n % 3 > 0, n * 10).alias("followers_count"))
    quoted = F.struct((n - 1).alias("id"), F.col("quoted_text").alias("content"), user(F.lit("before")).alias("user"), F.when(n % 2 == 0, F.array(picture(n, "q"))).alias("media"))
    records = turns.select(
        (F.col("conv_id") * 1000 + n).alias("id"), F.concat(F.lit("https://x.com/"), F.col("conv_id").cast("string")).alias("url"), F.col("conv_id").alias("date"), F.col("text").alias("content"),
        user(F.col("role")).alias("user"), F.when(n % 4 > 0, F.array(picture(n, "a"), F.struct(F.lit(None).cast("string").alias("url")), picture(n, "b"))).alias("media"),
        F.when(F.col("quoted_text") != "", quoted).alias("quoted"),
    )
    found = K.extended_posts(records)
    return found.select(
        "id", "url", "user", F.col("followers_count").cast("long").alias("followers_count"), F.array_join("media_urls", " ").alias("media_urls"), "quoted_url",
        F.sha2("quoted_content", 256).alias("quoted_sha"), F.array_join("quoted_media_urls", " ").alias("quoted_media_urls"),
    )


def domain_posts(spark, sf):
    m, q = F.col("visible_metrics"), F.col("quote_post")
    return _posts(spark, sf).select(
        "post_id", "platform_post_id", "canonical_url", "author_handle", "platform_created_at",
        m["likes"].alias("likes"), m["reposts"].alias("reposts"), m["replies"].alias("replies"), m["views"].alias("views"),
        q["author_handle"].alias("quote_author"), q["visible_text"].alias("quote_text"),
        F.array_join(F.col("media")["kind"], ",").alias("kinds"), "idempotency_key",
    )


def capture_errors(spark, sf):
    return _validated(spark, sf).select("post_id", F.array_join("errors", ",").alias("errors"))


def payload_gate(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("payload"))
    return docs.select(
        "doc_id", CP.payload_bytes(F.col("payload")).cast("long").alias("bytes"),
        CP.payload_too_large(F.col("payload"), CapturePolicy(max_payload_bytes=4096)).alias("too_large"),
    )


def redacted_map(spark, sf):
    e = A.table(spark, sf, "events").select(
        "event_id",
        F.create_map(
            F.lit("Session-Cookie"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"),
            F.lit("X-CSRF"), F.col("user_id").cast("string"), F.lit("user"), F.col("user_id").cast("string"),
        ).alias("m"),
    )
    clean = e.select("event_id", CP.redact_map(F.col("m")).alias("m"))
    return clean.select(
        "event_id", F.col("m")["Session-Cookie"].alias("cookie"), F.col("m")["k"].alias("k"),
        F.col("m")["X-CSRF"].alias("csrf"), F.col("m")["user"].alias("user"),
    )


def redacted_json(spark, sf):
    clean = A.payloads(spark, sf).select("post_id", CP.redact_json(F.col("payload")).alias("j"))
    return clean.select(
        "post_id", F.get_json_object("j", "$.authorization").alias("auth"),
        F.get_json_object("j", "$.nested.csrf_token").alias("csrf"), F.get_json_object("j", "$.nested.lang").alias("lang"),
        F.get_json_object("j", "$.media[0].url").alias("first_media"),
    )


def capture_ids(spark, sf):
    c = F.col
    first = F.try_element_at("media", F.lit(1))["source_url"]
    return _captures(spark, sf).select(
        "post_id",
        I.stable_id(c("url"), c("author_handle"), F.lit(None).cast("string"), c("timestamp")).alias("stable_id"),
        I.content_key(c("url"), c("author_handle"), c("text"), c("quoted_text")).alias("content_key"),
        F.sha2(I.outbox_key(c("url"), c("author_handle"), c("text"), first), 256).alias("outbox_sha"),
    )


def feature_rows(spark, sf):
    return CP.normalized_feature(CP.accepted(_validated(spark, sf))).select(
        "feature_id", "owner_id", "value_json", "source_ids_json", "created_at"
    )


def deduplicated_captures(spark, sf):
    return DD.first_captures(_posts(spark, sf)).select("post_id", "platform_post_id", "captured_at")


def captures_by_either_key(spark, sf):
    """Greedy first-wins where the idempotency key is the client's (author and likes)."""
    keyed = _posts(spark, sf).withColumn(
        "idempotency_key", F.concat_ws("|", "author_handle", F.col("visible_metrics.likes").cast("string"))
    )
    return DD.first_captures_by_either_key(materialize(keyed.select("platform", "platform_post_id", "idempotency_key", "captured_at", "post_id")))


def new_captures(spark, sf):
    """Captures not among the stored ones (those of labelled documents)."""
    posts = materialize(_posts(spark, sf).select("post_id", "platform", "platform_post_id", "idempotency_key"))
    labelled = A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    return DD.not_yet_stored(posts, posts.join(labelled, "post_id", "left_semi")).select("post_id", "platform_post_id")


def json_documents(spark, sf):
    """Payloads cut out of JSON documents with a list of posts each."""
    docs = A.table(spark, sf, "documents")
    posts = F.array(
        F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("text"), F.col("source").alias("author_handle")),
        F.struct(F.concat(F.lit("b"), "doc_id").alias("id"), F.col("lang").alias("text"), F.col("source").alias("author_handle")),
    )
    whole = docs.select("doc_id", F.to_json(F.struct(posts.alias("posts"))).alias("value"))
    parsed = CP.parse_payloads(SC.payload_items(whole, "value", "doc_id"))
    return parsed.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "platform_post_id", "author_handle", F.sha2("text", 256).alias("text_sha")
    )


def archived_posts(spark, sf):
    """Captures read as an archive: manual source, validated, first wins."""
    posts = CP.validate(CP.to_posts(_captures(spark, sf), "manual_json"))
    kept = DD.first_captures(CP.accepted(posts))
    return kept.select("post_id", "capture_source", "canonical_url", "idempotency_key")


def _stored(spark, sf):
    # read four times: computed once
    posts = CP.validate(CP.to_posts(CP.parse_payloads(A.payloads(spark, sf))))
    return SK.capture_tables(materialize(DD.first_captures(CP.accepted(posts))))


def stored_media(spark, sf):
    return _stored(spark, sf)["media_assets"].select(
        "asset_id", "post_id", F.col("position").cast("long").alias("position"), "kind", "source_url", "alt_text", "availability"
    )


def stored_audit(spark, sf):
    return _stored(spark, sf)["audit_log"].select("audit_id", "action", "entity_type", "entity_id", "details_json")


def stored_inbox(spark, sf):
    return _stored(spark, sf)["capture_inbox"].select("inbox_id", "post_id", "raw_payload_hash", "status", "correlation_id")


def stored_payloads(spark, sf):
    """What is kept of the payloads of stored captures."""
    rows = _stored(spark, sf)["captured_posts"]
    return rows.select("post_id", *_kept_secrets(F.col("raw_payload")))


def quarantined_payloads(spark, sf):
    """What is kept of the payloads of rejected captures."""
    posts = CP.validate(CP.to_posts(CP.parse_payloads(A.payloads(spark, sf))))
    rows = ST.quarantined(CP.rejected(posts))
    return rows.select(F.array_join("errors", ",").alias("errors"), *_kept_secrets(F.col("payload")))


def _kept_secrets(raw):
    return [
        F.get_json_object(raw, "$.authorization").alias("auth"), F.get_json_object(raw, "$.nested.csrf_token").alias("csrf"),
        F.get_json_object(raw, "$.nested.lang").alias("lang"), F.contains(raw, F.lit("Bearer")).alias("leaks"),
    ]


def stored_tables(spark, sf):
    """Rows per table a capture batch is stored as."""
    out = None
    for name, rows in _stored(spark, sf).items():
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rows.columns[0] if name == "capture_inbox" else ("entity_id" if name == "audit_log" else "post_id")).alias("ids"))
        part = part.select(F.lit(name).alias("table_name"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


def capture_quality(spark, sf):
    v = materialize(
        _validated(spark, sf).select("post_id", "author_handle", "platform", "platform_post_id", "idempotency_key", "captured_at", "errors")
    )
    kept = DD.first_captures(CP.accepted(v)).select("post_id")
    return R.capture_quality(v, kept)


def parse_quality(spark, sf):
    return R.parse_quality_summary(_captures(spark, sf))


def orphan_events(spark, sf):
    return J.orphans(
        A.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), A.table(spark, sf, "events"), "o_custkey", "user_id"
    )


QUERIES = {
    "parsed_captures": parsed_captures,
    "capture_flags": capture_flags,
    "content_digests": content_digests,
    "extended_posts": extended_posts,
    "domain_posts": domain_posts,
    "capture_errors": capture_errors,
    "payload_gate": payload_gate,
    "redacted_map": redacted_map,
    "redacted_json": redacted_json,
    "capture_ids": capture_ids,
    "feature_rows": feature_rows,
    "deduplicated_captures": deduplicated_captures,
    "captures_by_either_key": captures_by_either_key,
    "new_captures": new_captures,
    "json_documents": json_documents,
    "archived_posts": archived_posts,
    "stored_media": stored_media,
    "stored_audit": stored_audit,
    "stored_inbox": stored_inbox,
    "stored_payloads": stored_payloads,
    "quarantined_payloads": quarantined_payloads,
    "stored_tables": stored_tables,
    "capture_quality": capture_quality,
    "parse_quality": parse_quality,
    "orphan_events": orphan_events,
}

_CAP = f"""
  raw as (select doc_id, doc_id::varchar as post_id, {b.sql_strip('text')} as text, lang, n_chars,
    (case when doc_id % 17 = 0 then 'https://example.com/' when doc_id % 3 = 0 then 'https://twitter.com/' else 'https://x.com/' end) || source || '/status/' || doc_id as url,
    case when doc_id % 13 = 0 then 'unknown' else upper(source[1]) || source[2:] end as author_handle,
    '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || case when doc_id % 7 = 0 then 'T99' else 'T09:30:00Z' end as timestamp,
    case when doc_id % 3 = 0 then 'quoting ' || source else '' end as quoted_text,
    case when doc_id % 4 <> 3 then 'https://img.example/' || doc_id || '/p.jpg' else '' end as media_url,
    to_timestamp(1704067200 + doc_id)::timestamp as captured_at from documents),
  cap as (select *, case when doc_id % 5 <> 0 then (doc_id // 2)::varchar else substr(sha256(url || '|' || author_handle || '|' || text), 1, 16) end as platform_post_id from raw),
  body as (select *, case when media_url = '' then '[]' else '[{{"alt_text":' || to_json('shown in ' || lang) || ',"kind":"' || case when doc_id % 4 = 0 then 'unknown' else 'image' end || '","local_path":null,"source_url":' || to_json(media_url) || '}}]' end as media_json,
    case when quoted_text = '' then 'null' else '{{"author_handle":"quoted","canonical_url":null,"platform_post_id":null,"visible_text":' || to_json(quoted_text) || '}}' end as quote_json from cap),
  dom as (select *, lower(author_handle) as author, sha256('{{"author_handle":' || to_json(lower(author_handle)) || ',"canonical_url":' || to_json(url) || ',"media":' || media_json
    || ',"platform":"x","platform_post_id":' || to_json(platform_post_id) || ',"quote_post":' || quote_json
    || ',"visible_metrics":{{"likes":' || n_chars || ',"replies":null,"reposts":null,"views":' || ((doc_id % 9) * 10 + 2) || '}},"visible_text":' || to_json(text) || '}}') as idempotency_key from body),
  val as (select *, list_filter([case when doc_id % 17 = 0 then 'url_not_accepted' end, case when length(text) > 20000 then 'text_too_long' end,
    case when text = '' and quoted_text = '' and media_url = '' then 'nothing_captured' end], lambda x: x is not null) as errors from dom),
  kept as (select * from val where len(errors) = 0 qualify row_number() over (partition by platform_post_id order by captured_at, post_id) = 1)"""
_CAP = _CAP.replace("{{", "{").replace("}}", "}")

SQL = {
    "capture_flags": f"""with f as (select doc_id, ['has_author=false', 'has_quote=false', 'has_text=' || ({b.sql_strip('text')} <> '')::varchar, 'has_url=' || (doc_id % 4 > 0)::varchar, 'media_count=0',
          'selector_version=' || case when doc_id % 5 > 0 then 's' || doc_id % 2 else '' end] as own, case when doc_id % 5 > 0 then ['dom=' || lang, 'retries=' || doc_id % 3] else [] end as sent from documents)
        select doc_id, array_to_string(list_sort(own || sent), ' ') as flags from f""",
    "content_digests": "select page_id, strlen(html)::bigint as byte_size, sha256(html) as exact_sha256 from pages",
    "extended_posts": """with t as (select *, coalesce(lag(coalesce(text, '')) over (partition by conv_id order by turn), '') as before from conversations)
        select conv_id * 1000 + turn as id, 'https://x.com/' || conv_id as url, role as user, (case when turn % 3 > 0 then turn * 10 else 0 end)::bigint as followers_count,
          case when turn % 4 > 0 then 'https://m/' || turn || 'a https://m/' || turn || 'b' else '' end as media_urls,
          case when before <> '' then 'https://twitter.com/before/status/' || (turn - 1) end as quoted_url, case when before <> '' then sha256(before) end as quoted_sha,
          case when before <> '' and turn % 2 = 0 then 'https://m/' || turn || 'q' else '' end as quoted_media_urls from t""",
    "parsed_captures": f"""with {_CAP} select post_id, platform_post_id, url, author_handle, sha256(text) as text_sha, timestamp, quoted_text, '@Quoted' as quoted_author,
        media_url as media_urls, case when media_url = '' then '' else 'post' end as media_scopes, url <> '' as has_url, author_handle <> 'unknown' as has_author, text <> '' as has_text,
        quoted_text <> '' as has_quote, (media_url <> '')::bigint as media_count, 'visible_dom_v1' as selector_version from cap""",
    "domain_posts": f"""with {_CAP} select post_id, platform_post_id, url as canonical_url, author as author_handle,
        case when doc_id % 7 = 0 then null else ('2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || ' 09:30:00')::timestamp end as platform_created_at,
        n_chars as likes, null::bigint as reposts, null::bigint as replies, ((doc_id % 9) * 10 + 2)::bigint as views,
        case when quoted_text <> '' then 'quoted' end as quote_author, nullif(quoted_text, '') as quote_text,
        case when media_url = '' then '' when doc_id % 4 = 0 then 'unknown' else 'image' end as kinds, idempotency_key from dom""",
    "capture_errors": f"with {_CAP} select post_id, array_to_string(errors, ',') as errors from val",
    "payload_gate": """with p as (select doc_id, strlen(to_json({'doc_id': doc_id, 'text': text})::varchar) as bytes from documents)
        select doc_id, bytes::bigint as bytes, bytes > 4096 as too_large from p""",
    "redacted_map": "select event_id, '[redacted]' as cookie, props->>'$.k' as k, '[redacted]' as csrf, user_id::varchar as user from events",
    "redacted_json": """select doc_id::varchar as post_id, '[redacted]' as auth, '[redacted]' as csrf, lang,
        case when doc_id % 4 <> 3 then 'https://img.example/' || doc_id || '/profile_images/a.jpg' end as first_media from documents""",
    "capture_ids": f"""with {_CAP} select post_id, substr(sha256(url || '|' || author_handle || '||' || timestamp), 1, 16) as stable_id,
        sha256(url || '|' || author_handle || '|' || text || '|' || quoted_text) as content_key,
        sha256(url || '::' || author_handle || '::' || text || '::' || media_url) as outbox_sha from cap""",
    "feature_rows": f"""with {_CAP} select substr(sha256('feature|' || post_id || '|normalized_capture|normalize-v1'), 1, 32) as feature_id, post_id as owner_id,
        '{{"author_handle":' || to_json(author) || ',"text_length":' || length(text) || '}}' as value_json, '["' || post_id || '"]' as source_ids_json, captured_at as created_at from val where len(errors) = 0""",
    "deduplicated_captures": f"""with {_CAP} select post_id, platform_post_id, captured_at from dom qualify row_number() over (partition by platform_post_id order by captured_at, post_id) = 1""",
    "captures_by_either_key": f"""with recursive {_CAP},
        o as (select row_number() over (order by captured_at, post_id) as i, 'x' as platform, platform_post_id, author || '|' || n_chars as idempotency_key, captured_at, post_id from dom),
        r as (select 0::bigint as i, []::varchar[] as ks, []::varchar[] as ps, false as ok union all
          select o.i, case when not (list_contains(r.ks, idempotency_key) or list_contains(r.ps, platform_post_id)) then list_append(r.ks, idempotency_key) else r.ks end,
            case when not (list_contains(r.ks, idempotency_key) or list_contains(r.ps, platform_post_id)) then list_append(r.ps, platform_post_id) else r.ps end,
            not (list_contains(r.ks, idempotency_key) or list_contains(r.ps, platform_post_id)) from r join o on o.i = r.i + 1)
        select platform, platform_post_id, idempotency_key, captured_at, post_id from o join r using (i) where ok""",
    "new_captures": f"""with {_CAP}, stored as (select * from dom join labels using (doc_id))
        select post_id, platform_post_id from dom where idempotency_key not in (select idempotency_key from stored) and platform_post_id not in (select platform_post_id from stored)""",
    "json_documents": f"""select doc_id, 0::bigint as ordinal, doc_id::varchar as platform_post_id, source as author_handle, sha256({b.sql_strip('text')}) as text_sha from documents
        union all select doc_id, 1::bigint, 'b' || doc_id, source, sha256(lang) from documents""",
    "archived_posts": f"with {_CAP} select post_id, 'manual_json' as capture_source, url as canonical_url, idempotency_key from kept",
    "stored_media": f"""with {_CAP} select substr(sha256(post_id || '|0|' || media_url), 1, 32) as asset_id, post_id, 0::bigint as position,
        case when doc_id % 4 = 0 then 'unknown' else 'image' end as kind, media_url as source_url, 'shown in ' || lang as alt_text, 'remote' as availability from kept where media_url <> ''""",
    "stored_audit": f"""with {_CAP}, d as (select post_id, '{{"capture_source":"extension","raw_payload_hash":"' || idempotency_key || '","raw_payload_present":true}}' as details_json from kept)
        select substr(sha256('capture.accepted|' || post_id || '|' || details_json), 1, 32) as audit_id, 'capture.accepted' as action, 'captured_post' as entity_type, post_id as entity_id, details_json from d""",
    "stored_inbox": f"""with {_CAP} select substr(sha256('inbox|' || post_id), 1, 32) as inbox_id, post_id, idempotency_key as raw_payload_hash, 'accepted' as status,
        substr(sha256('correlation|' || idempotency_key), 1, 32) as correlation_id from kept""",
    "stored_payloads": f"with {_CAP} select post_id, '[redacted]' as auth, '[redacted]' as csrf, lang, contains(text, 'Bearer') as leaks from kept",
    "quarantined_payloads": f"""with {_CAP} select array_to_string(errors, ',') as errors, '[redacted]' as auth, '[redacted]' as csrf, lang, contains(text, 'Bearer') as leaks
        from val where len(errors) > 0""",
    "stored_tables": f"""with {_CAP}, c as (select count(*) as n, count(*) filter (media_url <> '') as m from kept)
        select unnest(['captured_posts', 'media_assets', 'capture_inbox', 'audit_log']) as table_name, unnest([n, m, n, n]) as n, unnest([n, m, n, n]) as ids from c""",
    "capture_quality": f"""with {_CAP}, o as (select author_handle, author, unnest(case when len(errors) > 0 then errors when post_id in (select post_id from kept) then ['accepted'] else ['duplicate'] end) as outcome from val)
        select coalesce(outcome, '(all)') as outcome, coalesce(author, '(all)') as author_handle, count(*) as captures, grouping(outcome, author)::int as level
        from o group by rollup (outcome, author)""",
    "parse_quality": f"""with {_CAP} select 'visible_dom_v1' as selector_version, count(*) as captures, count(*) as with_url, count(*) filter (author_handle <> 'unknown') as with_author,
        count(*) filter (text <> '') as with_text, count(*) filter (quoted_text <> '') as with_quote, (count(*) filter (media_url <> ''))::bigint as media_items from cap""",
    "orphan_events": "select o_orderkey, o_custkey from orders where o_custkey not in (select user_id from events)",
}
