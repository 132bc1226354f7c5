"""Media functions: context, risk, evidence, planning, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal.catalog import base as b
from postsignal.functions import ids as I
from postsignal.functions import media as M
from postsignal.operators import lookups as J
from postsignal.operators.rows import exploded
from postsignal.policies import VideoAudioPolicy
from postsignal.sources import adapters as A

POLICY = VideoAudioPolicy(max_video_ms=9_000, max_audio_ms=6_000, max_frames=3)


def media_scores(spark, sf):
    p = A.posts(spark, sf)
    media = F.transform(
        "media",
        lambda m: m.withField("ocr_text", F.when(F.col("ordinal") % 7 == 0, "words").otherwise("")).withField(
            "copyright_status",
            F.when(F.col("ordinal") % 4 == 0, "Owned").when(F.col("ordinal") % 4 == 1, "risky").otherwise(""),
        ),
    )
    p = p.withColumn("media", media)
    first = F.try_element_at("media", F.lit(1))
    return p.select(
        "post_id", M.media_context_score(F.col("media")).alias("context"), M.max_media_risk(F.col("media")).alias("max_risk"),
        F.when(first.isNotNull(), M.media_risk_label(first["copyright_status"])).alias("first_label"),
    )


def _ocr(spark, sf):
    """Recognised text for some attachments, keyed by media id (the attachment's URL)."""
    items = exploded(A.posts(spark, sf), F.col("media"), "m", "ordinal", "author_handle")
    return items.filter("m.id = 'm1'").select(
        F.col("m.source_url").alias("media_id"), F.concat(F.lit("the "), "author_handle", F.lit(" eaux")).alias("ocr_text")
    )


def _evidence_posts(spark, sf):
    posts = A.posts(spark, sf)
    # attachments are keyed by URL here
    media = F.transform("media", lambda m: m.withField("id", F.lit("")))
    return posts.withColumn("media", media).withColumn("quoted_text", F.substring("text", 5, 40))


def ocr_lookup(spark, sf):
    posts = J.attach_ocr(_evidence_posts(spark, sf), _ocr(spark, sf))
    return posts.select("post_id", F.array_join(F.col("media")["ocr_text"], "|").alias("ocr_texts"))


def multimodal_evidence(spark, sf):
    posts = J.attach_ocr(_evidence_posts(spark, sf), _ocr(spark, sf))
    info = F.col("info")
    staged = posts.withColumn("info", M.media_texts(F.col("media")))
    staged = staged.withColumns(M.evidence(F.col("text"), F.col("quoted_text"), info, b.TOPICS))
    out = staged.withColumns(M.evidence_verdict(info))
    return out.select(
        "post_id", "language", F.array_join("topics", ",").alias("topics"), F.sha2("ev_context", 256).alias("context_sha"),
        F.col("text_evidence.confidence").alias("text_confidence"), F.col("quote_evidence.confidence").alias("quote_confidence"),
        F.col("visual_evidence.confidence").alias("visual_confidence"), F.col("audio_video_evidence.confidence").alias("av_confidence"),
        "relationship", "relationship_confidence", F.array_join("missing_modalities", ",").alias("missing"),
        F.col("visual_evidence.missing_reason").alias("visual_missing"), "media_missing_is_not_negative",
        F.array_join(info["ocr_statuses"], ",").alias("ocr_statuses"),
        F.col("text_evidence.signals.char_count").cast("long").alias("text_chars"),
        F.col("quote_evidence.signals.char_count").cast("long").alias("quote_chars"),
        F.col("visual_evidence.signals.alt_text_count").cast("long").alias("alt_texts"),
        F.col("visual_evidence.signals.ocr_text_count").cast("long").alias("ocr_texts"),
        F.col("relationship_evidence.present").alias("related"),
        F.array_join("relationship_evidence.signals.visual_terms", ",").alias("visual_terms"),
    )


def _clips(spark, sf):
    e = A.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "video").when(F.col("event_type") == "click", "gif").when(
        F.col("event_type") == "error", "audio").otherwise(F.col("event_type"))
    duration = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.floor(F.col("value") * 100) - 50)
    return e.select("event_id", kind.alias("kind"), duration.cast("long").alias("duration_ms"), (F.col("user_id") % 3 > 0).alias("has_audio"))


def frame_offsets(spark, sf):
    return _clips(spark, sf).select(
        "event_id", F.array_join(M.frame_offsets(F.col("duration_ms"), POLICY).cast("array<string>"), ",").alias("offsets")
    )


def video_audio_plans(spark, sf):
    c = _clips(spark, sf).withColumn("p", M.video_audio_plan(F.col("kind"), F.col("duration_ms"), F.col("has_audio"), POLICY))
    return c.select(
        "event_id", "p.kind", "p.accepted", "p.reason", "p.duration_ms", "p.max_duration_ms", "p.audio_action", "p.audio_sample_rate_hz",
        F.size("p.frame_offsets_ms").cast("long").alias("frames"),
    )


def frame_markers(spark, sf):
    path = F.concat(F.lit("/media/"), "kind", F.lit("/clip-"), "event_id", F.lit(".mp4"))
    markers = M.frame_markers(path, M.frame_offsets(F.col("duration_ms"), POLICY))
    return exploded(_clips(spark, sf), markers, "marker", "event_id")


def hash_distances(spark, sf):
    """Digest of each document against the one of its language name."""
    d = A.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("h64:"), F.substring(F.sha2("text", 256), 1, 16)).alias("a"),
        F.concat(F.when(F.col("lang") == "en", "h64:").otherwise("other:"), F.substring(F.sha2("lang", 256), 1, 16)).alias("b"),
    )
    return d.select(
        "doc_id", I.hash_algorithm(F.col("a")).alias("algorithm"), I.hash_distance(F.col("a"), F.col("b")).cast("long").alias("distance"),
        I.near_duplicate(F.col("a"), F.col("b"), 30).alias("near"),
    )


def described_media(spark, sf):
    rows = exploded(A.posts(spark, sf), M.describe_media(F.col("media")), "d", "post_id", position="i")
    return rows.select("post_id", F.col("i").cast("long").alias("i"), "d.type", "d.url", "d.description")


def media_keys(spark, sf):
    items = exploded(A.posts(spark, sf), F.col("media"), "m", "post_id", "ordinal", position="i")
    given = F.when(F.col("ordinal") % 2 == 0, F.col("m.id")).otherwise("")
    url = F.when(F.col("ordinal") % 5 > 0, F.col("m.source_url")).otherwise("")
    kind = F.when(F.col("ordinal") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("MediaKind."), F.upper("m.media_type")))
    return items.select(
        "post_id", F.col("i").cast("long").alias("i"), M.media_key(given, url, F.col("i")).alias("media_key"),
        M.media_kind(kind, F.col("m.media_type")).alias("kind"),
    )


QUERIES = {
    "media_scores": media_scores,
    "ocr_lookup": ocr_lookup,
    "multimodal_evidence": multimodal_evidence,
    "frame_offsets": frame_offsets,
    "video_audio_plans": video_audio_plans,
    "frame_markers": frame_markers,
    "hash_distances": hash_distances,
    "described_media": described_media,
    "media_keys": media_keys,
}

_CLIPS = """clips as (select event_id, case event_type when 'view' then 'video' when 'click' then 'gif' when 'error' then 'audio' else event_type end as kind,
    case when event_type <> 'signup' then floor(value * 100)::bigint - 50 end as raw_ms, user_id % 3 > 0 as has_audio from events),
  dur as (select *, case when raw_ms is not null then greatest(raw_ms, 0) end as d from clips),
  off as (select *, case when d is null or d <= 0 or d > 9000 then []::bigint[] when d < 1000 then [d // 2]
    else list_transform(range(1, least(3, greatest(1, d // 1000)) + 1), lambda i: round_even(d / (least(3, greatest(1, d // 1000)) + 1) * i, 0)::bigint) end as offsets from dur)"""
_HASHBITS = "('0x' || substr(sha256({0}), 1, 16))::ubigint"
_ITEMS = f"{b.SQL_POSTS}, items as (select p.*, unnest(range(n_media)) as i from posts p)"
_EV = f"""{b.SQL_POSTS},
  e0 as (select *, substr(text, 5, 40) as quote, case when n_media > 0 then 'the ' || author_handle || ' eaux' else '' end as ocr from posts),
  e1 as (select *, {b.sql_clean('text')} as t, {b.sql_clean('quote')} as q,
    {b.sql_clean("concat_ws(' ', nullif(repeat(alt || ' ', n_media), ''), nullif(ocr, ''))")} as v from e0),
  e2 as (select *, {b.sql_terms('lower(t)', sorted(b.TOPICS))} as tt, {b.sql_terms('lower(q)', sorted(b.TOPICS))} as qt,
    {b.sql_terms('lower(v)', sorted(b.TOPICS))} as vt,
    {b.sql_clean("concat_ws(' ', nullif(t, ''), nullif(q, ''), nullif(repeat(alt || ' ', n_media), ''), nullif(ocr, ''))")} as ctx,
    n_media > 0 as has_media, (n_media > 0 and doc_id % 5 = 0) as has_av from e1),
  e3 as (select *, (len(tt) > 0 or len(qt) > 0) as topical, len(vt) > 0 as visual from e2)"""

SQL = {
    "media_scores": f"""with {b.SQL_POSTS} select post_id,
        case when n_media = 0 then 0.0 else least(100.0, 30.0 + n_media * (case when alt <> '' then 20.0 else 0 end + case when doc_id % 7 = 0 then 15.0 else 0 end)) end::double as context,
        case when n_media = 0 then 0.0 when doc_id % 4 = 0 then 5.0 when doc_id % 4 = 1 then 80.0 else 55.0 end::double as max_risk,
        case when n_media = 0 then null when doc_id % 4 = 0 then 'media_permitted' when doc_id % 4 = 1 then 'media_marked_risky' else 'copyright_unknown_review_required' end as first_label from posts""",
    "ocr_lookup": f"""with {b.SQL_POSTS} select post_id, case n_media when 0 then '' when 1 then 'the ' || author_handle || ' eaux' else 'the ' || author_handle || ' eaux|' end as ocr_texts from posts""",
    "multimodal_evidence": f"""with {_EV} select post_id,
        case when regexp_matches(lower(ctx), '[çğıöşü]') or len(list_filter({b.sql_tokens('lower(ctx)')}, lambda x: x in ('maç', 'gol', 'takım', 'taraftar'))) > 0 then 'tr' else 'unknown' end as language,
        array_to_string(list_sort(list_distinct(tt || qt || vt)), ',') as topics, sha256(ctx) as context_sha,
        case when len(tt) > 0 then 0.85 when t <> '' then 0.45 else 0 end::double as text_confidence,
        case when len(qt) > 0 then 0.75 when q <> '' then 0.35 else 0 end::double as quote_confidence,
        case when visual then 0.80 when v <> '' then 0.45 when has_media then 0.20 else 0 end::double as visual_confidence,
        case when has_av then 0.40 else 0 end::double as av_confidence,
        case when topical and visual then 'supports' when visual then 'visual_supplies_context' when topical and has_media then 'media_unclear_not_penalized' when topical then 'text_only_context' else 'insufficient_topic_evidence' end as relationship,
        case when topical and visual then 0.75 when visual then 0.65 when topical and has_media then 0.45 when topical then 0.55 else 0.20 end::double as relationship_confidence,
        array_to_string(list_filter([case when t = '' then 'text' end, case when q = '' then 'quote' end, case when not has_media then 'visual' end, case when not has_av then 'audio_video' end], lambda x: x is not null), ',') as missing,
        case when not has_media then 'missing_media' end as visual_missing, not has_media as media_missing_is_not_negative,
        case n_media when 0 then '' when 1 then 'ocr_supplied' else 'ocr_supplied,' || case when alt <> '' then 'alt_text_fallback' else 'missing_visual_text' end end as ocr_statuses,
        length(t) as text_chars, length(q) as quote_chars, (case when alt <> '' then n_media else 0 end)::bigint as alt_texts, (case when n_media > 0 then 1 else 0 end)::bigint as ocr_texts,
        topical or visual as related, array_to_string(vt, ',') as visual_terms from e3""",
    "frame_offsets": f"with {_CLIPS} select event_id, array_to_string(offsets, ',') as offsets from off",
    "video_audio_plans": f"""with {_CLIPS}, g as (select *, kind in ('video', 'gif') as vis, kind = 'audio' as aud, case when kind = 'audio' then 6000 else 9000 end as lim from off),
        h as (select *, (vis or aud) and d is not null and d <= lim as ok from g)
        select event_id, case when vis or aud then kind else 'unknown' end as kind, ok as accepted,
          case when not (vis or aud) then 'unsupported_media_kind' when d is null then 'missing_duration' when d > lim and aud then 'audio_duration_limit_exceeded'
            when d > lim then 'video_duration_limit_exceeded' else 'accepted_' || kind end as reason, d as duration_ms, lim::bigint as max_duration_ms,
          case when not (vis or aud) then 'skip_unsupported_kind' when d is null then 'skip_missing_duration' when d > lim then 'skip_duration_limit'
            when aud or (kind = 'video' and has_audio and d <= 6000) then 'extract_limited_audio' else 'skip_no_audio' end as audio_action,
          case when ok and (aud or (kind = 'video' and has_audio and d <= 6000)) then 16000 end::bigint as audio_sample_rate_hz,
          case when ok and vis then len(offsets) else 0 end::bigint as frames from h""",
    "frame_markers": f"with {_CLIPS} select event_id, 'clip-' || event_id || '.mp4:frame@' || unnest(offsets) || 'ms' as marker from off",
    "hash_distances": f"""with h as (select doc_id, bit_count(xor({_HASHBITS.format('text')}, {_HASHBITS.format('lang')}))::bigint as dist, lang from documents)
        select doc_id, 'h64' as algorithm, case when lang = 'en' then dist end as distance, lang = 'en' and dist <= 30 as near from h""",
    "described_media": f"""with {_ITEMS} select post_id, i::bigint as i, case when doc_id % 5 = 0 then 'video' else 'image' end as type,
        'https://media.example/' || doc_id || '/' || (i + 1) as url, '' as description from items""",
    "media_keys": f"""with {_ITEMS} select post_id, i::bigint as i, case when doc_id % 2 = 0 then 'm' || (i + 1) when doc_id % 5 > 0 then 'https://media.example/' || doc_id || '/' || (i + 1) else 'media-' || i end as media_key,
        case when doc_id % 5 = 0 then 'video' else 'image' end as kind from items""",
}
