"""Media attachments: context, risk, evidence and video/audio planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions.text import (
    clean_text,
    combined_context,
    detect_language,
    strip,
    text_or_empty,
    topic_terms,
)
from postsignal.policies import VideoAudioPolicy


def _filled(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def media_context_score(media: Column) -> Column:
    """0 without media; else 30, +20 per alternative text, +15 per OCR text, at most 100."""
    raw = F.aggregate(
        media,
        F.lit(30.0),
        lambda acc, m: acc
        + F.when(_filled(m["alt_text"]), 20.0).otherwise(0.0)
        + F.when(_filled(m["ocr_text"]), 15.0).otherwise(0.0),
    )
    return F.when(F.coalesce(F.size(media), F.lit(0)) > 0, F.least(F.lit(100.0), raw)).otherwise(0.0)


def media_risk(status: Column) -> Column:
    s = F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")))
    return F.when(s.isin("owned", "permitted"), 5.0).when(s == "risky", 80.0).otherwise(55.0)


def media_risk_label(status: Column) -> Column:
    s = F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")))
    return (
        F.when(s.isin("owned", "permitted"), "media_permitted")
        .when(s == "risky", "media_marked_risky")
        .otherwise("copyright_unknown_review_required")
    )


def max_media_risk(media: Column) -> Column:
    """Highest media risk of a post; 0 without media. The copyright status defaults to unknown."""
    risks = F.transform(media, lambda m: media_risk(m["copyright_status"]))
    return F.coalesce(F.array_max(risks), F.lit(0.0))


def media_kind(kind: Column, media_type: Column) -> Column:
    """Last dotted part of the kind, lower-case; ``unknown`` when neither is given."""
    value = F.coalesce(kind, media_type)
    value = F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))
    return F.lower(F.element_at(F.split(value, r"\."), -1))


def media_key(media_id: Column, source_url: Column, index: Column) -> Column:
    """Id, else URL, else the position, of one attachment."""
    return F.coalesce(
        F.nullif(media_id, F.lit("")),
        F.nullif(source_url, F.lit("")),
        F.concat(F.lit("media-"), index.cast("string")),
    )


def describe_media(media: Column) -> Column:
    """Type and URL of each attachment, with the older defaults."""
    return F.transform(
        media,
        lambda m: F.struct(
            F.coalesce(m["media_type"], F.lit("unknown")).alias("type"),
            F.coalesce(m["source_url"], F.lit("")).alias("url"),
            F.lit("").alias("description"),
        ),
    )


# ---------------------------------------------------------------- multimodal evidence

_AV = ("video", "gif", "audio")


def media_texts(media: Column) -> Column:
    """Per-post media text summary.

    ``media`` items carry ``media_type``, ``alt_text`` and ``ocr_text`` (own text or text
    supplied by an OCR table, see ``operators.lookups.attach_ocr``).
    """
    alts = F.filter(F.transform(media, lambda m: strip(text_or_empty(m["alt_text"]))), lambda a: a != "")
    ocrs = F.filter(F.transform(media, lambda m: strip(text_or_empty(m["ocr_text"]))), lambda a: a != "")
    statuses = F.transform(
        media,
        lambda m: F.when(strip(text_or_empty(m["ocr_text"])) != "", F.lit("ocr_supplied"))
        .when(strip(text_or_empty(m["alt_text"])) != "", F.lit("alt_text_fallback"))
        .otherwise(F.lit("missing_visual_text")),
    )
    av = F.size(
        F.filter(media, lambda m: media_kind(F.lit(None).cast("string"), m["media_type"]).isin(*_AV))
    )
    return F.struct(
        alts.alias("alt_texts"), ocrs.alias("ocr_texts"), statuses.alias("ocr_statuses"),
        av.alias("audio_video_count"), F.size(media).alias("media_count"),
    )


def evidence(
    text: Column, quote: Column, info: Column, terms: Sequence[str] = tuple(lx.EVIDENCE_TERMS)
) -> dict[str, Column]:
    """First stage of the evidence columns: cleaned texts and matched terms.

    The second stage (``evidence_verdict``) reads these as plain columns, so every term search
    runs once per row.
    """
    visual = F.array_join(F.concat(info["alt_texts"], info["ocr_texts"]), " ")
    return {
        "ev_text": clean_text(text),
        "ev_quote": clean_text(quote),
        "ev_context": combined_context(
            clean_text(text), clean_text(quote), info["alt_texts"], info["ocr_texts"]
        ),
        "text_terms": topic_terms(text, terms),
        "quote_terms": topic_terms(quote, terms),
        "visual_terms": topic_terms(visual, terms),
    }


def evidence_verdict(info: Column) -> dict[str, Column]:
    """Second stage: presence, confidence, relationship and missing modalities."""
    has_text, has_quote = F.col("ev_text") != "", F.col("ev_quote") != ""
    has_media, has_av = info["media_count"] > 0, info["audio_video_count"] > 0
    hit_text, hit_quote, hit_visual = (
        F.size(c) > 0 for c in ("text_terms", "quote_terms", "visual_terms")
    )
    any_visual_text = (F.size(info["alt_texts"]) > 0) | (F.size(info["ocr_texts"]) > 0)
    topical = hit_text | hit_quote
    relationship = (
        F.when(topical & hit_visual, "supports")
        .when(~topical & hit_visual, "visual_supplies_context")
        .when(topical & has_media, "media_unclear_not_penalized")
        .when(topical, "text_only_context")
        .otherwise("insufficient_topic_evidence")
    )
    rel_conf = (
        F.when(topical & hit_visual, 0.75)
        .when(~topical & hit_visual, 0.65)
        .when(topical & has_media, 0.45)
        .when(topical, 0.55)
        .otherwise(0.20)
    )
    names = F.array(*[F.lit(n) for n in ("text", "quote", "visual", "audio_video")])
    present = F.array(
        F.when(has_text, F.lit("text")), F.when(has_quote, F.lit("quote")),
        F.when(has_media, F.lit("visual")), F.when(has_av, F.lit("audio_video")),
    )

    def modality(name, here, conf, why, *signals):
        return F.struct(
            F.lit(name).alias("name"), here.alias("present"), conf.alias("confidence"),
            F.when(~here, F.lit(why)).alias("missing_reason"), F.struct(*signals).alias("signals"),
        )

    def found(terms, text):
        return F.col(terms).alias("matched_terms"), F.length(text).alias("char_count")

    return {
        "language": detect_language(F.col("ev_context")),
        "topics": F.array_sort(
            F.array_distinct(F.concat("text_terms", "quote_terms", "visual_terms"))
        ),
        "text_evidence": modality(
            "text", has_text,
            F.when(hit_text, 0.85).when(has_text, 0.45).otherwise(0.0), "missing_text", *found("text_terms", "ev_text"),
        ),
        "quote_evidence": modality(
            "quote", has_quote,
            F.when(hit_quote, 0.75).when(has_quote, 0.35).otherwise(0.0), "missing_quote", *found("quote_terms", "ev_quote"),
        ),
        "visual_evidence": modality(
            "visual", has_media,
            F.when(hit_visual, 0.80).when(any_visual_text, 0.45).when(has_media, 0.20).otherwise(0.0),
            "missing_media",
            info["media_count"].alias("media_count"),
            F.size(info["alt_texts"]).alias("alt_text_count"),
            F.size(info["ocr_texts"]).alias("ocr_text_count"),
            info["ocr_statuses"].alias("ocr_statuses"),
            F.col("visual_terms").alias("matched_terms"),
        ),
        "audio_video_evidence": modality(
            "audio_video", has_av, F.when(has_av, 0.40).otherwise(0.0), "missing_audio_video",
            info["audio_video_count"].alias("audio_video_count"),
        ),
        "relationship_evidence": modality(
            "relationship", relationship != "insufficient_topic_evidence", rel_conf, "insufficient_topic_evidence",
            relationship.alias("relationship"), F.col("text_terms").alias("text_terms"),
            F.col("quote_terms").alias("quote_terms"), F.col("visual_terms").alias("visual_terms"),
        ),
        "relationship": relationship,
        "relationship_confidence": rel_conf,
        "missing_modalities": F.array_except(names, present),
        "media_missing_is_not_negative": ~has_media,
    }


# ---------------------------------------------------------------- video and audio planning


def bounded_duration(duration_ms: Column) -> Column:
    return F.when(duration_ms.isNotNull(), F.greatest(F.lit(0), duration_ms)).cast("long")


def frame_offsets(duration_ms: Column, policy: VideoAudioPolicy = VideoAudioPolicy()) -> Column:
    """Evenly spaced frame offsets inside the duration; empty when not to be sampled."""
    none = F.array().cast("array<bigint>")
    d = bounded_duration(duration_ms)
    if policy.max_frames <= 0:
        return F.when(F.lit(True), none)
    count = F.least(
        F.lit(policy.max_frames).cast("long"),
        F.greatest(F.lit(1).cast("long"), F.floor(d / F.lit(policy.min_frame_gap_ms))),
    )
    # rint rounds halves to even, like the planning rule it stands for
    spaced = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1).cast("long"), count),
            lambda i: F.rint(d / (count + 1) * i).cast("long"),
        )
    )
    return (
        F.when(d.isNull() | (d <= 0) | (d > policy.max_video_ms), none)
        .when(d < policy.min_frame_gap_ms, F.array(F.floor(d / 2).cast("long")))
        .otherwise(spaced)
    )


def video_audio_plan(
    kind: Column,
    duration_ms: Column,
    has_audio: Column | None = None,
    policy: VideoAudioPolicy = VideoAudioPolicy(),
) -> Column:
    """Accept/reject gate before any decoding, with reason and audio action."""
    has_audio = has_audio if has_audio is not None else F.lit(True)
    d = bounded_duration(duration_ms)
    is_audio, is_visual = kind == "audio", kind.isin("video", "gif")
    is_audio, is_visual = F.coalesce(is_audio, F.lit(False)), F.coalesce(is_visual, F.lit(False))
    limit = F.when(is_audio, policy.max_audio_ms).otherwise(policy.max_video_ms)
    too_long = F.coalesce(d > limit, F.lit(False))
    supported = is_audio | is_visual
    accepted = supported & d.isNotNull() & ~too_long
    audio_ok = accepted & F.when(is_audio, F.lit(True)).otherwise(
        (kind == "video") & has_audio & (d <= policy.max_audio_ms)
    )
    reason = (
        F.when(~supported, "unsupported_media_kind")
        .when(d.isNull(), "missing_duration")
        .when(too_long & is_audio, "audio_duration_limit_exceeded")
        .when(too_long, "video_duration_limit_exceeded")
        .otherwise(F.concat(F.lit("accepted_"), kind))
    )
    audio_action = (
        F.when(~supported, "skip_unsupported_kind")
        .when(d.isNull(), "skip_missing_duration")
        .when(too_long, "skip_duration_limit")
        .when(audio_ok, "extract_limited_audio")
        .otherwise("skip_no_audio")
    )
    offsets = F.when(accepted & is_visual, frame_offsets(duration_ms, policy)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.struct(
        F.when(supported, kind).otherwise("unknown").alias("kind"),
        accepted.alias("accepted"),
        reason.alias("reason"),
        d.alias("duration_ms"),
        limit.cast("long").alias("max_duration_ms"),
        offsets.alias("frame_offsets_ms"),
        audio_action.alias("audio_action"),
        F.when(audio_ok, F.lit(policy.sample_rate_hz)).cast("long").alias("audio_sample_rate_hz"),
        F.lit("video-audio-lifecycle-v1").alias("lifecycle_version"),
    )


def frame_markers(path: Column, offsets: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.transform(
        offsets, lambda o: F.concat(name, F.lit(":frame@"), o.cast("string"), F.lit("ms"))
    )
