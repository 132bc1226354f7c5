"""From raw capture payloads to validated posts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsignal import lexicons as lx
from postsignal import schemas
from postsignal.functions.ids import stable_id
from postsignal.functions.text import contains_any, first_filled, normalize_handle, strip, text_or_empty, without_nulls
from postsignal.operators.rows import keep_where
from postsignal.policies import CapturePolicy

REDACTED = "[redacted]"


def redact_url(col: Column) -> Column:
    """Drop query and fragment of absolute URLs; anything else is only trimmed."""
    value = strip(text_or_empty(col))
    absolute = value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return F.when(absolute, F.regexp_replace(value, r"(?s)[?#].*$", "")).otherwise(value)


def is_sensitive_key(key: Column) -> Column:
    return contains_any(F.translate(F.lower(key), "-", "_"), lx.SENSITIVE_KEY_PARTS)


def redact_map(col: Column) -> Column:
    """Replace the values of sensitive keys of a flat map."""
    return F.transform_values(
        col, lambda k, v: F.when(is_sensitive_key(k), F.lit(REDACTED)).otherwise(v)
    )


def _scrub(value: object) -> object:
    if isinstance(value, dict):
        return {
            k: REDACTED
            if any(p in k.lower().replace("-", "_") for p in lx.SENSITIVE_KEY_PARTS)
            else _scrub(v)
            for k, v in value.items()
        }
    return [_scrub(v) for v in value] if isinstance(value, list) else value


@F.udf(T.StringType(), useArrow=False)
def redact_json(payload: str | None) -> str | None:
    """Replace the values of sensitive keys at any depth of a JSON text (sorted, compact).

    Rows go to Python a hundred at a time, so a worker holds few payloads, however long or many they are.
    """
    if payload is None:
        return None
    try:
        clean = _scrub(json.loads(payload))
    except ValueError:
        return None
    return json.dumps(clean, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def redacted_payload(payload: Column) -> Column:
    """A payload without secrets: as it is if no sensitive word occurs, else redacted; null if no JSON.

    Only payloads that may hold a sensitive key are sent to Python.
    """
    marks = [m for part in lx.SENSITIVE_KEY_PARTS for m in {part, part.replace("_", "-")}]
    # keys may be written with escapes, which only a parser reads
    suspect = contains_any(F.lower(payload), marks) | F.contains(payload, F.lit("\\u"))
    parsed = F.try_parse_json(payload)
    return F.when(suspect, redact_json(F.when(suspect, payload))).when(parsed.isNotNull(), payload)


def correlation_id(payload: Column, digest: Column) -> Column:
    """The client's id of the request, or one derived from a digest of what it sent."""
    given = F.nullif(strip(text_or_empty(F.get_json_object(payload, "$.correlation_id"))), F.lit(""))
    return F.coalesce(given, stable_id(F.lit("correlation"), digest, length=32))


def payload_bytes(json_text: Column) -> Column:
    return F.octet_length(json_text)


def payload_too_large(json_text: Column, policy: CapturePolicy = CapturePolicy()) -> Column:
    return payload_bytes(json_text) > policy.max_payload_bytes


# ---------------------------------------------------------------- media items


def media_scope(item: Column) -> Column:
    chosen = first_filled(item["media_scope"], item["scope"], item["context"], item["role"])
    return F.lower(strip(F.coalesce(chosen, F.lit("post"))))


def _clean_item(item: Column) -> Column:
    return F.struct(
        strip(F.coalesce(first_filled(item["media_type"], item["type"]), F.lit("unknown"))).alias("media_type"),
        redact_url(first_filled(item["source_url"], item["url"])).alias("source_url"),
        strip(text_or_empty(first_filled(item["alt_text"], item["alt"]))).alias("alt_text"),
        strip(text_or_empty(item["local_path"])).alias("local_path"),
        media_scope(item).alias("media_scope"),
    )


def is_post_media(item: Column) -> Column:
    """False for avatars, badges and other page furniture (takes a cleaned item)."""
    hay = F.lower(F.concat_ws(" ", item["source_url"], item["alt_text"], item["media_scope"]))
    furniture = item["media_scope"].isin(*lx.UI_MEDIA_SCOPES) | contains_any(hay, lx.UI_MEDIA_MARKERS)
    return (item["source_url"] != "") & ~furniture


def clean_media(media: Column) -> Column:
    items = F.transform(media, _clean_item)
    kept = F.filter(items, is_post_media)
    return F.coalesce(kept, F.array().cast(T.ArrayType(schemas.CAPTURED_MEDIA)))


# ---------------------------------------------------------------- metrics


def metric_value(value: Column) -> Column:
    """Number of a visible metric given as a JSON value.

    Whole numbers are clamped at zero; of anything else the dots and commas are dropped and the
    first run of digits is read, so ``1.2K`` gives 12.
    """
    kind = F.schema_of_variant(value)
    text = value.try_cast("string") if hasattr(value, "try_cast") else value.cast("string")
    number = F.greatest(text.try_cast("long"), F.lit(0).cast("long"))
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(None).cast("long"))
        .when(kind == "BIGINT", number)
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("long"))
        .otherwise(metric_text(text))
    )


def metric_text(text: Column) -> Column:
    digits = F.regexp_extract(F.translate(text, ".,", ""), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def metric_label(label: Column) -> Column:
    low = F.lower(label)
    out = None
    for name, parts in lx.METRIC_LABELS:
        cond = contains_any(low, parts)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def visible_metrics(raw: Column) -> Column:
    """Struct of the four known metrics; of several labels for one metric the last counts."""
    entries = F.map_entries(raw)

    def pick(name: str) -> Column:
        same = F.filter(entries, lambda e: metric_label(e["key"]) == name)
        last = F.try_element_at(same, F.lit(-1))
        return metric_value(last["value"]).alias(name)

    return F.struct(*[pick(name) for name, _ in lx.METRIC_LABELS])


def parse_time(col: Column) -> Column:
    """ISO-8601 text to timestamp (UTC when no zone is given); anything else is null."""
    iso = col.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(col))


# ---------------------------------------------------------------- payload -> capture -> post


def parse_payloads(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """Capture record of every payload: alias chains, redacted URLs, own media, parse flags."""
    p = F.col("_p")
    parsed = raw.withColumn("_p", F.from_json(json_col, schemas.PAYLOAD))
    text = strip(text_or_empty(first_filled(p["text"], p["content"])))
    url = redact_url(first_filled(p["url"], p["post_url"]))
    author = F.ltrim(
        strip(F.coalesce(first_filled(p["author_handle"], p["handle"]), F.lit("unknown"))), F.lit("@")
    )
    metrics = F.when(F.size(p["visible_metrics"]) > 0, p["visible_metrics"]).otherwise(p["metrics"])
    staged = parsed.select(
        *[F.col(c) for c in raw.columns],
        "_p",
        url.alias("url"),
        author.alias("author_handle"),
        text.alias("text"),
        text_or_empty(first_filled(p["display_name"], p["name"])).alias("display_name"),
        text_or_empty(first_filled(p["timestamp"], p["post_time"])).alias("timestamp"),
        text_or_empty(p["quoted_text"]).alias("quoted_text"),
        text_or_empty(p["quoted_author"]).alias("quoted_author"),
        redact_url(p["quoted_url"]).alias("quoted_url"),
        metrics.alias("raw_metrics"),
        clean_media(p["media"]).alias("media"),
        strip(
            text_or_empty(
                first_filled(p["raw_capture_version"], p["parse_quality"]["selector_version"])
            )
        ).alias("selector_version"),
    )

    def given(name: str) -> Column:
        """An id as text; the number zero is no id, the text "0" is one."""
        value = F.try_variant_get(F.try_parse_json(json_col), f"$.{name}", "variant")
        zero = (F.col(f"_p.{name}") == "0") & (F.schema_of_variant(value) != "STRING")
        return F.when(~F.coalesce(zero, F.lit(False)), F.col(f"_p.{name}"))

    platform_id = F.coalesce(
        first_filled(given("platform_post_id"), given("id")),
        stable_id(F.col("url"), F.col("author_handle"), F.col("text")),
    )
    return (
        staged.withColumn("platform_post_id", platform_id)
        .withColumn("parse_quality", parse_quality())
        .withColumn("parse_flags", parse_flags(F.col("_p.parse_quality")))
        .drop("_p")
    )


def parse_flags(given: Column) -> Column:
    """The client's own flags beside the computed ones, as text; a computed flag wins over one of its name.

    ``given`` is a map of text; flags that the client sends as null are kept as null.
    """
    own = F.col("parse_quality")
    names = ("has_url", "has_author", "has_text", "has_quote", "media_count", "selector_version")
    computed = F.create_map(*[x for n in names for x in (F.lit(n), own[n].cast("string"))])
    rest = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names))
    return F.map_concat(rest, computed)


def parse_quality() -> Column:
    return F.struct(
        (F.col("url") != "").alias("has_url"),
        ((F.col("author_handle") != "") & (F.col("author_handle") != "unknown")).alias("has_author"),
        (F.col("text") != "").alias("has_text"),
        (F.col("quoted_text") != "").alias("has_quote"),
        F.size("media").alias("media_count"),
        F.col("selector_version").alias("selector_version"),
    )


def to_posts(captures: DataFrame, source: str = "extension", policy: CapturePolicy = CapturePolicy()) -> DataFrame:
    """Domain form of parsed captures, with the idempotency key."""
    passthrough = [c for c in captures.columns if c not in _CAPTURE_COLUMNS]
    has_quote = F.col("quoted_text") != ""
    quote = F.when(
        has_quote,
        F.struct(
            normalize_handle(F.col("quoted_author")).alias("author_handle"),
            F.nullif(F.col("quoted_url"), F.lit("")).alias("canonical_url"),
            F.lit(None).cast("string").alias("platform_post_id"),
            F.col("quoted_text").alias("visible_text"),
        ),
    )
    media = F.transform(
        F.slice("media", 1, policy.max_media),
        lambda m: F.struct(
            F.nullif(m["alt_text"], F.lit("")).alias("alt_text"),
            F.when(m["media_type"].isin(*lx.MEDIA_KINDS), m["media_type"]).otherwise("unknown").alias("kind"),
            F.nullif(m["local_path"], F.lit("")).alias("local_path"),
            F.nullif(m["source_url"], F.lit("")).alias("source_url"),
        ),
    )
    posts = captures.select(
        *passthrough,
        F.lit("x").alias("platform"),
        "platform_post_id",
        F.col("url").alias("canonical_url"),
        F.coalesce(normalize_handle(F.col("author_handle")), F.lit("")).alias("author_handle"),
        F.col("text").alias("visible_text"),
        quote.alias("quote_post"),
        media.alias("media"),
        visible_metrics(F.col("raw_metrics")).alias("visible_metrics"),
        parse_time(F.col("timestamp")).alias("platform_created_at"),
        F.lit(source).alias("capture_source"),
        F.coalesce(F.nullif(F.col("selector_version"), F.lit("")), F.lit("unknown")).alias("selector_version"),
    )
    return posts.withColumn("idempotency_key", idempotency_key())


_CAPTURE_COLUMNS = {
    "url", "author_handle", "text", "display_name", "timestamp", "quoted_text", "quoted_author",
    "quoted_url", "raw_metrics", "media", "selector_version", "platform_post_id", "parse_quality", "parse_flags",
}


def idempotency_key() -> Column:
    """Digest of the canonical JSON (sorted keys, nulls kept) of what identifies a capture.

    Media items take part without their random asset id, so a repeated capture keeps its key.
    """
    metrics = F.col("visible_metrics")
    body = F.struct(
        "author_handle",
        "canonical_url",
        "media",
        "platform",
        "platform_post_id",
        "quote_post",
        F.struct(
            *[metrics[n].alias(n) for n in ("likes", "replies", "reposts", "views")]
        ).alias("visible_metrics"),
        "visible_text",
    )
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def validation_errors(policy: CapturePolicy = CapturePolicy()) -> Column:
    """Codes of every rule a domain post breaks."""
    metrics, quote = F.col("visible_metrics"), F.col("quote_post")
    quote_text = text_or_empty(quote["visible_text"])
    bad_metric = F.lit(False)
    for name, _ in lx.METRIC_LABELS:
        bad_metric = bad_metric | F.coalesce(metrics[name] < 0, F.lit(False))
    url_ok = F.lit(False)
    for prefix in lx.ACCEPTED_URL_PREFIXES:
        url_ok = url_ok | F.col("canonical_url").startswith(prefix)
    long_alt = F.exists("media", lambda m: F.length(text_or_empty(m["alt_text"])) > policy.max_alt_chars)
    nothing = (
        (strip(F.col("visible_text")) == "") & (strip(quote_text) == "") & (F.size("media") == 0)
    )
    rules = {
        "author_required": F.col("author_handle") == "",
        "url_not_accepted": ~url_ok,
        "text_too_long": F.length("visible_text") > policy.max_text_chars,
        "quote_too_long": F.length(quote_text) > policy.max_text_chars,
        "alt_text_too_long": long_alt,
        "too_many_media": F.size("media") > policy.max_media,
        "negative_metric": bad_metric,
        "nothing_captured": nothing,
        "selector_version_required": (F.col("capture_source") == "extension")
        & (text_or_empty(F.col("selector_version")) == ""),
    }
    return without_nulls(*[F.when(cond, F.lit(code)) for code, cond in rules.items()])


def validate(posts: DataFrame, policy: CapturePolicy = CapturePolicy()) -> DataFrame:
    return posts.withColumn("errors", validation_errors(policy))


def accepted(validated: DataFrame) -> DataFrame:
    return keep_where(validated, F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return keep_where(validated, F.size("errors") > 0)


def normalized_feature(posts: DataFrame, created_at: str = "captured_at") -> DataFrame:
    """Feature row (text length, author) of every stored post, with provenance."""
    version = "normalize-v1"
    owner = F.col("post_id")
    return posts.select(
        stable_id(F.lit("feature"), owner, F.lit("normalized_capture"), F.lit(version), length=32).alias("feature_id"),
        F.lit("post").alias("owner_type"),
        owner.alias("owner_id"),
        F.lit("normalized_capture").alias("feature_name"),
        F.lit(version).alias("feature_version"),
        F.to_json(
            F.struct("author_handle", F.length(text_or_empty(F.col("visible_text"))).alias("text_length"))
        ).alias("value_json"),
        F.lit("rules-v1").alias("model_version"),
        F.lit(version).alias("config_hash"),
        F.to_json(F.array(owner)).alias("source_ids_json"),
        F.lit("derived_feature").alias("data_class"),
        F.col(created_at).alias("created_at"),
    )
