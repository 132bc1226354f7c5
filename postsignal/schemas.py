"""Explicit schemas of the inputs and tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


RAW_MEDIA = _struct(
    media_type=S, type=S, source_url=S, url=S, alt_text=S, alt=S, local_path=S,
    media_scope=S, scope=S, context=S, role=S,
)

# Incoming capture payload: every alias is optional, metric values keep their JSON type.
PAYLOAD = _struct(
    text=S, content=S, url=S, post_url=S, author_handle=S, handle=S, platform_post_id=S, id=S,
    display_name=S, name=S, timestamp=S, post_time=S, quoted_text=S, quoted_author=S,
    quoted_url=S,
    visible_metrics=T.MapType(S, T.VariantType()),
    metrics=T.MapType(S, T.VariantType()),
    media=T.ArrayType(RAW_MEDIA),
    parse_quality=T.MapType(S, S),
    raw_capture_version=S,
)

CAPTURED_MEDIA = _struct(media_type=S, source_url=S, alt_text=S, local_path=S, media_scope=S)

QUOTE = _struct(platform_post_id=S, canonical_url=S, author_handle=S, visible_text=S)

VISIBLE_METRICS = _struct(likes=L, reposts=L, replies=L, views=L)

CAPTURED_POST = _struct(
    platform=S, platform_post_id=S, canonical_url=S, author_handle=S, visible_text=S,
    quote_post=QUOTE,
    media=T.ArrayType(_struct(kind=S, source_url=S, alt_text=S, local_path=S)),
    visible_metrics=VISIBLE_METRICS, platform_created_at=TS, captured_at=TS,
    capture_source=S, selector_version=S, idempotency_key=S, data_class=S,
)

MEDIA_ASSET = _struct(
    asset_id=S, post_id=S, kind=S, source_url=S, alt_text=S, local_path=S,
    storage_policy=S, availability=S,
)

FEATURE = _struct(
    feature_id=S, owner_type=S, owner_id=S, feature_name=S, feature_version=S, value_json=S,
    model_version=S, config_hash=S, source_ids_json=S, data_class=S, created_at=TS,
)

AUDIT = _struct(audit_id=S, action=S, entity_type=S, entity_id=S, details_json=S, created_at=TS)

SNAPSHOT = _struct(
    snapshot_id=S, source_url=S, reason=S, visible_text=S, alt_text=S, observed_at=L,
    availability=S,
)
