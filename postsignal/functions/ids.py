"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def stable_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[_text(p) for p in parts]), 256), 1, length)


def content_key(url: Column, author: Column, text: Column, quoted_text: Column) -> Column:
    """Digest of what a reader sees of a post."""
    return F.sha2(F.concat_ws("|", *[_text(p) for p in (url, author, text, quoted_text)]), 256)


def outbox_key(url: Column, author: Column, text: Column, first_media_url: Column) -> Column:
    """Key under which a client would send the same visible post twice."""
    return F.concat_ws("::", *[_text(p) for p in (url, author, text, first_media_url)])


def snapshot_id(source_url: Column, reason: Column, observed_at: Column) -> Column:
    from postsignal.functions.text import strip

    return F.sha2(F.concat_ws("|", strip(_text(source_url)), _text(reason), _text(observed_at)), 256)


def hash_algorithm(value: Column) -> Column:
    """Algorithm prefix of ``alg:hex``; plain hex has the algorithm ``hex``."""
    return F.when(value.contains(":"), F.substring_index(value, ":", 1)).otherwise("hex")


def hash_bits(value: Column) -> Column:
    """64-bit payload of ``alg:hex`` as a signed long."""
    payload = F.regexp_replace(value, "^[^:]*:", "")
    unsigned = F.conv(F.when(payload == "", F.lit("0")).otherwise(payload), 16, -10)
    return unsigned.cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two ``alg:hex`` values; null when the algorithms differ."""
    return F.when(hash_algorithm(a) == hash_algorithm(b), hamming(hash_bits(a), hash_bits(b)))


def near_duplicate(a: Column, b: Column, threshold: int = 8) -> Column:
    return F.coalesce(hash_distance(a, b) <= threshold, F.lit(False))
