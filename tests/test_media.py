import hashlib

import pytest
from pyspark.sql import functions as F

from postsignal.functions import media as M
from postsignal.operators import lookups as J
from postsignal.policies import VideoAudioPolicy
from postsignal.sources import files as FI

MEDIA = "array<struct<id string, media_type string, source_url string, alt_text string, ocr_text string, copyright_status string>>"


def item(alt="", ocr="", kind="image", id="", url="", status=""):
    return (id, kind, url, alt, ocr, status)


def evidence(spark, text, media, quote=""):
    df = spark.createDataFrame([(text, quote, media)], f"t string, q string, media {MEDIA}")
    staged = df.withColumn("info", M.media_texts(F.col("media")))
    staged = staged.withColumns(M.evidence(F.col("t"), F.col("q"), F.col("info")))
    return staged.withColumns(M.evidence_verdict(F.col("info"))).first()


def test_visual_context_for_ambiguous_text(spark):
    e = evidence(spark, "Şu ışığa bakın", [item("kale önünde forma değişimi")])
    assert e["language"] == "tr" and {"kale", "forma"} <= set(e["topics"])
    assert e["relationship"] == "visual_supplies_context"
    assert e["media_missing_is_not_negative"] is False
    assert e["visual_evidence"]["confidence"] == 0.8


def test_missing_media_is_not_negative(spark):
    e = evidence(spark, "Haftaya maç yok", [])
    assert e["topics"] == ["maç"] and e["relationship"] == "text_only_context"
    assert e["visual_evidence"]["missing_reason"] == "missing_media"
    assert e["missing_modalities"] == ["quote", "visual", "audio_video"]
    assert e["media_missing_is_not_negative"] is True


def test_ocr_table_and_video(spark):
    df = spark.createDataFrame([("p", [item(id="video-1", kind="video"), item("alt", id="x")]), ("q", [])], f"post_id string, media {MEDIA}")
    ocr = spark.createDataFrame([("video-1", "\tasist sonrası kart \n")], "media_id string, ocr_text string")
    got = {r["post_id"]: r["media"] for r in J.attach_ocr(df, ocr).collect()}
    assert [m["ocr_text"] for m in got["p"]] == ["asist sonrası kart", ""]
    assert got["q"] == []
    e = evidence(spark, "bkz.", [tuple(m) for m in got["p"]])
    assert {"asist", "kart"} <= set(e["topics"]) and e["audio_video_evidence"]["present"]
    assert e["info"]["ocr_statuses"] == ["ocr_supplied", "alt_text_fallback"]
    assert evidence(spark, "", [])["relationship"] == "insufficient_topic_evidence"
    assert evidence(spark, "gol", [item()])["relationship"] == "media_unclear_not_penalized"


def test_context_and_risk(spark):
    rows = [([],), ([item("a", "b"), item()],), ([item("a", "b")] * 3,), ([item(status="Owned"), item(status="RISKY")],)]
    df = spark.createDataFrame(rows, f"media {MEDIA}").select(
        M.media_context_score(F.col("media")).alias("c"), M.max_media_risk(F.col("media")).alias("r")
    )
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.0), (65.0, 55.0), (100.0, 55.0), (30.0, 80.0)]


def plan(spark, kind, ms, audio=True, policy=VideoAudioPolicy()):
    df = spark.createDataFrame([(kind, ms, audio)], "k string, d long, a boolean")
    return df.select(M.video_audio_plan(F.col("k"), F.col("d"), F.col("a"), policy).alias("p")).first()["p"]


def test_video_and_audio_plans(spark):
    p = plan(spark, "video", 12_000, True, VideoAudioPolicy(30_000, 20_000, 3, 1_000, 16_000))
    assert (p["accepted"], p["reason"], p["frame_offsets_ms"], p["audio_action"], p["audio_sample_rate_hz"]) == (
        True, "accepted_video", [3000, 6000, 9000], "extract_limited_audio", 16_000
    )
    assert plan(spark, "video", 5_001, True, VideoAudioPolicy(max_video_ms=5_000))["reason"] == "video_duration_limit_exceeded"
    assert plan(spark, "video", None)["reason"] == "missing_duration"
    g = plan(spark, "gif", 4_000, True, VideoAudioPolicy(max_frames=2))
    assert (g["reason"], g["frame_offsets_ms"], g["audio_action"], g["audio_sample_rate_hz"]) == ("accepted_gif", [1333, 2667], "skip_no_audio", None)
    a = VideoAudioPolicy(max_audio_ms=10_000)
    assert plan(spark, "audio", 9_000, True, a)["audio_action"] == "extract_limited_audio"
    assert plan(spark, "audio", 10_001, True, a)["reason"] == "audio_duration_limit_exceeded"
    assert plan(spark, "slides", 1)["kind"] == "unknown"
    assert plan(spark, None, 1)["reason"] == "unsupported_media_kind"


@pytest.mark.parametrize("ms, want", [(500, [250]), (0, []), (-3, []), (None, []), (90_001, []), (1_000, [500]), (2_001, [667, 1334])])
def test_frame_offsets(spark, ms, want):
    df = spark.createDataFrame([(ms,)], "d long")
    assert df.select(M.frame_offsets(F.col("d")).alias("o")).first()["o"] == want


def test_frame_markers(spark):
    df = spark.createDataFrame([("/x/clip.mp4", 9_000)], "p string, d long")
    got = df.select(M.frame_markers(F.col("p"), M.frame_offsets(F.col("d"))).alias("m")).first()["m"]
    assert got == ["clip.mp4:frame@2250ms", "clip.mp4:frame@4500ms", "clip.mp4:frame@6750ms"]


def test_file_digests(spark, tmp_path):
    (tmp_path / "note.txt").write_text("low water")
    got = FI.file_digests(spark, str(tmp_path)).first()
    assert (got["byte_size"], got["exact_sha256"]) == (9, hashlib.sha256(b"low water").hexdigest())


def test_content_path(spark):
    df = spark.createDataFrame([("abcdef", "/x/A.PNG"), ("abcdef", "/x/none"), ("abcdef", ".hidden")], "d string, n string")
    got = [r[0] for r in df.select(FI.content_path(F.col("d"), F.col("n"))).collect()]
    assert got == ["ab/cd/abcdef.png", "ab/cd/abcdef", "ab/cd/abcdef"]
