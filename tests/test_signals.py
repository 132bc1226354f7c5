import json

import pytest
from pyspark.sql import functions as F

from postsignal.functions import scores as C
from postsignal.operators import accounts as AC
from postsignal.operators import drafts as D
from postsignal.plans.signals import post_signals

MEDIA = "array<struct<media_type string, source_url string, alt_text string, ocr_text string, copyright_status string>>"


def posts(spark):
    """Invented posts: (id, text, quote, media text, what must come of it).

    An event type is the first rule with a keyword in the text. One image with a description gives
    media context 50. A word of doubt adds risk; so does media of unknown origin.
    """
    data = [
        (pid, f"writer{i}", text, quote, [("image", "u", alt, "", "")] if alt else [], i)
        for i, (pid, text, quote, alt, *_) in enumerate(POSTS)
    ]
    return spark.createDataFrame(data, f"post_id string, author_handle string, text string, quoted_text string, media {MEDIA}, ordinal int")


POSTS = [
    ("a", "Uzatmada gol sesi duyuldu.", "Kimse inanmadı", "kalabalık tribün", "match_moment", 50, 19.25, "", 48.15, "watch", 56.5),
    ("b", "Yarınki maç öne alındı.", "", None, "match_moment", 0, 0, "", 47.0, "watch", 40.0),
    ("c", "Transfer için iddia büyük.", "", None, "transfer", 0, 18, "misinformation", 43.4, "watch", 34.0),
    ("d", "Derbi bileti kalmadı.", "", None, "global_football", 0, 0, "", 47.0, "watch", 40.0),
    ("e", "Sakat listesi kulis konusu.", "", None, "injury", 0, 18, "misinformation", 43.4, "watch", 40.0),  # no claim: candidate as for "b"
    ("f", "Sabah koşusu güzeldi.", "", None, "other", 0, 0, "", 39.5, "archive", 25.0),
    ("g", "Sokakta futbol vardı.", "", "çamurlu ayakkabılar", "global_football", 50, 19.25, "", 48.15, "watch", 47.5),
]
EXPECTED = {pid: want for pid, _, _, _, *want in POSTS}


def test_sample_posts(spark):
    for r in post_signals(posts(spark)).collect():
        kind, ctx, risk, issues, event, decision, candidate = EXPECTED[r["post_id"]]
        assert (r["event_type"], ",".join(r["risk_issues"]), r["decision"]) == (kind, issues, decision)
        assert r["media_context"] == ctx
        assert r["risk_score"] == pytest.approx(risk)
        assert r["event_score"] == pytest.approx(event)
        assert r["candidate_score"] == pytest.approx(candidate)


def test_account_verdict_is_that_of_the_last_post(spark):
    s = post_signals(posts(spark)).withColumn("author_handle", F.lit("a"))
    row = AC.account_candidates(s).first()
    assert row["candidate_score"] == pytest.approx(47.5)
    assert row["action"] == "watch_one_week"
    assert row["example_post"].startswith("Sokakta")


def test_drafts(spark):
    events = spark.createDataFrame([(1, 0.0, "Rize"), (2, 61.0, "x"), (3, 0.0, "özetle " * 60)], "id int, risk_score double, topic string")
    rows = {}
    for r in D.draft_rows(D.with_drafts(events), "id").collect():
        rows.setdefault(r["id"], []).append(r)
    assert [r["variant_label"] for r in rows[1]] == ["reaction", "dry_humor", "neutral_short"]
    assert rows[1][1]["text"] == "Dakika 70, senaryo yine aynı."
    assert rows[1][2]["text"] == "Rize cephesinde gündem bu pozisyona döndü."
    assert [r["variant_label"] for r in rows[2]] == ["do_not_post"]
    # an unusable topic falls through to the next template
    assert rows[3][2]["text"] == "Bu olay kısa sürede konuşulur."
    assert all(r["quality_score"] == 100.0 for rs in rows.values() for r in rs)


def test_score_bounds_and_labels(spark):
    df = spark.createDataFrame([(0.0,), (200.0,), (-50.0,)], "x double")
    got = df.select(C.event_score(risk_score=F.col("x"), source_reliability=F.col("x") * 3).alias("s")).collect()
    assert [r["s"] for r in got] == [pytest.approx(12.5), 100.0, 0.0]
    labels = spark.createDataFrame(
        [(0.0, 81.0), (99.0, 61.0), (75.0, 60.9), (60.0, 0.0), (40.0, 0.0), (39.9, 0.0)], "e double, r double"
    ).select(C.decision_label(F.col("e"), F.col("r")).alias("d"))
    assert [r["d"] for r in labels.collect()] == [
        "block", "human_review", "high_priority_suggestion", "normal_suggestion", "watch", "archive"
    ]
    with pytest.raises(ValueError):
        C.event_score(unknown=F.lit(1))


def test_selected_candidates(spark):
    rows = [
        ("Gol gol maç", "tr", "a", 99, ["u"], None, 1),
        ("gol", "tr", "b", 0, [], "q", 2),
        ("gol", "en", "c", 0, [], None, 3),
        ("hava", "tr", "d", 0, [], None, 4),
    ]
    p = spark.createDataFrame(rows, "text string, lang string, author_handle string, followers_count int, media array<string>, quoted_url string, ordinal int")
    got = {r["author_handle"]: r["score"] for r in AC.select_candidates(p, "gol", lang="tr").collect()}
    # keywords: gol, maç (tokens longer than two letters)
    assert got == {"a": pytest.approx(2 + 1 + 0.6), "b": pytest.approx(0.5 + 0.3)}
    assert AC.select_candidates(p, "", lang="tr").count() == 0
    json.dumps(got)
