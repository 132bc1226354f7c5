import pytest
from pyspark.sql import functions as F

from postsignal.functions import text as X


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"t {dtype}").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Gol! https://x.com/a  maç", "Gol! <url> maç"),
        ("a!!!! b?? c...d", "a!! b?? c..d"),
        ("a​b  \t\n c ", "ab c"),
        ("x\x1cy　z", "x y z"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, X.clean_text) == clean


def test_collapse_text(spark):
    assert one(spark, " “Hi”  ‘you’!!! ok?? ...", X.collapse_text) == "\"Hi\" 'you'! ok? ."


def test_combined_context_skips_empty_parts(spark):
    got = spark.range(1).select(
        X.combined_context(F.lit("Bunu konuşurlar"), F.lit(""), F.array(F.lit(""), F.lit("penaltı  anı")), F.array(F.lit("x"))).alias("r")
    )
    assert got.first()["r"] == "Bunu konuşurlar penaltı anı x"


def test_handles(spark):
    for raw, want in [("  @@Ab ", "ab"), ("@", None), ("", None), (None, None), ("a@b", "a@b")]:
        assert one(spark, raw, X.normalize_handle) == want


def test_language(spark):
    assert one(spark, "Für dich", X.detect_language) == "tr"
    assert one(spark, "bir gol daha", X.detect_language) == "tr"
    assert one(spark, "golden age", X.detect_language) == "unknown"
    assert one(spark, None, X.detect_language) == "unknown"


def test_tone_rules_are_ordered(spark):
    assert one(spark, "Klasik, bu pozisyon", X.infer_tone) == "dry_humor"
    assert one(spark, "Bu pozisyon", X.infer_tone) == "reaction"
    assert one(spark, "kısa", X.infer_tone) == "neutral_short"
    assert one(spark, " ".join(["w"] * 12), X.infer_tone) == "fan_voice"


def test_quality(spark):
    issues = one(spark, "Özetle bu bağlamda #a #b #c " + "w " * 40, X.quality_issues)
    assert issues == ["ai_or_news_phrases:bu bağlamda,özetle", "too_many_hashtags", "too_explanatory"]
    assert one(spark, "  ", X.quality_issues) == ["empty_text"]
    assert one(spark, "x" * 281, X.quality_issues) == ["too_long"]
    assert one(spark, "iyi", X.quality_issues) == []


def test_categories_match_substrings(spark):
    assert one(spark, "He said AI wins the match", X.classify_text) == ["football", "technology"]
    assert one(spark, "", X.classify_text) == []


def test_sentiment(spark):
    assert one(spark, "good good bad day", X.estimate_sentiment) == pytest.approx(0.25)
    assert one(spark, "goodness badly", X.estimate_sentiment) == 0.0
    assert one(spark, " .. ", X.estimate_sentiment) == 0.0
    assert one(spark, "love", X.estimate_sentiment) == 1.0


def test_keyword_hits_fold_text_but_not_keywords(spark):
    # "maç" and "penaltı" cannot match a folded text
    assert one(spark, "Maç penaltı gol LİG derbi", lambda c: X.keyword_hits(c)) == 2
    assert one(spark, "goll", lambda c: X.keyword_hits(c)) == 2
    assert one(spark, None, lambda c: X.keyword_hits(c)) == 0


def test_event_type_precedence(spark):
    for raw, want in [
        ("Transfer ve gol", "transfer"), ("gol sakat", "match_moment"), ("kriz 😂", "injury"), ("mizah", "meme"),
        ("derbi", "global_football"), ("hava", "other"), (None, "other"),
    ]:
        assert one(spark, raw, X.infer_event_type) == want


def test_quote_risk_and_topics(spark):
    assert one(spark, "İddia değil iddia, skandal kavga", X.quote_context_risk) == 60.0
    assert one(spark, "Skor ve tribünler", X.topic_terms) == ["skor", "tribün"]


def test_summaries(spark):
    text = " ".join(f"w{i}" for i in range(50))
    assert one(spark, text, lambda c: X.summarize(c, 3, 5)) == "w0 w1 w2..."
    assert one(spark, "a b", lambda c: X.summarize(c, 3, 5)) == "a b"
    got = one(spark, "a b c", lambda c: X.summarize(c, 3, 2, F.lit("k1 k2")))
    assert got == "a b c | k1 k2"
