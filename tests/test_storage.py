from pyspark.sql import functions as F

from postsignal.operators import dedup as DD
from postsignal.operators import lookups as J
from postsignal.operators import reports as R
from postsignal.operators import storage as ST


def test_objects_references_and_snapshots(spark):
    schema = "sha string, relative_path string, byte_size long, perceptual_hash string, storage_policy string, availability string, source_url string, retention_expires_at long, updated_at long, seq int"
    rows = [
        ("s", "aa/blob.png", 123, "dhash64-v1:abcd", "thumbnail", "local", "https://u", 200, 100, 1),
        ("s", "aa/blob.png", 123, "dhash64-v1:abcd", "thumbnail", "local", "https://u", 200, 101, 2),
        ("s", "", 0, None, "metadata", "metadata_only", None, None, 102, 3),
        ("t", "", 0, None, "metadata", "metadata_only", None, None, 5, 4),
    ]
    got = {r["sha"]: r for r in ST.merged_objects(spark.createDataFrame(rows, schema)).collect()}
    s, t = got["s"], got["t"]
    assert (s["relative_path"], s["byte_size"], s["storage_policy"], s["source_url"], s["created_at"], s["updated_at"]) == (
        "aa/blob.png", 123, "thumbnail", "https://u", 100, 102
    )
    assert (t["relative_path"], t["byte_size"], t["storage_policy"], t["availability"], t["perceptual_hash"]) == ("", 0, "metadata", "metadata_only", None)

    log = spark.createDataFrame(
        [("s", "p1", "add", 1, 1), ("s", "p1", "add", 2, 2), ("s", "p2", "add", 3, 3), ("s", "p1", "release", 4, 4), ("s", "p9", "release", 5, 5), ("t", "q", "release", 1, 6)],
        "sha string, reference_id string, action string, at int, seq int",
    )
    live = ST.live_references(log)
    assert [(r["sha"], r["reference_id"]) for r in live.collect()] == [("s", "p2")]
    counts = ST.reference_counts(spark.createDataFrame([("s",), ("t",)], "sha string"), live)
    assert {r["sha"]: r["reference_count"] for r in counts.collect()} == {"s": 1, "t": 0}
    many = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "a")], "sha string, reference_id string")
    left = ST.release_unnamed(many, spark.createDataFrame([("s", 2), ("t", 5)], "sha string, n long"))
    assert [(r["sha"], r["reference_id"]) for r in left.collect()] == [("s", "a")]

    snaps = spark.createDataFrame([(" u ", "404", 1, 1), ("u", "404", 1, 2), ("u", "404", 2, 3)], "source_url string, reason string, observed_at long, seq int")
    assert sorted(r["seq"] for r in ST.remote_snapshots(snaps).collect()) == [1, 3]
    assert [r["seq"] for r in ST.latest_remote_snapshots(snaps).collect()] == [3]


def test_features_keep_their_first_id(spark):
    rows = [("post", "1", "n", "v1", "f1", 10, "a", 1), ("post", "1", "n", "v1", "f2", 20, "b", 2), ("post", "1", "n", "v2", "f3", 30, "c", 3)]
    df = spark.createDataFrame(rows, "owner_type string, owner_id string, feature_name string, feature_version string, feature_id string, created_at int, value_json string, seq int")
    got = sorted((r["feature_id"], r["created_at"], r["value_json"]) for r in ST.latest_features(df).collect())
    assert got == [("f1", 10, "b"), ("f3", 30, "c")]


def test_default_weights_fill_gaps_only(spark):
    w = spark.createDataFrame([("tone.reaction", 1.7)], "key string, value double")
    got = {r["key"]: r["value"] for r in ST.with_default_weights(w).collect()}
    assert len(got) == 4 and got["tone.reaction"] == 1.7 and got["tone.dry_humor"] == 1.0


def test_validity(spark):
    log = spark.createDataFrame(
        [("n", "k", "v1", "old", 1, None), ("n", "k", "v1", "new", 5, 100), ("n", "x", "v1", "gone", 5, 9), ("n", "y", "v2", "other", 5, None), ("m", "k", "v1", "cut", 5, None)],
        "namespace string, cache_key string, version string, value string, written_at long, expires_at long",
    )
    inv = spark.createDataFrame([("m", None, 6), ("n", "v1", 3)], "namespace string, version string, invalidated_at long")
    got = ST.valid_entries(log, 10, "v1", invalidations=inv).collect()
    assert [r["value"] for r in got] == ["new"]
    assert {r["value"] for r in ST.valid_entries(log, 10, "v1").collect()} == {"new", "cut"}


def test_cursor_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = ST.after_cursor(spark.read.parquet(str(tmp_path / "t")), "id", 6)
    assert df.count() == 3
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,6)]" in df._jdf.queryExecution().executedPlan().toString()
    assert ST.after_cursor(df, "id", None) is df


def test_previous_turn(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (2, 0, "c"), (1, 9, None), (1, 12, "d")], "conv_id int, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r["quoted_text"] for r in J.with_previous_text(df).collect()}
    assert got == {(1, 1): "", (1, 4): "a", (1, 9): "b", (1, 12): "", (2, 0): ""}


def test_stored_rows_are_not_new(spark):
    a = spark.createDataFrame([("x", "1", "k1", "a"), ("x", "2", "k2", "b"), ("x", "3", "k9", "c"), ("x", "", "k5", "d")], "platform string, platform_post_id string, idempotency_key string, post_id string")
    s = spark.createDataFrame([("x", "1", "other"), ("x", "9", "k9"), ("x", "", "z")], "platform string, platform_post_id string, idempotency_key string")
    assert sorted(r["post_id"] for r in DD.not_yet_stored(a, s).collect()) == ["b", "d"]


def test_report_without_feedback(spark):
    f = spark.createDataFrame([], "action string")
    w = spark.createDataFrame([], "key string, value double")
    assert R.weekly_report(f, w).first()["report"].split("\n")[1:3] == ["Feedback: no feedback yet", "Weights: default weights"]
    f = spark.createDataFrame([("b",), ("a",), ("b",)], "action string")
    w = spark.createDataFrame([("k", 1.256)], "key string, value double")
    assert R.weekly_report(f, w).first()["report"].split("\n")[1:3] == ["Feedback: a: 1, b: 2", "Weights: k=1.26"]


def test_first_and_last_per_key_prune_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    first = DD.first_per_key(df, ["k"], ["id"])
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in DD.last_per_key(df, ["k"], ["id"]).collect()) == [97, 98, 99]
