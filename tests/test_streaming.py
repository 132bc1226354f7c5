import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsignal.operators import backlog as BL
from postsignal.operators import learning as L
from postsignal.policies import CapturePolicy, ThrottlePolicy
from postsignal.sources import adapters as A
from postsignal.sources import captures as SC
from postsignal.sources import sinks as SK
from postsignal.streaming import capture as CS
from postsignal.streaming import state as SS


def payload(i, **more):
    body = {"id": str(i), "url": f"https://x.com/a/{i}", "author_handle": "a", "text": f"t{i}", "raw_capture_version": "v1",
            "received_at": f"2024-01-01T00:00:{i:02}Z", "media": [{"url": f"https://m/{i}"}]}
    return json.dumps({**body, **more})


def run(spark, folder, out, **kw):
    CS.start_capture(SC.stream_payload_lines(spark, folder), out, f"{out}/_checkpoint", **kw).awaitTermination()


def test_capture_stream_stores_each_capture_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join([payload(1), payload(1), payload(2), payload(3, url="https://bad.example/3")]))
    run(spark, str(src), out)
    (src / "2.jsonl").write_text("\n".join([payload(2, text="other"), payload(4), payload(5, text="x" * 2_000)]))
    run(spark, str(src), out, policy=CapturePolicy(max_payload_bytes=1_000))
    posts = SK.read_table(spark, out, "captured_posts")
    assert sorted(r["platform_post_id"] for r in posts.collect()) == ["1", "2", "4"]
    assert posts.filter("platform_post_id = '2'").first()["visible_text"] == "t2"
    assert SK.read_table(spark, out, "media_assets").count() == 3
    assert SK.read_table(spark, out, "audit_log").count() == SK.read_table(spark, out, "capture_inbox").count() == 3
    reasons = sorted(r["errors"][0] for r in SK.read_table(spark, out, "quarantine").collect())
    assert reasons == ["payload_too_large", "url_not_accepted"]
    assert SK.read_table(spark, out, "missing") is None


def test_late_captures_and_part_files_all_arrive(spark, tmp_path):
    """One file per trigger, event times out of order: no age limit decides, only the keys."""
    hours = [10, 15, 15, 11, 3, 15]
    rows = [(payload(i, token="hush"), datetime(2024, 1, 1, h)) for i, h in enumerate(hours)] + [(payload(3), datetime(2023, 1, 1))]
    rows += [(payload(9, url="https://bad.example/9", authorization="Bearer zzz"), datetime(2022, 1, 1)), ('{"token": "zzz"', datetime(2022, 1, 1))]
    folder, out = str(tmp_path / "t.parquet"), str(tmp_path / "out")
    for row in rows:
        spark.createDataFrame([row], "payload string, captured_at timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = A.table_stream(spark, str(tmp_path), "t", files_per_trigger=1)
    CS.start_capture(stream, out, f"{out}/_checkpoint").awaitTermination()
    posts = SK.read_table(spark, out, "captured_posts").collect()
    assert sorted(r["platform_post_id"] for r in posts) == ["0", "1", "2", "3", "4", "5"]
    assert len({r["batch_id"] for r in posts}) == 6
    kept = SK.read_table(spark, out, "quarantine").collect()
    assert len(kept) == 2 and all(r["payload_sha"] and r["correlation_id"] for r in kept)
    assert all("zzz" not in (r["payload"] or "") for r in kept) and all("hush" not in r["raw_payload"] for r in posts)
    assert {len(r["correlation_id"]) for r in SK.read_table(spark, out, "capture_inbox").collect()} == {32}


def test_single_file_tables_and_repeats_on_a_stream(spark, tmp_path):
    rows = [(payload(i % 4), datetime(2024, 1, 1 + i)) for i in range(8)]
    spark.createDataFrame(rows, "payload string, captured_at timestamp").coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    part.rename(tmp_path / "one.parquet")
    once = CS.drop_repeats(A.table_stream(spark, str(tmp_path), "one"))
    assert _collect(once, tmp_path, "append").count() == 4


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([(payload(i), datetime(2024, 1, 1)) for i in range(3)], "payload string, captured_at timestamp")
    for batch in (0, 0, 1):
        CS.store_batch(rows, batch, out)
    posts = SK.read_table(spark, out, "captured_posts").collect()
    assert sorted(r["platform_post_id"] for r in posts) == ["0", "1", "2"]
    assert {r["batch_id"] for r in posts} == {0}


def test_a_batch_is_read_by_splits_not_from_cached_blocks(spark, tmp_path, monkeypatch):
    """Stored tables read files, of which a task gets a split, and these hold no secrets and go with the batch."""
    plans, staged, write = {}, [], CS.write_batch

    def seen(tables, folder, batch):
        plans.update({name: rows._jdf.queryExecution().toString() for name, rows in tables.items()})
        for rows in tables.values():
            staged.extend(f for f in rows.inputFiles() if f not in staged)
        texts = [str(r) for f in staged for r in spark.read.parquet(f).collect()]
        assert len(texts) > 5 and not any("hush" in t for t in texts)
        write(tables, folder, batch)

    monkeypatch.setattr(CS, "write_batch", seen)
    rows = [(payload(i % 4, token="hush", url=f"https://{'bad.example' if i == 5 else 'x.com'}/a/{i}"), datetime(2024, 1, 1 + i)) for i in range(8)]
    rows += [(payload(20, text="y" * 2_000, token="hush"), datetime(2024, 1, 1)), ('{"token": "hush"', datetime(2024, 1, 2)), (None, datetime(2024, 1, 3))]
    out = str(tmp_path)
    CS.store_batch(spark.createDataFrame(rows, "payload string, captured_at timestamp"), 0, out, CapturePolicy(max_payload_bytes=1_000))
    assert set(plans) == {"captured_posts", "media_assets", "capture_inbox", "audit_log", "quarantine"}
    assert not any("InMemoryRelation" in plan or "BatchEvalPython" in plan for plan in plans.values())
    assert not any((tmp_path / f.removeprefix("file://")).exists() for f in staged)
    assert SK.read_table(spark, out, "captured_posts").count() == 4
    assert sorted(r["errors"][0] for r in SK.read_table(spark, out, "quarantine").collect()) == ["payload_too_large", "url_not_accepted", "url_not_accepted"]


def _write_batches(spark, tmp_path, rows, schema, parts=4):
    folder = str(tmp_path / "in")
    for i in range(parts):
        chunk = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


def _collect(stream, tmp_path, mode):
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_online_weights_equal_the_batch_fold(spark, tmp_path):
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    # one key holds nearly all rewards
    rows = [("tone.a" if i % 50 else "tone.b", start + timedelta(seconds=i // 2), i, rnd.choice([1.0, 1.2, -1.0, 0.4])) for i in range(400)]
    stream, batch = _write_batches(spark, tmp_path, rows, "key string, ts timestamp, event_id long, reward double")
    out = str(tmp_path / "out")
    SS.start_weights(stream, out, str(tmp_path / "check")).awaitTermination()
    got = {r["key"]: (r["value"], r["steps"]) for r in SK.latest_version(spark, out, "weights").collect()}
    assert got == {r["key"]: (pytest.approx(r["value"]), r["steps"]) for r in L.folded_weights(batch).collect()}
    # repeating the last batch changes nothing
    last = spark.createDataFrame(rows[300:], "key string, ts timestamp, event_id long, reward double")
    SS.store_weights(last, 3, out)
    assert {r["key"]: r["steps"] for r in SK.latest_version(spark, out, "weights").collect()} == {k: s for k, (_, s) in got.items()}
    assert SK.latest_version(spark, out, "other") is None and SK.latest_version(spark, out, "weights", before=0) is None


def test_stream_throttle_equals_the_batch_form(spark, tmp_path):
    SS.use_rocksdb(spark)
    policy = ThrottlePolicy(3, 0.5, 1)
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(100) * 1_000_000, i, rnd.choice("ab")) for i in range(120))
    rows = [(k, us, i) for us, i, k in rows]
    stream, batch = _write_batches(spark, tmp_path, rows, "key string, at_us long, event_id long")
    got = {r["event_id"]: r["admitted"] for r in _collect(SS.throttled(stream, policy), tmp_path, "append").collect()}
    want = {r["event_id"]: r["admitted"] for r in L.throttle(batch, "key", "at_us", "event_id", policy).collect()}
    assert got == want


def test_failures_are_routed(spark, tmp_path):
    rows = spark.createDataFrame([("fatal", 1), ("timeout", 1), ("E", 4), ("E", 5), ("timeout", 9)], "error_kind string, attempt int")
    got = [(r["error_code"], r["outcome"], r["delay_cap_s"]) for r in BL.route_failures(rows).collect()]
    assert got == [("FatalJobError", "dead", None), ("STAGE_TIMEOUT", "retry", 2.0), ("E", "retry", 128.0), ("E", "dead", None), ("STAGE_TIMEOUT", "dead", None)]
    SS.store_failures(rows, 0, str(tmp_path))
    assert SK.read_table(spark, str(tmp_path), "dead").count() == 3


def test_backlog_order(spark):
    us = 1_000_000
    rows = [("old60", 60, 0), ("p100", 100, 999 * us), ("fresh70", 70, 999 * us), ("low", 20, 0), ("later", 100, 2_000_000 * us)]
    df = spark.createDataFrame(rows, "job_id string, priority int, created_us long").withColumn("available_us", F.col("created_us")).withColumn(
        "status", F.lit("pending")).withColumn("resource_class", F.lit("light"))
    got = BL.next_items(df, 1_000_000 * us, 3).orderBy("claim_rank").collect()
    # all have waited for the full boost
    assert [r["job_id"] for r in got] == ["p100", "fresh70", "old60"]
    # 60 + 50 is ahead of a fresh 70
    fresh = df.withColumn("created_us", F.when(F.col("job_id") == "fresh70", 1_000_000 * us).otherwise(F.col("created_us"))).withColumn("available_us", F.lit(0))
    got = BL.next_items(fresh.filter("job_id <> 'later'"), 1_000_000 * us, 3).orderBy("claim_rank").collect()
    assert [r["job_id"] for r in got] == ["p100", "old60", "fresh70"]
