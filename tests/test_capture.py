import hashlib
import json
import random

from pyspark.sql import functions as F

from postsignal.operators import capture as CP
from postsignal.operators import dedup as DD
from postsignal.sources import captures as SC
from postsignal.sources import pages as PG

PAYLOAD = {
    "nested": {"deep": [{"X-Auth-Token": [1, 2], "count": 2}, {"harbour": {"password_hint": "boat"}}], "kept": None},
    "cookie": "tide=high",
    "media": [
        {"type": "image", "url": ""},
        {"type": "gif", "url": "https://cdn.harbour.test/m/ferry.gif#t=3", "context": "Quoted"},
        {"media_type": "image", "source_url": "https://cdn.harbour.test/m/pier.webp?w=640", "alt": " lighthouse at dusk ", "role": "post"},
        {"type": "image", "url": "https://cdn.harbour.test/u/badge-blue.png"},
        {"type": "image", "url": "https://cdn.harbour.test/emoji/wave.png", "scope": "post"},
        {"type": "image", "url": "https://cdn.harbour.test/u/7.png", "media_scope": "profile"},
    ],
    "raw_capture_version": "harbour-3",
    "quoted_url": "https://twitter.com/Tides/status/51?lang=en#r",
    "quoted_author": "Tides",
    "quoted_text": "Low water at noon",
    "metrics": {"views": "88,412", "7 reply": 7, "reposts": -4, "like": "2.5K"},
    "post_time": "2031-03-09T18:05:40Z",
    "name": "The Ferry Desk",
    "content": "Night ferry delayed; fog over the strait.",
    "handle": "@FerryDesk",
    "post_url": "https://x.com/FerryDesk/status/62?utm=mail",
    "platform_post_id": "62",
}


def frame(spark, *payloads):
    rows = [(str(i), json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "post_id string, payload string").withColumn(
        "captured_at", F.timestamp_seconds(F.col("post_id").cast("long"))
    )


def posts(spark, *payloads, source="extension"):
    return CP.validate(CP.to_posts(CP.parse_payloads(frame(spark, *payloads)).drop("payload"), source))


def test_recorded_payload(spark):
    p = posts(spark, PAYLOAD).first()
    assert p["canonical_url"] == "https://x.com/FerryDesk/status/62"
    assert (p["author_handle"], p["platform_post_id"], p["selector_version"]) == ("ferrydesk", "62", "harbour-3")
    # page furniture and empty addresses are gone, parameters cut off
    assert [m["source_url"] for m in p["media"]] == ["https://cdn.harbour.test/m/ferry.gif", "https://cdn.harbour.test/m/pier.webp"]
    assert p["media"][1]["alt_text"] == "lighthouse at dusk"
    assert p["quote_post"]["author_handle"] == "tides"
    assert p["quote_post"]["canonical_url"] == "https://twitter.com/Tides/status/51"
    # "2.5K" reads as its digits, negative counts as none
    assert p["visible_metrics"].asDict() == {"likes": 25, "reposts": 0, "replies": 7, "views": 88412}
    assert p["platform_created_at"].isoformat().startswith("2031-03-09T18:05:40")
    assert p["errors"] == []


def test_redaction_at_any_depth(spark):
    text = frame(spark, PAYLOAD).select(CP.redact_json(F.col("payload")).alias("j")).first()["j"]
    clean = json.loads(text)
    assert clean["cookie"] == "[redacted]" and clean["content"] == PAYLOAD["content"]
    assert clean["nested"] == {"deep": [{"X-Auth-Token": "[redacted]", "count": 2}, {"harbour": {"password_hint": "[redacted]"}}], "kept": None}
    bad = spark.createDataFrame([("{",), (None,)], "payload string").select(CP.redact_json(F.col("payload")).alias("j"))
    assert [r["j"] for r in bad.collect()] == [None, None]


def test_redaction_holds_few_payloads_in_python(spark):
    """Payloads come row by row, not as a column of ten thousand: a plain function gets text, never a series."""
    assert CP.redact_json.func('{"b": 1, "Auth-Token": "x"}') == '{"Auth-Token":"[redacted]","b":1}' and CP.redact_json.func("{") is None
    rows = spark.range(300).select(F.concat(F.lit('{"csrf": 1, "n": '), F.col("id").cast("string"), F.lit("}")).alias("p"))
    assert {r.j for r in rows.select(CP.redact_json("p").alias("j")).collect()} == {f'{{"csrf":"[redacted]","n":{i}}}' for i in range(300)}


def test_only_suspect_payloads_are_rewritten(spark):
    rows = [('{"a" : 1}',), ('{"Set-Cookie": "x", "b": 2}',), ('{"co\\u006fkie": "x"}',), ("token but no json",), ("plain",), (None,)]
    out = spark.createDataFrame(rows, "payload string").coalesce(1).select(CP.redacted_payload(F.col("payload")).alias("j"))
    assert [r["j"] for r in out.collect()] == ['{"a" : 1}', '{"Set-Cookie":"[redacted]","b":2}', '{"cookie":"[redacted]"}', None, None, None]


def test_rejections(spark):
    cases = [
        ({"url": "https://x.com/a/1", "author_handle": "a"}, ["nothing_captured"]),
        ({"url": "https://example.com/1", "text": "t", "author_handle": "@"}, ["author_required", "url_not_accepted"]),
        ({"url": "https://x.com/1", "text": "t" * 20_001}, ["text_too_long"]),
        ({"url": "https://twitter.com/1", "quoted_text": "q"}, []),
        ({"url": "https://x.com/1", "content": "x", "media": [{"url": f"https://m/{i}"} for i in range(9)]}, []),
    ]
    got = posts(spark, *[c[0] for c in cases]).orderBy("post_id").collect()
    assert [r["errors"] for r in got] == [c[1] for c in cases]
    assert len(got[4]["media"]) == 4
    assert got[3]["author_handle"] == "unknown"


def test_empty_payload_fields_fall_through(spark):
    r = CP.parse_payloads(frame(spark, {"text": "", "content": " c ", "handle": "@@h", "post_url": "rel?x", "id": 0})).first()
    derived = hashlib.sha256(b"rel?x|h|c").hexdigest()[:16]
    assert (r["text"], r["author_handle"], r["url"]) == ("c", "h", "rel?x")
    assert r["platform_post_id"] == derived  # a zero is no id
    assert r["media"] == []


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"posts": [PAYLOAD, {"id": "2", "text": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "3", "text": "y"}], indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"id": "4", "text": "z"}))
    got = SC.load_captures(spark, str(tmp_path)).select("platform_post_id").collect()
    assert sorted(r[0] for r in got) == ["2", "3", "4", "62"]
    assert SC.load_posts(spark, str(tmp_path)).filter("size(errors) = 0").count() == 1


def test_idempotency_key_matches_canonical_json(spark):
    p = {"id": "7", "url": "https://x.com/a/7", "author_handle": "A", "text": 'çay "x"\n\\', "quoted_text": ""}
    body = {
        "platform": "x", "platform_post_id": "7", "canonical_url": "https://x.com/a/7", "author_handle": "a",
        "visible_text": 'çay "x"\n\\', "quote_post": None, "media": [],
        "visible_metrics": {"likes": None, "reposts": None, "replies": None, "views": None},
    }
    want = hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert posts(spark, p).first()["idempotency_key"] == want


def test_first_captures_ignore_input_order(spark):
    rows = [(f"{i:03}", "x", random.Random(i).choice(["", "1", "2", "3"]), f"k{i % 7}") for i in range(60)]
    schema = "post_id string, platform string, platform_post_id string, idempotency_key string"
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).withColumn("captured_at", F.lit(0))
        results.append(sorted(r["post_id"] for r in DD.first_captures(df).collect()))
    assert results[0] == results[1]


KEYED = "post_id string, captured_at int, platform string, platform_post_id string, idempotency_key string"


def read_row_by_row(rows):
    keys, ids, kept = set(), set(), []
    for post_id, _, _, pid, key in rows:
        if (key is not None and key in keys) or (pid and pid in ids):
            continue
        keys.add(key)
        ids.add(pid)
        kept.append(post_id)
    return kept


def test_greedy_dedup_equals_reading_row_by_row(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(f"{i:03}", i, "x", rnd.choice(["", None, *"abcdefgh"]), rnd.choice([None, *(f"k{j}" for j in range(12))])) for i in range(50)]
        got = sorted(r["post_id"] for r in DD.first_captures_by_either_key(spark.createDataFrame(rows, KEYED).repartition(5)).collect())
        assert got == read_row_by_row(rows)


def test_chains_of_both_keys_take_few_rounds(spark, monkeypatch):
    calls = []
    firsts = DD._firsts
    monkeypatch.setattr(DD, "_firsts", lambda rows, key: calls.append(key) or firsts(rows, key))
    # each row shares a key with the one before and the other key with the one after; two chains grow from
    # one row, and the last one runs into rows that a hot key holds
    rows = [(f"{i:03}", i, "x", f"b{i // 2}", f"a{(i + 1) // 2}") for i in range(150)]
    rows += [(f"{i:03}", i, "x", f"a{(i - 149) // 2}", f"b{(i - 150) // 2}") for i in range(150, 200)]
    rows += [(f"{i:03}", i, "x", "b74", f"c{i}") for i in range(200, 240)]
    got = sorted(r["post_id"] for r in DD.first_captures_by_either_key(spark.createDataFrame(rows, KEYED).repartition(5)).collect())
    assert got == read_row_by_row(rows)
    assert len(calls) <= 2 * 4


PAGE = """<html lang="en"><head><title>Harbour</title></head><body><p>outside
<ARTICLE class="x"><H1>Night <i>ferry</i>&nbsp;news</H1><p>Fog &amp;lt; over<br>the strait.<script>var p = "<p>";</script>
<P id="two"> Low water at <a class="k" href="/tides?d=1">noon</a> </p> between <p></p><a href="https://x.com/a">more</a></ARTICLE><p>after</body></html>"""


def test_posts_from_html(spark):
    pages = spark.createDataFrame([(5, "https://h.test/1?x=2#f", PAGE), (6, "u", "<p>no article"), (7, "u", None), (8, None, "<article>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in PG.page_posts(pages).collect()}
    assert rows.keys() == {5, 8}
    assert (rows[5]["url"], rows[5]["heading"], rows[5]["links"]) == ("https://h.test/1", "Night ferry news", ["/tides?d=1", "https://x.com/a"])
    assert rows[5]["text"] == "Fog &lt; over the strait.var p = \"\n\";\nLow water at noon"
    assert (rows[8]["text"], rows[8]["paragraphs"], rows[8]["heading"]) == ("", 0, "")


def test_every_article_of_a_page_is_a_post(spark):
    html = """<article><h1>One</h1><p>first <a href='/a"b'>a</a></p></article><p>between</p>
<Article class=x><h1>Two</h1><p>second <a href=/b>b</a><article><p>inner</p></article><p>tail <a HREF = "/c'">c</a></article>
</article><article><p>last, not closed"""
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<article><p>alone</p></article>")], "page_id long, url string, html string")
    got = [(r.page_id, r.position, r.heading, r.text, r.links) for r in PG.page_posts(pages).orderBy("page_id", "position").collect()]
    assert got == [
        (1, 0, "One", "first a", ['/a"b']),
        (1, 1, "Two", "second b\ninner\ntail c", ["/b", "/c'"]),
        (1, 2, "", "inner", []),
        (1, 3, "", "last, not closed", []),
        (2, 0, "", "alone", []),
    ]


def test_articles_of_long_pages(spark):
    """A page of 2,000 articles is cut once; nested, stray and unclosed ones are found like single ones."""
    many = "".join(f"<article><h1>t{i}</h1><p>text {i}</p></article>" for i in range(2000))
    nested = "</article>" + "".join(f"<article><h1>n{i}</h1><article><p>in {i}</p></article><p>out {i}</p></article>" for i in range(300)) + "<article><p>open"
    pages = spark.createDataFrame([(1, "u", many), (2, "v", nested), (2, "v", nested)], "page_id long, url string, html string")
    got = {}
    for r in PG.page_posts(pages).collect():
        got.setdefault((r.page_id, r.position), []).append((r.heading, r.text))
    assert len(got) == 2000 + 601 and all(got[1, i] == [(f"t{i}", f"text {i}")] for i in range(2000))
    assert all(got[2, 2 * i] == [(f"n{i}", f"in {i}\nout {i}")] * 2 and got[2, 2 * i + 1] == [("", f"in {i}")] * 2 for i in range(300))
    assert got[2, 600] == [("", "open")] * 2


def test_articles_equal_their_sql(spark, tmp_path):
    from oracle import compare
    import duckdb

    from postsignal.catalog import streams

    html = [
        "<article><h1>a</h1><p>x<article><p>y<a href=/z>z</a></article>tail<p>w</article></article><article>q",
        "<p>none", None, "<ARTICLE id='1'><p>A &amp; B<br>c</p><a href='/x\"y'>l</a></ARTICLE><article>", "<article><p>1</p><article><p>2</p><article><p>3",
    ]
    spark.createDataFrame([(i, f" https://h/{i}?q#f ", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(streams.page_posts(spark, str(tmp_path)), con, streams.SQL["page_posts"]) == []


def test_client_flags_stay_beside_computed_ones(spark):
    rows = [
        '{"text":"a","parse_quality":{"x":1,"deep":{"a":[1]},"n":null,"has_text":false,"selector_version":7}}', '{"text":"a","parse_quality":"oops"}',
        '{"text":"a","raw_capture_version":"v2","parse_quality":{"selector_version":"v1"}}', "nonsense",
    ]
    got = [r.parse_flags for r in CP.parse_payloads(spark.createDataFrame(list(enumerate(rows)), "i int, payload string")).orderBy("i").collect()]
    own = {"has_url": "false", "has_author": "false", "has_text": "true", "has_quote": "false", "media_count": "0", "selector_version": ""}
    assert got == [own | {"x": "1", "deep": '{"a":[1]}', "n": None, "selector_version": "7"}, own, own | {"selector_version": "v2"}, own | {"has_text": "false"}]


def test_extended_posts(spark):
    from postsignal.operators.keywords import extended_posts

    media = "array<struct<url:string>>"
    schema = f"id long, url string, date long, content string, user struct<username:string,followers_count:long>, media {media}, quoted struct<id:long,content:string,user:struct<username:string,followers_count:long>,media:{media}>"
    rows = [
        (1, "u", 1, "c", ("a", None), [("m1",), (None,), ("",), ("m2",)], (9, "said", ("b", 3), [("q",)])),
        (2, "u", 1, "c", ("a", 5), None, None), (3, "u", 1, None, None, [], (8, None, None, None)),
    ]
    got = [tuple(r)[4:] for r in extended_posts(spark.createDataFrame(rows, schema)).orderBy("id").collect()]
    assert got == [("a", 0, ["m1", "m2"], "https://twitter.com/b/status/9", "said", ["q"]), ("a", 5, [], None, None, []), (None, 0, [], None, None, [])]
