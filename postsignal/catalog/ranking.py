"""Searches, rankings, reports and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.catalog import base as b
from postsignal.catalog.scoring import _FEEDBACK
from postsignal.functions.scores import retry_delay_cap
from postsignal.functions.text import summarize
from postsignal.operators import backlog as BL
from postsignal.operators import keywords as K
from postsignal.operators import learning as L
from postsignal.operators import reports as R
from postsignal.policies import ThrottlePolicy
from postsignal.runtime import scratch_folder
from postsignal.sources import adapters as A
from postsignal.sources import sinks as SK

NOW_US = 915_148_800_000_000  # 1999-01-01, between the order dates
THROTTLE = ThrottlePolicy(capacity=3.0, refill_per_s=1 / 7200, cost=1.0)


def search_posts(spark, sf):
    return K.search_posts(A.posts(spark, sf), "tertion", 20, "en").select("post_id", "author_handle", "ordinal")


def search_results(spark, sf):
    """Search results as written to and read back from JSON lines."""
    found = K.search_posts(A.posts(spark, sf), "tion", 20, "fr")
    rows = found.withColumn("summary", summarize(F.col("text"), 20, 10)).select(
        F.col("ordinal").alias("id"), F.concat(F.lit("https://x.com/"), "post_id").alias("url"), F.col("text").alias("content"),
        "summary", F.col("summary").alias("translated"),
    )
    path = scratch_folder(spark, "results")
    SK.write_results(rows, path)
    return spark.read.schema("id long, url string, content string, summary string, translated string").json(path)


def top_tokens(spark, sf):
    return K.top_tokens(A.text_table(spark, sf, "documents"), 25)


def style_keywords(spark, sf):
    return K.style_keywords(A.text_table(spark, sf, "documents"), 25)


def weekly_report(spark, sf):
    rewarded = L.rewarded_feedback(A.feedback(spark, sf))
    return R.weekly_report(rewarded, L.folded_weights(rewarded))


def folded_weights(spark, sf):
    out = L.folded_weights(L.rewarded_feedback(A.feedback(spark, sf), A.suggestions(spark, sf)))
    return out.select("key", F.round("value", 6).alias("value"), "steps")


def continued_weights(spark, sf):
    """Weights per user segment continuing from given earlier values."""
    rewarded = L.rewarded_feedback(A.feedback(spark, sf)).withColumn("key", F.concat(F.lit("u"), F.col("suggestion_id")))
    start = A.table(spark, sf, "customer").select(
        F.concat(F.lit("u"), "c_custkey").alias("key"), (F.col("c_nationkey") / 10.0).alias("seed")
    )
    out = L.folded_weights(rewarded, start=start)
    return out.select("key", F.round("value", 6).alias("value"), "steps")


def folded_reliability(spark, sf):
    sources = A.table(spark, sf, "documents").select("source").distinct().withColumn(
        "source_type", F.when(F.col("source") == "src0", "journalist").otherwise("unknown")
    )
    out = L.folded_reliability(A.observations(spark, sf), sources)
    return out.select("source", F.round("value", 6).alias("value"), "steps")


def style_examples(spark, sf):
    f = A.feedback(spark, sf).withColumn("edited_text", F.when(F.col("action") == "edited", F.concat(F.lit("e"), "event_id")))
    return L.style_examples(f)


def _options(spark, sf):
    e = A.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("option")).agg(
        F.round(F.sum("value"), 4).alias("s"), F.min("event_id").alias("ordinal")
    ).withColumn("score", F.when(F.col("s") > 20, F.col("s")))


def greedy_choices(spark, sf):
    return L.choose_options(_options(spark, sf)).select("key", "choice")


def explored_choices(spark, sf):
    return L.choose_options(_options(spark, sf), epsilon=0.3, seed=7)


def next_items(spark, sf):
    out = BL.next_items(A.jobs(spark, sf), NOW_US, 50)
    return out.select("job_id", "resource_class", F.col("effective_priority").cast("long").alias("effective_priority"), F.col("claim_rank").cast("long").alias("claim_rank"))


def status_summary(spark, sf):
    return BL.status_summary(A.jobs(spark, sf))


def class_load(spark, sf):
    return BL.class_load(A.jobs(spark, sf).withColumn("status", F.when(F.col("priority") == 70, "running").otherwise(F.col("status"))))


def board_summary(spark, sf):
    tasks = A.jobs(spark, sf).select(F.when(F.col("status") == "dead", "done").when(F.col("status") == "retry", "blocked").otherwise("todo").alias("status"))
    return BL.board_summary(tasks)


def failed_items(spark, sf):
    jobs = A.jobs(spark, sf)
    dead = jobs.filter("status = 'dead'").select("job_id", F.concat(F.lit("E"), F.col("priority")).alias("reason_code"), F.col("created_us").alias("failed_at"))
    return BL.failed_items(dead, jobs.select("job_id", "payload_ref", "resource_class", "attempt"), 50)


def routed_failures(spark, sf):
    f = A.jobs(spark, sf).select(
        "job_id", "attempt", F.when(F.col("resource_class") == "io", "timeout").when(F.col("priority") == 20, "fatal").otherwise("ValueError").alias("error_kind")
    )
    return BL.route_failures(f)


def delay_caps(spark, sf):
    attempts = A.jobs(spark, sf).select("job_id", F.col("attempt"))
    return attempts.select("job_id", retry_delay_cap(F.col("attempt")).alias("cap"))


def throttled_events(spark, sf):
    """Token bucket per user over the whole event log."""
    e = A.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return L.throttle(e, "user", "us", "event_id", THROTTLE).select("event_id", "admitted")


def throttled_types(spark, sf):
    """Token bucket per event type: few keys, each with a large share of the events."""
    e = A.table(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return L.throttle(e, "event_type", "us", "event_id", ThrottlePolicy(5.0, 1 / 3000, 1.0)).select("event_id", "admitted")


QUERIES = {
    "search_posts": search_posts,
    "search_results": search_results,
    "top_tokens": top_tokens,
    "style_keywords": style_keywords,
    "weekly_report": weekly_report,
    "folded_weights": folded_weights,
    "continued_weights": continued_weights,
    "folded_reliability": folded_reliability,
    "style_examples": style_examples,
    "greedy_choices": greedy_choices,
    "explored_choices": explored_choices,
    "next_items": next_items,
    "status_summary": status_summary,
    "class_load": class_load,
    "board_summary": board_summary,
    "failed_items": failed_items,
    "routed_failures": routed_failures,
    "delay_caps": delay_caps,
    "throttled_events": throttled_events,
    "throttled_types": throttled_types,
}

_JOBS = """jobs as (select o_orderkey as job_id, o_custkey as payload_ref, case o_orderstatus when 'O' then 'pending' when 'P' then 'retry' else 'dead' end as status,
    case o_orderpriority[1] when '1' then 100 when '2' then 90 when '3' then 70 when '4' then 40 when '5' then 20 end as priority,
    case o_orderkey % 3 when 0 then 'light' when 1 then 'heavy' else 'io' end as resource_class, epoch_us(o_orderdate) as created_us, (o_orderkey % 6 + 1)::int as attempt from orders)"""
_FOLD = """list_reduce(list_prepend({start}, list(reward order by ts, event_id)), lambda a, r: greatest(0.2::double, least(2.0::double, a + 0.05::double * r)))"""
_OPT = """opt as (select user_id as key, event_type as option, round(sum(value), 4) as s, min(event_id) as ordinal from events group by 1, 2),
  sc as (select *, case when s > 20 then s else 0 end as v from opt)"""
_DRAW = "('0x' || substr(sha256({0}), 1, 13))::bigint::double / pow(16, 13)"


def _bucket(key: str, cap: float, rate: str) -> str:
    step = f"least({cap}::double, r.tokens + greatest(0.0::double, (o.us - r.us) / 1000000.0::double) * {rate})"
    return f"""with recursive o as (select event_id, {key} as k, epoch_us(ts) as us, row_number() over (partition by {key} order by ts, event_id) as i from events),
        r as (select k, i, us, event_id, {cap}::double - 1 as tokens, true as admitted from o where i = 1
          union all select o.k, o.i, o.us, o.event_id, {step} - case when {step} >= 1 then 1 else 0 end, {step} >= 1 from r join o on o.k = r.k and o.i = r.i + 1)
        select event_id, admitted from r"""


SQL = {
    "search_posts": "select doc_id::varchar as post_id, source as author_handle, doc_id as ordinal from documents where lang = 'en' and contains(lower(text), 'tertion') order by doc_id desc limit 20",
    "search_results": f"""with f as (select doc_id, text, {b.sql_tokens('text')} as w from documents where lang = 'fr' and contains(lower(text), 'tion') order by doc_id desc limit 20),
        s as (select *, case when len(w) < 10 then text else array_to_string(w[1:20], ' ') || case when len(w) > 20 then '...' else '' end end as summary from f)
        select doc_id as id, 'https://x.com/' || doc_id as url, text as content, summary, summary as translated from s""",
    "top_tokens": f"""select token, count(*) as count from (select unnest({b.sql_tokens('lower(text)')}) as token from documents) where length(token) > 2 group by token order by count desc, token limit 25""",
    "style_keywords": f"""select token, count(*) as count from (select unnest(regexp_extract_all(lower(text), '{b.WORD}+')) as token from documents)
        where length(token) > 2 and token not in ({", ".join(map(b.lit, lx.STYLE_STOPWORDS))}) group by token order by count desc, token limit 25""",
    "weekly_report": f"""with {_FEEDBACK}, a as (select string_agg(action || ': ' || n, ', ' order by action) as a from (select action, count(*) as n from feedback group by 1)),
        w as (select key, {_FOLD.format(start='1.0::double')} as v from rewarded group by key), wt as (select string_agg(key || '=' || printf('%.2f', v), '; ' order by key) as w from w)
        select 'Weekly learning report' || chr(10) || 'Feedback: ' || a || chr(10) || 'Weights: ' || w || chr(10) || {b.lit(lx.REPORT_NEXT_ACTION)} as report from a, wt""",
    "folded_weights": f"""with {_FEEDBACK}, known as (select distinct suggestion_id from feedback where action = 'posted_manually')
        select key, round({_FOLD.format(start='1.0::double')}, 6) as value, count(*) as steps from rewarded where suggestion_id in (select suggestion_id from known) group by key""",
    "continued_weights": f"""with {_FEEDBACK}
        select 'u' || suggestion_id as key, round({_FOLD.format(start='coalesce(any_value(c_nationkey / 10.0::double), 1.0::double)')}, 6) as value, count(*) as steps
        from rewarded left join customer on c_custkey = suggestion_id group by suggestion_id""",
    "folded_reliability": """with o as (select source, quality * 100.0::double as x, doc_id from documents join labels using (doc_id))
        select source, round(list_reduce(list_prepend(case when source = 'src0' then 75.0::double else 30.0::double end, list(x order by doc_id)),
          lambda a, x: greatest(0.0::double, least(100.0::double, a * 0.85::double + x * 0.15::double))), 6) as value, count(*) as steps from o group by source""",
    "style_examples": "select 'e' || event_id as text, 'edited' as tone_tags, 65.0::double as performance_score, true as approved from events where event_type = 'click'",
    "greedy_choices": f"with {_OPT} select key, option as choice from sc qualify row_number() over (partition by key order by v desc, ordinal) = 1",
    "explored_choices": f"""with {_OPT}, d as (select *, {_DRAW.format("key || '|explore|7'")} < 0.3 as explored, {_DRAW.format("key || '|' || option || '|7'")} as draw from sc)
        select key, case when explored then arg_min(option, draw) else arg_max(option, {{'v': v, 'o': -ordinal}}) end as choice, explored from d group by key, explored""",
    "next_items": f"""with {_JOBS}, e as (select *, priority + least(50, greatest(0, floor(({NOW_US} - created_us) / 60000000)))::bigint as ep from jobs where status in ('pending', 'retry') and created_us <= {NOW_US})
        select job_id, resource_class, ep::bigint as effective_priority, rn as claim_rank from (select *, row_number() over (partition by resource_class order by case when priority >= 100 then 3 when priority >= 50 then 2 else 1 end desc, ep desc, priority desc, created_us, job_id) as rn from e) where rn <= 50""",
    "status_summary": f"with {_JOBS} select status, resource_class, count(*) as items from jobs group by all",
    "class_load": f"""with {_JOBS}, j as (select resource_class, case when priority = 70 then 'running' else status end as status from jobs)
        select resource_class, count(*) filter (status in ('pending', 'retry')) as queued, count(*) filter (status = 'running') as running from j group by 1""",
    "board_summary": f"""with {_JOBS}, t as (select case status when 'dead' then 'done' when 'retry' then 'blocked' else 'todo' end as status from jobs),
        c as (select status, count(*) as n from t group by 1), a as (select status from c union select unnest(['todo', 'in_progress', 'done']))
        select status, coalesce(n, 0) as items from a left join c using (status)""",
    "failed_items": f"""with {_JOBS} select job_id, 'E' || priority as reason_code, created_us as failed_at, payload_ref, resource_class, attempt from jobs where status = 'dead' order by created_us desc, job_id desc limit 50""",
    "routed_failures": f"""with {_JOBS}, f as (select job_id, attempt, case when resource_class = 'io' then 'timeout' when priority = 20 then 'fatal' else 'ValueError' end as error_kind from jobs),
        g as (select *, error_kind <> 'fatal' and attempt < 5 as again from f)
        select job_id, attempt, error_kind, case error_kind when 'fatal' then 'FatalJobError' when 'timeout' then 'STAGE_TIMEOUT' else error_kind end as error_code,
          case when again then 'retry' else 'dead' end as outcome, case when again then least(300.0::double, 2 * pow(4, attempt - 1)) end as delay_cap_s from g""",
    "delay_caps": f"with {_JOBS} select job_id, least(300.0::double, 2 * pow(4, attempt - 1)) as cap from jobs",
    "throttled_events": _bucket("user_id", 3.0, "(1 / 7200.0::double)"),
    "throttled_types": _bucket("event_type", 5.0, "(1 / 3000.0::double)"),
}
