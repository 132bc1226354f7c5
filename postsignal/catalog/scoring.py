"""Scores, decisions, accounts and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.catalog import base as b
from postsignal.functions import scores as C
from postsignal.operators import accounts as AC
from postsignal.operators import drafts as D
from postsignal.operators import learning as L
from postsignal.plans.signals import decision_summary, post_signals
from postsignal.policies import SignalDefaults
from postsignal.sources import adapters as A


def _signals(spark, sf):
    return post_signals(A.posts(spark, sf), b.LEXICON)


def decisions(spark, sf):
    return decision_summary(_signals(spark, sf))


def signals(spark, sf):
    return _signal_columns(_signals(spark, sf))


def quoted_signals(spark, sf):
    """Conversation turns as posts that quote the turn before."""
    turns = A.quoted_turns(spark, sf)
    media = F.array().cast("array<struct<media_type: string, source_url: string, alt_text: string, ocr_text: string, copyright_status: string>>")
    posts = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("post_id"), F.col("role").alias("author_handle"), "text", "quoted_text", media.alias("media"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
    )
    return _signal_columns(post_signals(posts, b.LEXICON))


def quoted_decisions(spark, sf):
    return quoted_signals(spark, sf).groupBy("decision", "event_type").agg(F.count(F.lit(1)).alias("posts"))


def _signal_columns(signals):
    return signals.select(
        "post_id", "event_type", "media_context", "media_risk", "quote_risk",
        F.array_join("risk_issues", ",").alias("risk_issues"),
        F.round("risk_score", 6).alias("risk_score"),
        F.round("event_score", 6).alias("event_score"),
        F.round("candidate_score", 6).alias("candidate_score"),
        "decision",
    )


def tiered_decisions(spark, sf):
    """Source reliability learned from labels, novelty and velocity from the data: all tiers occur."""
    posts = A.posts(spark, sf)
    sources = A.table(spark, sf, "documents").select("source").distinct().withColumn(
        "source_type", F.when(F.substring("source", -1, 1) == "0", "official_club").otherwise("fan")
    )
    learned = L.folded_reliability(A.observations(spark, sf), sources).select(
        F.col("source").alias("author_handle"), F.col("value").alias("source_reliability")
    )
    enriched = (
        posts.join(learned, "author_handle", "left")
        .withColumn("source_count_score", F.least(F.lit(100.0), F.col("followers_count") / 20.0))
        .withColumn("velocity_score", F.least(F.lit(100.0), F.col("followers_count") / 10.0))
        .withColumn("novelty_score", F.when(F.col("lang") == "en", 40.0).otherwise(100.0))
    )
    scored = post_signals(enriched, b.LEXICON, SignalDefaults())
    return scored.groupBy("decision", "lang").agg(
        F.count(F.lit(1)).alias("posts"), F.round(F.avg("event_score"), 6).alias("mean_score")
    )


def source_candidates(spark, sf):
    out = AC.account_candidates(_signals(spark, sf))
    return out.withColumn("candidate_score", F.round("candidate_score", 6))


def score_formulas(spark, sf):
    """Event score, account score, decision and reliability step on numeric inputs."""
    o = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"
    )
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    inputs = o.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
        C.event_score(
            source_reliability=q * 2, source_count_score=p / 500, velocity_score=F.col("l_tax") * 1000,
            risk_score=F.col("l_discount") * 900, fatigue_score=q,
        ).alias("event_score"),
        C.account_score(
            football_relevance=q * 2, early_signal_quality=p / 600, media_context_quality=F.col("l_tax") * 1000,
            quote_context_quality=q, misinformation_risk=F.col("l_discount") * 300,
        ).alias("account_score"),
        C.clamp(F.col("l_discount") * 900).alias("risk"),
    )
    out = inputs.select(
        C.decision_label(F.col("event_score"), F.col("risk")).alias("decision"),
        C.account_action(F.col("account_score")).alias("action"),
        C.updated_reliability(F.col("event_score"), F.col("account_score")).alias("reliability"),
        C.updated_weight(F.col("l_quantity") / 25, F.col("risk") / 20 - 1).alias("weight"),
        "event_score", "account_score",
    )
    return out.groupBy("decision", "action").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("event_score"), 5).alias("event_score"),
        F.round(F.avg("account_score"), 5).alias("account_score"),
        F.round(F.avg("reliability"), 5).alias("reliability"),
        F.round(F.avg("weight"), 5).alias("weight"),
    )


_TYPES = ["official_club", "Journalist", "stats", "FAN", "meme", "candidate", "", "other"]


def reliability_and_reward(spark, sf):
    d = A.table(spark, sf, "events")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("user_id") % 8 + 1).cast("int"))
    actions = A.feedback(spark, sf)
    joined = d.select("event_id", C.initial_reliability(kind).alias("reliability")).join(
        actions.select("event_id", C.feedback_reward(F.col("action")).alias("reward"), "action"), "event_id"
    )
    return joined.groupBy("action", "reliability", "reward").agg(F.count(F.lit(1)).alias("n"))


def candidate_accounts(spark, sf):
    """Authors of all posts about a keyword, by mean reach score."""
    out = AC.select_candidates(A.posts(spark, sf), "tion", sample_size=None, top_n=10, lang="en")
    return out.withColumn("score", F.round("score", 6))


def sampled_candidates(spark, sf):
    out = AC.select_candidates(A.posts(spark, sf), "tion", sample_size=50, top_n=10, lang="en")
    return out.withColumn("score", F.round("score", 6))


def relevant_accounts(spark, sf):
    out = AC.relevant_accounts(A.posts(spark, sf), 10, b.ACCOUNT_KEYWORDS)
    return out.withColumn("score", F.round("score", 6))


def drafts(spark, sf):
    s = _signals(spark, sf).withColumn("topic", F.col("author_handle")).withColumn("minute", F.col("ordinal") % 91)
    rows = D.draft_rows(D.with_drafts(s), "post_id")
    return rows.select(
        "post_id", F.col("position").cast("long").alias("position"), "text", "variant_label", "quality_score",
        F.array_join("issues", ",").alias("issues"),
    )


QUERIES = {
    "decisions": decisions,
    "signals": signals,
    "quoted_signals": quoted_signals,
    "quoted_decisions": quoted_decisions,
    "tiered_decisions": tiered_decisions,
    "source_candidates": source_candidates,
    "score_formulas": score_formulas,
    "reliability_and_reward": reliability_and_reward,
    "candidate_accounts": candidate_accounts,
    "sampled_candidates": sampled_candidates,
    "relevant_accounts": relevant_accounts,
    "drafts": drafts,
}


def _sql_signals(extra: str = "", rel="65.0", cnt="30.0", vel="45.0", nov="60.0") -> str:
    return f"""{b.SQL_POSTS}, ctx as (select p.*, {b.sql_context()} as context from posts p),
  ev as (select *, {b.sql_event('lower(context)')} as event_type, lower(substr(context, 1, 240)) as low from ctx),
  rk as (select *, case when n_media = 0 then 0.0::double else least(100.0, 30.0 + case when alt <> '' then 20.0 * n_media else 0 end)::double end as media_context,
    case when n_media = 0 then 0.0::double else 55.0::double end as media_risk, 0.0::double as quote_risk,
    {b.sql_tags('low', b.RISK)} as issues, {b.sql_any('low', b.CLAIMS)} as claim from ev),
  rs as (select *, least(100.0::double, 18.0::double * len(issues) + 0.35::double * media_risk + 0.25::double * quote_risk) as risk_score from rk),
  sc as (select *,
    {b.sql_clamp(f"0.25::double * {rel} + 0.20::double * {cnt} + 0.15::double * {vel} + 0.15::double * (case when event_type <> 'other' then 80.0 else 30.0 end)::double + 0.10::double * {nov} + 0.10::double * media_context - 0.20::double * risk_score")} as event_score,
    {b.sql_clamp("0.25::double * (case when event_type <> 'other' then 80 else 20 end) + 0.20::double * 40 + 0.15::double * media_context + 0.10::double * 70 + 0.10::double * 50 - 0.20::double * (case when claim then 30 else 0 end)")} as candidate_score
    from rs {extra}),
  sig as (select *, case when risk_score >= 81 then 'block' when risk_score >= 61 then 'human_review' when event_score >= 75 then 'high_priority_suggestion'
    when event_score >= 60 then 'normal_suggestion' when event_score >= 40 then 'watch' else 'archive' end as decision from sc)"""


_ACTION = "case when {0} >= 70 then 'approve_candidate' when {0} >= 45 then 'watch_one_week' else 'reject_or_ignore' end"
_FEEDBACK = """feedback as (select event_id, ts, user_id as suggestion_id,
    case event_type when 'purchase' then 'posted_manually' when 'signup' then 'approved' when 'click' then 'edited' when 'view' then 'ignored' when 'error' then 'rejected' end as action,
    case user_id % 4 when 0 then 'reaction' when 1 then 'dry_humor' when 2 then 'neutral_short' else 'quote_context' end as variant_label from events),
  rewarded as (select *, 'tone.' || variant_label as key, case action when 'approved' then 1.0 when 'posted_manually' then 1.2 when 'edited' then 0.4 when 'ignored' then -0.2 when 'rejected' then -1.0 else 0.0 end::double as reward from feedback)"""
_RELIABILITY = """obs as (select source, list(quality * 100.0::double order by doc_id) as xs from documents join labels using (doc_id) group by source),
  learned as (select source as author_handle, list_reduce(list_prepend(case when right(source, 1) = '0' then 90.0::double else 45.0::double end, xs),
    lambda a, x: greatest(0.0::double, least(100.0::double, a * 0.85::double + x * 0.15::double))) as rel from obs)"""


def _sql_candidates(sample: str) -> str:
    return f"""
        with found as (select doc_id, source, lower(text) as low, n_chars from documents where lang = 'en' and contains(lower(text), 'tion') {sample}),
        tok as (select t, count(*) as n from (select unnest(regexp_extract_all(low, '{b.NWS}+')) as t from found) where length(t) > 2 group by t order by n desc, t limit 15),
        kw as (select distinct k from (select t as k from tok union all select 'tion')),
        hits as (select doc_id, count(*) as h from found, kw where contains(low, k) group by doc_id)
        select source as author_handle, round(avg(log10(n_chars + 1) + case when doc_id % 3 > 0 then 1.0 else 0.0 end::double + case when doc_id % 4 = 0 then 0.5 else 0.0 end::double + 0.3::double * coalesce(h, 0)), 6) as score
        from found left join hits using (doc_id) group by source order by score desc, source limit 10"""


def _fold_count(text: str) -> str:
    return b.sql_count(f"translate(lower({text}), '{lx.FOLD_FROM}', '{lx.FOLD_TO}')", b.ACCOUNT_KEYWORDS)


def _sql_drafts() -> str:
    def quality(text: str) -> str:
        return f"""list_filter([case when {b.sql_words(text)} = 0 then 'empty_text' end, case when length({text}) > 280 then 'too_long' end,
          case when len({b.sql_terms(f'lower({text})', lx.STOCK_PHRASES)}) > 0 then 'ai_or_news_phrases' end,
          case when {b.sql_words(text)} > 38 then 'too_explanatory' end], lambda x: x is not null)"""

    rows = ", ".join(
        f"({v}, {b.lit(name)}, {t}, {b.lit(tpl)})"
        for v, name in enumerate(lx.DRAFT_VARIANTS)
        for t, tpl in enumerate(lx.DRAFT_TEMPLATES[name])
    )
    return f"""
        with {_sql_signals()}, tpl(v, variant_label, t, raw) as (values {rows}),
        filled as (select post_id, risk_score, v, variant_label, t, replace(replace(raw, '{{topic}}', author_handle), '{{minute}}', (doc_id % 91)::varchar) as text from sig, tpl),
        pass as (select *, row_number() over (partition by post_id, v order by t) as r from filled where len({quality('text')}) = 0),
        pick as (select post_id, v, variant_label, text, row_number() over (partition by post_id, text order by v) as rep from pass where r = 1 and risk_score < 61),
        num as (select *, row_number() over (partition by post_id order by v) - 1 as position from pick where rep = 1)
        select post_id, position::bigint as position, text, variant_label, 100.0::double as quality_score, '' as issues from num where position < 3
        union all
        select post_id, 0::bigint, {b.lit(lx.DO_NOT_POST_TEXT)}, 'do_not_post', 100.0::double, 'risk_review_required' from sig where risk_score >= 61"""


_QUOTED = f"""turns as (select conv_id || '-' || turn as post_id, text, coalesce(lag(coalesce(text, '')) over (partition by conv_id order by turn), '') as quoted_text from conversations),
  ctx as (select *, {b.sql_clean("concat_ws(' ', nullif(text, ''), nullif(quoted_text, ''))")} as context from turns),
  ev as (select *, {b.sql_event('lower(context)')} as event_type, lower(substr(context, 1, 240)) as low from ctx),
  rk as (select *, least(100.0, 20.0 * {b.sql_count('lower(quoted_text)', b.QUOTE_RISK)})::double as quote_risk, {b.sql_tags('low', b.RISK)} as issues, {b.sql_any('low', b.CLAIMS)} as claim from ev),
  rs as (select *, least(100.0::double, 18.0::double * len(issues) + 0.25::double * quote_risk) as risk_score from rk),
  sc as (select *,
    {b.sql_clamp("0.25::double * 65.0 + 0.20::double * 30.0 + 0.15::double * 45.0 + 0.15::double * (case when event_type <> 'other' then 80.0 else 30.0 end)::double + 0.10::double * 60.0 - 0.20::double * risk_score")} as event_score,
    {b.sql_clamp("0.25::double * (case when event_type <> 'other' then 80 else 20 end) + 0.20::double * 40 + 0.15::double * (case when quoted_text <> '' then 60 else 0 end) + 0.10::double * 70 + 0.10::double * 50 - 0.20::double * (case when claim then 30 else 0 end)")} as candidate_score
    from rs),
  sig as (select *, case when risk_score >= 81 then 'block' when risk_score >= 61 then 'human_review' when event_score >= 75 then 'high_priority_suggestion'
    when event_score >= 60 then 'normal_suggestion' when event_score >= 40 then 'watch' else 'archive' end as decision from sc)"""

SQL = {
    "quoted_signals": f"""with {_QUOTED} select post_id, event_type, 0.0::double as media_context, 0.0::double as media_risk, quote_risk, array_to_string(issues, ',') as risk_issues,
        round(risk_score, 6) as risk_score, round(event_score, 6) as event_score, round(candidate_score, 6) as candidate_score, decision from sig""",
    "quoted_decisions": f"with {_QUOTED} select decision, event_type, count(*) as posts from sig group by all",
    "decisions": f"with {_sql_signals()} select decision, event_type, count(*) as posts from sig group by all",
    "signals": f"""with {_sql_signals()} select post_id, event_type, media_context, media_risk, quote_risk, array_to_string(issues, ',') as risk_issues,
        round(risk_score, 6) as risk_score, round(event_score, 6) as event_score, round(candidate_score, 6) as candidate_score, decision from sig""",
    "tiered_decisions": f"""with {_RELIABILITY}, {_sql_signals(
        'left join learned using (author_handle)', 'coalesce(rel, 65.0)',
        'least(100.0, n_chars / 20.0)', 'least(100.0, n_chars / 10.0)', "(case when lang = 'en' then 40.0 else 100.0 end)")}
        select decision, lang, count(*) as posts, round(avg(event_score), 6) as mean_score from sig group by all""",
    "source_candidates": f"""with {_sql_signals()} select author_handle, round(candidate_score, 6) as candidate_score, text as example_post, {_ACTION.format('candidate_score')} as action
        from sig qualify row_number() over (partition by author_handle order by doc_id desc) = 1""",
    "score_formulas": f"""
        with i as (select l_quantity as q,
          {b.sql_clamp("0.25::double * (l_quantity * 2) + 0.20::double * (l_extendedprice / 500) + 0.15::double * (l_tax * 1000) + 0.15::double * 50 + 0.10::double * 50 - 0.20::double * (l_discount * 900) - 0.10::double * l_quantity")} as event_score,
          {b.sql_clamp("0.25::double * (l_quantity * 2) + 0.20::double * (l_extendedprice / 600) + 0.15::double * (l_tax * 1000) + 0.15::double * l_quantity - 0.20::double * (l_discount * 300)")} as account_score,
          {b.sql_clamp("l_discount * 900")} as risk from lineitem)
        select case when risk >= 81 then 'block' when risk >= 61 then 'human_review' when event_score >= 75 then 'high_priority_suggestion'
            when event_score >= 60 then 'normal_suggestion' when event_score >= 40 then 'watch' else 'archive' end as decision,
          {_ACTION.format('account_score')} as action, count(*) as n, round(avg(event_score), 5) as event_score, round(avg(account_score), 5) as account_score,
          round(avg({b.sql_clamp("event_score * 0.85::double + account_score * 0.15::double")}), 5) as reliability,
          round(avg(greatest(0.2::double, least(2.0::double, q / 25 + 0.05::double * (risk / 20 - 1)))), 5) as weight
        from i group by 1, 2""",
    "reliability_and_reward": f"""with {_FEEDBACK}
        select action, (case user_id % 8 when 0 then 90.0 when 1 then 75.0 when 2 then 70.0 when 3 then 45.0 when 4 then 40.0 when 5 then 35.0 else 30.0 end)::double as reliability,
          reward, count(*) as n from rewarded join events using (event_id) group by all""",
    "candidate_accounts": _sql_candidates(""),
    "sampled_candidates": _sql_candidates("order by doc_id desc limit 50"),
    "relevant_accounts": f"""with {b.SQL_POSTS}
        select author_handle, round(avg({_fold_count('text')} + 2.0::double * n_media * {_fold_count('alt')}), 6) as score from posts group by author_handle order by score desc, author_handle limit 10""",
    "drafts": _sql_drafts(),
}
