"""Text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.catalog import base as b
from postsignal.functions import text as X
from postsignal.operators import keywords as K
from postsignal.operators import lookups as J
from postsignal.operators.reports import analysed_posts
from postsignal.plans.signals import with_events
from postsignal.sources import adapters as A


def _docs(spark, sf):
    return A.text_table(spark, sf, "documents")


def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


def collapse_text(spark, sf):
    return _docs(spark, sf).select("doc_id", X.collapse_text(F.col("text")).alias("cleaned"))


def combined_context(spark, sf):
    turns = A.quoted_turns(spark, sf)
    return turns.select(
        "conv_id", "turn",
        X.combined_context(F.col("text"), F.col("quoted_text"), F.array("role"), F.array(F.lit(""))).alias("context"),
    )


def language_and_tone(spark, sf):
    return _docs(spark, sf).select(
        "doc_id",
        X.detect_language(F.col("text")).alias("language"),
        X.infer_tone(F.col("text"), b.HUMOR, b.REACTION).alias("tone"),
    )


def text_quality(spark, sf):
    staged = _docs(spark, sf).select("doc_id", X.quality_issues(F.col("text"), 2000, 300, 2, b.PHRASES).alias("i"))
    return staged.select(
        "doc_id",
        F.array_join("i", ";").alias("issues"),
        X.quality_score(F.col("i")).alias("score"),
        (F.size("i") == 0).alias("passed"),
    )


def categories(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join(X.classify_text(X.collapse_text(F.col("text"))), ",").alias("categories")
    )


def sentiment(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.round(X.estimate_sentiment(F.col("text"), b.POSITIVE, b.NEGATIVE), 6).alias("sentiment")
    )


def keyword_hits(spark, sf):
    return _docs(spark, sf).select("doc_id", X.keyword_hits(F.col("text"), b.ACCOUNT_KEYWORDS).cast("long").alias("hits"))


def events(spark, sf):
    return with_events(A.posts(spark, sf), b.LEXICON).select("post_id", "event_type", "title", "summary", "source_count")


def topic_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(X.topic_terms(F.col("text"), b.TOPICS), ",").alias("terms"))


def quote_risk(spark, sf):
    return A.quoted_turns(spark, sf).select(
        "conv_id", "turn", X.quote_context_risk(F.col("quoted_text"), b.QUOTE_RISK).alias("quote_risk")
    )


def summaries(spark, sf):
    suffix = K.style_suffix(A.table(spark, sf, "benchmark"), 5)
    docs = _docs(spark, sf).withColumn("_suffix", suffix.scalar())
    return docs.select("doc_id", X.summarize(F.col("text"), 150, 40, F.col("_suffix")).alias("summary"))


def handles(spark, sf):
    raw = F.concat(F.lit("  @@"), F.upper("source"), F.when(F.col("doc_id") % 2 == 0, "\t").otherwise(" "))
    raw = F.when(F.col("doc_id") % 10 == 0, F.lit(" @ ")).otherwise(raw)
    return _docs(spark, sf).select("doc_id", X.normalize_handle(raw).alias("handle"))


def lexicon_tags(spark, sf):
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("term")) for c, ts in b.RISK.items() for t in ts]))
    lexicon = spark.range(1).select(rows.alias("r")).select("r.*")
    return J.tag_with_terms(_docs(spark, sf), lexicon, ["doc_id"])


def analysis(spark, sf):
    out = analysed_posts(A.posts(spark, sf), positive=b.POSITIVE, negative=b.NEGATIVE)
    return out.select(
        "post_id", "cleaned_text", F.array_join("categories", ",").alias("categories"),
        F.round("sentiment", 6).alias("sentiment"),
        F.size("media").cast("long").alias("media_count"),
        F.coalesce(F.try_element_at(F.col("media")["type"], F.lit(1)), F.lit("-")).alias("first_type"),
    )


QUERIES = {
    "clean_text": clean_text,
    "collapse_text": collapse_text,
    "combined_context": combined_context,
    "language_and_tone": language_and_tone,
    "text_quality": text_quality,
    "categories": categories,
    "sentiment": sentiment,
    "keyword_hits": keyword_hits,
    "events": events,
    "topic_terms": topic_terms,
    "quote_risk": quote_risk,
    "summaries": summaries,
    "handles": handles,
    "lexicon_tags": lexicon_tags,
    "analysis": analysis,
}

_TURNS = "turns as (select *, coalesce(lag(text) over (partition by conv_id order by turn), '') as quoted_text from conversations)"
_SENTIMENT = (
    "case when len(w) = 0 then 0.0::double else round((len(list_filter(w, lambda x: x in ({pos}))) - "
    "len(list_filter(w, lambda x: x in ({neg}))))::double / len(w), 6) end"
).format(pos=", ".join(map(b.lit, b.POSITIVE)), neg=", ".join(map(b.lit, b.NEGATIVE)))
_FOLDED = f"translate(lower(text), '{lx.FOLD_FROM}', '{lx.FOLD_TO}')"
_STYLE = f"""
style as (
  select string_agg(token, ' ' order by n desc, token) as suffix from (
    select token, count(*) as n from (
      select unnest(regexp_extract_all(lower(text), '{b.WORD}+')) as token from benchmark)
    where length(token) > 2 and token not in ({", ".join(map(b.lit, lx.STYLE_STOPWORDS))})
    group by token order by n desc, token limit 5)
)"""
_ISSUES = f"""list_filter([
    case when {b.sql_words('text')} = 0 then 'empty_text' end,
    case when length(text) > 2000 then 'too_long' end,
    case when len(found) > 0 then 'ai_or_news_phrases:' || array_to_string(found, ',') end,
    case when length(text) - length(replace(text, '#', '')) > 2 then 'too_many_hashtags' end,
    case when {b.sql_words('text')} > 300 then 'too_explanatory' end], lambda x: x is not null)"""

SQL = {
    "clean_text": f"select doc_id, {b.sql_clean('text')} as cleaned from documents",
    "collapse_text": f"select doc_id, {b.sql_collapse('text')} as cleaned from documents",
    "combined_context": f"""
        with {_TURNS}
        select conv_id, turn, {b.sql_clean("concat_ws(' ', nullif(text, ''), nullif(quoted_text, ''), role)")} as context
        from turns""",
    "language_and_tone": f"""
        with d as (select doc_id, lower(text) as low from documents)
        select doc_id,
          case when regexp_matches(low, '[{lx.TURKISH_LETTERS}]')
            or len(list_filter({b.sql_tokens('low')}, lambda x: x in ({", ".join(map(b.lit, lx.TURKISH_WORDS))}))) > 0
            then 'tr' else 'unknown' end as language,
          case when {b.sql_any('low', b.HUMOR)} then 'dry_humor' when {b.sql_any('low', b.REACTION)} then 'reaction'
            when {b.sql_words('low')} < 12 then 'neutral_short' else 'fan_voice' end as tone
        from d""",
    "text_quality": f"""
        with d as (select doc_id, text, {b.sql_terms('lower(text)', b.PHRASES)} as found from documents),
        i as (select doc_id, {_ISSUES} as i from d)
        select doc_id, array_to_string(i, ';') as issues, greatest(0.0, 100.0 - 20.0 * len(i))::double as score, len(i) = 0 as passed
        from i""",
    "categories": f"""
        with d as (select doc_id, lower({b.sql_collapse('text')}) as low from documents)
        select doc_id, array_to_string({b.sql_tags('low', lx.CATEGORY_KEYWORDS)}, ',') as categories from d""",
    "sentiment": f"""
        with d as (select doc_id, regexp_extract_all(lower(text), '{b.WORD}+') as w from documents)
        select doc_id, {_SENTIMENT} as sentiment from d""",
    "keyword_hits": f"""
        with d as (select doc_id, {_FOLDED} as low from documents)
        select doc_id, {b.sql_count('low', b.ACCOUNT_KEYWORDS)}::bigint as hits from d""",
    "events": f"""
        with {b.SQL_POSTS}, c as (select post_id, {b.sql_context()} as context from posts)
        select post_id, {b.sql_event('lower(context)')} as event_type, substr(context, 1, 80) as title,
          substr(context, 1, 240) as summary, 1::bigint as source_count from c""",
    "topic_terms": f"""
        with d as (select doc_id, lower({b.sql_clean('text')}) as low from documents)
        select doc_id, array_to_string({b.sql_terms('low', sorted(b.TOPICS))}, ',') as terms from d""",
    "quote_risk": f"""
        with {_TURNS}
        select conv_id, turn, least(100.0, 20.0 * {b.sql_count('lower(quoted_text)', b.QUOTE_RISK)})::double as quote_risk from turns""",
    "summaries": f"""
        with {_STYLE}, d as (select doc_id, text, {b.sql_tokens('text')} as w from documents)
        select doc_id, case when len(w) < 40 then text else
          array_to_string(w[1:150], ' ') || case when len(w) > 150 then '...' else '' end
          || coalesce(' | ' || suffix, '') end as summary from d, style""",
    "handles": f"""
        select doc_id, nullif(lower(ltrim({b.sql_strip("case when doc_id % 10 = 0 then ' @ ' else '  @@' || upper(source) || chr(case when doc_id % 2 = 0 then 9 else 32 end) end")}, '@')), '') as handle
        from documents""",
    "lexicon_tags": f"select doc_id, unnest({b.sql_tags('lower(text)', b.RISK)}) as category from documents",
    "analysis": f"""
        with {b.SQL_POSTS}, c as (
          select post_id, n_media, doc_id,
            {b.sql_collapse("(text || case when alt <> '' then repeat(' ' || alt, n_media) else '' end)")} as cleaned_text from posts),
        t as (select *, regexp_extract_all(lower(cleaned_text), '{b.WORD}+') as w from c)
        select post_id, cleaned_text,
          array_to_string({b.sql_tags('lower(cleaned_text)', lx.CATEGORY_KEYWORDS)}, ',') as categories,
          {_SENTIMENT} as sentiment, n_media::bigint as media_count,
          case when n_media = 0 then '-' when doc_id % 5 = 0 then 'video' else 'image' end as first_type
        from t""",
}
