"""Naive Bayes, evaluation of rankings and probabilities, diverse lists and lifecycle plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsignal.catalog import base as b
from postsignal.operators import bayes as B
from postsignal.operators import diversity as DV
from postsignal.operators import evaluation as E
from postsignal.operators import learning as L
from postsignal.operators import ordered as O
from postsignal.operators import retention as RT
from postsignal.operators.rows import exploded
from postsignal.operators.samples import uniform
from postsignal.operators.similarity import word_terms
from postsignal.policies import DataClass, LifecyclePolicy
from postsignal.runtime import written
from postsignal.sources import adapters as A

HELD = 0.25  # share of documents that the classifier does not learn from


def _held_out(doc_id="doc_id"):
    return uniform(F.col(doc_id), 11) < HELD


def _words(docs, *keep):
    """Every word of ``docs`` (doc, text) as a row; the sums of the classifier need no counts by document."""
    return exploded(docs, word_terms(F.col("text")), "term", "doc", *keep).withColumn("tf", F.lit(1).cast("long"))


def _quality(spark, sf, only=None):
    """Probability of quality 1, from the words of the labelled documents; of all documents, or those in ``only`` (doc)."""
    docs = A.text_table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    labels = A.table(spark, sf, "labels").filter(~_held_out()).select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))
    model = B.fit(_words(docs.filter(~_held_out("doc")).join(labels, "doc"), "label"), labels)
    scored = docs if only is None else docs.join(only, "doc", "left_semi")
    found = B.posteriors(model, _words(scored), scored.select("doc")).filter("label = 1")
    p = F.round("probability", 6)
    return found.select(F.col("doc").alias("doc_id"), p.alias("probability"), (p >= 0.5).cast("long").alias("predicted"), _held_out("doc").alias("held_out"))


def bayes_quality(spark, sf):
    """Probability of quality 1 for every document, from the words of the labelled ones."""
    return _quality(spark, sf)


def _tested(spark, sf):
    """The labelled documents that the classifier has not learned from; only these are scored."""
    labels = A.table(spark, sf, "labels").select("doc_id", "quality").filter(_held_out())
    langs = A.table(spark, sf, "documents").select("doc_id", "lang")
    return _quality(spark, sf, labels.select(F.col("doc_id").alias("doc"))).join(labels, "doc_id").join(langs, "doc_id")


def bayes_calibration(spark, sf):
    """Brier score and calibration error of the classifier on documents it has not learned from."""
    found = E.calibration(_tested(spark, sf), ["lang"], "probability", "quality")
    return found.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "ece", "mce")])


def bayes_reliability(spark, sf):
    found = E.reliability(_tested(spark, sf), ["lang"], "probability", "quality", bins=5)
    return found.select("lang", "bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("mean_outcome", 6).alias("mean_outcome"))


def ranking_quality(spark, sf):
    """How well length ranks the labelled documents of a language by quality."""
    labels = A.table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + 1 - F.col("toxic")).alias("gain"))
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    found = E.ranking_metrics(docs, "lang", "doc_id", "n_chars", "gain")
    return found.select("lang", "items", "relevant", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall", "reciprocal_rank")])


def diverse_vectors(spark, sf):
    """Five vectors of each label that are typical of it and unlike each other."""
    items = DV.with_centroid_relevance(A.table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    found = DV.marginal_relevance(items, 5)
    return found.select(F.col("query").alias("label"), F.col("item").alias("vec_id"), "place", F.round("score", 6).alias("score"))


NOW = 1704067200 + 30 * 86400
LIFECYCLE = LifecyclePolicy((DataClass("view", 20 * 86400), DataClass("click", None, 5_000_000), DataClass("error", 25 * 86400, 6_000_000)), 40_000_000, 0.9, 0.7)


def lifecycle_plan(spark, sf):
    """Events as stored objects of five classes, those of some users pinned as evidence."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    objects = A.table(spark, sf, "events").select(
        F.col("event_id").alias("object_id"), F.col("event_type").alias("data_class"), F.floor(F.col("value") * 100).alias("byte_size"), seconds.alias("stored_at"),
        (seconds + F.col("event_id") * 7919 % 100_000).alias("last_accessed"), (F.col("user_id") % 10 == 0).alias("pinned"),
    )
    return RT.lifecycle_plan(objects, NOW, LIFECYCLE)


def source_posteriors(spark, sf):
    """Reliability of sources from quality labels, older documents counting less."""
    docs = A.table(spark, sf, "documents").select("doc_id", "source").join(A.table(spark, sf, "labels"), "doc_id")
    found = L.beta_posteriors(docs, "source", F.col("quality"), F.col("doc_id") % 365, 90.0)
    return found.select("source", "n", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "mean", "low", "high")])


def metric_deltas(spark, sf):
    """Change of the value from one event of a kind to the next."""
    rows = A.table(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    found = O.with_previous(rows, ["at", "value"], ["event_type"], ["at", "event_id"])
    hours = (F.col("at") - F.col("previous_at")) / 3.6e9
    return found.select(
        "event_id", F.round(F.col("value") - F.col("previous_value"), 6).alias("delta"), F.round(hours, 6).alias("hours"),
    )


QUERIES = {
    "source_posteriors": source_posteriors,
    "metric_deltas": metric_deltas,
    "bayes_quality": bayes_quality,
    "bayes_calibration": bayes_calibration,
    "bayes_reliability": bayes_reliability,
    "ranking_quality": ranking_quality,
    "diverse_vectors": diverse_vectors,
    "lifecycle_plan": lifecycle_plan,
}

_HELD = f"(('0x' || substr(sha256('11:' || doc_id::varchar), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double < {HELD}"
_BAYES = f"""tok as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{b.WORD}{{2,}}')) as term from documents), tf as (select doc_id, term, count(*) as tf from tok group by all),
  lab as (select doc_id, quality as label from labels where quality is not null and not ({_HELD})),
  tn as (select term, label, sum(tf)::bigint as n from tf join lab using (doc_id) group by all), v as (select count(distinct term) as size from tn),
  ls as (select label, count(*) as docs, (select coalesce(sum(n), 0)::bigint from tn where tn.label = lab.label) as n from lab group by label),
  pl as (select label, ln(docs / (select sum(docs) from ls)::double) as prior, -ln((n + size)::double) as base from ls, v),
  len as (select doc_id, sum(tf)::bigint as length from tf where term in (select term from tn) group by 1),
  gain as (select doc_id, label, sum(tf * ln((n + 1)::double)) as gain from tf join tn using (term) group by all),
  logs as (select d.doc_id, pl.label, prior + coalesce(length, 0) * base + coalesce(gain, 0.0::double) as log from documents d cross join pl left join len using (doc_id) left join gain g on g.doc_id = d.doc_id and g.label = pl.label),
  post as (select doc_id, label, exp(log - max(log) over (partition by doc_id)) / sum(exp(log - mx)) over (partition by doc_id) as p from (select *, max(log) over (partition by doc_id) as mx from logs)),
  scored as (select doc_id, round(p, 6) as probability, (round(p, 6) >= 0.5)::bigint as predicted, {_HELD} as held_out from post where label = 1),
  tested as (select s.*, l.quality, d.lang from scored s join labels l using (doc_id) join documents d using (doc_id) where held_out)"""
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def _cosine(x, y):
    return f"({_DOT.format(x, y)} / (sqrt({_DOT.format(x, x)}) * sqrt({_DOT.format(y, y)})))"


def _round(i):
    nearest = f"greatest({', '.join(_cosine('c.v', f'b{j}.v') for j in range(1, i))})" if i > 1 else "0.0::double"
    joins = " ".join(f"join r{j} b{j} on b{j}.label = c.label and b{j}.vec_id <> c.vec_id" for j in range(1, i))
    return f"""r{i} as materialized (select c.label, c.vec_id, c.v, {i} as place, round(0.7::double * rel - (1 - 0.7::double) * {nearest}, 9) as score from c {joins}
  qualify row_number() over (partition by c.label order by round(0.7::double * rel - (1 - 0.7::double) * {nearest}, 9) desc, c.vec_id) = 1)"""


SQL = {
    "source_posteriors": """with s as (select source, count(*) as n, 2 + sum(pow(0.5::double, (doc_id % 365) / 90.0::double) * quality) as alpha, 2 + sum(pow(0.5::double, (doc_id % 365) / 90.0::double) * (1 - quality)) as beta
          from documents join labels using (doc_id) where quality is not null group by source),
        m as (select *, alpha / (alpha + beta) as mean, 1.645::double * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) as spread from s)
        select source, n, round(alpha, 6) as alpha, round(beta, 6) as beta, round(mean, 6) as mean, round(greatest(0.0::double, mean - spread), 6) as low, round(least(1.0::double, mean + spread), 6) as high from m""",
    "metric_deltas": """select event_id, round(value - lag(value) over w, 6) as delta, round((epoch_us(ts) - lag(epoch_us(ts)) over w) / 3.6e9::double, 6) as hours
        from events window w as (partition by event_type order by epoch_us(ts), event_id)""",
    "bayes_quality": f"with {_BAYES} select * from scored",
    "bayes_calibration": f"""with {_BAYES}, cells as (select lang, least(floor(probability * 10), 9) as bin, count(*) as n, avg(probability) as mp, avg(quality) as my, sum((probability - quality) ** 2) as sq,
        sum(-quality * ln(greatest(1e-15::double, least(1 - 1e-15::double, probability))) - (1 - quality) * ln(1 - greatest(1e-15::double, least(1 - 1e-15::double, probability)))) as ll from tested group by all)
        select lang, sum(n)::bigint as n, round(sum(sq) / sum(n), 6) as brier, round(sum(ll) / sum(n), 6) as log_loss, round(sum(n * abs(mp - my)) / sum(n), 6) as ece, round(max(abs(mp - my)), 6) as mce from cells group by lang""",
    "bayes_reliability": f"""with {_BAYES} select lang, least(floor(probability * 5), 4)::bigint as bin, count(*) as n, round(avg(probability), 6) as mean_probability, round(avg(quality), 6) as mean_outcome from tested group by all""",
    "ranking_quality": """with j as (select doc_id, lang, n_chars, greatest(quality * 2 + 1 - toxic, 0)::double as gain from documents join labels using (doc_id)),
        r as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as place, row_number() over (partition by lang order by gain desc, doc_id) as best from j)
        select lang, count(*) as items, count(*) filter (gain > 0) as relevant, round(sum(gain / log2(place + 1)) filter (place <= 10) / sum(gain / log2(best + 1)) filter (best <= 10), 6) as ndcg,
          round(count(*) filter (place <= 10 and gain > 0) / 10.0::double, 6) as precision, round(count(*) filter (place <= 10 and gain > 0) / nullif(count(*) filter (gain > 0), 0)::double, 6) as recall,
          round(1.0::double / min(place) filter (gain > 0), 6) as reciprocal_rank from r group by lang""",
    "diverse_vectors": f"""with e as (select label, vec_id, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        m as (select label, list(x order by i) as mean from (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, len(v) + 1)) as i from e) group by all) group by label),
        c as materialized (select label, vec_id, v, {_cosine('v', 'mean')} as rel from e join m using (label)), {", ".join(_round(i) for i in range(1, 6))}
        select label, vec_id, place::bigint as place, round(score, 6) as score from ({" union all ".join(f"select * from r{i}" for i in range(1, 6))})""",
    "lifecycle_plan": f"""with o as (select event_id as object_id, event_type as data_class, greatest(floor(value * 100)::bigint, 0) as byte_size, epoch(date_trunc('second', ts))::bigint as stored_at,
          epoch(date_trunc('second', ts))::bigint + event_id * 7919 % 100000 as used, user_id % 10 = 0 as pinned from events),
        l(data_class, max_age, max_bytes) as (values {", ".join(f"('{c.name}', {c.max_age or 'null'}::bigint, {c.max_bytes or 'null'}::bigint)" for c in LIFECYCLE.classes)}),
        m as (select o.*, max_bytes, not pinned and coalesce(stored_at + max_age <= {NOW}, false) as expired from o left join l using (data_class)),
        c as (select *, case when pinned or expired then 0 else byte_size end as free, sum(case when expired then 0 else byte_size end) over (partition by data_class) as total from m),
        k as (select *, free > 0 and coalesce(total - coalesce(sum(free) over (partition by data_class order by used, object_id rows between unbounded preceding and 1 preceding), 0) > max_bytes, false) as budget from c),
        d as (select *, case when budget then 0 else free end as rest, sum(case when expired or budget then 0 else byte_size end) over () as kept from k),
        f as (select *, rest > 0 and kept > {LIFECYCLE.high_bytes} and kept - coalesce(sum(rest) over (order by used, object_id rows between unbounded preceding and 1 preceding), 0) > {LIFECYCLE.low_bytes} as disk from d)
        select object_id, data_class, byte_size, case when expired then 'class_expired' when budget then 'class_budget' else 'disk_watermark' end as reason from f where expired or budget or disk""",
}
