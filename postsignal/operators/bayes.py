"""Multinomial naive Bayes as a table of term counts.

Training is one aggregation: occurrences of each term by label. Scoring joins the terms of a document with
that table and sums smoothed log shares, combined on the map side; documents and terms are never collected,
and the counts of two training sets add up to those of both. Labels are taken to be few: their totals are
collected. Terms need not be counted by document first, since both sums take each occurrence alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.operators.rows import join_keyed
from postsignal.runtime import written


@dataclass(frozen=True)
class BayesModel:
    """``terms`` (term, label, n) and ``labels`` (label, docs, n); ``alpha`` is added to every count."""

    terms: DataFrame
    labels: DataFrame
    alpha: float


#: At most so many terms of the model are sent to every task, the most frequent ones; only the others are dealt out.
SENT_TERMS = 300_000


def fit(counts: DataFrame, labels: DataFrame, alpha: float = 1.0) -> BayesModel:
    """From ``counts`` (doc, term, tf) and ``labels`` (doc, label); documents without label or null labels teach nothing.

    A term of a document may have several rows. ``counts`` may bring ``label`` itself, and is then not joined.
    """
    known = labels.filter("label is not null").select("doc", "label")
    taught = counts.filter("label is not null") if "label" in counts.columns else counts.join(known, "doc")
    terms = written(taught.groupBy("term", "label").agg(F.sum("tf").alias("n")), "label-terms")
    docs = known.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    sums = terms.groupBy("label").agg(F.sum("n").alias("n"))
    return BayesModel(terms, written(docs.join(sums, "label", "left").select("label", "docs", F.coalesce("n", F.lit(0)).alias("n")), "label-sums"), alpha)


def posteriors(model: BayesModel, counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, label, probability) of every document of ``docs`` (doc) and every label.

    Terms that training has not seen are ignored; a document without known terms gets the shares of the
    labels. A label lacks most terms, so each document starts from the sum as if its labels lacked all, and
    only the terms that a label has add to it: one join with a row for each term, summed by document. Frequent
    terms are sent to the tasks, so the occurrences of a common word are not dealt to one of them.
    A term of a document may have several rows in ``counts`` (doc, term, tf).
    """
    size = model.terms.select("term").distinct().count()  # the vocabulary
    total = model.labels.agg(F.sum("docs")).scalar()
    per_label = model.labels.select(
        "label", F.ln(F.col("docs") / total).alias("prior"), F.ln(F.lit(model.alpha)).alias("absent"), F.ln(F.col("n") + model.alpha * size).alias("whole"), "n"
    )
    kind = model.labels.schema["label"].dataType
    listed = per_label.orderBy("label").collect()  # labels are few
    if not listed:
        return docs.limit(0).select("doc", F.lit(None).cast(kind).alias("label"), F.lit(None).cast("double").alias("probability"))
    gain = F.ln((F.col("n") + model.alpha) / model.alpha)
    own = [F.coalesce(F.sum(F.when(F.col("label") == F.lit(r["label"]), gain)), F.lit(0.0)).alias(f"_g{i}") for i, r in enumerate(listed)]
    gains = written(model.terms.groupBy("term").agg(F.sum("n").alias("_n"), *own), "term-gains")
    if size <= SENT_TERMS:
        met = counts.join(F.broadcast(gains), "term")
    else:  # fewer terms than SENT_TERMS occur more often than this
        met = join_keyed(counts, gains, ["term"], "_n", hot=sum(r["n"] for r in listed) // SENT_TERMS)
    hits = met.groupBy("doc").agg(
        F.sum("tf").alias("_length"), *[F.sum(F.col("tf") * F.col(f"_g{i}")).alias(f"_h{i}") for i in range(len(listed))]
    )
    length = F.coalesce("_length", F.lit(0))
    logs = [F.lit(r["prior"]) + length * F.lit(r["absent"] - r["whole"]) + F.coalesce(f"_h{i}", F.lit(0.0)) for i, r in enumerate(listed)]
    held = docs.select("doc").join(hits, "doc", "left").select("doc", F.array(*logs).alias("_logs"))
    shares = held.select("doc", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))).alias("_shares"))
    whole = F.aggregate("_shares", F.lit(0.0), lambda acc, x: acc + x)
    cells = [F.struct(F.lit(r["label"]).cast(kind).alias("label"), (F.element_at("_shares", i + 1) / whole).alias("probability")) for i, r in enumerate(listed)]
    return shares.select("doc", F.explode(F.array(*cells)).alias("_l")).select("doc", "_l.label", "_l.probability")
