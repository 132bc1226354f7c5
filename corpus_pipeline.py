"""From raw documents to token ids: five of the operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the documents of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.llm.common import stored, table
from postsignal.llm.exact_dedup import survivors
from postsignal.llm.jaccard_dedup import one_of_similar
from postsignal.llm.mixing import mixed_rows
from postsignal.llm.quality import fit, score
from postsignal.llm.sentencepiece_bpe import encode_texts


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of its own input."""
    shares = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, shares, names=("_score", "_good")).filter("_good = 1").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    return survivors(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id.

    SimHash values at most four bits apart and an index for looser copies give the pairs; exact sets of five-word
    shingles confirm those of similarity from 0.8.
    """
    return one_of_similar(docs).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    keep = [c for c in docs.columns if c not in ("ids", "decoded", "n_tokens", "lossless")]
    rows = encode_texts(docs, path, keep=keep, decoded=True)
    return rows.select(
        *keep,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("sentencepiece", coded),
]

#: A trained classifier, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
