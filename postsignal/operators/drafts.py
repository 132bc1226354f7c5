"""Draft texts from templates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.operators.rows import exploded
from postsignal.functions.text import first_filled, quality_issues, quality_score


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenation of the template's literal parts and the named columns."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols) if len(cols) > 1 else cols[0]


def first_passing(templates: Sequence[str], values: Mapping[str, Column], fallback: str) -> Column:
    """First filled template without quality findings, else the fallback: struct (text, issues)."""
    none = F.array().cast("array<string>")
    tries = []
    for template in templates:
        text = fill_template(template, values)
        passed = F.struct(text.alias("text"), none.alias("issues"))
        tries.append(F.when(F.size(quality_issues(text)) == 0, passed))
    last = F.lit(fallback)
    return F.coalesce(*tries, F.struct(last.alias("text"), quality_issues(last).alias("issues")))


def with_drafts(
    events: DataFrame,
    max_variants: int = 3,
    templates: Mapping[str, Sequence[str]] | None = None,
    variants: Sequence[str] = tuple(lx.DRAFT_VARIANTS),
    topic: Sequence[str] = ("team", "topic"),
    minute: str = "minute",
    risk: str = "risk_score",
    risk_limit: float = 61.0,
) -> DataFrame:
    """Add ``drafts``: up to ``max_variants`` different texts in variant order.

    Above the risk limit there is a single ``do_not_post`` entry. The templates are a constant
    of the job, so they are expanded as expressions; no join is needed.
    """
    templates = templates if templates is not None else lx.DRAFT_TEMPLATES
    topics = [F.col(c).cast("string") for c in topic if c in events.columns]
    values = {
        "topic": F.coalesce(first_filled(*topics) if topics else F.lit(None).cast("string"), F.lit(lx.DEFAULT_TOPIC)),
        "minute": F.coalesce(
            F.nullif(F.col(minute).cast("string"), F.lit("")) if minute in events.columns else F.lit(None).cast("string"),
            F.lit(lx.DEFAULT_MINUTE),
        ),
    }
    fallback = templates["neutral_short"][1]
    staged = events
    for i, variant in enumerate(variants):
        draft = first_passing(templates.get(variant, templates["neutral_short"]), values, fallback)
        staged = staged.withColumn(f"_draft{i}", draft)
    entries = []
    for i, variant in enumerate(variants):
        draft = F.col(f"_draft{i}")
        text = draft["text"]
        entry = F.struct(
            text.alias("text"),
            F.lit(variant).alias("variant_label"),
            quality_score(draft["issues"]).alias("quality_score"),
            draft["issues"].alias("issues"),
        )
        repeated = F.lit(False)
        for j in range(i):
            repeated = repeated | (text == F.col(f"_draft{j}")["text"])
        entries.append(F.when(~repeated, entry))
    blocked = F.array(
        F.struct(
            F.lit(lx.DO_NOT_POST_TEXT).alias("text"),
            F.lit("do_not_post").alias("variant_label"),
            F.lit(100.0).alias("quality_score"),
            F.array(F.lit("risk_review_required")).alias("issues"),
        )
    )
    drafts = F.slice(F.array_compact(F.array(*entries)), 1, max_variants)
    return staged.withColumn(
        "drafts", F.when(F.col(risk) >= risk_limit, blocked).otherwise(drafts)
    ).drop(*[f"_draft{i}" for i in range(len(variants))])


def draft_rows(drafted: DataFrame, *ids: str) -> DataFrame:
    """One row per draft with its position."""
    rows = exploded(drafted, F.col("drafts"), "_d", *ids, position="position")
    return rows.select(*ids, "position", "_d.*")
