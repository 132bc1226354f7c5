"""Text cleaning, lexicon tagging and text quality, as column expressions.

All expressions are Spark built-ins. Predicates over word lists are written as chains of
``contains`` and arrays of ``when``, which compile into the surrounding codegen stage;
lambda-based array functions would fall out of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsignal import lexicons as lx

# Unicode white space, plus the four separator controls that str.split() also accepts.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
# Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def words(col: Column) -> Column:
    """White-space separated tokens; no empty tokens."""
    return F.regexp_extract_all(text_or_empty(col), F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def word_count(col: Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(rf"{NOT_SPACE}+"))


def _terms(terms: Sequence[str]) -> list[str]:
    return [t for t in terms if t is not None]


def contains_any(low: Column, terms: Sequence[str]) -> Column:
    """True when the (already lower-cased) text contains one of the terms."""
    checks = [low.contains(t) for t in _terms(terms)]
    return F.coalesce(reduce(lambda a, b: a | b, checks, F.lit(False)), F.lit(False))


def count_contained(low: Column, terms: Sequence[str]) -> Column:
    """Number of distinct terms contained in the (already lower-cased) text."""
    checks = [F.when(low.contains(t), 1).otherwise(0) for t in dict.fromkeys(_terms(terms))]
    return reduce(lambda a, b: a + b, checks, F.lit(0))


def without_nulls(*items: Column) -> Column:
    """Array of the distinct non-null items, order kept."""
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def contained_terms(low: Column, terms: Sequence[str]) -> Column:
    """Terms contained in the (already lower-cased) text, in list order."""
    return without_nulls(*[F.when(low.contains(t), F.lit(t)) for t in _terms(terms)])


# ---------------------------------------------------------------- cleaning


def clean_text(col: Column) -> Column:
    """URLs to ``<url>``, zero-width spaces out, long punctuation runs to two, one-space."""
    out = F.regexp_replace(text_or_empty(col), rf"https?://{NOT_SPACE}+", "<url>")
    out = F.replace(out, F.lit("\u200b"), F.lit(""))
    out = F.regexp_replace(out, r"([!?.])\1{2,}", "$1$1")
    return F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))


def collapse_text(col: Column) -> Column:
    """The older cleaning rule: ASCII quotes, one-space, punctuation runs to one mark."""
    out = F.translate(text_or_empty(col), "“”‘’", "\"\"''")
    out = F.regexp_replace(out, rf"{SPACE}+", " ")
    return F.trim(F.regexp_replace(out, r"([!?.])\1+", "$1"))


def combined_context(
    text: Column,
    quoted_text: Column | None = None,
    alt_texts: Column | None = None,
    ocr_texts: Column | None = None,
) -> Column:
    """Clean text of post, quote, alternative texts and OCR texts joined by blanks."""
    parts = [F.nullif(text, F.lit(""))]
    if quoted_text is not None:
        parts.append(F.nullif(quoted_text, F.lit("")))
    parts += [F.array_remove(extra, "") for extra in (alt_texts, ocr_texts) if extra is not None]
    return clean_text(F.concat_ws(" ", *parts))


def normalize_handle(col: Column) -> Column:
    """Lower-case handle without surrounding space and leading ``@``; empty becomes null."""
    return F.nullif(F.lower(F.ltrim(strip(col), F.lit("@"))), F.lit(""))


# ---------------------------------------------------------------- tagging


def detect_language(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    token = low.rlike(f"(?<!{NOT_SPACE})(?:{'|'.join(lx.TURKISH_WORDS)})(?!{NOT_SPACE})")
    # the cheap substring test decides for most texts
    has_word = contains_any(low, lx.TURKISH_WORDS) & token
    return F.when(contains_any(low, lx.TURKISH_LETTERS) | has_word, "tr").otherwise("unknown")


def infer_tone(
    text: Column,
    humor: Sequence[str] = tuple(lx.DRY_HUMOR_WORDS),
    reaction: Sequence[str] = tuple(lx.REACTION_WORDS),
) -> Column:
    low = F.lower(text_or_empty(text))
    return (
        F.when(contains_any(low, humor), "dry_humor")
        .when(contains_any(low, reaction), "reaction")
        .when(word_count(low) < 12, "neutral_short")
        .otherwise("fan_voice")
    )


def event_type_of(low: Column, rules: Sequence[tuple[str, Sequence[str]]] | None = None) -> Column:
    """First rule whose terms occur in the lower-cased text decides; else ``other``."""
    out = None
    for label, terms in rules if rules is not None else lx.EVENT_RULES:
        cond = contains_any(low, terms)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("other") if out is not None else F.lit("other")


def infer_event_type(text: Column, rules: Sequence[tuple[str, Sequence[str]]] | None = None) -> Column:
    return event_type_of(F.lower(text_or_empty(text)), rules)


def stock_phrases(text: Column, phrases: Sequence[str] = tuple(lx.STOCK_PHRASES)) -> Column:
    return contained_terms(F.lower(text_or_empty(text)), phrases)


def quality_issues(
    text: Column,
    max_len: int = 280,
    max_words: int = 38,
    max_hashtags: int = 2,
    phrases: Sequence[str] = tuple(lx.STOCK_PHRASES),
) -> Column:
    """Array of quality findings; empty means the text passes."""
    text = text_or_empty(text)
    found = stock_phrases(text, phrases)
    return without_nulls(
        F.when(word_count(text) == 0, F.lit("empty_text")),
        F.when(F.length(text) > max_len, F.lit("too_long")),
        F.when(F.size(found) > 0, F.concat(F.lit("ai_or_news_phrases:"), F.array_join(found, ","))),
        F.when(F.regexp_count(text, F.lit("#")) > max_hashtags, F.lit("too_many_hashtags")),
        F.when(word_count(text) > max_words, F.lit("too_explanatory")),
    )


def quality_score(issues: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(20.0) * F.size(issues))


def classify_text(text: Column, categories: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Every category with a keyword occurring in the text (substring match)."""
    low = F.lower(text_or_empty(text))
    cats = categories if categories is not None else lx.CATEGORY_KEYWORDS
    return without_nulls(
        *[
            F.when(contains_any(low, [k.lower() for k in keywords]), F.lit(name))
            for name, keywords in cats.items()
        ]
    )


def word_tokens(text: Column) -> Column:
    """Lower-case words: maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(f"({WORD}+)"), F.lit(1))


def estimate_sentiment(
    text: Column,
    positive: Sequence[str] = tuple(lx.POSITIVE_WORDS),
    negative: Sequence[str] = tuple(lx.NEGATIVE_WORDS),
) -> Column:
    """(positive - negative words) / words, within [-1, 1]; 0 without words."""

    def step(acc: Column, word: Column) -> Column:
        gain = F.when(word.isin(*positive), 1).otherwise(0) - F.when(word.isin(*negative), 1).otherwise(0)
        return F.struct((acc["gain"] + gain).alias("gain"), (acc["n"] + 1).alias("n"))

    def finish(acc: Column) -> Column:
        score = acc["gain"].cast("double") / F.greatest(acc["n"], F.lit(1))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))

    start = F.struct(F.lit(0).alias("gain"), F.lit(0).alias("n"))
    # one pass over the words; they are split only once per text
    return F.aggregate(word_tokens(text), start, step, finish)


def keyword_hits(text: Column, keywords: Sequence[str] = tuple(lx.ACCOUNT_KEYWORDS)) -> Column:
    """Distinct keywords contained after lower-casing and folding letters to ASCII.

    Keywords themselves are not folded, so keywords with folded letters never match.
    """
    folded = F.translate(F.lower(text_or_empty(text)), lx.FOLD_FROM, lx.FOLD_TO)
    return count_contained(folded, keywords)


def topic_terms(text: Column, terms: Sequence[str] = tuple(lx.EVIDENCE_TERMS)) -> Column:
    """Sorted topic terms contained in the cleaned text."""
    return contained_terms(F.lower(clean_text(text)), sorted(set(terms)))


def quote_context_risk(quoted: Column, words_: Sequence[str] = tuple(lx.QUOTE_RISK_WORDS)) -> Column:
    hits = count_contained(F.lower(text_or_empty(quoted)), words_)
    return F.least(F.lit(100.0), F.lit(20.0) * hits)


def summarize(
    text: Column,
    max_length: int = 150,
    min_length: int = 40,
    style_suffix: Column | None = None,
) -> Column:
    """Leading words of long texts; short texts unchanged. ``style_suffix`` may be null."""
    tokens = words(text)
    count = word_count(text)
    short = F.array_join(F.slice(tokens, 1, max_length), " ")
    short = F.when(count > max_length, F.concat(short, F.lit("..."))).otherwise(short)
    if style_suffix is not None:
        suffix = F.nullif(style_suffix, F.lit(""))
        short = F.when(suffix.isNull(), short).otherwise(F.concat(short, F.lit(" | "), suffix))
    return F.when(count < min_length, text).otherwise(short)
