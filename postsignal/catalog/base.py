"""Lexicons and SQL fragments shared by the registered queries.

The lexicons here are chosen to occur in the tables the queries run on; the defaults of the
library are in ``postsignal.lexicons``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from postsignal.plans.signals import SignalLexicon

Query = Callable[[SparkSession, str], DataFrame]

EVENT_RULES = [
    ("transfer", ["license"]),
    ("match_moment", ["***", "%%%"]),
    ("injury", ["@"]),
    ("meme", ["free"]),
    ("global_football", ["tertion", "onsh"]),
]
RISK = {
    "misinformation": ["the "],
    "toxicity": ["tion"],
    "crisis": ["ent"],
    "political_tension": ["erin"],
    "copyright": ["from"],
}
QUOTE_RISK = ["the", "tion", "ent", "ou", "que", "und"]
CLAIMS = ["the "]
POSITIVE = ["the", "from"]
NEGATIVE = ["and", "with"]
PHRASES = ["of the", "in the", "de la"]
HUMOR = ["tertion", "lyly"]
REACTION = ["of the", "de la"]
ACCOUNT_KEYWORDS = ["tion", "ung", "que", "ção", "über", "uber", "onsh"]
TOPICS = ["ation", "eaux", "ich", "the", "und", "vier"]
LEXICON = SignalLexicon(EVENT_RULES, RISK, QUOTE_RISK, CLAIMS)

# SQL: white space and word characters as in postsignal.functions.text
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NWS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(low: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({low}, {lit(t)})" for t in terms) + ")"


def sql_count(low: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({low}, {lit(t)})::int" for t in terms) + ")"


def sql_terms(low: str, terms: Sequence[str]) -> str:
    items = ", ".join(f"case when contains({low}, {lit(t)}) then {lit(t)} end" for t in terms)
    return f"list_filter([{items}], lambda x: x is not null)"


def sql_tags(low: str, lexicon: Mapping[str, Sequence[str]]) -> str:
    items = ", ".join(f"case when {sql_any(low, ts)} then {lit(c)} end" for c, ts in lexicon.items())
    return f"list_filter([{items}], lambda x: x is not null)"


def sql_event(low: str, rules=EVENT_RULES) -> str:
    cases = " ".join(f"when {sql_any(low, ts)} then {lit(n)}" for n, ts in rules)
    return f"case {cases} else 'other' end"


def sql_clean(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), 'https?://{NWS}+', '<url>', 'g')"
    out = f"replace({out}, chr(8203), '')"
    for mark in ("!", "?", "."):
        out = rf"regexp_replace({out}, '[{mark}]{{3,}}', '{mark}{mark}', 'g')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


def sql_collapse(text: str) -> str:
    quotes = "translate(coalesce({0}, ''), '“”‘’', '\"\"''''')".format(text)
    out = f"regexp_replace({quotes}, '{WS}+', ' ', 'g')"
    for mark in ("!", "?", "."):
        out = rf"regexp_replace({out}, '[{mark}]{{2,}}', '{mark}', 'g')"
    return f"trim({out})"


def sql_strip(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^{WS}+|{WS}+$', '', 'g')"


def sql_words(text: str) -> str:
    """Number of white-space separated tokens."""
    return f"len(regexp_extract_all(coalesce({text}, ''), '{NWS}+'))"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{NWS}+')"


def sql_clamp(value: str) -> str:
    return f"greatest(0.0::double, least(100.0::double, ({value})::double))"


# The adapter views of postsignal.sources.adapters, in SQL.
SQL_POSTS = """
posts as (
  select doc_id, doc_id::varchar as post_id, source as author_handle, text, lang, '' as quoted_text,
    (doc_id % 3)::int as n_media,
    case when doc_id % 2 = 1 then 'image of ' || source else '' end as alt,
    n_chars
  from documents
)"""


def sql_context(text: str = "text", alt: str = "alt", n: str = "n_media") -> str:
    alts = f"case when {alt} <> '' then repeat(' ' || {alt}, {n}) else '' end"
    # an empty text contributes no leading blank; cleaning trims it
    return sql_clean(f"({text} || {alts})")


