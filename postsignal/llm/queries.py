"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.llm.chosen_path import similar_sets
from postsignal.llm.common import table
from postsignal.llm.exact_dedup import exact_groups
from postsignal.llm.fill_middle import digested, framed, transformed
from postsignal.llm.hash_forest import nearest
from postsignal.llm.hash_tree import shard_rows, tree
from postsignal.llm.host_reputation import SUFFIXES, Rule, domain_pattern, judge_urls, suffix_pattern
from postsignal.llm.mixing import mix
from postsignal.llm.quality import fit, held_out, score
from postsignal.llm.sentencepiece_bpe import encode_texts
from postsignal.llm.simhash_dedup import simhash_groups
from postsignal.llm.substring_dedup import remove_repeated_passages
from postsignal.llm.token_counts import count_tokens
from postsignal.llm.whitening import whitened


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), tree([1.0] * 16))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_texts(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shares = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, shares).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op9_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the quality label of the document that its url names by number."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[^?#]*?([0-9]{1,18})[^0-9/?#]*/?(?:[?#]|$)", 1)
    named = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return judge_urls(pages, named.join(labels, "doc_id"), URL_RULES).drop("bound")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(transformed(framed(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_exact_dedup,
        op2_simhash_dedup,
        op3_substring_dedup,
        op4_hash_tree,
        op5_mixing,
        op6_sentencepiece,
        op7_quality,
        op8_token_counts,
        op9_hash_forest,
        op10_host_reputation,
        op11_fill_middle,
        op12_whitening,
        op13_chosen_path,
    )
}

SQL = {
    "op1_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))""",
}

SQL["op5_mixing"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size,
    [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source
),
capped as (select *, source_size * 2.0::double as cap from sources),
levels as (
  select *, cap / weight as ratio,
    (sum(source_size) over () * 1.5::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from capped
),
targets as (
  select source, source_size,
    case when level * weight >= cap then cap
      else arg_min(level, ratio) filter (not level * weight >= cap) over () * weight end as target
  from levels
),
planned as (
  select *, floor(target / greatest(source_size, 1))::bigint as passes,
    target - floor(target / greatest(source_size, 1))::bigint * source_size as rest
  from targets
),
running as (
  select source, hash, sum(size) as tokens, sum(sum(size)) over (partition by source order by hash) as upto
  from sized where size > 0 group by source, hash
),
crossing as (
  select r.source, min(r.hash) as hash, arg_min(r.tokens, r.hash) as tokens, arg_min(r.upto, r.hash) as upto, any_value(p.rest) as rest
  from running r join planned p on r.source is not distinct from p.source
  where p.rest > 0 and r.upto >= p.rest group by r.source
)
select s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.passes + (s.hash < coalesce(case when (c.rest - (c.upto - c.tokens)) * 2 >= c.tokens then c.hash + 1 else c.hash end, 0))::int))::bigint as taken
from sized s join planned p on s.source is not distinct from p.source
left join crossing c on s.source is not distinct from c.source"""

_POSTERIORS = """
{key}_strength as (
  select case when coalesce(sum((good - n * rate) * (good - n * rate) - n * rate * (1 - rate)) / nullif(sum(n * (n - 1) * rate * (1 - rate)), 0), 0) > 0
    then least(greatest(sum(n * (n - 1) * rate * (1 - rate)) / sum((good - n * rate) * (good - n * rate) - n * rate * (1 - rate)) - 1, 1.0), 1000.0)
    else 1000.0 end as strength
  from {key}_counts
),
{key}_posterior as (
  select {key}, rate * strength + good as alpha, (1 - rate) * strength + n - good as beta,
    (rate * strength + good) / (strength + n) as rate
  from {key}_counts, {key}_strength
)"""

SQL["op10_host_reputation"] = rf"""
with split as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
    regexp_extract(coalesce(url, ''), '://[^/?#]*/[^?#]*?([0-9]{{1,18}})[^0-9/?#]*/?(?:[?#]|$)', 1) as number
  from pages
),
parts as (
  select page_id, number, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from split
),
host_sums as (
  select host, regexp_extract(host, '{domain_pattern(SUFFIXES)}', 1) as domain, regexp_extract(host, '(?:^|\.)({suffix_pattern(SUFFIXES)})$', 1) as suffix,
    sum(l.quality)::double as good, count(*)::double as n
  from parts p join labels l on l.doc_id = try_cast(nullif(p.number, '') as bigint) where l.quality is not null group by host
),
suffix_counts as (
  select suffix, sum(good) as good, sum(n) as n,
    (select (1.0::double + coalesce(sum(good), 0)) / (2.0::double + coalesce(sum(n), 0)) from host_sums) as rate
  from host_sums group by suffix
), {_POSTERIORS.format(key="suffix")},
domain_counts as (
  select domain, sum(good) as good, sum(n) as n, any_value(p.rate) as rate from host_sums join suffix_posterior p using (suffix) group by domain
), {_POSTERIORS.format(key="domain")},
host_counts as (select host, good, n, p.rate from host_sums join domain_posterior p using (domain)), {_POSTERIORS.format(key="host")},
judged as (
  select p.*, coalesce(h.alpha, d.alpha, s.alpha, (select 1.0 + coalesce(sum(good), 0) from host_sums)) as alpha,
    coalesce(h.beta, d.beta, s.beta, (select 1.0 + coalesce(sum(n - good), 0) from host_sums)) as beta,
    case {" ".join(
        f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{r.text}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r.text), r.text))
    )} end as rule
  from parts p left join host_posterior h using (host)
  left join domain_posterior d on d.domain = regexp_extract(p.host, '{domain_pattern(SUFFIXES)}', 1)
  left join suffix_posterior s on s.suffix = regexp_extract(p.host, '(?:^|\.)({suffix_pattern(SUFFIXES)})$', 1)
)
select page_id, host, path, rule, case {" ".join(f"when rule = '{r.text}' then '{r.verdict}'" for r in URL_RULES)}
  when alpha / (alpha + beta) - sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) >= 0.7 then 'allow'
  else 'block' end as verdict
from judged"""

SQL["op11_fill_middle"] = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
  from documents
),
drawn as (
  select *, len(units) as n, ('0x' || h[1:8])::bigint % (len(units) + 1) as x, ('0x' || h[9:16])::bigint % (len(units) + 1) as y,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from cut
),
parts as (
  select doc_id, n, form, text, array_to_string(units[1:least(x, y)], '') as p,
    array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(units[greatest(x, y) + 1:], '') as s
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from parts"""
