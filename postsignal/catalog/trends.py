"""Event clusters, bursts, drift, graph features and samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from postsignal.operators import drift as D
from postsignal.operators import event_clusters as EC
from postsignal.operators import graph_features as G
from postsignal.operators import rolling as R
from postsignal.operators import samples as SM
from postsignal.runtime import scratch_folder, written
from postsignal.sources import adapters as A
from postsignal.streaming import clusters as SC

GAP = 1800  # seconds between posts of one event


def _entities():
    """Entity keys of an event: the number its properties name with its kind, and the user."""
    number = F.get_json_object("props", "$.k")
    return F.array_compact(F.array(F.concat(F.lit("k"), number, F.lit(":"), F.col("event_type")), F.concat(F.lit("u"), F.col("user_id").cast("string"))))


def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def event_clusters(spark, sf):
    return EC.event_clusters(A.table(spark, sf, "events"), "event_id", _entities(), _seconds(), GAP)


def cluster_velocity(spark, sf):
    events = A.table(spark, sf, "events")
    found = EC.event_clusters(events, "event_id", _entities(), _seconds(), GAP)
    members = found.join(events.select("event_id", "user_id", _seconds().alias("at")), "event_id")
    return _rounded(EC.cluster_facts(members, "user_id", "at"))


def _rounded(facts):
    return facts.select(
        "cluster_id", "posts", "sources", "first_at", "last_at", F.round("velocity", 6).alias("velocity"), "peak", F.round("acceleration", 6).alias("acceleration")
    )


def streamed_clusters(spark, sf):
    folder = scratch_folder(spark, "clusters")
    stream = A.table_stream(spark, sf, "events", files_per_trigger=1)
    SC.start_clusters(stream, folder, f"{folder}/_checkpoint", "event_id", _entities(), _seconds(), GAP, ("user_id",)).awaitTermination()
    return _rounded(EC.cluster_facts(SC.read_clusters(spark, folder), "user_id", "at"))


def event_bursts(spark, sf):
    found = R.bursts(A.table(spark, sf, "events"), ["event_type"], _seconds())
    digits = [F.round(c, 6).alias(c) for c in ("mean", "std", "z", "ratio")]
    return found.select("event_type", "step", "n", *digits, "burst")


def entity_repeats(spark, sf):
    """Events that name the same number within two hours."""
    events = A.table(spark, sf, "events").withColumn("entity", F.get_json_object("props", "$.k"))
    return R.recent_repeats(events, "event_id", ["entity"], _seconds(), first_free=0)


START, WEEK = 1704067200, 604800


def _weekly(spark, sf):
    return A.table(spark, sf, "events").withColumn("week", F.floor((_seconds() - START) / WEEK))


def value_drift(spark, sf):
    """Drift of values and hours of each kind of event, week by week against the first."""
    features = {"value": F.col("value"), "hour": F.hour(F.col("ts").cast("timestamp")).cast("double")}
    return _rounded_drift(D.numeric_drift(_weekly(spark, sf), ["event_type"], "week", F.col("week") == 0, features), "event_type", "ks")


def category_drift(spark, sf):
    features = {"event_type": F.col("event_type"), "user_group": F.col("user_id") % 20}
    return _rounded_drift(D.categorical_drift(_weekly(spark, sf), [], "week", F.col("week") == 0, features))


def _rounded_drift(found, *more):
    keys = [c for c in more if c != "ks"]
    digits = ["psi", "js", *(c for c in more if c == "ks")]
    return found.select(*keys, "feature", "week", "reference_n", "current_n", *[F.round(c, 6).alias(c) for c in digits], "verdict")


def review_sample(spark, sf):
    found = SM.stratified_sample(A.table(spark, sf, "documents"), "doc_id", ["lang", "source"], 5, seed=7)
    return found.select("doc_id", "lang", "source", F.round("represents", 6).alias("represents"))


def weighted_sample(spark, sf):
    """Longer documents are drawn more often."""
    docs = A.table(spark, sf, "documents")
    return SM.stratified_sample(docs, "doc_id", ["lang"], 10, weight=F.col("n_chars"), seed=7).select("doc_id", "lang")


def _edges(spark, sf):
    """Users and the numbers that their events name; purchases lead back."""
    events = A.table(spark, sf, "events").withColumn("number", F.get_json_object("props", "$.k"))
    user, number = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), F.col("number"))
    age = F.lit(START + 30 * 86400) - _seconds()
    forth = G.decayed_edges(events, user, number, F.col("event_type"), age, 7 * 86400.0, {"view": 0.5, "purchase": 2.0})
    back = G.decayed_edges(events.filter("event_type = 'purchase'"), number, user, F.lit("by"), age, 7 * 86400.0)
    return forth.unionByName(back)


def walk_ranks(spark, sf):
    """Random walks with restart from some users, and from some numbers."""
    edges = written(_edges(spark, sf), "edges")
    users = edges.select(F.col("src").alias("node")).distinct().filter("node like 'u%0'").select(F.lit("users").alias("walk"), "node", F.lit(1.0).alias("weight"))
    numbers = edges.select(F.col("dst").alias("node")).distinct().filter("node like 'k_'").select(F.lit("numbers").alias("walk"), "node", F.lit(1.0).alias("weight"))
    ranks = G.personalized_pagerank(edges, users.unionByName(numbers), damping=0.5, tolerance=1e-9)
    return ranks.select("walk", "node", F.round("rank", 6).alias("rank"))


def path_degrees(spark, sf):
    """Paths from a user by a click to a number, by a purchase to a user, and by a view to a number."""
    found = G.metapath_degrees(_edges(spark, sf), ["click", "by", "view"])
    return found.select("node", F.round("paths", 6).alias("paths"))


def node_degrees(spark, sf):
    found = G.degrees(_edges(spark, sf))
    return found.select("node", "kind", "out_degree", "in_degree", F.round("out_weight", 6).alias("out_weight"), F.round("in_weight", 6).alias("in_weight"))


QUERIES = {
    "event_clusters": event_clusters,
    "cluster_velocity": cluster_velocity,
    "streamed_clusters": streamed_clusters,
    "event_bursts": event_bursts,
    "entity_repeats": entity_repeats,
    "value_drift": value_drift,
    "category_drift": category_drift,
    "review_sample": review_sample,
    "weighted_sample": weighted_sample,
    "walk_ranks": walk_ranks,
    "path_degrees": path_degrees,
    "node_degrees": node_degrees,
}

_CLUSTERS = f"""
e as (select event_id, user_id, epoch(date_trunc('second', ts))::bigint as sec,
  unnest(list_filter(['k' || (props ->> '$.k') || ':' || event_type, 'u' || user_id::varchar], lambda x: x is not null)) as key from events),
l as (select *, case when sec - lag(sec) over (partition by key order by sec, event_id) <= {GAP} then 0 else 1 end as opens from e),
s as (select *, sum(opens) over (partition by key order by sec, event_id) as session from l),
h as (select event_id, min(event_id) over (partition by key, session) as head from s),
edges as (select distinct event_id as a, head as b from h where event_id <> head),
sym as (select a, b from edges union select b, a from edges),
reach as (select event_id as node, event_id as seen from events union select reach.node, sym.b from reach join sym on sym.a = reach.seen),
roots as (select node as event_id, min(seen) as cluster_id from reach group by node)"""

_FACTS = f"""with recursive {_CLUSTERS},
m as (select cluster_id, user_id, epoch(date_trunc('second', ts))::bigint as sec from roots join events using (event_id)),
span as (select *, min(sec) over (partition by cluster_id) as first_at, max(sec) over (partition by cluster_id) as last_at,
  count(*) over (partition by cluster_id, sec // 3600) as in_hour from m)
select cluster_id, count(*) as posts, count(distinct user_id) as sources, any_value(first_at) as first_at, any_value(last_at) as last_at,
  round(count(*) / greatest((any_value(last_at) - any_value(first_at)) / 3600.0::double, 1.0::double), 6) as velocity, max(in_hour) as peak,
  round((sum((sec * 2 > first_at + last_at)::bigint) - sum((sec * 2 < first_at + last_at)::bigint)) / count(*)::double, 6) as acceleration
from span group by cluster_id"""

_BUCKET = f"""case when v is null or isnan(v) then null when abs(v) <= 1e-9::double then 0 else sign(v) * greatest(ceil(ln(abs(v) / 1e-9::double) / {math.log(D.RATIO)!r}::double), 1) end::bigint"""

_DIVERGENCE = """cells as (select b.*, p.week, coalesce(e.n, 0) as e, coalesce(a.n, 0) as a from (select distinct {keys}, bin from placed) b
    join (select distinct {keys}, week from placed where week <> 0) p using ({keys})
    left join placed e on e.week = 0 and e.bin = b.bin and {match_e} left join placed a on a.week = p.week and a.bin = b.bin and {match_a}),
  shares as (select *, sum(e) over w as en, sum(a) over w as an, (e + 0.5::double) / (sum(e) over w + 0.5::double * count(*) over w) as es, (a + 0.5::double) / (sum(a) over w + 0.5::double * count(*) over w) as asx
    from cells window w as (partition by {keys}, week)),
  found as (select {keys}, week, any_value(en)::bigint as reference_n, any_value(an)::bigint as current_n, sum((asx - es) * ln(asx / es)) as psi,
    sum(es * log2(es / ((es + asx) / 2)) + asx * log2(asx / ((es + asx) / 2))) / 2 as js from shares group by {keys}, week)"""
_VERDICT = "case when psi >= 0.25 then 'major' when psi >= 0.1 then 'moderate' else 'stable' end as verdict"


def _divergence(*keys):
    match = lambda side: " and ".join(f"{side}.{k} = b.{k}" for k in keys)
    return _DIVERGENCE.format(keys=", ".join(keys), match_e=match("e"), match_a=match("a"))


_WEEK = f"(epoch(date_trunc('second', ts))::bigint - {START}) // {WEEK}"
_UNIFORM = "(('0x' || substr(sha256('7:' || doc_id::varchar), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double"
_EDGES = f"""ev as (select 'u' || user_id as u, 'k' || (props ->> '$.k') as k, event_type, pow(0.5::double, ({START + 30 * 86400} - epoch(date_trunc('second', ts))::bigint) / 604800.0::double) as w from events),
edges as (select u as src, k as dst, event_type as kind, sum(case event_type when 'view' then 0.5::double when 'purchase' then 2.0::double else 1.0::double end * w) as weight from ev where k is not null group by all
  union all select k, u, 'by', sum(w) from ev where event_type = 'purchase' and k is not null group by all)"""
_STEPS = 36
_WALKS = f"""with {_EDGES},
moves as materialized (select src, dst, weight / sum(weight) over (partition by src) as share from (select src, dst, sum(weight) as weight from edges group by all)),
leaving as materialized (select distinct src from moves),
given as (select 'users' as walk, src as node from (select distinct src from edges) where src like 'u%0' union all select 'numbers', dst from (select distinct dst from edges) where dst like 'k_'),
home as materialized (select walk, node, 1.0::double / count(*) over (partition by walk) as share from given),
r0 as (select walk, node, share as rank from home),
{", ".join(f"""r{i + 1} as materialized (select walk, node, sum(flow) as rank from (
  select walk, dst as node, 0.5::double * sum(rank * share) as flow from r{i} join moves on node = src group by all
  union all select walk, h.node, h.share * coalesce(1 - 0.5::double * s.moved, 1.0::double) from home h left join (select walk, sum(rank) as moved from r{i} join leaving on node = src group by walk) s using (walk))
  group by walk, node)""" for i in range(_STEPS))}
select walk, node, round(rank, 6) as rank from r{_STEPS}"""

SQL = {
    "event_clusters": f"with recursive {_CLUSTERS} select event_id, cluster_id from roots",
    "cluster_velocity": _FACTS,
    "streamed_clusters": _FACTS,
    "event_bursts": """with c as (select event_type, epoch(date_trunc('second', ts))::bigint // 3600 as step, count(*) as n from events group by all),
        r as (select *, coalesce(sum(n) over w, 0) / 24.0::double as mean, coalesce(sum(n * n) over w, 0) / 24.0::double as sq from c window w as (partition by event_type order by step range between 24 preceding and 1 preceding)),
        s as (select *, sqrt(greatest(sq - mean * mean, 0.0::double)) as std from r)
        select event_type, step, n, round(mean, 6) as mean, round(std, 6) as std, round((n - mean) / greatest(std, 1.0::double), 6) as z, round((n + 1) / (mean + 1), 6) as ratio,
          (n - mean) / greatest(std, 1.0::double) >= 3 and n >= 3 as burst from s""",
    "entity_repeats": """with e as (select event_id, props ->> '$.k' as entity, epoch(date_trunc('second', ts))::bigint as sec from events)
        select event_id, case when entity is null then 0 else count(*) over (partition by entity order by sec range between 7200 preceding and 1 preceding) end as repeats,
          least(100.0::double, case when entity is null then 0 else count(*) over (partition by entity order by sec range between 7200 preceding and 1 preceding) end * 20.0::double) as fatigue from e""",
    "value_drift": f"""with f as (select event_type, {_WEEK} as week, unnest([{{'feature': 'value', 'v': value}}, {{'feature': 'hour', 'v': hour(ts)::double}}], recursive := true) from events),
        sk as (select event_type, week, feature, {_BUCKET} as bucket, count(*) as n from f group by all),
        cum as (select event_type, feature, bucket, sum(n) over (partition by event_type, feature order by bucket) as upto, sum(n) over (partition by event_type, feature) as total from sk where week = 0 and bucket is not null),
        cuts as (select event_type, feature, list(distinct b) as cuts from (select event_type, feature, q, min(bucket) as b from cum, (select unnest([{", ".join(f"{i / 10}::double" for i in range(1, 10))}]) as q) where upto >= q * total group by all) group by all),
        placed as (select event_type, feature, week, case when bucket is null then -1 else len(list_filter(coalesce(cuts, []), lambda c: c < bucket)) end as bin, sum(n) as n from sk left join cuts using (event_type, feature) group by all),
        {_divergence('event_type', 'feature')},
        points as (select p.event_type, p.feature, p.week, bucket, n as e, 0 as a from (select distinct event_type, feature, week from sk where week <> 0) p join sk on sk.event_type = p.event_type and sk.feature = p.feature and sk.week = 0 where bucket is not null
          union all select event_type, feature, week, bucket, 0, n from sk where week <> 0 and bucket is not null),
        ks as (select event_type, feature, week, max(gap) as ks from (select event_type, feature, week, abs(sum(sum(e)) over o / sum(sum(e)) over t - sum(sum(a)) over o / sum(sum(a)) over t) as gap from points group by event_type, feature, week, bucket
          window o as (partition by event_type, feature, week order by bucket), t as (partition by event_type, feature, week)) group by all)
        select event_type, feature, week, reference_n, current_n, round(psi, 6) as psi, round(js, 6) as js, round(ks, 6) as ks, {_VERDICT} from found left join ks using (event_type, feature, week)""",
    "category_drift": f"""with f as (select {_WEEK} as week, unnest([{{'feature': 'event_type', 'bin': '=' || event_type}}, {{'feature': 'user_group', 'bin': '=' || (user_id % 20)::varchar}}], recursive := true) from events),
        placed as (select feature, week, bin, count(*) as n from f group by all), {_divergence('feature')}
        select feature, week, reference_n, current_n, round(psi, 6) as psi, round(js, 6) as js, {_VERDICT} from found""",
    "review_sample": f"""with s as (select doc_id, lang, source, row_number() over (partition by lang, source order by -ln({_UNIFORM}), doc_id) as place, count(*) over (partition by lang, source) as total from documents)
        select doc_id, lang, source, round(total / least(total, 5)::double, 6) as represents from s where place <= 5""",
    "weighted_sample": f"""select doc_id, lang from documents where n_chars > 0 qualify row_number() over (partition by lang order by -ln({_UNIFORM}) / n_chars, doc_id) <= 10""",
    "walk_ranks": _WALKS,
    "path_degrees": f"""with {_EDGES}, v as (select src as node, sum(weight) as paths from edges where kind = 'view' group by 1),
        p as (select src as node, sum(weight * paths) as paths from edges join v on dst = node where kind = 'by' group by 1)
        select src as node, round(sum(weight * paths), 6) as paths from edges join p on dst = node where kind = 'click' group by 1""",
    "node_degrees": f"""with {_EDGES}, d as (select src as node, kind, 1 as o, 0 as i, weight as ow, 0.0::double as iw from edges union all select dst, kind, 0, 1, 0.0::double, weight from edges)
        select node, kind, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, round(sum(ow), 6) as out_weight, round(sum(iw), 6) as in_weight from d group by all""",
}
