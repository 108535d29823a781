"""The registered corpus queries: (spark, folder of tables) -> DataFrame."""

from pyspark.sql import functions as F

from curbside.llm import (
    bpe,
    centroids,
    decontaminate,
    licenses,
    main_text,
    quality,
    secret_spans,
    simhash,
    topk,
    toxicity,
    url_lists,
    wavelet,
    whitening,
)
from curbside.llm.common import table

REGISTRY = {}
ORACLE = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


@query
def op1_simhash_groups(spark, folder):
    return simhash.simhash_groups(table(spark, folder, "documents"))


@query
def op2_license_scan(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents"))


@query
def op3_main_text(spark, folder):
    return main_text.main_texts(table(spark, folder, "pages"))


@query
def op4_quality_scores(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_token_files(spark, folder):
    return wavelet.token_files(table(spark, folder, "documents"))


@query
def op6_secret_spans(spark, folder):
    return secret_spans.secret_spans(table(spark, folder, "documents"))


@query
def op7_byte_bpe(spark, folder):
    return bpe.round_trips(table(spark, folder, "documents"))


# The tables hold neither lists nor fetch times: both are derived from the
# pages, in the same way here and in the SQL. Each host has a dated history of
# its own, and so have its parent domain and one leading part of its paths.
_FETCHED = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 7 % 360 as int), cast(page_id % 24 as int), 0, 0)"
_DATED = "date_add(date '2024-01-01', cast(({0}) % 330 as int))"


@query
def op8_url_decisions(spark, folder):
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.expr(_FETCHED).alias("fetched_at"))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    seed = "(length(host) * 31 + ascii(substr(host, 3, 1)) * 7)"
    parent = "substr(host, instr(host, '.') + 1)"
    history = hosts.select(F.expr(
        "inline(array("
        f"named_struct('pattern', host, 'action', 'block', 'dated', {_DATED.format(seed)}), "
        f"named_struct('pattern', host, 'action', case {seed} % 3 when 0 then 'remove' when 1 then 'allow' else 'block' end, 'dated', {_DATED.format(seed + ' + 41')}), "
        f"named_struct('pattern', host, 'action', case {seed} % 2 when 0 then 'block' else 'remove' end, 'dated', {_DATED.format(seed + ' + 111')}), "
        f"named_struct('pattern', {parent}, 'action', case {seed} % 2 when 0 then 'allow' else 'block' end, 'dated', {_DATED.format(seed + ' * 3')}), "
        f"named_struct('pattern', concat(host, '/en'), 'action', 'block', 'dated', {_DATED.format(seed + ' * 5')}), "
        f"named_struct('pattern', concat(host, '/en'), 'action', 'remove', 'dated', {_DATED.format(seed + ' * 5 + 60')})))"
    ))
    entries = history.withColumn("dated", F.col("dated").cast("timestamp"))
    return url_lists.decide(captures, entries)


_SEED = "(length(host) * 31 + ascii(substr(host, 3, 1)) * 7)"
ORACLE["op8_url_decisions"] = f"""
with captures as (
  select page_id, url, timestamp '2024-01-01' + to_days(cast(page_id * 7 % 360 as int)) + to_hours(page_id % 24) as fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
hosts as (select distinct host from captures where host <> ''),
entries as (
  select host as pattern, 'block' as action, {_SEED} % 330 as d from hosts
  union all select host, case {_SEED} % 3 when 0 then 'remove' when 1 then 'allow' else 'block' end, ({_SEED} + 41) % 330 from hosts
  union all select host, case {_SEED} % 2 when 0 then 'block' else 'remove' end, ({_SEED} + 111) % 330 from hosts
  union all select substr(host, instr(host, '.') + 1), case {_SEED} % 2 when 0 then 'allow' else 'block' end, ({_SEED} * 3) % 330 from hosts
  union all select host || '/en', 'block', ({_SEED} * 5) % 330 from hosts
  union all select host || '/en', 'remove', ({_SEED} * 5 + 60) % 330 from hosts),
one as (
  select pattern, timestamp '2024-01-01' + to_days(cast(d as int)) as dated,
    max(case action when 'remove' then 1 when 'allow' then 2 else 3 end) as strength
  from entries group by all),
spans as (
  select pattern, strength, dated as active_from, lead(dated) over (partition by pattern order by dated) as active_to from one),
active as (
  select c.page_id, c.url, c.fetched_at, s.pattern, s.strength, s.active_from,
    row_number() over (partition by c.page_id, c.url, c.fetched_at order by length(s.pattern) desc, s.pattern desc) as nth
  from captures c join spans s on s.strength > 1 and c.fetched_at >= s.active_from
    and (s.active_to is null or c.fetched_at < s.active_to)
    and (c.host = s.pattern or ends_with(c.host, '.' || s.pattern) or starts_with(c.host || c.path || '/', s.pattern || '/')))
select c.page_id, c.url, c.fetched_at, case a.strength when 3 then 'block' else 'allow' end as decision,
  a.pattern, a.active_from as listed_since
from captures c left join active a
  on a.nth = 1 and a.page_id = c.page_id and a.url = c.url and a.fetched_at = c.fetched_at
"""


@query
def op9_benchmark_passages(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op10_top_k"] = """
with vectors as (
  select row_number() over () as nth, vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where vec_id is not null and embedding is not null
    and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.nth, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
  from vectors q join vectors c on q.vec_id % 20 = 0 and c.nth <> q.nth),
ranked as (
  select query_id, cast(row_number() over (partition by nth order by score desc, vec_id) as int) as rank, vec_id, score
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


@query
def op11_centroid_clusters(spark, folder):
    return centroids.clusters(table(spark, folder, "embeddings"))


def _clustering_sql(rounds: int) -> str:
    """Rounds of assignment and exact means, one pair of CTEs each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as (
  select nth, vec_id, v, cluster, distance from (
    select k.nth, k.vec_id, k.v, c.cluster,
      list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance,
      row_number() over (partition by k.nth order by distance, c.cluster) as place
    from kept k cross join c{r} c) where place = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} as (
  select cluster, place, sum(x) as s, count(*) as n from (
    select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{r}) group by all),
c{r + 1} as (
  select c.cluster, coalesce(new.v, c.v) as v from c{r} c left join (
    select cluster, list(cast((s - ((s % n) + n) % n) / n as bigint) order by place) as v from m{r} group by cluster) new
  using (cluster))""")
    return ",".join(steps)


ORACLE["op11_centroid_clusters"] = f"""
with kept as (
  select row_number() over () as nth, vec_id, [cast(floor(64 * cast(x as double)) as hugeint) for x in embedding] as v
  from embeddings
  where len(embedding) = 64 and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as (
  select cast(row_number() over (order by name, v) - 1 as int) as cluster, v from (
    select sha256('1:' || coalesce(cast(vec_id as varchar), 'null')) as name, v from kept)
  order by cluster limit 16),
{_clustering_sql(3)},
total as (select cluster, sum(distance) as s from a3 group by cluster)
select a.vec_id, a.cluster, cast(a.distance as bigint) as distance, cast(t.s as bigint) as cluster_inertia,
  cast((select sum(distance) from a3) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a3 a join total t using (cluster) join c3 c using (cluster)
"""


@query
def op12_whitened_embeddings(spark, folder):
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op13_toxicity_scores(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
