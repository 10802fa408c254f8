"""Registered queries of the pipeline operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm.fill_middle import fill_in_middle_digests
from tallyline.llm.filter_audit import filter_audit
from tallyline.llm.katz import score
from tallyline.llm.language_id import identify
from tallyline.llm.mixing import mix
from tallyline.llm.mtree import top_products
from tallyline.llm.near_dup import near_duplicates
from tallyline.llm.neighbours import neighbours
from tallyline.llm.packing import pack
from tallyline.llm.passages import repeated_passages
from tallyline.llm.pii import personal_data
from tallyline.llm.token_counts import token_counts
from tallyline.llm.vector_dup import vector_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file; every machine has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_near_duplicates", sql=r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
           else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, m.n, n.n having 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y),
parts as (select x as doc_id, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, p.component_id, d.doc_id = p.component_id as kept
from documents d join parts p using (doc_id) left join sizes s using (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


@query("op5_vector_duplicates", sql="""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
parts as (select x as vec_id, min(y) as component_id from reach group by x),
counts as (select x as vec_id, count(*) as n from links group by x)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, p.component_id, e.vec_id = p.component_id as kept
from embeddings e join parts p using (vec_id) left join counts c using (vec_id)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(embeddings(spark, sf_dir))


@query("op8_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(embeddings(spark, sf_dir))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


@query("op7_katz_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


@query("op11_filter_audit", sql=r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
told as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
         from labels where doc_id is not null group by doc_id),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from d),
marks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
         || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end
         || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when coalesce(first < words.doc_id, false) then 'E' else '' end as fails
  from words left join told on told.doc_id = words.doc_id),
patterns as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from marks group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, filter_order[step] as letter from orders, range(1, 6) as r(step)),
gone as (
  select p.*, o.filter_order, list_min(list_transform(string_split(p.fails, ''), lambda x: strpos(o.filter_order, x))) as at
  from patterns p, orders o where p.fails <> ''),
counts as (
  select parts.part, s.filter_order, s.step, s.letter, parts.total,
         coalesce(sum(g.n) filter (where g.at <= s.step), 0) as gone_so_far, coalesce(sum(g.n) filter (where g.at = s.step), 0) as removed,
         coalesce(sum(g.n) filter (where g.at < s.step and contains(g.fails, s.letter)), 0) as redundant,
         coalesce(sum(g.n) filter (where g.fails = s.letter), 0) as unique_fails,
         coalesce(sum(g.good) filter (where g.at = s.step), 0) as good_lost, coalesce(sum(g.toxic) filter (where g.at = s.step), 0) as toxic_lost
  from (select part, sum(n) as total from patterns group by part) parts cross join steps s
  left join gone g on g.part = parts.part and g.filter_order = s.filter_order
  group by parts.part, s.filter_order, s.step, s.letter, parts.total)
select part, filter_order, step::int as step, (total - gone_so_far)::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint as shapley
from counts
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_fill_in_middle", sql=r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h
  from documents),
h as (select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cuts),
made as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as o from parts),
back as (
  select *, case form when 'plain' then o
    when 'psm' then regexp_extract(o, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 1) || regexp_extract(o, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 3) || regexp_extract(o, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', 2)
    else regexp_extract(o, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 2) || regexp_extract(o, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 3) || regexp_extract(o, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', 1) end as r
  from made)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars, sha256(o) as output_sha256, sha256(r) as restored_sha256
from back
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(documents(spark, sf_dir))


@query("op13_top_products", sql="""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(embeddings(spark, sf_dir))
