"""Registered queries of the training-data operators, with checking SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.llm import bpe, decontam, jaccard, langid, prefixtrie, quality, suffix, tokencount, tokenfile, topk, toxicity, urlfilter, whitening
from callsheet.llm.common import table
from callsheet.plans.query import Query


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"))


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.tokenized(table(spark, sf_dir, "documents")))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


TOP_K_SQL = """
with q as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings),
s as (select a.vec_id as query_id, b.vec_id as vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
      from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the day of fetching follows from the URL and the page's number."""
    seen = F.md5(F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")))
    day = F.conv(F.substring(seen, 1, 6), 16, 10).cast("int") % 366
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def _entries(captures: DataFrame) -> DataFrame:
    """Three dated lists made of the captures' own hosts, domains and sections.

    A key is on a list if a digest says so. It is added on one day, and for some keys removed and
    added again later.
    """
    keys = captures.select(F.explode(urlfilter.lookup_keys(F.col("url"))).alias("key")).distinct()
    names = F.explode(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam"))).alias("list")
    seen = F.md5(F.concat_ws("|", "list", "key"))
    part = lambda a, m: F.conv(F.substring("seen", a, 5), 16, 10).cast("int") % m
    first = F.lit("2023-12-01").cast("date")
    listed = keys.select(names, "key").withColumn("seen", seen).where(part(1, 12) == 0)
    added = F.date_add(first, part(6, 200))
    step = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(first, part(6, 200) + days).alias("dated"))
    history = F.when(part(11, 3) == 0, F.array(F.struct(F.lit("add").alias("action"), added.alias("dated")), step("remove", part(16, 90) + 1), step("add", part(21, 90) + 100)))
    return listed.select("list", "key", F.explode(history.otherwise(F.array(F.struct(F.lit("add").alias("action"), added.alias("dated"))))).alias("e")).select("list", "key", "e.*")


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    return urlfilter.verdicts(captures, _entries(captures))


URL_SQL = r"""
with captures as (
  select page_id as capture_id, url, date '2024-01-01' + cast(('0x' || substr(md5(url || '#' || cast(page_id as varchar)), 1, 6)) as int) % 366 as fetched,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.+$', '')) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
split as (select *, string_split(host, '.') as labels, string_split(path, '/') as parts from captures),
keyed as (
  select distinct capture_id, fetched, unnest(case when host = '' then [] else list_concat(
    list_transform(generate_series(1, greatest(len(labels) - 1, 1)), lambda i: array_to_string(labels[i:], '.')),
    case when len(parts) > 1 then list_transform(generate_series(2, len(parts)), lambda i: host || array_to_string(parts[1:i], '/') || case when i < len(parts) then '/' else '' end) else [] end) end) as key
  from split),
listed as (
  select list, key, md5(list || '|' || key) as seen
  from (select distinct key from keyed) cross join (select unnest(['adult', 'malware', 'spam']) as list)),
digits as (
  select list, key, cast('0x' || substr(seen, 1, 5) as int) % 12 as pick, cast('0x' || substr(seen, 6, 5) as int) % 200 as a, cast('0x' || substr(seen, 11, 5) as int) % 3 as again,
    cast('0x' || substr(seen, 16, 5) as int) % 90 + 1 as r, cast('0x' || substr(seen, 21, 5) as int) % 90 + 100 as b
  from listed),
entries as (
  select list, key, 'add' as action, date '2023-12-01' + a as dated from digits where pick = 0
  union all select list, key, 'remove', date '2023-12-01' + (a + r) from digits where pick = 0 and again = 0
  union all select list, key, 'add', date '2023-12-01' + (a + b) from digits where pick = 0 and again = 0),
state as (
  select k.capture_id, e.list, e.key, arg_max(e.action, e.dated) as action
  from keyed k join entries e on e.key = k.key and e.dated <= k.fetched group by all),
found as (
  select capture_id, count(*) as n_matches, array_to_string(list_sort(list(distinct list)), ',') as lists, (list(key order by -length(key), key))[1] as reason
  from state where action = 'add' group by capture_id)
select c.capture_id, c.url, c.fetched, c.host, f.capture_id is not null as blocked, coalesce(n_matches, 0) as n_matches, coalesce(lists, '') as lists, coalesce(reason, '') as reason
from captures c left join found f using (capture_id)
"""


def _suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"), "text")


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.score(table(spark, sf_dir, "documents"))


def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


#: crc32 is worked out bit by bit from the digits of an id; a path is the row of its turns' digests.
TRIE_SQL = r"""
with turns as (
  select conv_id, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) as n
  from conversations where conv_id is not null),
heads as (
  select conv_id, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ord(d) as bigint))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from turns)),
taken as (
  select c.conv_id, b.n as d, b.digest, b.words from heads c join turns b on b.conv_id = c.conv_id - c.conv_id % 20 and b.n <= c.h
  union all
  select c.conv_id, least(c.h, (select count(*) from turns b where b.conv_id = c.conv_id - c.conv_id % 20)) + t.n - c.h, t.digest, t.words
  from heads c join turns t on t.conv_id = c.conv_id and t.n > c.h),
steps as (
  select conv_id, 0 as d, '' as path, 0 as words from heads
  union all select conv_id, d, string_agg(digest, '') over (partition by conv_id order by d), words from taken),
lengths as (select conv_id, max(d) as d, arg_max(path, d) as path from steps group by conv_id),
ended as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from lengths group by path),
nodes as (select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from steps group by path, d),
kids as (select left(path, 64 * (depth - 1)) as path, count(*) as n from nodes where depth > 0 group by 1),
full_nodes as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (path)),
below as (
  select left(path, 64 * up) as path, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved
  from (select *, unnest(range(depth + 1)) as up from full_nodes) group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, cast(n.n_convs as bigint) as n_convs, cast(n.n_children as bigint) as n_children,
  cast(b.n_leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_nodes n join below b using (path) left join ended e using (path)
left join full_nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.path = left(n.path, 64 * (n.depth - 1))
"""


def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.stored(table(spark, sf_dir, "documents"))


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_top_k": Query(_top_k, TOP_K_SQL),
    "op2_quality": Query(_quality),
    "op3_token_counts": Query(_token_counts),
    "op4_decontaminate": Query(_decontaminate),
    "op5_url_filter": Query(_url_filter, URL_SQL),
    "op6_bpe": Query(_bpe),
    "op7_suffix_dedup": Query(_suffix),
    "op8_language": Query(_language),
    "op9_jaccard": Query(_jaccard),
    "op10_toxicity": Query(_toxicity),
    "op11_prefix_trie": Query(_prefix_trie, TRIE_SQL),
    "op12_token_files": Query(_token_files),
    "op13_whitening": Query(_whitening),
}
