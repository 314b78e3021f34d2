"""The URL filter's query: a dated list, capture times, and the DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import urllist
from lodestrata.llm.common import table

# kind, pattern, category, verdict, since
ENTRIES = [
    ("domain", "cheap-pills.example.com", "spam", "block", "2024-01-10"),
    ("domain", "cheap-pills.example.com", "spam", "remove", "2024-02-20"),
    ("domain", "cheap-pills.example.com", "spam", "block", "2024-03-05"),
    ("host", "www.cheap-pills.example.com", "pharmacy", "allow", "2024-03-20"),
    ("domain", "example.net", "mirror", "block", "2024-02-01"),
    ("domain", "example.net", "mirror", "remove", "2024-02-15"),
    ("path", "m.ththth.example.net/en", "mobile", "allow", "2024-01-05"),
    ("domain", "blog.tiontion.example.com", "blog", "block", "2024-01-15"),
    ("path", "blog.tiontion.example.com/en", "blog", "allow", "2024-02-10"),
    ("domain", "example.org", "archive", "block", "2024-03-01"),
    ("host", "thther.example.org", "archive", "allow", "2024-03-01"),
    ("domain", "org", "region", "block", "2024-04-01"),
]


_HEX = "0123456789abcdef"


def listed(hosts: DataFrame) -> DataFrame:
    """Entries made by rule from (host): digits of its MD5 say whether it is blocked and from when,
    whether that ends after 20 days, and whether its English pages are allowed then."""
    digit = lambda i: F.instr(F.lit(_HEX), F.substring(F.md5("host"), i, 1)) - 1
    own = hosts.where("host <> ''").distinct().select("host", digit(1).alias("a"), digit(3).alias("b"), F.date_add(F.lit("2024-01-01").cast("date"), 4 * digit(2)).alias("day"))
    entry = lambda kind, pattern, category, verdict, day: F.struct(
        F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(category).alias("category"), F.lit(verdict).alias("verdict"), day.cast("timestamp").alias("since")
    )
    host, day = F.col("host"), F.col("day")
    made = F.array(
        F.when(F.col("a") < 5, entry("host", host, "rule", "block", day)),
        F.when(F.col("a") < 2, entry("host", host, "rule", "remove", F.date_add(day, 20))),
        F.when(F.col("b") < 8, entry("path", F.concat(host, F.lit("/en")), "english", "allow", day)),
    )
    return own.select(F.explode(made).alias("e")).where("e is not null").select("e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds ``ENTRIES`` and those that ``listed`` makes of all hosts.  Pages carry no time of capture: page n counts as fetched n * 37 minutes, modulo
    100 days, after the start of 2024."""
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, category string, verdict string, since string")
    entries = entries.withColumn("since", F.to_timestamp("since", "yyyy-MM-dd"))
    minutes = F.pmod(F.col("page_id") * 37, F.lit(144000)).cast("int")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp '2024-01-01 00:00:00'").alias("start"), minutes.alias("minutes"))
    captures = captures.select("page_id", "url", F.expr("start + make_dt_interval(0, 0, minutes, 0)").alias("fetched_at"))
    entries = entries.unionByName(listed(captures.select(urllist.host(F.col("url")).alias("host"))))
    out = urllist.judged(captures, entries)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("fetched_at", "rule_since")})


_ROWS = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in ENTRIES)
SQL = rf"""
with p as (
  select page_id, url, timestamp '2024-01-01 00:00:00' + to_minutes(cast((page_id * 37) % 144000 as int)) as fetched_at,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) as host,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) as path
  from pages
),
g as (select host, instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 as a, instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 as b,
  cast(date '2024-01-01' + cast(4 * (instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1) as int) as timestamp) as day from (select distinct host from p where host <> '')),
e as (
  select kind, lower(pattern) as pattern, category, verdict, cast(since as timestamp) as since from (values {_ROWS}) as v(kind, pattern, category, verdict, since)
  union all select 'host', host, 'rule', 'block', day from g where a < 5
  union all select 'host', host, 'rule', 'remove', day + interval 20 day from g where a < 2
  union all select 'path', host || '/en', 'english', 'allow', day from g where b < 8
),
i as (
  select *, lead(since) over (partition by kind, pattern, category order by since) as valid_to from e
),
q as (select *, string_split(host, '.') as l, list_filter(string_split(path, '/'), lambda x: x <> '') as s from p where host <> ''),
a as (
  select page_id, url, fetched_at, 'domain' as kind, array_to_string(list_slice(l, len(l) - k + 1, len(l)), '.') as pattern, k as weight from (select *, unnest(range(1, len(l) + 1)) as k from q)
  union all select page_id, url, fetched_at, 'host', host, 1000 from q
  union all select page_id, url, fetched_at, 'path', host || '/' || array_to_string(list_slice(s, 1, k), '/'), 1000 + k from (select *, unnest(range(1, len(s) + 1)) as k from q)
),
h as (select a.*, i.category, i.verdict, i.since from a join i using (kind, pattern) where i.verdict <> 'remove' and since <= fetched_at and (valid_to is null or fetched_at < valid_to)),
b as (
  select *, row_number() over (partition by page_id, url order by weight desc, (verdict = 'allow') desc, kind desc, pattern desc, category desc, since desc) as r,
    count(*) over (partition by page_id, url) as n_active from h
),
c as (select page_id, url, string_agg(category, ',' order by category) as categories from (select distinct page_id, url, category from h) group by all)
select p.page_id, p.host, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at, coalesce(b.verdict = 'block', false) as blocked, b.kind as rule_kind, b.pattern as rule,
  b.category, strftime(b.since, '%Y-%m-%d %H:%M:%S') as rule_since, coalesce(b.n_active, 0) as n_active, coalesce(c.categories, '') as categories
from p left join b on p.page_id = b.page_id and p.url = b.url and b.r = 1 left join c on p.page_id = c.page_id and p.url = c.url
"""
