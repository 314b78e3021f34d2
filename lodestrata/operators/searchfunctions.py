"""Search as SQL table functions: ``select * from documents_keyword('leaking pumps', 5)``.

``register`` puts three functions of a corpus into the session: ``<name>_semantic``, ``<name>_keyword``
and ``<name>_hybrid``.  They are SQL functions over the corpus's vectors and its stored posting lists,
so they can be joined and filtered like tables and are planned with the query around them.  A null
query, or one of stop words alone, finds nothing by words; a null or zero vector finds nothing by
likeness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import textindex


def register(spark: SparkSession, name: str, vectors: DataFrame, index: str, buckets: int = textindex.BUCKETS) -> list[str]:
    """Registers the functions over ``vectors`` (id, embedding) and the index stored at ``index``; returns their names."""
    if not name.isidentifier():
        raise ValueError(f"unsafe name {name!r}")
    vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).createOrReplaceTempView(f"{name}_vectors")
    spark.read.schema("term string, id long, places array<int>, bucket int").parquet(index).createOrReplaceTempView(f"{name}_lists")
    spark.udf.register("search_terms", lambda text: textindex.query_terms(text or ""), T.ArrayType(T.StringType()))
    bodies = {
        "semantic": ("wanted array<double>, k int, least double", "id bigint, similarity double", f"""
select id, similarity from (select id, similarity, row_number() over (order by similarity desc, id) as r from (
  select id, aggregate(zip_with(embedding, wanted, (a, b) -> a * b), 0D, (s, x) -> s + x)
    / nullif(sqrt(aggregate(embedding, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(wanted, 0D, (s, x) -> s + x * x)), 0D) as similarity
  from {name}_vectors where size(embedding) = size(wanted)) where similarity >= least) where r <= k"""),
        "keyword": ("asked string, k int", "id bigint, rank double", f"""
select id, rank from (select id, rank, row_number() over (order by rank desc, id) as r from (
  select id, {textindex.COVER_DENSITY} as rank from (
    select id, count(distinct n) as terms, any_value(wanted) as wanted, array_sort(flatten(collect_list(transform(places, p -> struct(p as place, n as term))))) as entries
    from (select l.id, l.places, q.n, q.wanted from {name}_lists l
      join (select term, n, size(terms) as wanted, cast(crc32(cast(term as binary)) % {buckets} as int) as bucket from (select search_terms(asked) as terms) lateral view posexplode(terms) x as n, term) q
      on l.bucket = q.bucket and l.term = q.term)
    group by id) where terms = wanted)) where r <= k"""),
    }
    bodies["hybrid"] = ("asked string, wanted array<double>, k int, least double", "id bigint, rank_s bigint, rank_k bigint, score double", f"""
select id, rank_s, rank_k, score from (select *, row_number() over (order by score desc, id) as r from (
  select coalesce(a.id, b.id) as id, a.n as rank_s, b.n as rank_k, coalesce(0.7D / (60 + a.n), 0D) + coalesce(0.3D / (60 + b.n), 0D) as score
  from (select id, cast(row_number() over (order by similarity desc, id) as bigint) as n from {name}_semantic(wanted, 3 * k, least)) a
  full outer join (select id, cast(row_number() over (order by rank desc, id) as bigint) as n from {name}_keyword(asked, 3 * k)) b on a.id = b.id)) where r <= k""")  # fmt: skip
    for kind, (takes, gives, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}_{kind}({takes}) returns table ({gives}) return {body}")
    return [f"{name}_{kind}" for kind in bodies]
