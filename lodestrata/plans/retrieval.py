"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import chunking, english
from lodestrata.operators import retrieval, textindex, vectorindex
from lodestrata.plans.registry import query
from lodestrata.sources import scratch
from lodestrata.sources.readers import table

QUERY_VECTOR = [((i * 7) % 11 - 5) / 5 for i in range(64)]
ASKED = "the tions of thing and er"
_V = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::double[]"
_SIM = f"with s as (select vec_id as id, label, list_cosine_similarity(embedding::double[], {_V}) as sim from embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(_SIM + " select id, label, round(sim, 6) as similarity from s where sim >= 0.05 order by sim desc, id limit 10")
def semantic_topk(spark, sf):
    return retrieval.semantic(_vectors(spark, sf), QUERY_VECTOR, 10, 0.05).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(_SIM + ", t as (select * from s order by sim desc, id limit 10) select id, label, round(sim, 6) as similarity from t where sim >= 0.2")
def semantic_threshold_after_limit(spark, sf):
    return retrieval.semantic_then_threshold(_vectors(spark, sf), QUERY_VECTOR, 10, 0.2).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query()
def ann_topk(spark, sf):
    """The ten nearest of all vectors for every row whose id is divisible by 20, from three quarters of the cells."""
    vectors, path = _vectors(spark, sf), scratch.folder(spark)
    vectorindex.build(vectors, path)
    model = vectorindex.load(spark, path)
    found = vectorindex.search(vectors.where("id % 20 = 0"), path, 10, -(-3 * len(model.cells) // 4) if model else 1)
    near = F.array_sort(F.collect_list(F.struct("rank", "id", F.round("similarity", 6).alias("similarity"))))
    return found.groupBy("query_id").agg(near.alias("near")).select("query_id", "near.id", "near.similarity").withColumnsRenamed({"id": "ids", "similarity": "similarities"})


def _endings(word: str, rules: list[tuple[str, str, str]]) -> str:
    """A CASE for the longest ending of ``word``: (ending, condition, replacement)."""
    cases = (
        f"when ends_with({word}, '{end}') then case when {when.replace('@', f'(length({word}) - {len(end)})')} then substr({word}, 1, length({word}) - {len(end)}) || '{to}' else {word} end"
        for end, when, to in sorted(rules, key=lambda r: -len(r[0]))
    )
    return f"case {' '.join(cases)} else {word} end"


def _stems_sql(words: str) -> str:
    """CTEs that end in ``stems`` (w, s): the stemmer's rules in SQL for the rows of ``words`` (w)."""
    short = "regexp_matches({0}, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
    vowel = "regexp_matches(substr({0}, 1, @), '[aeiouy]')"
    region = "coalesce(nullif(length(regexp_extract({0}, '^.*?[aeiouy][^aeiouy]')), 0), length({0}))"
    first = " ".join(f"when starts_with(x, '{p}') then {len(p)}" for p in english.FIRST_REGION_AFTER)
    plurals = _endings("x", [("sses", "true", "ss"), ("ied", "@ > 1", "i"), ("ies", "@ > 1", "i"), ("us", "false", ""), ("ss", "false", ""), ("s", "regexp_matches(substr(x, 1, length(x) - 2), '[aeiouy]')", "")])
    plurals = f"case when x in ('ied', 'ies') or (length(x) = 4 and regexp_matches(x, '(ied|ies)$')) then substr(x, 1, 3) else {plurals} end"
    cut = _endings("x", [(e, vowel.format("x"), "") for e in ("ed", "edly", "ing", "ingly")] + [("eed", "@ >= r1", "ee"), ("eedly", "@ >= r1", "ee")])
    doubles = ", ".join(f"'{d}'" for d in english.DOUBLES)
    mended = f"""case when kept or x = x0 or regexp_matches(x0, 'eed(ly)?$') then x when regexp_matches(x, '(at|bl|iz)$') then x || 'e'
      when right(x, 2) in ({doubles}) then substr(x, 1, length(x) - 1) when length(x) <= r1 and {short.format("x")} then x || 'e' else x end"""
    one = [(e, "@ >= r1" + (" and substr(x, @, 1) = 'l'" if e == "ogi" else f" and contains('{english.BEFORE_LI}', substr(x, @, 1)) and @ > 0" if e == "li" else ""), to) for e, to in english.DERIVED.items()]
    two = [(e, "@ >= r2" if e == "ative" else "@ >= r1", to) for e, to in english.DERIVED_AGAIN.items()]
    three = [(e, "@ >= r2" + (" and substr(x, @, 1) in ('s', 't')" if e == "ion" else ""), "") for e in english.REMOVED]
    last = f"""case when ends_with(x, 'e') and (length(x) - 1 >= r2 or length(x) - 1 >= r1 and not {short.format("substr(x, 1, length(x) - 1)")}) then substr(x, 1, length(x) - 1)
      when ends_with(x, 'll') and length(x) - 1 >= r2 then substr(x, 1, length(x) - 1) else x end"""
    whole = " ".join(f"when w = '{w}' then '{s}'" for w, s in english.WHOLE_WORDS.items())
    kept = ", ".join(f"'{w}'" for w in english.KEPT_AFTER_PLURALS)
    step = lambda name, source, x: f"{name} as (select w, r1, r2, kept, x as x0, case when kept then x else {x} end as x from {source})"
    return f"""s0 as (select w, regexp_replace(case when starts_with(w, 'y') then 'Y' || substr(w, 2) else w end, '([aeiouy])y', '\\1Y', 'g') as x from {words}),
s1 as (select w, x, case {first} else {region.format("x")} end as r1 from s0),
s2 as (select w, x, r1, r1 + {region.format("substr(x, r1 + 1)")} as r2 from s1),
s3 as (select w, r1, r2, {plurals} as x from s2),
s4 as (select w, r1, r2, x in ({kept}) as kept, x from s3),
{step("s5", "s4", cut)},
s6 as (select w, r1, r2, kept, {mended} as x from s5),
{step("s7", "s6", "case when length(x) > 2 then regexp_replace(x, '([^aeiouy])[yY]$', '" + chr(92) + "1i') else x end")},
{step("s8", "s7", _endings("x", one))},
{step("s9", "s8", _endings("x", two))},
{step("s10", "s9", _endings("x", three))},
{step("s11", "s10", last)},
stems as (select w, case when length(w) < 3 or regexp_matches(w, '[0-9]') then w {whole} else replace(x, 'Y', 'y') end as s from s11)"""


def _keyword_sql(where: str = "true"):
    """Cover density: each stretch that starts at the earliest of the last places of all terms counts
    up to the first place where it is complete."""
    asked = textindex.query_terms(ASKED)
    stops = ", ".join(f"'{w}'" for w in english.STOP_WORDS)
    terms = ", ".join(f"'{t}'" for t in asked)
    last = ", ".join(f"max(case when s = '{t}' then j end) over (partition by id order by j) as l{k}" for k, t in enumerate(asked))
    names = [f"l{k}" for k in range(len(asked))]
    return f"""texts as (select doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{textindex.WORD_BREAK}'), lambda x: x <> '') as t from documents where {where}),
spread as (select id, unnest(t) as w, unnest(range(len(t))) as i from texts),
vocabulary as (select distinct w from spread where w not in ({stops})),
{_stems_sql("vocabulary")},
places as (select id, s, i, row_number() over (partition by id order by i) as j from spread join stems using (w) where s in ({terms})),
m as (select id from places group by id having count(distinct s) = {len(asked)}),
lasts as (select id, j, {last} from places semi join m using (id)),
covers as (select id, least({", ".join(names)}) as a, min(j) as z from lasts where {" and ".join(n + " is not null" for n in names)} group by all),
keyed as (select c.id, round(sum({textindex.WEIGHT}::double / (1 + (q.i - p.i) - (c.z - c.a)) order by c.a), 9) as rank
  from covers c join places p on p.id = c.id and p.j = c.a join places q on q.id = c.id and q.j = c.z group by c.id)"""


def _indexed(spark, sf) -> str:
    """Stores an index over all documents and says where."""
    path = scratch.folder(spark)
    textindex.write(table(spark, sf, "documents"), path, id_col="doc_id", text_col="text")
    return path


@query(f"with {_keyword_sql()} select id from m")
def keyword_match_set(spark, sf):
    return textindex.search_stored(spark, _indexed(spark, sf), ASKED, None).select("id")


@query(f"with {_keyword_sql()} select id, round(rank, 6) as rank from keyed order by keyed.rank desc, id limit 10")
def keyword_topk(spark, sf):
    return textindex.search_stored(spark, _indexed(spark, sf), ASKED, 10).select("id", F.round("rank", 6).alias("rank"))


@query(f"with {_keyword_sql()} select s as term, count(*) as documents, cast(sum(n) as bigint) as places from (select id, s, count(*) as n from spread join stems using (w) group by id, s) group by s")
def text_index_terms(spark, sf):
    """The dictionary of the index: how many documents and places each term has."""
    return textindex.dictionary(table(spark, sf, "documents"), "doc_id", "text")


def _hybrid_sql(candidates, least):
    return _SIM + f""", {_keyword_sql()}, own as (select s.* from s join documents d on s.id = d.doc_id),
a as (select id, row_number() over (order by sim desc, id) as rs from own where sim >= {least} order by sim desc, id limit {candidates}),
b as (select keyed.id, row_number() over (order by rank desc, keyed.id) as rk from keyed join own on keyed.id = own.id order by rank desc, keyed.id limit {candidates})
select coalesce(a.id, b.id) as id, rs as rank_s, rk as rank_k, round(coalesce(0.7 / (60 + rs), 0) + coalesce(0.3 / (60 + rk), 0), 9) as score from a full join b on a.id = b.id
order by coalesce(0.7 / (60 + rs), 0) + coalesce(0.3 / (60 + rk), 0) desc, 1 limit 10"""


def _hybrid(spark, sf, factor, least):
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(_vectors(spark, sf), "id")
    hits = textindex.search_stored(spark, _indexed(spark, sf), ASKED, factor * 10, own)
    out = retrieval.hybrid(own, ASKED, QUERY_VECTOR, 10, factor, least, hits)
    return out.select("id", F.col("rank_s").cast("long"), F.col("rank_k").cast("long"), F.round("score", 9).alias("score"))


@query(_hybrid_sql(30, 0.05))
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf, 3, 0.05)


@query(_hybrid_sql(20, 0.3))
def hybrid_rrf_client(spark, sf):
    """The client's candidates and threshold."""
    return _hybrid(spark, sf, 2, 0.3)


@query(f"with {_keyword_sql()} select keyed.id, d.source, round(rank, 6) as rank from keyed join documents d on d.doc_id = keyed.id where d.lang = 'en' order by keyed.rank desc, keyed.id limit 5")
def search_maintenance_docs(spark, sf):
    """Keyword search among the documents of one kind; ``lang`` stands in for the kind."""
    docs = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source")
    hits = textindex.search_stored(spark, _indexed(spark, sf), ASKED, 5, docs)
    return hits.join(docs, "id").orderBy(F.desc("rank"), "id").select("id", "source", F.round("rank", 6).alias("rank"))


@query("""with t as (select doc_id, source, lang, text, row_number() over (order by n_chars desc, doc_id) as r from documents order by n_chars desc, doc_id limit 5)
select string_agg('[Source ' || r || ': ' || source || case when lang <> 'en' then ' (Material: ' || lang || ')' else '' end || ']' || chr(10) || text, chr(10) || '---' || chr(10) order by r) as context from t""")
def context_builder(spark, sf):
    top = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    hits = top.select((-F.col("n_chars")).alias("neg"), "doc_id", F.col("source").alias("name"), F.when(F.col("lang") != "en", F.col("lang")).alias("material"), F.col("text").alias("content"))
    return retrieval.context(hits.select(F.struct("neg", "doc_id").alias("rank"), "name", "material", "content"))


@query("""select 'documents' as table_name, count(*) as chunks, count(distinct source) as documents, round(avg(length(text)), 4) as avg_length, min(doc_id) as first, max(doc_id) as last from documents
union all select 'benchmark', count(*), count(distinct item_id), round(avg(length(text)), 4), min(item_id), max(item_id) from benchmark""")
def embedding_stats(spark, sf):
    one = retrieval.index_stats(table(spark, sf, "documents"), "documents", "source", "text", "doc_id")
    return one.unionByName(retrieval.index_stats(table(spark, sf, "benchmark"), "benchmark", "item_id", "text", "item_id"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where json_extract_string(props, '$.k') = '42' and json_exists(props, '$.k')")
def json_filter(spark, sf):
    rows = table(spark, sf, "events").where(retrieval.json_contains("props", {"k": 42}) & retrieval.json_has("props", "k"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select cast(json_extract_string(props, '$.k') as int) % 4 as bucket, count(*) as n, round(avg(value), 4) as avg_value from events group by 1")
def stats_by_json_key(spark, sf):
    return table(spark, sf, "events").groupBy((F.get_json_object("props", "$.k").cast("int") % 4).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("""with c as (select doc_id as document_id, unnest(range(0, greatest(length(text) - 65, 0) + 1, 448)) as start, text from documents where length(text) > 0)
select document_id, cast(start // 448 as int) as chunk_index, substr(text, start + 1, 512) as content from c""")
def doc_chunk_fixed(spark, sf):
    return chunking.fixed(table(spark, sf, "documents"), 512, 64)


_STRIP = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CHUNK_ROWS = """select document_id, cast(row_number() over (partition by document_id order by k) - 1 as int) as chunk_index, cast(count(*) over (partition by document_id) as int) as total_chunks,
  printf('%s_chunk_%04d', document_id, cast(row_number() over (partition by document_id order by k) - 1 as int)) as id, content, sha256(content) as content_hash from pieces"""
_RECURSIVE = f"""with recursive d as (select cast(doc_id as varchar) as document_id, {_STRIP.format("coalesce(text, '')")} as t from documents),
e as (select document_id, t, case {' '.join("when contains(t, '" + s.replace(chr(10), "' || chr(10) || '") + "') then '" + s.replace(chr(10), "' || chr(10) || '") + "'" for s in chunking.SEPARATORS)} else '' end as sep from d where length(t) > {chunking.SIZE}),
p as (select document_id, sep, length(sep) as w, case when sep = '' then list_filter(string_split(t, ''), lambda x: x <> '') else string_split(t, sep) end as parts from e),
c as (select document_id, sep, w, parts, len(parts) as m, (select list(s order by i) from (select i, sum(length(parts[i])) over (order by i) as s from (select unnest(range(1, len(parts) + 1)) as i))) as till from p),
r as (  -- a run from part a on that was last opened at part k (both from 1), and the part that closes it
  select document_id, 0 as step, 1 as a, 1 as k, cast(null as bigint) as closed from c
  union all
  select document_id, step + 1, cast(coalesce(list_filter(range(a, z + 1), lambda t: till[z - 1] - case when t > 1 then till[t - 1] else 0 end <= {chunking.OVERLAP})[1], z) as int), cast(z as int), a
  from (select r.document_id, step, a, k, till, list_filter(range(k + 1, m + 1), lambda z: till[z] - case when a > 1 then till[a - 1] else 0 end + (z - a) * w > {chunking.SIZE})[1] as z from r join c using (document_id)) where z is not null
),
runs as (
  select r.document_id, step, closed as a, k - 1 as b, false as last from r where step > 0
  union all select r.document_id, step + 1, a, m, true from (select *, row_number() over (partition by document_id order by step desc) as back from r) r join c using (document_id) where back = 1
),
texts as (
  select document_id, step, last, sep, substr(t, cast(before + (a - 1) * w + 1 as bigint), cast(till[b] - before + (b - a) * w as bigint)) as content
  from (select *, case when a > 1 then till[a - 1] else 0 end as before from runs join c using (document_id) join d using (document_id))
),
kept as (select *, lead(case when last and length(content) < {chunking.LEAST} and length(content) > 0 then sep || content end) over (partition by document_id order by step) as after from texts where last or length(content) >= {chunking.LEAST}),
pieces as (
  select document_id, step as k, content || coalesce(after, '') as content from kept where not last or length(content) >= {chunking.LEAST}
  union all select document_id, 0, t from d where length(t) between 1 and {chunking.SIZE}
) {_CHUNK_ROWS}"""
_AFTER = "length(around) - length(string_split(around, {0})[-1])"
_SLIDING = f"""with recursive d as (select cast(doc_id as varchar) as document_id, coalesce(text, '') as t from documents),
w as (
  select document_id, t, 0 as k, 0 as a, cast(null as bigint) as b, length(t) = 0 as done from d
  union all
  select document_id, t, k + 1, cast(greatest(z - {chunking.OVERLAP}, a + 1) as int), z, z >= length(t) from (
    select document_id, t, k, a, case when a + {chunking.SIZE} >= length(t) then length(t) {' '.join(f"when contains(around, {m}) then a + {chunking.SIZE // 2} + " + _AFTER.format(m) for m in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"))} else a + {chunking.SIZE} end as z
    from (select *, substr(t, a + {chunking.SIZE // 2} + 1, least(a + {chunking.SIZE + chunking.BEYOND}, length(t)) - a - {chunking.SIZE // 2}) as around from w where not done)
  )
),
spans as (select document_id, t, k, lag(a) over (partition by document_id order by k) as a, b from w),
pieces as (select document_id, k, content from (select document_id, k, {_STRIP.format("substr(t, a + 1, b - a)")} as content from spans where b is not null) where length(content) >= {chunking.LEAST_WINDOW})
{_CHUNK_ROWS}"""


@query(_RECURSIVE)
def doc_chunk_recursive(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"))


@query(_SLIDING)
def doc_chunk_sliding(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), chunking.sliding)


@query("select printf('%s_chunk_%04d', cast(doc_id as varchar), cast(doc_id % 7 as int)) as id, sha256(text) as content_hash, md5(cast(doc_id as varchar) || ':' || cast(doc_id % 7 as varchar)) as short_id from documents")
def chunk_ids(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(chunking.chunk_id(d.cast("string"), (d % 7).cast("int")).alias("id"), F.sha2("text", 256).alias("content_hash"), F.md5(F.concat_ws(":", d.cast("string"), (d % 7).cast("string"))).alias("short_id"))
