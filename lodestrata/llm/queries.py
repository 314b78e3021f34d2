"""The queries of this subpackage, and their DuckDB twins where SQL has one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import audit, chat, decontaminate, langid, mergedrop, negatives, oneperm, phrases, runindex, sharding, simhash, toxicity, urlquery
from lodestrata.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(col: str) -> str:
    lower = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


ORACLE["op3_benchmark_decontamination"] = f"""
with d as (select doc_id, {_words_sql("text")} as w from documents),
i as (select item_id, {_words_sql("text")} as w from benchmark),
iw as (
  select distinct item_id, list_slice(w, s, s + least(13, len(w)) - 1) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from i where len(w) > 0)
),
lens as (select distinct len(win) as n from iw),
dw as (
  select doc_id, s, n, list_slice(w, s, s + n - 1) as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)
),
found as (select doc_id, s, n, item_id from dw join iw using (win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from found) group by doc_id),
listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join listed using (doc_id)
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    every = given.union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.formatted(every, f"{TOKENIZERS}/byte_bpe_50k.json"))


ORACLE["op6_chat_formatting"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) as v(conv_id, turn, role, text)
),
e as (
  select *, length(text) + len(regexp_extract_all(text, '\\|###|</turn>|: ')) as n,
    length(role) + len(regexp_extract_all(role, '\\|###|</turn>|: ')) as m
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + m + 2 + n + 8) as bigint) as formatted_chars
from e group by conv_id
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.deduplicated(table(spark, sf_dir, "documents"))


ORACLE["op9_substring_dedup"] = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as p from d where len(w) >= 50),
h as (select doc_id, p, md5_number(array_to_string(list_slice(w, p, p + 49), ' ')) as k from s),
f as (select k, min(doc_id) as first from h group by k having count(*) > 1),
dup as (select distinct doc_id, unnest(range(p, p + 50)) as i from h join f using (k) where doc_id > first),
gone as (select doc_id, list(i) as gone from dup group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(case when gone is null then array_to_string(w, ' ')
    else coalesce(array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i)), ' '), '') end) as kept_sha256
from d left join gone using (doc_id)
"""


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.deduplicated(table(spark, sf_dir, "documents"))


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneperm.fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergedrop.digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES["op4_url_filters"] = urlquery.query
ORACLE["op4_url_filters"] = urlquery.SQL


@query
def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_interaction_audit"] = audit.SQL


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(table(spark, sf_dir, "documents"))


ORACLE["op13_sharding"] = sharding.SQL


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE["op12_hard_negatives"] = negatives.SQL
