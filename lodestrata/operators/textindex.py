"""Keyword search over an inverted index: term -> (document, places), stored by term.

``write`` stems every text once, makes its lists in the task that has it, and lays them out in
folders by a hash of the term, by one shuffle; each folder's lists are cut by a hash of the
document over several tasks and files, and sorted by term and document.  ``search`` reads the folders and, by the files' statistics, the parts of its own terms
alone; no text is read or stemmed again.

Edge cases: a null or empty text has no postings; a null id is left out; of repeated rows with
one id the places are put together; a query of stop words alone finds nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import english

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"
BUCKETS = 64
PARTS = 16
WORDS_AT_ONCE = 1 << 19
#: Fixed value: the weight of a term in a text without sections.
WEIGHT = 0.1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    """The distinct stems of a query without its stop words, in order; a few words, on the driver."""
    import regex

    found = (w for w in regex.split(WORD_BREAK, text.lower()) if w)
    return list(dict.fromkeys(english.stem(w) for w in found if w not in english.STOP_WORDS))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(term, id, places): the places of each term in each text, from 0 and in order; stop words
    are left out, but keep their places.  An id that several rows have has lists for each of them."""
    own = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")).where("id is not null")
    return own.mapInArrow(_listed, own.select(F.lit("").alias("term"), "id", F.array(F.lit(0)).alias("places")).schema)


def _listed(batches):
    """Texts are taken up to ``WORDS_AT_ONCE`` words at a time; their different words alone are stemmed."""
    stops = frozenset(english.STOP_WORDS)
    for b in batches:
        offsets = np.asarray(b.column(1).offsets).astype(np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WORDS_AT_ONCE, "right")) - 1)
            yield from _lists_of(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).flatten(), np.diff(offsets[lo : hi + 1]), stops)
            lo = hi


def _lists_of(ids: pa.Array, flat: pa.Array, sizes: np.ndarray, stops: frozenset):
    coded = flat.dictionary_encode()
    terms: dict[str, int] = {}
    number = np.array([-1 if w in stops else terms.setdefault(english.stem(w), len(terms)) for w in coded.dictionary.to_pylist()], np.int64)
    if not terms:
        return
    term = number[coded.indices.to_numpy()]
    place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(term >= 0)
    key = (np.repeat(np.arange(len(sizes)), sizes) * len(terms) + term)[kept]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    row, of = np.divmod(key[first], len(terms))
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[kept][order].astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(of)), ids.take(pa.array(row)), places], ["term", "id", "places"])


def _part() -> Column:
    """A hash of the id within ``PARTS``: cuts the lists of a frequent term over as many tasks."""
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")


def write(docs: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite", **columns) -> None:
    """Stores the lists of ``docs`` at ``path``; ``append`` adds the lists of more documents."""
    bucket = (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")
    rows = postings(docs, **columns).select("term", "id", "places", bucket.alias("bucket"), _part())
    rows.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "id").write.mode(mode).partitionBy("bucket").parquet(path)


def dictionary(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(term, documents, places): how many documents and places each term has."""
    rows = postings(docs, id_col, text_col).select("term", "id", F.size("places").alias("n"), _part())
    each = rows.repartition("term", "part").groupBy("term", "part", "id").agg(F.sum("n").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("places"))


def lists(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, id, places) of these terms, from their own folders and files."""
    own = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    stored = spark.read.schema("term string, id long, places array<int>, bucket int").parquet(path)
    return stored.where(F.col("bucket").isin(own) & F.col("term").isin(terms)).drop("bucket")


#: The sum, over the shortest stretches that hold all terms, of a weight that falls with the words
#: between.  ``entries`` are (place, term from 0) in order of place; the fold keeps each term's last entry,
#: and a stretch counts when no earlier one starts inside of it.
_LAST = "transform(s.last, (v, k) -> if(k = element_at(entries, i).term, i, v))"
_NOISE = f"element_at(entries, i).place - element_at(entries, array_min({_LAST})).place - (i - array_min({_LAST}))"
_NEW = f"array_min({_LAST}) > s.begin"
COVER_DENSITY = f"""aggregate(sequence(1, size(entries)), named_struct('last', array_repeat(0, cast(terms as int)), 'begin', 0, 'total', 0D),
  (s, i) -> named_struct('last', {_LAST}, 'begin', if({_NEW}, array_min({_LAST}), s.begin), 'total', if({_NEW}, s.total + {WEIGHT}D / (1 + {_NOISE}), s.total)), s -> round(s.total, 9))"""


def search(found: DataFrame, query: str, k: int | None, within: DataFrame | None = None) -> DataFrame:
    """(id, rank): documents that hold all terms of the query, the k best by cover density (ties to
    the smaller id), or all in no order if k is None.

    ``found`` are posting lists, of these terms at least; ``within`` (id) restricts the documents.
    """
    asked = query_terms(query)
    own = found.where(F.col("term").isin(asked)) if asked else found.limit(0)
    if within is not None:
        own = own.join(within.select("id"), "id", "left_semi")
    number = F.array_position(F.array(*map(F.lit, asked or [""])), F.col("term")).cast("int") - 1
    coded = own.select("id", "term", F.transform("places", lambda p: F.struct(p.alias("place"), number.alias("term"))).alias("entries"))
    whole = coded.groupBy("id").agg(F.count_distinct("term").alias("terms"), F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    hits = whole.where(F.col("terms") == len(asked))
    ranked = hits.select("id", F.expr(COVER_DENSITY).alias("rank"))
    return ranked if k is None else ranked.orderBy(F.desc("rank"), "id").limit(k)


def search_stored(spark: SparkSession, path: str, query: str, k: int | None, within: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    return search(lists(spark, path, query_terms(query), buckets), query, k, within)
