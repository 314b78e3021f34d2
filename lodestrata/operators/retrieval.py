"""Retrieval: exact cosine search, keyword search, rank fusion, context."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import textindex


def cosine(vector: str | Column, wanted: list[float]) -> Column:
    """Similarity to a literal query vector; null for a null, zero or mismatched vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*(F.lit(float(x)) for x in wanted))
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    length = sum(float(x) * float(x) for x in wanted) ** 0.5
    return F.when((norm > 0) & (F.size(v) == len(wanted)), dot / (norm * length)) if length else F.lit(None).cast("double")


def semantic(vectors: DataFrame, wanted: list[float], k: int, least: float | None = 0.3, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar rows among those that reach the threshold."""
    rows = vectors.withColumn("similarity", cosine(vector_col, wanted)).where("similarity is not null")
    if least is not None:
        rows = rows.where(F.col("similarity") >= least)
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


def semantic_then_threshold(vectors: DataFrame, wanted: list[float], k: int, least: float = 0.3, **columns) -> DataFrame:
    """The k most similar rows, less those below the threshold."""
    return semantic(vectors, wanted, k, None, **columns).where(F.col("similarity") >= least)


def keyword(docs: DataFrame, query: str, k: int | None, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Rows that hold all terms of the query, the k best by cover density, or all in no order
    if k is None; none for stop words alone.

    For a text that is searched once; ``textindex.write`` and ``search_stored`` serve many searches.
    """
    hits = textindex.search(textindex.postings(docs, id_col, text_col), query, k).withColumnRenamed("id", "_hit")
    ranked = docs.join(hits, F.col(id_col) == F.col("_hit")).drop("_hit")
    return ranked if k is None else ranked.orderBy(F.desc("rank"), id_col).limit(k)


def fused(semantic_hits: DataFrame, keyword_hits: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3), rrf_k: int = 60, id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of two candidate lists, each a small multiple of k long."""

    def ranked(hits: DataFrame, score: str, name: str) -> DataFrame:
        return hits.select(F.col(id_col), F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias(name))

    both = ranked(semantic_hits, "similarity", "rank_s").join(ranked(keyword_hits, "rank", "rank_k"), id_col, "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (rrf_k + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part(weights[0], "rank_s") + part(weights[1], "rank_k")).orderBy(F.desc("score"), id_col).limit(k)


def hybrid(docs: DataFrame, query: str, wanted: list[float], k: int, factor: int = 3, least: float = 0.1, hits: DataFrame | None = None, **options) -> DataFrame:
    """Fusion of both searches over ``docs``; ``hits`` are the keyword search's (id, rank), where an index has them."""
    by_word = keyword(docs, query, factor * k) if hits is None else hits.orderBy(F.desc("rank"), "id").limit(factor * k)
    return fused(semantic(docs, wanted, factor * k, least), by_word, k, **options)


def context(hits: DataFrame, order: str = "rank") -> DataFrame:
    """One text of numbered sources from a short ranked list (name, material, content)."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "name", "material", "content")))
    part = lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), s["name"], F.when(s["material"].isNotNull(), F.concat(F.lit(" (Material: "), s["material"], F.lit(")"))).otherwise(""), F.lit("]\n"), s["content"])
    return hits.agg(F.array_join(F.transform(ordered, part), "\n---\n").alias("context"))


def json_contains(column: str, wanted: dict) -> Column:
    """Whether a JSON object has each key with an equal value of the same type; objects are
    compared key by key, a number equals another way to write it."""
    return F.coalesce(_holds(F.try_parse_json(F.col(column)), "$", wanted), F.lit(False))


def _holds(parsed: Column, path: str, wanted: dict) -> Column:
    out = F.lit(True)
    for key, value in wanted.items():
        if not key.replace("_", "").isalnum():
            raise ValueError(f"unsafe key {key!r}")
        at = f"{path}.{key}"
        text = F.to_json(F.try_variant_get(parsed, at, "variant"))
        if isinstance(value, dict):
            same = text.startswith("{") & _holds(parsed, at, value)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            same = text.try_cast("double") == F.lit(float(value))
        elif value is None or isinstance(value, (str, bool)):
            same = text == F.lit(json.dumps(value, ensure_ascii=False))
        else:
            raise ValueError(f"cannot compare {key!r} with a {type(value).__name__}")
        out = out & same
    return out


def json_has(column: str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def index_stats(chunks: DataFrame, name: str, document: str, content: str, at: str) -> DataFrame:
    return chunks.agg(
        F.lit(name).alias("table_name"), F.count("*").alias("chunks"), F.countDistinct(document).alias("documents"), F.round(F.avg(F.length(content)), 4).alias("avg_length"), F.min(at).alias("first"), F.max(at).alias("last")
    )
