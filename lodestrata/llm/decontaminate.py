"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

An item window is ``width`` consecutive words of an item, or the whole of a
shorter one.  The tokens of a window are ordered by rarity over all documents.
Containment must be complete, so the necessary prefix is one token: the rarest.
Document words join the prefix tokens; a candidate then has to fit into the
document (length bound), to hold the second rarest token at its place (positional
bound), and at last to equal the window word by word.

Edge cases: a null or wordless text has no words and is never contaminated; a
wordless item has no window; items that share an id count once, and items without
one hit words but are not listed; repeated rows each get the same result; a very long text
is one array of words in its row; empty tables give no rows, or no hits; extra columns,
whatever their names, are ignored or carried (``drop_contaminated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import ascii_lower, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20  # what a stored table may take, as rows in memory, to be broadcast


def words(text: Column) -> Column:
    found = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def held_bytes(words: Column) -> Column:
    """About what an array of words takes in a row."""
    return F.aggregate(words, F.lit(64).cast("long"), lambda n, w: n + F.octet_length(w) + 24)


def is_small(df: DataFrame, row_bytes: Column, most: int | None = None) -> bool:
    """Whether all rows of a stored table together take few enough bytes to be broadcast."""
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def broadcast_if_small(df: DataFrame, row_bytes: Column) -> DataFrame:
    return F.broadcast(df) if is_small(df, row_bytes) else df


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, win): the distinct windows of each item, as arrays of words."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return own.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("win")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Each window with its two rarest tokens and their places (0-based)."""
    vocabulary = stored(windows.select(F.explode("win").alias("token")).distinct())
    seen = (
        docs.select(F.explode(words(F.col(text_col))).alias("token"))
        .join(broadcast_if_small(vocabulary, F.octet_length("token") + 64), "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarity = stored(vocabulary.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")))
    placed = windows.select("item_id", "win", F.posexplode("win").alias("place", "token")).join(broadcast_if_small(rarity, F.octet_length("token") + 72), "token")
    ordered = placed.groupBy("item_id", "win").agg(F.array_sort(F.collect_list(F.struct("n", "token", "place"))).alias("by_rarity"))
    first, second = F.col("by_rarity")[0], F.get("by_rarity", F.least(F.lit(1), F.size("by_rarity") - 1))
    return ordered.select(
        "item_id", "win", first["token"].alias("token"), first["place"].alias("place"), second["token"].alias("token2"), second["place"].alias("place2")
    )


def occurrences(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, th, item_id, start, stop): every place where a window occurs in a text.

    Small prefixes are broadcast to the words, and no text moves.  Otherwise words
    without their text are joined with the prefixes, and the candidates, whose number of words is that of their
    window alone, meet each text once, to be verified there.
    """
    windows = stored(item_windows(items, width))
    wanted = stored(prefixes(windows, docs, text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.when(F.get("w", start + F.col("place2")) == F.col("token2"), F.slice("w", start + 1, F.size("win")) == F.col("win")).otherwise(False)
    if is_small(wanted, held_bytes(F.col("win")) + F.octet_length("token") + F.octet_length("token2") + 128):
        at = own.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token")).join(F.broadcast(wanted), "token")
        at = at.where(F.when(fits, same).otherwise(False))
    else:
        alone = own.select("doc_id", "th", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
        found = alone.join(wanted, "token").where(fits).withColumnsRenamed({"doc_id": "found_id", "th": "found_th"})
        at = found.join(own, F.col("found_id").eqNullSafe(F.col("doc_id")) & (F.col("found_th") == F.col("th"))).where(same)
    return at.select("doc_id", "th", "item_id", start.alias("start"), (start + F.size("win")).alias("stop"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, one_in: int = 20) -> DataFrame:
    """A row per document: words, words hit, items found, and the verdict.

    A document is contaminated if any word is hit and ``one_in`` times the hit words
    reach its words.
    """
    found = stored(occurrences(docs, items, id_col, text_col, width))
    key = ["doc_id", "th"]
    spans = found.select(*key, "start", "stop").distinct()
    before = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", done))
    hit = spans.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    listed = found.select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy(*key).agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    per_doc = hit.join(listed.withColumnsRenamed({"doc_id": "d2", "th": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select(
        F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "n_hit", "n_items", "items"
    )
    n_words = F.size(words(F.col(text_col))).cast("long")
    every = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), n_words.alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return every.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; rows without an id are judged by
    their text like all others, as the verdict is joined by id and text together."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    verdict = contamination(own.select(F.struct("id", "th").alias("doc_id"), "text"), items, **options)
    bad = verdict.where("contaminated").select("doc_id.*").distinct().toDF("bad_id", "bad_th")
    return own.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("th") == F.col("bad_th")), "left_anti").select("row.*")
