"""URL filters as a temporal list join, in DataFrame operations.

A list is a log of dated entries: from ``since`` on, ``pattern`` of ``kind`` is in ``category``
with ``verdict`` ``block`` or ``allow``, or no longer listed (``remove``).  The next entry for the same
kind, pattern and category ends the one before, which makes validity intervals.  A
capture asks for the patterns that its URL falls under (its host and all parent
domains, and the host with each leading path) and an as-of join takes the entries
whose interval holds the time of the capture.  The most specific pattern decides; an
allowance beats a block of the same pattern.

Edge cases: a null or unparseable URL, or one without time, is under no entry and is
not blocked; entries without kind, pattern or date are ignored; patterns may be written as URLs,
with a leading dot or a final slash (``normalised``); hosts and paths are compared without case, as
lists write them; of several entries with
one date for the same pattern and category the last in the order remove, block, allow
stands, and repeated ones count once; repeated captures each get a row, told apart by
no more than their columns; a very long URL is split as a whole; an empty list blocks nothing,
an empty table has no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalised(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, verdict, since) with patterns as URLs are asked for: without scheme,
    user, port, query, wildcard, outer dots and slashes, and in lower case.  A path entry that names no
    path is one of its host; an entry that names no host is left out."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("pattern"), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#][\s\S]*$", "")
    site = F.regexp_extract(bare, r"^(?:[^/@]*@)?(?:\*\.|\.)*([^/:]*?)\.*(?::[0-9]*)?(?:/|$)", 1)
    steps = F.filter(F.split(F.regexp_extract(bare, r"^[^/]*(/[\s\S]*)$", 1), "/"), lambda x: x != "")
    deep = (F.col("kind") == "path") & (F.size(steps) > 0)
    kind = F.when((F.col("kind") == "path") & ~deep, "host").otherwise(F.col("kind"))
    pattern = F.lower(F.when(deep, F.concat_ws("/", site, F.array_join(steps, "/"))).otherwise(site))
    return entries.where(site != "").select(kind.alias("kind"), pattern.alias("pattern"), "category", "verdict", "since")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, verdict, valid_from, valid_to); an open end is null."""
    strength = F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1).otherwise(0)
    named = normalised(entries.where("kind is not null and pattern is not null and since is not null"))
    daily = named.groupBy("kind", "pattern", F.coalesce("category", F.lit("")).alias("category"), "since").agg(F.max(strength).alias("strength"))
    following = Window.partitionBy("kind", "pattern", "category").orderBy("since")
    ended = daily.withColumn("valid_to", F.lead("since").over(following)).where("strength > 0")
    return ended.select("kind", "pattern", "category", F.when(F.col("strength") == 2, "allow").otherwise("block").alias("verdict"), F.col("since").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """The lower-cased host, without user, port or a final dot."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns(host_col: str, path_col: str, deepest_col: str) -> Column:
    """All (kind, pattern, weight) a URL falls under, with as many leading path segments as
    ``deepest_col`` says; the weight grows with how specific the pattern is."""
    labels = F.split(host_col, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("pattern"), i.alias("weight"))
    )
    whole = F.array(F.struct(F.lit("host").alias("kind"), F.col(host_col).alias("pattern"), F.lit(1000).alias("weight")))
    steps = F.filter(F.split(F.lower(path_col), "/"), lambda x: x != "")
    depth = F.least(F.size(steps), F.col(deepest_col))
    paths = F.when(
        depth > 0,
        F.transform(
            F.sequence(F.lit(1), depth),
            lambda i: F.struct(F.lit("path").alias("kind"), F.concat(F.col(host_col), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("pattern"), (i + 1000).alias("weight")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string,weight:int>>"))
    return F.when(F.col(host_col) != "", F.concat(domains, whole, paths))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """A row per capture: host, time, whether it is blocked, and by what.

    The URLs are joined on their patterns.  A short list is broadcast by Spark's own
    estimate; with a long one, adaptive execution splits the rows of a domain that a third of
    all captures fall under, as both sides of the join are dealt for it alone.  All entries of a
    capture are then brought together by its own key.
    """
    own = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    listed = intervals(entries)
    deepest = listed.where("kind = 'path'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("deepest"))
    urls = own.distinct().withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).crossJoin(F.broadcast(deepest))
    asked = urls.withColumn("asked", patterns("host", "path", "deepest"))
    keys = asked.select("page_id", "url", "fetched_at", F.explode("asked").alias("a")).select("page_id", "url", "fetched_at", "a.*")
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(listed, ["kind", "pattern"]).where(active)
    best = F.max(F.struct("weight", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allows"), "kind", "pattern", "category", "valid_from")).alias("best")
    per = hits.groupBy("page_id", "url", "fetched_at").agg(best, F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    per = per.withColumnsRenamed({"page_id": "p2", "url": "u2", "fetched_at": "f2"})
    same = F.col("page_id").eqNullSafe(F.col("p2")) & F.col("url").eqNullSafe(F.col("u2")) & F.col("fetched_at").eqNullSafe(F.col("f2"))
    return own.join(per, same, "left").select(
        "page_id", host(F.col("url")).alias("host"), "fetched_at",
        F.coalesce(F.col("best.allows") == 0, F.lit(False)).alias("blocked"),
        F.col("best.kind").alias("rule_kind"), F.col("best.pattern").alias("rule"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("rule_since"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"),
    )
