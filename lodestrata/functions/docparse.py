"""Documents to rows: headings and metadata of texts, catalogs in JSON, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = T.StructType([T.StructField(c, T.StringType()) for c in ("material", "name", "group", "type", "description")])


def title(text: Column) -> Column:
    """The first heading of the first level, or null."""
    found = F.regexp_extract(text, r"(?m)^# (.+)$", 1)
    return F.when(found != "", F.trim(found))


def equipment_id(text: Column) -> Column:
    found = F.regexp_extract(text, r"EQ-\d+-\w+-\d+", 0)
    return F.when(found != "", found)


def health_score(text: Column) -> Column:
    """The number before ``/100`` in either way that documents write a health score."""
    found = F.regexp_extract(text, r"Health Score[\s|:*]*(\d+)\s*/\s*100", 1)
    return found.try_cast("int")


def risk_word(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\b(low|medium|high|critical)\b\s+risk", 1)
    return F.when(found != "", F.initcap(found))


def document_type(file: Column) -> Column:
    """The prefix of a file's name up to the first underscore."""
    return F.regexp_extract(file, r"([^/_]+)_[^/]*$", 1)


def catalog_products(files: DataFrame) -> DataFrame:
    """(source_file, text) of JSON catalogs, a list or an object with ``products`` -> a row
    per product with its lines of text."""
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.products"), T.ArrayType(PRODUCT)), F.from_json("text", T.ArrayType(PRODUCT)))
    rows = files.select("source_file", F.explode(listed).alias("p"))
    lines = [F.concat(F.lit(f"{c}: "), F.col(f"p.{c}")) for c in PRODUCT.names]
    return rows.select("source_file", F.col("p.material").alias("material"), F.concat_ws("\n", *lines).alias("text"))


def citations(text: Column, rules: dict[str, list[str]]) -> Column:
    """The names of all rules of which any keyword is in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), name) for name, words in rules.items()]
    return F.array_compact(F.array(*hits))
