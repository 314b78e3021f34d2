"""Document fingerprints by one-permutation MinHash, in DataFrame operations.

Each shingle of five words is hashed once.  The top bits of a hash name its bin, and
sorting the hashes of a text puts the least of each bin first.  An empty bin borrows
from the first non-empty bin on its own probe sequence (optimal densification), and
the low ``BITS`` bits of all bins, packed, are the fingerprint (the highest value of each bin marks its
end and counts as no hash).  Two values agree by
chance with probability 2^-BITS, and the likeness is corrected for that.

Edge cases: a null text is empty; a text without words has the empty fingerprint,
which is like itself (1) and unlike all others (0); a shorter text than one shingle is
one shingle; rows that share an id are put in order by a hash of their text, equal
rows are one document in that order and each gets the result; null ids come first.
The one document of a table is its own successor.  A very long text is one array of words
in its row, and all its shingles count; an empty table gives no rows; extra columns,
whatever their names, are ignored by ``fingerprints``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import stored

SHINGLE = 5
BIN_BITS = 7
BITS = 8
FEW_PROBES = 16
BINS = 1 << BIN_BITS


def probes() -> list[list[int]]:
    """For each bin all bins, in the order in which it asks them: a keyed rule, the same
    for every document."""
    order = []
    for b in range(BINS):
        rank = [(((b * BINS + t + 1) * 0x9E3779B97F4A7C15) ^ ((t + 1) * 0xC2B2AE3D27D4EB4F)) % (1 << 64) for t in range(BINS)]
        rank = [((r ^ r >> 29) * 0xBF58476D1CE4E5B9) % (1 << 64) >> 20 for r in rank]
        order.append(sorted(range(BINS), key=rank.__getitem__))
    return order


def _ints(rows: list[list[int]]) -> Column:
    return F.expr("array(" + ",".join("array(" + ",".join(map(str, r)) + ")" for r in rows) + ")")


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _texts(values: list[str]) -> Column:
    return F.expr("array(" + ",".join(f"'{v}'" for v in values) + ")")


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` in column ``out``.

    Each step is a column of its own, as the lambdas of the next look into it often.
    """
    w, s, d, f = (f"_{x}_{out}" for x in "wsdf")
    df = df.withColumn(w, F.array_remove(F.split(text, "[ \t-\r]+"), ""))
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + k) for k in range(shingle))), 1))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 1))
    found = F.when(F.size(w) >= shingle, grams).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<long>"))
    bin_of = 63 - BIN_BITS
    # the highest value of each bin closes it, so that the first of every bin in sorted order is its least, or says that it is empty
    df = df.withColumn(s, F.sort_array(F.concat(found, _longs([((b + 1) << bin_of) - 1 for b in range(BINS)]))))
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, bin_of) != F.shiftright(F.get(s, i - 1), bin_of)))
    df = df.withColumn(d, F.transform(first, lambda x: F.when(x.bitwiseAND((1 << bin_of) - 1) != (1 << bin_of) - 1, x.bitwiseAND((1 << BITS) - 1).cast("int"))))
    table = probes()
    few, every = _ints([r[:FEW_PROBES] for r in table]), _ints(table)

    def ask(order, i):
        return F.get(d, F.get(F.filter(F.get(order, i), lambda t: F.get(d, t).isNotNull()), F.lit(0)))

    df = df.withColumn(f, F.transform(d, lambda x, i: F.when(x.isNotNull(), x).otherwise(F.coalesce(ask(few, i), ask(every, i)))))
    digits = _texts([f"{v:0{BITS // 4}x}" for v in range(1 << BITS)])
    packed = F.array_join(F.transform(f, lambda x: F.get(digits, x)), "")
    return df.withColumn(out, F.when(F.size(w) > 0, packed).otherwise("")).drop(w, s, d, f)


def _folded(by: int):
    return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, by))


def differing(a: str, b: str) -> Column:
    """How many bins differ, 64 bits of both fingerprints at a time: the bits of a bin in which
    they differ are folded into its lowest one."""
    digits = 16
    longs = lambda c: F.transform(F.sequence(F.lit(1), F.lit(BINS * BITS // 4), F.lit(digits)), lambda i: F.conv(F.substr(F.col(c), i, F.lit(digits)), 16, -10).cast("long"))
    bits, step = F.zip_with(longs(a), longs(b), lambda x, y: x.bitwiseXOR(y)), BITS // 2
    while step:
        bits = F.transform(bits, _folded(step))
        step //= 2
    lowest = sum(1 << k for k in range(0, 64, BITS))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + F.bit_count(x.bitwiseAND(lowest)))


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance of two fingerprints, corrected for chance agreement."""
    agree = BINS - differing(a, b)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(estimate)


def successors(keys: DataFrame) -> DataFrame:
    """(k, doc_id, n) -> the same with next_k, in the order of (doc_id, k), the last followed by
    the first.  Ranges of the order are linked inside, and their heads to one another:
    one row per range is all that meets in one place."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(keys.repartitionByRange(parts, "doc_id", "k").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("doc_id", "k")
    linked = ranged.withColumn("inner_k", F.lead("k").over(inside))
    heads = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "k")).alias("head")).select("part", F.col("head.k").alias("head_k"))
    across = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead("head_k").over(across), F.first("head_k").over(across)).alias("next_head"))
    return linked.join(follow, "part").select("k", "doc_id", "n", F.coalesce("inner_k", "next_head").alias("next_k"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and likenesses."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # the id is part of the key, so that a collision of hashes can join no two ids
    given = given.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), "doc_id", "text")
    keys = given.groupBy("k").agg(F.max(F.length("text")).alias("n")).select("k", "k.doc_id", "n")
    chain = stored(successors(keys))
    # both joins below read the texts in the same two columns, so that they share one shuffle, whose
    # partitions are not merged where they are small, as the work on a text is much more than its bytes
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # and whose key has the type of the stored one to the letter: a cast in a join would shuffle the texts once more
    own = given.select(F.col("k").cast(chain.schema["k"].dataType).alias("k"), "text").repartition(many, "k")
    quarter = F.floor(F.col("n") / 4).cast("int")
    asked = chain.select(F.col("next_k").alias("k"), F.col("k").alias("for_k"), "doc_id", quarter.alias("q"))
    parts = own.join(asked, "k").select("for_k", "doc_id", F.expr("left(text, q)").alias("head")).repartition(many, "for_k")
    parts = parts.groupBy(F.col("for_k").alias("k")).agg(F.first("doc_id").alias("doc_id"), F.first("head").alias("head"))
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), "head")
    both = own.join(parts, "k").select("k", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    made = stored(both.drop("text", "edited"))
    following = made.groupBy("k").agg(F.first("fingerprint").alias("next_fingerprint")).withColumnRenamed("k", "next_k")
    out = made.join(chain.select("k", "next_k").join(following, "next_k"), "k")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
