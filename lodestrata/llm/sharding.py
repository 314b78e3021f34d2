"""Sharding by a permutation that can be computed: shuffled rows, shard and slot from a row's number.

Rows get their global numbers from a sort by id (then checksum, then size); a keyed Feistel
network permutes the numbers.  The network works on the next power of four; a number that
leaves the table is sent through it again until it is back (cycle walking), which is again a
permutation.  The place of number i is shard ``p(i) % shards`` and slot ``p(i) // shards``, so
shards differ by one row at most and slots have no gaps.  ``row_at`` is the way back: a reader
finds the row of any shard and slot without a table.  The law that holds is ``rows``; groups of
equal texts are dealt out like any other rows.

Edge cases: a null text has no bytes (size 1, checksum 0); a null id sorts first; repeated rows
each get a number of their own, and as they are equal it does not matter which; very long texts
are read once and only their size and checksum move (``places``); an empty table has no
rows; extra columns, whatever their names, are carried (``sharded``, but for the three it adds) or
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestrata.llm.common import stored

SHARDS = 8
SEED = 13
ROUNDS = 4
#: Odd multipliers under 2**62 of the round function, and the step between round keys (fixed values).
MULTIPLIERS = (0x3F51AFD7ED558CCD, 0x34CEB9FE1A85EC53)
KEY_STEP = 0x9E3779B97F4A7C15
COPIES_AT_ONCE = 1 << 16
PARTITION_BITS = 33  # of monotonically_increasing_id: the row within its partition


def round_keys(seed: int = SEED) -> list[int]:
    return [(seed + 1 + k) * KEY_STEP % (1 << 64) for k in range(ROUNDS)]


def half_bits(rows: int) -> int:
    """Half the bits of the network's domain, the least power of four that holds all numbers."""
    return max(1, ((rows - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(33))


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << np.uint64(half)) | right


def _network_back(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys):
        left, right = right ^ (_mixed(left, key) & mask), left
    return (left << np.uint64(half)) | right


def _walked(step, numbers, rows: int, seed: int) -> np.ndarray:
    half, keys = half_bits(rows), round_keys(seed)
    out = step(np.asarray(numbers).astype(np.uint64), half, keys)
    while len(outside := np.flatnonzero(out >= rows)):
        out[outside] = step(out[outside], half, keys)
    return out.astype(np.int64)


def permuted(numbers, rows: int, seed: int = SEED) -> np.ndarray:
    """Where each of the numbers 0 to ``rows - 1`` goes."""
    return _walked(_network, numbers, rows, seed)


def row_at(shard, slot, rows: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The numbers of the rows that stand at these places."""
    return _walked(_network_back, np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), rows, seed)


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_number``, the place of each row in the order, from 0; and how many rows there are.

    Range partitions are sorted and stored with each row's place in its partition; the
    partitions' sizes, as many as there are partitions, give where each begins.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(spread.withColumn("row_number", F.monotonically_increasing_id()))
    part = F.shiftright("row_number", PARTITION_BITS)
    sizes = placed.groupBy(part.alias("in_part")).agg(F.count(F.lit(1)).alias("in_rows"))
    starts = sizes.select("in_part", F.sum("in_rows").over(Window.orderBy("in_part")) - F.col("in_rows"), "in_rows").toDF("in_part", "in_start", "in_rows")
    starts = stored(starts)
    rows = starts.agg(F.sum("in_rows")).first()[0] or 0
    own = F.col("row_number").bitwiseAND((1 << PARTITION_BITS) - 1)
    found = placed.join(F.broadcast(starts), part == F.col("in_part"))
    return found.withColumn("row_number", F.col("in_start") + own).select(placed.columns), rows


def dealt(df: DataFrame, rows: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df``, which has ``row_number``, with the ``shard`` and ``slot`` of each row."""

    def run(batches):
        for b in batches:
            to = permuted(b.column("row_number").to_numpy(), rows, seed) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((to % shards).astype(np.int32)), pa.array(to // shards)], [*b.schema.names, "shard", "slot"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("shard", IntegerType()), StructField("slot", LongType())]))


def measured(text):
    """The size of a text (UTF-8 bytes and 1) and its checksum."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def places(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number) of every row; no text moves.

    Repeated rows are counted and given out again, so no sort key is hot.
    """
    size, crc = measured(F.col(text_col))
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    copies = light.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    blocks = copies.select("*", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES_AT_ONCE}L)")).alias("low"))
    each = blocks.select("doc_id", "size", "text_crc32", F.explode(F.expr(f"sequence(low, least(low + {COPIES_AT_ONCE}, copies) - 1)")).alias("copy"))
    known, rows = numbered(each, "doc_id", "text_crc32", "size", "copy")
    out = dealt(known, rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``row_number``, ``shard`` and ``slot``; texts move once, in the sort."""
    size, crc = measured(F.col(text_col))
    own = [c for c in docs.columns if c not in ("row_number", "shard", "slot")]
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(id_col).alias("id"), crc.alias("crc"), size.alias("size"))
    known, rows = numbered(wrapped, "id", "crc", "size")
    return dealt(known, rows, shards, seed).select("row.*", "row_number", "shard", "slot")


def written(shards: DataFrame, path: str) -> None:
    """One folder for each shard, whose files hold their rows in the order of the slots."""
    shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _network_sql(number: str, source: str, rest: str = "") -> str:
    """Selects ``y``, the network's value for ``number``, from ``source``; DuckDB's hugeint holds the products."""
    word = f"{1 << 64}::hugeint"
    mix = lambda x, key: (
        f"list_reduce([xor({x}::hugeint, {key}::hugeint) * {MULTIPLIERS[0]}::hugeint % {word}, 0], lambda a, b: xor(a, a >> 33) * {MULTIPLIERS[1]}::hugeint % {word})"
    )
    columns, left, right = [f"{number}::hugeint >> half as l0", f"{number}::hugeint & mask as r0"], "l0", "r0"
    for k, key in enumerate(round_keys()):
        columns += [f"{mix(right, key)} as m{k}", f"xor({left}, xor(m{k}, m{k} >> 33) & mask) as r{k + 1}"]
        left, right = right, f"r{k + 1}"
    return f"select {rest} (({left} << half) | {right})::bigint as y from (select *, {', '.join(columns)} from {source})"


#: The same places in DuckDB's SQL; the checksum is worked out byte by byte over a table made by its rule.
SQL = f"""
with recursive poly as (
  select n, n as c, 0 as k from (select unnest(range(256)) as n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from poly where k < 8
),
crc as (select list(c order by n) as t from poly where k = 8),
bytes as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as x from documents),
light as (
  select doc_id, n + 1 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || substr(x, 2 * i + 1, 2))::bigint for i in range(n)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
  from bytes, crc
),
num as (
  select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as i, count(*) over () as total,
    greatest(1, (length(ltrim(bin(count(*) over () - 1), '0')) + 1) // 2)::int as half from light
),
start as (select *, (1::hugeint << half) - 1 as mask from num),
walk as (
  select i, total, half, mask, y from ({_network_sql("i", "start", "i, total, half, mask,")})
  union all
  select i, total, half, mask, y from ({_network_sql("y", "(select i, total, half, mask, y as y from walk where y >= total)", "i, total, half, mask,").replace("select *,", "select i, total, half, mask,")})
)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(y % 8 as int) as shard, cast(y // 8 as bigint) as slot,
  cast(null as int) as grown_shard, cast(i as bigint) as row_number
from start join (select i, y from walk where y < total) using (i)
"""
