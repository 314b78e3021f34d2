"""Repeated windows of symbols (bytes or words), found at content-chosen anchors.

Every window of ``window`` symbols contains ``window - gram + 1`` grams; the one with
the least hash, the leftmost of equals, is its anchor.  Equal windows have equal
anchors at equal places, wherever they occur.  The windows that share one anchor form
its context, a stretch of text that is known by the hash of its anchor's gram and by an
XXH3 digest of all its symbols.  Contexts whose gram occurs once cannot hold a repeated window.

Grams that very many contexts have (``hot_grams``, counted over all texts) anchor a window only
if it has no other gram.  So a line that a third of all texts share does not gather all texts around
it: windows that reach beyond the line have their anchors there, and windows inside it are
equal contexts, of which the first stands for all.  A gram with still more different
contexts than a shard holds is settled window by window in one more shuffle.
A text that repeats itself with a short period has one context per period, all of them equal:
they are one row with their number, ``times``, so that no row is made for each period.

Digests only say where to look.  ``claims`` are stretches of a text with the place where
they are said to have occurred first; texts are dealt out to shards, each shard is
given the passages its texts claim, and the callers (``phrases``, ``runindex``) find these in the
texts symbol by symbol.  So nothing is removed on the strength of a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import pieces, stored, utf8

SLICE = 1 << 19
SHARD_TEXT = 1 << 22  # bytes of text in a shard, about
SHARDS_AT_ONCE = 64  # shards that one row of a source text serves
HOT_FROM = 500  # occurrences from which a gram is hot
HOT_HERE = 4
HOT_FLUSH = 4_000_000
HOT_SHARE = 256  # of this many grams that are rarer than HOT_HERE in a flush, one is reported for all
HOT_REPORTS = 8  # such reports from which they count
HOT_TABLE = 1 << 25  # bytes that the flags of hot grams take at most
ASKED_DOCS = 1_000_000  # documents asked for a passage up to which their ids are broadcast
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 32) - 1)

_tables: dict = {}  # what a task has computed; a plain dict travels with the functions


@dataclass(frozen=True)
class Unit:
    """What is compared: words or bytes, in windows of so many; whether an earlier start in
    the same text counts; and the bytes of different contexts of one gram that a task takes."""

    words: bool
    window: int
    gram: int
    same_text_counts: bool
    most_bytes: int


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_tables.get("powers", ((),))[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables["powers"] = tuple(out)
    return _tables["powers"]


def byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["bytes"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _room(n: int) -> int:
    return 1 << max(20, int(n + 1).bit_length())


class Prefix:
    """Hashes of any stretch of a symbol array, from one running sum."""

    def __init__(self, symbols: np.ndarray):
        self.p, self.q = powers(_room(len(symbols)))
        self.sum = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.p[: len(symbols)], out=self.sum[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sum[stop] - self.sum[start]) * self.q[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sum) - k
        return (self.sum[k:] - self.sum[:n]) * self.q[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts in ``data[at[0]:at[-1]]``: starts, stops, and each text's first word."""
    b = ~_SPACE[data[at[0] : at[-1]]]
    own = at - at[0]
    prev = np.r_[False, b[:-1]]
    edges = own[1:-1][own[1:-1] < len(b)]
    prev[edges] = False
    starts = np.flatnonzero(b & ~prev)
    ends = np.r_[~b[1:], True] if len(b) else b
    ends[edges[edges > 0] - 1] = True
    stops = np.flatnonzero(b & ends) + 1
    return starts, stops, np.searchsorted(starts, own)


@dataclass
class Symbols:
    """Symbols of some texts: a 64-bit value of each, where each text's begin, and a buffer
    in which equal stretches of symbols are equal bytes, from ``start`` to ``stop`` of them."""

    value: np.ndarray
    first: np.ndarray
    buffer: memoryview
    start: np.ndarray | None
    stop: np.ndarray | None

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (lo, hi) if self.start is None else (self.start[lo], self.stop[hi - 1])

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """XXH3 of each stretch of symbols."""
        f, b = xxhash.xxh3_64_intdigest, self.buffer
        a, z = self.bounds(lo, hi)
        return np.fromiter((f(b[i:j]) for i, j in zip(a.tolist(), z.tolist())), np.uint64, len(lo)).view(np.int64)


def symbols(data: np.ndarray, at: np.ndarray, words: bool) -> Symbols:
    """Words are parted by one space in the buffer; bytes are their own."""
    own = data[at[0] : at[-1]]
    if not words:
        return Symbols(byte_values()[own], at - at[0], memoryview(own), None, None)
    starts, stops, first = word_spans(data, at)
    size = stops - starts
    value = mixed(Prefix(byte_values()[own]).of(starts, stops))
    begin = np.cumsum(size) - size + np.arange(len(size))
    flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
    kept = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    flat[kept] = own[~_SPACE[own]]
    return Symbols(value, first, memoryview(flat), begin, begin + size)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def contexts(s: Symbols, window: int, gram: int, hot: np.ndarray | None = None):
    """(gram hash, text, first symbol, windows) of each anchor's context.

    A gram is hot if the table ``hot`` (a power of two of bytes, a flag in each bit) says so for its last bits;
    what anchors a window thus depends on nothing but the window.
    """
    none = np.zeros(0, np.int64)
    if len(s.value) < window:
        return none, none, none, none
    g = mixed(Prefix(s.value).grams(gram))
    key = g >> np.uint64(1)
    if hot is not None and len(hot):
        flag = hot[(g >> np.uint64(3)) & np.uint64(len(hot) - 1)] >> (g & np.uint64(7)).astype(np.uint8) & 1
        key |= flag.astype(np.uint64) << np.uint64(63)
    key = (key & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_min(key, window - gram + 1) & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    ok = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :])
    if not len(ok):
        return none, none, none, none
    anchor = anchor[ok]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)])
    lo = ok[new]
    return g[anchor[new]].view(np.int64), doc[lo], lo, np.diff(np.r_[new, len(ok)])


def hot_grams(docs: DataFrame, unit: Unit) -> tuple[np.ndarray, int]:
    """The table of hot grams (a bit for each value of their last bits), and the bytes of all texts.

    A partition sends the grams that ``HOT_FLUSH`` of its grams have ``HOT_HERE`` times or more; most
    are ruled out by a count per bucket of hashes.  Of the rarer ones each flush reports one in
    ``HOT_SHARE``, chosen by hash of the gram and the flush, so that a gram that is rare in every flush
    but has very many of them is found, too.  One that is missed costs time, not results.
    The bound for a hot gram is a power of two times ``HOT_FROM``: the first with which the table, of 64
    bits or more for each hot gram, stays within ``HOT_TABLE`` bytes.
    """
    buckets = np.uint64((1 << 22) - 1)

    def run(batches):
        kept, rows, size = [], 0, 0

        def often():
            g = np.concatenate(kept)
            full = np.bincount((g & buckets).view(np.int64), minlength=int(buckets) + 1) >= HOT_HERE
            turn = mixed(g[:1] + np.uint64(len(g))) % np.uint64(HOT_SHARE)
            rare = g[(g >> np.uint64(40)) % np.uint64(HOT_SHARE) == turn]
            g, n = np.unique(g[full[g & buckets]], return_counts=True)
            ok = n >= HOT_HERE
            rare, m = np.unique(rare[~np.isin(rare, g[ok])], return_counts=True)
            exact = np.r_[n[ok], np.zeros(len(m), np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[g[ok], rare].view(np.int64)), pa.array(exact), pa.array(np.r_[np.zeros(len(n[ok]), np.int64), m])], ["h", "n", "m"])

        for b in batches:
            data, at = utf8(b.column(0))
            size += int(at[-1] - at[0])
            for lo, hi in pieces(at, SLICE):
                value = symbols(data, at[lo : hi + 1], unit.words).value
                if len(value) >= unit.gram:
                    kept.append(mixed(Prefix(value).grams(unit.gram)))
                    rows += len(kept[-1])
                if rows > HOT_FLUSH:
                    yield often()
                    kept, rows = [], 0
        if rows:
            yield often()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([size], pa.int64()), pa.array([0], pa.int64())], ["h", "n", "m"])

    texts = docs.where("doc_id is not null and text is not null").select("text")
    sums = texts.mapInArrow(run, "h long, n long, m long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total = F.col("n") + F.when(F.col("m") >= HOT_REPORTS, F.col("m") * HOT_SHARE).otherwise(0)
    counts = stored(sums.select("h", total.alias("n")).where(f"h is null or n >= {HOT_FROM}"))
    size = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    hot = counts.where("h is not null").select("h", F.floor(F.log2(F.col("n") / HOT_FROM)).alias("level"))
    levels, most, least = {r.level: r["count"] for r in hot.groupBy("level").count().collect()}, HOT_TABLE // 8, 0
    while sum(n for level, n in levels.items() if level >= least) > most:
        least += 1
    found = hot.where(F.col("level") >= least).select("h").toArrow().column(0).to_numpy().view(np.uint64)
    flags = np.zeros(1 << max(10, len(found).bit_length() + 3) if len(found) else 0, np.uint8)
    if len(found):
        flags = flags[: max(HOT_TABLE, 1)]
        np.bitwise_or.at(flags, (found >> np.uint64(3)) & np.uint64(len(flags) - 1), np.uint8(1) << (found & np.uint64(7)).astype(np.uint8))
    return flags, size


ANCHOR = "key long, h long, dg long, doc_id long, th int, lo int, n int, times int, known boolean"


def periods(h: np.ndarray, dg: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in the order of the texts: the first of each run of equal ones (those of a text leave no
    window out, so each begins ``n`` windows after the one before), and how many these are."""
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (dg[1:] != dg[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])][: len(h)])
    return new, np.diff(np.r_[new, len(h)])


def anchors(docs: DataFrame, unit: Unit, hot: np.ndarray) -> DataFrame:
    """(doc_id, th, text) -> a row per context; a row without id or text has none.

    Within a batch of texts equal contexts meet before any shuffle: those that an equal
    one precedes are repeats, whatever other batches hold.  All but one of these are
    ``known``: they wait for what is found out about the context and get a key of their own,
    which deals them out evenly, so that a passage of a third of all texts sends two
    rows from each batch to its own key.
    """
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for b in batches:
            data, at = utf8(b.column(2))
            found = []
            for lo, hi in pieces(at, SLICE):
                s = symbols(data, at[lo : hi + 1], unit.words)
                h, d, start, n = contexts(s, unit.window, unit.gram, held.value)
                dg = s.digests(start, start + n + (unit.window - 1))
                new, times = periods(h, dg, d, n)
                found.append((h[new], dg[new], d[new] + lo, (start - s.first[d])[new], n[new], times))
            if not found:
                continue
            h, dg, row, start, n, times = (np.concatenate(x) for x in zip(*found))
            doc = b.column(0).to_numpy(zero_copy_only=False)[row]
            same = mixed(h.view(np.uint64) * np.uint64(3) ^ dg.view(np.uint64))
            order = np.lexsort((start, doc, same))
            new = np.r_[True, same[order][1:] != same[order][:-1]][: len(order)]
            top = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            after = (doc[order] != doc[top]) | ((start[order] != start[top]) if unit.same_text_counts else False)
            known = np.zeros(len(h), bool)
            known[order] = after & np.r_[False, after[:-1] & ~new[1:]][: len(order)]
            own = mixed(doc.astype(np.uint64) << np.uint64(24) ^ start.astype(np.uint64)).view(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(known, own, h)), pa.array(h), pa.array(dg), b.column(0).take(take), b.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (start, n, times)), pa.array(known)],
                ["key", "h", "dg", "doc_id", "th", "lo", "n", "times", "known"],
            )

    return docs.where("doc_id is not null and text is not null").select("doc_id", "th", "text").mapInArrow(run, ANCHOR)


def recurring(rows: DataFrame) -> DataFrame:
    """Contexts whose gram occurs elsewhere: with the place of the first equal one (src_doc,
    src_th, src_lo), their number among the equal ones, whether those are several places, and
    whether the gram has different contexts.  All of that is null for a ``known`` row."""
    equal = Window.partitionBy("key", "dg").orderBy("doc_id", "lo", "th")
    all_equal = Window.partitionBy("key", "dg")
    gram = Window.partitionBy("key")
    src = F.first(F.struct("doc_id", "th", "lo")).over(equal)
    marked = rows.repartition("key").withColumns({"src": src, "rank": F.row_number().over(equal)})
    marked = marked.withColumn("copied", F.sum("times").over(all_equal) > 1)
    marked = marked.withColumns({"rows": F.sum("times").over(gram), "several": F.min("dg").over(gram) != F.max("dg").over(gram)}).where("known or rows > 1")
    of = lambda c: F.when(~F.col("known"), F.col(c))
    return marked.select(
        "h", "dg", "doc_id", "th", "lo", "n", "times", "known", of("src.doc_id").alias("src_doc"), of("src.th").alias("src_th"), of("src.lo").alias("src_lo"),
        of("rank").alias("rank"), of("copied").alias("copied"), of("several").alias("several"),
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): rows that share an id are told apart by a hash of their text.  Ids
    must be whole numbers, or text that is one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))


def cut(docs: DataFrame, asked: DataFrame, unit: Unit, carried: list[str]) -> DataFrame:
    """``asked`` (doc_id, th, lo, n, ...) -> its ``carried`` columns and body: the symbols of n
    windows from lo on, words joined by one space.  Equal rows of ``docs`` answer once.  Texts
    that nothing is asked of are left out before the shuffle, if those asked are few enough to be told to all tasks."""
    names = ["doc_id", "th", "lo", "n", *carried]
    few_docs = stored(asked.select("doc_id").distinct().limit(ASKED_DOCS + 1))
    few_docs = few_docs if few_docs.count() <= ASKED_DOCS else None
    per_doc = asked.groupBy("doc_id", "th", *(["part"] if "part" in asked.columns else [])).agg(F.collect_list(F.struct("lo", "n", *carried)).alias("asked"))
    kind = {f.name: f.dataType.simpleString() for f in asked.schema.fields}

    def run(batches):
        for b in batches:
            data, at = utf8(b.column(2))
            own = b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3)
            from_, flat = np.asarray(own.offsets), own.values
            flat = flat.slice(from_[0], from_[-1] - from_[0])
            lo, n = (flat.field(k).to_numpy().tolist() for k in (0, 1))
            row, body = np.repeat(np.arange(b.num_rows), np.diff(from_)), []
            for i in range(b.num_rows):
                text = data[at[i] : at[i + 1]].tobytes()
                part = text.split() if unit.words else text
                for k in range(from_[i] - from_[0], from_[i + 1] - from_[0]):
                    piece = part[lo[k] : lo[k] + n[k] + unit.window - 1]
                    body.append(b" ".join(piece) if unit.words else piece)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(flat.field(k) for k in range(2 + len(carried))), pa.array(body, pa.binary())], [*names, "body"])

    texts = docs.where("doc_id is not null and text is not null")
    if few_docs is not None:
        texts = texts.join(F.broadcast(few_docs), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return texts.join(per_doc, ["doc_id", "th"]).select("doc_id", "th", "text", "asked").mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in names) + ", body binary")


def groups(batches, most_bytes: int):
    """Rows sorted by h, in tables of whole h groups of about ``most_bytes`` of bodies."""
    kept, size = [], 0
    for b in batches:
        h = b.column("h").to_numpy()
        lens = np.diff(utf8(b.column("body"))[1])
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        for lo, hi in zip(edge, np.r_[edge[1:], len(h)]):
            if kept and size > most_bytes and kept[-1].column("h")[-1].as_py() != h[lo]:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
            kept.append(b.slice(lo, hi - lo))
            size += int(lens[lo:hi].sum())
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def numbered(bodies: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all bodies one after the other, as numbers from 1 (equal if and only if
    they are the same symbol), a 0 after each; and how many each body takes."""
    if not words:
        flat = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8).astype(np.int64) + 1
        flat[flat == 256] = 0  # never a byte of UTF-8
        return flat, np.array([len(x) + 1 for x in bodies])
    number: dict[bytes, int] = {}
    flat, sizes = [], []
    for body in bodies:
        own = [number.setdefault(w, len(number) + 1) for w in body.split()]
        sizes.append(len(own) + 1)
        flat += own
        flat.append(0)
    return np.array(flat, np.int64), np.array(sizes)


def first_places(t: pa.Table, unit: Unit):
    """The windows of a shard's contexts that recur -> (context, at, windows, context of the
    first occurrence, its start there): runs of windows whose first occurrences are neighbours."""
    none = (np.zeros(0, np.int64),) * 5
    ids, sizes = numbered(t.column("body").to_pylist(), unit.words)
    row = np.repeat(np.arange(len(sizes)), sizes)
    began = np.cumsum(sizes) - sizes
    m = len(ids) - unit.window + 1
    if m <= 0:
        return none
    zeros = np.r_[0, np.cumsum(ids == 0)]
    at = np.flatnonzero(zeros[unit.window :][:m] == zeros[:m])
    if not len(at):
        return none
    hash_of = mixed(Prefix(mixed(ids.astype(np.uint64))).of(at, at + unit.window))
    doc, lo = t.column("doc_id").to_numpy(), t.column("lo").to_numpy()
    pos = lo[row[at]] + at - began[row[at]]
    order = np.lexsort((pos, doc[row[at]], hash_of))
    new = np.r_[True, hash_of[order][1:] != hash_of[order][:-1]]
    first = np.empty(len(at), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    copied = t.column("copied").to_numpy(zero_copy_only=False).astype(bool)
    own, theirs = doc[row[at]], doc[row[at[first]]]
    earlier = theirs < own
    if unit.same_text_counts:
        earlier |= (theirs == own) & (pos[first] < pos)
    i = np.flatnonzero(earlier | copied[row[at]])
    if not len(i):
        return none
    a, f = at[i], at[first[i]]
    edge = np.flatnonzero(np.r_[True, (a[1:] != a[:-1] + 1) | (f[1:] != f[:-1] + 1) | (row[a[1:]] != row[a[:-1]])])
    r, fr = row[a[edge]], row[f[edge]]
    return r, a[edge] - began[r], np.diff(np.r_[edge, len(i)]), fr, f[edge] - began[fr]


FOUND = "h long, dg long, at int, n int, src_doc long, src_th int, src_lo int"


def joined_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, lo, n, src_doc, src_th, src_lo, src_n) with neighbouring ones made one where
    their sources are neighbours too; rows of more windows than their source (``src_n``) stay."""
    w = Window.partitionBy(*keys).orderBy("lo", "src_doc", "src_th", "src_lo")
    follows = (
        (F.lag(F.col("lo") + F.col("n")).over(w) == F.col("lo"))
        & (F.lag("src_doc").over(w) == F.col("src_doc"))
        & (F.lag("src_th").over(w) == F.col("src_th"))
        & (F.lag(F.col("src_lo") - F.col("lo")).over(w) == F.col("src_lo") - F.col("lo"))
        & F.lag(F.col("n") == F.col("src_n")).over(w)
        & (F.col("n") == F.col("src_n"))
    )
    run = F.sum(F.when(follows, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("run", run).groupBy(*keys, "run")
    total = [F.sum(c).cast("int").alias(c) for c in ("n", "src_n")]
    return parts.agg(F.min("lo").alias("lo"), *total, F.first("src_doc").alias("src_doc"), F.first("src_th").alias("src_th"), F.min("src_lo").alias("src_lo")).drop("run")


def by_window(bodies: DataFrame, unit: Unit) -> DataFrame:
    """``FOUND`` for contexts of grams with too many of them: each window goes to its own
    128-bit hash, and what it meets there tells its first occurrence."""

    def run(batches):
        for b in batches:
            data, at = utf8(b.column("body"))
            for lo, hi in pieces(at, SLICE):
                s = symbols(data, at[lo : hi + 1], unit.words)
                m = len(s.value) - unit.window + 1
                owner = np.repeat(np.arange(hi - lo), np.diff(s.first))
                w = np.flatnonzero(owner[:m] == owner[unit.window - 1 :]) if m > 0 else np.zeros(0, np.int64)
                a, z = s.bounds(w, w + unit.window)
                digest = b"".join(xxhash.xxh3_128_digest(s.buffer[i:j]) for i, j in zip(a.tolist(), z.tolist()))
                h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                take, offset = pa.array(owner[w] + lo), (w - s.first[owner[w]]).astype(np.int32)
                own = [b.column(c).take(take) for c in ("h", "dg", "doc_id", "th", "lo", "copied")]
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *own, pa.array(offset)], ["w1", "w2", "h", "dg", "doc_id", "th", "from", "copied", "at"])

    windows = stored(bodies.mapInArrow(run, "w1 long, w2 long, h long, dg long, doc_id long, th int, `from` int, copied boolean, at int"))
    place = F.struct("doc_id", (F.col("from") + F.col("at")).alias("lo"), "th")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("src"))
    earlier = F.col("src.doc_id") < F.col("doc_id")
    if unit.same_text_counts:
        earlier = earlier | ((F.col("src.doc_id") == F.col("doc_id")) & (F.col("src.lo") < F.col("from") + F.col("at")))
    rows = windows.join(first, ["w1", "w2"]).where(earlier | F.col("copied"))
    rows = rows.select("h", "dg", F.col("at").alias("lo"), F.lit(1).alias("n"), F.col("src.doc_id").alias("src_doc"), F.col("src.th").alias("src_th"), F.col("src.lo").alias("src_lo"), F.lit(1).alias("src_n"))
    return joined_runs(rows, ["h", "dg"]).drop("src_n").withColumnRenamed("lo", "at")


def settled(docs: DataFrame, found: DataFrame, unit: Unit) -> DataFrame:
    """``FOUND`` for the grams with different contexts: which windows of a context occurred
    first where."""
    firsts = found.where("several and rank = 1")
    size = F.sum(F.col("n").cast("long") + (unit.window - 1)) * (8 if unit.words else 1)
    large = stored(firsts.groupBy("h").agg(size.alias("size")).where(F.col("size") > unit.most_bytes).select("h"))
    carried = ["h", "dg", "copied"]
    split = None
    if not large.isEmpty():
        split = by_window(cut(docs, firsts.join(large, "h"), unit, carried), unit)
        firsts = firsts.join(large, "h", "left_anti")

    def run(batches):
        for t in groups(batches, unit.most_bytes):
            row, at, n, src, src_at = first_places(t, unit)
            own, theirs = pa.array(row), pa.array(src)
            lo = t.column("lo").to_numpy()[src] + src_at
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks().take(own) for c in ("h", "dg")), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                 *(t.column(c).combine_chunks().take(theirs) for c in ("doc_id", "th")), pa.array(lo.astype(np.int32))],
                ["h", "dg", "at", "n", "src_doc", "src_th", "src_lo"],
            )

    out = cut(docs, firsts, unit, carried).repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)
    return out if split is None else out.unionByName(split)


def claims(docs: DataFrame, unit: Unit) -> tuple[DataFrame, int]:
    """(shard, doc_id, th, lo, n, src_doc, src_th, src_lo, src_n): n windows from lo on that are
    said to have occurred first among the src_n (all n, or the period in which they recur) of src_doc
    from src_lo on; and the number of shards."""
    hot, size = hot_grams(docs, unit)
    shards = max(1, -(-size // SHARD_TEXT))
    found = stored(recurring(anchors(docs, unit, hot)))
    several = stored(settled(docs, found, unit))
    once = found.where("not known and not several and copied and rank = 1")
    verdict = several.unionByName(once.select("h", "dg", F.lit(0).alias("at"), "n", "src_doc", "src_th", "src_lo"))
    source = ["src_doc", "src_th", "src_lo", F.col("n").alias("src_n")]
    direct = found.where("not known and not several and (rank > 1 or times > 1)").select("doc_id", "th", "lo", F.col("n").alias("step"), "times", *source)
    asking = found.where("known or several").select("h", "dg", "doc_id", "th", F.col("lo").alias("from"), F.col("n").alias("step"), "times")
    answered = asking.join(verdict, ["h", "dg"]).select("doc_id", "th", (F.col("from") + F.col("at")).alias("lo"), "step", "times", *source)
    # of ``times`` contexts, ``step`` windows apart, those count that begin after the source
    late = F.when(F.col("src_doc") < F.col("doc_id"), F.lit(0))
    if unit.same_text_counts:
        late = late.when(F.col("src_doc") == F.col("doc_id"), F.greatest(F.lit(0), F.floor((F.col("src_lo") - F.col("lo")) / F.col("step")).cast("int") + 1))
    every = direct.unionByName(answered).withColumn("late", late).where("late < times")
    every = every.select("doc_id", "th", F.expr("lo + late * step as lo"), F.expr("(times - late - 1) * step + src_n as n"), "src_doc", "src_th", "src_lo", "src_n")
    return stored(joined_runs(every, ["doc_id", "th"]).withColumn("shard", shard_of(shards))), shards


def shard_of(shards: int):
    return F.pmod(F.xxhash64("doc_id", "th"), F.lit(shards)).cast("int")


def passages(docs: DataFrame, claimed: DataFrame, unit: Unit) -> DataFrame:
    """(shard, doc_id, th, lo, n, body): the passages that the texts of each shard claim."""
    asked = claimed.select("shard", F.col("src_doc").alias("doc_id"), F.col("src_th").alias("th"), F.col("src_lo").alias("lo"), F.col("src_n").alias("n")).distinct()
    return cut(docs, asked.withColumn("part", F.floor(F.col("shard") / SHARDS_AT_ONCE)), unit, ["shard"])


def removed(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A mask over ``n`` symbols, True where one of the stretches lies."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    return np.cumsum(change[:-1]) > 0
