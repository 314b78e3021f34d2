"""SimHash near-duplicates found through anchor points of a covering code.

A 64-bit fingerprint is cut into two halves of 32 bits.  Two fingerprints that
differ in at most three bits differ in at most one bit in one of the halves.  In
a half, the code words of the perfect Hamming code over 31 bits, with a free last
bit, are the anchors: each value is within ``RADIUS`` (1) of one.  A fingerprint has
its nearest anchor as home and is replicated to every anchor within the radius
plus one; whoever is one bit away from it meets it at its home.  Fingerprints are
compared per anchor, and each anchor yields a star for each group it finds, so
copies never become pairs.

Edge cases: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows count as copies; a null doc_id keeps its fingerprint and is
never the smallest id, so a component of such rows alone has a null component_id; a very
long text is hashed whole, a block of shingles at a time; an empty table has no rows;
extra columns, whatever their names, are carried (``keep_first``) or ignored.  Ids are whole
numbers.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import stored
from lodestrata.llm.components import components, star_labels

RADIUS = 1
MOST_BITS = 3  # floor(MOST_BITS / 2) is the number of bits a half may differ by
PAIRS_AT_ONCE = 1 << 21
SHINGLES_AT_ONCE = 1 << 16
LOOKUP_FROM = 2048  # larger anchors look up all values within the distance instead


def simhash(text: bytes, shingle: int, seed: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    grams = iter([b" ".join(words)]) if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n, on = 0, np.zeros(64, np.int64)
    while part := [xxhash.xxh64_intdigest(g, seed) for g in islice(grams, SHINGLES_AT_ONCE)]:
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64)
        on += np.add.reduce(bits, axis=0, dtype=np.uint32)
        n += len(part)
    return int(np.packbits(2 * on > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            fps = [simhash(t, shingle, seed) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, whether it is the home) for every anchor in reach."""
    everyone = np.arange(len(fps))
    out = []
    for side in (0, 1):
        half = ((fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(31):
            syndrome ^= ((half >> i) & 1) * (i + 1)
        home = np.where(syndrome > 0, half ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), half)
        tag = np.int64(side) << 32
        out += [(tag | home, everyone, np.ones(len(fps), bool)), (tag | (home ^ (1 << 31)), everyone, np.zeros(len(fps), bool))]
        for i in range(1, 32):  # two flips whose columns add up to the syndrome, each pair once
            other = syndrome ^ i
            ok = np.flatnonzero((syndrome > 0) & (other > i))
            far = half[ok] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (other[ok] - 1))
            out.append((tag | far, ok, np.zeros(len(ok), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def within(bits: int) -> np.ndarray:
    """All 64-bit masks with one to ``bits`` bits set."""
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    found, last = [], np.zeros(1, np.uint64)
    for _ in range(bits):
        last = np.unique(np.bitwise_xor.outer(last, ones))
        found.append(last)
    masks = np.unique(np.concatenate(found))
    return masks[(np.bitwise_count(masks) <= bits) & (masks > 0)]


def links(fps: np.ndarray, home: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int):
    """Linked (u, v) within anchors; large anchors yield stars only."""
    us, vs = [], []
    small = (sizes > 1) & (sizes <= LOOKUP_FROM)
    big = np.flatnonzero(sizes > LOOKUP_FROM)
    rows = np.flatnonzero(home & np.repeat(small, sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)
    n = sizes[group[rows]]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        m = n[lo:hi]
        x = np.repeat(rows[lo:hi], m)
        y = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[group[rows[lo:hi]]], m)
        ok = (np.bitwise_count(fps[x] ^ fps[y]) <= bits) & (fps[x] != fps[y])
        us.append(fps[x[ok]])
        vs.append(fps[y[ok]])
        lo = hi
    masks = within(bits) if len(big) else ()
    for g in big:
        own = np.unique(fps[starts[g] : starts[g] + sizes[g]])
        label = own.copy()
        for mask in masks:
            at = np.minimum(np.searchsorted(own, own ^ mask), len(own) - 1)
            ok = np.flatnonzero(own[at] == own ^ mask)
            np.minimum.at(label, ok, own[at[ok]])
            us.append(own[ok[own[ok] < own[at[ok]]]])
            vs.append(own[at[ok[own[ok] < own[at[ok]]]]])
            if sum(map(len, us)) > PAIRS_AT_ONCE:
                a, b = star_labels(np.concatenate(us), np.concatenate(vs))
                us, vs = [a], [b]
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def fingerprint_links(fps: DataFrame, bits: int) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v): stars that join all fingerprints that link."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"this code covers distances up to {MOST_BITS}")

    def replicate(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            anchor, at, home = anchors(own)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[at].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches):
        """Rows come sorted by anchor; the last anchor of a batch waits for the next batch."""
        kept = None
        for b in _with_end(batches):
            if b is None:
                if kept is None:
                    return
                a, f, h = kept
                cut = len(a)
            else:
                new = (b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
                a, f, h = new if kept is None else (np.concatenate(x) for x in zip(kept, new))
                if not len(a):
                    continue
                cut = int(np.searchsorted(a, a[-1], "left"))
            kept = (a[cut:], f[cut:], h[cut:])
            a, f, h = a[:cut], f[:cut], h[:cut]
            if not len(a):
                continue
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            u, v = links(f, h, starts, np.diff(np.r_[starts, len(a)]), bits)
            if len(u):
                u, v = star_labels(u, v)
                ok = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[ok].view(np.int64)), pa.array(v[ok].view(np.int64))], ["u", "v"])

    spread = fps.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(fingerprint_links(classes, bits))
    known = classes.join(labels, classes.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    tops = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # (fp, component) is stored so that the join below is with a plain scan, whose hot
    # fingerprints adaptive execution can split
    of = stored(known.join(tops, "label").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows that share that id stay together; rows without an id are kept.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(options.get("id_col", "doc_id")).cast("long").alias("id"))
    first = near_duplicates(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    kept = own.join(first, F.col("id") == F.col("first"), "left_semi")
    return kept.unionByName(own.where("id is null")).select("row.*")
