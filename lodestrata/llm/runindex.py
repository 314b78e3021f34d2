"""Substring deduplication over bytes, with a run-length index.

Strings of 100 bytes that occur more than once are found at anchors (see ``repeats``),
which says where a stretch of a text is claimed to have occurred first.  Texts are
dealt out to shards.  The passages that a shard's texts claim are indexed: their
Burrows-Wheeler transform is kept as runs with the suffix positions sampled at both ends
of each run.  The claimed stretches of all texts, copies included, are streamed backwards
through it for their matching statistics, the length of the longest match of each
position and one place of it.  A match is extended while the byte before its place is the next
one, many bytes at a time; where it is not, the sampled ends of the neighbouring runs of
that byte give the places whose match, cut back to what they share, goes on.  So steps are
taken for the places where matches break off, not for each byte.  A string whose match reaches 100
bytes at a place of the corpus before its own is removed.  As places and lengths come from
the bytes themselves, no hash removes anything.

Edge cases: a null text is empty; an empty table has no rows; a row without id is neither
removed from nor a source; rows that share an id count as one document; repeated rows get
equal results; a very long text is streamed in pieces that overlap by a window; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.repeats import Unit, claims, keyed, passages, removed, shard_of

WINDOW = 100
GRAM = 16
SHARD_BYTES = 1 << 18
PIECE = 512  # windows of a passage that are indexed, or streamed, together
COMPARED = 1 << 19  # bytes that are compared at once, about
BORDER = 255  # never a byte of UTF-8


def unit_of(window: int) -> Unit:
    return Unit(False, window, min(GRAM, window), True, SHARD_BYTES)


def suffix_order(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the place of each in it.  A suffix ends with its border, ``left`` bytes
    from its start; equal ones stand in the order of the text.  A round sorts only those that are
    not told apart yet, by three ranks of the first 8, 24, 72, ... bytes where these fit
    into 63 bits, by two otherwise."""
    n = len(text)
    first = np.ndarray(n, ">u8", np.r_[text, np.zeros(8, np.uint8)], strides=(1,)).astype(np.uint64)
    key = first & (np.uint64((1 << 64) - 1) << (8 * (8 - np.minimum(left, 8))).astype(np.uint64))
    bits = (n + 1).bit_length()
    many, k = 3 if 3 * bits <= 63 else 2, 8
    order, rank = np.empty(n, np.int32), np.empty(n, np.int32)
    slot = at = np.arange(n, dtype=np.int32)
    while len(at):
        by = np.argsort(key)
        at, own = at[by], key[by]
        new = np.r_[True, own[1:] != own[:-1]]
        order[slot] = at
        rank[at] = slot[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        slot, at = slot[tied], at[tied]
        # equal ones have all met their border, or none has
        key = rank[at].astype(np.int64) << bits | np.where(left[at] > k, rank[np.minimum(at + k, n - 1)], at)
        for i in range(2, many):
            key = key << bits | np.where(left[at] > i * k, rank[np.minimum(at + i * k, n - 1)], 0)
        k *= many
    return order, rank


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts that each end in a border; suffixes
    that are equal up to their borders stand in the order of the texts.

    Held are the text, the row of each suffix, and of each run, in the order of their
    characters, then of their rows: its character, first row and length, and the suffix
    positions at its first and last row.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        borders = np.flatnonzero(text == BORDER)
        left = np.repeat(borders, np.diff(np.r_[-1, borders])) - np.arange(n) + 1
        sa, self.row = suffix_order(text, left)
        bwt = text[sa - 1]  # the first suffix is preceded by the last border
        edge = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        length = np.diff(np.r_[edge, n])
        by = np.argsort(bwt[edge], kind="stable")
        self.text, self.n = text, n
        self.head, self.start, self.length = bwt[edge][by].astype(np.int64), edge[by], length[by]
        self.key = self.head * n + self.start
        self.first_sample, self.last_sample = sa[edge][by], sa[edge + length - 1][by]

    def shared(self, pattern: np.ndarray, at: np.ndarray, place: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
        """Bytes that pattern[at:] and text[place:] share, up to ``most``; with a ``step`` of -1, those
        from at and place backwards."""
        out, live, k, width = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 0, 8
        while len(live):
            i = k + np.arange(width)
            a = pattern.take(at[live, None] + step * i, mode="clip")
            b = self.text.take(place[live, None] + step * i, mode="wrap")  # what precedes the text is a border
            ok = (a == b) & (i < most[live, None])
            n = np.where(ok.all(1), width, ok.argmin(1))
            out[live] += n
            live, k = live[n == width], k + width
            width = max(8, min(64, COMPARED // max(1, len(live))))
        return out

    def stretches(self, pattern: np.ndarray, stop: np.ndarray, sizes: np.ndarray):
        """Matching statistics of many patterns at once, each read backwards from ``stop``, in stretches
        along which a match goes on: yields (patterns, first and last offset from the end, match length and a place
        of the match at the first), where length and place go one up and one down with the offset."""
        who = np.arange(len(stop))
        k, size, place = np.zeros(len(stop), np.int64), np.zeros(len(stop), np.int64), np.full(len(stop), self.n - 1)
        last = len(self.key) - 1
        while len(who):
            on = self.shared(pattern, stop[who] - k - 1, place - 1, sizes[who] - k, -1)
            yield who, k, k + on, size, place
            go = np.flatnonzero(k + on < sizes[who])
            who, k, size, place = who[go], (k + on)[go], (size + on)[go], (place - on)[go]
            begin = stop[who] - k
            c = pattern[begin - 1].astype(np.int64)
            at = np.searchsorted(self.key, c * self.n + self.row[place], "right") - 1
            up, down = np.maximum(at, 0), np.minimum(at + 1, last)
            has_up, has_down = (self.head[up] == c) & (at >= 0), self.head[down] == c
            by_up = np.where(has_up, self.shared(pattern, begin, self.last_sample[up], np.where(has_up, size, 0)), -1)
            by_down = np.where(has_down, self.shared(pattern, begin, self.first_sample[down], np.where(has_down, size, 0)), -1)
            k, size = k + 1, np.maximum(by_up, by_down) + 1
            place = np.where(by_down > by_up, self.first_sample[down], self.last_sample[up]) - 1
            place[size == 0] = self.n - 1  # the byte is nowhere in the text

    def statistics(self, pattern: np.ndarray, stop: np.ndarray, sizes: np.ndarray):
        """The same, offset by offset: yields (patterns, offset from the end, match length, a place of the match)."""
        who, first, last, size, place = (np.concatenate(x) for x in zip(*self.stretches(pattern, stop, sizes)))
        for k in range(1, int(sizes.max(initial=0)) + 1):
            i = np.flatnonzero((first <= k) & (k <= last))
            yield who[i], k, size[i] + k - first[i], place[i] - (k - first[i])


def pieced(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``size`` windows in pieces: (stretch, first window, windows)."""
    n = -(-size // PIECE)
    which = np.repeat(np.arange(len(size)), n)
    at = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    return which, at, np.minimum(PIECE, size[which] - at)


def united(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (text, start, windows), those of one text that overlap or touch made one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], (start + n)[order]
    far = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(row * far + stop)
    new = np.flatnonzero(np.r_[True, row[1:] * far + start[1:] > reach[:-1]][: len(row)])
    return row[new], start[new], np.maximum.reduceat(stop, new) - start[new] if len(new) else stop


def indexed(bodies: list[bytes], source: np.ndarray, start: np.ndarray, window: int):
    """The index of passages, each of which lies at ``start`` of ``source``, and of each of its texts where it
    begins, its source and its start there.  Passages of one source that overlap are indexed once."""
    size = np.array([len(b) - window + 1 for b in bodies])
    merged: list[tuple[int, int, bytearray]] = []
    for i in np.lexsort((-size, start, source)).tolist():
        s, a = int(source[i]), int(start[i])
        if merged and merged[-1][0] == s and a <= (end := merged[-1][1] + len(merged[-1][2]) - window + 1):
            merged[-1][2].extend(bodies[i][end - a + window - 1 :])
        else:
            merged.append((s, a, bytearray(bodies[i])))
    which, at, n = pieced(np.array([len(b) - window + 1 for _, _, b in merged]))
    text = bytearray()
    for i, a, k in zip(which.tolist(), at.tolist(), n.tolist()):
        text += merged[i][2][a : a + k + window - 1] + b"\xff"
    length = n + window
    src, lo = np.array([m[0] for m in merged])[which], np.array([m[1] for m in merged])[which] + at
    return RunIndex(np.frombuffer(bytes(text), np.uint8)), np.cumsum(length) - length, src, lo


def repeats_of(bodies, source, start, texts: list[bytes], docs: np.ndarray, asked: tuple, window: int):
    """Strings of the ``asked`` stretches (text, start, windows) that have an earlier place ->
    (text, start, len): runs of them."""
    none = (np.zeros(0, np.int64),) * 3
    if not bodies or not len(asked[0]):
        return none
    index, begins, src, src_lo = indexed(bodies, source, start, window)
    row, begin, size = united(*asked)
    which, at, n = pieced(size)
    row, lo = row[which], begin[which] + at
    pattern = np.frombuffer(b"".join(texts[r][a : a + k + window - 1] for r, a, k in zip(row.tolist(), lo.tolist(), n.tolist())), np.uint8)
    sizes = n + window - 1
    found = []
    for who, first, last, size, place in index.stretches(pattern, np.cumsum(sizes), sizes):
        first = first + np.maximum(window - size, 0)  # from here on the match is a window long
        long = np.flatnonzero(first <= last)
        w, own = who[long], (lo + sizes)[who[long]] - last[long]
        # a stretch stays in one text of the index, and its place there moves with it
        there = place[long] - (last - first + np.maximum(window - size, 0))[long]
        text = np.searchsorted(begins, there, "right") - 1
        pos = src_lo[text] + there - begins[text]
        hit = (src[text] < docs[row[w]]) | ((src[text] == docs[row[w]]) & (pos < own))
        found.append((row[w[hit]], own[hit], (last - first + 1)[long][hit]))
    row, begin, n = (np.concatenate(x) for x in zip(*found))
    if not len(row):
        return none
    order = np.lexsort((begin, row))
    row, begin, n = row[order], begin[order], n[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + n[:-1])])
    return row[new], begin[new], np.add.reduceat(n, new) + window - 1


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: its bytes, the bytes and maximal runs removed, and a hash of
    what is kept."""
    unit = unit_of(window)
    own = keyed(docs, id_col, text_col)
    claimed, shards = claims(own, unit)
    texts_of = own.select("doc_id", "th", "text", F.coalesce(shard_of(shards), F.lit(0)).alias("shard"))
    given = passages(own, claimed, unit).unionByName(claimed.select("shard", "doc_id", "th", "lo", "n"), allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t.encode() if t is not None else b"" for t in left.column("text").to_pylist()]
        ids, th = left.column("doc_id").combine_chunks(), left.column("th").to_numpy()
        docs_of = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        is_passage = right.column("body").combine_chunks().is_valid()
        source, claim = right.filter(is_passage), right.filter(pc.invert(is_passage))
        rows_of: dict = {}
        for i, key in enumerate(zip(ids.to_pylist(), th.tolist())):
            rows_of.setdefault(key, []).append(i)  # repeated rows
        asked = [(i, lo, n) for d, t, lo, n in zip(*(claim.column(c).to_pylist() for c in ("doc_id", "th", "lo", "n"))) for i in rows_of.get((d, t), ())]
        asked = tuple(np.array(asked, np.int64).reshape(-1, 3).T)
        row, start, n = repeats_of(source.column("body").to_pylist(), source.column("doc_id").to_numpy(), source.column("lo").to_numpy(), texts, docs_of, asked, window)
        size, gone, runs, digest = [], [], [], []
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        for text, a, z in zip(texts, edges, edges[1:]):
            drop = removed(len(text), start[a:z], n[a:z]) if z > a else np.zeros(0, bool)
            size.append(len(text))
            gone.append(int(drop.sum()))
            runs.append(int((np.diff(np.r_[0, drop.astype(np.int8)]) == 1).sum()))
            digest.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~drop].tobytes() if gone[-1] else text).hexdigest())
        return pa.Table.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts_of.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
