"""Encoding and decoding with a merge-type vocabulary and seeded merge dropout.

Text is cut into segments (spaces, then everything up to the next space), as no piece
of the vocabulary reaches over such a border.  In a segment the agenda holds all
neighbouring pairs whose union is a piece; the best score, then the leftmost, is popped.
A popped candidate is skipped for good if a hash of seed, document, the segment's place
in it, the segment and the candidate's borders falls below the dropout rate, and merged
otherwise.  So a run can be repeated anywhere, and each occurrence has draws of its own.
Characters outside the vocabulary, and a literal U+2581, become byte pieces, so every text
decodes to itself.

Which candidates are popped depends only on which of those before were skipped.  So a task
remembers, for a segment and the candidates skipped so far, the pops that follow as long as
nothing more is skipped: a path.  All occurrences of a batch look for their first skip
on the path they are on, and turn off there, together; paths that are missing are worked out
together too, one pop of all their agendas at a time.  Nothing limits how many ways a
segment can be cut.  Segments of ``LONG`` characters or more go through a heap of their own
each time.  Both give the same pieces.

Edge cases: a null or empty text has no tokens and decodes to null or empty; an empty
table has no rows; a null id counts as document 0; repeated rows get equal results; a very
long text, or one without a space, is encoded whole; extra columns are carried, but for those
named ids, decoded or lossless, which the results replace.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lodestrata.llm.common import pieces, utf8

DROPOUT = 0.1
SEED = 20240229
LONG = 48  # characters from which a segment goes through the heap
MOST_PATHS = 250_000  # paths a task remembers before it starts anew
MOST_IDS = 8_000_000  # their pieces, likewise
BYTES_AT_ONCE = 1 << 20
_SEGMENT = re.compile(r" *[^ ]+| +")
_ALL = (1 << 64) - 1
_NO = np.int32((1 << 31) - 1)


class Vocabulary:
    """Pieces, byte pieces and all merges of a model file, as arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        plain = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(p[3:-1], 16)])
                self.byte_id[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[p] = i
                self.bytes_of[i] = p.replace("▁", " ").encode()
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[32], self.char_id[0x2581] = self.char_id[0x2581], -1
        score = {i: sp.get_score(i) for i in plain.values()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        merges = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (rank[score[i]], i)
        self.key = np.array(sorted(merges), np.int64)
        self.rank, self.merged = (np.array([merges[k][j] for k in self.key.tolist()], np.int32) for j in (0, 1))

    def merges(self) -> dict[int, tuple[int, int]]:
        """Pair -> rank and merged piece."""
        if not hasattr(self, "_merges"):
            self._merges = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        return self._merges

    def spell(self, symbols, text: str, ends) -> list[int]:
        """Pieces of a segment whose symbols end at ``ends``: unknown characters as bytes."""
        out = []
        for s, end in zip(symbols, ends):
            out += [s] if s >= 0 else [self.byte_id[b] for b in text[end - 1].encode()]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_one(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def checksums(segments: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, segments)), np.uint64, len(segments))


def occurrence_keys(crc: np.ndarray, documents: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Keys of segments (by checksum) at places of documents (64-bit numbers)."""
    own = _mix(documents * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return _mix(own + places * np.uint64(0xD6E8FEB86659FD93)) ^ crc << np.uint64(32)


def candidate(start: int, middle: int, stop: int) -> int:
    """A number for the candidate with these borders (in characters), to be mixed with a key."""
    return _mix_one((start << 42 | middle << 21 | stop) & _ALL)


def bound(dropout: float) -> int:
    """Hashes below it are skipped."""
    return min(int(dropout * 2**64), _ALL)


def encode_long(v: Vocabulary, segment: str, key: int, dropout: float) -> list[int]:
    """One agenda, as a heap."""
    n, merges, below = len(segment), v.merges(), bound(dropout)
    sym, end, prev = v.char_id[[ord(c) for c in segment]].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda, live = [], [True] * n

    def ask(a, b):
        hit = merges.get(sym[a] << 32 | sym[b]) if sym[a] >= 0 and sym[b] >= 0 else None
        if hit is not None:
            agenda.append((hit[0], a, b, end[b], hit[1]))

    for k in range(n - 1):
        ask(k, k + 1)
    heapq.heapify(agenda)
    while agenda:
        _, a, b, stop, m = heapq.heappop(agenda)
        if not (live[a] and b < n and live[b] and end[a] == b and end[b] == stop) or _mix_one(candidate(a, b, stop) ^ key) < below:
            continue
        sym[a], end[a], live[b] = m, stop, False
        size = len(agenda)
        if stop < n:
            prev[stop] = a
            ask(a, stop)
        if prev[a] >= 0:
            ask(prev[a], a)
        for new in [agenda.pop() for _ in range(len(agenda) - size)]:
            heapq.heappush(agenda, new)
    at = [k for k in range(n) if live[k]]
    return v.spell([sym[k] for k in at], segment, [end[k] for k in at])


class Rows:
    """Arrays of one length that grow together."""

    def __init__(self, **kinds):
        self.n, self.of = 0, {name: np.zeros(1024, kind) for name, kind in kinds.items()}

    def add(self, n: int, **values) -> int:
        lo, self.n = self.n, self.n + n
        for name, x in self.of.items():
            if self.n > len(x):
                self.of[name] = x = np.r_[x, np.zeros(max(len(x), self.n - len(x)), x.dtype)]
            x[lo : self.n] = values[name]
        return lo

    def __getitem__(self, name: str) -> np.ndarray:
        return self.of[name]


def ragged(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches (first, n), and the stretch of each."""
    end = np.cumsum(n)
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) + (first - end + n)[own], own


def pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (``_NO`` if there is no merge) and merged piece of neighbours."""
    pair = (left.astype(np.int64) << 32) | right
    at = np.minimum(np.searchsorted(v.key, pair), len(v.key) - 1)
    ok = (v.key[at] == pair) & (left >= 0) & (right >= 0)
    return np.where(ok, v.rank[at], _NO), v.merged[at]


def edges(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, as a mask."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def agendas(v: Vocabulary, segments: list[str], skips: np.ndarray, depth: np.ndarray):
    """Many agendas at once, each of which skips its own ``depth`` candidates (rows of ``skips``, in the
    order of their pops) and no others -> (segment, candidate) of all pops after the last
    skip, in order; and the pieces, with the number of each segment's."""
    chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    # arrays of 32 bits, as each pop moves them all; a character outside the vocabulary is in no pair, so it is where it was
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
    start = (np.arange(len(chars)) - np.repeat(begin, sizes)).astype(np.int32)
    stop, sym = start + np.int32(1), v.char_id[chars]
    rank, made = np.full(len(chars), _NO), np.zeros(len(chars), np.int32)
    inner = np.flatnonzero(own[1:] == own[:-1])
    rank[inner], made[inner] = pairs(v, sym[inner], sym[inner + 1])
    seen, done, path = np.zeros(len(segments), np.int64), [], []
    while len(own):
        new = np.flatnonzero(edges(own))
        least = np.repeat(np.minimum.reduceat(rank, new), np.diff(new, append=len(own)))
        over = least == _NO
        if over.any():
            done.append((own[over], sym[over], start[over]))
            left = np.flatnonzero(~over)
            own, start, stop, sym, rank, made, least = (x.take(left) for x in (own, start, stop, sym, rank, made, least))
            if not len(own):
                break
        pop = np.flatnonzero(rank == least)
        pop = pop[edges(own[pop])]
        who = own[pop]
        cand = start[pop].astype(np.int64) << 42 | start[pop + 1].astype(np.int64) << 21 | stop[pop + 1]
        skip = seen[who] < depth[who]
        if skips.shape[1]:
            skip &= skips[who, np.minimum(seen[who], skips.shape[1] - 1)] == cand
        else:
            skip[:] = False
        if skip.any():
            rank[pop[skip]] = _NO
            seen[who[skip]] += 1
            pop, who, cand = pop[~skip], who[~skip], cand[~skip]
            if not len(pop):
                continue
        after = seen[who] == depth[who]
        path.append((who[after], cand[after]))
        sym[pop], stop[pop] = made[pop], stop[pop + 1]
        rank[pop] = _NO
        last = len(own) - 1
        follows = np.minimum(pop + 2, last)
        right = (pop + 2 <= last) & (own[follows] == who)
        before = np.maximum(pop - 1, 0)
        left = (pop > 0) & (own[before] == who)
        a, b = np.r_[pop[right], before[left]], np.r_[follows[right], pop[left]]
        rank[a], made[a] = pairs(v, sym[a], sym[b])
        keep = np.ones(len(own), bool)
        keep[pop + 1] = False
        keep = np.flatnonzero(keep)
        own, start, stop, sym, rank, made = (x.take(keep) for x in (own, start, stop, sym, rank, made))
    own, sym, start = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int32),) * 3
    order = np.argsort(own, kind="stable")
    own, sym, start = own[order], sym[order], start[order]
    odd = np.flatnonzero(sym < 0)
    if len(odd):  # characters outside the vocabulary become their bytes
        spelt = [[v.byte_id[b] for b in chr(c).encode()] for c in chars[begin[own[odd]] + start[odd]].tolist()]
        n = np.ones(len(own), np.int64)
        n[odd] = [len(x) for x in spelt]
        at = np.cumsum(n) - n
        own, sym = np.repeat(own, n), np.repeat(sym, n)
        for i, x in zip(at[odd].tolist(), spelt):
            sym[i : i + len(x)] = x
    who, cand = (np.concatenate(x) for x in zip(*path)) if path else (np.zeros(0, np.int64),) * 2
    order = np.argsort(who, kind="stable")
    return who[order], cand[order], sym, np.bincount(own, minlength=len(segments))


class Encoder:
    """Encodes texts; remembers the paths that segments have gone."""

    def __init__(self, v: Vocabulary, dropout: float, seed: int):
        self.v, self.dropout, self.seed = v, dropout, seed
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}  # segment -> its place in ``words``
        self.texts: list[str] = []
        self.words = Rows(root=np.int64, crc=np.uint64)
        self.paths = Rows(word=np.int64, parent=np.int64, via=np.int64, depth=np.int64, first=np.int64, pops=np.int64, ids=np.int64, n_ids=np.int64)
        self.pops = Rows(hash=np.uint64, cand=np.int64, turn=np.int64)  # turn: the path after a skip here, -1 if unknown
        self.ids = Rows(id=np.int32)

    def work_out(self, word: np.ndarray, parent: np.ndarray, via: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """New paths, each with one skip (``via``) more than its parent (-1 for none)."""
        skips = np.zeros((len(word), int(depth.max(initial=0))), np.int64)
        up, skipped = parent.copy(), via.copy()
        for k in range(skips.shape[1]):
            live = np.flatnonzero(depth > k)
            skips[live, depth[live] - 1 - k] = skipped[live]
            skipped[live], up[live] = self.paths["via"][up[live]], self.paths["parent"][up[live]]
        who, cand, sym, n_ids = agendas(self.v, [self.texts[w] for w in word.tolist()], skips, depth)
        n = np.bincount(who, minlength=len(word))
        at = cand.view(np.uint64)
        first = self.pops.add(len(cand), hash=_mix(at), cand=cand, turn=-1) + np.cumsum(n) - n
        ids = self.ids.add(len(sym), id=sym) + np.cumsum(n_ids) - n_ids
        lo = self.paths.add(len(word), word=word, parent=parent, via=via, depth=depth, first=first, pops=n, ids=ids, n_ids=n_ids)
        return np.arange(lo, lo + len(word))

    def learn(self, new: list[str]):
        at = self.words.add(len(new), root=-1, crc=checksums(new))
        self.number.update(zip(new, range(at, at + len(new))))
        self.texts += new
        short = np.array([i for i, s in enumerate(new, at) if len(s) < LONG], np.int64)
        if len(short):
            none = np.zeros(len(short), np.int64)
            self.words["root"][short] = self.work_out(short, none - 1, none, none)

    def walk(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """All occurrences from their first path to the one that they end on."""
        below, active = np.uint64(bound(self.dropout)), np.flatnonzero(at >= 0)
        while len(active):
            place, own = ragged(self.paths["first"][at[active]], self.paths["pops"][at[active]])
            hit = np.flatnonzero(_mix(self.pops["hash"][place] ^ keys[active][own]) < below)
            hit = hit[np.r_[True, own[hit[1:]] != own[hit[:-1]]][: len(hit)]]
            active, place = active[own[hit]], place[hit]
            new, which = np.unique(place[self.pops["turn"][place] < 0], return_index=True)
            if len(new):
                parent = at[active][self.pops["turn"][place] < 0][which]
                self.pops["turn"][new] = self.work_out(self.paths["word"][parent], parent, self.pops["cand"][new], self.paths["depth"][parent] + 1)
            at[active] = self.pops["turn"][place]
        return at

    def flat_ids(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        if self.paths.n > MOST_PATHS or self.ids.n > MOST_IDS:
            self.forget()
        parts = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        flat = [s for own in parts for s in own]
        new = set(flat).difference(self.number)
        if new:
            self.learn(list(new))
        sizes = np.array([len(x) for x in parts], np.int64)
        which = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        places, own = ragged(np.zeros(len(sizes), np.int64), sizes)
        keys = occurrence_keys(self.words["crc"][which], np.array(documents, np.int64).view(np.uint64)[own], places.astype(np.uint64), self.seed)
        at = self.words["root"][which]
        for i in np.flatnonzero(at < 0).tolist():
            ids = encode_long(self.v, flat[i], int(keys[i]), self.dropout)
            at[i] = self.paths.add(1, word=which[i], parent=-1, via=0, depth=0, first=0, pops=0, ids=self.ids.add(len(ids), id=ids), n_ids=len(ids))
        at = self.walk(at, keys)
        n = self.paths["n_ids"][at]
        ids = self.ids["id"][ragged(self.paths["ids"][at], n)[0]]
        return ids, np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        ids, at = self.flat_ids(texts, documents)
        return [ids[a:b] for a, b in zip(at, at[1:])]


def decode(v: Vocabulary, ids) -> str:
    """The text back: the pieces' bytes, without the space that encoding put in front."""
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode()[1:]


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` without ``text_col``, plus ids (array<int>), decoded (string) and lossless:
    whether decoding the ids gave the text back.  Columns of ``docs`` with one of these
    three names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_file)))  # plain data: tasks need no import
    others = [c for c in docs.columns if c not in (text_col, "ids", "decoded", "lossless")]
    document = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), F.col(id_col))).cast("long")

    def run(batches):
        v = Vocabulary.__new__(Vocabulary)
        vars(v).update(held.value)
        encoder = Encoder(v, dropout, seed)
        for batch in batches:
            for lo, hi in pieces(utf8(batch.column(0))[1], BYTES_AT_ONCE):
                b = batch.slice(lo, hi - lo)
                given = b.column(0).to_pylist()
                ids, at = encoder.flat_ids([t or "" for t in given], b.column(1).to_pylist())
                flat, cuts = ids.tolist(), at.tolist()
                back = [decode(v, flat[x:y]) if t is not None else None for x, y, t in zip(cuts, cuts[1:], given)]
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(2), listed, pa.array(back, pa.string()), pa.array([x == t for x, t in zip(back, given)])], ["row", "ids", "decoded", "lossless"])

    own = docs.select(F.col(text_col).alias("text"), document.alias("document"), (F.struct(*others) if others else F.lit(0)).alias("row"))
    made = own.mapInArrow(run, StructType([own.schema["row"], *DataType.fromDDL("ids array<int>, decoded string, lossless boolean")]))
    return made.select(*(F.col("row")[c].alias(c) for c in others), "ids", "decoded", "lossless")


def digests(docs: DataFrame, model_file: str, **options) -> DataFrame:
    """A row per document: tokens, and hashes of the ids and of the decoded text."""
    out = encoded(docs.select("doc_id", "text"), model_file, **options)
    text = F.coalesce("decoded", F.lit(""))
    return out.select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(text, 256).alias("decoded_sha256"),
        "lossless",
    )
