import hashlib

import numpy as np
import pytest

from lodestrata.llm import repeats, runindex


def brute(rows, window=100):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1) if d is not None else ():
            k = b[p : p + window]
            first[k] = min((d, p), first.get(k, (d, p)))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1) if d is not None else ():
            if first[b[p : p + window]] < (d, p):
                gone[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, letters):
    rng = np.random.default_rng(seed)
    say = lambda n: "".join(rng.choice(list(letters), int(n)))
    passages = [say(k) for k in rng.integers(100, 400, 8)]
    rows = []
    for i in range(100):
        t = say(rng.integers(0, 300))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 8)]
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + p[int(rng.integers(0, 60)) : len(p) - int(rng.integers(0, 60))] + t[at:]
        rows.append((int(rng.integers(0, 10**6)), t))
    rows += [(k, rows[k * 3][1]) for k in range(8)]
    return rows + [(7777777, None), (7777779, ""), (None, rows[0][1]), (rows[5][0], rows[9][1]), rows[2], rows[2], (88, "x" * 700), (90, "xy" * 150), (91, "x" * 99)]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("seed,letters", [(3, "abcdé €"), (4, "ab")])
def test_bytes_match_brute_force(spark, seed, letters):
    rows = corpus(seed, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as lo", "'x' as spans")
    got = [tuple(r) for r in runindex.deduplicated(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("letters", ["abcdé €", "ab"])
def test_small_shards_and_slices_give_the_same(spark, monkeypatch, letters):
    rows = corpus(5, letters)
    monkeypatch.setattr(runindex, "SHARD_BYTES", 100)
    monkeypatch.setattr(runindex, "PIECE", 40)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "HOT_FROM", 5)
    monkeypatch.setattr(repeats, "SHARD_TEXT", 3000)
    monkeypatch.setattr(repeats, "SHARDS_AT_ONCE", 2)
    got = [tuple(r) for r in runindex.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_statistics_are_longest_matches(seed):
    rng = np.random.default_rng(seed)
    say = lambda n: rng.choice(list(b"abc"), int(n)).astype(np.uint8).tobytes()
    bodies = [say(n) for n in rng.integers(1, 60, 20)] + [b"a" * 90, b"ab" * 40]
    raw = b"\xff".join(bodies) + b"\xff"
    index = runindex.RunIndex(np.frombuffer(raw, np.uint8))
    patterns = [say(n) for n in rng.integers(1, 80, 15)] + [b"zza" + bodies[0], bodies[1] + bodies[2], b"a" * 120]
    flat = np.frombuffer(b"".join(patterns), np.uint8)
    sizes = np.array([len(p) for p in patterns])
    seen = 0
    for who, k, size, place in index.statistics(flat, np.cumsum(sizes), sizes):
        for w, n, at in zip(who.tolist(), size.tolist(), place.tolist()):
            rest = patterns[w][len(patterns[w]) - k :]
            best = max(m for m in range(len(rest) + 1) if rest[:m] in raw)
            assert n == best and (n == 0 or raw[at : at + n] == rest[:n])
            seen += 1
    assert seen == sizes.sum()
    assert [raw[i - 1] for i in index.first_sample] == index.head.tolist() == [raw[i - 1] for i in index.last_sample]
    assert len(index.key) < len(raw)  # runs, not positions


def test_a_claim_that_the_bytes_deny_removes_nothing():
    a, b = b"x" * 60 + b"a" * 60, b"x" * 60 + b"b" * 60
    asked = (np.array([0]), np.array([0]), np.array([21]))
    out = runindex.repeats_of([a], np.array([1]), np.array([0]), [b], np.array([2]), asked, 100)
    assert not len(out[0])
    out = runindex.repeats_of([a], np.array([1]), np.array([0]), [a], np.array([2]), asked, 100)
    assert [x.tolist() for x in out] == [[0], [0], [120]]


def test_long_text(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 1 << 20, np.uint8)).decode()
    rows = [(1, long), (2, "y" + long[1000:900000] + "z"), (3, long[5:200])]
    got = {r.doc_id: r for r in runindex.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 899000, 1, 195)


def test_empty_table(spark):
    assert runindex.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_that_touch_are_streamed_once():
    row, start, n = (np.array(x) for x in zip((1, 0, 40), (0, 5, 10), (1, 10, 30), (0, 15, 5), (0, 21, 2), (0, 6, 3), (2, 0, 1)))
    assert [x.tolist() for x in runindex.united(row, start, n)] == [[0, 0, 1, 2], [5, 21, 0, 0], [15, 2, 40, 1]]
    assert all(len(x) == 0 for x in runindex.united(*(np.zeros(0, np.int64),) * 3))


@pytest.mark.parametrize("letters", ["abcdé €", "ab", "\0a"])
def test_suffixes_in_order(letters):
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list(letters), int(n))).encode()
    bodies = [say(n) for n in rng.integers(1, 90, 12)]
    raw = b"\xff".join([*bodies, bodies[3], *bodies[:2], letters[:1].encode() * 300]) + b"\xff"
    text = np.frombuffer(raw, np.uint8)
    left = np.array([raw.index(b"\xff", i) - i + 1 for i in range(len(raw))])
    order, row = runindex.suffix_order(text, left)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : i + left[i]], i))
    assert row[order].tolist() == list(range(len(raw)))


def test_a_match_that_goes_on_is_one_stretch():
    """Steps are taken for places where a match breaks off, not for each byte."""
    rng = np.random.default_rng(7)
    body = rng.integers(97, 123, 4000, np.uint8).tobytes()
    raw = body[:2000] + b"\xff" + body[1000:] + b"\xff"
    index = runindex.RunIndex(np.frombuffer(raw, np.uint8))
    patterns = [body[50:1950], body[300:900] + body[1200:3900], b"?" + body[:40]]
    flat, sizes = np.frombuffer(b"".join(patterns), np.uint8), np.array([len(p) for p in patterns])
    rows = [r for part in index.stretches(flat, np.cumsum(sizes), sizes) for r in zip(*(x.tolist() for x in part))]
    assert len(rows) < 60 and all(last - first < sizes[w] for w, first, last, _, _ in rows)
    for w, first, last, size, place in rows:
        rest = patterns[w][len(patterns[w]) - last :]
        assert size == 0 or raw[place - last + first :].startswith(rest[: size + last - first])
    assert sum(last - max(first, 1) + 1 for _, first, last, _, _ in rows) == sizes.sum()
