"""Repeated strings against all strings of all texts; common prefixes against plain comparison."""

import random

import numpy as np
import pytest

from shoebox.llm import repeats

SCHEMA = "doc_id long, text string, kept string, Spans int, chunk long"


def plain(rows, length=50):
    """Sorted ``(id, bytes, spans, kept)``."""
    least = {}
    for i, text in rows:
        body, order = (text or "").encode(), float("inf") if i is None else i
        for p in range(len(body) - length + 1):
            s = body[p : p + length]
            least[s] = min(least.get(s, order), order)
    out = []
    for i, text in rows:
        body, order = (text or "").encode(), float("inf") if i is None else i
        cut = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if least[body[p : p + length]] < order:
                cut[p : p + length] = b"\x01" * length
        edges = [p for p in range(len(body) + 1) if (cut[p] if p < len(body) else 0) != (cut[p - 1] if p else 0)]
        out.append((i, len(body), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, c in zip(body, cut, strict=True) if not c)))
    return sorted(out, key=str)


def check(spark, rows, length=50, parts=3):
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(parts)
    got = repeats.cut_repeats(docs, length=length)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    found = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()), key=str)
    assert found == plain(rows, length)
    return found


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(9)
    texts = [prose(rng.randrange(0, 90)) for _ in range(40)]
    texts += [prose(3) + passage + prose(rng.randrange(5)) for _ in range(12)]
    texts += [f"{prose(rng.randrange(9))}\n{line}\n{prose(rng.randrange(9))}" for _ in range(30)]
    texts += [passage[k : k + 49 + k % 3] for k in range(0, 60, 5)]
    texts += [texts[0]] * 5 + [texts[41] + texts[42]] + ["a" * 400, "a" * 49, "a" * 50, "ab" * 130, "b" + "ab" * 60]
    return texts


def test_whole_table(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [(500, None), (501, ""), (None, texts[0]), (None, texts[50]), (None, texts[50]), (ids[0], texts[0]), (ids[3], texts[60])]
    found = check(spark, rows)
    assert sum(bool(r[2]) for r in found) > 40


def test_shorter_strings_in_one_task(spark):
    check(spark, list(enumerate(corpus(9))), length=20, parts=1)


def test_core_with_small_steps(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 128)
    monkeypatch.setattr(repeats, "BLOCK", 300)
    repeats._powers.cache_clear()
    for many in (1 << 17, 3):
        monkeypatch.setattr(repeats, "MANY", many)
        texts = corpus(6)
        rows = list(enumerate(texts))
        chunks = []
        for low in range(0, len(rows), 7):
            part = rows[low : low + 7]
            body = [t.encode() for _, t in part]
            blob = repeats.zstandard.compress(b"".join(body))
            chunks.append(repeats.Chunk([i for i, _ in part], np.cumsum([len(b) for b in body]), blob, 50, 3))
        flags, pieces, replies = ({k: [] for k in range(len(chunks))} for _ in range(3))
        tallies = sorted((b, k, keys, times) for k, c in enumerate(chunks) for b, keys, times in c.tallies())
        for bucket in range(3):
            for k, shared, hot in repeats._flag([t[1:] for t in tallies if t[0] == bucket]):
                flags[k].append({"bucket": bucket, "shared": np.packbits(shared).tobytes(), "hot": np.packbits(hot & shared).tobytes()})
        for k, c in enumerate(chunks):
            c.pieces(flags[k])
            pieces[k] = list(c.sent())
        assert many > 3 or any((c.strings == 1).sum() > 20 for c in chunks)
        for bucket in range(3):
            rows_of = [(k, blob) for k in pieces for b, blob in pieces[k] if b == bucket]
            for r, found in repeats._resolve(rows_of, 50).items():
                replies[rows_of[r][0]].append({"bucket": bucket, "found": repeats.pack(*found)})
        got = [(i, n, [(s["start"], s["stop"]) for s in spans], kept) for k, c in enumerate(chunks) for i, n, spans, kept in c.cut(c.covered(replies[k]))]
        assert sorted(got, key=str) == plain(rows)
    repeats._powers.cache_clear()


def test_occurrences_are_laid_out_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(repeats, "ROWS", 64)
    at_once, rows = [], repeats._rows
    monkeypatch.setattr(repeats, "_rows", lambda data, starts, *rest: (at_once.append(len(starts)), rows(data, starts, *rest))[1])
    # very many occurrences of few strings, and some strings once
    data = np.frombuffer(b"the same line here.\n" * 200 + bytes(range(60, 250)), np.uint8)
    starts = np.arange(len(data) - 49)
    first, which = repeats._distinct(data, starts, np.full(len(starts), 50), repeats._grams(data, 50), 84)
    strings = [data[i : i + 50].tobytes() for i in starts]
    assert len(first) == len(set(strings)) and [strings[i] for i in first[which]] == strings
    assert max(at_once) <= 2 * 64 and [len(x) for x in repeats._distinct(data, starts[:0], starts[:0], np.zeros(0, np.uint64), 84)] == [0, 0]


def test_tiny_tables(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])
    check(spark, [(2, "x" * 60), (1, "x" * 60)])
    with pytest.raises(ValueError):
        repeats.cut_repeats(spark.createDataFrame([], "doc_id long, text string"), length=1)


def test_very_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, long), (2, "z" + long[700_000:700_090] + "z"), (3, "q" * 1_200_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.cut_repeats(docs).collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 91)] and bytes(got[2].kept) == b"zz" and not got[1].spans and not got[3].spans


def test_prefixes_by_increasing_value():
    rng = random.Random(2)
    for length in (2, 3, 8, 50):
        for _ in range(20):
            symbols = np.array([0 if rng.random() < 0.05 else rng.randrange(1, 4) for _ in range(rng.randrange(5, 200))] + [0], np.uint16)
            order, prefix = repeats.intervals(symbols, length)
            strings = [tuple(symbols[p : p + length].tolist()) for p in order]
            assert sorted(order.tolist()) == list(range(len(symbols)))
            for j in range(1, len(strings)):
                x, y = strings[j - 1], strings[j]
                if len(y) == length and 0 not in y:
                    assert prefix[j] == next((k for k in range(length) if k >= len(x) or x[k] != y[k]), length)


def test_only_strings_met_twice_are_put_in_order(monkeypatch):
    rng = np.random.default_rng(6)
    seen, plain_order = [], repeats.intervals
    monkeypatch.setattr(repeats, "intervals", lambda symbols, length: seen.append(len(symbols)) or plain_order(symbols, length))
    anchor = rng.integers(97, 123, 16, dtype=np.uint8)

    def row(n, owner, group, shared=None):
        body = [np.r_[rng.integers(97, 123, 17, dtype=np.uint8), anchor, rng.integers(97, 123, 17, dtype=np.uint8)] for _ in range(n)]
        if shared is not None:
            body[0] = shared
        counts = np.full(n, 1, np.uint8)
        return [owner, repeats.pack(np.full(n, group, np.uint32), counts, np.full(n, owner), np.concatenate(body))]

    # pieces of one anchor that have no string in common, and two that are one string
    assert repeats._resolve([row(200, 5, 1), row(200, 6, 1)], 50) == {} and not seen
    wide = rng.integers(97, 123, 60, dtype=np.uint8)

    def strings(owner, low, n):
        return [owner, repeats.pack(np.array([1, 1], np.uint32), np.array([n, 1], np.uint8), np.full(2, owner), np.r_[wide[low : low + n + 49], rng.integers(97, 123, 50, dtype=np.uint8)])]

    found = repeats._resolve([strings(7, 0, 9), strings(8, 2, 9)], 50)
    # strings 2 to 8 are in both: seven strings of 56 bytes and a separator, twice
    assert seen == [2 * 57] and {k: [x.tolist() for x in v] for k, v in found.items()} == {1: [[0], [0], [7], [7]]}
