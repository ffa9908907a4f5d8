"""Bit-sliced weights and Gumbel draws against plain sums."""

import hashlib
import math
import random
import zlib

import numpy as np

from shoebox.llm import resample
from tests.llm import plain

SCHEMA = "doc_id long, text string, weight int, N_words string, score double"


def features(text):
    words = plain.bench_words(text)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(rows, targets):
    own = [features(t) for _, t in rows]
    have, want = np.zeros(10000, int), np.zeros(10000, int)
    for _, found in own:
        np.add.at(have, found, 1)
    for t in targets:
        np.add.at(want, features(t)[1], 1)
    s_all, t_all = int(have.sum()), int(want.sum())
    gain = [math.floor(1000 * math.log(((int(t) + 1) * (s_all + 10000)) / ((int(s) + 1) * (t_all + 10000)))) for s, t in zip(have, want, strict=True)]
    out = []
    for (i, _), (n, found) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < 5 * len(able) // 100 else None)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in out), key=str)


def check(spark, rows, targets):
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA).repartition(3)
    items = spark.createDataFrame([("b", t) for t in targets], "item_id string, text string")
    got = resample.resample(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, targets)


def texts(n):
    rng = random.Random(5)
    words = ["the", "The", "a1", "naïve", "漢字", "x" * 70, "y" * 49, "z" * 48, *(f"w{k}" for k in range(40))]
    return [rng.choice([" ", ", ", "\n--"]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_whole_table(spark):
    some = texts(90)
    rows = [(i, t) for i, t in enumerate(some)] + [(100, None), (101, ""), (102, " .,- "), (103, "word"), (None, some[0]), (None, some[0]), (3, some[3]), (3, "b " * 30)]
    rows += [(200, "w1 w2 " * 60_000), (201, "q" * 100_000)]
    check(spark, rows, ["w1 w2 w3 naïve", "The the a1", None, ""])


def test_empty_tables(spark):
    check(spark, [], ["w1"])
    check(spark, [(1, "a b"), (2, None)], [])


def test_slices_of_long_texts(monkeypatch):
    rows = [t.encode() for t in texts(40)]
    whole = [c.copy() for _, _, _, counts in resample._counted(rows, 997) for c in counts]
    monkeypatch.setattr(resample, "PIECE", 20)
    cut = [c.copy() for _, _, _, counts in resample._counted(rows, 997) for c in counts]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    counts, gain = rng.integers(0, 5000, (7, 1000)), rng.integers(-(10**7), 10**7, 1000)
    got = resample.weights(counts, resample.planes(np.maximum(gain, 0)[None]), resample.planes(np.maximum(-gain, 0)[None]))
    assert (got == counts @ gain).all()
    assert not resample.weights(np.zeros((2, 5), int), [], []).any()
