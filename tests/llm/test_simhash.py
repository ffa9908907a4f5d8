"""SimHash: fingerprints, exact links through the tree, groups and what stays."""

import random

import numpy as np
import pytest

from shoebox.llm import simhash
from tests.llm import plain

SCHEMA = "doc_id long, text string, fingerprint string, _print string, root string"


def texts():
    rng = random.Random(3)
    words = ["Alpha", "beta", "é", "漢字", "x" * 40, "gamma,", "delta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(4000))
    return ["", "  \n", None, "one", "one two", "One  two\tTHREE", "one two three", "one two three four", long, long, long.replace("beta7", "beta8", 1), "q" * 300]


def test_fingerprints_match_plain():
    some = [(t or "") for t in texts()]
    got = simhash.fingerprints([t.encode() for t in some])
    assert [int(x) for x in got] == [plain.fingerprint(t) for t in some]


def test_links_are_exact_over_many_leaves(spark):
    rng = np.random.RandomState(1)
    base = rng.randint(0, 2**63, 300, dtype=np.int64)
    near = np.concatenate([base ^ (np.int64(1) << rng.randint(0, 63, 300)) for _ in range(4)])
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    values = sorted({int(v) for v in np.concatenate([base, near])} | set(dense) | {0, -1, 3})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(5)
    got = plain.roots(values, [(r.a, r.b) for r in simhash.links(df, 2, leaf_size=40).collect()])
    u = np.array(values).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2, 1))
    assert got == plain.roots(values, [(values[a], values[b]) for a, b in zip(i, j, strict=True)])
    # a forest: never more edges than points
    assert simhash.links(df, 2, leaf_size=40).count() < 2 * len(values)


def test_groups_and_what_stays(spark):
    rows = [(i if i != 3 else None, t, "f", "p", "r") for i, t in enumerate(texts())] + [(4, "one two", "f", "p", "r"), (4, "one two", "f", "p", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    prints = [plain.fingerprint(r[1]) for r in rows]
    group = plain.roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for k, r in enumerate(rows):
        ids = least.setdefault(group[k], [])
        ids.append(r[0])
    want = sorted(str((r[0], f"{prints[k]:016x}", min((x for x in least[group[k]] if x is not None), default=None))) for k, r in enumerate(rows))
    got = simhash.groups(df.select("doc_id", "text"))
    assert sorted(str((r.doc_id, r.f, r.component_id)) for r in got.select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((x for x in ids if x is not None), default=None)) for ids in least.values())


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(5, "a b c d")][:n], "doc_id long, text string")
    assert [r.component_id for r in simhash.groups(df).collect()] == [5][:n]
    assert simhash.keep_one(df).count() == n
