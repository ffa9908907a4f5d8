"""Mixing against a plain water filling; contamination against a plain scan."""

import hashlib
import random

from shoebox.llm import mixing, phrases
from tests.llm import plain


def fill(sums):
    """Targets by giving the excess back until none is above its limit."""
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    wanted, stopped = 1.5 * sum(sums.values()), set()
    while True:
        rest = [s for s in names if s not in stopped]
        left = wanted - sum(2 * sums[s] for s in stopped)
        per = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * per > 2 * sums[s] + 1e-9}
        if not over:
            return {s: 2.0 * sums[s] if s in stopped else weight[s] * per for s in names}
        stopped |= over


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["b", "a", "é", "z", None, "hot", "hot", "hot"]), "clash", 7) for i in range(300)]
    rows += [(300, None, "empty", "c", 1), (301, "", "empty", "c", 1), (302, " \t\n", "a", "c", 1), (None, "one two", "a", "c", 1), (5, rows[5][1], rows[5][2], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size int")
    sums = {}
    for _, text, source, _, _ in rows:
        sums[source] = sums.get(source, 0) + len((text or "").split())
    want = fill(sums)
    planned = mixing.copies(docs)
    assert planned.columns == [*docs.columns, "_size", "source_size", "_target", "n_copies"]
    got = planned.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sums[r.source] and abs(r["_target"] - want[r.source]) < 1e-6
        rate = want[r.source] / sums[r.source] if sums[r.source] else 0
        assert int(rate) <= r.n_copies <= min(2, int(rate) + 1)
    assert abs(sum(want.values()) - 1.5 * sum(sums.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "Ünder", "ÜNDER", "x1", "zeta", "ΣΑΣ", "common", "rare"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([14, 10, 3, 9, 25, 1])] + [(6, None), (7, "..."), (70, "the the the the the the the the the the the the")]
    docs = []
    for i in range(40):
        words = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.randrange(30))]
        if i % 3 == 0:
            passage = rng.choice(items)[1] or ""
            # only A-Z may change case
            words[5:5] = (plain.low(passage).replace("the", "THE") if rng.random() < 0.5 else passage).split()
        docs.append((i, ", ".join(words), "c"))
    docs += [(40, None, "c"), (41, "", "c"), (41, "the " * 50, "c"), (None, items[0][1], "c"), (0, docs[0][1], "c")]
    items = [(i, t) for i, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string, print string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(str(tuple(r)) for r in phrases.report(df, bench).drop("print").collect())
    want = []
    for i, text, _ in docs:
        n, hit, found = plain.contamination(text, items)
        want.append(str((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)))
    assert got == sorted(want)
    clean = phrases.without_items(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(plain.contamination(t, items)[1] == 0 for _, t, _ in docs)
    assert phrases.report(df.limit(0), bench).count() == 0
    assert phrases.report(df, bench.limit(0)).where("contaminated").count() == 0
    near = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"), (2, "q10 q9 q8 z q7 q6 q5 q4 q3 q2 q1")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string")
    assert phrases.proximity_matches(near.where("doc_id = 2").unionByName(near), item, 0.5).select("doc_id").distinct().count() == 2
