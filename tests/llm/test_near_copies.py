"""Near copies against every pair's Jaccard similarity; what the pipeline's stage leaves of them."""

import random
import re
from fractions import Fraction

import numpy as np

import corpus_pipeline
from shoebox.llm import near_copies, simhash
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", plain.low(text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def least_ids(rows):
    """Smallest id of every group, from all pairs."""
    sets = [shingles(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group, ids = plain.roots(range(len(rows)), near), {}
    for k, r in enumerate(rows):
        ids.setdefault(group[k], []).append(r[0])
    return sorted(str(min((i for i in own if i is not None), default=None)) for own in ids.values())


def texts():
    rng = random.Random(8)
    out = [None, "", " \n", "one", "One", "one two", "a b c d e", "A  b c\td E", "a b c d f"]
    line = "this very common line stands in every text here below"
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))]
        out.append(" ".join(words))
        for _ in range(6):  # chains too: each copy is changed from some earlier one
            words = list(words)
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
            out.append(" ".join(words) + ("" if k % 2 else f" {line}"))
    base = [f"g{i}" for i in range(200)]
    for k in range(60):  # one large group
        out.append(" ".join([*base, line, f"end{k}", f"tail{k % 7}"]))
    return out


def test_groups_are_those_of_all_pairs(spark):
    rows = [(i if i != 12 else None, t, "en", "s", 1) for i, t in enumerate(texts())]
    rows += [(14, rows[14][1], "en", "s", 1), (14, rows[20][1], "en", "s", 1), (None, rows[30][1], "en", "s", 1)]
    random.Random(1).shuffle(rows)
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == least_ids(rows)


def test_similarity_of_exactly_the_share(spark):
    words = [f"w{i}" for i in range(13)]  # nine shingles
    at, below = [*words[:12], "x"], [*words[:11], "y", "z"]  # 8 of 10, 7 of 11
    rows = [(1, " ".join(words)), (2, " ".join(at)), (3, " ".join(below))]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_simhash_proposes_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(3000)]
    changed = [*words[:1500], "other", *words[1501:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(reversed(words))), (4, " ".join(words).upper())]
    prints = simhash.fingerprints([t.encode() for _, t in rows], 5)
    assert (int(prints[0]) ^ int(prints[1])).bit_count() <= 3 < (int(prints[0]) ^ int(prints[2])).bit_count()
    # nothing meets by shingles here: what is linked, SimHash has proposed
    monkeypatch.setattr(near_copies, "_met", lambda *_: spark.createDataFrame([], "h long, key long, other long, n int, pos int"))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_texts_too_far_along_in_a_common_shingle_do_not_meet(spark):
    # of 100 shingles 15 come before the common one, so two such texts share 85 of 115 at most
    far = [(7, key, 100, 15) for key in range(300)]
    few = [(8, key, 100, 12) for key in range(5)]
    # ten that have it early, and one too small for all of them
    early = [(9, key, 100, key % 3) for key in range(10)] + [(9, 10, 70, 0)]
    rows = spark.createDataFrame(far + few + early, "h long, key long, n int, pos int")
    met = near_copies._met(rows, Fraction(4, 5)).collect()
    assert sorted((r.h, r.key, r.n, r.pos) for r in met) == sorted(early[:10]) and all(r.other is None for r in met)


def met_of(spark, monkeypatch, rows, **options):
    """Ids that stay, and what met by shingles."""
    seen, met = [], near_copies._met

    def watched(postings, least):
        out = met(postings, least)
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(near_copies, "_met", watched)
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted(r.doc_id for r in kept.collect()), seen


def test_shingles_that_a_small_sample_misses_do_not_bring_texts_together(spark, monkeypatch):
    rng = random.Random(3)
    line = [f"line{i}" for i in range(30)]
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(150)]
        rows.append((k, " ".join([*words[:60], *line, *words[60:]])))
    rows.append((40, rows[7][1].replace("line3 ", "other ")))
    kept, met = met_of(spark, monkeypatch, rows, sample=1)
    assert kept == list(range(40))
    assert {(r.key, r.other) for r in met if r.other is None} == set() and len({frozenset((r.key, r.other)) for r in met}) == 1


def test_groups_are_those_of_all_pairs_without_a_sample(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    kept, _ = met_of(spark, monkeypatch, rows, sample=1)
    assert sorted(map(str, kept)) == least_ids(rows)


def test_prefixes_are_the_first_in_one_order_of_whole_sets(spark, monkeypatch):
    rng, least, orders = random.Random(4), Fraction(4, 5), []
    sets = {key: sorted(rng.sample(range(400), rng.choice([0, 1, 7, 60, 90]))) for key in range(40)}
    sets |= {key: sorted([*rng.sample(range(400, 420), 12), *rng.sample(range(1000, 9000), 60), *rng.sample(range(9000, 9012), 10)]) for key in range(40, 80)}
    common = np.arange(0, 400, 4), np.arange(100)
    wanted = {k: n - -(-n * 4 // 5) + 1 if (n := len(s)) else 0 for k, s in sets.items()}
    whole = spark.createDataFrame([(k, len(s), s) for k, s in sets.items()], "key long, n int, hashes array<bigint>")
    rows = spark.createDataFrame([(k, len(s), s[: wanted[k] + 6]) for k, s in sets.items()], whole.schema)
    asked = []

    def sets_of(keys, part=lambda found: found):
        asked.append([r.key for r in keys.collect()])
        return spark.createDataFrame([(k, len(sets[k]), [int(h) for h in part(np.array(sets[k]))]) for k in asked[-1]], whole.schema)

    made = near_copies._Order.__init__
    monkeypatch.setattr(near_copies._Order, "__init__", lambda order, *lists: orders.append(order) or made(order, *lists))
    found = near_copies._prefixes(rows, common, sets_of, least).collect()
    assert 0 < len(asked[0]) <= len(asked[1]) < 80 and len(found) == 80
    assert len(orders[0].hashes) < len(orders[1].hashes) and set(common[0].tolist()) <= set(orders[0].hashes.tolist())
    assert {r.key: r.hashes for r in found} == {k: orders[1].first(np.array(s, np.int64), wanted[k]).tolist() for k, s in sets.items()}


def test_tiny_tables(spark):
    df = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert near_copies.keep_one(df).count() == 1 and near_copies.keep_one(df.limit(0)).count() == 0
