"""Merkle manifests against a plain tree."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from shoebox.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, Root int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Root of the digests, and for each of them its siblings, left and right, a level each."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, p in enumerate(at):
            low = p // 3 * 3
            paths[k].append(("".join(level[low:p]), "".join(level[p + 1 : low + 3])))
            at[k] = p // 3
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    """Sorted ``(id, leaf, subroot, root, proof, folded root)``."""
    made = []
    for r in rows:
        half = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
        other = None if r[1] is None else r[1].replace("\n", "") if half else r[1]
        made.append((r[3], r[0], leaf(r, r[1]), leaf(r, other)))
    sources = sorted({m[0] for m in made}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((m for m in made if m[0] == s), key=lambda m: (m[1] is not None, m[1] or 0, m[2], m[3])) for s in sources}
    trees = {s: tree([m[2] for m in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for k, s in enumerate(sources):
        for m, path in zip(own[s], trees[s][1], strict=True):
            steps, folded = path + above[k], m[3]
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((m[1], m[2], trees[s][0], root, digest("".join(x + y for x, y in steps)), folded))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = manifest.manifest(docs, tampered={"text": manifest.without_line_feeds("doc_id", "text")})
    fold = manifest.folded(F.col("tampered_leaf"), F.col("segment"))
    got = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("segment")), fold).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    for r in found.collect():
        back = r.leaf
        for step in r.segment:
            back = digest(bytes(step.left).hex() + back + bytes(step.right).hex())
        assert back == r.root
    return got


def row(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 1)


def test_tree_of_many_groups(spark):
    rng = random.Random(3)
    rows = [row(i, "line\n" * rng.randrange(3) + str(i), rng.choice(["big", "big", "big", "Zoo", "é", "\U00010000", "￿", None])) for i in range(150)]
    rows += [row(900 + k, "a\nb", f"lone{k}") for k in range(7)]
    got = check(spark, rows)
    assert 0 < sum(r.root != r[5] for r in got) < len(got)


def test_nulls_repeats_and_empty_texts(spark):
    rows = [row(1, "", "s"), row(1, "", "s"), row(1, None, "s"), row(None, "x\ny", None, None), row(None, "x\ny", None, None), row(5, "word " * 40_000, ""), row(5, "b\n", "")]
    check(spark, rows, 1)


def test_small_trees(spark):
    check(spark, [row(7, "one\n", "s")])
    check(spark, [row(k, "one\n", "s") for k in range(4)])
    check(spark, [row(k, "one\n", f"s{k}") for k in range(4)])
    check(spark, [])
