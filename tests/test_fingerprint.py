import hashlib
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from shoebox.operators import fingerprint
from shoebox.plans import ingest
from shoebox.sources.catalog import Catalog

from test_ingest import media_of, png, put

HUGE = {
    "wide.png": png(2**32 - 1, 5), "high.png": png(5, 2**31), "back.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", -8, 4),
    "low.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -(2**31)),
    "long.tiff": b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 2**32 - 1) + struct.pack("<HHII", 257, 4, 1, 2**32 - 1),
}


def plain_tree(content, piece, children):
    level = [hashlib.sha256(b"\0" + content[k : k + piece]).digest() for k in range(0, max(len(content), 1), piece)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + children])).digest() for k in range(0, len(level), children)]
    return level[0].hex()


def test_headers_that_claim_too_much(spark, tmp_path, now):
    """One corrupt file of each kind does not stop a scan."""
    root = str(tmp_path / "lib")
    for name, content in HUGE.items():
        put(root, name, content)
    put(root, "good.png", png(2**31 - 1, 1))
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    done = ingest.scan_import(spark, catalog, {"path": root}, now).first()
    assert (done.processed, done.rejected, done.rejects) == (6, 0, None)
    assert {n: (r.width, r.height) for n, r in media_of(catalog).items()} == {**dict.fromkeys(HUGE, (None, None)), "good.png": (2**31 - 1, 1)}
    again = fingerprint.fingerprint_content(spark.createDataFrame([(f"/{n}", c) for n, c in HUGE.items()], "path string, content binary"))
    assert all(r.width is None and r.height is None for r in again.collect())


def test_tree_hashes(spark, tmp_path):
    rng = random.Random(1)
    contents = {f"f{n}.png": rng.randbytes(n) for n in (0, 1, 9, 10, 11, 30, 31, 90, 91, 1000)} | {"p.png": png(7, 9)}
    rows = [(put(str(tmp_path), n, c), len(c)) for n, c in contents.items()]
    rows += [(str(tmp_path / "none.png"), 5), (put(str(tmp_path), "short.png", b"abc"), 25)]
    files = spark.createDataFrame(rows, "path string, size bigint")
    found = fingerprint.fingerprint_files(files, fingerprint.TREE, piece=10, children=3)
    got = {os.path.basename(r.path): r for r in found.collect()}
    assert {n: got[n].content_hash for n in contents} == {n: plain_tree(c, 10, 3) for n, c in contents.items()}
    assert (got["p.png"].width, got["p.png"].height, got["p.png"].format) == (7, 9, "png")
    assert got["none.png"].error and got["short.png"].error == "shorter than listed" and got["short.png"].content_hash is None
    assert fingerprint.tree_hashes(files.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fingerprint.fingerprint_files(files, "md5")


def test_pieces_of_one_file_are_shared_out(spark, tmp_path):
    path = put(str(tmp_path), "big.png", b"x" * (1 << 20))
    leaves = fingerprint.leaf_hashes(spark.createDataFrame([(path, 1 << 20)], "path string, size bigint"), piece=1 << 14)
    tasks = leaves.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 64 and len(tasks) == 2


def test_equal_bytes_to_a_task(spark):
    """Ten files hold nearly all bytes of a tree; no task gets two of them while others get none."""
    sizes = [100 << 20] * 10 + [1000] * 5000 + [0, None]
    rows = spark.createDataFrame([(f"/lib/{n}.png", s) for n, s in enumerate(sizes)], "path string, size bigint")
    cost = F.coalesce("size", F.lit(0)) + fingerprint.BYTES_OF_A_FILE
    dealt = fingerprint.dealt_by_bytes(rows, "size", ["path"], most=64 << 20)
    loads = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(cost).alias("n")).collect()]
    assert dealt.count() == len(sizes) and sum(loads) == sum((s or 0) + fingerprint.BYTES_OF_A_FILE for s in sizes)
    assert max(loads) <= 2 * (64 << 20) + (100 << 20) and sum(n >= 100 << 20 for n in loads) == 10
    even = fingerprint.dealt_by_bytes(spark.createDataFrame([(f"/{n}", 1 << 20) for n in range(400)], "path string, size bigint"), "size", ["path"])
    loads = [r.n for r in even.groupBy(F.spark_partition_id()).agg(F.sum(cost).alias("n")).collect()]
    assert len(loads) == 8 and max(loads) < 1.1 * sum(loads) / len(loads)


def test_progress_and_rejects(spark, tmp_path, now):
    root = str(tmp_path / "lib")
    for k in range(60):
        put(root, f"d{k % 3}/{k}.png")
    os.symlink(f"{root}/nowhere", f"{root}/broken.png")
    os.makedirs(f"{root}/later")
    seen, during = [], []
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    commit = catalog.commit
    catalog.commit = lambda *a, **k: (during.extend(seen), commit(*a, **k))[1]
    done = ingest.scan_import(spark, catalog, {"path": root}, now, progress=seen.append, every=10).first()
    assert len(during) >= 2 and {s["stage"] for s in during} == {"listed", "fingerprinted"}
    last = {s["stage"]: s["files"] for s in seen}
    assert last["fingerprinted"] == 60 and last["listed"] >= 60 and seen[-1]["bytes"] > 0
    rejects = spark.read.parquet(done.rejects).collect()
    assert done.rejected == 1 and [os.path.basename(r.path) for r in rejects] == ["broken.png"] and rejects[0].error


def test_imports_out_of_reach(spark, tmp_path, now):
    root = str(tmp_path / "lib")
    put(root, "a.png")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    rules = [{"path": ""}, {"path": f"{root}/"}, {"path": f"{root}-gone"}]
    report = {r.root: r for r in ingest.scan_all(spark, catalog, rules, now).collect()}
    assert {k: r.reason for k, r in report.items()} == {"": "no path configured", root: None, f"{root}-gone": "not reachable"}
    assert report[root].processed == 1 and report[""].listed is None
    assert [r.path for r in catalog.read("folders").collect()] == [root] and len(media_of(catalog)) == 1
