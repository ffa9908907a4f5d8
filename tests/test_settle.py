import datetime as dt
import itertools
import os
import random

from pyspark.sql import functions as F

from shoebox.plans import ingest
from shoebox.schemas import CHANGE_EVENTS
from shoebox.sources.catalog import Catalog
from shoebox.streaming import changes as stream
from shoebox.streaming import settle

from test_ingest import media_of, put

START = dt.datetime(2024, 6, 1)


def write(spark, feed, rows):
    """One event file; rows are ``(second, path, kind)``."""
    n = len(os.listdir(feed)) if os.path.isdir(feed) else 0
    full = [(1000 * n + k, START + dt.timedelta(seconds=s), p, kind, kind != "remove", False) for k, (s, p, kind) in enumerate(rows)]
    spark.createDataFrame(full, CHANGE_EVENTS).coalesce(1).write.parquet(f"{feed}/{n:03}")


def settle_feed(spark, feed, where, **options):
    out = settle.settled(stream.read_events(spark, f"{feed}/*", per_batch=1), "5 seconds", **options)
    writer = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{where}/out").collect()
    return sorted((r.path, r.kind, r.n_events, (r.first_ts - START).seconds, (r.last_ts - START).seconds, r.stale) for r in rows)


def test_burst_over_files_and_restarts(spark, tmp_path):
    feed = str(tmp_path / "feed")
    write(spark, feed, [(1, "/a.png", "create"), (100, "/b.png", "modify")])
    assert settle_feed(spark, feed, tmp_path, delay="5 minutes") == []
    # the stream starts anew, from the state it left
    write(spark, feed, [(4, "/a.png", "remove"), (6, "/a.png", "modify")])
    assert settle_feed(spark, feed, tmp_path, delay="5 minutes") == []
    write(spark, feed, [(3000, "", "heartbeat")])
    assert settle_feed(spark, feed, tmp_path, delay="5 minutes") == [("/a.png", "remove", 3, 1, 6, False), ("/b.png", "upsert", 1, 100, 100, False)]


def test_late_events(spark, tmp_path):
    feed = str(tmp_path / "feed")
    write(spark, feed, [(100, "/a.png", "modify"), (100, "/b.png", "modify"), (100, "/c.png", "modify"), (500, "", "heartbeat")])
    assert len(settle_feed(spark, feed, tmp_path, delay="0 seconds")) == 3
    write(spark, feed, [(20, "/a.png", "remove"), (97, "/b.png", "remove"), (200, "/c.png", "remove"), (20, "/d.png", "create")])
    write(spark, feed, [(600, "", "heartbeat")])
    assert settle_feed(spark, feed, tmp_path, delay="0 seconds") == [
        ("/a.png", "remove", 1, 20, 20, True), ("/a.png", "upsert", 1, 100, 100, False),
        ("/b.png", "remove", 2, 97, 100, False), ("/b.png", "upsert", 1, 100, 100, False),
        ("/c.png", "remove", 1, 200, 200, False), ("/c.png", "upsert", 1, 100, 100, False),
        ("/d.png", "upsert", 1, 20, 20, False)]


def bursts_of(events, gap):
    made = []
    for at, number, removed in sorted(events):
        if made and at - made[-1][-1][0] <= gap:
            made[-1].append((at, number, removed))
        else:
            made.append([(at, number, removed)])
    return made


def test_any_order_of_arrival():
    """Whatever the order and the clock, what is applied last is what sorted events give."""
    rng = random.Random(4)
    for trial, order in itertools.product(range(150), ("latest", "remove_wins")):
        events = [(rng.randrange(60), n, rng.random() < 0.4) for n in range(rng.randrange(1, 9))]
        rng.shuffle(events)
        bursts, clock, applied = [], 0, None
        for k, (at, number, removed) in enumerate(events):
            bursts = settle.with_burst(bursts, settle.Burst(at, at, number, removed, removed, 1), 4)
            clock = max(clock, rng.choice([0, at, at + 30, 200]) if trial % 3 else 200)
            for kind, _, _, last, last_id, stale in settle.passed_on(bursts, 500 if k == len(events) - 1 else clock, 4, order):
                applied = applied if stale else kind
        last = bursts_of(events, 4)[-1]
        assert len(bursts) == len(bursts_of(events, 4)) and sum(b.n for b in bursts) == len(events)
        assert applied == ("remove" if (last[-1][2] if order == "latest" else any(e[2] for e in last)) else "upsert"), (events, order)


def test_stream_beside_a_scan(spark, tmp_path, now):
    """Another handle commits between two batches, and during one; the stream goes on."""
    root = str(tmp_path / "lib")
    put(root, "a.png")
    rule = {"rule_no": 1, "path": root}
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    ingest.scan_import(spark, catalog, rule, now)
    feed = str(tmp_path / "events")
    write(spark, feed, [(1, f"{root}/a.png", "remove"), (30, "", "heartbeat")])
    write(spark, feed, [(40, f"{root}/b.png", "create"), (90, "", "heartbeat")])
    write(spark, feed, [(99, f"{root}/c.png", "create"), (200, "", "heartbeat")])
    put(root, "b.png")
    put(root, "c.png")
    seen, meddled = [], []

    def report(counts):
        seen.append(counts)
        if counts["missing"]:
            ingest.rescan_import(spark, Catalog(spark, catalog.root), rule, now)

    def printer(files):
        printed = stream.print_files(files)
        if not meddled and printed.where(F.endswith("path", F.lit("c.png"))).count():
            meddled.append(Catalog(spark, catalog.root).commit({"values": Catalog(spark, catalog.root).read("values")}))
        return printed

    source = stream.read_events(spark, f"{feed}/*", per_batch=1)
    stream.run(
        source, catalog, [rule], now, str(tmp_path / "progress"), trigger={"availableNow": True}, debounce="5 seconds", delay="1 second", report=report, printer=printer,
    ).awaitTermination()
    assert {n: r.is_present for n, r in media_of(Catalog(spark, catalog.root)).items()} == {"a.png": True, "b.png": True, "c.png": True}
    assert meddled and sum(c["missing"] for c in seen) == 1 and not any(c["replayed"] for c in seen)


def test_work_of_a_busy_path_is_in_step_with_its_events(monkeypatch):
    joins, joined = [], settle.Burst.joined
    monkeypatch.setattr(settle.Burst, "joined", lambda self, other: (joins.append(1), joined(self, other))[1])
    rng = random.Random(4)
    times = [rng.randrange(40_000) for _ in range(20_000)]
    new = [settle.Burst(at, at, k, k % 3 == 0, k % 3 == 0, 1) for k, at in enumerate(times)]
    found = settle.with_bursts(settle.with_bursts([], new[:9_000], 4), new[9_000:], 4)
    want = bursts_of([(at, k, k % 3 == 0) for k, at in enumerate(times)], 4)
    assert len(found) == len(want) > 100 and sum(b.n for b in found) == 20_000 and len(joins) < 20_000
    assert all(a.last + 4 < b.first for a, b in zip(found, found[1:], strict=False))
