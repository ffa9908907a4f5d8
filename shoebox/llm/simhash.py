"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Fingerprints are computed on Arrow batches with numpy.  Distinct fingerprints are then
dealt to the leaves of a vantage-point tree: each goes to its own leaf and, by the
triangle inequality, to every later leaf that its ball can reach.  Leaves are compared
exactly, again pruned by distance to a vantage point, and yield a spanning forest of
the links, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import components, fresh, small_batches, stored

# fixed values of the XXH64 algorithm
P1, P2, P3, P4, P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)
# bytes of text looked at together; working arrays take several times that
SLICE_BYTES = 1 << 19
SLICE_SHINGLES = 1 << 19


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * np.uint64(P2), 31) * np.uint64(P1)


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of ``buf``, which must have 8 spare bytes at its end."""
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    u = np.uint64
    with np.errstate(over="ignore"):
        h = np.full(len(start), (seed + P5) % 2**64, dtype=np.uint64)
        pos, rest = start.copy(), length.copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            at, left = start[long].copy(), length[long].copy()
            seeds = [(seed + P1 + P2) % 2**64, (seed + P2) % 2**64, seed, (seed - P1) % 2**64]
            v = [np.full(len(long), s, dtype=np.uint64) for s in seeds]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], words[at[live] + 8 * k])
                at[live] += 32
                left[live] -= 32
                live = live[left[live] >= 32]
            out = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                out = (out ^ _round(u(0), v[k])) * u(P1) + u(P4)
            h[long], pos[long], rest[long] = out, at, left
        h += length.astype(np.uint64)
        live = np.flatnonzero(rest >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ _round(u(0), words[pos[live]]), 27) * u(P1) + u(P4)
            pos[live] += 8
            rest[live] -= 8
            live = live[rest[live] >= 8]
        live = np.flatnonzero(rest >= 4)
        if len(live):
            lane = words[pos[live]] & u(0xFFFFFFFF)
            h[live] = _rotl(h[live] ^ (lane * u(P1)), 23) * u(P2) + u(P3)
            pos[live] += 4
            rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (buf[pos[live]].astype(np.uint64) * u(P5)), 11) * u(P1)
            pos[live] += 1
            rest[live] -= 1
        h = (h ^ (h >> u(33))) * u(P2)
        h = (h ^ (h >> u(29))) * u(P3)
        return h ^ (h >> u(32))


def _bit_counts(h: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """How often each of the 64 bits is set, by owner (ascending): eight bits are summed
    at once in the bytes of a word, over runs short enough not to overflow a byte."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    runs = np.unique(np.r_[first, np.arange(0, len(h), 255)])
    starts = np.searchsorted(runs, first)
    ones = np.uint64(0x0101010101010101)
    counts = np.zeros((n_owners, 64), dtype=np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ones, runs)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), starts, axis=0)
        counts[owner[first], bit::8] = sums
    return counts


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text (unsigned)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data[space] = 32
    after_space = np.r_[True, space[:-1]]
    word_at = np.flatnonzero(~space & after_space)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(word_at, ends)
    # single spaces only: a shingle is then one run of bytes
    packed = data[~(space & after_space)]
    del data, space, after_space, upper
    gaps = np.flatnonzero(packed == 32)
    packed = np.r_[packed, np.zeros(8, np.uint8)]
    word_from, word_to = np.r_[0, gaps[:-1] + 1], gaps
    before = np.r_[0, upto[:-1]]
    n_words = upto - before
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    total = int(n_shingles.sum())
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    offset = np.r_[0, np.cumsum(n_shingles)]
    for low in range(0, total, SLICE_SHINGLES):
        index = np.arange(low, min(low + SLICE_SHINGLES, total))
        owner = np.searchsorted(offset, index, side="right") - 1
        first = before[owner] + index - offset[owner]
        last = np.minimum(first + shingle, upto[owner]) - 1
        begin = word_from[first]
        counts += _bit_counts(xxh64(packed, begin, word_to[last] - begin), owner, len(texts))
    bits = (2 * counts > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``fingerprint`` (the 64 bits as a signed long).
    Null counts as empty text; a text without words has fingerprint zero."""
    keep = docs.columns if keep is None else keep
    inner = fresh(keep, "_text")
    rows = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(inner))
    schema = docs.select(*keep).withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            parts = [fingerprints(texts[a:b], shingle) for a, b in _sliced(texts)]
            values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            columns = [*batch.columns[:-1], pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


class Tree:
    """Vantage-point tree over a bounded sample.  Nodes are (vantage, radius, left, right),
    leaves are numbers in depth-first order."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self._build(np.unique(sample), leaves)

    def _build(self, points: np.ndarray, leaves: int):
        if leaves > 1 and len(points) > 1:
            # of a few spread candidates take the one whose distances vary most
            tried = points[np.linspace(0, len(points) - 1, min(16, len(points))).astype(int)]
            dist = np.bitwise_count(tried[:, None] ^ points[None, :]).astype(np.int16)
            best = int(np.argmax(dist.std(axis=1)))
            radius = int(np.median(dist[best]))
            inside = dist[best] <= radius
            if 0 < inside.sum() < len(points):
                half = leaves // 2
                left = self._build(points[inside], half)
                return (tried[best], radius, left, self._build(points[~inside], leaves - half))
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: indexes of the points that live there, and of those that live in
        an earlier leaf but have a point within ``reach`` of them there at most."""
        home = np.zeros(len(points), dtype=np.int64)

        def settle(node, index):
            if isinstance(node, int):
                home[index] = node
                return
            inside = np.bitwise_count(points[index] ^ node[0]).astype(np.int16) <= node[1]
            settle(node[2], index[inside])
            settle(node[3], index[~inside])

        def visit(node, index):
            if not len(index):
                return
            if isinstance(node, int):
                yield node, index[home[index] == node], index[home[index] < node]
                return
            dist = np.bitwise_count(points[index] ^ node[0]).astype(np.int16)
            yield from visit(node[2], index[dist - reach <= node[1]])
            yield from visit(node[3], index[dist + reach > node[1]])

        everything = np.arange(len(points))
        settle(self.root, everything)
        yield from visit(self.root, everything)


class _Forest:
    """Union-find over the points of one shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            parent = self.root.tolist()
            for x, y in zip(a[:4096].tolist(), b[:4096].tolist(), strict=True):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
            root = np.array(parent)
            while (root[root] != root).any():
                root = root[root]
            self.root = root


def _near(homes: np.ndarray, rings: np.ndarray, vantage, points: np.ndarray, reach: int):
    """Index pairs (home, point) within ``reach``.  ``homes`` are sorted by ``rings``, their
    distance to ``vantage``; a point meets only the rings within reach of its own."""
    own = np.bitwise_count(points ^ vantage).astype(np.int16)
    for ring in np.unique(own):
        low, high = np.searchsorted(rings, ring - reach), np.searchsorted(rings, ring + reach, side="right")
        which = np.flatnonzero(own == ring)
        for a in range(low, high, 1024):
            some = homes[a : min(a + 1024, high)]
            for b in range(0, len(which), 1024):
                part = which[b : b + 1024]
                i, j = np.nonzero(np.bitwise_count(some[:, None] ^ points[part][None, :]) <= reach)
                if len(i):
                    yield i + a, part[j]


def links(prints: DataFrame, reach: int = 2, leaf_size: int = 2_000, sample: int = 1 << 20) -> DataFrame:
    """A spanning forest ``(a, b)`` of all pairs within ``reach`` bits among the distinct
    values of the only column of ``prints``.

    The tree is laid out on about ``sample`` fingerprints at most (the lowest by hash); every
    fingerprint is dealt to leaves and compared.  A leaf with more than twice
    ``leaf_size`` points of its own is cut into shards, each meeting the later ones, so a
    task holds one shard at a time and streams the rest.  Each level of the tree sends
    some two fifths of the visitors both ways, so what is dealt grows a little faster
    than the number of distinct fingerprints (about its power 1.4).
    """
    spark, fp = prints.sparkSession, prints.columns[0]
    prints = prints.select(F.col(fp).alias("fp"))
    total = prints.count()
    wanted = max(1, -(-total // leaf_size))
    share = min(1.0, min(sample, 64 * wanted) / max(total, 1))
    low = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(share * (1 << 30))
    points = prints.where(low).toPandas()["fp"].to_numpy(np.int64)
    tree = Tree(points.view(np.uint64), min(wanted, max(1, sample // 64)))
    tree = spark.sparkContext.broadcast(tree)

    def live_in(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, home, _ in tree.value.route(values, 0):
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int32()), "n": pa.array([len(home)], pa.int64())})

    sizes = prints.mapInArrow(live_in, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    shards, first = {}, 0  # a leaf's first shard and how many it has; at most one row per leaf came here
    for row in sorted(sizes, key=lambda r: r.leaf):
        shards[row.leaf] = (first, max(1, row.n // leaf_size))
        first += shards[row.leaf][1]

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, home, visitors in tree.value.route(values, reach):
                start, n = shards.get(leaf, (0, 0))
                out = []
                place = start + (values[home] * np.uint64(P1) >> np.uint64(33)).astype(np.int64) % max(n, 1)
                for shard in range(start, start + n):
                    out.append((shard, home[place == shard], 0))
                    out.append((shard, np.r_[home[place < shard], visitors], 1))
                for shard, index, role in out:
                    if len(index):
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array(np.full(len(index), shard, np.int32)),
                            "role": pa.array(np.full(len(index), role, np.int8)),
                            "fp": pa.array(values[index].view(np.int64)),
                        })

    dealt = prints.mapInArrow(deal, "shard int, role byte, fp long")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "role")

    def compare(batches):
        shard, homes, rings, forest, waiting = None, None, None, None, []

        def edges(a, b):
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        def settle():
            nonlocal homes, rings, forest
            homes = np.unique(np.concatenate(waiting)) if waiting else np.zeros(0, np.uint64)
            waiting.clear()
            dist = np.bitwise_count(homes ^ (homes[0] if len(homes) else np.uint64(0))).astype(np.int16)
            order = np.argsort(dist, kind="stable")
            vantage = homes[0] if len(homes) else np.uint64(0)
            homes, rings, forest = homes[order], dist[order], _Forest(len(homes))
            for i, j in _near(homes, rings, vantage, homes, reach):
                forest.join(i, j)
            return vantage

        def close():
            if forest is not None:
                moved = np.flatnonzero(forest.root != np.arange(len(homes)))
                if len(moved):
                    yield edges(homes[moved], homes[forest.root[moved]])

        vantage = None
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            roles = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for number in np.unique(at):
                if number != shard:
                    if waiting:
                        vantage = settle()
                    yield from close()
                    shard, homes, forest = number, None, None
                mine = at == number
                waiting += [values[mine & (roles == 0)]] if (mine & (roles == 0)).any() else []
                visitors = values[mine & (roles == 1)]
                if not len(visitors):
                    continue
                if homes is None:
                    vantage = settle()
                seen = np.full(len(visitors), -1)
                for i, j in _near(homes, rings, vantage, visitors, reach):
                    new = seen[j] < 0
                    seen[j[new]] = i[new]
                    forest.join(i, seen[j])
                met = np.flatnonzero(seen >= 0)
                if len(met):
                    yield edges(visitors[met], homes[seen[met]])
        if waiting:
            vantage = settle()
        yield from close()

    return ordered.mapInArrow(compare, "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, reach: int = 2, extra: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``extra`` columns, ``fingerprint``, ``component_id``,
    the smallest id whose document is reachable over links of at most ``reach`` differing
    bits, and ``root``, the smallest fingerprint so reachable.

    Null text is empty; texts without words share fingerprint zero and are linked.
    Repeated rows and repeated ids each give a row.  A null id is never smallest unless
    its whole component has none.  Exact copies meet in one aggregate; only distinct
    fingerprints are compared.
    """
    rows = stored(with_fingerprint(docs, text, [doc_id, *(extra or [])], shingle), "simhash-rows")
    least = stored(rows.groupBy("fingerprint").agg(F.min(doc_id).alias("_least")), "simhash-distinct")
    forest = stored(links(least.select("fingerprint"), reach), "simhash-links")
    roots = components(forest, "simhash-components").withColumnRenamed("node", "fingerprint")
    named = least.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    best = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    names = named.join(best, "root").select("fingerprint", "component_id", "root")
    return rows.join(names, "fingerprint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, reach: int = 2) -> DataFrame:
    """``docs`` with one row of every group left: that of the smallest id, and of rows with
    that id the one whose text hashes lowest.  A null id stays only if its group has no
    other; of wholly repeated rows one stays."""
    print_, id_ = fresh(docs.columns, "_print"), fresh(docs.columns, "_id")
    keyed = docs.withColumn(id_, F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))).withColumn(print_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = groups(keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(id_).alias("id"), F.col(print_).alias("print")),
                   shingle=shingle, reach=reach, extra=["id", "print"])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print", "id")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col("first.id").alias(id_), F.col("first.print").alias(print_)).distinct()
    return keyed.join(stay, [id_, print_]).dropDuplicates([id_, print_]).select(*docs.columns)


def fingerprint_hex(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
