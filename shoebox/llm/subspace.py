"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c lie at squared distance 2 - 2c.  Rotated and cut into blocks,
two such vectors differ in at least one block by no more than that block's share of the
budget.  So every block is range-joined on its own: vectors go to grid cells over two
of the block's coordinates, and to those later cells their ball reaches; cells are
compared in tasks, and every pair is verified by its cosine in double precision in the
first block that finds it.  A cell gives a sum of links per vector and a spanning
forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import components, stored

BLOCKS = 8
# a cell with more vectors of its own is cut into tiles that meet one after another
TILE = 4_000
# cut cells up to this number are broadcast; more are joined
BROADCAST_CELLS = 100_000
SLACK = 1e-9


def rotated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and the same rotated.

    The rotation is a Walsh-Hadamard transform after fixed sign changes: additions only,
    so a vector gets the same bits in whatever batch it comes.  Dimensions are filled up
    with zeros to a power of two."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    size = max(BLOCKS, 1 << (x.shape[1] - 1).bit_length())
    signs = np.where(np.random.RandomState(7).rand(size) < 0.5, -1.0, 1.0)
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = unit
    y *= signs
    step = 1
    while step < size:
        pairs = y.reshape(len(y), -1, 2, step)
        y = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(y), size)
        step *= 2
    return unit, y / np.sqrt(size)


def _budget(threshold: float) -> float:
    """Squared distance a block may have: all blocks have the same number of dimensions."""
    return (2 - 2 * threshold) / BLOCKS + SLACK


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct comparable vectors: ``(cls, label, vec, least, n)``."""
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    real = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(sound)
    return real.groupBy("cls").agg(
        F.min("label").alias("label"), F.min("vec").alias("vec"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")
    )


def _class_key() -> Column:
    """128 bits of label and vector."""
    return F.concat(F.hex(F.xxhash64("label", "vec")), F.lit(":"), F.hex(F.xxhash64("vec", F.lit(1), "label")))


def _vectors(batch: pa.RecordBatch, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by dimension."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(size)]))
    return out


def _cells(block: np.ndarray, radius: float) -> np.ndarray:
    return np.floor(block[:, :2] / (2 * radius)).astype(np.int32)


_PLACE = "lab long, dim int, block int, c0 int, c1 int"


def _deal(classes: DataFrame, threshold: float, homes_only: bool) -> DataFrame:
    """Every vector in its cell of every block (role 0), and unless ``homes_only`` in the
    later cells within the block's radius (role 1)."""
    radius = float(np.sqrt(_budget(threshold)))

    def deal(batches):
        for batch in batches:
            labs = batch.column("lab").to_numpy(zero_copy_only=False)
            for rows, vectors in _vectors(batch, "vec"):
                _, turned = rotated(vectors)
                width = turned.shape[1] // BLOCKS
                for b in range(BLOCKS):
                    part = turned[:, b * width : (b + 1) * width]
                    part = part if width > 1 else np.c_[part, np.zeros(len(part))]
                    home, low, high = _cells(part, radius), _cells(part - radius, radius), _cells(part + radius, radius)
                    # a cell is twice the radius wide: a ball reaches one neighbour a side at most
                    for d0 in (-1, 0, 1):
                        for d1 in (-1, 0, 1):
                            if (homes_only and (d0 or d1)) or (d0, d1) < (0, 0):
                                continue
                            here = np.flatnonzero(
                                (home[:, 0] + d0 >= low[:, 0]) & (home[:, 0] + d0 <= high[:, 0]) & (home[:, 1] + d1 >= low[:, 1]) & (home[:, 1] + d1 <= high[:, 1])
                            )
                            if not len(here):
                                continue
                            index = pa.array(rows[here])
                            place = {
                                "lab": pa.array(labs[rows[here]]), "dim": pa.array(np.full(len(here), vectors.shape[1], np.int32)),
                                "block": pa.array(np.full(len(here), b, np.int32)), "c0": pa.array(home[here, 0] + np.int32(d0)), "c1": pa.array(home[here, 1] + np.int32(d1)),
                            }
                            if homes_only:
                                yield pa.RecordBatch.from_pydict(place)
                            else:
                                yield pa.RecordBatch.from_pydict(place | {
                                    "role": pa.array(np.full(len(here), int(bool(d0 or d1)), np.int8)),
                                    "cls": batch.column("cls").take(index), "n": batch.column("n").take(index), "vec": batch.column("vec").take(index),
                                })

    if homes_only:
        return classes.select("lab", "vec").mapInArrow(deal, _PLACE)
    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("lab", "cls", "n", "vec").mapInArrow(deal, f"{_PLACE}, role byte, cls string, n long, vec {kind}")


class _Shard:
    """Vectors that live in one tile of one cell; later ones are compared as they come."""

    def __init__(self, block: int, threshold: float, names: list, weights: np.ndarray, vectors: np.ndarray):
        order = np.argsort(np.array(names))  # any order, as long as it does not depend on arrival
        self.block, self.threshold, self.budget = block, threshold, _budget(threshold)
        self.names, self.weights = np.array(names)[order], weights[order]
        self.unit, self.turned = rotated(vectors[order])
        self.sums, self.root = np.zeros(len(names), np.int64), np.arange(len(names))
        for a in range(0, len(names), 1024):
            for i, j in self._pairs(self.unit[a : a + 1024], self.turned[a : a + 1024], later=a):
                j = j + a
                np.add.at(self.sums, i, self.weights[j])
                np.add.at(self.sums, j, self.weights[i])
                self._join(i, j)

    def _pairs(self, unit: np.ndarray, turned: np.ndarray, later: int | None = None):
        """Linked (home, other) whose first block within budget is this one."""
        width = self.turned.shape[1] // BLOCKS
        span = slice(self.block * width, (self.block + 1) * width)
        other, other_sq = turned[:, span], (turned[:, span] ** 2).sum(axis=1)
        for a in range(0, len(self.names) if later is None else min(len(self.names), later + len(unit)), 1024):
            mine = self.turned[a : a + 1024, span]
            rough = (mine**2).sum(axis=1)[:, None] + other_sq[None, :] - 2 * mine @ other.T
            i, j = np.nonzero(rough <= self.budget + SLACK)
            i = i + a
            if later is not None:
                i, j = i[i < j + later], j[i < j + later]
            for s in range(0, len(i), 1 << 15):
                x, y = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                gaps = ((self.turned[x] - turned[y]) ** 2).reshape(len(x), BLOCKS, width).sum(axis=2) <= self.budget
                first = gaps[:, self.block] & ~gaps[:, : self.block].any(axis=1)
                x, y = x[first], y[first]
                near = np.einsum("ij,ij->i", self.unit[x], unit[y]) >= self.threshold
                if near.any():
                    yield x[near], y[near]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
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
                parent[max(x, y)] = min(x, y)
            root = np.array(parent)
            while (root[root] != root).any():
                root = root[root]
            self.root = root

    def meet(self, names: list, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Other vectors linked here: (name, sum of weights it links to, one home)."""
        unit, turned = rotated(vectors)
        sums, seen = np.zeros(len(names), np.int64), np.full(len(names), -1)
        for i, j in self._pairs(unit, turned):
            np.add.at(self.sums, i, weights[j])
            np.add.at(sums, j, self.weights[i])
            new = seen[j] < 0
            seen[j[new]] = i[new]
            self._join(i, seen[j])
        met = np.flatnonzero(seen >= 0)
        return np.array(names, object)[met], sums[met], self.names[seen[met]]

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.sums > 0)
        return self.names[linked], self.sums[linked], self.names[self.root[linked]]


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """``(cls, n, other)``: parts of the number of vectors linked to a class, each with a
    class of its component."""
    spark = classes.sparkSession
    cell = ["lab", "dim", "block", "c0", "c1"]
    sizes = _deal(classes, threshold, True).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TILE)
    cut = stored(sizes.select(*cell, F.ceil(F.col("_n") / TILE).cast("int").alias("tiles")), "cut-cells")
    side = F.broadcast(cut) if cut.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cut
    dealt = _deal(classes, threshold, False).join(side, cell, "left")
    own = F.pmod(F.xxhash64("cls"), F.coalesce("tiles", F.lit(1))).cast("int")
    # those that live in a tile also meet the later tiles of their cell; others meet all
    dealt = dealt.withColumn("own", own).withColumn(
        "tile", F.explode(F.sequence(F.when(F.col("role") == 0, F.col("own")).otherwise(0), F.coalesce("tiles", F.lit(1)) - 1))
    ).withColumn("role", F.when((F.col("role") == 0) & (F.col("tile") == F.col("own")), 0).otherwise(1))
    place = [*cell, "tile"]
    ordered = dealt.select(*place, "role", "cls", "n", "vec").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place)

    def compare(batches):
        key, shard, waiting = None, None, []

        def out(names, sums, others):
            return pa.RecordBatch.from_pydict({
                "cls": pa.array(list(names), pa.string()), "n": pa.array(sums), "other": pa.array(list(others), pa.string()),
            })

        def ready():
            nonlocal shard
            if shard is None and waiting:
                names = [x for part in waiting for x in part[0]]
                shard = _Shard(key[2], threshold, names, np.concatenate([p[1] for p in waiting]), np.concatenate([p[2] for p in waiting]))
                waiting.clear()
            return shard

        def close():
            if key is not None and ready() is not None:
                done = shard.rest()
                if len(done[0]):
                    yield out(*done)

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip(np.r_[0, changes], np.r_[changes, batch.num_rows], strict=True):
                a, b = int(a), int(b)
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns[:6])
                if now != key:
                    yield from close()
                    key, shard, waiting = now, None, []
                part = batch.slice(a, b - a)
                names, weights = part.column("cls").to_pylist(), part.column("n").to_numpy(zero_copy_only=False)
                vectors = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b - a, key[1])
                if columns[6][a] == 0:
                    waiting.append((names, weights, vectors))
                elif ready() is not None:
                    for s in range(0, b - a, 2048):
                        met = shard.meet(names[s : s + 2048], weights[s : s + 2048], vectors[s : s + 2048])
                        if len(met[0]):
                            yield out(*met)
        yield from close()

    return ordered.sortWithinPartitions(*place, "role").mapInArrow(compare, "cls string, n long, other string")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null and they have the same
    number of components, by cosine in double precision.  Vectors that are null, empty,
    zero, or hold a null or non-finite component link with nothing.  Exact copies within a
    label are one class: they meet in one aggregate, and all their links are counted.
    Repeated ids count as vectors of their own and share ``kept``; a null id is smallest
    only where a component has no other.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    rows = rows.withColumn("cls", _class_key())
    classes = stored(_classes(rows).withColumn("lab", F.xxhash64("label")), "vector-classes")
    parts = stored(_links(classes, threshold), "vector-links")
    sums = parts.groupBy("cls").agg(F.sum("n").alias("linked"))
    roots = components(parts.select("cls", "other"), "vector-components").withColumnRenamed("node", "cls")
    named = classes.select("cls", "least", "n").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(best, "root").join(sums, "cls", "left").select(
        "cls", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"
    )
    found = rows.select("vec_id", "cls").join(facts, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
