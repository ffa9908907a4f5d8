"""Near copies by SimHash and the exact Jaccard similarity of their word shingles.

SimHash fingerprints of the same shingles, linked through the tree of ``simhash``, propose
pairs, and those that are near are links.  Near sets whose fingerprints lie further apart
are found by a prefix filter, among texts that are not linked yet: in any one order of all shingles, two sets whose Jaccard similarity is at least ``share``
meet in the first ``n - ceil(share * n) + 1`` shingles of each, so the
candidates hold every near pair.  Each candidate is confirmed on the whole sets.  The
order is by hash, with the shingles last that are common in a sample or that more than a
few of all texts have among their first; it decides how many candidates there are, never
which pairs are found.
"""

from __future__ import annotations

import operator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm import simhash
from shoebox.llm.common import components, discard, fresh, small_batches, stored
from shoebox.llm.phrases import _filter_of
from shoebox.llm.simhash import SLICE_SHINGLES, _sliced, xxh64

PIVOT_ROUNDS = 4
# texts of a shingle that meet at once
FEW = 8
# bits of a sketch: at least so many, and at least so many for each member of the set
LEAST_SKETCH, SKETCH_SHARE = 512, 2
# a shingle is common from so many texts of the sample, and so many are remembered
LEAST_COMMON, MOST_COMMON = 3, 1 << 16
# so many shingles are remembered that more than FEW of all texts have early (16 bytes each)
MOST_SHARED = 1 << 20
# shingles kept past the prefix, to take the place of shared ones: one for so many in it, and so many more
SPARE_SHARE, SPARE = 4, 8


def shingle_sets(texts: list[bytes], shingle: int) -> list[tuple[int, np.ndarray]]:
    """A key of the words of each text (64 bits) and its distinct shingles' hashes, ascending.
    Words are told apart and folded as for SimHash; fewer words than a shingle are one."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data[space] = 32
    after_space = np.r_[True, space[:-1]]
    word_at = np.flatnonzero(~space & after_space)
    upto = np.searchsorted(word_at, np.cumsum([len(t) + 1 for t in texts]))
    packed = data[~(space & after_space)]
    del data, space, after_space
    gaps = np.flatnonzero(packed == 32)
    word_from = np.r_[0, gaps[:-1] + 1]
    body, packed = packed.tobytes(), np.r_[packed, np.zeros(8, np.uint8)]
    out = []
    for low, high in zip(np.r_[0, upto[:-1]].tolist(), upto.tolist(), strict=True):
        if low == high:
            out.append((0, np.zeros(0, np.int64)))
            continue
        key = int.from_bytes(blake2b(body[word_from[low] : gaps[high - 1]], digest_size=8).digest(), "little", signed=True)
        first = np.arange(low, max(high - shingle, low) + 1)
        last = np.minimum(first + shingle, high) - 1
        parts = [
            xxh64(packed, word_from[first[a : a + SLICE_SHINGLES]], (gaps[last] - word_from[first])[a : a + SLICE_SHINGLES])
            for a in range(0, len(first), SLICE_SHINGLES)
        ]
        out.append((key, np.unique(np.concatenate(parts).view(np.int64))))
    return out


def _sketch(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of as many places as the size calls
    for, a power of two; the halves of a longer sketch, put on top of each other, are the shorter one."""
    bits = max(LEAST_SKETCH, 1 << (SKETCH_SHARE * len(found) - 1).bit_length())
    odd = np.bincount(found >> 12 & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _with_sets(docs: DataFrame, keep: list[str], text: str, shingle: int, part=lambda found: found) -> DataFrame:
    """Columns ``keep`` plus ``key``, ``n`` (how many shingles), ``part`` of their hashes, a
    sketch and the SimHash fingerprint."""
    inner = fresh(keep, "_text")
    rows = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(inner))
    none = F.array().cast("array<bigint>")
    schema = docs.select(*keep).withColumns({"key": F.lit(0).cast("long"), "n": F.lit(0), "hashes": none, "sketch": none, "fingerprint": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _sliced(texts):
                keys, sets = zip(*shingle_sets(texts[a:b], shingle), strict=True)
                parts = [part(s) for s in sets]
                ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                sizes = pa.array([len(s) for s in sets], pa.int32())
                sketches = [_sketch(s) for s in sets]
                ends = np.r_[0, np.cumsum([len(s) for s in sketches])].astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)))
                prints = pa.array(simhash.fingerprints(texts[a:b], shingle).view(np.int64))
                columns = [*batch.slice(a, b - a).columns[:-1], pa.array(keys, pa.int64()), sizes, hashes, sketch, prints]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


class _Order:
    """An order of all shingles: by hash those that are not listed, then the listed ones by
    how many texts are taken to have them, the most if a hash is listed again."""

    def __init__(self, *lists: tuple[np.ndarray, np.ndarray]):
        hashes, texts = (np.concatenate(x) for x in zip(*lists, strict=True))
        by_hash = np.lexsort((-texts, hashes))
        hashes, texts = hashes[by_hash], texts[by_hash]
        once = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        self.hashes, texts = hashes[once], texts[once]
        self.ranks = np.empty(len(self.hashes), np.int64)
        self.ranks[np.lexsort((self.hashes, texts))] = np.arange(len(self.hashes))

    def place(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is or would be in the list, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return at, self.hashes[at] == found

    def first(self, found: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of a set's hashes, which ascend."""
        at, listed = self.place(found)
        last = found[listed][np.argsort(self.ranks[at[listed]])]
        return np.r_[found[~listed], last][:length]


def _prefix(n, least: Fraction):
    """How many shingles of a set of ``n`` have to meet."""
    return (n + n * -least.numerator // least.denominator + 1) * (n > 0)


def _common(docs: DataFrame, text: str, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles found most often in about ``sample`` texts, by hash, and how many of all
    texts that makes."""
    share = min(1.0, sample / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(text)
    counts = _with_sets(some, [], text, shingle).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    most = counts.where(F.col("c") >= LEAST_COMMON).orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    return most["h"].to_numpy(), most["c"].to_numpy() / share


def _shared(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of all texts keep, by hash, and how many do, if more than
    ``FEW``; copies of a text are one.  A sample of fixed size leaves those out that are as
    rare in it as they are many in a large input."""
    kept = rows.select("key", F.explode("hashes").alias("h"))
    texts = F.count(F.lit(1)).alias("c")
    many = stored(kept.groupBy("h").agg(texts).where(F.col("c") > FEW).select("h"), "near-many")
    # what the test lets through beside them is of few rows
    counts = kept.where(_filter_of(many, "h", "h")).distinct().groupBy("h").agg(texts)
    most = counts.where(F.col("c") > FEW).orderBy(F.desc("c"), "h").limit(MOST_SHARED).toArrow()
    discard(many)
    return most["h"].to_numpy(), most["c"].to_numpy()


def _split(rows: DataFrame, order, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """``(key, n, hashes)``, the prefix in ``order`` (broadcast) of each text of which ``rows``
    keep enough that is not listed, and the keys of the other texts."""

    def of(batch):
        key, n = (batch.column(i).to_numpy() for i in range(2))
        sizes, found = pc.list_value_length(batch.column(2)).to_numpy(), batch.column(2).flatten().to_numpy()
        wanted = _prefix(n.astype(np.int64), least)
        free = ~order.value.place(found)[1]
        upto, ends = np.r_[0, np.cumsum(free)], np.cumsum(sizes, dtype=np.int64)
        before = upto[ends - sizes]
        enough = upto[ends] - before >= wanted
        return key, n, sizes, found, wanted, free, upto[:-1] - np.repeat(before, sizes), enough

    def short(batches):
        for batch in batches:
            key, *_, enough = of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(key[~enough])], names=["key"])

    def rest(batches):
        for batch in batches:
            key, n, sizes, found, wanted, free, place, enough = of(batch)
            kept = free & (place < np.repeat(wanted, sizes)) & np.repeat(enough, sizes)
            ends = np.r_[0, np.cumsum(wanted[enough])].astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[kept]))
            yield pa.RecordBatch.from_arrays([pa.array(key[enough]), pa.array(n[enough]), hashes], names=["key", "n", "hashes"])

    slim = rows.select("key", "n", "hashes")
    keys = stored(slim.mapInArrow(short, "key long").distinct(), "near-short")
    return slim.mapInArrow(rest, "key long, n int, hashes array<bigint>"), keys


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], sets_of, least: Fraction) -> DataFrame:
    """``(key, n, hashes)``: the prefixes of all texts in one order, in which the shingles come
    last that are ``common`` or that more than ``FEW`` texts have in what ``rows`` keep of them.
    Where that leaves too little, the prefix is of the whole set and reaches beyond what is
    kept of other texts; so what many of these sets have comes last too."""
    spark = rows.sparkSession
    lists = [common, _shared(rows)]
    _, keys = _split(rows, spark.sparkContext.broadcast(_Order(*lists)), least)
    whole = stored(sets_of(keys), "near-whole")
    order = spark.sparkContext.broadcast(_Order(*lists, _shared(whole)))
    for table in (keys, whole):
        discard(table)
    own, keys = _split(rows, order, least)
    return own.unionByName(sets_of(keys, lambda found: order.value.first(found, _prefix(len(found), least))))


def _enough(inner: Column, n: Column, m: Column, least: Fraction) -> Column:
    """Whether sets of ``n`` and ``m`` with ``inner`` in common are that similar, in whole numbers."""
    return inner * (least.numerator + least.denominator) >= (n + m) * least.numerator


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets_of, least: Fraction) -> DataFrame:
    """Pairs that near enough sets make: first by their sketches, which differ in no more
    bits than the sets in members, then by the whole sets."""
    x = sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = F.col("na") + F.col("nb")
    near = _enough((both - _apart(F.col("sa"), F.col("sb"))).cast("long"), 2 * F.col("na"), 2 * F.col("nb"), least)
    close = stored(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"), "near-close")
    sets = stored(sets_of(close.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "near-sets")
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    inner = F.size(F.array_intersect("ha", "hb")).cast("long")
    found = stored(close.join(x, "a").join(y, "b").where(_enough(inner, F.col("na"), F.col("nb"), least)).select("a", "b"), "near-links")
    discard(sets)
    discard(close)
    return found


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded once if their lengths
    differ.  Those of sets of which one is more than twice the other are not told apart."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda s: (F.size(s) / 2).cast("int")
    folded = lambda s: F.zip_with(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)), xor)
    x = F.when(F.size(a) == 2 * F.size(b), folded(a)).otherwise(a)
    y = F.when(F.size(b) == 2 * F.size(a), folded(b)).otherwise(b)
    bits = F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w).cast("int"))
    return F.when(F.size(x) == F.size(y), bits).otherwise(0)


def _partnered(h: np.ndarray, n: np.ndarray, pos: np.ndarray, least: Fraction) -> np.ndarray:
    """Which postings, ordered by shingle, may be the first that their text has in common with a
    near one: a text of the shingle is large enough for it, and not too large for what follows ``pos``."""
    up, down = least.numerator + least.denominator, least.numerator
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    order = np.lexsort((n, group))
    own, size, rest = group[order], n[order], (n - pos)[order]
    # the smallest other text that is large enough
    other = np.searchsorted(own << 32 | size, own << 32 | -(-size * down // least.denominator))
    other += other == np.arange(len(h))
    last = np.minimum(other, len(h) - 1)
    some = (other < len(h)) & (own[last] == own) & (rest * up >= (size + size[last]) * down)
    out = np.zeros(len(h), bool)
    out[order] = some
    return out


def _met(postings: DataFrame, least: Fraction) -> DataFrame:
    """From ``(h, key, n, pos)``: the pairs of keys that meet in a shingle of few texts
    (``h`` null), and the postings of shingles that more texts share (``other`` null).  Near
    sets have nothing in common before the first shingle where they meet, so there what
    follows it in the one with less is enough; pairs and postings of which that cannot be said are left out."""
    up, down = least.numerator + least.denominator, least.numerator

    def meet(batches):
        def run(h, key, n, pos):
            for _ in range(2):
                # most shingles are in one text only
                twice = np.r_[False, h[1:] == h[:-1]]
                twice[:-1] |= twice[1:]
                h, key, n, pos = h[twice], key[twice], n[twice], pos[twice]
                kept = _partnered(h, n, pos, least) if len(h) else twice[:0]
                h, key, n, pos = h[kept], key[kept], n[kept], pos[kept]
                if not len(h):
                    return
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
            some = size <= FEW
            a, b = [], []
            for step in range(1, min(FEW, len(h))):
                i = np.flatnonzero((h[step:] == h[:-step]) & some[step:])
                j = i + step
                most = np.minimum(n[i] - pos[i], n[j] - pos[j])
                near = most * up >= (n[i] + n[j]) * down
                a.append(key[i[near]])
                b.append(key[j[near]])
            if a and sum(map(len, a)):
                left, right = np.concatenate(a), np.concatenate(b)
                none = np.zeros(len(left), np.int64)
                yield batch_of(none, left, right, none, none, True)
            if not some.all():
                m = ~some
                yield batch_of(h[m], key[m], key[m], n[m], pos[m], False)

        def batch_of(h, key, other, n, pos, pair):
            void = np.full(len(h), True)
            return pa.RecordBatch.from_arrays(
                [pa.array(h, mask=void if pair else None), pa.array(key), pa.array(other, mask=None if pair else void), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))],
                names=["h", "key", "other", "n", "pos"],
            )

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            part = part if held is None else [np.r_[x, y] for x, y in zip(held, part, strict=True)]
            # copies of a text meet as one
            once = np.r_[True, (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])]
            part = [c[once] for c in part]
            cut = int(np.flatnonzero(part[0] != part[0][-1])[-1]) + 1 if (part[0] != part[0][-1]).any() else 0
            if cut:
                yield from run(*(c[:cut] for c in part))
            held = [c[cut:] for c in part]
        if held is not None:
            yield from run(*held)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.select("h", "key", "n", "pos").repartition(parts, "h").sortWithinPartitions("h", "key")
    return ordered.mapInArrow(meet, "h long, key long, other long, n int, pos int")


def told(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of keys that SimHash proposes: texts of one fingerprint meet the one of
    the smallest key, and these meet along the links of fingerprints that differ in at most
    ``reach`` bits."""
    keys = rows.select("key", "fingerprint").distinct()
    least = stored(keys.groupBy("fingerprint").agg(F.min("key").alias("least")), "near-prints")
    same = keys.join(least, "fingerprint").select(F.col("key").alias("a"), F.col("least").alias("b"))
    x, y = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b"))
    near = simhash.links(least.select("fingerprint"), reach).join(x, "a").join(y, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    pairs = same.unionByName(near).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(rows: DataFrame, prefixes: DataFrame, sets_of, share: float = 0.8, reach: int = 3) -> DataFrame:
    """Confirmed pairs ``(a, b)`` of keys that connect all keys that near pairs connect.

    ``rows`` has ``key``, ``n``, ``sketch`` and ``fingerprint``; ``prefixes`` has ``key``, ``n`` and
    ``hashes``, the prefix in one order; ``sets_of(keys)`` gives whole sets.  What SimHash proposes is confirmed first.
    Then all texts of a shingle that few share meet, unless they are connected already.
    Those of other shingles first meet one of them each, in rounds; only members that no
    confirmed pair connects meet each other after that, so a large group of copies
    costs its size and not its square.
    """
    least = Fraction(str(share))
    met = stored(_met(prefixes.select("key", "n", F.posexplode("hashes").alias("pos", "h")), least), "near-met")
    sketches = stored(rows.select("key", "n", "sketch").dropDuplicates(["key"]), "near-sketches")
    found = _confirmed(stored(told(rows, reach), "near-told"), sketches, sets_of, least)
    roots = components(found, "near-components")
    pairs = met.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    pairs = pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    found = found.unionByName(_confirmed(pairs, sketches, sets_of, least))
    members = met.where("other is null").select("h", "key", "n", "pos")
    if members.isEmpty():
        for table in (met, sketches):
            discard(table)
        return found

    def pairs_of(left: DataFrame, right: DataFrame, apart) -> DataFrame:
        rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        near = _enough(rest.cast("long"), F.col("x.n"), F.col("y.n"), least)
        pairs = left.alias("x").join(right.alias("y"), (F.col("x.h") == F.col("y.h")) & apart(F.col("x.label"), F.col("y.label")) & near)
        return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()

    before = None
    for step in range(PIVOT_ROUNDS + 1):
        roots = components(found, "near-components").withColumnRenamed("node", "key")
        labelled = members.join(roots, "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
        left = labelled.groupBy("h").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select("h")
        open_, closed = stored(labelled.join(left, "h", "left_semi"), "near-open"), members
        # a shingle whose texts are all connected stays so
        members = open_.select("h", "key", "n", "pos")
        if step:
            discard(closed)
        # how many pairs are left, and how many rows they stem from
        sizes = open_.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
        size = sizes.agg(F.sum("m").alias("m"), F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("p")).first()
        if not size.m:
            for table in (met, sketches, open_):
                discard(table)
            return found
        # the first round connects most; another one costs as much and pays for larger groups only
        if step == PIVOT_ROUNDS or size.p <= (16 if step else 4) * size.m or (before is not None and size.p >= 0.9 * before):
            break
        before = size.p
        # one member of each shingle, another one in each round; first the one with the least that others lack
        order = F.struct(F.col("pos") if step == 0 else F.lit(0).alias("pos"), F.xxhash64("key", F.lit(step)).alias("by"))
        pivot = open_.groupBy("h").agg(F.min(order).alias("_least"))
        pivots = open_.join(pivot, "h").where(order == F.col("_least")).drop("_least")
        found = found.unionByName(_confirmed(pairs_of(pivots, open_, operator.ne), sketches, sets_of, least))
    found = found.unionByName(_confirmed(pairs_of(open_, open_, operator.lt), sketches, sets_of, least))
    for table in (met, sketches, open_):
        discard(table)
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, share: float = 0.8, sample: int = 1 << 14, reach: int = 3) -> DataFrame:
    """``docs`` with one row left of every group that near pairs connect: that of the
    smallest id, and of rows with that id the one whose text hashes lowest.

    Two texts are near if the Jaccard similarity of their shingle sets is at least
    ``share``, however far apart their SimHash fingerprints lie (``reach`` bits is how far these
    propose pairs); texts without words are one group.  A null id stays only if its group has
    no other; of wholly repeated rows one stays.  Texts and shingles are told apart by
    64-bit hashes.
    """
    least = Fraction(str(share))
    spark = docs.sparkSession
    common = _common(docs.select(text), text, shingle, sample)
    sampled = spark.sparkContext.broadcast(_Order(common))

    def early(found: np.ndarray) -> np.ndarray:
        length = _prefix(len(found), least)
        return sampled.value.first(found, length + length // SPARE_SHARE + SPARE)

    print_, id_ = fresh(docs.columns, "_print"), fresh(docs.columns, "_id")
    keyed = docs.withColumn(id_, F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))).withColumn(print_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    slim = keyed.select(F.col(doc_id).alias("doc_id"), F.col(id_).alias("id"), F.col(print_).alias("print"), F.col(text).alias("text"))
    rows = stored(_with_sets(slim, ["doc_id", "id", "print"], "text", shingle, early), "near-rows")

    def sets_of(keys: DataFrame, part=lambda found: found) -> DataFrame:
        one = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("id", "print")).alias("one")).select("one.id", "one.print")
        one = stored(one.withColumn("term", F.xxhash64("id", "print")), "near-wanted")
        # of the other texts only a few get as far as the join
        some = slim.select("id", "print", "text").withColumn("term", F.xxhash64("id", "print")).where(_filter_of(one, "term"))
        texts = some.join(one, ["id", "print"], "left_semi").dropDuplicates(["id", "print"])
        return _with_sets(texts, [], "text", shingle, part).drop("sketch", "fingerprint")

    prefixes = _prefixes(rows, common, sets_of, least)
    roots = components(stored(links(rows, prefixes, sets_of, share, reach), "near-all"), "near-components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print", "id")).alias("first")
    # copies meet by key before the few linked keys meet their roots
    copies = rows.groupBy("key").agg(first).join(roots.withColumnRenamed("node", "key"), "key", "left")
    best = copies.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    stay = best.select(F.col("first.id").alias(id_), F.col("first.print").alias(print_)).distinct()
    return keyed.join(stay, [id_, print_]).dropDuplicates([id_, print_]).select(*docs.columns)
