"""Repeated byte strings of a corpus, by suffix order and interval expansion.

A string of ``length`` bytes is found again where it starts in a document of a smaller
id.  Texts lie in chunks.  Strings are told apart in three steps:

1. Every string has an anchor, the least hash of the grams in it, so equal strings have
   equal anchors.  Anchors of only one document are counted out: ``(bucket, chunk)`` rows
   carry hashes, and bits come back.
2. Neighbouring strings of one anchor form a piece.  Pieces of the anchors left meet in a
   task by their anchor; equal pieces count once, with the least id.
3. There, strings whose hash no other piece has are left out, and blocks of the rest are put in
   suffix order, threshold-bounded: the Burrows-Wheeler transform is taken, and from the intervals of single characters all
   intervals are extended backwards at once, breadth first.  Each round sets the borders of the
   strings one longer, hence common prefixes by increasing value, and the last round is
   that of ``length``.  An interval left whole is a repeated string; its least id goes back
   to the chunks, which cut their texts.

Anchors with more pieces than a block should hold are dealt by single strings instead.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import small_batches, stored

LENGTH = 50
# bytes of text in a chunk (a longer text alone), and positions hashed at once
CHUNK = 2 << 20
SLICE = 1 << 19
# bytes of text to a bucket, and bytes of pieces put in order at once
BUCKET = 32 << 20
BLOCK = 1 << 20
# pieces laid out side by side at once
ROWS = 1 << 14
# an anchor of more pieces is dealt by single strings
MANY = 1 << 17
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
# stands for a null id: after all others
LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds))
    ends = np.cumsum(sizes) + sizes.nbytes
    return [np.frombuffer(data[e - s : e], kind) for s, e, kind in zip(sizes.tolist(), ends.tolist(), kinds, strict=True)]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes; it decides where strings meet, not what is equal."""
    up, down = _powers(SLICE + 1024)
    if len(data) > len(up):
        raise ValueError("more bytes than are hashed at once")
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    found = (total[size:] - total[:-size]) * down[: len(data) - size + 1]
    found ^= found >> np.uint64(32)
    found *= MIX
    return found ^ found >> np.uint64(29)


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of every ``reach`` neighbours."""
    span = 1
    out = values
    while span * 2 <= reach:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - reach + 1], out[reach - span :]) if span < reach else out


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, how many, anchor)`` of the runs of neighbouring strings with one anchor, in
    order; none crosses a text's end.  ``ends`` are the texts' ends in ``data``."""
    gram = max(1, length // 3)
    reach = length - gram + 1
    begins = np.r_[0, ends[:-1]]
    barred = np.zeros(len(data) + 1, np.int8)
    some = ends > begins
    np.add.at(barred, np.maximum(begins, ends - length + 1)[some], 1)
    np.add.at(barred, ends[some], -1)
    starts, counts, anchors = [], [], []
    before = 0
    for a in range(0, len(data) - length + 1, SLICE):
        b = min(a + SLICE, len(data) - length + 1)
        least = _least(_grams(data[a : b + length - 1], gram), reach)
        level = np.cumsum(barred[a:b], dtype=np.int32) + before
        before = int(level[-1])
        here = level == 0
        new = here.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~here[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # a run ends where the next one begins or a text is over
        upto = np.cumsum(here)
        size = np.diff(np.r_[upto[first] - 1, upto[-1]])
        parts = -(-size // reach)
        at = np.repeat(first, parts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts.append(at + step * reach + a)
        counts.append(np.minimum(np.repeat(size, parts) - step * reach, reach))
        anchors.append(least[at])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``symbols`` (below 512; 0 separates, and ends the text) ordered by their
    first ``length`` symbols at least, and the common prefix of each with the one before,
    counted up to ``length`` and meant for suffixes without a separator that near."""
    n = len(symbols)
    padded = np.r_[symbols, np.zeros(8, symbols.dtype)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    known = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]]).astype(np.uint64)
        if known >= length:
            break
        later = np.zeros(n, np.uint64)
        later[: max(n - known, 0)] = rank[known:]
        key = rank << np.uint64(32) | later
        known *= 2
    del key, ranked, rank, padded
    # the transform; a stable sort of it leads from a suffix to the one after its first symbol
    transform = symbols[order - 1]
    after = np.argsort(transform, kind="stable")
    sorted_ = transform[after]
    prefix = np.full(n, length, np.int16)
    border = np.r_[True, sorted_[1:] != sorted_[:-1]]
    prefix[border] = 0
    open_ = np.flatnonzero(~border)
    here, there = after[open_], after[open_ - 1]
    for value in range(1, length):
        # the interval each suffix is in, for strings of ``value`` symbols; extending all of
        # them backwards tells two suffixes apart whose rests lie in different ones
        interval = np.cumsum(border, dtype=np.int32)
        apart = interval[here] != interval[there]
        if not apart.any():
            break
        prefix[open_[apart]] = value
        border[open_[apart]] = True
        open_, here, there = open_[~apart], here[~apart], there[~apart]
    return order, prefix


def _rows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Pieces of ``data`` as fixed-size keys: their bytes, filled up, and their size."""
    at = np.minimum(starts[:, None] + np.arange(width), max(len(data) - 1, 0))
    table = np.where(np.arange(width) < sizes[:, None], data[at], 0).astype(np.uint8)
    return np.ascontiguousarray(np.c_[table, sizes.astype(np.uint8)]).view(np.dtype((np.void, width + 1))).ravel()


def _distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first, which)``: one occurrence of every distinct piece, and the piece of each
    occurrence.  Equal pieces have equal keys, so pieces are told apart among those of some keys at
    a time, and of these among ``ROWS`` at most before what is left of them meets."""
    part = (key >> np.uint64(16)) % np.uint64(max(1, -(-len(key) // ROWS)))
    order = np.argsort(part, kind="stable")
    first, which, n = [], np.empty(len(key), np.int64), 0

    def unique(some):
        return np.unique(_rows(data, starts[some], sizes[some], width), return_index=True, return_inverse=True)[1:]

    for a, b in _same(part[order]):
        kept, inner, seen = [], [], 0
        for low in range(a, b, ROWS):
            some = order[low : min(low + ROWS, b)]
            at, where = unique(some)
            kept.append(some[at])
            inner.append(where + seen)
            seen += len(at)
        left, piece = np.concatenate(kept), np.concatenate(inner)
        if len(kept) > 1:
            at, where = unique(left)
            left, piece = left[at], where[piece]
        first.append(left)
        which[order[a:b]] = piece + n
        n += len(left)
    return np.concatenate([np.zeros(0, np.int64), *first]), which


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from ``first``, ``count`` of them each, and whose they are."""
    whose = np.repeat(np.arange(len(first)), count)
    return np.arange(len(whose)) - np.repeat(np.cumsum(count) - count - first, count), whose


class Chunk:
    """One chunk's texts and, once its flags are known, its pieces in a fixed order."""

    def __init__(self, ids, ends, body: bytes, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.ids, self.ends = ids, np.asarray(ends, np.int64)
        self.order = np.array([LAST if i is None else i for i in ids], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self.start, self.count, self.anchor = runs(self.data, self.ends, length)
        self.text = np.searchsorted(self.ends, self.start, side="right")
        found = np.unique(self.anchor, return_inverse=True, return_counts=True)
        self.keys, self.which, self.times = found
        bucket = (self.keys >> np.uint64(40)).astype(np.int64) % buckets
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.by_bucket]

    def tallies(self):
        """``(bucket, keys, counts)`` of its anchors."""
        for a, b in _same(self.bucket):
            mine = self.by_bucket[a:b]
            low = self.keys[mine].view(np.uint8).reshape(-1, 8)[:, :5]
            yield int(self.bucket[a]), low.tobytes(), self.times[mine].astype(np.uint32).tobytes()

    def pieces(self, flags) -> None:
        """Finds its distinct pieces whose anchor is in more than one text."""
        n = len(self.keys)
        least, most = np.full(n, len(self.ids)), np.full(n, -1)
        np.minimum.at(least, self.which, self.text)
        np.maximum.at(most, self.which, self.text)
        shared, hot = least < most, np.zeros(n, bool)
        for f in flags or []:
            a, b = np.searchsorted(self.bucket, [f["bucket"], f["bucket"] + 1])
            mine = self.by_bucket[a:b]
            shared[mine] |= np.unpackbits(np.frombuffer(f["shared"], np.uint8), count=b - a).astype(bool)
            hot[mine] |= np.unpackbits(np.frombuffer(f["hot"], np.uint8), count=b - a).astype(bool)
        plain = np.flatnonzero(shared[self.which] & ~hot[self.which])
        single, whose = _spread(self.start, np.where(shared[self.which] & hot[self.which], self.count, 0))
        # occurrences: where they start, how many strings they are, in which text
        self.at = np.r_[self.start[plain], single]
        self.many = np.r_[self.count[plain], np.ones(len(single), np.int64)]
        self.owner = self.order[np.r_[self.text[plain], self.text[whose]]]
        width = 2 * self.length - max(1, self.length // 3)
        key = np.r_[self.anchor[plain], np.zeros(len(single), np.uint64)]
        if len(single):
            key[len(plain) :] = self._of_strings(single)
        first, self.piece = _distinct(self.data, self.at, self.many + self.length - 1, key, width)
        self.own = np.full(len(first), LAST)
        np.minimum.at(self.own, self.piece, self.owner)
        self.key, self.from_, self.strings = key[first], self.at[first], self.many[first]
        bucket = (self.key >> np.uint64(32)).astype(np.int64) % self.buckets
        self.by_piece = np.argsort(bucket, kind="stable")
        self.piece_bucket = bucket[self.by_piece]

    def _of_strings(self, starts: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(starts), SLICE // self.length):
            part = starts[a : a + SLICE // self.length]
            flat = self.data[part[:, None] + np.arange(self.length)].ravel()
            out.append(_grams(flat, self.length)[:: self.length])
        return np.concatenate(out)

    def sent(self):
        """``(bucket, pieces)`` to be put in order."""
        for a, b in _same(self.piece_bucket):
            mine = self.by_piece[a:b]
            places, _ = _spread(self.from_[mine], self.strings[mine] + self.length - 1)
            group = (self.key[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield int(self.piece_bucket[a]), pack(group, self.strings[mine].astype(np.uint8), self.own[mine], self.data[places])

    def covered(self, replies) -> np.ndarray:
        """Which bytes lie in a string that a text of a smaller id has too."""
        base = np.cumsum(self.strings) - self.strings
        least = np.repeat(self.own, self.strings)
        for r in replies or []:
            a, b = np.searchsorted(self.piece_bucket, [r["bucket"], r["bucket"] + 1])
            local, place, size, value = unpack(r["found"], np.uint32, np.uint8, np.uint8, np.int64)
            where, whose = _spread(base[self.by_piece[a:b][local]] + place, size.astype(np.int64))
            least[where] = value[whose]
        string, whose = _spread(base[self.piece], self.many)
        out = least[string] < self.owner[whose]
        place = (self.at[whose] + string - base[self.piece][whose])[out]
        change = np.bincount(place, minlength=len(self.data) + 1) - np.bincount(place + self.length, minlength=len(self.data) + 1)
        return np.cumsum(change[: len(self.data)]) > 0

    def cut(self, covered: np.ndarray):
        """``(id, bytes, spans, kept)`` of every text."""
        body, low = self.data.tobytes(), 0
        for i, high in zip(self.ids, self.ends.tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.r_[False, covered[low:high], False].view(np.int8))).tolist()
            spans = list(zip(edges[::2], edges[1::2], strict=True))
            kept = b"".join(body[low + x : low + y] for x, y in zip([0, *edges[1::2]], [*edges[::2], high - low], strict=True))
            yield i, high - low, [{"start": x, "stop": y} for x, y in spans], kept
            low = high


def _same(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(values):
        return []
    cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _by_bucket(batches):
    """``(bucket, rows)`` of rows that come sorted by bucket."""
    held, at = [], None
    for batch in batches:
        for row in range(batch.num_rows):
            bucket = batch.column(0)[row].as_py()
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append([c[row].as_py() for c in batch.columns[1:]])
    if held:
        yield at, held


def _flag(rows: list) -> list[tuple]:
    """Which of a bucket's keys are in more than one chunk, and which of these in very many pieces."""
    parts = [np.frombuffer(r[1], np.uint8).reshape(-1, 5) for r in rows]
    keys = np.zeros((sum(map(len, parts)), 8), np.uint8)
    keys[:, :5] = np.concatenate(parts)
    times = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]).astype(np.int64)
    _, which, chunks = np.unique(keys.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    shared = chunks[which] > 1
    hot = np.bincount(which, times)[which] > MANY
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return [(r[0], shared[a:b], hot[a:b]) for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True)]


def _again(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which strings of the pieces have a hash that another one has too: all that are equal to
    another, and by chance a few more."""
    hashes = [np.zeros(0, np.uint64)]
    upto = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = upto[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(upto, before + SLICE, side="right")))
        places, whose = _spread(starts[low:high], sizes[low:high])
        left = upto[low:high][whose] - before - np.arange(len(places))
        hashes.append(_grams(data[places], length)[left[: len(places) - length + 1] >= length])
        low = high
    found = np.concatenate(hashes)
    ranked = np.sort(found)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    twice = twice[np.r_[True, twice[1:] != twice[:-1]][: len(twice)]]
    if not len(twice):
        return np.zeros(len(found), bool)
    return twice[np.minimum(np.searchsorted(twice, found), len(twice) - 1)] == found


def _resolve(rows: list, length: int) -> dict[int, list[np.ndarray]]:
    """For each row of pieces, strings that a text of a smaller id than its own has:
    ``(piece, first string, how many, least id)``."""
    parts = [unpack(r[1], np.uint32, np.uint8, np.int64, np.uint8) for r in rows]
    group, strings, own, data = (np.concatenate([p[k] for p in parts]) for k in range(4))
    local = np.concatenate([np.arange(len(p[0])) for p in parts])
    row = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
    del parts
    strings = strings.astype(np.int64)
    sizes = strings + length - 1
    start = np.cumsum(sizes) - sizes
    order = np.argsort(group, kind="stable")
    groups = _same(group[order])
    made, low = [], 0
    weight = np.cumsum(sizes[order])
    while low < len(groups):
        # whole groups, a block's bytes together
        high, before = low + 1, weight[groups[low][0]] - sizes[order[groups[low][0]]]
        while high < len(groups) and weight[groups[high][1] - 1] - before <= BLOCK:
            high += 1
        mine = order[groups[low][0] : groups[high - 1][1]]
        low = high
        width = 2 * length - max(1, length // 3)
        _, first, which = np.unique(_rows(data, start[mine], sizes[mine], width), return_index=True, return_inverse=True)
        least_own = np.full(len(first), LAST)
        np.minimum.at(least_own, which, own[mine])
        kept = mine[first]
        base = np.cumsum(strings[kept]) - strings[kept]
        least = np.repeat(least_own, strings[kept])
        # strings of one piece only have its least id; runs of the others, a separator after each
        again = _again(data, start[kept], sizes[kept], length)
        edge = np.r_[True, again[1:] != again[:-1]]
        edge[base] = True
        begin = np.flatnonzero(edge)
        count = np.diff(np.r_[begin, len(again)])[again[begin]]
        begin = begin[again[begin]]
        if len(begin):
            owner = np.searchsorted(base, begin, side="right") - 1
            places, whose = _spread(start[kept][owner] + begin - base[owner], count + length - 1)
            symbols = np.zeros(len(places) + len(begin), np.uint16)
            symbols[np.arange(len(places)) + whose] = data[places].astype(np.uint16) + 1
            value = np.full(len(symbols), LAST)
            string, whose = _spread(np.cumsum(count + length) - count - length, count)
            value[string] = least_own[owner[whose]]
            suffix, prefix = intervals(symbols, length)
            borders = np.flatnonzero(prefix < length)
            lowest = np.empty(len(symbols), np.int64)
            lowest[suffix] = np.repeat(np.minimum.reduceat(value[suffix], borders), np.diff(np.r_[borders, len(suffix)]))
            least[again] = lowest[string]
        # every piece's strings against the least id of its own chunk
        at, piece = _spread(base[which], strings[mine])
        found = least[at]
        less = found < own[mine][piece]
        at, piece, found = at[less], piece[less], found[less]
        new = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1) | (found[1:] != found[:-1])][: len(at)])
        count = np.diff(np.r_[new, len(at)])
        made.append((row[mine[piece[new]]], local[mine[piece[new]]], at[new] - base[which[piece[new]]], count, found[new]))
    row, local, place, count, found = (np.concatenate([m[k] for m in made]) for k in range(5))
    order = np.argsort(row, kind="stable")
    return {
        int(row[order[a]]): [local[order[a:b]].astype(np.uint32), place[order[a:b]].astype(np.uint8), count[order[a:b]].astype(np.uint8), found[order[a:b]]]
        for a, b in _same(row[order])
    }


def chunked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(ids, ends, body)``: texts in chunks, compressed, as they come."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    schema = "ids array<bigint>, ends array<bigint>, body binary"

    def run(batches):
        for batch in small_batches(batches, most=CHUNK):
            texts = batch.column(1).to_pylist()
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            ends = np.cumsum([len(t) for t in texts]).tolist()
            yield pa.RecordBatch.from_pydict({"ids": [batch.column(0).to_pylist()], "ends": [ends], "body": [body]})

    return rows.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of UTF-8 bytes (``start`` to before ``stop``) covered by
    strings of ``length`` bytes that also start in a row with a smaller whole-number id;
    ``kept`` is the rest, as bytes, since a cut may fall inside a character.  Strings are judged
    on the whole input.  Null and empty texts have no bytes; texts shorter than ``length``
    stay whole.  Repeated ids are one document to each other; a null id counts as larger
    than all others.  Other columns are left out, an empty table gives no rows.
    """
    if not 2 <= length <= 128:
        raise ValueError("length must lie between 2 and 128")
    chunks = stored(chunked(docs, doc_id, text).withColumn("chunk", F.monotonically_increasing_id()), "repeat-chunks")
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))

    def chunk_of(batch, row, flags=None):
        at = {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}
        return at, Chunk(at["ids"], at["ends"], at["body"], length, buckets)

    def tally(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, chunk = chunk_of(batch, row)
                made = list(chunk.tallies())
                if made:
                    bucket, keys, times = zip(*made, strict=True)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "chunk": [at["chunk"]] * len(made), "keys": keys, "times": times})

    def flag(batches):
        for bucket, rows in _by_bucket(batches):
            for chunk, shared, hot in _flag(rows):
                if shared.any():
                    bits = {"shared": [np.packbits(shared).tobytes()], "hot": [np.packbits(hot & shared).tobytes()]}
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bucket": pa.array([bucket], pa.int32()), **bits})

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, chunk = chunk_of(batch, row)
                chunk.pieces(at["flags"])
                made = list(chunk.sent())
                if made:
                    bucket, pieces = zip(*made, strict=True)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "chunk": [at["chunk"]] * len(made), "pieces": pieces})

    def resolve(batches):
        for bucket, rows in _by_bucket(batches):
            for row, found in _resolve(rows, length).items():
                yield pa.RecordBatch.from_pydict({"chunk": [rows[row][0]], "bucket": pa.array([bucket], pa.int32()), "found": [pack(*found)]})

    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, chunk = chunk_of(batch, row)
                chunk.pieces(at["flags"])
                ids, sizes, gone, kept = zip(*chunk.cut(chunk.covered(at["replies"])), strict=True)
                columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")

    tallies = chunks.mapInArrow(tally, "bucket int, chunk bigint, keys binary, times binary")
    flags = stored(dealt(tallies).mapInArrow(flag, "chunk bigint, bucket int, shared binary, hot binary"), "repeat-flags")
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("flags"))
    known = chunks.join(flags, "chunk", "left")
    pieces = known.mapInArrow(send, "bucket int, chunk bigint, pieces binary")
    replies = stored(dealt(pieces).mapInArrow(resolve, "chunk bigint, bucket int, found binary"), "repeat-found")
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "found")).alias("replies"))
    return known.join(replies, "chunk", "left").mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")
