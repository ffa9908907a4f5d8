"""Resampling a corpus towards a target distribution, weights by bit-sliced aggregation.

Features are runs of one to three words, hashed by CRC-32 into buckets.  Bucket totals of
the corpus and of the target give every bucket a signed whole gain.  A document's bucket
counts are cut into bit planes, one bit per bucket, and so are the gains, those above
and those below zero apart; the weight is the sum, over pairs of planes, of the popcount
of their AND times the power of two the pair stands for.  No rounding takes place.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, id_text, small_batches, stored
from shoebox.operators.skew import with_position

BUCKETS = 10_000
LONGEST = 3
# words of more bytes are hashed one by one
TABLED = 48
# bytes of text hashed at once, and words of a document
PIECE = 1 << 21
# documents whose counts are cut into planes at once
TOGETHER = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The step table of CRC-32, and for 0 to TABLED zero bytes appended, what each of the
    four bytes of a register becomes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    shift = np.empty((TABLED + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << (8 * k)
    for n in range(TABLED):
        shift[n + 1] = step[shift[n] & 255] ^ shift[n] >> 8
    return step, shift


def _appended(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes as ``zeros`` says."""
    shift = _tables()[1].reshape(-1)
    left = zeros
    while left.size and left.max() > TABLED:
        much = left > TABLED
        register, left = register.copy(), left.copy()
        register[much] = _appended(register[much], np.full(int(much.sum()), TABLED))
        left[much] -= TABLED
    base = left.astype(np.int64) << 10
    out = shift[base + (register & 255)]
    for k in range(1, 4):
        out = out ^ shift[base + (k << 8) + (register >> (8 * k) & 255)]
    return out


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of A-Z (lower-cased), 0-9 and bytes from 128: ``(register, length, words per text)``,
    the register being that of the word alone, from zero."""
    step, _ = _tables()
    body = b" ".join(texts) + b" "
    data = np.frombuffer(body, np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edges = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    start, end = edges[::2], edges[1::2]
    length = end - start
    register = np.zeros(len(start), np.uint32)
    # a byte of all words at a time, the long ones apart
    rest = np.flatnonzero(length <= TABLED)
    for at in range(TABLED):
        rest = rest[length[rest] > at]
        if not len(rest):
            break
        now = register[rest]
        register[rest] = step[(now ^ data[start[rest] + at]) & 255] ^ now >> 8
    long = np.flatnonzero(length > TABLED)
    lower = data.tobytes() if len(long) else b""
    for w in long.tolist():
        register[w] = zlib.crc32(lower[start[w] : end[w]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    upto = np.cumsum([len(t) + 1 for t in texts])
    return register, length, np.diff(np.r_[0, np.searchsorted(start, upto)])


def _features(register: np.ndarray, length: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all runs of words of one owner, with their owners, for each run length."""
    step, _ = _tables()
    full = np.uint32(0xFFFFFFFF)
    made, state = [], _appended(np.full(len(register), full), length) ^ register
    for words in range(1, LONGEST + 1):
        if words > 1:
            # a space, then the next word
            state = step[(state[:-1] ^ np.uint32(32)) & 255] ^ state[:-1] >> 8
            state = _appended(state, length[words - 1 :]) ^ register[words - 1 :]
        whole = owner[words - 1 :] == owner[: len(owner) - words + 1]
        made.append((((state ^ full)[whole] % np.uint32(buckets)).astype(np.int64), owner[words - 1 :][whole]))
        if len(state) < 2:
            break
    return made


def _long_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words of a long text, a piece at a time; pieces end where words do."""
    parts, low = [], 0
    while low < len(text):
        high = min(low + PIECE, len(text))
        while high < len(text) and (text[high] >= 128 or chr(text[high]).isalnum()):
            high += 1
        parts.append(_split([text[low:high]])[:2])
        low = high
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _groups(texts: list[bytes]):
    """``(first, last, registers, lengths, words per text)`` of texts taken together, long ones alone."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and high - low < TOGETHER and (high == low or size + len(texts[high]) <= PIECE):
            size += len(texts[high])
            high += 1
        if size > PIECE:
            register, length = _long_words(texts[low])
            yield low, high, register, length, np.array([len(register)])
        else:
            yield low, high, *_split(texts[low:high])
        low = high


def _counted(texts: list[bytes], buckets: int, together: bool = False):
    """``(first, last, words per text, counts)``, counts being a row of buckets per text, or
    one row for all of them."""
    for low, high, register, length, n_words in _groups(texts):
        owner = np.repeat(np.arange(high - low), n_words)
        counts = np.zeros(buckets * (1 if together else high - low), np.int64)
        # a very long text a slice of words at a time, each with the two words before it
        for a in range(0, max(len(register), 1), PIECE):
            part = slice(max(a - LONGEST + 1, 0), a + PIECE)
            back, places = a - part.start, []
            for words, (bucket, own) in enumerate(_features(register[part], length[part], owner[part], buckets), 1):
                # runs that end before this slice are counted already
                skip = max(back - words + 1, 0)
                places.append((bucket if together else own * buckets + bucket)[skip:])
            found = np.bincount(np.concatenate(places), minlength=len(counts))
            counts = found if a == 0 else counts + found
        yield low, high, n_words, counts.reshape(-1, buckets)


def planes(counts: np.ndarray) -> list[np.ndarray]:
    """Bit planes of whole numbers, lowest first: one bit a column, packed into 64-bit words."""
    most = int(counts.max(initial=0))
    counts = counts.astype(np.min_scalar_type(most))
    out = []
    for bit in range(most.bit_length()):
        whole = np.zeros((len(counts), -(-counts.shape[1] // 64) * 8), np.uint8)
        packed = np.packbits(counts >> bit & 1, axis=1)
        whole[:, : packed.shape[1]] = packed
        out.append(whole.view(np.uint64))
    return out


def weights(counts: np.ndarray, above: list[np.ndarray], below: list[np.ndarray]) -> np.ndarray:
    """Sum over buckets of count times gain, from planes of both."""
    total = np.zeros(len(counts), np.int64)
    for i, plane in enumerate(planes(counts)):
        for sign, gains in ((1, above), (-1, below)):
            for j, gain in enumerate(gains):
                total += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (i + j))
    return total


def totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; buckets without any are absent."""
    rows = docs.select(F.encode(F.col(text), "UTF-8").alias("t")).where("t IS NOT NULL")

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            for _, _, _, counts in _counted(batch.column(0).to_pylist(), buckets, together=True):
                sums += counts[0]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, doc_text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of a log ratio of add-one shares, rounded down: target over corpus.
    Two numbers a bucket reach the driver."""
    have, want = ({r.bucket: r.n for r in totals(df, text, buckets).collect()} for df, text in ((docs, doc_text), (target, target_text)))
    s_all, t_all = sum(have.values()), sum(want.values())
    ratio = [(float(want.get(b, 0) + 1) * float(s_all + buckets)) / (float(have.get(b, 0) + 1) * float(t_all + buckets)) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``n_words, n_features, weight`` of every text.  Null and empty
    texts, and texts without words, have weight 0."""
    keep = [doc_id] if keep is None else keep
    buckets = len(gain)
    above, below = planes(np.maximum(gain, 0)[None]), planes(np.maximum(-gain, 0)[None])
    rows = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(fresh(keep, "_text")))
    schema = docs.select(*keep).withColumns({n: F.lit(0).cast("long") for n in ("n_words", "n_features", "weight")}).schema

    def run(batches):
        for batch in small_batches(batches):
            found = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for low, high, n_words, counts in _counted(batch.column(batch.num_columns - 1).to_pylist(), buckets):
                for into, value in zip(found, (n_words, counts.sum(axis=1), weights(counts, above, below)), strict=True):
                    into[low:high] = value
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=schema.names)

    return rows.mapInArrow(run, schema)


def gumbel(doc_id: str, seed: int = 42) -> Column:
    """A draw from the Gumbel distribution in thousandths, rounded down, from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(doc_id)), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the rows with at least ``least_words`` words, the share of ``percent`` per cent
    (rounded down) with the highest scores is drawn without replacement (Gumbel top-k) and ranked from
    1; the others' rank is null.  Ties go to the smaller id, a null id first; repeated
    rows draw the same number, and each takes a rank of its own.  Null, empty and
    wordless texts have weight 0 and are not drawn; an empty table gives no rows, an
    empty target equal wishes for all buckets.
    """
    gain = gains(docs, target, text, target_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = stored(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc(able), F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    rank = F.when(able & (F.col("rank") <= drawn), F.col("rank"))
    return with_position(scored, order, "rank").withColumn("rank", rank).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
