"""Token-id files with bit-plane or byte-plane shuffling.

Documents are tokenised where they lie, dealt to ranges of ascending ids, and packed
into shards: a run of whole documents whose ids are cut into fixed-size blocks; each
block is transposed into planes, each plane compressed with zstandard, and an index
says where every plane ends.  A shard is one row of a Parquet table, so Spark's commit
protocol makes the files whole or absent when an executor is lost.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.common import give_back, lean_batches, scratch, small_batches

BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
# pieces a worker remembers (some 200 bytes each); the memory is cleared when it is full
REMEMBERED = 600_000

SHARDS = (
    "bucket int, shard int, first long, n_ids long, planes string, block int, doc_ids array<long>, "
    "lengths array<long>, plane_ends array<long>, payload binary"
)


# --- blocks -----------------------------------------------------------------

def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    if planes == "byte":
        wide = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(wide[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        wide = np.empty((n, 4), np.uint8)
        for k, part in enumerate(parts):
            wide[:, k] = np.frombuffer(part, np.uint8)
        return wide.view("<u4").reshape(-1)
    bits = np.empty((n, 32), np.uint8)
    for k, part in enumerate(parts):
        bits[:, k] = np.unpackbits(np.frombuffer(part, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> tuple[bytes, list[int]]:
    """Compressed planes of all blocks, and where each ends."""
    press, out, ends, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for low in range(0, len(ids), block):
        for plane in split_planes(ids[low : low + block], planes):
            out.append(press.compress(plane))
            at += len(out[-1])
            ends.append(at)
    return b"".join(out), ends


def unpack(payload: bytes, ends: list[int], n: int, planes: str = "byte", block: int = BLOCK_IDS) -> np.ndarray:
    open_, out = zstandard.ZstdDecompressor(), np.empty(n, "<u4")
    each, at = 4 if planes == "byte" else 32, 0
    for k, low in enumerate(range(0, n, block)):
        parts = []
        for end in ends[k * each : (k + 1) * each]:
            parts.append(open_.decompress(payload[at:end]))
            at = end
        size = min(block, n - low)
        out[low : low + size] = join_planes(parts, size, planes)
    return out


# --- tokenising -------------------------------------------------------------

# a stop or comma that ends a word, right after a letter or digit
_STOP = re.compile(r"[.,](?<=[^\W_][.,])(?=[ \n]|\Z)")


def _plainer(text: str) -> str:
    """The same words with fewer spellings, for a lower-casing tokenizer: western texts in
    lower case (character by character, and in composed form already), with the stops
    that are words of their own set apart."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return _STOP.sub(r" \g<0>", text.lower())


class _Words:
    """Ids of texts by the library's own normalizer, pre-tokenizer and model.

    A lower-casing tokenizer that marks word ends and drops white space never joins over
    a blank, so pieces between blanks are encoded once and remembered.  Every other
    tokenizer, and texts that spell a special token, go to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = bool(
            spec["model"].get("end_of_word_suffix") and "Lowercase" in steps
            and split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]
        )
        if self.by_piece:
            self.normalize, self.cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.word = self.tokenizer.model.tokenize
            self.words_of = regex.compile(split["pattern"]["Regex"]).findall
            # western letters that the normalizer leaves alone, as the pre-tokenizer spells them
            letters = [c for c in map(chr, range(256)) if c.isalpha() and self.normalize(c) == c]
            self.spelt = {ord(c): self.cut(c)[0][0] for c in letters}
            self.western = re.compile(f"[{''.join(letters)}]+").fullmatch
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list = [None] * len(texts)
        pieces, places = [], []
        for i, text in enumerate(texts):
            if self.special.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                pieces.append(_plainer(text).replace("\n", " ").split(" "))
                places.append(i)
        if len(self.known) > self.remembered:
            self.known.clear()
        for new in set().union(*pieces).difference(self.known):
            self.known[new] = self._piece(new)
        get = self.known.__getitem__
        for i, words in zip(places, pieces, strict=True):
            out[i] = np.frombuffer(b"".join(map(get, words)), "<u4")
        return out

    def _piece(self, piece: str) -> bytes:
        """A stop or comma right after what is a letter once normalised is always a word of its own."""
        core = piece.rstrip(".,")
        if core != piece and core and (core[-1] if core[-1].isascii() else self.normalize(core)[-1:]).isalpha():
            return self._core(core) + self._core(piece[len(core) :])
        return self._core(piece)

    def _core(self, core: str) -> bytes:
        plain = core.isascii()
        core = core.lower() if plain else core
        found = self.known.get(core)
        if found is None:
            if self.western(core):
                words = [core if plain else core.translate(self.spelt)]
            elif plain and core.isprintable():
                words = self.words_of(core)
            else:
                words = [word for word, _ in self.cut(self.normalize(core))]
            found = self.known[core] = array("I", [t.id for word in words for t in self.word(word)]).tobytes()
        return found


_encoders: dict[tuple, _Words] = {}


def _encoder(path: str, remembered: int) -> _Words:
    if (path, remembered) not in _encoders:
        give_back()
        _encoders[path, remembered] = _Words(path, remembered)
    return _encoders[path, remembered]


# --- writing and reading ----------------------------------------------------

def write(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
    planes: str = "byte", block: int = BLOCK_IDS, buckets: int | None = None, remembered: int = REMEMBERED,
) -> None:
    """Encode every text (null: empty), append ``end_id``, and write the ids in ascending
    order of id.

    ``buckets`` ranges of ids (as many as shuffle partitions unless given) are cut at
    quantiles of the id, of which that many numbers reach the driver.  A repeated id
    keeps its rows next to each other, ordered by a hash of the text; one that fills
    several ranges is spread over them by that hash.  A null id comes first.
    ``remembered`` bounds the pieces whose ids a worker keeps; it changes time and memory,
    not ids.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = -(2**63)
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(nothing)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = keyed.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first().q
    cuts = np.array(cuts if n > 1 and cuts else [], np.int64)

    def encode(batches):
        words = _encoder(tokenizer, remembered)
        for batch in small_batches(batches):
            ids, ties, texts = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist())
            low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
            part = ties.astype(np.float64) / 2.0**63
            bucket = low + np.minimum((part * (high - low)).astype(np.int64), np.maximum(high - low - 1, 0))
            lists = words.encode(texts)
            narrow = np.dtype("<u4") if max((int(x.max()) for x in lists if len(x)), default=0) > 65535 or end_id > 65535 else np.dtype("<u2")
            raw = [np.append(x, end_id).astype(narrow).tobytes() for x in lists]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket.astype(np.int32)), "id": batch.column(0), "tie": batch.column(1),
                "width": pa.array(np.full(len(raw), narrow.itemsize, np.int32)), "ids": pa.array(raw, pa.binary()),
            })

    tie = F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)).alias("tie")
    rows = keyed.select("id", tie, "text").mapInArrow(encode, "bucket int, id long, tie long, width int, ids binary")
    ordered = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "id", "tie")

    def shards(batches):
        bucket, number, first, names, parts, size = None, 0, 0, [], [], 0

        def flush():
            nonlocal number, first, names, parts, size
            ids = np.concatenate(parts).astype("<u4")
            payload, ends = pack(ids, planes, block)
            out = pa.RecordBatch.from_pydict({
                "bucket": pa.array([bucket], pa.int32()), "shard": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "planes": pa.array([planes]), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([[None if x == nothing else x for x in names]], pa.list_(pa.int64())),
                "lengths": pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                "plane_ends": pa.array([ends], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
            })
            number, first, names, parts, size = number + 1, first + len(ids), [], [], 0
            return out

        for batch in small_batches(batches, 4, 4 << 20):
            for at, name, width, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if names and (at != bucket or size >= SHARD_IDS):
                    yield flush()
                if at != bucket:
                    bucket, number, first = at, 0, 0
                names.append(name)
                parts.append(np.frombuffer(raw, f"<u{width}"))
                size += len(parts[-1])
        if names:
            yield flush()

    with lean_batches(spark):
        ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document in the files.
    What comes before a bucket is summed from the shards' headers: one number per bucket
    reaches the driver."""
    files = spark.read.schema(SHARDS).parquet(path)
    starts, before = {}, 0
    for row in files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect():
        starts[row.bucket], before = before, before + row.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decode(batches):
        for batch in small_batches(batches, 9, 4 << 20):
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["plane_ends"], row["n_ids"], row["planes"], row["block"])
                stops = np.cumsum(row["lengths"])
                begins = stops - row["lengths"]
                spans = [ids[a:b] for a, b in zip(begins, stops, strict=True)]
                out = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + (starts[row["bucket"]] + row["first"])),
                    "n_tokens": pa.array(stops - begins), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in spans], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(decode, schema)


def roundtrip(docs: DataFrame, tokenizer: str, with_ids: bool = False, **options) -> DataFrame:
    """Write ``docs`` to a new folder below the shared checkpoint folder and read it back."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, **options)
    return read(docs.sparkSession, path, with_ids)
