"""Content hash, format and dimensions.

The hash is SHA-256 in hex, or a tree of such hashes (``tree_hashes``), which several tasks
can work out for one huge file.  The format follows the extension, as the decoder
does when it opens a file by name; dimensions are read from the header that
format calls for, and are null when the header does not fit or claims what no picture has.

Work is dealt by bytes: files, or pieces of files, in the order of a hash of their paths,
are cut where a running sum of bytes passes equal shares.
"""

from __future__ import annotations

import io
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One task hashes about this much at most, and this little at least; a file costs as much as
# so many of its bytes, however small it is.
BYTES_PER_TASK = 2 << 30
LEAST_PER_TASK = 4 << 20
BYTES_OF_A_FILE = 1 << 16
SHA256, TREE = "sha256", "sha256-tree"
# a tree's leaves are pieces of files of this size, and each of its nodes has so many children
PIECE = 64 << 20
CHILDREN = 256
# a dimension is a 32-bit number in the tables
MOST = (1 << 31) - 1


def format_of(path) -> Column:
    ext = paths.extension(path)
    return F.when(ext == "jpg", "jpeg").when(ext != "", ext)


def _jpeg_size(f):
    f.seek(2)
    while True:
        head = f.read(2)
        if len(head) < 2 or head[0] != 0xFF:
            return None
        marker = head[1]
        while marker == 0xFF:
            marker = f.read(1)[0]
        if marker in (0x01, *range(0xD0, 0xD8)):
            continue
        (length,) = struct.unpack(">H", f.read(2))
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">xHH", f.read(5))
            return width, height
        f.seek(length - 2, 1)


def _webp_size(head):
    if head[12:16] == b"VP8 ":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if head[12:16] == b"VP8L":
        (bits,) = struct.unpack("<I", head[21:25])
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
    if head[12:16] == b"VP8X":
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    return None


def _tiff_size(f, head):
    order = "<" if head[:2] == b"II" else ">"
    f.seek(struct.unpack(order + "I", head[4:8])[0])
    found = {}
    for _ in range(struct.unpack(order + "H", f.read(2))[0]):
        tag, kind, _count, value = struct.unpack(order + "HHI4s", f.read(12))
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return found[256], found[257]


def image_size(f, kind):
    """``(width, height)`` from an open file, or None: also where a header claims more than
    the tables hold, or less than nothing."""
    size = _claimed_size(f, kind)
    return size if size and all(0 <= n <= MOST for n in size) else None


def _claimed_size(f, kind):
    try:
        head = f.read(32)
        if kind == "png" and head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if kind == "gif" and head[:4] == b"GIF8":
            return struct.unpack("<HH", head[6:10])
        if kind == "bmp" and head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if kind == "jpeg" and head[:2] == b"\xff\xd8":
            return _jpeg_size(f)
        if kind == "webp" and head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp_size(head)
        if kind == "tiff" and head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_size(f, head)
    except (struct.error, IndexError, KeyError, OSError):
        return None
    return None


def fingerprint_content(files: DataFrame) -> DataFrame:
    """Fingerprint rows ``(path, content)``, for files that fit in memory.  The
    hash stays in the JVM; the header check gets the content in Arrow batches."""

    @F.pandas_udf("width int, height int")
    def size_of(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        sizes = [image_size(io.BytesIO(c), k) if c is not None else None for c, k in zip(content, kind)]
        out = pd.DataFrame([s or (None, None) for s in sizes], columns=["width", "height"])
        return out.astype("Int32")

    kind = format_of("path")
    sized = files.withColumn("format", kind).withColumn("_size", size_of("content", F.coalesce(kind, F.lit(""))))
    return sized.select(
        *[c for c in files.columns if c != "content"],
        F.sha2("content", 256).alias("content_hash"),
        F.col("_size.width").alias("width"), F.col("_size.height").alias("height"), "format",
    )


def _cost(size) -> Column:
    return F.coalesce(size, F.lit(0)) + BYTES_OF_A_FILE


def dealt_by_bytes(rows: DataFrame, size: str, order: list[str], least: int = LEAST_PER_TASK, most: int = BYTES_PER_TASK) -> DataFrame:
    """The rows in partitions of about equal bytes (of column ``size``), none above twice an
    equal share plus one row.

    There is a share for every core as long as it is worth it, more beyond
    ``most`` bytes a task.  The running sum is taken within range partitions of a hash of
    ``order``; of each, one row with its sum reaches the driver.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(_cost(F.col(size)))).first()[0] or 0
    share = min(most, max(least, -(-total // spark.sparkContext.defaultParallelism)))
    tasks = max(1, -(-total // share))
    if tasks == 1:
        return rows.coalesce(1)
    ranged = rows.withColumn("_order", F.xxhash64(*order)).repartitionByRange("_order", *order).sortWithinPartitions("_order", *order)
    # a partition's rows keep their places, so both uses must see the same ones
    pinned = checkpointed(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sums = pinned.groupBy(part.alias("p")).agg(F.sum(_cost(F.col(size))).alias("n")).collect()
    before, starts = 0, []
    for row in sorted(sums, key=lambda r: r.p):
        starts.append((row.p, before))
        before += row.n
    starts = spark.createDataFrame(starts, "_part bigint, _before bigint")
    inside = F.sum(_cost(F.col(size))).over(Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0))
    summed = pinned.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_upto", inside + F.col("_before"))
    # the share in which a row's middle byte lies
    task = F.least(F.floor((F.col("_upto") - _cost(F.col(size)) / 2) / share), F.lit(tasks - 1)).cast("int")
    return summed.repartitionById(tasks, task).select(*rows.columns)


def _counting(counter, n: int, size: int) -> None:
    if counter is not None:
        files, read = counter
        files.add(n)
        read.add(size)


def fingerprint_files(files: DataFrame, algorithm: str = SHA256, counter=None, piece: int = PIECE, children: int = CHILDREN) -> DataFrame:
    """Fingerprint the files named by ``path`` and ``size``, all other columns carried along.

    Each file is hashed in pieces, so its size does not matter to memory; with
    ``sha256-tree`` the pieces of one file are shared out too.  A file that cannot be
    read comes back with ``error`` set.  Rows are tiny next to the bytes they stand for,
    so they are dealt by bytes.  ``counter`` is a pair of accumulators, of files and of bytes.
    """
    if algorithm not in (SHA256, TREE):
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    named = files.withColumn("format", format_of("path"))
    if algorithm == TREE:
        found = tree_hashes(files.select("path", "size"), counter, piece, children)
        return named.join(found, "path", "left").select(*named.columns, "content_hash", "width", "height", "error")

    def work(batches):
        import hashlib

        for pdf in batches:
            out, total = [], 0
            for path, kind in zip(pdf["path"], pdf["format"], strict=True):
                try:
                    digest = hashlib.sha256()
                    with open(path, "rb") as f:
                        while block := f.read(1 << 20):
                            digest.update(block)
                            total += len(block)
                        f.seek(0)
                        width, height = image_size(f, kind) or (None, None)
                    out.append((digest.hexdigest(), width, height, None))
                except OSError as problem:
                    out.append((None, None, None, str(problem)))
            _counting(counter, len(out), total)
            made = pd.DataFrame(out, columns=["content_hash", "width", "height", "error"])
            yield pd.concat([pdf.reset_index(drop=True), made.astype({"width": "Int32", "height": "Int32"})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    return dealt_by_bytes(named, "size", ["path"]).mapInPandas(work, f"{schema}, content_hash string, width int, height int, error string")


def leaf_hashes(files: DataFrame, counter=None, piece: int = PIECE) -> DataFrame:
    """``(path, piece_no, digest, width, height, error)``: every piece of every file of
    ``(path, size)``, hashed behind a zero byte.  A file is as long as its row says; one that has
    become shorter is an error.  An empty file has one empty piece."""
    rest = F.greatest(F.col("size") - F.col("piece_no") * piece, F.lit(0))
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / piece), F.lit(1)).cast("long") - 1)
    pieces = files.select("path", "size", format_of("path").alias("format"), F.explode(numbers).alias("piece_no"))
    pieces = pieces.select("path", "format", "piece_no", F.least(rest, F.lit(piece)).cast("long").alias("length"))

    def work(batches):
        import hashlib

        for pdf in batches:
            out, total, begun = [], 0, 0
            for path, kind, number, length in zip(pdf["path"], pdf["format"], pdf["piece_no"], pdf["length"], strict=True):
                width = height = None
                begun += number == 0
                try:
                    digest, left = hashlib.sha256(b"\0"), int(length)
                    with open(path, "rb") as f:
                        if number == 0:
                            width, height = image_size(f, kind) or (None, None)
                        f.seek(int(number) * piece)
                        while left and (block := f.read(min(left, 1 << 20))):
                            digest.update(block)
                            left -= len(block)
                    total += int(length) - left
                    out.append((path, number, None if left else digest.hexdigest(), width, height, "shorter than listed" if left else None))
                except OSError as problem:
                    out.append((path, number, None, None, None, str(problem)))
            _counting(counter, int(begun), total)
            made = pd.DataFrame(out, columns=["path", "piece_no", "digest", "width", "height", "error"])
            yield made.astype({"piece_no": "int64", "width": "Int32", "height": "Int32"})

    spread = dealt_by_bytes(pieces, "length", ["path", "piece_no"])
    return spread.mapInPandas(work, "path string, piece_no bigint, digest string, width int, height int, error string")


def folded(leaves: DataFrame, key: str = "path", number: str = "piece_no", children: int = CHILDREN) -> DataFrame:
    """``(key, digest)``: digests numbered from 0 under each key, folded to one.  While a
    key has several, every run of ``children`` neighbours becomes the hash of a one byte and
    their bytes; a run may be shorter at the end.  A group never holds more than
    ``children`` rows, and only the largest number of digests reaches the driver."""
    nodes = leaves.select(F.col(key), F.col(number).alias("_no"), "digest")
    most = nodes.agg(F.max("_no")).first()[0]
    left = 0 if most is None else most + 1
    if left > 1:
        nodes = nodes.join(nodes.groupBy(key).agg((F.max("_no") + 1).alias("_n")), key)
    else:
        nodes = nodes.withColumn("_n", F.lit(1).cast("long"))
    while left > 1:
        run = F.array_sort(F.collect_list(F.struct("_no", "digest")))
        up = nodes.groupBy(key, "_n", F.expr(f"_no div {children}").alias("_no")).agg(run["digest"].alias("run"))
        parent = F.sha2(F.unhex(F.concat(F.lit("01"), F.array_join("run", ""))), 256)
        nodes = up.select(key, "_no", F.when(F.col("_n") > 1, parent).otherwise(F.col("run")[0]).alias("digest"), F.ceil(F.col("_n") / children).alias("_n"))
        left = -(-left // children)
    return nodes.select(key, "digest")


def tree_hashes(files: DataFrame, counter=None, piece: int = PIECE, children: int = CHILDREN) -> DataFrame:
    """``(path, content_hash, width, height, error)`` by ``sha256-tree``: pieces hashed
    wherever there is a free task, then folded file by file."""
    leaves = checkpointed(leaf_hashes(files, counter, piece))
    state = leaves.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("error").alias("error"))
    sound = leaves.join(state.where("error IS NOT NULL").select("path"), "path", "left_anti")
    hashes = folded(sound, children=children).withColumnRenamed("digest", "content_hash")
    return state.join(hashes, "path", "left").select("path", "content_hash", "width", "height", "error")
