"""A Merkle manifest of a dataset, with every leaf's proof found by pointer jumping.

Rows are leaves, ordered within their group; runs of three nodes become their parent
until one is left, the subroot.  Subroots, ordered by group, form the tree above.  Every
node starts with a pointer to its parent and the siblings of that step; a self-join then
replaces each pointer by that of the node it points to and joins the two segments, so
the distance doubles until all of them point to the root.  Leaves, to which nothing
points, take part in the last of these joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import discard, id_text, stored
from shoebox.operators.skew import with_position

RUN = 3
# the tree above the subroots
ABOVE = -1
DIGEST = 32
SEGMENT = "array<struct<left: binary, right: binary>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of values, each as ``-`` if null, else byte count, colon and text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _key(level: int, n: Column) -> Column:
    """Level of a node's key: the last node of a tree counts as level 0, whatever its height."""
    return F.when(n == 1, 0).otherwise(level)


def _siblings(children: Column, slot: Column) -> Column:
    """The other nodes of a run, before and after its member ``slot``."""
    left = F.substring(children, F.lit(1), slot * DIGEST)
    right = F.substring(children, (slot + 1) * DIGEST + 1, F.octet_length(children).cast("int"))
    return F.struct(left.alias("left"), right.alias("right"))


def _grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``nodes (tree, pos, n, digest)``, of trees with more than one node.
    ``n`` counts the nodes of a row's tree and level, ``children`` are a node's run."""
    levels = []
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        grouped = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {RUN}").alias("pos")).agg(run.alias("run"))
        joined = F.array_join(F.col("run.digest"), "")
        nodes = grouped.select(
            "tree", F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "pos", F.unhex(joined).alias("children"), F.sha2(joined, 256).alias("digest"),
        )
        nodes = stored(nodes, "merkle-level")
        levels.append(nodes)
        most = -(-most // RUN)
    return levels


def _steps(levels: list[DataFrame], lowest: int) -> list[DataFrame]:
    """From each level's runs, one step of the members that are nodes of level ``lowest`` or above."""
    steps = []
    for level, nodes in enumerate(levels, 1):
        if level <= lowest:
            continue
        members = F.posexplode(F.sequence(F.lit(0), (F.octet_length("children") / DIGEST).cast("int") - 1))
        each = nodes.select("*", members.alias("slot", "_"))
        # a member has company in its level, so its own key keeps the level
        steps.append(each.select(
            "tree", F.lit(level - 1).alias("level"), (F.col("pos") * RUN + F.col("slot")).alias("pos"),
            F.col("tree").alias("up_tree"), _key(level, F.col("n")).alias("up_level"), F.col("pos").alias("up_pos"),
            F.array(_siblings(F.col("children"), F.col("slot"))).cast(SEGMENT).alias("segment"),
        ))
    return steps


def _jump(nodes: DataFrame) -> DataFrame:
    """Doubles the distance of all pointers until none is left; ``segment`` then leads to the root."""
    nodes, distance = stored(nodes, "merkle-steps"), 1
    while not nodes.where("up_tree IS NOT NULL").isEmpty():
        # what a pointer of that distance can reach
        ahead = nodes.where((F.col("tree") == ABOVE) | (F.col("level") == 0) | (F.col("level") > distance)).select(
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"),
            F.struct("up_tree", "up_level", "up_pos").alias("next"), F.col("segment").alias("more"),
        )
        moved = nodes.where("up_tree IS NOT NULL").join(ahead, ["up_tree", "up_level", "up_pos"]).select(
            "tree", "level", "pos", "next.*", F.concat("segment", "more").alias("segment")
        )
        before, nodes = nodes, stored(moved.unionByName(nodes.where("up_tree IS NULL")), "merkle-steps")
        discard(before)
        distance *= 2
    return nodes


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row: ``doc_id, leaf, subroot, root, segment, tampered_leaf``.

    ``segment`` holds the siblings from leaf to root, one ``(left, right)`` of joined
    32-byte digests a level (both empty for a node alone in its run).  ``tampered``
    replaces fields by other columns of ``docs`` for ``tampered_leaf``.  Groups are ordered by their
    UTF-8 bytes, a null group first and one of its own; leaves by id (null first), then
    by digest, so wholly repeated rows stand side by side and may swap places, which
    changes no root.  Nulls count as ``-`` in a leaf, empty texts as ``0:``.  An empty
    table gives no rows; other columns are left out.
    """
    other = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(group).alias("group"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        leaf_digest([other[f] for f in fields]).alias("tampered_leaf"),
    )
    placed = with_position(rows, [F.asc("group"), F.asc("doc_id"), F.asc("leaf"), F.asc("tampered_leaf")], "at")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = with_position(groups, [F.asc("group")], "tree").withColumn("tree", F.col("tree") - 1)
    size = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    theirs = groups.withColumnRenamed("group", "g")
    leaves = placed.join(theirs, placed["group"].eqNullSafe(theirs["g"])).select(
        "doc_id", "leaf", "tampered_leaf", "tree", "n", (F.col("at") - F.col("first")).alias("pos")
    )
    leaves = stored(leaves, "merkle-leaves")

    nodes = leaves.select("tree", "pos", "n", F.col("leaf").alias("digest"))
    levels = _grow(nodes, size.most or 0)
    tops = nodes.where("n = 1").select("tree", "digest")
    for level in levels:
        tops = tops.unionByName(level.where("n = 1").select("tree", "digest"))
    tops = stored(tops, "merkle-tops")
    above = _grow(tops.select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size.trees).cast("long").alias("n"), "digest"), size.trees)
    # of all the digests the root alone comes to the driver
    last = above[-1] if above else tops
    root = last.first()
    root = root.digest if root else None

    none = F.lit(None)
    start = last.where(F.lit(True) if not above else F.col("n") == 1).select(
        "tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"), none.cast("long").alias("up_tree"), none.cast("int").alias("up_level"),
        none.cast("long").alias("up_pos"), F.array().cast(SEGMENT).alias("segment"),
    )
    for step in _steps(levels, 1):
        start = start.unionByName(step)
    for level, step in enumerate(_steps(above, 0)):
        if level == 0:
            # members of the lowest runs are the subroots
            step = step.select(F.col("pos").alias("tree"), "level", F.lit(0).cast("long").alias("pos"), "up_tree", "up_level", "up_pos", "segment")
        start = start.unionByName(step)
    reached = _jump(start)

    ends = reached.where("tree >= 0 AND level <= 1").select("tree", "level", "pos", "segment")
    if levels:
        runs = levels[0].select("tree", _key(1, F.col("n")).alias("level"), "pos", "children")
        ends = ends.join(runs, ["tree", "level", "pos"], "left")
    else:
        ends = ends.withColumn("children", none.cast("binary"))
    ends = ends.join(tops.withColumnRenamed("digest", "subroot"), "tree")
    few = F.col("n") <= RUN
    up = F.expr(f"pos div {RUN}")
    pointed = leaves.select(
        "doc_id", "leaf", "tampered_leaf", "tree", F.when(few, 0).otherwise(1).alias("level"), F.when(few, 0).otherwise(up).alias("pos"),
        F.when(F.col("n") > 1, (F.col("pos") % RUN).cast("int")).alias("slot"),
    )
    found = pointed.join(ends, ["tree", "level", "pos"])
    first = F.array(_siblings(F.col("children"), F.col("slot"))).cast(SEGMENT)
    segment = F.when(F.col("slot").isNull(), F.col("segment")).otherwise(F.concat(first, F.col("segment")))
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), segment.alias("segment"), "tampered_leaf")


def folded(leaf: Column, segment: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(segment, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def proof_digest(segment: Column) -> Column:
    """SHA-256 of a proof's digests in order."""
    return F.sha2(F.array_join(F.transform(segment, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def without_line_feeds(doc_id: str, text: str) -> Column:
    """The tampering the query tries out: half of the rows, by checksum of the id (a null id counts as empty text)."""
    half = F.crc32(F.encode(id_text(doc_id), "UTF-8")) % 2 == 0
    return F.when(half, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
