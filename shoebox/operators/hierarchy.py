"""Folder tree: closure, roots, visibility, listing, inheritance, derivation.

A folder's parent is the folder of its parent directory, or none for an import
root.  The closure therefore comes from the path prefixes in one equi-join, cut
at the nearest root, with no iteration and no depth limit.  ``closure_recursive``
follows ``parent_id`` literally for tables that break that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators.skew import lookup_join
from shoebox.session import checkpointed


def closure(folders: DataFrame) -> DataFrame:
    """``(ancestor_id, folder_id, depth)``, every folder paired with itself at depth 0.

    The path of an import root is a prefix of every folder below it, hence the
    hot-key join.  The window groups are bounded by the depth of a path.
    """
    return _climbing(folders, folders)


def _climbing(some: DataFrame, folders: DataFrame) -> DataFrame:
    """The closure's rows of ``some`` of the folders."""
    prefixes = F.posexplode(F.reverse(paths.ancestor_paths("path"))).alias("depth", "path")
    up = some.select(F.col("id").alias("folder_id"), prefixes)
    lookup = folders.select("path", F.col("id").alias("ancestor_id"), F.col("parent_id").isNull().alias("is_root"))
    pairs = lookup_join(up, lookup, "path", "inner", ["folder_id"])
    nearest_root = F.min(F.when(F.col("is_root"), F.col("depth"))).over(Window.partitionBy("folder_id"))
    return (
        pairs.withColumn("_cut", nearest_root)
        .where(F.col("_cut").isNull() | (F.col("depth") <= F.col("_cut")))
        .select("ancestor_id", "folder_id", F.col("depth").cast("int").alias("depth"))
    )


def closure_after(tree: DataFrame, folders: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The closure ``tree`` brought up to date with a change of folders.

    ``gone`` and ``new`` are the folder rows that left and came (a row that changes its
    path or parent is in both), ``folders`` the table as it is now.  Only folders at or below
    a path that changed climb anew; the rest of the table is read for its paths and of the
    old closure what they had is dropped, without a shuffle while the change is small.
    """
    changed = gone.select("path").unionByName(new.select("path")).distinct()
    below = folders.select("id", F.explode(paths.ancestor_paths("path")).alias("path")).join(changed, "path", "left_semi")
    below = below.select("id").distinct()
    stale = below.unionByName(gone.select("id")).select(F.col("id").alias("folder_id")).distinct()
    moved = folders.join(below, "id", "left_semi")
    return tree.join(stale, "folder_id", "left_anti").select(*tree.columns).unionByName(_climbing(moved, folders).select(*tree.columns))


def climbed(folders: DataFrame) -> DataFrame:
    """``(folder_id, root_id, depth)`` by following ``parent_id``, however deep the tree.

    Every round a folder's pointer becomes that of the folder it points to, so a chain of
    n folders takes about log2(n) rounds; folders whose pointer has reached a root rest.  A
    parent that does not exist gives a null root, and a cycle fails with the name of a folder on
    or below it.  Rounds are written to the shared checkpoint folder.
    """
    root = F.col("parent_id").isNull()
    start = folders.select(
        F.col("id").alias("folder_id"), F.coalesce("parent_id", "id").alias("at"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done"),
    )
    state, reach, n = checkpointed(start), 1, folders.count()
    while True:
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            return state.select("folder_id", F.col("at").alias("root_id"), "depth")
        if reach > 2 * n:
            looped = folders.join(open_.select(F.col("folder_id").alias("id")), "id", "left_semi").agg(F.min("path")).first()[0]
            raise ValueError(f"the parents of {looped} form a cycle")
        ahead = state.select(F.col("folder_id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = open_.join(ahead, "at", "left").select(
            "folder_id", F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done"),
        )
        state = checkpointed(moved.unionByName(state.where("done")))
        reach *= 2


def closure_recursive(folders: DataFrame) -> DataFrame:
    """The same relation by following ``parent_id``, whatever its size and depth.

    The recursion's rows are made by doubling: what is known up to some depth, joined to
    the ancestor at that depth, gives the rows up to twice of it, each of them once.  Rounds are
    written to the shared checkpoint folder, and no limit on levels or rows applies.  A
    parent that does not exist is an ancestor without any of its own; a parent cycle fails as soon
    as a folder turns up as its own ancestor.
    """
    found = folders.select(F.col("id").alias("ancestor_id"), F.col("id").alias("folder_id"), F.lit(0).alias("depth"))
    # the ancestor that stands ``reach`` levels up
    jump = checkpointed(folders.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("folder_id"), F.col("parent_id").alias("at")))
    reach = 1
    while not jump.isEmpty():
        above = found.select(F.col("folder_id").alias("at"), "ancestor_id", F.col("depth").alias("_depth"))
        # a hot ancestor's folders are on the left, where they may be split
        further = checkpointed(jump.join(above, "at", "left").select(
            F.coalesce("ancestor_id", "at").alias("ancestor_id"), "folder_id", (F.coalesce("_depth", F.lit(0)) + reach).cast("int").alias("depth"),
        ))
        looped = further.where("ancestor_id = folder_id").agg(F.min("folder_id")).first()[0]
        if looped is not None:
            raise ValueError(f"RECURSION without end: the parents of folder {looped} form a cycle")
        found = found.unionByName(further)
        jump = checkpointed(jump.join(jump.select(F.col("folder_id").alias("at"), F.col("at").alias("_at")), "at").select("folder_id", F.col("_at").alias("at")))
        reach *= 2
    return found


def subtree(tree: DataFrame, root_id: int) -> DataFrame:
    """Ids of a folder and everything below it.

    ``tree`` is a closure, which is then just filtered, or the folder table
    itself: folders below the root's path, less those that belong to an import
    nested there.  The second form reads two columns once and is the one to use
    for a single folder; the root's path is a scalar subquery, not a join.
    """
    root = F.lit(root_id).cast("bigint")
    if "ancestor_id" in tree.columns:
        return tree.where(F.col("ancestor_id") == root).select(F.col("folder_id").alias("id"))
    top = tree.where(F.col("id") == root).select("path").scalar()
    below = F.startswith(F.col("path"), F.concat(top, F.lit("/")))
    inside = tree.where((F.col("id") == root) | below).select("id", "parent_id", "path")
    nested = inside.where(F.col("parent_id").isNull() & (F.col("id") != root)).select("path")
    climbs = inside.where(F.col("id") != root).select("id", F.explode(paths.ancestor_paths("path")).alias("path"))
    foreign = climbs.join(nested, "path", "left_semi").select("id")
    return inside.join(foreign, "id", "left_anti").select("id")


def roots(tree: DataFrame) -> DataFrame:
    """``(folder_id, root_id)``: the top of each folder's chain."""
    return tree.groupBy("folder_id").agg(F.max_by("ancestor_id", "depth").alias("root_id"))


def hide_unreachable(folders: DataFrame, tree: DataFrame, reachable_roots: DataFrame) -> DataFrame:
    """Folders whose root is among ``reachable_roots(root_id)``.

    A folder's root is in its own closure rows, so reachability is settled there
    and no join runs on the root id, which whole imports share.
    """
    reached = tree.join(
        reachable_roots.select(F.col("root_id").alias("ancestor_id")), "ancestor_id", "left_semi"
    ).select(F.col("folder_id").alias("id"))
    return folders.join(reached, "id", "left_semi")


def name_filter(folders: DataFrame, tree: DataFrame, text: str) -> DataFrame:
    """Folders whose own name, or the name of a folder below, contains ``text``
    in any case; an empty text keeps all."""
    if text == "":
        return folders
    named = folders.where(F.contains(F.lower(paths.file_name("path")), F.lower(F.lit(text))))
    hits = named.select(F.col("id").alias("folder_id"))
    visible = tree.join(hits, "folder_id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
    return folders.join(visible, "id", "left_semi")


def with_root(folders: DataFrame, tree: DataFrame, *root_columns) -> DataFrame:
    """Each folder with its root's id and the given expressions of the root row."""
    info = folders.where(F.col("parent_id").isNull()).select(F.col("id").alias("ancestor_id"), *root_columns)
    # the closure is the left side: where one root owns most folders its rows
    # may be split, and few roots are simply broadcast once their size is known
    above = tree.join(info, "ancestor_id").withColumnsRenamed({"ancestor_id": "root_id", "folder_id": "id"}).drop("depth")
    return folders.join(above, "id")


def tree_order(folders: DataFrame, tree: DataFrame, flattened_roots: DataFrame | None = None) -> DataFrame:
    """Folders with ``depth`` and a ``sort_key`` that puts them in depth-first
    order, siblings by lower-cased name.  Roots named in
    ``flattened_roots(path)`` show no children.

    The key is the list of names from the root down, each followed by its full
    path so that equal names neither mix their children nor tie.
    """
    placed = with_root(folders, tree, F.col("path").alias("root_path"))
    chain = F.filter(paths.ancestor_paths("path"), lambda p: F.length(p) >= F.length("root_path"))
    ordered = placed.withColumn("depth", F.size(chain) - 1).withColumn(
        "sort_key",
        F.transform(chain, lambda p: F.concat(F.lower(paths.file_name(p)), F.lit("\u0001"), p)),
    )
    if flattened_roots is None:
        return ordered
    flat = flattened_roots.select(F.col("path").alias("root_path")).distinct().withColumn("_flat", F.lit(True))
    hidden = ordered.join(flat, "root_path", "left")
    return hidden.where((F.col("depth") == 0) | F.col("_flat").isNull()).drop("_flat")


def inherited_settings(folders: DataFrame) -> DataFrame:
    """Thumbnail policy of each folder, taken from the root nearest above it, with defaults.

    A folder looks its own path prefixes up among the root rows, of which there are as
    many as imports; no closure is built.  Folders stand on the left, where a root that
    owns most of them may be split."""
    policy = F.struct(
        F.col("id").alias("root_id"), F.col("path").alias("root_path"),
        F.coalesce("thumbnail_cache_mode", F.lit("global")).alias("cache_mode"),
        F.coalesce("thumbnail_cache_folder", F.lit("")).alias("cache_folder"),
        F.col("thumbnail_cache_fallback").alias("cache_fallback"),
    )
    tops = folders.where(F.col("parent_id").isNull()).select("path", policy.alias("_policy"))
    climbs = folders.select(F.col("id").alias("folder_id"), F.explode(paths.ancestor_paths("path")).alias("path"))
    nearest = F.max_by("_policy", F.length("path"))
    return climbs.join(tops, "path").groupBy("folder_id").agg(nearest.alias("_p")).select("folder_id", "_p.*")


def _literal(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def directories_of(listing: DataFrame, root: str | Column, *carried: str) -> DataFrame:
    """Distinct directories below ``root``: those listed, and every directory on
    the way down to a listed file.  Files collapse to their directory before any
    prefix is produced.  ``root`` may be a column, kept together with ``carried``."""
    holder = F.when(F.col("is_dir"), F.col("path")).otherwise(paths.parent_dir("path"))
    held = listing.select(holder.alias("path"), *carried).distinct()
    below = F.filter(paths.ancestor_paths("path"), lambda p: F.length(p) > F.length(_literal(root)))
    inside = held.where(paths.is_under("path", _literal(root)))
    return inside.select(F.explode(below).alias("_path"), *carried).distinct().withColumnRenamed("_path", "path")


FOLDER_SETTINGS = {
    "exclude": "array<string>", "include": "array<string>", "thumbnail_cache_mode": "string",
    "thumbnail_cache_folder": "string", "thumbnail_cache_fallback": "string",
}


def derive_folders(
    directories: DataFrame, folders: DataFrame, now: Column, scan_complete: bool = False, **settings: Column | None
) -> DataFrame:
    """Rows for directories that have no folder yet.

    A new id is the hash of the path, so a parent that is itself new needs no
    lookup; only existing parents are joined.  Children are non-recursive; their
    lists and thumbnail policy are given as literals or as columns of
    ``directories``.
    """
    known = folders.select("path", F.col("id").alias("known_id"))
    given = {**{n: None for n in FOLDER_SETTINGS}, "thumbnail_cache_fallback": F.lit("disable")} | settings
    given = {n: (F.lit(None) if c is None else c).cast(FOLDER_SETTINGS[n]) for n, c in given.items()}
    empty = F.array().cast("array<string>")
    given |= {n: F.coalesce(given[n], empty) for n in ("exclude", "include")}
    fresh = directories.join(known, "path", "left_anti")
    child = fresh.select(
        F.col("path").alias("child_path"), paths.parent_dir("path").alias("path"), *[c.alias(n) for n, c in given.items()]
    )
    placed = child.join(known, "path", "left")
    return placed.select(
        F.xxhash64("child_path").alias("id"),
        F.coalesce("known_id", F.xxhash64("path")).alias("parent_id"),
        F.col("child_path").alias("path"),
        F.lit(False).alias("recursive"),
        F.lit(scan_complete).alias("scan_complete"),
        *FOLDER_SETTINGS,
        now.alias("created_at"),
    )


def set_scan_state(folders: DataFrame, ids: DataFrame, complete: bool) -> DataFrame:
    """Folders with ``scan_complete`` set for every id in ``ids(id)``."""
    touched = ids.select("id").distinct().withColumn("_touched", F.lit(True))
    return (
        folders.join(touched, "id", "left")
        .withColumn("scan_complete", F.when(F.col("_touched"), F.lit(complete)).otherwise(F.col("scan_complete")))
        .drop("_touched")
        .select(*folders.columns)
    )


def complete_directories(folders: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """After a finished scan: the root and every directory it walked are complete."""
    walked = directories_of(listing, root)
    done = folders.where(F.col("path") == root).select("id").unionByName(
        folders.join(walked, "path", "left_semi").select("id")
    )
    return set_scan_state(folders, done, True)


def prune_complete(listing: DataFrame, folders: DataFrame, tree: DataFrame, root_id: int, root: str) -> DataFrame:
    """Drop what lies in a completed subfolder of the root, and the subfolder
    itself; the root never counts.

    Directories, not files, are tested against their ancestors: the listing
    collapses to its directories first.
    """
    scoped = subtree(tree, root_id).where(F.col("id") != root_id)
    complete = folders.where("scan_complete").join(scoped, "id", "left_semi").select("path")
    holder = F.when(F.col("is_dir"), F.col("path")).otherwise(paths.parent_dir("path"))
    held = listing.select(holder.alias("_dir")).distinct()
    below = F.filter(paths.ancestor_paths("_dir"), lambda p: F.length(p) > len(root))
    climbs = held.select("_dir", F.explode(below).alias("path"))
    pruned = climbs.join(complete, "path", "left_semi").select("_dir").distinct()
    return listing.withColumn("_dir", holder).join(pruned, "_dir", "left_anti").drop("_dir")
