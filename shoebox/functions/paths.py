"""Path expressions.  All stay JVM-side; none shuffles."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file types the catalogue admits.
SUPPORTED_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "avif")
HEIF_EXTENSIONS = ("heif", "heic")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path) -> Column:
    """Directory part; the parent of ``/a`` is ``/``, of a bare name the empty string."""
    path = _col(path)
    cut = F.substr(path, F.lit(1), F.length(path) - F.length(file_name(path)) - 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit("")).when(cut == "", F.lit("/")).otherwise(cut)


def extension(path) -> Column:
    """Lower-cased extension, empty when there is none (a leading dot starts a name)."""
    name = file_name(path)
    has_one = F.contains(F.substr(name, F.lit(2)), F.lit("."))
    return F.when(has_one, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def is_supported(path, heif: bool = False) -> Column:
    return extension(path).isin(*SUPPORTED_EXTENSIONS, *(HEIF_EXTENSIONS if heif else ()))


def normalize(path) -> Column:
    """Drop doubled separators, ``.`` components and a trailing separator."""
    collapsed = F.regexp_replace(_col(path), r"/(\.?/)+", "/")
    return F.regexp_replace(collapsed, r"(.)/\.?$", "$1")


def clean(path: str) -> str:
    """What ``normalize`` does, for a path that came from the driver."""
    collapsed = re.sub(r"/(?:\.?/)+", "/", path)
    return re.sub(r"(.)/\.?$", r"\1", collapsed)


def is_under(path, root) -> Column:
    """Component-wise prefix test: the root itself or anything below it."""
    path, root = _col(path), _col(root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/"))) | (
        (root == "/") & F.startswith(path, F.lit("/"))
    )


def relative_to(path, root) -> Column:
    """``path`` without the leading ``root/``; empty for the root itself."""
    path, root = _col(path), _col(root)
    skip = F.when(root == "/", F.lit(2)).otherwise(F.length(root) + 2)
    return F.substr(path, skip)


def ancestor_paths(path) -> Column:
    """Every prefix of an absolute path, shortest first, the path itself last."""
    parts = F.split(_col(path), "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def _matches(path: Column, pattern: Column, subtree: bool) -> Column:
    exact = normalize(pattern)
    absolute = is_under(path, exact) if subtree else path == exact
    return F.when(F.startswith(pattern, F.lit("/")), absolute).otherwise(F.contains(path, pattern))


def matches_any(path, patterns, subtree: bool = False) -> Column:
    """Does any pattern hit ``path``?

    An absolute pattern names one exact path, anything else is a substring.
    ``patterns`` is a Python list (unrolled into plain predicates, which stay in
    generated code) or an array column.
    """
    path = _col(path)
    if isinstance(patterns, (list, tuple)):
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | _matches(path, F.lit(pattern), subtree)
        return hit
    return F.exists(_col(patterns), lambda p: _matches(path, p, subtree))


def is_excluded(path, exclude) -> Column:
    return matches_any(path, exclude)


def is_included(path, include, mode: str = "strict") -> Column:
    """An empty list admits everything.  ``mode='subtree'`` lets an absolute
    pattern admit what lies below it as well."""
    hit = matches_any(path, include, subtree=mode == "subtree")
    if isinstance(include, (list, tuple)):
        return hit if include else F.lit(True)
    return (F.size(_col(include)) == 0) | hit


def is_admitted(path, exclude, include, mode: str = "strict") -> Column:
    """Exclusion beats inclusion."""
    return ~is_excluded(path, exclude) & is_included(path, include, mode)


def _rejected_at_or_above(path: Column, root: Column, pattern: Column) -> Column:
    """Does an exclude pattern hit the path or a directory between it and the
    root?  What a directory contains as a substring its descendants contain too,
    and an exact hit on a directory means the path lies below it, so the path
    alone decides."""
    exact = normalize(pattern)
    below = is_under(path, exact) & (F.length(exact) > F.length(root))
    return F.when(F.startswith(pattern, F.lit("/")), below).otherwise(F.contains(path, pattern))


def _child(path: Column, root: Column) -> Column:
    """The path one level below ``root`` on the way to ``path``."""
    prefix = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    return F.concat(prefix, F.substring_index(relative_to(path, root), "/", 1))


def _admitted_below(path: Column, root: Column, include) -> Column:
    """Is every step from the root to the path included?  A substring found at one step is
    found at all later ones, so the steps before it are exact patterns: it is enough to
    look one level below the root and below each exact pattern that is itself admitted."""
    anywhere = [p for p in include if not p.startswith("/")]
    stations = [(root, F.lit(True))]
    admitted = F.lit(False)
    # a pattern is longer than those above it
    for exact in [None, *sorted({clean(p) for p in include if p.startswith("/")}, key=len)]:
        if exact is not None:
            here = F.lit(exact)
            reached = F.lit(False)
            for above, open_ in stations:
                step = _child(here, above)
                beside = is_under(here, above) & (here != above)
                reached = reached | (open_ & beside & ((step == here) | matches_any(step, anywhere)))
            stations.append((here, reached))
            admitted = admitted | (reached & (path == here))
        station, open_ = stations[-1]
        admitted = admitted | (open_ & is_under(path, station) & (path != station) & matches_any(_child(path, station), anywhere))
    return admitted


def survives_pruning(path, root, exclude, include, mode: str = "strict") -> Column:
    """True when neither the path nor any directory between it and the root is
    rejected.  The root itself is always admitted.  Works on a flat listing with
    no join and, but for include lists held in columns, without looking at the
    directories one by one."""
    path, root = _col(path), _col(root)
    unrolled = isinstance(exclude, (list, tuple))
    if unrolled:
        rejected = F.lit(False)
        for pattern in exclude:
            rejected = rejected | _rejected_at_or_above(path, root, F.lit(pattern))
    else:
        rejected = F.exists(_col(exclude), lambda p: _rejected_at_or_above(path, root, p))
    if isinstance(include, (list, tuple)) and not include:
        return (path == root) | ~rejected
    if mode == "subtree":
        # admitted at the first level means admitted all the way down
        admitted = is_included(_child(path, root), include, mode)
    elif isinstance(include, (list, tuple)):
        admitted = _admitted_below(path, root, include)
    else:
        below = F.filter(ancestor_paths(path), lambda p: F.length(p) > F.length(root))
        admitted = F.forall(below, lambda p: is_included(p, include, mode))
    return (path == root) | (~rejected & admitted)


def within_depth(path, root, recursive) -> Column:
    """A non-recursive import sees only the entries directly in its root."""
    recursive = F.lit(recursive) if isinstance(recursive, bool) else recursive
    return recursive | (parent_dir(path) == _col(root)) | (_col(path) == _col(root))


def longest_rule(path, rules: Iterable[tuple[int, str]]) -> Column:
    """``rule_no`` of the longest import root above ``path``; a tie goes to the
    later rule, no match gives null.

    For a handful of configured rules and many paths: one narrow projection in
    generated code, no join.  ``operators.changes.match_rules`` is the form for
    rules held in a table.
    """
    path = _col(path)
    choice = F.lit(None).cast("int")
    for rule_no, root in sorted(((n, clean(r)) for n, r in rules), key=lambda r: (len(r[1]), r[0])):
        hit = F.lit(True) if root == "" else is_under(path, F.lit(root))
        choice = F.when(hit, F.lit(rule_no)).otherwise(choice)
    return choice
