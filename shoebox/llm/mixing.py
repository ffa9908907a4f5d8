"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, each source gets a share of the wanted total by weight,
no more than ``most`` times what it has, and the excess goes to the others.  A
document is then taken floor(rate) times, and once more by a draw from its id with the
fraction as probability.  Decisions depend on the row and its source's sum only, so
reruns and repeated tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, id_text, stored
from shoebox.operators.skew import with_position

BETWEEN = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def size_of(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")).cast("long")


def draw(doc_id: str, seed: int = 42) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of a digest."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), id_text(doc_id)), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Each round gives
    the sources below their limit what the others leave, by weight, and stops those that
    came above it; only three sums a round reach the driver, and a round without a new
    stop is the last.
    """
    ordered = with_position(sums, [F.col("source").isNull(), F.col("source")], "_at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    table = stored(ordered.select("source", "source_size", weight.alias("_w"), limit.alias("_limit")), "mix-sources")
    wanted = float(total) * (table.agg(F.sum("source_size")).first()[0] or 0)
    per_weight = 0.0
    stopped = F.lit(False)
    count = -1
    while True:
        row = table.agg(
            F.sum(F.when(stopped, F.col("_limit")).otherwise(0.0)).alias("spent"),
            F.sum(F.when(stopped, 0).otherwise(F.col("_w"))).alias("weight"), F.count_if(stopped).alias("n"),
        ).first()
        if row.n == count or not row.weight:
            break
        count = row.n
        per_weight = (wanted - row.spent) / row.weight
        stopped = F.col("_w") * F.lit(per_weight) > F.col("_limit")
    target = F.least(F.col("_w") * F.lit(per_weight), F.col("_limit"))
    return table.select("source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    total: float = 1.5, most: float = 2.0, seed: int = 42, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of every row with ``size, source_size, target, n_copies``.

    Null and empty texts have size 0 and change no sum; a source of size 0 has target 0
    and its rows are not taken.  Null is a source like any other.  Rows that repeat an id
    share its draw.
    """
    keep = docs.columns if keep is None else keep
    # working columns get names that none of the kept ones has
    size, src, rate = (fresh(keep, n) for n in ("size", "_source", "_rate"))
    rows = docs.select(*keep, size_of(text).alias(size), F.col(source).alias(src), draw(doc_id, seed).alias(fresh(keep, "_draw")))
    sums = rows.groupBy(F.col(src).alias("source")).agg(F.sum(size).alias("source_size"))
    shares = targets(stored(sums, "mix-sums"), weights, total, most)
    shares = shares.select(
        F.col("source").alias("_s"), F.col("source_size").alias(fresh(keep, "source_size")), F.col("target").alias(fresh(keep, "target")),
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias(rate),
    ).withColumnRenamed("_s", fresh(rows.columns, "_s"))
    # the large table stays on the left, where a hot source may be split
    joined = rows.join(shares, F.col(src).eqNullSafe(F.col(shares.columns[0])), "left")
    whole = F.floor(rate)
    extra = F.when(F.col(fresh(keep, "_draw")) < F.col(rate) - whole, 1).otherwise(0)
    return joined.select(*keep, size, *shares.columns[1:3], (whole + extra).cast("int").alias(fresh(keep, "n_copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken."""
    planned = copies(docs, **options)
    n = planned.columns[-1]
    spread = planned.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return spread.select(*docs.columns)
