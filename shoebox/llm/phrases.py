"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Every test window (ten consecutive words of an item) is looked up from its rarest
terms: corpus frequencies of all test terms are counted first, then postings
(term, document, position) of the two rarest terms of each window are stored, and the
two lists, shifted by the terms' offsets, are intersected.  Postings of rarest terms
carry the words around them, from which a match is confirmed word for word, or a
proximity match is scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what stands between words, stated for text that is not lower-cased yet
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    # splitting costs a tenth of extracting the words
    return F.array_remove(F.split(text, BETWEEN), "")


def exact(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = 10) -> DataFrame:
    """``(item_id, window, n)``: every run of ``length`` words as one string, or all words
    of an item that has fewer.  Items that are null or have no words give none."""
    split = items.select(F.col(item_id).alias("item_id"), words(text).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - length + 1, F.lit(1)))
    runs = split.select("item_id", "_w", F.explode(starts).alias("_i")).select("item_id", F.slice("_w", F.col("_i"), length).alias("_w"))
    return runs.select("item_id", exact(F.concat_ws(" ", "_w")).alias("window"), F.size("_w").alias("n")).distinct()


def _filter_of(terms: DataFrame, column: str, tested: Column | str = "term") -> Column:
    """A test whether ``tested`` may be one of ``terms``."""
    return _bitmap(terms, column)(tested)


def _bitmap(terms: DataFrame, column: str, most_bits: int = 1 << 20) -> Callable[[Column | str], Column]:
    """A test whether a value may be one of ``terms``, as a literal bitmap: one bit per
    hash, about 32 bits per term and never more than ``most_bits``, whatever the number
    of terms.  It lets through all of them and some others."""
    bits = 1 << 12
    wanted = 32 * terms.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    # at most most_bits / 64 rows
    filled = terms.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    ).collect()
    cells = ["0"] * (bits // 64)
    for row in filled:
        cells[row.w] = str(row.bits)
    table = F.split(F.lit(",".join(cells)), ",").cast("array<bigint>")

    def test(tested: Column | str) -> Column:
        at = F.pmod(F.xxhash64(tested), F.lit(bits))
        return F.getbit(F.element_at(table, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows under a key of id and text, so that repeated ids with other texts stay apart."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text, F.col(doc_id).isNull()).alias("print"), F.col(text).alias("text")
    )


def _tokens(rows: DataFrame, *extra: Column) -> DataFrame:
    split = rows.select("doc_id", "print", words("text").alias("_w"))
    spread = split.select("doc_id", "print", F.posexplode("_w").alias("pos", "word"), *extra)
    # folding more than A-Z here only lets more through: matches are confirmed exactly
    return spread.withColumn("term", F.lower("word"))


def frequencies(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each of ``terms`` (column ``term``) occurs in all documents."""
    tokens = _tokens(_documents(docs, doc_id, text)).where(_filter_of(terms, "term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).join(terms, "term", "left_semi")


def neighbours(distinct: DataFrame) -> DataFrame:
    """``(pair)``: words that stand side by side in a window, joined by a blank; of a window
    of one word, that word before a blank."""
    split = F.split(F.lower("window"), " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)))
    pairs = distinct.select(split.alias("w")).select("w", F.explode(starts).alias("i"))
    return pairs.select(F.concat(F.get("w", F.col("i")), F.lit(" "), F.coalesce(F.get("w", F.col("i") + 1), F.lit(""))).alias("pair")).distinct()


def index(
    docs: DataFrame, anchors: DataFrame, others: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 10, pairs: DataFrame | None = None,
) -> DataFrame:
    """Postings ``(term, doc_id, print, pos, left, around)`` of the terms asked for, written
    to the shared folder.  ``around`` (anchors only) holds the ``length - 1`` words on
    either side, ``left`` how many stand before the term.  With ``pairs``, as from
    ``neighbours``, for exact phrases, a term counts only where it makes a pair
    with the word before or after it: wherever a phrase occurs, all its terms do."""
    split = _documents(docs, doc_id, text).select("doc_id", "print", words("text").alias("_w"))
    spread = split.select("doc_id", "print", "_w", F.posexplode("_w").alias("pos", "word")).withColumn("term", F.lower("word"))
    asked = anchors.union(others).distinct()
    wanted = spread.where(_filter_of(asked, "term"))
    if pairs is not None:
        known = _bitmap(stored(pairs, "window-pairs"), "pair")
        beside = lambda a, b: F.concat(a, F.lit(" "), F.lower(b))
        before, after = F.get("_w", F.col("pos") - 1), F.get("_w", F.col("pos") + 1)
        made = [beside(F.lower(before), F.col("word")), beside(F.col("term"), after), F.concat("term", F.lit(" "))]
        wanted = wanted.where(F.coalesce(*[F.when(known(m), True) for m in made], F.lit(False)))
    left = F.least(F.col("pos"), F.lit(length - 1))
    around = F.when(_filter_of(anchors, "term"), F.slice("_w", F.col("pos") - left + 1, left + length))
    return stored(wanted.select("term", "doc_id", "print", "pos", left.alias("left"), around.alias("around")), "postings")


def _plan(docs: DataFrame, items: DataFrame, doc_id: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct windows with their two rarest terms and offsets, what items they belong
    to, and the postings of those terms."""
    owned = stored(windows(items, "item_id", "text", length), "windows")
    distinct = owned.select("window", "n").distinct()
    terms = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    terms = stored(terms.select("window", "n", "offset", F.lower("word").alias("term")), "window-terms")
    freq = stored(frequencies(docs, terms.select("term").distinct(), doc_id, text), "term-frequencies")
    # a window with a term that occurs nowhere occurs nowhere
    known = terms.join(freq, "term").groupBy("window", "n").agg(
        F.sort_array(F.collect_list(F.struct("freq", "offset", "term"))).alias("by"), F.count(F.lit(1)).alias("known")
    ).where("known = n")
    second = F.element_at("by", F.least(F.lit(2), F.size("by")))
    plan = known.select(
        "window", "n", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["offset"].alias("offset"),
        second["term"].alias("term2"), second["offset"].alias("offset2"), F.xxhash64("window").alias("win"),
    )
    plan = stored(plan, "window-plan")
    seconds = plan.select(F.col("term2").alias("term")).distinct()
    postings = index(docs, plan.select("term").distinct(), seconds, doc_id, text, length, neighbours(plan))
    return plan, owned, postings


def _matches(plan: DataFrame, postings: DataFrame) -> DataFrame:
    anchors = postings.where("around is not null")
    starts = anchors.join(plan, "term").where("pos >= offset").withColumn("start", F.col("pos") - F.col("offset"))
    # a list shifted by its term's offset names the same start as the other one
    slim = starts.select("doc_id", "print", "pos", "term", "win", "start", "term2", (F.col("start") + F.col("offset2")).alias("pos2"))
    other = postings.select(F.col("doc_id").alias("d2"), F.col("print").alias("print"), F.col("pos").alias("pos2"), F.col("term").alias("term2"))
    met = slim.join(other, ["print", "pos2", "term2"]).where("doc_id <=> d2").select("doc_id", "print", "pos", "term", "win", "start").distinct()
    held = met.join(anchors.withColumnRenamed("doc_id", "d2"), ["print", "pos", "term"]).where("doc_id <=> d2")
    both = held.join(plan.select("win", "window", "n", "offset"), "win")
    phrase = exact(F.concat_ws(" ", F.slice("around", F.col("left") - F.col("offset") + 1, F.col("n"))))
    return both.where(phrase == F.col("window")).select("doc_id", "print", "start", "n", "window").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 10) -> DataFrame:
    """``(doc_id, print, start, n, window)``: every place (word number, from 0) at which a
    window of an item occurs word for word.  ``print`` tells texts of a repeated id apart;
    identical rows share their matches."""
    plan, _, postings = _plan(docs, items, doc_id, text, length)
    return _matches(plan, postings)


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 10) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs."""
    hit = stored(phrase_matches(docs, items, doc_id, text, length).select("doc_id", "print").distinct(), "contaminated")
    print_, id_ = fresh(docs.columns, "_print"), fresh(docs.columns, "_id")
    hit = hit.select(F.col("doc_id").alias(id_), F.col("print").alias(print_))
    here = F.xxhash64(docs[text], docs[doc_id].isNull())
    return docs.join(hit, (here == hit[print_]) & docs[doc_id].eqNullSafe(hit[id_]), "left_anti")


def proximity_matches(docs: DataFrame, items: DataFrame, share: float = 0.8, doc_id: str = "doc_id", text: str = "text", length: int = 10) -> DataFrame:
    """``(doc_id, print, pos, window, share)``: places where one of the window's anchors
    stands among at least ``share`` of its distinct terms, in any order, within the words
    ``index`` keeps around it.  Anchors are the k + 1 rarest terms that occur at all, where
    ``share`` lets k be missing: whatever is missing, one of them is there."""
    owned = stored(windows(items, "item_id", "text", length), "windows")
    asked = F.array_distinct(F.split("window", " "))
    distinct = owned.select("window").distinct()
    terms = stored(distinct.select("window", F.explode(asked).alias("word")).select("window", F.lower("word").alias("term")).distinct(), "window-terms")
    freq = stored(frequencies(docs, terms.select("term").distinct(), doc_id, text), "term-frequencies")
    by = terms.join(freq, "term").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("freq", "term"))).alias("by"))
    missing = F.size(F.filter(F.sequence(F.lit(1), F.size(asked)), lambda m: (F.size(asked) - m) / F.size(asked) >= share))
    anchors = by.select("window", F.explode(F.slice("by", F.lit(1), missing + 1)).alias("anchor"))
    plan = stored(anchors.select("window", F.col("anchor.term").alias("term")), "window-anchors")
    wanted = plan.select("term").distinct()
    near = index(docs, wanted, wanted, doc_id, text, length).where("around is not null").join(plan, "term")
    there = F.array_intersect(asked, F.split(exact(F.concat_ws(" ", "around")), " "))
    scored = near.withColumn("share", F.size(there) / F.size(asked))
    return scored.where(F.col("share") >= share).select("doc_id", "print", "pos", "window", "share").distinct()


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 10) -> DataFrame:
    """One row per input row: ``doc_id, print, n_words, n_hit, n_items, items_sha256,
    contaminated``.

    Null and empty texts have no words.  Repeated rows get equal results.  Items without
    words match nothing; item texts that repeat count once per item id, a null item id as
    empty text.
    """
    plan, owned, postings = _plan(docs, items, doc_id, text, length)
    found = stored(_matches(plan, postings), "matches")
    spans = found.groupBy("doc_id", "print", "start").agg(F.max("n").alias("n"))
    # words covered by overlapping spans count once: each adds what lies beyond all before it
    before = Window.partitionBy("doc_id", "print").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    added = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("_added", added).groupBy("doc_id", "print").agg(F.sum("_added").alias("n_hit"))
    named = found.select("doc_id", "print", "window").distinct().join(owned.select("window", "item_id"), "window")
    named = named.select("doc_id", "print", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    lists = named.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = hits.withColumnRenamed("doc_id", "d1").join(lists.withColumnRenamed("doc_id", "d2"), "print").where("d1 <=> d2")
    hit = hit.select(F.col("d1").alias("d"), "print", "n_hit", "items")
    rows = _documents(docs, doc_id, text).select("doc_id", "print", F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))
    all_rows = rows.join(hit.withColumnRenamed("print", "p"), F.col("print").eqNullSafe(F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return all_rows.select(
        "doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
