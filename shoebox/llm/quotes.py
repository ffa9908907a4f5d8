"""Quotation linking for message threads, in DataFrame operations only.

Lines are parsed to their quote level, runs of lines of one level become passages,
normalised passages are hashed and joined to the message in which they first stood
unquoted, and messages come out without quotes, in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import stored
from shoebox.operators.skew import with_position

PREFIX = r"^[ \t>]*>"
ATTRIBUTION = r"(?i)^[ \t]*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió) ?:[ \t]*$"
# a single line links by itself only if it has this many words
LEAST_WORDS = 3
# where a sentence ends within a run of lines
SENTENCE_END = r"(?<=[.!?…。！？])[\"'”’»)\]]*(?:\s+|(?<=[。！？]))"


def normalised(text: Column) -> Column:
    """Lower-case words with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hash(words: Column) -> Column:
    return F.md5(F.encode(words, "UTF-8"))


def lines(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, print, pos, level, content)`` of every line; ``content`` comes
    without its quote marks.  An attribution right above a quote has the quote's level."""
    split = messages.select("conv_id", "turn", "print", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", PREFIX, 0)
    level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
    parsed = split.select("conv_id", "turn", "print", "pos", level.alias("level"), F.expr("substring(line, length(regexp_extract(line, r'" + PREFIX + "', 0)) + 1)").alias("content"))
    # a message is one row of the input, so this holds no more than a row's text
    own = Window.partitionBy("conv_id", "turn", "print").orderBy("pos")
    below = F.lead("level").over(own)
    lifted = F.when((F.col("level") == 0) & (below > 0) & F.col("content").rlike(ATTRIBUTION), -1).otherwise(F.col("level"))
    return parsed.withColumn("level", lifted)


def passages(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, print, level, hash)``: hashes of each run of lines of one level
    (blank lines part runs), and of each line and each sentence of some length, so that a
    part of a paragraph links however its lines are broken."""
    own = Window.partitionBy("conv_id", "turn", "print").orderBy("pos")
    worded = parsed.where("level >= 0").withColumn("words", normalised(F.col("content")))
    blank = F.col("words") == ""
    starts = blank | (F.lag("level").over(own) != F.col("level")) | (F.lag("words").over(own) == "") | F.lag("level").over(own).isNull()
    numbered = worded.withColumn("run", F.sum(starts.cast("int")).over(own)).where(~blank)
    runs = numbered.groupBy("conv_id", "turn", "print", "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "words", "content"))).alias("l"))
    whole = runs.select("conv_id", "turn", "print", "level", _hash(F.concat_ws(" ", F.col("l.words"))).alias("hash"))
    single = numbered.where(F.size(F.split("words", " ")) >= LEAST_WORDS).select("conv_id", "turn", "print", "level", _hash(F.col("words")).alias("hash"))
    sentences = runs.select("conv_id", "turn", "print", "level", F.explode(F.split(F.concat_ws(" ", F.col("l.content")), SENTENCE_END)).alias("content"))
    worded = sentences.withColumn("words", normalised(F.col("content"))).where(F.size(F.split("words", " ")) >= LEAST_WORDS)
    part = worded.select("conv_id", "turn", "print", "level", _hash(F.col("words")).alias("hash"))
    return whole.unionByName(single).unionByName(part).distinct()


def reply_links(units: DataFrame) -> DataFrame:
    """``(conv_id, turn, print, reply_to)``: the turn each quoting message answers.

    A passage belongs to the first turn of its conversation that has it unquoted; of
    matches at the lowest quote level that has any, the latest turn counts.  Only earlier
    turns can be answered.  Passages meet the table of their first turns, one row each,
    so a passage that is repeated everywhere gives no pairs."""
    first = units.where("level = 0 and conv_id is not null and turn is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    met = units.where("level > 0").join(first, ["conv_id", "hash"]).where(F.col("turn").isNull() | (F.col("origin") < F.col("turn")))
    by_level = met.groupBy("conv_id", "turn", "print", "level").agg(F.max("origin").alias("origin"))
    return by_level.groupBy("conv_id", "turn", "print").agg(F.min_by("origin", "level").alias("reply_to"))


def thread_roots(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, root)`` of every turn that answers another: the turn its chain
    starts at, found by doubling the jump until none moves.  A turn of several messages
    answers the latest turn any of them answers."""
    jump = stored(links.where("turn is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("root")), "threads")
    while True:
        ahead = jump.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = stored(jump.join(ahead, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "threads")
        jump = moved.select("conv_id", "turn", "root")
        if moved.where("moved").limit(1).count() == 0:
            return jump


def conversations(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per message: ``conv_id, turn, role, n_levels, reply_to, root, position, text``.

    ``text`` is what the message says itself, without quotes and their attributions;
    ``n_levels`` the deepest quote in it.  ``position`` counts from 1 within the
    conversation: threads by the turn they start at, answers after what they answer (a
    message only answers earlier turns).  Messages that share a turn are ordered by role,
    then text.  A null turn comes last and is never answered; messages without a
    conversation are not linked and form one sequence.  Null text stays null; wholly
    repeated rows each keep a place.
    """
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.xxhash64(role, text, F.col(text).isNull()).alias("print"),
    )
    quoting = rows.where(F.col("text").contains(">") & F.col("text").rlike(r"(?m)" + PREFIX))
    # only conversations that quote need their lines
    needed = rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").dropDuplicates(["conv_id", "turn", "print"])
    links = stored(reply_links(passages(lines(needed))), "reply-links")
    roots = thread_roots(links)
    bare = lines(quoting.dropDuplicates(["conv_id", "turn", "print"])).groupBy("conv_id", "turn", "print").agg(
        F.greatest(F.max("level"), F.lit(0)).alias("n_levels"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "content")))).alias("own"),
    ).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("print").alias("p"), "n_levels", F.trim(F.array_join(F.col("own.content"), "\n"), F.lit(" \n\t")).alias("bare"))
    same = lambda a: (F.col("conv_id").eqNullSafe(a["c"])) & (F.col("turn").eqNullSafe(a["t"])) & (F.col("print") == a["p"])
    linked = links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("print").alias("p"), "reply_to")
    full = rows.join(bare, same(bare), "left").drop("c", "t", "p").join(linked, same(linked), "left").drop("c", "t", "p")
    full = full.join(roots, ["conv_id", "turn"], "left")
    table = full.select(
        "conv_id", "turn", "role", F.coalesce("n_levels", F.lit(0)).alias("n_levels"), "reply_to", F.coalesce("root", "turn").alias("root"),
        F.when(F.col("n_levels").isNull(), F.col("text")).otherwise(F.col("bare")).alias("text"), "print",
    )
    order = [F.col("conv_id").asc_nulls_last(), F.col("root").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("print")]
    placed = with_position(table, order, "_at")
    starts = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("_at").alias("_first"))
    out = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "turn", "role", "n_levels", "reply_to", "root", (F.col("_at") - F.col("_first") + 1).alias("position"), "text")
