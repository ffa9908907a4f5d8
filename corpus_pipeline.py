"""From raw documents to token files: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import langid, mixing, near_copies, phrases, tokens
from shoebox.llm.common import fresh, lean_batches, stored, table

# a text of which known languages explain less than this share is in none of them
LEAST_SHARE = 0.2
# pieces a worker of the last stage remembers, beside what it keeps of earlier stages
REMEMBERED = 150_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that some rows are labelled with.  Where no row is
    labelled, every text with a letter stays."""
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = langid.identify(docs, model)
    return found.where((F.col(lang) != langid.NOTHING) & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies: texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.  SimHash fingerprints of the shingles
    propose pairs, which are confirmed on the sets; a prefix filter adds the near pairs whose
    fingerprints lie too far apart."""
    return near_copies.keep_one(docs, shingle=5, share=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of a benchmark item."""
    return phrases.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold, as read back."""
    return tokens.roundtrip(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("language", known_language), ("simhash", one_of_each), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", token_files),
]
# XXH64 fingerprints and tokenizers have no SQL; tests hold the stages against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Rows with a null text go in the first stage; copies
    the mixture takes twice are two documents of the token files, next to each other; an
    empty table gives no rows; columns beyond the given ones are carried up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with lean_batches(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
