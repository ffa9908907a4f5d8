"""Text expressions for search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

TOKEN_SCORE = 1.0
EXACT_PATH_SCORE = 5.0


def split_query(text: str) -> list[str]:
    """Tokens of a query held by the driver; duplicates stay."""
    return [t for t in re.split(f"[{WHITE_SPACE}]+", text) if t]


def trim_query(text: str) -> str:
    return re.sub(f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "", text)


def tokens(query: Column) -> Column:
    """The column form of ``split_query``, lower-cased."""
    # white space bounds every letter's context, so lowering the whole text lowers each token
    return F.array_remove(F.split(F.lower(query), r"(?U)\s+"), "")


def trimmed(query: Column) -> Column:
    return F.regexp_replace(query, r"(?U)^\s+|\s+$", "")


def filename_score(path: Column, text: str) -> Column:
    """+1 per query token inside the lower-cased path, +5 when the whole path
    equals the query; null when nothing matches.  Tokens are unrolled so the
    score stays in generated code."""
    lowered = F.lower(path)
    score = F.lit(0.0)
    for token in split_query(text):
        score = score + F.when(F.contains(lowered, F.lower(F.lit(token))), TOKEN_SCORE).otherwise(0.0)
    score = score + F.when(lowered == F.lower(F.lit(trim_query(text))), EXACT_PATH_SCORE).otherwise(0.0)
    return F.when(score > 0, score.cast("float"))


def parse_kind(kind: Column) -> Column:
    """``text | tags | classification | vector:N`` to a struct ``(kind, dims)``;
    null for anything else, and for more dimensions than a bigint holds."""
    # an optional plus sign and leading zeros are legal, a bare 'vector' is not
    dims = F.regexp_extract(kind, r"^vector:\+?0*([0-9]+)$", 1).try_cast("bigint")
    plain = kind.isin("text", "tags", "classification")
    return F.when(plain, F.struct(kind.alias("kind"), F.lit(None).cast("bigint").alias("dims"))).when(
        dims.isNotNull(), F.struct(F.lit("vector").alias("kind"), dims.cast("bigint").alias("dims"))
    )
