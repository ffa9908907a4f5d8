"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: lower case, compatibility forms, accents and look-alike
letters of other scripts become plain letters, digits and signs that stand for letters
become those letters, invisible characters go.  Lexicon entries are beginnings of
words; their weights are log odds learned from labelled rows.  Hits inside an
exception phrase do not count, and the sum is normalised by length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, id_text, small_batches, stored

# Letters of other scripts that look like Latin ones, and what digits and signs
# stand for.  "1" may be an i or an l, so both, and all that look like them, become i.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i", "ʟ": "i", "ᴏ": "o", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ӏ": "i", "һ": "h", "ո": "n", "օ": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
# Entries that hold without labels, and phrases in which an entry is harmless.
SEED_WORDS = (
    "idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "dumbass", "retard",
    "bastard", "asshole", "bitch", "whore", "slut",
)
SEED_WEIGHT = 3.0
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash talk show", "clown fish", "clownfish", "circus clown", "class clown",
    "pond scum", "idiot proof", "pathetic fallacy", "stupid question", "sore loser award", "moron theorem",
)
SLICE_CHARS = 1 << 20
_fold: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """What each code point becomes: 0 goes, 32 separates words."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x30000):
            char = chr(code)
            if code in (0xAD, 0x34F, 0x61C, 0xFEFF) or 0x200B <= code <= 0x200F or 0x2060 <= code <= 0x2064 or 0xFE00 <= code <= 0xFE0F:
                table[code] = 0
                continue
            plain = unicodedata.normalize("NFKD", char)
            if len(plain) > 1 and all(unicodedata.combining(c) for c in plain[1:]):
                plain = plain[0]
            elif len(plain) != 1:
                plain = char
            if unicodedata.combining(plain):
                table[code] = 0
                continue
            plain = plain.lower()[0]
            plain = SIGNS.get(plain, LOOKALIKES.get(plain, plain))
            if plain.isalpha():
                table[code] = ord("i" if plain == "l" else plain)
        _fold.append(table)
    return _fold[0]


def fold(texts: list[str]) -> list[str]:
    """Folded texts: letters, with one blank between words, before the first and after the last."""
    codes = np.frombuffer("\x00".join(t.replace("\x00", " ") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    marks = np.flatnonzero(codes == 0)
    out = _fold_table()[codes]
    out[marks] = 1
    out = out[out != 0]
    blank = out == 32
    edge = np.r_[True, (out[:-1] == 32) | (out[:-1] == 1)]
    out = out[~(blank & edge)]
    return [f" {t.strip(' ')} " if t.strip(" ") else " " for t in out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\x01")]


def _slices(texts: list[str]):
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield texts[low:i]
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield texts[low:]


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: tuple[float, float] = (-3.0, 2.0)  # of the logistic curve over the normalised sum
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                made.add_word(" " + word, (len(word) + 1, weight))  # a blank at the end asks for the whole word
            for phrase in self.exceptions:
                folded = fold([phrase])[0].rstrip()
                made.add_word(folded, (len(folded), None))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Matches as (from, to, weight), without those in an exception.  Of entries that
        begin at the same place the heaviest counts."""
        made, found, harmless = self.automaton(), {}, []
        if not len(made):
            return []
        for last, (size, weight) in made.iter(folded):
            first = last + 1 - size
            if weight is None:
                harmless.append((first, last + 1))
            elif first not in found or weight > found[first][1]:
                found[first] = (last + 1, weight)
        return [(a, b, w) for a, (b, w) in sorted(found.items()) if not any(x <= a and b <= y for x, y in harmless)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Normalised sum of each text: weights of its hits over the logarithm of its length."""
        out = []
        for some in _slices([t or "" for t in texts]):
            for folded in fold(some):
                total = sum(w for _, _, w in self.hits(folded))
                out.append(total / np.log(np.e + folded.count(" ")))
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + self.coef[1] * self.features(texts), -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps with a small penalty; both classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    design, coef, penalty = np.c_[np.ones(len(x)), x], np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        grad = design.T @ (weight * (p - y)) + penalty @ coef
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, grad)
        coef = coef - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(coef[0]), float(coef[1])


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    toxic_docs: int = 6_000, clean_docs: int = 12_000, least_odds: float = 1.8, doubt: float = 2.5,
) -> Model:
    """Learn word beginnings and their weights from labelled rows.

    About ``toxic_docs`` and ``clean_docs`` rows are read, those with the lowest hash of
    the id: the bound on what training costs.  Of rows that share the smallest hash of a
    word pair, for any of three hashes, one counts, so that copies do not vote.  A
    beginning of at least three letters, or a whole word (stated with a blank after it),
    is an entry if its log odds less ``doubt`` standard errors reach ``least_odds``.
    Heavier ones come first, longer ones of equal weight; an entry that extends another
    or is its beginning is left out.  Labels that are null, contradict each other or belong to no row are ignored;
    without both classes the seed words stand.
    """
    at = F.abs(F.xxhash64(id_text(doc_id)) % F.lit(1 << 30))
    agreed = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    agreed = stored(agreed.where("y = z").select("id", F.col("y").cast("int").alias("y"), F.abs(F.xxhash64(id_text("id")) % F.lit(1 << 30)).alias("at")), "toxicity-labels")
    counts = {r.y: r.n for r in agreed.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({fold([w])[0].strip(): SEED_WEIGHT for w in SEED_WORDS})
    cut = {y: min(1.0, n / counts[y]) * (1 << 30) for y, n in ((1, toxic_docs), (0, clean_docs))}
    chosen = agreed.where(F.col("at") < F.when(F.col("y") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0]))).select("id", "y")
    # the two limits bound how many ids are chosen, so they go to the texts
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), at.alias("at")).where(F.col("at") < F.lit(max(cut.values())))
    sample = picked.where("text is not null").join(F.broadcast(chosen), "id").select("id", "text", "y")

    def keys(batches):
        for batch in small_batches(batches, 1):
            texts, out = batch.column(1).to_pylist(), []
            for folded in (f for some in _slices(texts) for f in fold(some)):
                words = folded.split()
                pairs = {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or words, strict=False)} or {0}
                out.append([min((h * m) % 4294967291 for h in pairs) for m in (1, 2654435761, 40503)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)]], names=["id", "text", "y", "k0", "k1", "k2"])

    rows = sample.mapInArrow(keys, "id long, text string, y int, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):
        rows = rows.groupBy(k, "y").agg(F.min_by(F.struct(*[c for c in ("id", "text", "k0", "k1", "k2") if c != k]), F.struct("id", F.xxhash64("text"))).alias("r"))
        rows = rows.select("y", k, "r.*")
    rows = stored(rows.select("id", "text", "y"), "toxicity-sample")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            texts, ys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            folded = [f for some in _slices(texts) for f in fold(some)]
            for f, y in zip(folded, ys, strict=True):
                seen[y].update(set(f.split()))
            words = sorted({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.string()), "clean": pa.array([seen[0][w] for w in words], pa.int64()), "toxic": pa.array([seen[1][w] for w in words], pa.int64()),
            })

    total = F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    words = rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(*total)
    lengths = F.sequence(F.lit(3), F.least(F.length("word") + 1, F.lit(16)))
    closed = words.where(F.length("word") >= 3).withColumn("word", F.concat("word", F.lit(" ")))
    begun = closed.withColumn("n", F.explode(lengths)).groupBy(F.expr("substring(word, 1, n)").alias("start")).agg(*total)
    n0, n1 = float(sizes.get(0, 1)), float(sizes.get(1, 1))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1)) - F.log((F.col("clean") + 0.5) / F.lit(n0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = begun.select("start", (odds - doubt * error).alias("sure"))
    # each entry stands out in the bounded sample, which bounds how many there are
    found = sure.where(F.col("sure") >= least_odds).collect()
    learned: dict[str, float] = {}
    for row in sorted(found, key=lambda r: (-round(r.sure, 1), -len(r.start), r.start)):
        if not any(row.start.startswith(e) or e.startswith(row.start) for e in learned):
            learned[row.start] = float(row.sure)
    weights = {w: SEED_WEIGHT for w in (fold([x])[0].strip() for x in SEED_WORDS) if not any(w[:k] in learned for k in range(3, len(w) + 1))}
    weights.update(learned)
    model = Model(weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(shared.value.features(batch.column(1).to_pylist()), pa.float64()), "y": batch.column(2)})

    sums = rows.mapInArrow(measure, "x double, y int").toPandas()  # bounded by the sample
    model.coef = _fit_curve(sums["x"].to_numpy(float), sums["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``score``, the chance that the text is toxic (named otherwise
    only if a kept column has that name).  Null and empty texts have no hits and get the
    lowest score there is."""
    keep = docs.columns if keep is None else keep
    name, inner = fresh(keep, "score"), fresh(keep, "_text")
    schema = docs.select(*keep, F.lit(0.0).alias(name)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches):
            values = shared.value.scores(batch.column(batch.num_columns - 1).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias(inner)).mapInArrow(run, schema)
