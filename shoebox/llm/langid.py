"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter answers for all languages at once: every slot of the
filter is a bitmask over languages, and the AND of an n-gram's slots is the set of
languages that contain it.  Per language the set bits of all n-grams of a text are
counted, and the hits expected from false positives alone are taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, id_text, small_batches

NOTHING = "und"
SLOTS = 1 << 21
HASHES = 2
# characters looked at together: some 200 bytes of working arrays for each
SLICE_CHARS = 1 << 17
_GRAM = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character 4-grams, and the index of the text of each.

    Letters are lower-cased, whatever stands between words is one blank, and a blank
    stands before and after every text, so short words count with their ends."""
    codes = np.frombuffer("\x00".join(["", *[t.lower().replace("\x00", " ") for t in texts], ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    # blanks shrink to one; the marks between texts stay
    mark = codes == 0
    keep = letter | mark
    keep[1:] |= letter[:-1] & ~letter[1:]
    flat, marks = np.where(letter, codes, 32)[keep].astype(np.uint64), mark[keep]
    owner = np.cumsum(marks) - 1
    if len(flat) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = flat[:-3] * _GRAM[0]
        for k in range(1, 4):
            h = (h ^ (h >> np.uint64(29))) * _GRAM[k] + flat[k : len(flat) - 3 + k]
        h = (h ^ (h >> np.uint64(32))) * _GRAM[0]
        h ^= h >> np.uint64(29)
    # a window belongs to the text of its first character and may touch marks only at its ends
    inner = ~(marks[1:-2] | marks[2:-1])
    return h[inner], np.minimum(owner[:-3][inner], len(texts) - 1)


def _slots(h: np.ndarray, slots: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(2 * k + 1) + (h >> np.uint64(17 + k))) >> np.uint64(20)).astype(np.int64) % slots


def _slices(texts: list[str]):
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


@dataclass
class Model:
    """Learned languages and the filter: per slot a row of bytes, one bit per language."""

    langs: list[str]
    table: np.ndarray  # (slots, bytes)

    def __post_init__(self):
        fill = [float(((self.table[:, i // 8] >> (i % 8)) & 1).mean()) for i in range(len(self.langs))]
        self.false_rate = np.array(fill) ** HASHES

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Bitmask rows of the languages that contain each n-gram."""
        found = self.table[_slots(h, len(self.table), 0)]
        for k in range(1, HASHES):
            found = found & self.table[_slots(h, len(self.table), k)]
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of each text's n-grams that each language explains, false positives taken out."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in _slices(texts):
            h, owner = grams(texts[a:b])
            total = np.maximum(np.bincount(owner, minlength=b - a), 1)
            masks = self.languages_of(h)
            for byte in range(masks.shape[1]):
                # how often each mask occurs in each text gives the counts of its eight languages
                seen = np.bincount(owner * 256 + masks[:, byte], minlength=(b - a) * 256).reshape(b - a, 256)
                for bit in range(min(8, len(self.langs) - 8 * byte)):
                    has = (np.arange(256) >> bit) & 1 == 1
                    i, hits = 8 * byte + bit, seen[:, has].sum(axis=1)
                    rate = self.false_rate[i]
                    out[a:b, i] = np.clip((hits - total * rate) / max(1 - rate, 1e-9) / total, 0, 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        filled = [t or "" for t in texts]
        wordless = [not any(map(str.isalpha, t)) for t in filled]
        if not self.langs:
            return [NOTHING] * len(texts), [0.0] * len(texts)
        shares = self.scores(filled)
        best = shares.argmax(axis=1)
        names = [NOTHING if empty else self.langs[i] for empty, i in zip(wordless, best, strict=True)]
        return names, [0.0 if empty else float(s[i]) for empty, i, s in zip(wordless, best, shares, strict=True)]


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 4_000, slots: int = SLOTS,
) -> Model:
    """Learn from rows with text and language.

    About ``docs_per_lang`` rows of each language are read, those with the lowest hash of
    the id: the bound on what training costs.  An n-gram counts for a language that uses
    it at least twice, and no less than an eighth as often as the language that uses it
    most.  What reaches the driver is one row per language and one per filter slot.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.abs(F.xxhash64(id_text(doc_id)) % F.lit(1 << 30)).alias("at")
    )
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((slots, 1), np.uint8))
    cut = {name: min(1.0, docs_per_lang / n) for name, n in counts.items()}
    number = F.create_map(*[F.lit(x) for i, name in enumerate(langs) for x in (name, i)])
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, cut[name] * (1 << 30))])
    sample = known.where(F.col("at") < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches):
        for batch in small_batches(batches):
            which, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                h, owner = grams(texts[a:b])
                at = which[a:b][owner]
                for i in np.unique(at):
                    gram, n = np.unique(h[at == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array(np.full(len(gram), i, np.int32)), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n.astype(np.int64)),
                    })

    # the count of a language fits a broadcast: one row per language
    grams_of = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in grams_of.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[F.lit(x) for i in range(len(langs)) for x in (i, float(totals.get(i, 1)))])
    rated = grams_of.where("n >= 2").withColumn("rate", F.col("n") / total[F.col("lang")])
    uses = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    kept = uses.select("gram", "top", F.explode("by").alias("x")).where(F.col("x.rate") * 8 >= F.col("top"))
    kept = kept.select("gram", F.col("x.lang").alias("lang"))

    def place(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            lang_no = batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(HASHES):
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(_slots(h, slots, k)), "byte": pa.array((lang_no // 8).astype(np.int32)),
                    "mask": pa.array((1 << (lang_no % 8)).astype(np.int32)),
                })

    cells = kept.mapInArrow(place, "slot long, byte int, mask int").groupBy("slot", "byte").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((slots, (len(langs) + 7) // 8), np.uint8)
    table[cells["slot"], cells["byte"]] = cells["mask"]
    return Model(langs, table)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus the predicted language and its score, the corrected share of
    the text's n-grams that the language explains.  The two new columns come last, named
    ``lang_pred`` and ``score`` unless a kept column has that name.

    A text that is null or has no letter gives ``und`` and 0, as does every text where
    nothing was learned.  Ties go to the first language by name.
    """
    keep = docs.columns if keep is None else keep
    lang_name, score_name, inner = (fresh(keep, n) for n in ("lang_pred", "score", "_text"))
    schema = docs.select(*keep, F.lit("").alias(lang_name), F.lit(0.0).alias(score_name)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches):
            names, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col(text).alias(inner)).mapInArrow(run, schema)
