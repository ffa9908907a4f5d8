"""One query per corpus operator, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import langid, licenses, manifest, mincut, mixing, phrases, quotes, repeats, resample, simhash, subspace, tokens, toxicity
from shoebox.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window."""
    found = phrases.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("print")


ORACLES["op6_decontaminate"] = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lengths AS (SELECT DISTINCT len(win) AS n FROM win),
span AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc, lengths WHERE len(w) >= n),
found AS (
  SELECT s.r, s.i, s.n, v.item_id FROM span AS s JOIN win AS v ON s.w[s.i:s.i + s.n - 1] = v.win),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@_query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document."""
    taken = mixing.copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLES["op7_mix"] = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM doc GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w, source_size * 2.0::DOUBLE AS most FROM src),
ranked AS (SELECT *, row_number() OVER (ORDER BY most / w, i) AS k FROM weighed),
rest AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per FROM ranked),
level AS (SELECT per FROM rest WHERE w * per <= most ORDER BY k LIMIT 1),
share AS (SELECT source, source_size, least(w * per, most) AS target FROM weighed, level),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM doc JOIN share ON doc.source IS NOT DISTINCT FROM share.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""


@_query
def op3_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, as read back from them."""
    return tokens.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.withColumn("held_out", held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    found = toxicity.score(docs, toxicity.train(docs, known), keep=["doc_id"])
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", predicted.alias("predicted"))


@_query
def op4_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op4_subspace"] = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound AS a JOIN sound AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings
  UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degree ON degree.a = vec_id
"""


@_query
def op5_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return mincut.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@_query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, as a whole text and by notices."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The same reduction in SQL, for the documents and the known texts alike."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = f"regexp_replace(lower(regexp_replace(text, {quote('(?im)' + licenses.COPYRIGHT_LINE)}, '', 'g')), {quote(licenses.NOT_WORDS)}, ' ', 'g')"
    for other, usual in licenses.SPELLINGS:
        words = f"replace({words}, {quote(other)}, {quote(usual)})"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in licenses.KNOWN)
    whole = f"trim(regexp_replace(regexp_replace(lines, {quote('(?m)' + licenses.TITLE_LINE)}, '', 'g'), '[ \\n]+', ' ', 'g'))"
    for other, usual in licenses.TWO_WORDS:
        whole = f"replace({whole}, {quote(other)}, {quote(usual)})"
    listed = ", ".join(f"({quote(name)}, {quote(digest)}, false)" for name, digest in licenses.DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id, max(notice) AS notice FROM (
    SELECT license_id, sha256({whole}) AS digest, notice
    FROM (SELECT license_id, {words} AS lines, NOT contains(text, chr(10)) AS notice FROM (VALUES {values}) AS t(license_id, text))
    UNION ALL SELECT * FROM (VALUES {listed}) AS d(license_id, digest, notice)) GROUP BY 1),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
line AS (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM doc),
said AS (
  SELECT r, string_agg(license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT r, license_id FROM line JOIN known USING (digest) WHERE notice) GROUP BY r)
SELECT doc_id, sha256({whole}) AS digest, license_id, coalesce(notices, '') AS notices
FROM doc LEFT JOIN known ON known.digest = sha256({whole}) LEFT JOIN said USING (r)
"""


ORACLES["op10_licenses"] = _license_sql()


@_query
def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, in reply order."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


# CRC-32 of a list of byte values ``{bytes}``, its step table coming from ``crc(steps)``
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


@_query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest, tried out on tampered texts."""
    docs = table(spark, sf_dir, "documents")
    found = manifest.manifest(docs, tampered={"text": manifest.without_line_feeds("doc_id", "text")})
    root = manifest.folded(F.col("tampered_leaf"), F.col("segment"))
    proof = manifest.proof_digest(F.col("segment"))
    shown = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
ORACLES["op11_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
leaf AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC.format(bytes="[ord(d) for d in string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') if d <> '']")} % 2 = 0
      THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS tampered
  FROM documents, crc),
placed AS (
  SELECT r, doc_id, leaf, tampered, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaf),
node AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 3, n),
top AS (SELECT tree AS pos, digest, count(*) OVER () AS n FROM node WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, n, digest FROM top
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 3, n),
every AS (
  SELECT tree, level, pos, n, digest FROM node UNION ALL SELECT -1, level, pos, n, digest FROM above),
sibling AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every AS a JOIN every AS b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT r AS row, tree AS own, tree, 0 AS level, pos, n, tampered AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT row, own, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN c.n > 1 THEN c.pos // 3 ELSE own END, CASE WHEN c.n > 1 THEN (c.n + 2) // 3 ELSE (SELECT count(*) FROM top) END,
    CASE WHEN c.n > 1 THEN sha256(l || folded || s.r) ELSE folded END, CASE WHEN c.n > 1 THEN proof || l || s.r ELSE proof END
  FROM climb AS c LEFT JOIN sibling AS s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos WHERE c.n > 1 OR c.tree >= 0)
SELECT doc_id, leaf, top.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified
FROM climb JOIN placed ON placed.r = climb.row JOIN top ON top.pos = climb.own, (SELECT digest FROM above WHERE n = 1) AS root
WHERE climb.tree = -1 AND climb.n = 1
"""


@_query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that earlier ones have."""
    found = repeats.cut_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's features."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_words")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op12_resample"] = f"""
WITH {_CRC_TABLE},
word AS (
  SELECT row_number() OVER () AS r, true AS own, doc_id, coalesce({_WORDS}, []) AS w FROM documents
  UNION ALL SELECT 0, false, NULL, coalesce({_WORDS}, []) FROM benchmark),
run AS (SELECT r, own, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM word),
counted AS (SELECT r, own, run, count(*) AS n FROM run GROUP BY ALL),
byte AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM counted)),
hashed AS (
  SELECT run, {_CRC.format(bytes="list_transform(range(strlen(h) // 2), lambda i: instr('123456789ABCDEF', h[2 * i + 1]) * 16 + instr('123456789ABCDEF', h[2 * i + 2]))")} % 10000 AS bucket
  FROM byte, crc),
cell AS (SELECT r, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
tally AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM cell GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM tally, (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM tally)),
weight AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM cell JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM word LEFT JOIN weight USING (r) WHERE word.own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k, 5 * count(*) OVER (PARTITION BY able) // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= most THEN k END AS rank FROM ranked
"""
