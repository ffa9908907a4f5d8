"""Language, toxicity and licences: learning, folding, canonical forms, odd rows."""

import os
import random

import pytest

from shoebox.llm import langid, licenses, toxicity

EN, DE = "the of and that with this from have".split(), "der und nicht mit ein auch sich das".split()


def corpus(spark, rng):
    rows = [(i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(30)), "en" if i % 2 else "de", "x") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string"), rows


def test_language(spark):
    docs, rows = corpus(spark, random.Random(1))
    model = langid.train(docs, slots=1 << 16)
    assert model.langs == ["de", "en"]
    h, owner = langid.grams(["der und", "x"])
    assert (owner == 0).sum() == 6 and len(h) == 6  # " der und " holds six windows of four
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 $%", "k"), (4, "THE of AND that", "k"), (5, "nicht", "k"), (5, "nicht", "k"), (6, "\x00", "k")], "doc_id long, text string, score string")
    got = langid.identify(odd, model)
    assert got.columns == ["doc_id", "text", "score", "lang_pred", "_score"]
    assert [(r.doc_id, r.lang_pred) for r in got.orderBy("doc_id").collect()] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (6, "und")]
    found = langid.identify(docs, model, keep=["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)
    blank = langid.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(odd, blank).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_many_languages_need_more_than_one_byte(spark):
    rows = [(i, (chr(97 + i % 20) * 3 + " ") * 10, f"l{i % 20:02d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, slots=1 << 14)
    assert model.table.shape == (1 << 14, 3)
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, model).collect())


def test_folding():
    assert toxicity.fold(["1D10T, ѕсum wоrth1ess", "", "  l0ser!", "x​y É"]) == [" idiot scum worthiess ", " ", " ioseri ", " xy e "]


def test_exceptions_and_seeds(spark):
    model = toxicity.Model({"trash ": 2.0, "idiot": 3.0})
    assert [w for _, _, w in model.hits(toxicity.fold(["the trash can, 1diots and TRASH"])[0])] == [3.0, 2.0]
    docs = spark.createDataFrame([(1, "such an idiot you stupid moron"), (2, "a fine day"), (3, None), (4, "")], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, none).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] <= got[2]


def test_learned_lexicon(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(EN) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(40)]
        if i % 4 == 0:
            words.insert(rng.randrange(40), "zork" + rng.choice(["en", "ig", "s", ""]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(1, 1), (9999, 1), (None, 0), (5, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert "zork" in model.weights
    found = toxicity.score(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found)


def test_licenses(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    styled = mit.replace("<year> <holder>", "2001 Some One").replace("sublicense", "sub-licence").upper().replace(" ", "  ")
    rows = [(1, styled, "a"), (2, mit + " more", "a"), (3, "words\n  licensed under the MIT licence!\nLicensed under CC BY 4.0", "a"), (4, None, "a"), (5, "", "a"), (3, "x", "b"), (5, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted((r.doc_id, r.license_id or "", r.notices) for r in licenses.scan(docs).collect())
    assert got == [(1, "MIT", ""), (2, "", ""), (3, "", ""), (3, "", "CC-BY-4.0,MIT"), (4, "", ""), (5, "", ""), (5, "", "")]
    extra = spark.createDataFrame([("OWN", "Own terms apply here.\nAll of them.")], "license_id string, text string")
    own = licenses.scan(spark.createDataFrame([(1, "OWN TERMS apply here; all of them")], "doc_id long, text string"), extra=extra).first()
    assert own.license_id == "OWN"
    assert licenses.scan(docs.limit(0)).count() == 0


def rewrapped(text, width):
    """The same words on lines of other lengths, headings and copyright lines left alone."""
    import textwrap

    blocks = text.split("\n\n")
    kept = [b if "copyright (c)" in b.lower() else textwrap.fill(" ".join(b.split()), width) for b in blocks]
    return "\n\n".join(kept)


def test_titles_rights_and_line_ends_do_not_matter(spark):
    known = [(name, text) for name, text in licenses.KNOWN if "\n" in text]
    rows = []
    for name, text in known:
        title, holder, rest = text.split("\n", 2)
        words = " ".join(rest.split()).replace("COPYRIGHT HOLDER", "COPYRIGHT\nOWNER").replace("copyright holder", "copyright\nowner")
        for head in ("", title + "\n", f"The {name.split('-')[0]} License (MIT)\n" if name == "MIT" else ""):
            for owner in ("Copyright (c) 2001, Some One", "Copyright The Foo Authors\nAll rights reserved.", "(c) 1999 x. All Rights Reserved", holder):
                rows.append((len(rows), name, f"{head}\n{owner}\n\n{words}\n"))
    # what is no licence: a title alone, one sentence less, another word
    lacking = [(-1, None, "MIT License"), (-2, None, known[0][1].rsplit(".", 2)[0]), (-3, None, known[0][1].replace("Software", "Hardware")), (-4, None, "All rights reserved.")]
    docs = spark.createDataFrame(rows + lacking, "doc_id long, wanted string, text string")
    found = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert found == {k: name for k, name, _ in rows + lacking}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="the system has no licence texts")
def test_whole_texts_by_digest(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows, end = [], "END OF TERMS AND CONDITIONS"
    for file, name in files.items():
        with open(f"/usr/share/common-licenses/{file}") as f:
            text = f.read()
        forms = [text, text.upper(), text.replace("\n", "\r\n"), text.replace(" ", "  ").replace(",", " ,"), text.replace("license", "licence"), rewrapped(text, 60)]
        if end in text:
            forms.append(text.split(end)[0] + end)
        rows += [(name, form, k) for k, form in enumerate(forms)] + [(None, text.replace(" the ", " a ", 1), -1), (None, text + "\nAnd one more word.", -2)]
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "doc_id long, wanted string, text string, form int")
    found = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    wrong = [(row[0], row[2], found[k]) for k, row in enumerate(rows) if found[k] != row[0]]
    assert not wrong


def test_licenses_equal_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from shoebox.llm import queries

    rng = random.Random(5)
    texts = [None, "", "MIT License", "All rights reserved.\nCopyright The X Authors\nsub\nlicence", "Copyright the rest", "(c) x\n\n per\ncent"]
    for _, text in licenses.KNOWN:
        words = text.replace("COPYRIGHT HOLDER", "COPYRIGHT\nOWNER").split(" ")
        texts += [text, text.lower().replace("mit license\n", "the mit licence (mit)\n"), "Preface.\n" + text]
        texts += ["".join(w + rng.choice([" ", " ", "  ", ", ", "\n"]) for w in words)]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    columns = "doc_id, digest, license_id, notices"
    wanted = con.execute(f"SELECT {columns} FROM ({queries.ORACLES['op10_licenses']}) ORDER BY doc_id").fetchall()
    got = queries.QUERIES["op10_licenses"](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == wanted and sum(r.license_id is not None for r in got) > 30
