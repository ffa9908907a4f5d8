"""Round trips of token files, vector links against all pairs, minimum cuts against all labellings."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoebox.llm import mincut, subspace, tokens
from tests.llm import plain

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_whole_texts():
    rng = random.Random(3)
    whole, mine = Tokenizer.from_file(WORD), tokens._Words(WORD)
    assert mine.by_piece
    some = ["", " ", "\n", "a b\tc d <|startoftext|> x", "don't it's 12 34", "É́ ́x  Σας ΟΔΟΣ İ K", "x y\x1cz", "a ̸b", "ẃ. q.,.,"]
    some += ["".join(rng.choice(" \n\tabcÀé́'sΣσ漢🙂12.,!-ffi　̇İ") for _ in range(40)) for _ in range(500)]
    for text, ids in zip(some, mine.encode(some), strict=True):
        assert whole.encode(text, add_special_tokens=False).ids == ids.tolist()
    other = tokens._Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_piece and other.encode(["Two words"])[0].tolist() == other.tokenizer.encode("Two words").ids


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes(planes):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.RandomState(n).randint(0, 2**32, n, dtype=np.uint64).astype("<u4")
        payload, ends = tokens.pack(ids, planes, block=64)
        assert (tokens.unpack(payload, ends, n, planes, block=64) == ids).all()


def test_files(spark):
    rows = [(9, "nine words", "x"), (2, "two " * 500, "x"), (2, "again two", "x"), (-4, None, "x"), (5, "", "x"), (None, "none", "x")] + [(7, "seven", "x")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = tokens.roundtrip(docs, WORD, with_ids=True, planes="bit", block=100, buckets=4).orderBy("start").collect()
    whole = Tokenizer.from_file(WORD)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    texts = {}
    for i, text, _ in rows:
        texts.setdefault(i, []).append([*whole.encode(text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert tokens.roundtrip(docs.limit(0), WORD).count() == 0


def test_vectors(spark):
    rng = np.random.RandomState(2)
    base = rng.randn(40, 64)
    rows = []
    for i in range(260):
        v = base[i % 40] + rng.randn(64) * rng.choice([0.1, 0.25, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 3), "c"))
    rows += [(300 + k, [float(x) * 7 for x in base[0]], 0, "c") for k in range(3)] + [(310, [float(x) for x in base[0]], 0, "c")] * 2
    rows += [(400, None, 0, "c"), (401, [0.0] * 64, 0, "c"), (402, [float("nan")] * 64, 0, "c"), (403, [1.0, None], 0, "c"), (404, [1.0, 2.0], 0, "c"), (405, [1.0, 2.1], 0, "c"), (406, [], 0, "c"), (407, rows[0][1], None, "c"), (408, [float("inf")] * 64, 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    ok = lambda r: r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    group = plain.roots(range(len(rows)), links)
    least = {}
    for k, r in enumerate(rows):
        least[group[k]] = min(least.get(group[k], 10**9), r[0])
    n = [sum(k in pair for pair in links) for k in range(len(rows))]
    want = sorted((r[0], n[k], least[group[k]], r[0] == least[group[k]]) for k, r in enumerate(rows))
    tile, subspace.TILE = subspace.TILE, 20
    try:
        got = sorted(tuple(r) for r in subspace.near_duplicates(df).collect())
    finally:
        subspace.TILE = tile
    assert got == want and len(links) > 100
    assert subspace.near_duplicates(df.limit(0)).count() == 0


def test_minimum_cut_is_least():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores, edges, pairs = [rng.uniform(-2, 2) for _ in range(n)], [[] for _ in range(n)], []
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                w = rng.uniform(0, 1.5)
                edges[i].append((j, w))
                edges[j].append((i, w))
                pairs.append((i, j, w))

        def cost(x, scores=scores, pairs=pairs):
            ends = sum(max(0, -s) if k else max(0, s) for s, k in zip(scores, x, strict=True))
            return ends + sum(w for i, j, w in pairs if x[i] != x[j])

        assert cost(mincut.cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


PAGE = """<html><head><title>T</title></head><body><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies to improve
your experience here, and so on.</div><div id="wrap"><div class="post-content"><h1>Title&nbsp; here</h1><p>First paragraph of the story &amp; more
text, long enough.<p>Short.<aside>Related: <a href=x>other</a></aside><script>if (a < b) "</p>"</script><p>Second &eacute; goes <b>on</b>.</p>
<form><p>Subscribe to our newsletter for more stories every day.</p></form><ul><li>point one is here<li>point two</ul></div>
<div id="comments"><p>I think this is a very good article and everyone should read it.</p></div></div><footer>(c) 2020 x"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "c"), (2, "u", None, "c"), (3, None, "", "c"), (4, "u", "<nav>only menu</nav>", "c"), (1, "u", PAGE, "c"), (None, "u", "<p>" + "word " * 30000 + "end.</p>", "c"), (6, "u", "<p a='x>y'", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = mincut.extract(df)
    assert got.columns == ["page_id", "url", "text", "_text", "n_chars"]
    found = sorted(((r.page_id or 0, r["_text"], r.n_chars) for r in got.collect()))
    want = "Title here\nFirst paragraph of the story & more text, long enough.\nShort.\nSecond é goes on.\npoint one is here\npoint two"
    assert [t for i, t, _ in found if i == 1] == [want, want]
    assert [t for i, t, _ in found if i in (2, 3, 4)] == ["", "", ""]
    assert [n for i, _, n in found if i == 0] == [5 * 30000 + 4]
    assert mincut.extract(df.limit(0)).count() == 0


PARAGRAPH = "<p>This is a long enough paragraph of article text, and it has a second clause. It also has another sentence.</p>"


def test_article_text_is_not_lost():
    text = PARAGRAPH[3:-4]
    for page in (
        f"<article class='box hidden md:block'>{PARAGRAPH}</article>", f"<article title='The hidden cost'>{PARAGRAPH}</article>",
        f"<article data-title=\"a hidden world\">{PARAGRAPH}</article>", f"<article><svg class='i'/>{PARAGRAPH}</article>", f"<article><button>{PARAGRAPH}</article>",
        f"<article><title-bar>{PARAGRAPH}</title-bar></article>", f"<article><script>if (a<b && c == \"'\") x = '<p class=\"';</script>{PARAGRAPH}</article>",
    ):
        assert mincut.main_text(page) == text, page
    for name in ("share-price", "search-results", "notice-period", "social-history", "tags-explained"):
        assert mincut.main_text(f"<div class='{name}'>{PARAGRAPH}{PARAGRAPH}</div>") == f"{text}\n{text}", name
    for page in (f"<article hidden>{PARAGRAPH}</article>", f"<div class='share-buttons'>{PARAGRAPH}</div>", f"<article><script>{PARAGRAPH}</article>", f"<div class='search'>{PARAGRAPH}</div>"):
        assert mincut.main_text(page) == "", page


def test_broken_pages_take_linear_time():
    import time

    for page in (
        "<a " * 350_000, "<b>" * 170_000 + "x</p>" * 170_000, "<a \">" * 200_001, "<a '\">" * 150_001, "<button>" * 120_000, "<b>" * 100_000 + "<div></div>" * 60_000,
        "<div>" * 100_000 + "<li></li>" * 60_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<!-" * 300_000, "<" * 10**6, "<svg>" * 200_000,
    ):
        begun = time.process_time()
        mincut.main_text(page)
        assert time.process_time() - begun < 15, page[:20]
