"""Proximity matches against every passage, with the rarest words replaced."""

from shoebox.llm import phrases
from tests.llm import plain


def test_rarest_words_replaced(spark):
    terms = [f"q{k}" for k in range(1, 11)]
    bodies = [
        terms, [*terms[:9], "other"], [*terms[:8], "other", "nowhere"], [*terms[:7], "other", "and", "more"],
        ["none", *terms[1:]], list(reversed(terms[1:])), [*terms[:4], "x", "y", *terms[6:]], terms[3:],
    ]
    # q10 is the rarest, q1 next; more rows make the others common
    docs = [(k, " ".join(["before", *b, "after"])) for k, b in enumerate(bodies)]
    docs += [(100 + k, f"q{2 + k % 8} alone") for k in range(40)]
    items = [(1, " ".join(terms)), (2, " ".join([*terms[:9], "absent"])), (3, " ".join([*terms[:8], "absent", "missing"]))]
    want = set()
    for item, body in items:
        own = plain.bench_words(body)
        for doc, text in docs:
            words = plain.bench_words(text)
            if any(len(set(own) & set(words[i : i + 10])) >= 0.8 * len(set(own)) for i in range(max(1, len(words) - 9))):
                want.add((doc, body))
    found = phrases.proximity_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {(r.doc_id, r.window) for r in found.collect()}
    assert got == want and {d for d, _ in want} >= {0, 1, 2, 4, 5, 6}
