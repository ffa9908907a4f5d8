"""Quotation linking: nested levels, attributions, chains, ties, nulls."""

from shoebox.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return [tuple(r) for r in quotes.conversations(df).orderBy("conv_id", "position").collect()]


def test_nested_quotes_link_and_leave(spark):
    rows = [
        (1, 0, "a", "The first question is here.\nIt has two lines."),
        (1, 1, "b", "Another topic entirely, unrelated."),
        (1, 2, "c", "On Monday a wrote:\n> The first question IS here. It has\n> two lines.\n\nMy answer to that."),
        (1, 3, "b", ">> The first question is here. It has two lines.\n> My answer to that.\nAnd mine to yours."),
    ]
    got = run(spark, rows)
    # conv, turn, role, levels, reply_to, root, position, text
    assert got == [
        (1, 0, "a", 0, None, 0, 1, rows[0][3]), (1, 2, "c", 1, 0, 0, 2, "My answer to that."),
        (1, 3, "b", 2, 2, 0, 3, "And mine to yours."), (1, 1, "b", 0, None, 1, 4, rows[1][3]),
    ]


def test_long_chain_and_first_origin(spark):
    rows = [(7, i, "x", (f"> this is message number {i - 1} of it\n" if i else "") + f"this is message number {i} of it") for i in range(12)]
    got = run(spark, rows)
    assert [(r[1], r[4], r[5]) for r in got] == [(i, i - 1 if i else None, 0) for i in range(12)]


def test_only_earlier_turns_of_the_same_conversation(spark):
    rows = [(1, 0, "a", "> said somewhere else entirely\nhm"), (1, 1, "a", "said somewhere else entirely"), (2, 5, "a", "> said somewhere else entirely")]
    assert [r[4] for r in run(spark, rows)] == [None, None, None]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [
        (1, 0, "u", "one two three"), (1, 0, "u", "one two three"), (1, None, "u", "> one two three\nlate"), (None, 3, "u", "> one two three"),
        (2, 1, None, None), (2, 1, "a", ""), (2, 2, "a", ">"),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert [(r[1], r[4], r[6], r[7]) for r in got if r[0] == 1] == [(0, None, 1, "one two three"), (0, None, 2, "one two three"), (None, 0, 3, "late")]
    assert [(r[4], r[7]) for r in got if r[0] is None] == [(None, "")]
    assert [r[7] for r in got if r[0] == 2] == [None, "", ""]
    assert run(spark, []) == []


def test_parts_of_paragraphs(spark):
    rows = [
        (1, 0, "a", "We should meet at noon. The lake is frozen over! Bring your skates, please."),
        (1, 1, "b", "A different remark about dinner plans."),
        (1, 2, "c", "> The lake is\n> frozen over!\nIt is indeed."),
        (1, 3, "d", "> dinner plans.\nToo few words to link."),
        (1, 4, "e", ">> We should meet at noon. The\n>> lake is frozen over!\n> It is indeed.\nGood."),
    ]
    assert [(r[1], r[4]) for r in sorted(run(spark, rows), key=lambda r: r[1])] == [(0, None), (1, None), (2, 0), (3, None), (4, 2)]


def plain_links(rows):
    """Reply targets of (turn, text) rows of one conversation, passage by passage."""
    import re

    def words(text):
        return re.sub(r"[^\w]+|_", " ", text.lower()).strip()

    def units(text):
        found, run = [], []
        for line in [*text.split("\n"), None]:
            mark = re.match(r"[ \t>]*>", line or "")
            level = mark.group().count(">") if mark else 0
            content = line[mark.end() :] if mark else line
            new = line is None or not words(content) or (run and run[0][0] != level)
            if new and run:
                joined = " ".join(c for _, c in run)
                whole = [words(joined)]
                parts = [words(c) for _, c in run] + [words(s) for s in re.split(r"(?<=[.!?])\s+", joined)]
                found += [(run[0][0], u) for u in whole + [p for p in parts if len(p.split()) >= 3]]
                run = []
            if line is not None and words(content):
                run.append((level, content))
        return set(found)

    own, out = [units(t) for _, t in rows], []
    for k, _ in enumerate(rows):
        best = {}
        for level, u in own[k]:
            origin = min((j for j in range(len(rows)) if (0, u) in own[j]), default=None)
            if level and origin is not None and origin < k:
                best[level] = max(best.get(level, -1), origin)
        out.append(best[min(best)] if best else None)
    return out


def test_against_a_plain_linker(spark):
    import random

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    for conversation in range(4):
        rows = []
        for turn in range(14):
            text = ["".join(f"{' '.join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5)))}{rng.choice(['.', '?', ','])} " for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))]
            for _ in range(rng.randrange(3)):
                if rows:
                    source = rng.choice(rows)[1].split("\n")
                    low = rng.randrange(len(source))
                    text[0:0] = ["> " + line for line in source[low : low + rng.randrange(1, 3)]] + rng.choice([[], [""]])
            rows.append((turn, "\n".join(text)))
        got = run(spark, [(conversation, t, "u", text) for t, text in rows])
        assert [r[4] for r in sorted(got, key=lambda r: r[1])] == plain_links(rows)


def test_very_long_quote_marks(spark):
    rows = [(1, 0, "a", "said before this one"), (1, 1, "b", ">" * 10**6 + " said before this one\nyes"), (1, 2, "c", " \t" * 300_000 + "x > y")]
    got = {r[1]: r for r in run(spark, rows)}
    assert (got[1][3], got[1][4], got[1][7]) == (10**6, 0, "yes") and got[2][3] == 0
