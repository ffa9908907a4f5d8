"""Plain versions of what the operators compute, for small inputs."""

import re

import xxhash


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    """Smallest reachable node of each."""
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def contamination(text, items):
    """Number of words, hit word places, and items found."""
    words, hit, found = bench_words(text), set(), set()
    for item, body in items:
        own = bench_words(body)
        for run in {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else ():
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)
