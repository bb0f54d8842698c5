"""Collocations against a count of every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodespark.llm import phrases
from lodespark.llm.queries import COLLOCATIONS, op12_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, max_n + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        have = {p: a for p, a in c.items() if 1 < len(p) and a >= least}
        found = []
        for p, a in have.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in have.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["the", "of", "New", "york", "City", "é", "É", "b c", "x\ty", "a", "hot  dog", "a b", "10%"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", " ", ", ", "\n", "\t", ". ", "  "]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    texts += ["", None, "new york " * 40, "...", " . ", "É é É", "la " * 500, "one"]
    langs = ["en", "de", None, "und"]
    return [(langs[k % 4] if k % 5 else "en", t) for k, t in enumerate(texts)] + [("en", texts[0])] * 3


@pytest.mark.parametrize(("max_n", "share", "top", "together"), [(3, 50, 2000, 8 << 20), (2, 50, 5, 64), (4, 30, 7, 100), (3, 100, 2000, 7)])
def test_collocations_against_brute_force(spark, rows, monkeypatch, max_n, share, top, together):
    monkeypatch.setattr(phrases, "TOGETHER", together)
    monkeypatch.setattr(phrases, "ROWS", 13)
    docs = spark.createDataFrame([(lang, t, "clash", 1) for lang, t in rows], "lang string, text string, phrase string, f int")
    got = sorted(tuple(x) for x in phrases.collocations(docs, max_n, 4, share, top).collect())
    assert got == brute(rows, max_n, 4, share, top) and got


def test_counts_across_blocks(rows):
    texts = [t.encode() for _, t in rows if t]
    want = Counter()
    for n, names, counts in phrases._grams(texts, 1, 4, 10**9):
        want.update({(n, p): k for p, k in zip(names.to_pylist(), counts.tolist(), strict=True)})
    for most in (1, 5, 33, 1000):
        got = Counter()
        for n, names, counts in phrases._grams(texts, 1, 4, most):
            got.update({(n, p): k for p, k in zip(names.to_pylist(), counts.tolist(), strict=True)})
        assert got == want


def test_exact_beyond_64_bits(spark):
    import lodespark.llm.phrases as p

    big = 10**14 + 1
    counted = spark.createDataFrame([("en", "x", big), ("en", "y", big + 1), ("en", "x y", big)], "lang string, phrase string, f bigint")
    keep, p.phrase_counts = p.phrase_counts, lambda _, low, *__: counted.where("instr(phrase, ' ') = 0" if low == 1 and __[0] == 1 else "instr(phrase, ' ') > 0")
    try:
        row = p.collocations(None, max_n=2).first()
    finally:
        p.phrase_counts = keep
    assert (row.score, row.a, row.l, row.r, row.n) == (10**6 * big * big // (big * (big + 1)), big, big, big + 1, 2 * big + 1) and row.score == 999_999


def test_empty(spark):
    docs = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.where("false")).count() == 0


def test_sql(same):
    same(op12_collocations, COLLOCATIONS)
