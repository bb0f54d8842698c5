"""Runs of words against a search of all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodespark.llm import common, periodic_runs


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        k = 0
        while k + q < len(x):
            e = k
            while e + q < len(x) and x[e] == x[e + q]:
                e += 1
            if e + q - k >= max(6, 4 * q) and not any(q % d == 0 and all(x[j] == x[j + d] for j in range(k, e + q - d)) for d in range(1, q)):
                out.append((k, e + q - k, q))
            k = max(e, k + 1) if e > k else k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_all_stretches(seed, monkeypatch):
    r = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(periodic_runs, "MANY", 1)
    monkeypatch.setattr(periodic_runs, "TOGETHER", r.choice([1, 2, 16]))
    texts = []
    for _ in range(r.randint(1, 8)):
        x, letters = [], r.randint(1, 4)
        while len(x) < r.choice([0, 5, 40, 120]):
            block = [r.randrange(letters) for _ in range(r.randint(1, 9))]
            x += block * r.randint(1, 7) + block[: r.randint(0, len(block))]
        texts.append(np.array(x, np.int64))
    assert periodic_runs.runs(texts) == [brute_runs(x.tolist()) for x in texts]


def test_z_values():
    r = random.Random(1)
    for _ in range(50):
        x = [r.randrange(2) for _ in range(r.randint(0, 30))]
        z = periodic_runs.z_values(x)
        assert z == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_long_periodic_text_stays_fast():
    one = np.zeros(200_000, np.int64)
    far = np.tile(np.arange(30_000), 5)
    assert periodic_runs.runs([one, far]) == [[(0, 200_000, 1)], [(0, 150_000, 30_000)]]


def test_words_in_parts(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice(["a", "bc", "é", " ", "\t", "\r\n", "\x0b", "　"]) for _ in range(500)).encode()
    for part in (1, 3, 50, 10**6):
        monkeypatch.setattr(common, "PART", part)
        assert [w for p in common.word_parts(text) for w in p] == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text.decode())]


def test_whole_query_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    words = ["a", "b", "née", "c　d", "X", "x"]
    texts = [" ".join(r.choice(words[: r.randint(1, 6)]) for _ in range(r.randint(0, 90))) for _ in range(150)]
    texts += ["", None, " \n\t ", "a a\na\ta  a\x0ba", "one", "la " * 30_000, " ".join(str(k) for k in range(5000)) * 6]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, "b " * 8, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int")
    monkeypatch.setattr(periodic_runs, "TEXTS", 500)
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if n < 1000 else [(0, 30_000, 1)] if w[0] == "la" else periodic_runs.runs([np.unique(w, return_inverse=True)[1]])[0]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        top = min(((-m, s, q) for s, m, q in found), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(x) for x in periodic_runs.run_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(150))
    assert periodic_runs.run_digests(docs.where("false")).count() == 0
