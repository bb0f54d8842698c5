"""Titles that share only frequent tokens, against a comparison of all."""

import random

from pyspark.sql import functions as F

from lodespark.operators import literature as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_frequent_tokens_against_brute_force(spark):
    rnd = random.Random(1)
    titles = [" ".join(["host", *(rnd.choice(["alpha", "beta", "gamma", "delta", "aaaaaaaa"]) for _ in range(k % 4))]) for k in range(40)]
    titles += [t + rnd.choice(["x", "", " b", "aa"]) for t in titles] + ["rareword host alpha", "rarewords host alpha", "unmet alphas", "unmet alphos"]
    rows = [(k, t, sorted({w for w in t.split() if len(w) >= 4})) for k, t in enumerate(titles)]
    want = {}
    for i, a, x in rows:
        for j, b, y in rows:
            s = round(1 - distance(a, b) / max(len(a), len(b)), 6)
            if i != j and set(x) & set(y) and s >= 0.8:
                want[i, j] = s
    df = spark.createDataFrame(rows, "id bigint, title string, tokens array<string>")
    for cap in (0, 3, 1000):
        got = {(r.id, r.other): r.similarity for r in L.token_blocked_matches(df, df, cap, 0.8).collect()}
        assert got == want
    assert L.token_blocked_matches(df.where(F.lit(False)), df, 3, 0.8).count() == 0
