"""Quantised search against all cosines, and hashed embeddings against their definition."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodespark.operators import vector_index as X


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (2, 4):
        for size in (1, 3, 8, 17):
            codes = rng.integers(0, 2**bits, (5, size)).astype(np.uint8)
            assert (X._unpack(X._pack(codes, bits), bits, size) == codes).all()


@pytest.mark.parametrize("bits", [2, 4])
def test_search_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(X, "QUERIES", 7)
    monkeypatch.setattr(X, "BLOCK", 40)
    rng = np.random.default_rng(bits)
    x = np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(3, 24)), 20, 0) + 0.1 * rng.normal(size=(60, 24))])
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 24, ""), (902, [float("nan")] * 24, ""), (903, [1.0, 2.0], ""), (904, [], ""), (905, [None] * 24, ""), (906, x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "id int, vector array<double>, codes string")
    queries = df.where("id % 20 = 0 OR id > 899").select(df.id.alias("query_id"), "vector")
    got = {}
    for r in X.search(X.build_index(df, bits=bits), df, queries, k=10, bits=bits, others_only=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.cosine))
    good = {k: np.array(v) for k, v, _ in rows if v and len(v) == 24 and None not in v and not math.isnan(v[0])}
    unit = {k: v / n if (n := np.linalg.norm(v)) else v for k, v in good.items()}
    for q in unit:
        if q % 20 == 0 or q > 899:
            want = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k in unit if k != q)[:10]
            assert [k for _, k, _ in sorted(got[q])] == [k for _, k in want]
    assert set(got) == {q for q in unit if q % 20 == 0 or q > 899}
    assert X.search(X.build_index(df.where("false")), df, queries, k=3).count() == 0
    with pytest.raises(ValueError):
        X.build_index(df, bits=8)


def test_recall_and_pruning_on_the_table(spark, sf):
    """Recall at 50 of at least 0.99 with the usual slack, from a small part of all rows."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    queries = v.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    got = {}
    for r in X.search(X.build_index(v, "vec_id", "embedding"), v, queries, 50, "vec_id", "embedding").collect():
        got.setdefault(r.query_id, set()).add(r.id)
    m = np.stack([x / max(np.linalg.norm(x), 1e-300) for _, x in rows])
    hit = all_ = 0
    for i, x in rows:
        if i % 10 == 0:
            cos = m @ (x / np.linalg.norm(x))
            best = {rows[k][0] for k in np.argsort(-cos, kind="stable")[:50]}
            hit, all_ = hit + len(best & got[i]), all_ + 50
    assert hit >= 0.99 * all_


def test_hashed_embeddings(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["Apple", "pear", "snake_case", "née", "STRASSE", "straße", "x1", "--"]) for _ in range(r.randint(0, 40))) for _ in range(30)] + [None, "", "!!", "long " * 50_000]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(None, "a", 1.0)], "doc_id int, text string, embedding double")
    for normalized in (True, False):
        got = {x.doc_id: x.embedding for x in X.hashed_embeddings(docs, dimensions=16, normalized=normalized).collect()}
        for k, t in enumerate(texts):
            want = [0.0] * 16
            for token in re.findall(r"[a-zA-Z0-9_]+", (t or "").casefold()):
                d = hashlib.blake2b(token.encode(), digest_size=8).digest()
                want[int.from_bytes(d[:4], "big") % 16] += 1 if d[4] % 2 == 0 else -1
            n = math.sqrt(sum(x * x for x in want)) if normalized else 1
            assert got[k] == pytest.approx([x / n if n else 0.0 for x in want])
    assert X.hashed_embeddings(docs.where("false")).count() == 0
