"""Every stage of the corpus pipeline, and all of it, against plain Python on a small table with odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodespark.llm import language, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, copies int, kept_id string, gone_id bigint, mix_id bigint, lang_pred string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rnd = random.Random(3)
    words = {"en": ["the", "river", "went", "under", "bridge", "while", "people", "watch"], "de": ["der", "fluss", "ging", "unter", "brücke", "während", "leute", "schauen"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(30)) for _ in range(n))
    rows = [(k, text(lang, rnd.randrange(5, 60)), lang, rnd.choice(["a", "b", "c", None])) for k, lang in enumerate(["en", "de"] * 20)]
    base = rows[4][1]
    rows += [(100, base, "en", "a"), (101, base, None, "b"), (102, base + " tail1 tail2", "en", "a"), (103, "x " + base, "en", "c")]
    rows += [(110, None, "en", "a"), (111, "", "de", "a"), (112, "  \n", None, None), (113, "12345 67 !!", "en", "b"), (114, "hi", "en", "b"), (115, "hi there", "en", "b"), (116, "Hi there", "de", "b")]
    rows += [(120, text("en", 4000), "en", "c"), (121, rows[7][1], "de", "a"), (121, rows[7][1], "de", "a"), (None, "no id here", "en", "a"), (None, base, "en", "a")]
    return [(*r, len(r[1] or ""), 7, 8, "k", 9, 10, "p") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def plain(rows):
    return Counter((r[0], r[1], r[3]) for r in rows)


def spark_rows(df, docs):
    assert df.columns == docs.columns and df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = df.collect()
    assert all(tuple(r)[5:] == (7, 8, "k", 9, 10, "p") for r in got)
    return plain(got)


def lettered(rows):
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def last_of_equal(rows):
    keep = {}
    for r in rows:
        t = r[1] or ""
        known = keep.get(t, None)
        keep[t] = r[0] if known is None else known if r[0] is None else max(known, r[0])
    return [r for r in rows if keep[r[1] or ""] == r[0]]


def first_of_near(rows):
    """Rows without an id are documents of their own after all others."""
    keys = [(r[0] is None, k if r[0] is None else r[0]) for k, r in enumerate(rows)]
    sets = defaultdict(set)
    for key, r in zip(keys, rows, strict=True):
        w = [x.lower() for x in WORD.findall(r[1] or "")]
        if w:
            sets[key] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    ids = sorted(set(keys))
    group = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return [r for key, r in zip(keys, rows, strict=True) if group[key] == key]


def mixed(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA) if rows else None
    if df is None:
        return []
    most = {}
    for r in mixing.pareto_mix(df.select("doc_id", "text", "source")).collect():
        most[r.doc_id, r.size] = max(most.get((r.doc_id, r.size), 0), r.taken)
    out = []
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        out += [r] * (int(most[r[0], n] / n + 0.5) if n else 0)
    return out


def test_language_stage(spark, docs):
    assert spark_rows(P.identify_language(spark, docs, ""), docs) == plain(lettered(documents()))


def test_exact_stage(spark, docs):
    assert spark_rows(P.drop_exact_copies(spark, docs, ""), docs) == plain(last_of_equal(documents()))


def test_near_stage(spark, docs):
    assert spark_rows(P.drop_near_copies(spark, docs, ""), docs) == plain(first_of_near(documents()))


def test_near_stage_on_short_texts_alone(spark, docs):
    short = docs.where("doc_id BETWEEN 110 AND 116")
    assert spark_rows(P.drop_near_copies(spark, short.repartition(7), ""), docs) == plain(first_of_near([r for r in documents() if r[0] in range(110, 117)]))


def test_mixing_stage(spark, docs):
    assert spark_rows(P.mix_sources(spark, docs, ""), docs) == plain(mixed(spark, documents()))


def encoded(rows):
    import tiktoken
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return Counter((r[0], np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in rows)


def test_encoding_stage(spark, docs):
    got = P.encode(spark, docs, "").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == encoded(documents()) and all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_stages_on_an_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = mixed(spark, first_of_near(last_of_equal(lettered(documents()))))
    assert Counter((r.doc_id, bytes(r.ids)) for r in P.run(spark, str(tmp_path)).collect()) == encoded(rows)


def test_a_window_of_any_place_is_learnt_from(spark):
    """Languages that differ only at the end of long texts are still told apart."""
    head = "0123456789 " * 400
    rows = [(k, head + ("abcd efgh " if k % 2 else "wxyz uvst ") * 900, "l1" if k % 2 else "l2") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train_on(df)
    got = language.predict_languages(df, model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 76
