"""Tokeniser measures and rules against plain Python that encodes every word by itself."""

import base64
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tiktoken

from lodespark.llm import fertility

WORD = r"[^\x20\x09-\x0D]+"
RANKS, PATTERN, PIECES = fertility.default_vocabularies()


@pytest.fixture(scope="module")
def coders():
    out = []
    for path in RANKS:
        with open(path, "rb") as f:
            out.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={}))
    return out, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(text, coders):
    ranks, pieces = coders
    w = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    ids = [[t for x in w for t in c.encode_ordinary(" " + x)] for c in ranks]
    p = [t for x in w for t in pieces.encode(x)]
    chars, c = sum(map(len, w)), Counter(ids[-1])
    n = len(ids[-1])
    entropy = -sum(v / n * math.log2(v / n) for v in c.values()) if n else None
    base = (len(w), chars, sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered))
    return base, [chars / len(x) if x else None for x in (*ids, p)], sum(pieces.is_byte(t) for t in p) / len(p) if p else None, entropy


def near(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    vocabulary = ["the", "of", "house", "running", "née", "straße", "日本語", "don't", "a　b", "x\x85", "42,", "Ünïcode", "\x01", "##", "<b>", "😀", "　", "ß"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))) for _ in range(60)]
    texts += ["", None, " \n\t", "a b c d e f g h " * 9, "one line\none line\none line \n\n \n\n", "word " * 40_000, "x" * 30_000, "#*$%&|<> " * 3, "\x01 \x02"]
    return [(k, t, ["en", None, "de"][k % 3]) for k, t in enumerate(texts)] + [(5, texts[5], "en"), (None, texts[6], None), (None, None, None)]


def test_measures(spark, rows, coders, monkeypatch):
    monkeypatch.setattr(fertility, "TEXTS", 3000)
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id bigint, text string, lang string, n_words int, id string")
    got = sorted(fertility.measure(docs, (RANKS, PATTERN, PIECES)).collect(), key=lambda r: repr((r.id, r.n_words, r.word_chars, r.language)))
    want = sorted(((i, lang, t, brute(t, coders)) for i, t, lang in rows), key=lambda x: repr((x[0], x[3][0][0], x[3][0][1], x[1] or "script:" + fertility.script(x[2] or ""))))
    assert len(got) == len(want)
    for r, (i, lang, t, (base, chars, share, entropy)) in zip(got, want, strict=True):
        assert (r.id, r.language) == (i, lang or "script:" + fertility.script(t or ""))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert all(map(near, r.chars_per_token, chars)) and near(r.byte_share, share) and near(r.entropy, entropy)


def test_script():
    assert [fertility.script(x) for x in ("", "12", "abc née", "Привет a", "日本語", "ひらがな日", "한국어", "مرحبا")] == ["none", "none", "latin", "cyrillic", "han", "kana", "hangul", "arabic"]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_repeated_words(width):
    r = random.Random(width)
    for _ in range(30):
        texts = [np.array([r.randrange(3) for _ in range(r.choice([0, 3, 12, 40]))], np.int64) for _ in range(4)]
        want = []
        for x in texts:
            windows = Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))
            want.append(len({j for k in range(len(x) - width + 1) if windows[tuple(x[k : k + width])] > 1 for j in range(k, k + width)}))
        assert fertility.repeated_words(texts, width).tolist() == want


def test_rules_against_brute_force(spark, coders):
    r = random.Random(9)
    prose = {"en": ["the", "of", "and", "house", "morning", "river", "walked", "people", "never", "because"], "fr": ["le", "de", "et", "maison", "matin", "rivière", "monde", "jamais", "parce", "que"]}
    rows = []
    for k in range(260):
        lang = "en" if k % 3 else "fr"
        rows.append((k, " ".join(r.choice(prose[lang]) + str(r.randrange(1000)) for _ in range(r.randint(20, 150))), lang))
    rows += [(300, " ".join(f"{r.random():.12f}" for _ in range(60)), "en"), (301, "ﷺ꧁꧂ᚠ ".join("abcdefghij" * 4), "en"), (302, "the " * 100, "en"), (303, "a b", "en"), (304, None, "en"), (305, rows[1][1], "en"), (306, " ".join(rows[k][1] for k in (1, 2, 4)), "xx")]
    rows += [(400 + k, rows[300 - 40][1], "en") for k in range(150)]  # copies of junk move no band
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x.doc_id: x for x in fertility.fertility_rules(docs, (RANKS, PATTERN, PIECES)).collect()}
    measured = {i: (lang, *brute(t, coders)) for i, t, lang in rows}
    groups = defaultdict(set)
    ok = {i: m[1][0] >= 20 and 100 * m[1][4] <= 30 * m[1][0] for i, m in measured.items()}
    flat = {i: (*m[2], m[3], m[4]) for i, m in measured.items()}
    for i, m in measured.items():
        if ok[i]:
            for length in (m[1][0].bit_length() - 1, -1):
                groups[m[0], length].add((m[1][0], m[1][1], *flat[i]))
    for i, m in measured.items():
        outside = 0
        for k in range(5):
            length, group = next(((x, g) for x in (m[1][0].bit_length() - 1, -1) if len(g := groups[m[0], x]) >= fertility.LEAST), (0, None))
            if group and flat[i][k] is not None:
                q1, q2, q3 = np.quantile([round(x[2 + k], 4) for x in group], [0.25, 0.5, 0.75])
                reach = max(6 / 1.349 * (q3 - q1), (0.05 + 0.5 / 2 ** (length / 2 if length >= 0 else 2)) * q2 if k < 3 else [0.05, 0.8][k - 3])
                outside += (flat[i][k] < q2 - reach and k != 3) or (flat[i][k] > q2 + reach and k != 4)
        assert (got[i].base_failed, got[i].n_outside, got[i].kept) == (not ok[i], outside, ok[i] and not outside), (i, flat[i])
    assert not got[300].kept and not got[301].kept and not got[302].kept and got[306].kept and sum(got[k].kept for k in range(260)) >= 258
    assert fertility.fertility_rules(docs.where("false"), (RANKS, PATTERN, PIECES)).count() == 0
