"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.llm import bwt, byte_bpe, exact_dedup, language, mixing, near_dedup, quality, suffix_dedup, vector_links, warc

LONG = "word soup " * 30000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeats and clashing columns."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Omega,", "x1", "née", "42", "!"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts += ["", None, "   ", "\n\n", "A", "a", LONG, texts[0], texts[0], texts[1] + " tail", "0 1 2", "日本語 テキスト"]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, texts[2], "en", "s1", 1, "x", "y"), (None, None, None, None, None, None, None)], DOCS)


def table(df):
    return [r.asDict() for r in df.collect()]


# 1 suffix-array dedup
def brute_repeats(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_merged_transforms_find_repeats(seed):
    r = random.Random(seed)
    base = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 60))) for _ in range(5)]
    strings = [b"".join(r.choice(base)[r.randint(0, 20) :] for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 12))]
    length = r.choice([5, 8, 12, 20, 40])
    seen = Counter(s[k : k + length] for s in strings for k in range(len(s) - length + 1))
    want = [k + length <= len(s) and seen[s[k : k + length]] > 1 for s in strings for k in range(len(s))]
    assert bwt.repeated_starts(strings, length, shard_bytes=r.choice([10, 60, 10**6])).tolist() == want


def test_merge_gives_order_and_common_prefixes():
    strings = [b"banana", b"ananas", b"bandana"]
    s = bwt.Strings(strings, 1)
    places, block, common = bwt.merge(s, [0, 7, 14, s.n], 12)
    data = b"\0".join(strings) + b"\0"
    tails = [data[p : data.index(b"\0", p)] for p in places]
    assert tails == sorted(tails)
    for k in range(1, len(tails)):
        both = 0
        while both < min(map(len, tails[k - 1 : k + 1])) and tails[k - 1][both] == tails[k][both]:
            both += 1
        assert common[k] == both


@pytest.mark.parametrize("wide", [2, 2000])
def test_repeats_are_removed(spark, odd, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    texts = list(rows.values())
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=100).collect()}
    for (i, t), gone in zip(rows.items(), brute_repeats(texts, 100), strict=True):
        assert bytes(got[i].kept) == bytes(b for b, g in zip(t, gone, strict=True) if not g) and got[i].n_removed == sum(gone)
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()
    assert suffix_dedup.remove_repeats(odd.where("false")).count() == 0


# 2 exact dedup
def test_cuckoo_index_resizes_and_deletes():
    index, keys = exact_dedup.CuckooIndex(8), [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(3000)]
    assert all(index.insert(k, [1, n]) for n, k in enumerate(keys)) and index.resizes > 0
    assert not index.insert(keys[5], [9, 9]) and index.get(keys[5]) == [1, 5]
    for k in keys[::2]:
        assert index.delete(k) and not index.delete(k)
    assert index.size == 1500 and all((index.get(k) is None) == (n % 2 == 0) for n, k in enumerate(keys))
    assert all(index.maybe(k) for k in keys[1::2])


def test_exact_dedup(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd).collect())
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    keep = {t: max((i for i in v if i is not None), default=None) for t, v in by.items()}
    assert got == Counter((i, keep[t], len(by[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0


def test_live_index_updates(spark):
    d = lambda *x: spark.createDataFrame([(k.encode(), n, i) for k, n, i in x], "digest binary, n bigint, keep bigint")
    index = exact_dedup.live_index(d(("a", 1, 1), ("a", 1, 5), ("b", 1, 2)))
    after = exact_dedup.update_index(index, d(("b", 1, 9), ("c", 1, 3)), d(("a", 0, 0), ("zz", 0, 0)))
    assert sorted((bytes(r.digest), r.n, r.keep) for r in after.collect()) == [(b"b", 2, 9), (b"c", 1, 3)]


# 3 embeddings
def test_cover_tree_pairs_are_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.02 * rng.normal(size=(10, 16)), np.repeat(base[:1], 40, 0) + 0.01 * rng.normal(size=(40, 16)), base[:3] * 7.5])
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, x[0].tolist(), None), (904, [1.0, 2.0], 0), (905, [None] * 16, 0), (906, x[0].tolist(), 0), (None, x[0].tolist(), 0), (907, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, unit string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u, labels, ids = np.vstack([u, u[:1], u[:1]]), np.array([k % 2 for k in range(len(x))] + [0, 0]), [*range(len(x)), 906, None]
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(u), dtype=bool)
    comp = list(range(len(u)))
    for _ in comp:
        comp = [min([comp[k], *(comp[j] for j in np.flatnonzero(link[k]))]) for k in range(len(u))]
    for block in (2048, 7):
        vector_links.BLOCK, old = block, vector_links.BLOCK
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.link_vectors(df).collect()}
        vector_links.BLOCK = old
        for k, i in enumerate(ids):
            assert got[i] == (int(link[k].sum()), ids[comp[k]], ids[comp[k]] == i)
        assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 907))
    assert vector_links.link_vectors(df.where("false")).count() == 0


# 5 near duplicates
def brute_components(sets, ids, percent):
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, odd, width):
    import re

    r = random.Random(width)
    base = [r.choice("abcdefghijklm") * r.randint(1, 4) for _ in range(200)]
    more = []
    for k in range(25):  # a large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 9)}"
        more.append((1000 + k, " ".join(w).upper() if k % 2 else " ".join(w)))
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    sets = {}
    for x in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x.text or "").encode().lower())
        sets[x.doc_id] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    want = brute_components(sets, sorted(sets), 80)
    got = {x.doc_id: x for x in near_dedup.near_duplicates(docs, width=width).collect()}
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert near_dedup.near_duplicates(odd).count() == odd.count() and near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_bits_estimate_similarity(spark):
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)  # 800 of 1200
    m = [near_dedup.packed_bits(near_dedup.minima(near_dedup._mix(x))).tolist() for x in (a, b)]
    e = spark.createDataFrame([m], "a array<bigint>, b array<bigint>").select(near_dedup.estimated_similarity(F.col("a"), F.col("b"))).first()[0]
    assert abs(e - 2 / 3) < 0.15 and near_dedup.enough_equal(0.8) < 0.8125 * 128


# 6 WARC
def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", LONG), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>é</p>"), (None, "u", "only")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages, str(tmp_path / "w")).collect()), key=repr)
    size = lambda t: len((t or "").encode())
    want = [(1, size(rows[0][2]), "response", None), (2, size(rows[0][2]), "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, size(LONG), "response", None), *[(6, size(rows[5][2]), "response", None)] * 2, (None, size(rows[0][2]), "revisit", 1), (None, 4, "response", None)]
    assert got == sorted(want, key=repr)
    read = warc.read_warc(spark, str(tmp_path / "w"))
    assert {bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()} == {r[2] or "" for r in rows}
    assert read.where("record_type = 'revisit'").count() == 3
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("payload IS NOT NULL").count() == 0
    assert warc.archived(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_predicates_reach_the_source(spark, tmp_path, capsys):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b")], "page_id bigint, url string, html string")
    revisits = warc.archive_pages(pages, str(tmp_path / "w")).where("record_type = 'revisit'")
    revisits.explain("formatted")
    assert "EqualTo(record_type,revisit)" in capsys.readouterr().out
    assert [r.record_id for r in revisits.collect()] == ["urn:page:2"]


def test_commits_to_one_folder_add_up(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"p{k}") for k in range(4)], "page_id bigint, url string, html string")
    warc.archive_pages(pages.where("page_id < 3"), str(tmp_path / "w"))
    assert warc.archive_pages(pages.where("page_id = 3"), str(tmp_path / "w")).count() == 4
    warc.archive_records(pages.where("page_id = 0")).write.format("warc").mode("overwrite").save(str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 1


def test_short_batches_have_sets():
    for width in (2, 4, 5, 8):
        for n in range(12):
            words = [f"w{k}".encode() for k in range(n)]
            want = len({tuple(words[k : k + width]) for k in range(n - width + 1)}) if n >= width else int(n > 0)
            (one,) = near_dedup.shingle_sets([b" ".join(words)], width)
            assert len(one) == want
            both = near_dedup.shingle_sets([b" ".join(words), b"", b"w0 w1"], width)
            assert both[0].tolist() == one.tolist() and len(both[1]) == 0 and len(both[2]) == 1


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    got = warc.archive_pages(pages, str(tmp_path / "w"), smallest=3)
    assert sorted((r.record_id[-1], r.record_type) for r in got.collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_unwanted_payloads_are_not_decoded(tmp_path):
    block = b"x" * 500_000
    records = b"".join(warc.record_bytes([("WARC-Type", t), ("WARC-Record-ID", f"<urn:{k}>")], block) for k, t in enumerate(["response", "metadata", "response"]))
    (tmp_path / "a.warc.gz").write_bytes(records)
    f = warc.ArchiveFile(str(tmp_path / "a.warc.gz"))
    assert [h["warc-record-id"] for h, b in f.records(lambda h: h["warc-type"] == "metadata", True)] == ["<urn:1>"] and f.inflated < 510_000
    # foreign files: members without lengths, and plain records
    plain = gzip.decompress(records)
    (tmp_path / "b.warc").write_bytes(plain)
    one = plain[: len(plain) // 3]
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    assert [len(b) for _, b in warc.ArchiveFile(str(tmp_path / "b.warc")).records(lambda h: True, True)] == [500_000] * 3
    assert [len(b) for _, b in warc.ArchiveFile(str(tmp_path / "c.warc.gz")).records(lambda h: True, True)] == [500_000] * 2


# 7 byte-level BPE
def reference_encoder():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.vocabulary(path).ranks, special_tokens={})


def test_bpe_equals_library(odd):
    library = reference_encoder()
    for r in byte_bpe.encode_texts(odd, *byte_bpe.default_vocabulary()).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode_digests(odd.where("false"), *byte_bpe.default_vocabulary()).count() == 0


def test_bpe_on_random_text_and_edits():
    library, r = reference_encoder(), random.Random(1)
    own = byte_bpe.Encoder(*byte_bpe.default_vocabulary())
    letters = list("ab c\n\t'étsS0 9.!é中 ️ ²\x1c ")
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    for _ in range(300):
        a, b = ("".join(r.choice(letters) for _ in range(n)).encode() for n in (r.randint(0, 40), r.randint(0, 10)))
        i = r.randint(0, len(a))
        j = r.randint(i, len(a))
        c = byte_bpe.PrefixCoder(own.v, a)
        c.replace(i, j, b)
        assert c.ids() == byte_bpe.PrefixCoder(own.v, a[:i] + b + a[j:]).ids()
        c.append(b)
        assert c.ids() == byte_bpe.PrefixCoder(own.v, a[:i] + b + a[j:] + b).ids()
    c = byte_bpe.PrefixCoder(own.v, b"some words in a long text " * 40)
    assert c.replace(500, 503, b"?") < 300  # an edit is local


# 8 mixing
def test_mix_meets_targets(odd):
    got = table(mixing.pareto_mix(odd))
    assert len(got) == odd.count() and Counter(map(repr, got)) == Counter(map(repr, table(mixing.pareto_mix(odd.repartition(7)))))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, capped = {}, set()
    while True:  # share, cap, share the excess again
        free = [s for s in order if s not in capped]
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        want = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = [s for s in free if want[s] > 3 * size[s]]
        if not over:
            break
        capped |= set(over)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    assert mixing.pareto_mix(odd.where("false")).count() == 0
    assert {r["taken"] for r in table(mixing.pareto_mix(odd.where("text IS NULL")))} == {0}


# 9 language
def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model, x, y = language.Model(["a", "b", "c"]), rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 5)
    _, grads = model.gradients(x, y)
    for group, grad in zip([model.ways[0].p, model.ways[1].p, model.out], grads, strict=True):
        for k, w in group.items():
            at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
            old, step = w[at], 1e-5
            w[at] = old + step
            up = model.gradients(x, y)[0]
            w[at] = old - step
            down = model.gradients(x, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[k][at]) < 1e-6


def test_windowed_reading_equals_plain_recurrence():
    model, rng = language.Model(["a", "b"]), np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 50, 256, 300)]
    got = model.predict(texts)
    for t, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for k in range(0, len(t), language.WINDOW):
            x = np.frombuffer(t[k : k + language.WINDOW], np.uint8)[None]
            states = np.concatenate([model.ways[0].forward(x)[0], model.ways[1].forward(x[:, ::-1])[0][::-1]], 2)
            e = np.exp(states @ model.out["w"] + model.out["b"])
            total += (e / e.sum(2, keepdims=True)).sum((0, 1))
        assert np.abs(total / max(1, len(t)) - p).max() < 1e-5


def test_languages_are_told_apart(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got >= 0.9
    rows = {r.doc_id: r for r in language.identify(odd).where("doc_id IS NOT NULL").collect()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or "")) and 0 <= r.score <= 1 for i, r in rows.items())
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.where("false")).count() == 0


# 10 quality
def test_isotonic_means_never_fall():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 5, 64)
    curve = quality.pool_adjacent(rng.binomial(n, np.linspace(0.1, 0.9, 64)).astype(float), n.astype(float))
    assert (np.diff(curve) >= 0).all() and 0 < curve[0] and curve[-1] < 1
    assert (quality.pool_adjacent(np.zeros(4), np.zeros(4)) == 0.5).all()


def test_quality_is_learnt(spark, odd, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.85
    scored = table(quality.quality_scores(odd, labels))
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert {r["score"] for r in table(quality.quality_scores(odd, labels.where("false")))} == {0.5}
    assert quality.quality_scores(odd.where("false"), labels).count() == 0
