"""Quality rules from tokenisers: how well public vocabularies fit a text, judged against what is usual in its language.

A text that is what its language label says splits into tokens of a usual length, needs few byte tokens and spreads
over many tokens. Every word is encoded on its own after one space; three measures follow for each document: characters
per token (one for each vocabulary), the share of byte-fallback tokens, and the entropy of the token distribution.
Bands are learnt from the measures of all documents, for each language (or script, where none is given) and each
doubling of length; a document outside a band is rejected, besides those that fail the base rules.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodespark.llm.common import binary, slices, word_parts, written

#: Bytes of texts that are measured together.
TEXTS = 8 << 20
#: Distinct documents that a band needs; below, the band of all lengths serves, and below that none.
LEAST = 30
#: A value may lie this many robust standard deviations (quartile distance / 1.349) from the median ...
SPREADS = 6.0
#: ... or this far at least: for characters per token a share of the median, to which 0.5 / sqrt(words) comes for the noise
#: of a mean over few words; absolute for byte share and entropy (bits).
SLACK = {"chars_per_token": 0.05, "byte_share": 0.05, "entropy": 0.8}
_SYMBOLS = b"#*$%&|<>"
_BLANK = bytes([32, *range(9, 14)])
_INNER = bytes(range(0x80, 0xC0))
#: First code points of blocks and the script that their letters are counted for.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0x20000, "han"), (0x32000, "other"),
]


class Tokens:
    """Rank files (encoded by merges of bytes) and a piece model with byte fallback."""

    def __init__(self, ranks: tuple[str, ...], pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        self.coders, self.starts = [], []
        for path in ranks:
            with open(path, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
            self.coders.append(tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=table, special_tokens={}))
            self.starts.append(np.zeros(max(table.values()) + 1, bool))
            self.starts[-1][[rank for token, rank in table.items() if token.startswith(b" ")]] = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.get_piece_size())])

    def code(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Tokens of each word by each vocabulary, byte tokens of each word, and all tokens of the last rank file with their words' places."""
        plain = np.fromiter((len(w.split()) == 1 and not w[0].isspace() and not w[-1].isspace() for w in words), bool, len(words))
        joined, odd = "".join(" " + w for w, one in zip(words, plain.tolist(), strict=True) if one), [words[k] for k in np.flatnonzero(~plain)]
        order, counts = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), []
        for coder, starts in zip(self.coders, self.starts, strict=True):
            # no token crosses the space before a word, so words are encoded in one go; those with spaces beyond ASCII alone
            ids = np.array(coder.encode_ordinary(joined), np.int64)
            alone = [coder.encode_ordinary(" " + w) for w in odd]
            place = order[np.concatenate([np.cumsum(starts[ids]) - 1, np.repeat(np.arange(len(odd)), [len(x) for x in alone]) + plain.sum()]).astype(np.int64)]
            flat = np.concatenate([ids, np.fromiter(chain.from_iterable(alone), np.int64)])
            counts.append(np.bincount(place, minlength=len(words)))
        by_word = np.argsort(place, kind="stable")
        flat, place = flat[by_word], place[by_word]
        ids = self.pieces.encode(words, num_threads=1) if words else []
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        byte = self.is_byte[np.fromiter(chain.from_iterable(ids), np.int64)]
        fallback = np.bincount(np.repeat(np.arange(len(words)), n), weights=byte, minlength=len(words)).astype(np.int64)
        return [*counts, n], fallback, (flat, place)


@lru_cache(maxsize=2)
def tokens(ranks: tuple[str, ...], pattern: str, pieces: str) -> Tokens:
    return Tokens(ranks, pattern, pieces)


def default_vocabularies() -> tuple[tuple[str, ...], str, str]:
    """The installed byte-level rank files, their split pattern, and the piece model."""
    import public_tokenizers as own

    return (own.path("byte_bpe_50k.tiktoken"), own.path("byte_bpe_multi_50k.tiktoken")), own.PATTERN, own.path("piece_bpe_32k.model")


def script(text: str) -> str:
    """The script of most letters; ``none`` without letters."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), np.uint32)
    if not len(points):
        return "none"
    names = [name for _, name in _SCRIPTS]
    counts: dict[str, int] = defaultdict(int)
    for k, n in enumerate(np.bincount(np.searchsorted([at for at, _ in _SCRIPTS], points, side="right") - 1, minlength=len(names)).tolist()):
        counts[names[k]] += n
    return min(counts, key=lambda name: (-counts[name], name))


def repeated_words(texts: list[np.ndarray], width: int = 8) -> np.ndarray:
    """For each text, given as word ids from 0, its words inside stretches of ``width`` words that stand in it twice or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    row, doc = np.concatenate([np.zeros(0, np.int64), *texts]), np.repeat(np.arange(len(texts)), sizes)
    n = len(row) - width + 1
    if n < 1:
        return np.zeros(len(texts), np.int64)
    rank, step = row, 1  # rank tells equal stretches of step words
    while step < width:
        move = min(step, width - step)
        rank = pd.factorize(rank[:-move] * (int(rank.max()) + 1) + rank[move:])[0]
        step += move
    starts = np.flatnonzero(doc[:n] == doc[width - 1 :])
    which = pd.factorize(doc[starts] * (int(rank.max()) + 1) + rank[starts])[0]
    starts = starts[np.bincount(which, minlength=1)[which] > 1] if len(starts) else starts
    edges = np.bincount(starts, minlength=len(row) + 1) - np.bincount(starts + width, minlength=len(row) + 1)
    return np.bincount(doc, weights=np.cumsum(edges[:-1]) > 0, minlength=len(texts)).astype(np.int64)


def entropies(texts: list[np.ndarray], flat: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """Entropy in bits of each text's tokens; ``flat`` has the tokens of all words, ``place`` the word of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    doc, row = np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.zeros(0, np.int64), *texts])
    which, pairs = pd.factorize(doc * max(1, words) + row)
    times = np.bincount(which, minlength=len(pairs))
    doc, word = pairs // max(1, words), pairs % max(1, words)
    each = np.bincount(place, minlength=words)
    first = np.cumsum(each) - each
    n = each[word]
    at = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    which, pairs = pd.factorize(np.repeat(doc, n) * (1 << 32) + flat[at])
    c = np.bincount(which, weights=np.repeat(times, n), minlength=len(pairs))
    doc = pairs >> 32
    total = np.bincount(doc, weights=c, minlength=len(texts))
    spread = np.bincount(doc, weights=c * np.log2(np.maximum(c, 1)), minlength=len(texts))
    return np.maximum(0.0, np.log2(np.maximum(total, 1)) - spread / np.maximum(total, 1))


def measure(docs: DataFrame, vocabularies: tuple[tuple[str, ...], str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: (id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    chars_per_token, byte_share, entropy).

    ``vocabularies`` names rank files, their split pattern and a piece model; every executor must be able to read them.
    language is the row's own, or where null ``script:`` and the script of most letters. chars_per_token is an array: one
    value for each rank file, then the piece model. byte_share is of the piece model's tokens, entropy (bits) of the last
    rank file's. They are null where there are no tokens. Null texts are empty. Texts are read whole; of a long one
    memory holds the text, its ids and its distinct words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(*vocabularies)
        for batch in batches:
            for at, k in slices(batch.column("text"), TEXTS):
                texts = [t or b"" for t in binary(batch.column("text").slice(at, k))]
                table: defaultdict[bytes, int] = defaultdict()
                table.default_factory = table.__len__
                coded = [np.concatenate([np.array(list(map(table.__getitem__, part)), np.int64) for part in word_parts(t)]) for t in texts]
                counts, fallback, (flat, place) = own.code([w.decode() for w in table])
                n = np.array([len(x) for x in coded])
                chars = np.array([len(t.translate(None, _BLANK + _INNER)) for t in texts], np.int64)
                totals = np.array([[int(c[x].sum()) for c in (*counts, fallback)] for x in coded], np.int64)
                lines = ([x for x in t.split(b"\n") if x.strip()] for t in texts)
                some = totals[:, -2] > 0
                per = [[float(chars[d] / v) if v else None for v in totals[d, :-1].tolist()] for d in range(len(texts))]
                langs = [lang if lang is not None else "script:" + script(t.decode()) for lang, t in zip(batch.column("lang").slice(at, k).to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, k), pa.array(langs, pa.string()), pa.array(n, pa.int64()), pa.array(chars), pa.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], pa.int64()),
                        pa.array([len(x) - len(set(x)) for x in lines], pa.int64()), pa.array(repeated_words(coded), pa.int64()), pa.array(per, pa.list_(pa.float64())),
                        pa.array(totals[:, -1] / np.maximum(totals[:, -2], 1), mask=~some), pa.array(entropies(coded, flat, place, len(table)), mask=totals[:, -3] == 0),
                    ],
                    ["id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "byte_share", "entropy"],
                )

    kind = f"id {rows.schema['id'].dataType.simpleString()}, language string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars_per_token array<double>, byte_share double, entropy double"
    return rows.mapInArrow(measured, kind)


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    """Too few words, or too many of them in repeated stretches of eight."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def bands(measured: DataFrame, columns: dict[str, str], least: int = LEAST, spreads: float = SPREADS, slack: dict[str, float] = SLACK) -> DataFrame:
    """(language, length, low_<c>, high_<c> for each column): the usual range of each measure.

    ``columns`` maps a column of ``measured`` to the measure whose slack it has. length is the logarithm of n_words to
    base 2, rounded down, or -1 for all lengths together. Only documents that pass the base rules count, and equal ones
    (in all their measures) once, so that copies do not move a band. Ranges of fewer than ``least`` documents are left out.
    """
    length = F.floor(F.log2("n_words")).cast("int")
    once = measured.where(~base_failed()).select("language", "n_words", "word_chars", *columns).distinct()
    rows = once.withColumn("length", F.explode(F.array(length, F.lit(-1))))
    quartiles = [F.percentile(F.round(c, 4), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]
    out = rows.groupBy("language", "length").agg(F.count(F.lit(1)).alias("documents"), *quartiles).where(F.col("documents") >= least)

    def reach(c: str, kind: str) -> Column:
        words = F.pow(F.lit(2.0), F.when(F.col("length") >= 0, F.col("length")).otherwise(4))  # the fewest of this band
        near = (slack[kind] + 0.5 / F.sqrt(words)) * F.col(c)[1] if kind == "chars_per_token" else F.lit(slack[kind])
        return F.greatest(spreads / 1.349 * (F.col(c)[2] - F.col(c)[0]), near)

    low = [(F.col(c)[1] - reach(c, kind) if kind != "byte_share" else F.lit(float("-inf"))).alias(f"low_{c}") for c, kind in columns.items()]
    high = [(F.col(c)[1] + reach(c, kind) if kind != "entropy" else F.lit(float("inf"))).alias(f"high_{c}") for c, kind in columns.items()]
    return out.select("language", "length", *low, *high)


def fertility_rules(docs: DataFrame, vocabularies: tuple[tuple[str, ...], str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """``measure`` with base_failed, n_outside (bands that the document lies outside of) and kept, for every row of ``docs``.

    Characters per token may be neither too low nor too high, the byte share not too high, the entropy not too low. A
    language with few documents has no bands, and a null measure (no tokens) lies outside none: there the base rules
    decide alone. Null and empty texts have no words and fail them. An empty table stays empty.
    """
    measured = written(measure(docs, vocabularies, id_col, text_col, lang_col), "fertility")
    n = len(vocabularies[0]) + 1
    columns = {f"chars_{k}": "chars_per_token" for k in range(n)} | {"byte_share": "byte_share", "entropy": "entropy"}
    wide = measured.withColumns({f"chars_{k}": F.col("chars_per_token")[k] for k in range(n)} | {"length": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")})
    found = bands(wide, columns, least)
    all_lengths = found.where("length = -1").drop("length")
    all_lengths = all_lengths.toDF("language", *(f"any_{c}" for c in all_lengths.columns[1:]))
    judged = wide.join(found, ["language", "length"], "left").join(all_lengths, "language", "left")

    def outside(c: str) -> Column:
        out = (F.col(c) < F.coalesce(f"low_{c}", f"any_low_{c}")) | (F.col(c) > F.coalesce(f"high_{c}", f"any_high_{c}"))
        return F.coalesce(out, F.lit(False)).cast("int")

    failed = base_failed()
    judged = judged.withColumn("base_failed", failed).withColumn("n_outside", sum((outside(c) for c in columns), F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("n_outside") == 0)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_outside", "language", "chars_per_token", "byte_share", "entropy")
