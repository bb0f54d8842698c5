"""Byte-level BPE by dynamic programming over prefixes.

The merges of BPE leave exactly one token sequence for a byte string, and that of a prefix is found by its last token
alone: the one token that ends the prefix, and whose seam with the last token of what stands before it no merge would
cross. ``PrefixCoder`` stores that last token for each prefix, so bytes can be appended exactly, and an edit only
recodes what follows it until the stored tokens agree again. Texts are split into words first; a task keeps the ids of the words it has
met in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lodespark.llm.common import slices

#: Words and seams that a worker keeps; a full table becomes the old one, from which words still in use return.
KEPT_WORDS, KEPT_SEAMS = 300_000, 250_000
#: Bytes of texts that are encoded together.
TEXTS = 1 << 20


class Vocabulary:
    """Token bytes by id, and for each token the two that its bytes merge from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.tokens = {i: t for t, i in ranks.items()}
        self.matches = ahocorasick.Automaton()  # gives the tokens that end at each byte, longest first
        for t, i in ranks.items():
            self.matches.add_word(t.decode("latin-1"), (i, len(t)))
        self.matches.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and len(two := self._merged(t, i)) == 2:
                self.halves[i] = two
                self.joined[two] = i
        self.seams: dict[tuple[int, int], bool] = {}
        self.size = {i: len(t) for i, t in self.tokens.items()}

    def _merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """The tokens that merges of a lower rank than ``below`` leave of the bytes."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def seam(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart where they meet.

        The facing edges are unrolled from the last merge to the first. A merge over the seam of lower rank than every
        merge that would have hidden one of its two sides by then comes first, and breaks the pair up.
        """
        if len(self.seams) > KEPT_SEAMS:
            self.seams.clear()
        apart = self.seams[left, right] = self._apart(left, right)
        return apart

    def _apart(self, left: int, right: int) -> bool:
        # Time runs backwards: at each step the edge token that was made last is taken apart. ``hidden`` is the rank at
        # which the present pair stopped facing each other, for a merge of equal rank the left one happens first.
        a, b, hidden = left, right, 1 << 62
        while True:
            if self.joined.get((a, b), hidden) < hidden:
                return False
            made_a = a if a in self.halves else -1
            made_b = b if b in self.halves else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                hidden, a = made_a, self.halves[a][1]
            else:
                hidden, b = made_b + 1, self.halves[b][0]


    def code(self, data: bytes) -> list[int]:
        """Ids of bytes that nothing will be appended to: the last tokens of all prefixes, in one loop."""
        last, seams, want = [-1], self.seams, 0
        for at, (token, n) in self.matches.iter(data.decode("latin-1")):
            if at != want:  # this prefix has its token, or one before it has none
                continue
            if n <= at:
                key = (last[at + 1 - n], token)
                if not (self.seam(*key) if (apart := seams.get(key)) is None else apart):
                    continue
            last.append(token)
            want += 1
        if len(last) <= len(data):
            raise ValueError("the vocabulary lacks a byte")
        out, end, size = [], len(data), self.size
        while end:
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class PrefixCoder:
    """The unique last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for _ in self._tokens(len(self.last) - 1):
            pass
        if len(self.last) <= len(self.data):
            raise ValueError("the vocabulary lacks a byte")

    def _tokens(self, done: int) -> Iterator[int]:
        """Adds the last tokens of the prefixes longer than ``done``, and gives each prefix's length once it has one."""
        last, seams, seam = self.last, self.v.seams, self.v.seam
        back = max(0, done - self.v.longest)
        for at, (token, n) in self.v.matches.iter(self.data[back:].decode("latin-1")):
            end = back + at + 1
            if end == len(last):
                if n < end:
                    apart = seams.get((last[end - n], token))
                    if not (seam(last[end - n], token) if apart is None else apart):
                        continue
                elif n > end:
                    continue
                last.append(token)
                yield end

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts ``data`` in place of bytes start..stop; returns how many prefixes were coded anew.

        Prefixes up to ``start`` keep their tokens. Once as many prefixes in a row as the longest token has bytes end
        in the tokens they had before, all later ones do too: a token only depends on that many before it.
        """
        old, tail = self.last, len(self.data) - stop
        self.data[start:stop] = data
        self.last, agree, done, moved = old[: start + 1], 0, 0, len(self.data) + 1 - len(old)
        for end in self._tokens(start):
            done += 1
            agree = agree + 1 if end > len(self.data) - tail and self.last[end] == old[end - moved] else 0
            if agree >= self.v.longest:
                self.last += old[end + 1 - moved :]
                break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.tokens[self.last[end]])
        return out[::-1]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Encodes and decodes whole texts; ids of words it has met are kept as packed little-endian integers."""

    def __init__(self, path: str, pattern: str):
        self.v, self.pattern = vocabulary(path), regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by what follows a single space
        self.old: dict[str, dict[str, bytes]] = {"kept": {}, "spaced": {}}
        self.bytes_of = pa.array([self.v.tokens.get(i, b"") for i in range(max(self.v.tokens) + 1)], pa.large_binary())

    def word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        if (whole := self.v.ranks.get(data)) is not None:
            return whole.to_bytes(4, "little")
        return array("I", self.v.code(data)).tobytes()

    def run(self, text: str) -> bytes:
        """Ids of a text in which any match may begin."""
        out = []
        for w in self.pattern.findall(text):
            name, key = ("spaced", w[1:]) if w[0] == " " and len(w) > 1 and not w[1].isspace() else ("kept", w)
            if (ids := getattr(self, name).get(key)) is None:
                if (ids := self.old[name].get(key)) is None:
                    ids = self.word(w)
                self._keep(name, key, ids)
            out.append(ids)
        return b"".join(out)

    def _keep(self, name: str, key: str, ids: bytes) -> None:
        where = getattr(self, name)
        if len(where) >= KEPT_WORDS:
            self.old[name], where = where, {}
            setattr(self, name, where)
        if len(key) < 100:
            where[key] = ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, cut at single spaces between two characters that are not white space: a new word starts there in any case."""
        first, *rest = text.split(" ")
        parts = list(map(self.spaced.get, rest))
        if None in parts:
            for at, ids in enumerate(parts):
                if ids is None:
                    chunk = rest[at]
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace():  # such chunks are never kept
                        return self.run(text)
                    if (ids := self.old["spaced"].get(chunk)) is None:
                        ids = self.run(" " + chunk)
                    parts[at] = ids
                    self._keep("spaced", chunk, ids)
        if rest and first and first[-1].isspace():
            return self.run(text)
        return self.run(first) + b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        _, ends, data = self.bytes_of.take(pa.array(np.frombuffer(ids, "<u4"))).buffers()
        return data.slice(0, int(np.frombuffer(ends, np.int64)[len(ids) // 4])).to_pybytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ids (binary: unsigned 32-bit little-endian) and decoded (binary: the bytes of those ids) to every row.

    ``path`` names a rank file that every executor can read. Null texts are empty: no ids, no bytes. Rows, their order
    and their other columns stay as they are; columns called ids or decoded are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at, n in slices(batch.column(text_col), TEXTS):
                part = batch.slice(at, n)
                ids = [own.encode(t) if t else b"" for t in part.column(text_col).to_pylist()]
                arrays = [*part.columns, pa.array(ids, pa.large_binary()), pa.array([own.decode(x) for x in ids], pa.large_binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "ids", "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(code, StructType([*kept, StructField("ids", BinaryType()), StructField("decoded", BinaryType())]))


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids and decoded bytes of ``encode_texts`` as digests, made where they arise."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at, rows_ in slices(batch.column("text"), TEXTS):
                n, a, b = [], [], []
                for text in batch.column("text").slice(at, rows_).to_pylist():
                    ids = own.encode(text) if text else b""
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, rows_), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(digest, kind).withColumnRenamed("id", id_col)


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
