"""Where in a text a statement is best supported: verbatim, or by the longest stretch that both share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


class Stretches:
    """Suffix automaton of a statement: reading a text through it gives the longest common stretch in time linear in both."""

    def __init__(self, statement: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in statement:
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def longest(self, text: str) -> tuple[int, int]:
        """(start, length) of the longest stretch of ``text`` that the statement has; of equals the first."""
        state = size = best = end = 0
        for at, ch in enumerate(text):
            while state and ch not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if ch in self.next[state]:
                state, size = self.next[state][ch], size + 1
            if size > best:
                best, end = size, at + 1
        return end - best, best


def sentence_at(text: str, offset: int) -> int:
    """Number, from 0, of the sentence that holds an offset; white space after a sentence counts to the last one of the text."""
    spans, start = [], 0
    for found in _SENTENCE_END.finditer(text):
        if found.start() > start:
            spans.append((start, found.start()))
        start = found.end()
    if start < len(text):
        spans.append((start, len(text)))
    return next((k for k, (a, b) in enumerate(spans) if a <= offset < b), max(len(spans) - 1, 0))


def locate(text: str, statement: str, least: float = 0.6) -> tuple[int, int, int, str, float] | None:
    """(start, end, sentence, method, score) of a statement's support in a text, or None; offsets are of the lower-case text."""
    low, wanted = text.lower(), statement.lower().strip()
    if not low or not wanted:
        return None
    at = low.find(wanted)
    if at >= 0:
        return at, at + len(wanted), sentence_at(text, at), "exact", 1.0
    at, size = Stretches(wanted).longest(low)
    if not size or size / len(wanted) < least:
        return None
    return at, at + size, sentence_at(text, at), "fuzzy", round(size / len(wanted), 3)


def locate_spans(pairs: DataFrame, least: float = 0.6, text_col: str = "text", statement_col: str = "statement") -> DataFrame:
    """The rows of ``pairs`` whose statement has support in their text, with char_start, char_end, sentence_id, match_method
    and match_score in place of the two texts.

    A statement that the text holds verbatim, case ignored, is ``exact``. Otherwise the longest stretch that both share
    counts if it is at least ``least`` of the statement (``fuzzy``, score rounded to 3 places); of equal ones the first in
    the text. Rows with a null or empty text or statement have no support. Columns with the new names are replaced.
    """
    added = [StructField("char_start", LongType()), StructField("char_end", LongType()), StructField("sentence_id", LongType()), StructField("match_method", StringType()), StructField("match_score", DoubleType())]
    kept = [f for f in pairs.schema.fields if f.name.lower() not in {a.name for a in added} | {text_col.lower(), statement_col.lower()}]
    text, statement = F.col(f"`{text_col}`"), F.col(f"`{statement_col}`")
    rows = pairs.where((F.length(text) > 0) & (F.length(F.trim(statement)) > 0))
    rows = rows.select(*(F.col(f"`{f.name}`") for f in kept), text.alias("char_start"), statement.alias("char_end"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            found = [locate(x.as_py(), y.as_py(), least) for x, y in zip(a, b, strict=True)]
            at = [k for k, f in enumerate(found) if f]
            data = [pa.array([found[k][j] for k in at], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:-2]), *data], [*(f.name for f in kept), *(f.name for f in added)])

    return rows.mapInArrow(find, StructType([*kept, *added]))
