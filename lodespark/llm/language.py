"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained in numpy on the driver, by backpropagation through time, on windows of a bounded sample of
labelled documents; the bound is ``SAMPLE`` documents a language and does not grow. Prediction runs in tasks: a text is
cut into windows of ``WINDOW`` bytes that cover all of it, both directions read each window, every byte gets
probabilities of the languages, and a document's probabilities are the means over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from lodespark.llm.common import slices

#: Units of a direction, bytes of a window, windows that are read together.
HIDDEN, WINDOW, TOGETHER = 8, 256, 4096
#: Bytes of texts that are predicted together.
TEXTS = 2 << 20
#: Training: documents a language, bytes of one document that may serve, steps, windows and bytes of a step.
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, SPAN = 600, 1500, 260, 192, 48
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text can be divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One gated recurrent unit: the gates' input sums are rows of a table, one for each byte."""

    def __init__(self, rng: np.random.Generator, h: int = HIDDEN):
        self.h = h
        self.p = {"e": rng.normal(0, 0.5, (256, 3 * h)), "u": rng.normal(0, h**-0.5, (h, 2 * h)), "v": rng.normal(0, h**-0.5, (h, h))}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each byte of x (windows, bytes), and what the way back needs."""
        h, (n, t) = self.h, x.shape
        state, states, kept = np.zeros((n, h)), np.empty((t, n, h)), []
        for k in range(t):
            a = self.p["e"][x[:, k]]
            gates = _sigmoid(a[:, : 2 * h] + state @ self.p["u"])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * state) @ self.p["v"])
            kept.append((state, z, r, c))
            state = state + z * (c - state)
            states[k] = state
        return states, kept

    def backward(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        h, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        d_a = np.empty((x.shape[1], x.shape[0], 3 * h))
        d = np.zeros_like(d_states[0])
        for k in range(x.shape[1] - 1, -1, -1):
            before, z, r, c = kept[k]
            d = d + d_states[k]
            d_c = d * z * (1 - c * c)
            d_z = d * (c - before) * z * (1 - z)
            through = d_c @ self.p["v"].T
            d_r = through * before * r * (1 - r)
            g["v"] += (r * before).T @ d_c
            d_gates = np.concatenate([d_z, d_r], 1)
            g["u"] += before.T @ d_gates
            d = d * (1 - z) + through * r + d_gates @ self.p["u"].T
            d_a[k, :, : 2 * h], d_a[k, :, 2 * h :] = d_gates, d_c
        np.add.at(g["e"], x.T.ravel(), d_a.reshape(-1, 3 * h))
        return g


class Model:
    """Two directions and a softmax layer over the languages."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.ways = languages, [Direction(rng), Direction(rng)]
        self.out = {"w": rng.normal(0, 0.2, (2 * HIDDEN, len(languages))), "b": np.zeros(len(languages))}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        (fs, fk), (bs, bk) = self.ways[0].forward(x), self.ways[1].forward(x[:, ::-1])
        states = np.concatenate([fs, bs[::-1]], 2)
        logits = states @ self.out["w"] + self.out["b"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows = np.arange(len(y))
        loss = -np.log(p[:, rows, y] + 1e-12).mean()
        p[:, rows, y] -= 1
        p /= p.shape[0] * p.shape[1]
        flat = p.reshape(-1, p.shape[2])
        d = p @ self.out["w"].T
        own = {"w": states.reshape(-1, 2 * HIDDEN).T @ flat, "b": flat.sum(0)}
        return loss, [self.ways[0].backward(x, fk, d[:, :, :HIDDEN]), self.ways[1].backward(x[:, ::-1], bk, d[::-1, :, HIDDEN:]), own]

    def train(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> float:
        """Adam over random batches of the windows (rows of SPAN bytes); returns the last loss."""
        rng, groups, loss = np.random.default_rng(seed), [self.ways[0].p, self.ways[1].p, self.out], 0.0
        m, v = ([{k: np.zeros_like(a) for k, a in g.items()} for g in groups] for _ in range(2))
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
            pick = np.concatenate([rng.choice(i, max(1, BATCH // len(by))) for i in by])
            loss, grads = self.gradients(windows[pick], y[pick])
            for g, d, a, b in zip(groups, grads, m, v, strict=True):
                for k in g:
                    a[k] += 0.1 * (d[k] - a[k])
                    b[k] += 0.01 * (d[k] * d[k] - b[k])
                    g[k] -= rate * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-8)
        for g in groups:
            for k in g:
                g[k] = g[k].astype(np.float32)
        return float(loss)

    def _read(self, way: Direction, windows: np.ndarray, lengths: np.ndarray, into: np.ndarray) -> None:
        """Adds a direction's part of every byte's logits to ``into`` (bytes, windows, languages); windows are in falling order of length."""
        h, e, u, v = way.h, way.p["e"], way.p["u"], way.p["v"]
        w = self.out["w"][:HIDDEN] if way is self.ways[0] else self.out["w"][HIDDEN:]
        alive = np.searchsorted(-lengths, -np.arange(windows.shape[0]), side="left")  # windows longer than k
        state = np.zeros((len(lengths), h), np.float32)
        for k in range(windows.shape[0]):
            n = alive[k]
            a, s = e.take(windows[k, :n], axis=0), state[:n]
            gates = _sigmoid(s @ u + a[:, : 2 * h])
            c = (gates[:, h:] * s) @ v
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            c -= s
            c *= gates[:, :h]
            s += c
            into[k, :n] += s @ w

    def positions(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean probabilities over the bytes of each window (start, length) of a buffer, windows in falling order of length."""
        t = int(lengths[0])
        at = np.arange(t)[:, None]
        inside = at < lengths
        forward = buffer[np.minimum(starts + at, len(buffer) - 1)]
        back = buffer[np.maximum(starts + lengths - 1 - at, 0)]
        logits = np.zeros((t, len(lengths), len(self.languages)), np.float32)
        logits += self.out["b"]
        self._read(self.ways[0], forward, lengths, logits)
        reverse = np.zeros_like(logits)
        self._read(self.ways[1], back, lengths, reverse)
        # byte j of a window is step length - 1 - j of the way back
        logits += reverse[np.maximum(lengths - 1 - at, 0), np.arange(len(lengths))]
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        logits *= inside[:, :, None]
        return logits.sum(0)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text; an empty text has zeros."""
        sizes = np.array([len(t) for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        n = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        starts = (np.cumsum(sizes) - sizes)[doc] + piece * WINDOW
        lengths = np.minimum(WINDOW, sizes[doc] - piece * WINDOW)
        order = np.argsort(-lengths, kind="stable")
        for k in range(0, len(order), TOGETHER):
            part = order[k : k + TOGETHER]
            np.add.at(total, doc[part], self.positions(buffer, starts[part], lengths[part]))
        return total / np.maximum(sizes, 1)[:, None]


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages of labelled rows that are not held out; None if there are none.

    About ``sample`` documents of each language serve, chosen by a hash of the id, with a window of at most SAMPLE_BYTES
    characters of each that begins anywhere in the text, by the text's hash. The driver gets at most ``4 * sample`` short
    strings a language, whatever the table's size and however often an id repeats.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES + 1)).cast("int")
    windows_of = chosen.select("lang", "id", F.substring(F.col("text"), start, F.lit(SAMPLE_BYTES)).alias("text"))
    got = sorted((r.lang, r.id, r.text) for r in windows_of.limit(4 * sample * len(counts)).collect())
    languages = sorted(counts)
    windows, y = [], []
    for lang, _, text in got:
        data = np.frombuffer(text.encode(), np.uint8)
        for k in range(0, len(data) - SPAN + 1, SPAN):
            windows.append(data[k : k + SPAN])
            y.append(languages.index(lang))
        if 0 < len(data) < SPAN:
            windows.append(np.resize(data, SPAN))
            y.append(languages.index(lang))
    model = Model(languages)
    y = np.array(y)
    if len(languages) == 1 or not len(y) or any(not (y == k).any() for k in range(len(languages))):
        present = sorted({languages[k] for k in y.tolist()}) or languages[:1]
        y = np.array([present.index(languages[k]) for k in y.tolist()])
        model = Model(present)
    if len(model.languages) > 1:
        model.train(np.stack(windows), y)
    else:
        model.train(np.stack(windows) if windows else np.zeros((1, SPAN), np.uint8), y if len(y) else np.zeros(1, int), steps=1)
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def predict_languages(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (``und`` for null texts and texts without a letter) and score (0 to 1) to every row of ``docs``.

    The score is the predicted language's mean probability over all bytes; 0 for ``und``. Columns of these names are
    replaced. Without a model every row is ``und``. Long texts are cut into windows, which are read in batches of fixed
    size, so memory does not grow with a text's length beyond the text itself.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            for at, n in slices(column, TEXTS):
                part = batch.slice(at, n)
                texts = part.column(text_col).to_pylist()
                known = [has_letter(t) and model is not None for t in texts]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if any(known):
                    p = model.predict([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
                    best = p.argmax(1)
                    for k in np.flatnonzero(known):
                        names[k], scores[k] = model.languages[best[k]], min(1.0, p[k, best[k]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    return rows.mapInArrow(predict, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows, with their own columns only, whose language is not ``und``; columns called lang_pred or score survive."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    known = predict_languages(plain, model, f"c{docs.columns.index(text_col)}").where(F.col("lang_pred") != "und")
    return known.drop("lang_pred", "score").toDF(*docs.columns)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``, by a model learnt from its rows that are not held out."""
    model = train_on(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict_languages(rows, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
