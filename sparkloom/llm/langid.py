"""Language identification (operator 2): averaged hashed subword embeddings and a linear softmax, learned by SGD in numpy.

A text's subwords are its character n-grams in lower case, with a mark for word edges; each is hashed to a row of an
embedding table, and the average of these rows goes through a linear softmax. Fitting takes a bounded sample of labelled
rows. A part of the sample that takes no part in fitting sets the temperature of the softmax and the
score below which a prediction is rejected: the least score from which on enough predictions are right, within bounds that hold
whatever the labels are. A score is the probability of the language times the share of the text's subwords that were seen in fitting.

After fitting, average and softmax fold into one table of logits by bucket, so that prediction only looks up and sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import id_hash

UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class Settings:
    """sample: most labelled rows that are learned from, a fourth of them for calibration. steps: of SGD, at least; few rows
    are passed over more often. right: share of accepted predictions that must be right on the calibration rows. floor, margin: the score at this share of right
    calibration rows, times the margin, is rejected below in any case. spare: most right calibration rows that may be rejected, as a share."""

    sample: int = 3000
    buckets: int = 1 << 14
    widths: tuple[int, ...] = (2, 3)
    dims: int = 16
    epochs: int = 12
    steps: int = 1600
    batch: int = 16
    rate: float = 4.0
    seed: int = 7
    right: float = 0.99
    floor: float = 0.005
    margin: float = 0.9
    spare: float = 0.02


_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(texts: list[str | None], widths: tuple[int, ...], buckets: int):
    """(text number, bucket) of every subword, and how many letters each text has."""
    low = [(t or "").lower() for t in texts]
    chars = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low) + 1), [1, *[len(t) + 1 for t in low]]) - 1
    letter = _is_letter()[chars]
    c = np.where(letter, chars, np.uint32(1))
    owner, bucket = [], []
    for w in widths:
        n = len(c) - w + 1
        h = np.full(n, w, np.uint32)
        inner = letter[:n] | letter[w - 1 :]
        for j in range(w):
            h = (h ^ c[j : j + n]) * _FACTORS[j]
            if 0 < j < w - 1:
                inner = inner & letter[j : j + n]
        at = np.flatnonzero(inner)
        # An n-gram at the edge of a text takes the line end before or after it for a word edge; it belongs to its letters' text.
        owner.append(doc[at + 1] if w > 2 else np.where(letter[at], doc[at], doc[at + 1]))
        h = h[at]
        bucket.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (buckets.bit_length() - 1)))
    owner_all = np.concatenate(owner)
    return owner_all, np.concatenate(bucket).astype(np.int64), np.bincount(doc[letter], minlength=len(low)) if letter.any() else np.zeros(len(low), int)


@dataclass
class Model:
    """Logits by bucket, already divided by the temperature; `least` is the score below which a prediction is rejected; `seen` is 1 for
    buckets of subwords that were learned from."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    least: float
    settings: Settings
    seen: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return pred, score
        start = 0
        while start < len(texts):  # bounded memory: about a quarter of a million characters at once, or one text
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") < 250_000):
                size += len(texts[stop] or "")
                stop += 1
            part = texts[start:stop]
            owner, bucket, letters = subwords(part, self.settings.widths, self.settings.buckets)
            n = np.maximum(np.bincount(owner, minlength=len(part)), 1)
            z = np.stack([np.bincount(owner, weights=self.table[:, j][bucket], minlength=len(part)) for j in range(len(self.langs))], 1) / n[:, None] + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            known = np.bincount(owner, weights=self.seen[bucket], minlength=len(part)) / n
            for i in np.flatnonzero(letters):
                pred[start + i], score[start + i] = self.langs[best[i]], p[i, best[i]] * known[i]
            start = stop
        return pred, score


def _sample(df: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column | None, bound: int) -> DataFrame:
    """Labelled rows with the `bound` smallest hashes of their ids, and rows that tie with the last: picked on narrow columns."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    able = df.where((F.col(label_col).isNotNull() if learn is None else learn & F.col(label_col).isNotNull()) & F.col(text_col).isNotNull())
    edge = able.select(h.alias("h")).orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    rows = able.where(F.lit(False) if edge is None else h <= edge)
    return rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), h.alias("h"), F.xxhash64(text_col).alias("g"))


def train(sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, learned: np.ndarray, n_langs: int, settings: Settings, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias after stochastic gradient descent over the texts `learned`, given as (buckets, counts)."""
    emb = rng.normal(0, 0.1, (settings.buckets, settings.dims)).astype(np.float32)
    w, bias = np.zeros((settings.dims, n_langs), np.float32), np.zeros(n_langs, np.float32)
    per_epoch = max(1, -(-len(learned) // settings.batch))
    epochs = max(settings.epochs, -(-settings.steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        rng.shuffle(learned)
        for i in range(0, len(learned), settings.batch):
            which = learned[i : i + settings.batch]
            cols = np.unique(np.concatenate([sparse[j][0] for j in which]))
            x = np.zeros((len(which), len(cols)), np.float32)
            for r, j in enumerate(which):
                x[r, np.searchsorted(cols, sparse[j][0])] = sparse[j][1] / sparse[j][1].sum()
            own = emb[cols]
            hidden = x @ own
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            p *= settings.rate * (1 - done / steps) / len(which)
            emb[cols] = own - x.T @ (p @ w.T)
            w -= hidden.T @ p
            bias -= p.sum(0)
            done += 1
    return emb, w, bias


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", learn: Column | None = None, settings: Settings = Settings()) -> Model:
    """Learns from at most `settings.sample` rows of `df` for which `learn` holds. Subwords are counted on the executors, where the texts are; the driver
    gets at most `buckets` counts for a row. Rows without a label or text teach nothing; without any the model knows no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                found, times = np.unique(subwords([text], settings.widths, settings.buckets)[1], return_counts=True)
                out.append((found.astype("<u4").tobytes(), times.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["label", "h", "g", "found", "times"])

    rows = _sample(df, id_col, text_col, label_col, learn, settings.sample).mapInArrow(count, "label string, h long, g long, found binary, times binary").orderBy("h", "g").limit(settings.sample).collect()
    rows = sorted((r for r in rows if r.found), key=lambda r: (r.h, r.g))
    langs = sorted({r.label for r in rows})
    if not langs:
        return Model([], np.zeros((settings.buckets, 0)), np.zeros(0), 0.0, settings, np.zeros(settings.buckets))
    y = np.array([langs.index(r.label) for r in rows])
    sparse = [(np.frombuffer(r.found, "<u4").astype(int), np.frombuffer(r.times, "<f4")) for r in rows]

    def dense(which) -> np.ndarray:
        x = np.zeros((len(which), settings.buckets), np.float32)
        for i, j in enumerate(which):
            x[i, sparse[j][0]] = sparse[j][1] / sparse[j][1].sum()
        return x

    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(rows))
    held, learned = order[: len(rows) // 4], order[len(rows) // 4 :]
    seen = np.zeros(settings.buckets)
    for j in learned:
        seen[sparse[j][0]] = 1
    emb, w, bias = train(sparse, y, learned, len(langs), settings, rng)
    logits = emb @ w
    z = np.concatenate([dense(held[i : i + 64]) @ logits for i in range(0, len(held), 64)] or [np.zeros((0, len(langs)))]) + bias
    true = y[held]
    heat, least = 1.0, 0.0
    if len(held):

        def loss(t: float) -> float:
            s = z / t
            return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(true)), true]).mean())

        heat = min(np.geomspace(0.1, 10, 81), key=loss)
        s = z / heat
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = p.max(1) * np.array([(sparse[j][1] * seen[sparse[j][0]]).sum() / sparse[j][1].sum() for j in held])
        by = np.argsort(-top, kind="stable")
        hit = p.argmax(1) == true
        share = np.cumsum(hit[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(share >= settings.right)
        # Where all predictions together are right often enough, only those below the floor are rejected.
        least = 0.0 if len(good) and good[-1] == len(by) - 1 else float(top[by[good[-1]]]) if len(good) else 1.0
        if hit.any():
            own = np.sort(top[hit])
            least = min(max(least, float(own[int(settings.floor * len(own))]) * settings.margin), float(own[int(settings.spare * len(own))]))
    return Model(langs, np.ascontiguousarray(logits / heat).astype(np.float32), bias / heat, least, settings, seen)


def classify(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row. A text that is null or has no letter is `und` with score 0 and
    rejected; a very long text counts whole; equal scores go to the first language by name. Repeated rows and null ids give a row each; an empty
    table gives an empty one. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = model.predict(b.column(1).to_pylist())
            gone = [p == UNKNOWN or s < model.least for p, s in zip(pred, score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text is not rejected, with their columns. Null and empty texts and those without letters go; repeated rows are judged
    alike; ids are not looked at."""

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        pred, score = model.predict([None if t is None else t for t in texts])
        return pd.Series([p != UNKNOWN and s >= model.least for p, s in zip(pred, score, strict=True)])

    return df.where(accepted(text_col))


def held_out(id_col: str):
    """Rows kept for testing: crc32 of the id as text, mod 4, is 2."""
    return id_hash(F.col(id_col)) % 4 == 2


def learnable(id_col: str):
    return F.col(id_col).isNotNull() & ~held_out(id_col)
