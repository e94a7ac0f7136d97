"""Toxicity (operator 3): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows, as many toxic as clean ones where there are. Terms are all words of the sample in lower
case and their beginnings, so that inflected and compounded forms meet; none is left out. A term's weight is its inverse document
frequency, times a relevance between a small base and 1 that grows with its link to the toxic label beyond chance: texts in one language
share many words, and these must not outweigh the few that matter.

Examples are ordered by label and likeness and dealt into blocks; the index has each term's postings by block, and their greatest weight
there. A query's bound for a block is the sum of its weights times these. The blocks with the highest bounds are scored first, then all
whose bound reaches the k-th best cosine so far, so the neighbours are exact.

The neighbours' labels, toxic and clean, vote with weights that fall with distance. A logistic curve over the vote and the best cosine gives the
score. It is fitted on votes of examples over indexes, weights included, that were built without them and without their copies, classes weighted to
their true shares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import id_hash

WORD = re.compile(r"\w+")

#: Of each byte of Latin-1: itself in a word, else a space.
SPACED = bytes(i if WORD.match(chr(i)) else 32 for i in range(256))

#: Vectors that meet the unpacked lists in one product.
AT_ONCE = 64


@dataclass(frozen=True)
class Settings:
    """sample: most examples of each label. longest: characters of the longest text taken as an example. beginnings: lengths of word
    beginnings. base, full: relevance of a term without a link to the toxic label, and the log-likelihood ratio of such a link that counts in
    full. folds: parts for the fit of the curve. first: blocks scored before others are ruled out."""

    sample: int = 1500
    longest: int = 200_000
    beginnings: tuple[int, ...] = (5,)
    base: float = 0.05
    full: float = 20.0
    neighbours: int = 15
    block: int = 512
    first: int = 1
    folds: int = 3
    threshold: float = 0.7


def terms_of(word: str, beginnings: tuple[int, ...]) -> list[str]:
    return [word, *[word[:n] + "*" for n in beginnings if len(word) >= n]]


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case. Texts within Latin-1 go by a table, which gives the pattern's words in half the time."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and which range each is from."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + (start - (np.cumsum(n) - n))[owner], owner


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other, of `n` from `start`."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Index:
    """Block-max inverted index over unit vectors. `origin` says which vector each row is. A term's list is cut into runs, one for each block that
    it is in, with the run's greatest weight; lists that hold more than one in `full` of all rows are kept unpacked, a cell for each row."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, block: int, first: int = 1, full: int = 8):
        held = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, int)]).astype(int), minlength=n_terms)
        often = held * full > len(vectors)
        # Rows whose heaviest common term is the same are alike, as those in one language are.
        lead = [int(t[np.argmax(np.where(often[t], w, 0))]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (labels[i], lead[i], i))
        self.origin, self.labels, self.block, self.first = order, np.asarray(labels, float)[order], block, first
        self.n_blocks = max(1, -(-len(order) // block))
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, int)]).astype(int)
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        self.unpacked = np.where(often, np.cumsum(often) - 1, -1)
        self.cells = np.zeros((self.n_blocks * block, int(often.sum())))
        at = often[term]
        self.cells[row[at], self.unpacked[term[at]]] = weight[at]
        by = np.lexsort((row[~at], term[~at]))
        row, term, weight = row[~at][by], term[~at][by], weight[~at][by]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] // block != row[:-1] // block)])[: len(row)])
        self.row, self.weight = row, weight
        self.run_start = np.append(new, len(row))
        self.run_size = np.diff(self.run_start)
        self.run_block = row[new] // block
        self.run_most = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        self.term_start = np.searchsorted(term[new], np.arange(n_terms + 1))

    def unpacked_scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the unpacked lists add to the cosine of each vector with each row, up to rounding that may vary with the company."""
        asked = np.zeros((len(vectors), self.cells.shape[1] + 1))
        for own, (terms, weights) in zip(asked, vectors, strict=True):
            own[self.unpacked.take(terms)] = weights
        return asked[:, :-1] @ self.cells.T

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, unpacked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest with a cosine over 0, best first, ties by row; row `skip` takes no part. `unpacked` is the vector's
        row of `unpacked_scores`; it only picks blocks and rows, and cosines are summed anew, so they don't depend on what else is asked."""
        if unpacked is None:
            unpacked = self.unpacked_scores([(terms, weights)])[0]
        if skip >= 0:
            unpacked = unpacked.copy()
            unpacked[skip] = -np.inf
        cell = self.unpacked.take(terms)
        often = cell >= 0
        cell, cell_weight, terms, weights = cell[often], weights[often], terms[~often], weights[~often]
        first = self.term_start.take(terms)
        runs = self.term_start.take(terms + 1) - first
        run, weight = _ranges(first, runs), np.repeat(weights, runs)
        block = self.run_block.take(run)
        bound = unpacked.reshape(self.n_blocks, -1).max(1) + np.bincount(block, weights=weight * self.run_most.take(run), minlength=self.n_blocks)
        wave = np.zeros(self.n_blocks, bool)
        wave[np.argsort(-bound, kind="stable")[: self.first]] = True
        done, packed = np.zeros(self.n_blocks, bool), np.zeros(len(unpacked))
        while True:
            # No row's cosine is less than what it has so far.
            score = unpacked + packed
            floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
            wave &= (bound > 0) & (bound >= floor - 1e-9) & ~done
            if not wave.any():
                break
            if not wave.all():
                here = np.flatnonzero(wave.take(block))
                at, heavy = run.take(here), weight.take(here)
                start, n = self.run_start.take(at), self.run_size.take(at)
            else:
                start, heavy = self.run_start.take(first), weights
                n = self.run_start.take(first + runs) - start
            posting = _ranges(start, n)
            packed += np.bincount(self.row.take(posting), weights=self.weight.take(posting) * np.repeat(heavy, n), minlength=len(packed))
            done |= wave
            wave = ~done
        rows = np.flatnonzero(score >= max(floor - 1e-9, 1e-300))
        exact = packed[rows] + (cell_weight[:, None] * self.cells[rows, cell[:, None]]).sum(0)
        best = np.lexsort((rows, -np.round(exact, 12)))[:k]
        return rows[best], exact[best]


@dataclass
class Weights:
    """Terms' weights, learned from examples."""

    weight: np.ndarray
    settings: Settings

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w


def _weights(examples: list, labels: np.ndarray, share: np.ndarray, n_terms: int, settings: Settings) -> Weights:
    """Inverse document frequency times relevance; of copies, each counts for its share of one text."""
    held = np.zeros((2, n_terms))
    for (terms, _), y, s in zip(examples, labels, share, strict=True):
        held[int(y), terms] += s
    n = np.array([share[labels == y].sum() for y in (0, 1)])
    idf = np.log((1 + n.sum()) / (1 + held.sum(0))) + 1
    leaning = held[1] * n[0] > held[0] * n[1]
    link = np.where(leaning, _likelihood_ratio(held, np.maximum(n, 1e-9)), 0)
    return Weights(idf * (settings.base + (1 - settings.base) * np.minimum(1, link / settings.full) ** 2), settings)


def _likelihood_ratio(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each term: twice the log-likelihood ratio of the two labels' rates against one common rate."""

    def part(k, size, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (size - k) * np.log(1 - p)

    common = held.sum(0) / n.sum()
    return 2 * sum(part(held[i], n[i], held[i] / n[i]) - part(held[i], n[i], common) for i in (0, 1))


def _votes(index: Index, vectors: Iterable[tuple[np.ndarray, np.ndarray]], settings: Settings) -> Iterator[tuple[float, float, tuple[np.ndarray, np.ndarray]]]:
    """Of each vector: the vote in -1 to 1, the best cosine, and the neighbours."""
    for some in batched(vectors, AT_ONCE):
        for vector, unpacked in zip(some, index.unpacked_scores(some), strict=True):
            rows, sims = index.nearest(*vector, settings.neighbours, unpacked=unpacked)
            if not len(rows):
                yield 0.0, 0.0, (rows, sims)
                continue
            near = 1 / (1.05 - np.minimum(sims, 1))
            yield float((near * (2 * index.labels[rows] - 1)).sum() / near.sum()), float(sims[0]), (rows, sims)


def _inputs(vote: float, best: float) -> list[float]:
    return [1.0, vote, vote * best, float(best > 0)]


class Model:
    """`ids` and `labels` are the examples'; without examples of both labels there is no index, and every score is the same."""

    def __init__(self, vocabulary: dict[str, int], weights: Weights, index: Index | None, ids: list, curve: np.ndarray, settings: Settings):
        self.vocabulary, self.weights, self.index, self.curve, self.settings = vocabulary, weights, index, curve, settings
        self.ids = [ids[i] for i in index.origin] if index else []
        # Of each term that is a word, the terms of its beginnings; and beginnings apart, for words that are no terms.
        self.heads = {t: i for t, i in vocabulary.items() if t.endswith("*")}
        self.heads_of = np.array([[self.heads.get(t[:n] + "*", -1) if len(t) >= n and not t.endswith("*") else -1 for t in vocabulary] for n in settings.beginnings], int)

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and how often they stand in it."""
        counts = Counter(words_of(text))
        find, head = self.vocabulary.get, self.heads.get
        words = np.fromiter(map(find, counts, repeat(-1)), int, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        known = words >= 0
        strange = np.flatnonzero(~known)
        named = list(counts)
        # A word is no beginning, and beginnings of two lengths differ, so only those of one length can repeat.
        terms, often = [words[known]], [times[known]]
        for n, heads in zip(self.settings.beginnings, self.heads_of, strict=True):
            begun = heads[words]
            begun[strange] = [head(named[i][:n] + "*", -1) if len(named[i]) >= n else -1 for i in strange.tolist()]
            held = begun >= 0
            own, place = np.unique(begun[held], return_inverse=True)
            terms.append(own)
            often.append(np.bincount(place, weights=times[held], minlength=len(own)))
        terms, often = np.concatenate(terms), np.concatenate(often)
        by = np.argsort(terms)
        return terms[by], often[by]

    def calibrated(self, vote: float, best: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.array(_inputs(vote, best)) @ self.curve, -30, 30))))

    def scores(self, texts: Iterable[str | None]) -> Iterator[tuple[float, tuple[np.ndarray, np.ndarray]]]:
        """Of each text: its score, and its neighbours' rows and cosines."""
        if not self.index:
            yield from ((self.calibrated(0.0, 0.0), (np.zeros(0, int), np.zeros(0))) for _ in texts)
            return
        for vote, best, found in _votes(self.index, (self.weights.vector(*self.terms(t)) for t in texts), self.settings):
            yield self.calibrated(vote, best), found

    def score(self, text: str | None) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
        return next(self.scores([text]))


def _groups_of_copies(examples: list[np.ndarray], n_words: int, tries: int = 12, of: int = 8) -> np.ndarray:
    """The group of near copies that each example is in: those that agree in all word min-hashes of any try."""
    rng = np.random.default_rng(11)
    orders = [rng.permutation(n_words) for _ in range(tries * of)]
    group = list(range(len(examples)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    first: dict[tuple, int] = {}
    for i, words in enumerate(examples):
        if not len(words):
            continue
        low = [int(o[words].min()) for o in orders]
        for j in range(tries):
            key = (j, *low[j * of : j * of + of])
            group[root(i)] = root(first.setdefault(key, i))
    return np.array([root(i) for i in range(len(examples))], int)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, settings: Settings = Settings()) -> Model:
    """Learns from at most `settings.sample` labelled rows of either label for which `learn` holds, of at most `settings.longest` characters.
    Of repeated labels of an id the highest counts; an id with several texts gives an example for each. Rows with a null id, text or label
    teach nothing. Without examples of both labels, empty tables included, every score is the share of toxic ones. Ids may be of any type."""
    learn = F.lit(True) if learn is None else learn
    marked = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("long").alias("label"))
    shares = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    h = F.xxhash64(F.col("id").cast("string"))
    picked = [marked.where(F.col("label") == y).orderBy(h, "id").limit(settings.sample) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).withColumn("h", h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = ["\n".join(f"{w} {n}" for w, n in sorted(Counter(words_of(t)).items())) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(words, pa.string())], names=["id", "label", "h", "g", "words"])

    # The chosen ids are at most twice the sample, so this side is bounded.
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.where(F.length(text_col) <= settings.longest).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select(F.col("id"), "label", "h", F.xxhash64("text").alias("g"), "text")
    counted = texts.mapInArrow(count, f"id {kind}, label long, h long, g long, words string").dropDuplicates(["id", "g"])
    rows = counted.orderBy("h", "id", "g").limit(2 * settings.sample).collect()
    y = np.array([r.label for r in rows], int)
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 0.5) / (total + 1)
    base = np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
    if len(np.unique(y)) < 2:
        return Model({}, Weights(np.zeros(0), settings), None, [], base, settings)
    number: dict[str, int] = {}
    words = []
    for r in rows:
        pairs = [line.rsplit(" ", 1) for line in r.words.split("\n") if line]
        words.append((np.array([number.setdefault(w, len(number)) for w, _ in pairs], int), np.array([int(c) for _, c in pairs], float)))
    ids = [r.id for r in rows]
    del rows
    vocabulary: dict[str, int] = {}
    of_word = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(w, settings.beginnings)] for w in number]
    n_of, flat = np.array([len(x) for x in of_word], int), np.array([t for x in of_word for t in x], int)
    first = np.cumsum(n_of) - n_of
    examples = []
    for w, c in words:
        at, owner = _spread(first[w], first[w] + n_of[w])
        terms, place = np.unique(flat[at], return_inverse=True)
        examples.append((terms, np.bincount(place, weights=c[owner], minlength=len(terms))))
    group = _groups_of_copies([w for w, _ in words], len(number))
    alone = 1 / np.bincount(group, minlength=len(group))[group]

    def build(which: np.ndarray) -> tuple[Weights, Index]:
        own = [examples[i] for i in which]
        weights = _weights(own, y[which], alone[which], len(vocabulary), settings)
        return weights, Index([weights.vector(*e) for e in own], y[which], len(vocabulary), settings.block, settings.first)

    # A group of copies is in one fold as a whole.
    fold = np.random.default_rng(5).permutation(len(group))[group] % settings.folds
    x, target, weight = [], [], []
    for f in range(settings.folds):
        rest = np.flatnonzero(fold != f)
        if len(np.unique(y[rest])) < 2:
            continue
        weights, index = build(rest)
        own = np.flatnonzero(fold == f)
        for i, (vote, best, _) in zip(own, _votes(index, (weights.vector(*examples[i]) for i in own), settings), strict=True):
            x.append(_inputs(vote, best))
            target.append(y[i])
            weight.append((prior if y[i] else 1 - prior) * alone[i] / alone[y == y[i]].sum())
    curve = base
    if x and len(set(target)) > 1:
        curve = _logistic(np.array(x), np.array(target, float), np.array(weight) / np.sum(weight) * len(weight), base)
    weights, index = build(np.arange(len(y)))
    return Model(vocabulary, weights, index, ids, curve, settings)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a weighted logistic regression with a ridge, each halved until the loss falls."""

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (c * c).sum())

    curve, now = start.copy(), loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (p - y)) + ridge * curve)
        size = 1.0
        while size > 1e-6 and loss(curve - size * step) > now:
            size /= 2
        if size <= 1e-6 or now - loss(curve - size * step) < 1e-9:
            break
        curve = curve - size * step
        now = loss(curve)
    return curve


def classify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence) for each row; evidence lists the nearest examples with id, label and cosine.

    A null or empty text, or one without known terms, has no neighbours and gets the score that such examples have. A very
    long text counts whole; equal cosines go to the example that comes first in the index. Repeated rows and null ids give a row each;
    an empty table gives an empty one. Other columns are not read.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = model.index.labels.astype("int32") if model.index else np.zeros(0, "int32")
        for b in batches:
            ids = pa.array(model.ids, b.schema.field(0).type)
            scores, rows, sims = [], [np.zeros(0, int)], [np.zeros(0)]
            for s, (r, c) in model.scores(b.column(1).to_pylist()):
                scores.append(s)
                rows.append(r)
                sims.append(c)
            at, flat = np.cumsum([len(r) for r in rows]), np.concatenate(rows)
            near = pa.StructArray.from_arrays([ids.take(pa.array(flat)), pa.array(toxic[flat]), pa.array(np.concatenate(sims))], names=["doc_id", "toxic", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(at, pa.int32()), near)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= model.settings.threshold) for s in scores], pa.int32()), evidence], names=["doc_id", "score", "predicted", "evidence"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},toxic:int,cosine:double>>")


def held_out(id_col: str):
    """Rows kept for testing: crc32 of the id as text, mod 3, is 1."""
    return id_hash(F.col(id_col)) % 3 == 1
