"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and weights of lexicon words and word beginnings, how near they stand to
second-person words, capitals, punctuation, and the rate of obfuscated spellings (digits and signs are
read as the letters they stand for before any look-up). The lexicon, the trees and the calibration are
learned here from labelled rows; the label, the language, the source and the id are never features.

Learning takes at most ``SAMPLE`` labelled rows (a documented bound; the rows with the least hash of
their id). Half of them give the lexicon, the others the trees and, apart from those, the calibration;
halves are dealt by text, so that copies of a document do not teach the lexicon what the trees are fitted to.
Scoring takes every row and its whole text.

Defined cases: null and empty texts are scored as texts without words; without labelled rows, or with
one label only, every score is the share of that label (0 without rows); repeated rows score alike;
labels that are null are left out; a document with several label rows is toxic if one says so; a score that
ties with the threshold is predicted toxic; null ids stay null and are not held out; an empty table of
documents gives an empty result; other columns are ignored. What is held of a text is about 100 bytes for
each of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

SAMPLE = 24_000
LEXICON = 4096
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
NEAR = 8
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 64

#: Second-person words of the languages at hand.
SECOND_PERSON = (
    "you your yours yourself u ur thou du dich dir dein deine deinen euch ihr sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro"
).split()
#: Signs and digits, and the letters that they stand for.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_FOLD = tb.LOWER.copy()
for _a, _b in LOOKALIKE.items():
    _FOLD[ord(_a)] = ord(_b)
_MEMBER = tb.table_of(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 or chr(b) in "@$")
_SIGN = tb.table_of(lambda b: 48 <= b <= 57 or chr(b) in "@$")
_UPPER = tb.table_of(lambda b: 65 <= b <= 90)
_ALPHA = tb.table_of(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)
_PUNCT = tb.table_of(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_KINDS = np.array([tb.mix(np.array([k + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03))[0] for k in range(8)])


def held_out(doc_id: str) -> bool:
    return zlib.crc32(doc_id.encode()) % 4 == 2


def keys(data: np.ndarray, offsets: np.ndarray):
    """Words of a buffer and, for the whole word and each beginning, its key and the word's number."""
    starts, ends, rows = tb.words(data, offsets, _MEMBER)
    folded = _FOLD[data]
    numbers = np.arange(len(starts))
    out = [(tb.mix(tb.span_hashes(folded, starts, ends) + _KINDS[0]), numbers)]
    for k, size in enumerate(PREFIXES, 1):
        long = numbers[ends - starts > size]
        out.append((tb.mix(tb.span_hashes(folded, starts[long], starts[long] + size) + _KINDS[k]), long))
    return starts, ends, rows, out


class Lexicon:
    """Keys with their weights; a bit table answers most look-ups."""

    def __init__(self, pairs: list[tuple[int, float]]):
        pairs = sorted(pairs)
        self.keys = np.array([k for k, _ in pairs], np.int64).view(np.uint64)
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], np.array([w for _, w in pairs], float)[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.keys & np.uint64(0x3FFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hits, weights)."""
        at = np.flatnonzero(self.bits[hashes & np.uint64(0x3FFFF)])
        if not len(at):
            return at, np.empty(0)
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[at]
        return at[hit], self.weights[place[hit]]


_PERSON_TEXT = " ".join(SECOND_PERSON).encode()


def _person_keys() -> np.ndarray:
    data = np.frombuffer(_PERSON_TEXT, np.uint8)
    return np.sort(keys(data, np.array([0, len(data)]))[3][0][0])


_PERSON = Lexicon([(int(k), 1.0) for k in _person_keys().view(np.int64)])


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Dense features, one row for each text."""
    n = len(offsets) - 1
    starts, ends, rows, found = keys(data, offsets)
    bounds = tb.row_bounds(rows, n)
    size = np.diff(bounds).astype(float)
    safe = np.maximum(size, 1)
    length = np.maximum(np.diff(offsets), 1).astype(float)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def words_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[ends] - total[starts]

    weight = np.zeros(len(starts))
    whole = np.zeros(len(starts), bool)
    begun = np.zeros(len(starts), bool)
    for k, (hashes, numbers) in enumerate(found):
        at, w = lexicon.find(hashes)
        np.maximum.at(weight, numbers[at], w)
        (begun if k else whole)[numbers[at]] = True
    hit = whole | begun
    person = np.zeros(len(starts), bool)
    person[_PERSON.find(found[0][0])[0]] = True
    places = np.flatnonzero(person)
    near = np.zeros(len(starts), bool)
    hits = np.flatnonzero(hit)
    if len(places) and len(hits):
        right = np.minimum(np.searchsorted(places, hits), len(places) - 1)
        for at in (places[right], places[np.maximum(right - 1, 0)]):
            near[hits[(np.abs(at - hits) <= NEAR) & (rows[at] == rows[hits])]] = True
    top = np.zeros(n)
    np.maximum.at(top, rows[hits], weight[hits])
    total = np.bincount(rows[hits], weights=weight[hits], minlength=n)
    alpha, signs, upper = inside(_ALPHA[data]), inside(_SIGN[data]), inside(_UPPER[data])
    odd = (alpha > 1) & (signs > 0)
    letters = np.maximum(bytes_in(_ALPHA[data]), 1)
    columns = [
        words_in(whole) / safe, words_in(begun) / safe, np.log1p(words_in(whole)), np.log1p(words_in(hit)),
        top, total, total / np.sqrt(safe), np.log1p(words_in(near)), words_in(near) / safe, words_in(person) / safe,
        bytes_in(_UPPER[data]) / letters, words_in((upper > 1) & (upper == ends - starts)) / safe,
        bytes_in(data == 33) / length, bytes_in(data == 63) / length, bytes_in(_PUNCT[data]) / length,
        words_in(odd) / safe, words_in(odd & hit) / safe, np.log1p(size), (letters / safe),
    ]
    return np.stack(columns, axis=1)


class Trees:
    """Gradient-boosted trees for a yes-or-no label: histogram splits, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6)))
            raw += RATE * self._leaf(self.trees[-1], binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    @staticmethod
    def _grow(binned, gradient, curvature):
        """Heap-ordered nodes (feature, bin, value); a leaf above the last level is split on nothing."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut_at, value = np.zeros(size, int), np.full(size, BINS + 1), np.zeros(size)
        node = np.zeros(len(gradient), int)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            g, h = gradient[rows].sum(), curvature[rows].sum()
            value[k] = -g / (h + 1)
            if k >= 2**DEPTH - 1 or len(rows) < 40:
                # Rows of an early leaf go down to the left, each time with the same value.
                if k < 2**DEPTH - 1:
                    node[rows] = 2 * k + 1
                continue
            best = (1e-6, 0, BINS + 1)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, gradient[rows], BINS + 1))[:-1]
                hl = np.cumsum(np.bincount(b, curvature[rows], BINS + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < 1) | (h - hl < 1)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
            feature[k], cut_at[k] = best[1], best[2]
            node[rows] = np.where(binned[rows, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return feature, cut_at, value

    @staticmethod
    def _leaf(tree, binned):
        feature, cut_at, value = tree
        node = np.zeros(len(binned), int)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            node = np.where(binned[rows, feature[node]] <= cut_at[node], 2 * node + 1, 2 * node + 2)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + RATE * sum(self._leaf(t, binned) for t in self.trees)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, shares of the label), both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order]):
        blocks.append([float(y), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


class Model:
    """Lexicon, trees and calibration; a constant where there was nothing to learn."""

    def __init__(self, lexicon: Lexicon | None, x: np.ndarray | None, y: np.ndarray | None, constant: float = 0.0):
        self.lexicon, self.trees, self.constant = lexicon, None, constant
        if lexicon is None or x is None or len(set(y.tolist())) < 2:
            return
        apart = np.arange(len(y)) % 10 < 3
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart = np.ones(len(y), bool)
        train = ~apart if not apart.all() else apart
        self.trees = Trees(x[train], y[train])
        self.at, self.share = isotonic(self.trees.raw(x[apart]), y[apart])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.constant)
        raw = self.trees.raw(features(data, offsets, self.lexicon))
        # A small share of the uncalibrated score keeps the order within a calibrated step.
        return np.clip(0.99 * np.interp(raw, self.at, self.share) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled documents outside the held-out fold, with a column ``half``."""
    rank = F.xxhash64("label_id", F.lit(29))
    fold = F.crc32(F.col("label_id").cast("string")) % 4
    some = (
        labels.where(F.col("toxic").isNotNull() & F.col("label_id").isNotNull() & (fold != 2))
        .groupBy("label_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(rank, "label_id").limit(size)
    )
    # The sample is bounded by ``size``, whatever the input, so it may be broadcast.
    joined = docs.join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))
    return joined.select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("text", F.lit(29)), F.lit(2)) == 0).alias("half"))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The model from documents (doc_id, text) and labels (label_id, toxic)."""
    rows = labelled_sample(docs, labels, sample)

    def mine(batches):
        for part in tb.slices(batches, "text"):
            data, offsets = tb.text_buffer(part.column("text"))
            toxic = part.column("toxic").to_numpy()
            _, _, owner, found = keys(data, offsets)
            pairs = [np.stack((h, owner[w].astype(np.uint64))) for h, w in found]
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.uint64)
            known, at = np.unique(pairs[0], return_inverse=True)
            is_toxic = toxic[pairs[1].astype(np.int64)] > 0
            t, c = np.bincount(at, is_toxic, len(known)), np.bincount(at, ~is_toxic, len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], names=["k", "t", "c"]
            )

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sum(v for k, v in totals.items() if k > 0), sum(v for k, v in totals.items() if k <= 0)
    if not pos or not neg:
        return Model(None, None, None, 1.0 if pos else 0.0)
    odds = F.log((F.col("t") + 0.5) / (pos / 2 + 1)) - F.log((F.col("c") + 0.5) / (neg / 2 + 1))
    picked = (
        rows.where("half").mapInArrow(mine, "k long, t long, c long")
        .groupBy("k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= 4).withColumn("w", odds).where(F.col("w") >= 2)
        .orderBy(F.desc(F.col("w") * F.log1p("t")), "k").limit(LEXICON)
    )
    lexicon = Lexicon([(r.k, r.w) for r in picked.select("k", "w").collect()] or [(0, 0.0)])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def describe(batches):
        for part in tb.slices(batches, "text"):
            x = features(*tb.text_buffer(part.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "x"],
            )

    found = rows.where("not half").mapInArrow(describe, "doc_id string, toxic int, x array<double>").toArrow()
    order = np.argsort([zlib.crc32(f"{d}/order".encode()) for d in found.column("doc_id").to_pylist()], kind="stable")
    x = np.array(found.column("x").to_pylist())[order]
    y = (found.column("toxic").to_numpy() > 0).astype(float)[order]
    return Model(lexicon, x, y, pos / (pos + neg)) if len(y) else Model(None, None, None, pos / (pos + neg))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, sample: int):
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return learn(rows, labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).alias("toxic")), sample=sample)


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, label_id_col, label_col, sample))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            got = shared.value.score(*tb.text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return base.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, "doc_id", "toxic", sample))

    def run(batches):
        for part in tb.slices(batches, text_col):
            yield part.filter(pa.array(shared.value.score(*tb.text_buffer(part.column(text_col))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
