"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes about twenty surface features. Boosting visits the features in a fixed cycle; each
step fits a shallow tree (three leaves) on one feature's quantile bins and adds it to that feature's
lookup table. The strongest pairs then get two-dimensional tables, boosted the same way with four-leaf
trees. A score is the sum of table entries, so scoring is a few vectorised look-ups.

Labels are fitted from at most ``max_train`` labelled rows, those with the smallest hash of doc_id.
Null and empty texts have all features 0 and get the score of that point. Rows repeat in the result as
often as in the input; a null doc_id is never used for training. Only doc_id and text are read, so other
columns and their names do not matter. Labels given twice for one doc_id count once, 1 if any row says 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import code_points, fold, table

FEATURES = [
    "log_chars", "log_words", "word_len", "long_words", "short_words", "upper", "digits", "symbols", "bangs",
    "bars", "stops", "other_punct", "distinct_words", "top_word", "dup_lines", "line_words", "dup_windows",
    "adjacent", "capital_starts", "stopped_words",
]

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _STOP, _SPACE, _OTHER = range(9)


def _char_classes() -> np.ndarray:
    table_ = np.full(0x110000, _OTHER, dtype=np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isupper():
            table_[cp] = _UPPER
        elif c.isalpha():
            table_[cp] = _LOWER
        elif c.isdigit():
            table_[cp] = _DIGIT
        elif c.isspace():
            table_[cp] = _SPACE
    table_[0x3000:] = _LOWER
    for c in "#*$%&<>@=~^_":
        table_[ord(c)] = _SYMBOL
    table_[ord("!")], table_[ord("|")] = _BANG, _BAR
    for c in ".?;:,":
        table_[ord(c)] = _STOP
    return table_


_CLASSES: list[np.ndarray] = []


def features(text: str | None) -> np.ndarray:
    """The feature vector of one text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    if not _CLASSES:
        _CLASSES.append(_char_classes())
    counts = np.bincount(_CLASSES[0][code_points(text)], minlength=9)
    chars = len(text)
    words = text.split()
    n = len(words)
    out[0] = np.log1p(chars)
    letters = max(1, counts[_UPPER] + counts[_LOWER])
    out[5] = counts[_UPPER] / letters
    out[6] = counts[_DIGIT] / chars
    out[7] = counts[_SYMBOL] / chars
    out[8] = counts[_BANG] / chars
    out[9] = counts[_BAR] / chars
    out[10] = counts[_STOP] / chars
    out[11] = counts[_OTHER] / chars
    if not n:
        return out
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    out[1] = np.log1p(n)
    out[2] = lens.mean()
    out[3] = (lens > 11).mean()
    out[4] = (lens <= 3).mean()
    tally = Counter(words)
    out[12] = len(tally) / n
    out[13] = max(tally.values()) / n
    lines = [x for x in text.split("\n") if x.strip()]
    out[14] = 1 - len(set(lines)) / max(1, len(lines))
    out[15] = np.log1p(n / max(1, len(lines)))
    if n >= 5:
        roll = hashes[: n - 4].copy()
        for k in range(1, 5):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - 4 + k]
        roll.sort()
        out[16] = (roll[1:] == roll[:-1]).sum() / len(roll)
    out[17] = (hashes[1:] == hashes[:-1]).sum() / n
    out[18] = sum(w[0].isupper() for w in words) / n
    out[19] = sum(w[-1] in ".,;:?" for w in words) / n
    return out


@dataclass
class PairwiseGam:
    """Additive tables over binned features: ``one[j]`` by feature, ``two[(i, j)]`` by pair of coarse bins."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 120
    pairs: int = 6
    rate: float = 0.15
    ridge: float = 2.0
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    wide: list[np.ndarray] = field(default_factory=list)
    one: list[np.ndarray] = field(default_factory=list)
    two: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def _quantiles(self, x: np.ndarray, parts: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, parts + 1)[1:-1])) for j in range(x.shape[1])]

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        self.edges, self.wide = (self._quantiles(x, n) if len(x) else [np.zeros(0)] * x.shape[1] for n in (self.bins, self.coarse))
        b, c = self._binned(x, self.edges), self._binned(x, self.wide)
        self.one = [np.zeros(len(e) + 1) for e in self.edges]
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        if not len(y):
            return self
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            for j, t in enumerate(self.one):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * _three_leaves(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), self.ridge)
                t += step
                f += step[b[:, j]]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                _, gain = _four_leaves(*_grids(c, i, j, y - p, p * (1 - p), self.wide), self.ridge)
                gains.append((-gain, i, j))
        for _, i, j in sorted(gains)[: self.pairs]:
            self.two[i, j] = np.zeros((len(self.wide[i]) + 1, len(self.wide[j]) + 1))
        for _ in range(self.rounds // 4):
            for (i, j), t in self.two.items():
                p = 1 / (1 + np.exp(-f))
                leaf, _ = _four_leaves(*_grids(c, i, j, y - p, p * (1 - p), self.wide), self.ridge)
                t += self.rate * leaf
                f += self.rate * leaf[c[:, i], c[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, c = self._binned(x, self.edges), self._binned(x, self.wide)
        f = np.full(len(x), self.bias)
        for j, t in enumerate(self.one):
            f += t[b[:, j]]
        for (i, j), t in self.two.items():
            f += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-f))


def _three_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The best tree with two cuts over ordered bins, as one value a bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    n = len(g)
    a, b = np.triu_indices(n + 1)

    def gain(lo, hi):
        return (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)

    best = int(np.argmax(gain(np.zeros_like(a), a) + gain(a, b) + gain(b, np.full_like(b, n))))
    out = np.zeros(n)
    for lo, hi in ((0, a[best]), (a[best], b[best]), (b[best], n)):
        if hi > lo:
            out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _grids(c, i, j, g, h, wide):
    shape = (len(wide[i]) + 1, len(wide[j]) + 1)
    at = c[:, i] * shape[1] + c[:, j]
    size = shape[0] * shape[1]
    return np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape)


def _four_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree with one cut on each axis, as a grid, and its gain."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quadrants(m):
        a = m[1:, 1:]
        top, left = m[1:, -1:], m[-1:, 1:]
        return [a, top - a, left - a, m[-1, -1] - top - left + a]

    qg, qh = quadrants(cg), quadrants(ch)
    gain = sum(x * x / (w + ridge) for x, w in zip(qg, qh, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = np.zeros_like(g)
    values = [x[i, j] / (w[i, j] + ridge) for x, w in zip(qg, qh, strict=True)]
    leaf[: i + 1, : j + 1], leaf[: i + 1, j + 1 :], leaf[i + 1 :, : j + 1], leaf[i + 1 :, j + 1 :] = values
    return leaf, float(gain[i, j])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def labelled(labels: DataFrame, column: str, parts: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, by smallest hash: (doc_id, label)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, *, parts: int = 3, held_out: int = 1, max_train: int = 20000) -> PairwiseGam:
    """Fit the model on the labelled rows outside the held-out fold. The ids of the sample (bounded) are
    broadcast; features of just those rows come to the driver."""
    chosen = F.broadcast(labelled(labels, "quality", parts, held_out, max_train))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    got = rows.mapInArrow(_featured, "doc_id bigint, label int, x array<double>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))[order]
    y = np.asarray(got.column("label").to_pylist(), dtype=float)[order]
    return PairwiseGam().fit(x, y)


def score(docs: DataFrame, model: PairwiseGam) -> DataFrame:
    """doc_id, score of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: PairwiseGam, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least ``least``, all columns kept."""
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(kept, schema)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
