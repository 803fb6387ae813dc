"""Toxicity: bags of subword embeddings, averaged, into a linear softmax.

A word's vector is the mean of the embeddings of its character 3- to 5-grams (with word ends) and of the
word itself, all hashed into one table; so an unseen misspelling shares most of its vector with the
word it imitates. Each window of ``window`` consecutive words is the mean of its word vectors, goes
through a linear softmax over (clean, toxic), and a document takes its worst window: a single insult in
a long text is not averaged away. Embeddings and softmax are trained jointly by full-batch Adam in numpy.
Only documents carry labels, so training alternates: all windows of toxic documents start as positive,
then only the ones that score highest; the hardest windows of clean documents are added as negatives.
The document score is calibrated by a two-parameter logistic fit on the worst windows.

Because pooling and softmax are linear, a trained model collapses into one number for each hashed
n-gram; scoring sums those numbers.

Fitted on at most ``max_toxic`` and ``max_clean`` labelled documents (smallest hash of doc_id first), and of their windows on at most
``most`` positive and ``most`` negative ones at a time: in the first round all windows of toxic documents (a seeded draw of ``most``
beyond that) and a seeded draw of twice as many clean windows, 2,000 at least; later the strongest of toxic documents, the hardest
of clean ones and a seeded draw of ``most`` / 2 clean ones. These are bounds of training alone; scoring reads every window of every text.
Null or empty texts have no windows and get the score of the neutral window 0. Repeated rows stay
repeated; a null doc_id is scored but never trained on; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import fold, mix64, table
from motiondeck.llm.quality_gam import labelled

_WORDS = re.compile(r"\w+")


def subwords(words: list[str], buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word, the word itself included."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), lens)
    ends = np.repeat(np.cumsum(lens), lens)
    place = np.arange(len(codes))
    who, what = [], []
    roll = codes.copy()
    for n in range(2, longest + 1):
        roll = roll[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n < shortest:
            continue
        fits = place[: len(roll)] + n <= ends[: len(roll)]
        who.append(owner[: len(roll)][fits])
        what.append(mix64(roll[fits] + np.uint64(n)))
    if len(marked):
        weights = mix64(codes + (place - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        who.append(np.arange(len(marked)))
        what.append(mix64(np.add.reduceat(weights, np.cumsum(lens) - lens)))
    who_ = np.concatenate(who) if who else np.zeros(0, dtype=np.int64)
    what_ = np.concatenate(what) if what else np.zeros(0, dtype=np.uint64)
    return who_, (what_ % np.uint64(buckets)).astype(np.int64)


def _word_list(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def worst_window(values: np.ndarray, window: int) -> float:
    """The largest mean of ``window`` consecutive values (of all of them, if there are fewer)."""
    if not len(values):
        return 0.0
    w = min(window, len(values))
    c = np.concatenate([[0.0], np.cumsum(values)])
    return float((c[w:] - c[:-w]).max() / window)


@dataclass
class SubwordSoftmax:
    """``values[b]``: the toxic-minus-clean logit of hashed n-gram b; ``slope``, ``offset``: calibration."""

    values: np.ndarray
    bias: float
    slope: float
    offset: float
    window: int

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        who, what = subwords(words, len(self.values))
        n = np.bincount(who, minlength=len(words))
        return np.bincount(who, self.values[what], len(words)) / np.maximum(n, 1)

    def scores(self, texts: list[str | None], known: dict[str, float], rows: int = 500) -> np.ndarray:
        """known: logits of words met before by the same task. ``rows`` texts are held as words at a time."""
        parts = [self._scores(texts[at : at + rows], known) for at in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        lists = [_word_list(t) for t in texts]
        fresh = list({w for ws in lists for w in ws if w not in known})
        if len(known) + len(fresh) > 500_000:
            known.clear()
            fresh = list({w for ws in lists for w in ws})
        for at in range(0, len(fresh), 20000):
            part = fresh[at : at + 20000]
            known.update(zip(part, self.word_logits(part).tolist(), strict=True))
        get = known.__getitem__
        raw = np.array([worst_window(np.fromiter(map(get, ws), dtype=float, count=len(ws)), self.window) for ws in lists])
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -60, 60)))


def fit(texts: Iterable[str], toxic: np.ndarray, *, buckets: int = 1 << 17, dim: int = 8, window: int = 6, outer: int = 4, steps: int = 12, most: int = 50000, seed: int = 7) -> SubwordSoftmax:
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, dtype=bool)
    index: dict[str, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in _word_list(t)), dtype=np.int32) for t in texts]
    vocabulary = list(index)
    del index
    model = SubwordSoftmax(np.zeros(buckets), 0.0, 1.0, 0.0, window)
    if not vocabulary or toxic.all() or not toxic.any():
        p = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3)
        model.offset = float(np.log(p / (1 - p)))
        return model
    parts = []
    for at in range(0, len(vocabulary), 20000):  # in parts, to bound the memory of the n-gram codes
        who, what = subwords(vocabulary[at : at + 20000], buckets)
        order = np.argsort(who, kind="stable")
        parts.append(((who[order] + at).astype(np.int32), what[order].astype(np.int32)))
    who, what = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    first = np.searchsorted(who, np.arange(len(vocabulary) + 1))
    counts = np.diff(first)

    starts = [np.arange(0, max(1, len(d)), window) if len(d) else np.zeros(0, dtype=np.int64) for d in docs]
    win_doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(starts)]).astype(np.int64)
    win_at = np.concatenate(starts)
    flat = np.concatenate(docs)
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    win_lo = base[win_doc] + win_at
    win_hi = np.minimum(win_lo + window, base[win_doc + 1])
    positive_doc = toxic[win_doc]

    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    state = [np.zeros_like(z) for z in (embed, embed, soft, soft, bias, bias)]
    clock = 0
    negatives = np.flatnonzero(~positive_doc)
    chosen_pos = np.flatnonzero(positive_doc)
    chosen_neg = rng.choice(negatives, min(len(negatives), max(2000, 2 * len(chosen_pos)), most), replace=False)
    if len(chosen_pos) > most:
        chosen_pos = np.sort(rng.choice(chosen_pos, most, replace=False))
    for _ in range(outer):
        chosen = np.concatenate([chosen_pos, chosen_neg])
        y = np.concatenate([np.ones(len(chosen_pos)), np.zeros(len(chosen_neg))]).astype(np.float32)
        weight = np.where(y > 0, 0.5 / max(1, len(chosen_pos)), 0.5 / max(1, len(chosen_neg))).astype(np.float32)
        span = win_hi[chosen] - win_lo[chosen]
        win_of = np.repeat(np.arange(len(chosen)), span)
        inner = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        used, word = np.unique(flat[np.repeat(win_lo[chosen], span) + inner], return_inverse=True)
        n_sub = counts[used]
        sub_of = np.repeat(np.arange(len(used), dtype=np.int32), n_sub)
        sub = what[np.repeat(first[used] - (np.cumsum(n_sub) - n_sub), n_sub) + np.arange(n_sub.sum())]
        for _ in range(steps):
            clock += 1
            vec = np.stack([np.bincount(sub_of, embed[sub, k], len(used)) for k in range(dim)], axis=1) / n_sub[:, None]
            bag = np.stack([np.bincount(win_of, vec[word, k], len(chosen)) for k in range(dim)], axis=1) / window
            z = bag @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(len(y)), y.astype(int)] -= 1
            d *= weight[:, None]
            g_soft, g_bias = bag.T @ d, d.sum(0)
            g_bag = (d @ soft.T) / window
            g_vec = np.stack([np.bincount(word, g_bag[win_of, k], len(used)) for k in range(dim)], axis=1) / n_sub[:, None]
            g_embed = np.stack([np.bincount(sub, g_vec[sub_of, k], buckets) for k in range(dim)], axis=1)
            for value, grad, (m, v) in ((embed, g_embed, state[:2]), (soft, g_soft, state[2:4]), (bias, g_bias, state[4:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.1 * (m / (1 - 0.9**clock)) / (np.sqrt(v / (1 - 0.99**clock)) + 1e-8)
        side = soft[:, 1] - soft[:, 0]
        model.values, model.bias = (embed @ side).astype(np.float64), float(bias[1] - bias[0])
        logits = np.bincount(who, model.values[what], len(vocabulary)) / np.maximum(counts, 1)
        c = np.concatenate([[0.0], np.cumsum(logits[flat])])
        win = (c[win_hi] - c[win_lo]) / window
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, win_doc, win)
        top = win >= best[win_doc] - 1e-12
        strong = win >= best[win_doc] - 0.25 * np.abs(best[win_doc])
        chosen_pos = np.flatnonzero(positive_doc & (top | (strong & (win + model.bias > 0))))
        hard = np.flatnonzero(~positive_doc & top)
        chosen_neg = np.union1d(hard, rng.choice(negatives, min(len(negatives), most // 2), replace=False))
    raw = np.array([worst_window(logits[d], window) for d in docs])
    model.slope, model.offset = _calibrate(raw, toxic)
    return model


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on standardised raw, with a light ridge, by Newton's method."""
    mid, spread = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - mid) / spread, np.ones(len(raw))], axis=1)
    beta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + 0.01 * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2) + 1e-6 * np.eye(2), grad).clip(-2, 2)
    return float(beta[0] / spread), float(beta[1] - beta[0] * mid / spread)


def train(docs: DataFrame, labels: DataFrame, *, parts: int = 5, held_out: int = 0, max_toxic: int = 2500, max_clean: int = 5000) -> SubwordSoftmax:
    """Fit on a bounded sample of labelled documents, whose ids are broadcast and whose texts go to one task."""
    bad = labelled(labels.where("toxic = 1"), "toxic", parts, held_out, max_toxic)
    good = labelled(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 0"), "toxic", parts, held_out, max_clean)
    sample = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(bad.unionAll(good)), "doc_id").where("text is not null")
    row = sample.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(_fitted, "logits binary, bias double, slope double, shift double, size int").first()
    return SubwordSoftmax(np.frombuffer(row.logits), row.bias, row.slope, row.shift, row.size)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the bounded sample: one task's work, so that the driver holds no texts."""
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        toxic += [x == 1 for x in batch.column("label").to_pylist()]
    m = fit(texts, np.array(toxic, dtype=bool))
    yield pa.RecordBatch.from_pylist([{"logits": m.values.tobytes(), "bias": m.bias, "slope": m.slope, "shift": m.offset, "size": m.window}], schema=pa.schema([("logits", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64()), ("size", pa.int32())]))


def score(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist(), known))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: SubwordSoftmax, most: float = 0.5) -> DataFrame:
    """The rows of docs whose toxicity is below ``most``, all columns kept."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text").to_pylist(), known) < most))

    return docs.mapInArrow(kept, docs.schema)


def op9_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
