"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is a binary logistic classifier over hashed letter n-grams
(1 to 4, words marked by their ends). Up to seven languages use the exhaustive code of all two-way
splits, more a seeded random code with the largest smallest distance found. Decoding adds, over the bits,
the logistic loss of the classifier's margin against the codeword's bit, weighted by that classifier's
accuracy in training; the codeword of least loss wins, the softmax of the negative losses is the score,
and a text whose two best are close is flagged ambiguous.

Languages are whatever non-null ``lang`` values the training rows hold. Training takes about ``per_lang``
documents of a language, at most ``most`` in all, by a hash of doc_id. A text that is null or has no
letter is ``und`` with score 0. Repeated rows are scored each; a null doc_id is never trained on; columns
other than doc_id, text and (in training) lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import code_points, fold, mix64, table

#: Numerals such as superscripts and fractions are words to the pattern, but no letters.
_WORDS = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _WORDS.finditer(text))


DIM = 1 << 13
LONGEST = 4


def letter_table() -> np.ndarray:
    """True for code points taken as letters in features."""
    out = np.ones(0x110000, dtype=bool)
    out[:0x3000] = [chr(c).isalpha() for c in range(0x3000)]
    return out


def vector(text: str, letters: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of the text's hashed n-grams."""
    c = code_points(f" {text.lower()} ").astype(np.uint64)
    c[~letters[c.astype(np.int64)]] = 32
    c = c[(c != 32) | (np.concatenate([[0], c[:-1]]) != 32)]
    counts = np.zeros(DIM)
    roll = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, min(LONGEST, len(c)) + 1):
        roll = roll[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        counts += np.bincount((mix64(roll + np.uint64(n)) & np.uint64(DIM - 1)).astype(np.int64), minlength=DIM)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of +-1 bits."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=k - 1) if -1 in rest], dtype=float).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * code.shape[1]
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class EcocModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row of x."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), p.max(1), second > 0.5 * top[:, -1]

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        live = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        for at in range(0, len(live), 256):
            part = live[at : at + 256]
            found = self.decode(np.stack([vector(texts[i], letters) for i in part]))
            for i, k, s, a in zip(part, *(z.tolist() for z in found), strict=True):
                langs[i], scores[i], unsure[i] = self.langs[k], s, a
        return langs, scores, unsure


def fit(texts: list[str], langs: list[str], steps: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> EcocModel:
    letters = letter_table()
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return EcocModel([], code, np.zeros((DIM, 1), np.float32), np.zeros(1), np.ones(1))
    which = np.array([names.index(x) for x in langs])
    x = np.stack([vector(t, letters) for t in texts])
    y = code[which].astype(np.float32)
    share = np.bincount(which, minlength=len(names))[which]
    w8 = (1 / share / len(names)).astype(np.float32)[:, None]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(y * (x @ w + b))) * w8
        for value, grad, m, v in ((w, x.T @ g + ridge * w, *state[:2]), (b, g.sum(0), *state[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((np.sign(x @ w + b) == y) * w8).sum(0)
    return EcocModel(names, code, w, b, np.clip(2 * right - 1, 0.05, 1))


def train(docs: DataFrame, *, parts: int = 5, held_out: int = 0, per_lang: int = 600, most: int = 4000) -> EcocModel:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), parts) != held_out))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    each = min(per_lang, most // max(1, len(counts)))
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))]) if counts else F.lit(None)
    some = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000)) if counts else known
    got = some.select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: EcocModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def op2_lang_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
