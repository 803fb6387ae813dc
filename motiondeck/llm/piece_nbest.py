"""SentencePiece encoding and decoding with the N best segmentations.

A text is escaped (white space to the meta symbol, one in front) and its piece lattice is searched for
the N segmentations of the largest sum of piece scores. The forward pass (Viterbi) gives for every
position the best score from the start; it is the exact heuristic of an A-star search from the end
backwards, so complete segmentations leave the agenda in order of score. Characters that no piece covers
are spelt in byte pieces, at a fixed penalty a character.

No piece has a meta symbol after another character, so the lattice falls apart before each run of meta
symbols, and the N best of a text are combinations of the N best of its parts. The passes forward and
backward are made for all distinct parts of a batch at once, in numpy, and tell for each part how much its
second-best segmentation loses. Only the N - 1 parts of a text that lose least can differ in its N
best, so A-star runs for those alone, and their lists are merged.

Ties of score are broken in one way that depends on the part alone. A null text is one of no
pieces with one segmentation. Decoding any of the segmentations returns the text. Rows repeat as in the
input; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import mix64, table

META = "▁"
_PART = re.compile(f"{META}+[^{META}]*|[^{META}]+")
_P = np.uint64(0x100000001B3)
_SLOT = np.uint64(64 - 22)


class Pieces:
    """The vocabulary of a model, as far as a lattice needs it."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_of = np.empty(sp.get_piece_size(), dtype=object)
        self.score, self.byte_id = {}, {}
        names = []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            self.bytes_of[i] = b""
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[name] = (i, sp.get_score(i))
                self.bytes_of[i] = name.replace(META, " ").encode()
                names.append(name)
        least = min((s for _, s in self.score.values() if s > -1e6), default=0.0)
        #: pieces that a model marks as never to be merged get the penalty of an uncovered character
        self.penalty = least - 10.0
        self.score = {k: (i, s if s > -1e6 else self.penalty) for k, (i, s) in self.score.items()}
        self.longest = max(map(len, self.score))
        if any(META in x.lstrip(META) for x in names):
            raise ValueError("a piece joins parts: " + next(x for x in names if META in x.lstrip(META)))
        order = sorted(self.score, key=lambda x: int(_hash(x)))
        self.hashes = np.array([_hash(x) for x in order], dtype=np.uint64)
        self.ids = np.array([self.score[x][0] for x in order], dtype=np.int32)
        self.scores = np.array([self.score[x][1] for x in order])
        #: Whether sums of up to 64 scores are exact in 32-bit floats: they are whole numbers and not large.
        self.narrow = bool((self.scores == np.rint(self.scores)).all() and self.penalty == round(self.penalty) and 64 * max(np.abs(self.scores).max(initial=0), abs(self.penalty)) < 2**24)
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two pieces share a hash")
        self.likely = np.zeros(1 << 22, dtype=bool)
        self.likely[(self.hashes >> _SLOT).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Sets score and ids where a substring's hash is that of a piece."""
        at = np.nonzero(self.likely[(hashes >> _SLOT).astype(np.int32)])
        some = hashes[at]
        k = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        hit = self.hashes[k] == some
        k, at = k[hit], (at[0][hit], at[1][hit])
        score[at], ids[at] = self.scores[k], self.ids[k]

    def spell(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in (" " if char == META else "▁" if char == "\x00\x01" else char).encode("utf-8", "surrogatepass")]


def _hash(piece: str) -> np.uint64:
    h = np.zeros(1, dtype=np.uint64)
    for c in piece:
        h = h * _P + np.uint64(ord(c))
    return mix64(h + np.uint64(len(piece)))[0]


def escape(text: str, hole: str = "") -> str:
    """The text with white space as meta symbols; a meta symbol of its own becomes a private character."""
    return META + text.replace(META, hole).replace(" ", META)


def edges(pieces: Pieces, part: str) -> list[list[tuple[int, float, int]]]:
    """By end position: (start, score, id or -1 for a spelt character) of the lattice's edges."""
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
    for e in range(1, len(part) + 1):
        for s in range(max(0, e - pieces.longest), e):
            if found := pieces.score.get(part[s:e]):
                out[e].append((s, found[1], found[0]))
        if not out[e] or out[e][-1][0] != e - 1:
            out[e].append((e - 1, pieces.penalty, -1))
    return out


def nbest(pieces: Pieces, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a part, as (score, piece ids; -1 for a spelt character), best first.

    What is on the agenda costs exactly what its best completion does, so an entry is put there only if it is among as many
    cheapest ones as are still wanted. Paths are kept as their last piece and the path after it: time and memory grow with
    the length of the part.
    """
    lattice = edges(pieces, part)
    ahead = [0.0] + [0.0] * len(part)
    for e in range(1, len(part) + 1):
        ahead[e] = max(ahead[s] + w for s, w, _ in lattice[e])
    pushed = 0
    agenda = [(-ahead[-1], 0, None, len(part), 0.0)]
    low = [-ahead[-1]]  # the least costs on the agenda, as many as are wanted
    found: list[tuple[float, tuple[int, ...]]] = []
    while agenda and len(found) < n:
        _, _, path, at, behind = heapq.heappop(agenda)
        if low:
            del low[0]
        if not at:
            ids = []
            while path is not None:
                i, path = path
                ids.append(i)
            found.append((behind, tuple(ids)))
            del low[n - len(found) :]
            continue
        for s, w, i in lattice[at]:
            cost = -(ahead[s] + w + behind)
            if len(low) < n - len(found) or cost < low[-1]:
                insort(low, cost)
                del low[n - len(found) :]
                pushed -= 1  # of equals the latest comes first
                heapq.heappush(agenda, (cost, pushed, (i, path), s, behind + w))
    return found


def batch_viterbi(pieces: Pieces, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For parts of one length: best scores, what the second-best loses (inf: there is none), the best ids,
    right-aligned in a matrix, and how many they are."""
    n, size = len(parts), len(parts[0])
    exact = np.float32 if pieces.narrow and size <= 64 else np.float64
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.uint64)
    most = min(size, pieces.longest)
    score = np.full((most, n, size), -np.inf, dtype=exact)  # by length - 1, part, end - 1
    ids = np.full((most, n, size), -1, dtype=np.int32)
    roll = np.zeros((n, size), dtype=np.uint64)
    for m in range(1, most + 1):
        roll = roll[:, : size - m + 1] * _P + codes[:, m - 1 :]
        pieces.look_up(mix64(roll + np.uint64(m)), score[m - 1, :, m - 1 :], ids[m - 1, :, m - 1 :])
    score[0][ids[0] < 0] = pieces.penalty
    ahead, behind = np.zeros((n, size + 1), dtype=exact), np.zeros((n, size + 1), dtype=exact)
    length = np.zeros((n, size + 1), dtype=np.int32)
    for e in range(1, size + 1):
        k = min(most, e)
        paths = score[:k, :, e - 1] + ahead[:, e - k : e].T[::-1]
        length[:, e] = paths.argmax(0) + 1
        ahead[:, e] = paths.max(0)
    for s in range(size - 1, -1, -1):
        behind[:, s] = max_over(score, behind, s, min(most, size - s))
    at, counts = np.full(n, size), np.zeros(n, dtype=np.int64)
    best = np.full((n, size), -2, dtype=np.int32)
    for step in range(size):
        live = np.flatnonzero(at > 0)
        if not len(live):
            break
        m = length[live, at[live]]
        best[live, size - 1 - step] = ids[m - 1, live, at[live] - 1]
        score[m - 1, live, at[live] - 1] = -np.inf  # what is left are the edges off the best path
        at[live] -= m
        counts[live] += 1
    loss = np.full(n, np.inf)
    for m in range(1, most + 1):
        through = ahead[:, : size - m + 1] + score[m - 1, :, m - 1 :] + behind[:, m:]
        loss = np.minimum(loss, ahead[:, size] - through.max(1))
    return ahead[:, size].astype(float), loss, best, counts


def max_over(score: np.ndarray, behind: np.ndarray, s: int, k: int) -> np.ndarray:
    out = score[0, :, s] + behind[:, s + 1]
    for m in range(2, k + 1):
        out = np.maximum(out, score[m - 1, :, s + m - 1] + behind[:, s + m])
    return out


class Encoder:
    """N best encodings of texts; keeps what it knows of parts, up to ``most`` of them."""

    def __init__(self, model_path: str, n: int, most: int = 600_000):
        self.pieces, self.n, self.most = Pieces(model_path), n, most
        self.hole = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.pieces.score)
        self._forget()

    def _forget(self) -> None:
        """known: the number of a part, under which score, loss and raw (its best ids) have it."""
        self.known: dict[str, int] = {}
        self.score, self.loss, self.raw = np.zeros(0), np.zeros(0), []
        self.lists: dict[str, list[tuple[float, bytes, int]]] = {}

    def spelt(self, part: str, ids: tuple[int, ...]) -> bytes:
        """The ids of a segmentation as little-endian 32-bit integers, spelt characters as their bytes' ids."""
        if -1 in ids:
            out, at, ends = [], len(part), []
            for i in reversed(ids):
                ends.append(at)
                at -= 1 if i < 0 else self.length[i]
            for i, e in zip(ids, reversed(ends), strict=True):
                out += [i] if i >= 0 else self.pieces.spell("\x00\x01" if part[e - 1] == self.hole else part[e - 1])
            ids = tuple(out)
        return np.array(ids, dtype="<u4").tobytes()

    @property
    def length(self) -> dict[int, int]:
        if not hasattr(self, "_length"):
            self._length = {i: len(k) for k, (i, _) in self.pieces.score.items()}
        return self._length

    def learn(self, parts: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        scores, losses = [self.score], [self.loss]
        for size, group in by_size.items():
            step = max(1, 200_000 // (size * min(size, self.pieces.longest)))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                score, loss, best, counts = batch_viterbi(self.pieces, some)
                self.known.update(zip(some, range(len(self.raw), len(self.raw) + len(some)), strict=True))
                scores.append(score)
                losses.append(loss)
                whole, ends = best.astype("<i4").tobytes(), np.arange(1, len(some) + 1) * size * 4
                raw = [whole[lo:hi] for lo, hi in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]
                for i in np.flatnonzero((best == -1).any(1)).tolist():
                    raw[i] = self.spelt(some[i], tuple(best[i][size - counts[i] :].tolist()))
                self.raw += raw
        self.score, self.loss = np.concatenate(scores), np.concatenate(losses)

    def others(self, part: str) -> list[tuple[float, bytes, int]]:
        """(loss, ids, number of ids) of the best segmentations of a part but its first, at most n - 1."""
        found = self.lists.get(part)
        if found is None:
            at = self.known[part]
            best, raw = float(self.score[at]), self.raw[at]
            found = [(best - score, self.spelt(part, ids)) for score, ids in nbest(self.pieces, part, self.n)]
            found = [(loss, x, len(x) // 4) for loss, x in found if x != raw][: self.n - 1]
            self.lists[part] = found
        return found

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[float, bytes]]]:
        """For each text the (score, ids) of its N best segmentations, best first."""
        split = [None if t is None else _PART.findall(escape(t, self.hole)) for t in texts]
        parts = {p for ps in split if ps for p in ps}
        fresh = parts - self.known.keys()
        if len(self.known) + len(fresh) > self.most:
            self._forget()
            fresh = parts
        if fresh:
            self.learn(fresh)
        for parts in split:
            yield [(0.0, b"")] if parts is None else self._combined(parts)

    def _combined(self, parts: list[str]) -> list[tuple[float, bytes]]:
        at = list(map(self.known.__getitem__, parts))
        raws = list(map(self.raw.__getitem__, at))
        at = np.array(at, dtype=np.int64)
        best = float(self.score[at].sum())
        out = [(best, b"".join(raws))]
        if self.n == 1:
            return out
        losses = self.loss[at]
        k = min(self.n - 1, len(losses))
        cut = np.partition(losses, k - 1)[k - 1]
        few = np.concatenate([np.flatnonzero(losses < cut), np.flatnonzero(losses == cut)])[:k]
        choices = [self.others(parts[i]) for i in few.tolist() if np.isfinite(losses[i])]
        few = [i for i in few.tolist() if np.isfinite(losses[i])]
        # combinations of the few parts' lists, in order of what they lose; 0 is a part's best
        agenda: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(few))]
        met = {agenda[0][1]}
        while agenda and len(out) < self.n + 1:
            loss, state = heapq.heappop(agenda)
            if any(state):
                row = raws.copy()
                for i, c, options in zip(few, state, choices, strict=True):
                    if c:
                        row[i] = options[c - 1][1]
                out.append((best - loss, b"".join(row)))
                if len(out) == self.n:
                    break
            for j, c in enumerate(state):
                if c < len(choices[j]):
                    after = (*state[:j], c + 1, *state[j + 1 :])
                    if after not in met:
                        met.add(after)
                        now = choices[j][c][0] - (choices[j][c - 1][0] if c else 0.0)
                        heapq.heappush(agenda, (loss + now, after))
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(self.pieces.bytes_of[np.frombuffer(ids, dtype="<u4")].tolist())
        return raw.decode("utf-8", "surrogatepass").removeprefix(" ")


def encode_nbest(docs: DataFrame, *, n: int = 4, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each text and rank (0: best): doc_id, rank, score, n_pieces, ids_crc32, decodes, and ids if wanted."""
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    schema = "doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, decodes boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, n)
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, rows = batch.slice(at, 1000), []
                texts = part.column("text").to_pylist()
                for d, t, found in zip(part.column("doc_id").to_pylist(), texts, encoder.encode(texts), strict=True):
                    for rank, (score, ids) in enumerate(found):
                        row = (d, rank, score, len(ids) // 4, zlib.crc32(ids), encoder.decode(ids) == (t or ""))
                        rows.append((*row, np.frombuffer(ids, dtype="<i4")) if with_ids else row)
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """encoded with ``decoded``, the text of its array column ids."""
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model_path, 1)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else encoder.decode(np.asarray(x, dtype="<u4").tobytes()))

    return encoded.withColumn("decoded", decoded("ids"))


def op1_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(table(spark, sf_dir, "documents"), with_ids=False)
