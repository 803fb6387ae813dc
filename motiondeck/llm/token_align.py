"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

A encodes a space and the text (byte-level BPE, ``tokenizers``), B the text (``sentencepiece``, which puts the
space there itself). Cuts are the byte offsets where a token of A and a token of B both end; tokens between
two cuts are a group, and the last tokens of a group of either side are linked. The ends of tokens come
from A's character offsets and B's immutable-proto spans; where several tokens share a character
(byte-level parts of a multibyte character, byte-fallback tokens) the spans are only coarse cuts, and
the ends between them come from the decoded bytes. How often two ids are linked in the whole corpus tells
``n_best`` (links whose count is the highest of their B id, ties included) and ``count_sum``.

A text is encoded by stretches, each a space and what stands up to the next single space between two
characters that are not white space. Neither tokenizer joins anything across such a space (A splits words there
first; no piece of B has its space mark anywhere but in front, which is checked when the model is read), so the
tokens are those of the whole text, and a stretch that a task has met is not encoded again. Special
tokens' strings are plain text.

Null and empty texts, and texts whose tokens of A or B do not spell a space and the text (a literal space mark,
U+2581, for instance), have no tokens: zeros and an empty ``groups_sha256``; other texts are unaffected. Rows that repeat a
doc_id count each; a null doc_id is kept. Other columns are not read. Memory: a chunk of ``LINKS`` links, or one
longer text. No table of pairs is broadcast; a frequent pair is one row a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.chunks import new_ids, pack, sums, unpack
from motiondeck.llm.common import materialize, table

#: Links in a chunk; stretches that a task remembers, the longest that it does, and the characters of longer ones after which it starts anew;
#: rows that are held as stretches at a time.
LINKS, KNOWN, LONGEST, KEPT, ROWS = 1 << 20, 400_000, 64, 1 << 22, 200
#: A pair (a, b) is b * WIDTH + a; both vocabularies have fewer ids.
WIDTH = 1 << 20
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def refined_ends(begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte ends of a text's tokens from coarse spans (begins, ends) of bytes.

    A span's end is a cut if the span holds something and the next one does not begin before that end. Tokens up to a cut that have no cut
    of their own (parts of one character) end where their decoded bytes (lengths) do.
    """
    n, total = len(ends), np.cumsum(lengths)
    sure = ends > begins
    sure[:-1] &= begins[1:] >= ends[:-1]
    last = np.maximum.accumulate(np.where(sure, np.arange(n), -1)) if n else np.zeros(0, int)
    known = np.maximum(last, 0)
    return np.where(last >= 0, ends[known] + total - total[known], total) if n else ends


class _Vocabulary:
    """Bytes of every id, one after the other, and its decimal digits with what follows it in a group."""

    def __init__(self, pieces: list[bytes], end: str) -> None:
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.within = np.array([f"{i}," for i in range(len(pieces))], object)
        self.closing = np.array([f"{i}{end}" for i in range(len(pieces))], object)
        self.digits = np.array([len(str(i)) + 1 for i in range(len(pieces))], np.int64)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _in_each(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sums(values.astype(np.int64), counts)


class Aligner:
    """Both tokenizers, and what they make of the stretches met so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        known = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_words = _Vocabulary([known.get(i, b"") for i in range(max(known) + 1)], "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_words = _Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], ";")
        #: Whether texts may be cut at single spaces.
        self.cuts = not any(MARK in p[1:] and p.strip(MARK) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the bytes differ
        self.counts: list[np.ndarray] = []  # rows of (tokens of A, of B, links)
        self.links: list[np.ndarray] = []

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def _keep(self, fresh: list[str], groups: list[str | None], counts: np.ndarray, links: np.ndarray) -> None:
        n = len(self.groups)
        self.number.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.groups += groups
        self.counts.append(counts)
        self.links.append(links)

    def learn(self, fresh: list[str]) -> None:
        """Encodes stretches (without their space) and finds their groups, all at once: with their spaces they are one text, which falls
        apart at those (no stretch may begin or end with white space unless it is alone). Where its tokens do not spell it, halves of it are tried, down to the stretches that are not spelt."""
        if not fresh:
            return
        text = " ".join(fresh)
        coded, proto = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto")
        a_ids = np.array(coded.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64).reshape(-1, 2)
        b_all = np.fromiter((x for q in proto.pieces for x in (q.id, q.end)), np.int64).reshape(-1, 2)
        b_ids = b_all[:, 0]
        data = np.frombuffer((" " + text).encode(), np.uint8)
        if not all(int(w.lengths[ids].sum()) == len(data) and (w.spell(ids) == data).all() for w, ids in ((self.a_words, a_ids), (self.b_words, b_ids))):
            if len(fresh) == 1:
                self._keep(fresh, [None], np.zeros((1, 3), np.int64), np.zeros(0, np.int64))
            else:
                self.learn(fresh[: len(fresh) // 2])
                self.learn(fresh[len(fresh) // 2 :])
            return
        chars = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))])
        stop = place[np.cumsum(np.array(list(map(len, fresh))) + 1)]
        a_ends = refined_ends(place[spans[:, 0]], place[spans[:, 1]], self.a_words.lengths[a_ids])
        # B's spans follow one another; the space in front is the first piece's
        b_ends = refined_ends(np.concatenate([[0], b_all[:-1, 1] + 1]), b_all[:, 1] + 1, self.b_words.lengths[b_ids])
        n_a, n_b = (np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (a_ends, b_ends))
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        a_cut = b_ends[at] == a_ends
        b_cut = np.zeros(len(b_ends), bool)
        b_cut[at[a_cut]] = True
        links = b_ids[b_cut] * WIDTH + a_ids[a_cut]
        group = np.concatenate([2 * (np.cumsum(a_cut) - a_cut), 2 * (np.cumsum(b_cut) - b_cut) + 1])
        order = np.argsort(group, kind="stable")
        texts = np.concatenate([np.where(cut, w.closing[ids], w.within[ids]) for cut, w, ids in ((a_cut, self.a_words, a_ids), (b_cut, self.b_words, b_ids))])
        whole = "".join(texts[order].tolist())
        long = np.cumsum(_in_each(n_a, self.a_words.digits[a_ids]) + _in_each(n_b, self.b_words.digits[b_ids])).tolist()
        self._keep(fresh, [whole[i : j - 1] for i, j in zip([0, *long], long, strict=False)], np.column_stack([n_a, n_b, _in_each(n_a, a_cut)]), links)

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], list[np.ndarray]]:
        """(tokens of A, tokens of B, links, groups) and the linked pairs of each text."""
        lists = [self.stretches(t) if t else [] for t in texts]
        if len(self.number) > KNOWN:
            self.forget()
        fresh = list({s for x in lists for s in x if s not in self.number})
        joins = [s for s in fresh if self.cuts and not s[0].isspace() and not s[-1].isspace()]
        for some in (joins[k : k + 4000] for k in range(0, len(joins), 4000)):
            self.learn(some)
        for s in fresh:
            if s not in self.number:
                self.learn([s])
        self.counts, self.links = [np.concatenate(self.counts) if self.counts else np.zeros((0, 3), np.int64)], [np.concatenate(self.links) if self.links else np.zeros(0, np.int64)]
        n = self.counts[0][:, 2]
        starts, number, groups = np.cumsum(n) - n, self.number, self.groups
        rows, links = [], []
        for x in lists:
            at = [number[s] for s in x]
            parts = [groups[k] for k in at]
            if not parts or None in parts:
                rows.append((0, 0, 0, ""))
                links.append(np.zeros(0, np.int64))
                continue
            where = np.array(at)
            each = n[where]
            take = np.repeat(starts[where] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            rows.append((*map(int, self.counts[0][where].sum(axis=0)), ";".join(parts)))
            links.append(self.links[0][take])
        long = [s for s in fresh if len(s) > LONGEST]
        if sum(map(len, long)) > KEPT:
            self.forget()
        else:
            for s in long:
                self.groups[number.pop(s)] = None
        return rows, links


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_CHUNK = f"chunk bigint, docs array<struct<{', '.join(c.replace(' ', ': ') for c in _DOC.split(', '))}>>, codes array<bigint>, counts array<bigint>, links binary"
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def to_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents with their alignment, the distinct linked pairs and their counts, and the links as numbers of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, numbers = Aligner(a_path, b_path), new_ids()
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes, at, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            cells = [pa.array([next(numbers)], pa.int64()), pa.array([[dict(zip(_DOC_TYPE.names, r, strict=True)) for r in rows]], pa.list_(_DOC_TYPE)), pa.array([codes], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(at)], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["chunk", "docs", "codes", "counts", "links"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found, links = aligner.align(batch.column("text").to_pylist())
                for d, (a, b, n, groups), x in zip(batch.column("doc_id").to_pylist(), found, links, strict=True):
                    rows.append((d, a, b, n, n, hashlib.sha256(groups.encode()).hexdigest() if a or b else ""))
                    held.append(x)
                    size += len(x)
                if size >= LINKS:
                    yield out()
                    rows, held, size = [], [], 0
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(code, n, best): how many links of the corpus hold a pair, and whether no pair of its B id has more."""
    pairs = chunks.select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("n"))
    pairs = materialize(pairs)
    b = F.shiftright("code", 20)
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _tell(left: pa.Table, right: pa.Table) -> pa.Table:
    known = right.combine_chunks()
    by = np.argsort(known.column("code").to_numpy())
    code, n, best = known.column("code").to_numpy()[by], known.column("n").to_numpy()[by], known.column("best").to_numpy(zero_copy_only=False)[by].astype(np.int64)
    out = []
    for row in left.to_pylist():
        at = np.searchsorted(code, np.array(row["codes"], np.int64))[unpack(row["links"])]
        docs = pa.Table.from_pylist(row["docs"], schema=pa.schema(list(_DOC_TYPE)))
        each = docs.column("n_links").to_numpy()
        out.append(docs.append_column("n_best", pa.array(sums(best[at], each))).append_column("count_sum", pa.array(sums(n[at], each))))
    kinds = [(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")]
    return pa.concat_tables(out).select([k for k, _ in kinds]) if out else pa.schema(kinds).empty_table()


def align_documents(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    chunks = materialize(to_chunks(docs, a_path, b_path), keep=True)
    known = chunks.select(F.col("chunk").alias("of"), F.explode("codes").alias("code")).join(pair_counts(chunks), "code")
    return chunks.select("chunk", "docs", "codes", "links").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_tell, _RESULT)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
