"""Line dedup: lines that are the same up to small edits occur once in the corpus.

Lines (split at \\n) are normalised: letters and digits in lower case, character by character, and one space for each run of others
between them. A normalised line has a fingerprint of SimHash blocks, 64 bits each. A block is the SimHash (the bitwise majority) of
four words of the line that it draws by minimum hash, longer words first, so an edit changes the few blocks that draw an edited word and
leaves the others alone: lines whose fingerprints differ in all blocks but one still agree in that one (pigeonhole), and lines
that agree in a block are candidates. (A SimHash of all words of a line moves in most of its blocks with any edit: of lines with one
word of ten replaced, one in thirty stays within 3 of 64 bits.) Short lines, and those with few words for their length, have blocks that draw character n-grams,
and for lines of at most ``TINY`` characters all that deletions can leave are keys too, which misses no pair of them. A plain SimHash of all words spares
the verification of candidates that differ in over ``SKETCH`` bits, and the words drawn that of those with over ``UNLIKE`` other draws of 32 (lines that
share a long passage and little else); lines of fewer than ``WORDY`` words have neither, those that draw n-grams have no such words. Of lines of up to ``SHORT``
characters a bitmap of their pairs of characters rules out what no number of allowed edits can make alike, and nothing else. Candidates are verified
by edit similarity, 1 - levenshtein / longer length >= ``similarity``. Of each connected group of lines
the occurrence with the smallest (doc_id, line number) stays and all others are removed; equal
normalised lines are one group from the start.

Lines without a letter or digit are never removed. Null text stays null, has no lines. Rows that repeat a doc_id
are the same document: a line stays in each of them or in none. A null doc_id sorts first.
Only doc_id and text are read; other columns pass through ``dedup_lines`` untouched, whatever their names but ``__lines``, ``__gone``, ``__drop`` and ``__id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from motiondeck.llm.align import within
from motiondeck.llm.common import materialize, mix64, shuffle_parts, table, temporary
from motiondeck.llm.links import SMALL, components, filter_bits, filter_size, in_filter, linked, sized

#: Up to this length (characters) lines are found by deletions, exactly.
TINY = 14
#: Up to this length blocks draw n-grams of characters, from WORDS_FROM on they draw words; a pair of a similarity of 0.8 is within one of them.
SHORT, WORDS_FROM = 64, 32
#: A line of more characters a word than this draws n-grams too, such as one in a script without spaces.
LONG_WORDS = 12
#: Blocks of words and of n-grams, how many each draws, and n.
BLOCKS, DRAWS, GRAM_BLOCKS, GRAM_DRAWS, GRAM = 8, 4, 16, 3, 4
#: Words of fewer characters are mostly those that any line may have; a block draws them only for want of others.
BRIEF = 5
#: Bits in which the SimHashes of candidates of at least WORDY words may differ.
SKETCH, WORDY = 18, 8
#: Draws, of the BLOCKS * DRAWS of a line's words, in which such candidates may differ. A fifth of the words replaced makes some nine differ.
UNLIKE = 14
#: Longs of the bitmap of pairs of characters that a line of up to SHORT characters has.
BITMAP = 8
#: Rounds of hubs end when one links less than this share of the pairs it verifies; the comparison across groups takes what is left.
WORTH = 0.05
#: Keys of more lines than this are first held against one of them.
PAIRWISE = 4
#: Lines that a task remembers to have met, so as to give keys once.
REMEMBERED = 1 << 19
#: Keys that a task packs at a time for the shuffle.
HELD = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """For every code point its lower case if that is one letter or digit (itself if it is more), 1 for \\n, else 0; 4 MB."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[ord("\n")] = 1
    return out


class Lines:
    """The normalised lines of texts, those with a letter or digit: ``number`` (of all lines, one after another),
    the hashes of their ``words``, the ``first`` and the ``counts`` of each line's words, and their ``sizes`` in characters."""

    def __init__(self, texts: list[str], of: np.ndarray):
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mapped = of[codes]
        inside = mapped > 1
        before = np.zeros(len(mapped), dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~before)
        breaks = mapped == 1
        self.starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])  # of lines, in all that was joined
        chars = mapped[inside]
        at = np.cumsum(inside, dtype=np.int64)[starts] - 1
        line = np.cumsum(breaks, dtype=np.int64)[starts]
        lens = np.diff(np.append(at, len(chars)))
        self.brief = lens < BRIEF
        self.words = np.zeros(0, dtype=np.uint64)
        if len(at):
            place = (np.arange(len(chars)) - np.repeat(at, lens)).astype(np.uint64)
            self.words = mix64(np.add.reduceat(mix64(chars + (place << np.uint64(32))), at))
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.number = line[self.first]
        self.counts = np.diff(np.append(self.first, len(at)))
        self.sizes = (np.add.reduceat(lens, self.first) if len(at) else np.zeros(0, dtype=np.int64)) + self.counts - 1
        # characters with a space after each word
        self._flat = np.full(len(chars) + len(at), ord(" "), dtype=np.uint32)
        self._flat[np.arange(len(chars)) + np.repeat(np.arange(len(at)), lens)] = chars
        self._from = at[self.first] + self.first if len(at) else at

    def __len__(self) -> int:
        return len(self.number)

    def text(self, i: int) -> str:
        return self._flat[self._from[i] : self._from[i] + self.sizes[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash of each line in two halves."""
        if not len(self):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        k = (np.arange(len(self.words)) - np.repeat(self.first, self.counts)).astype(np.uint64)
        one = np.add.reduceat(mix64(self.words + k * _GOLDEN), self.first)
        two = np.add.reduceat(mix64((self.words ^ _GOLDEN) * (k + k + np.uint64(1))), self.first)
        return one.view(np.int64), two.view(np.int64)

    def simhashes(self, some: np.ndarray) -> np.ndarray:
        """64-bit SimHashes of some lines: the sign of the sum over their words, bit by bit. Eight bits are summed
        at a time, as the bytes of one 64-bit number, over at most 255 words."""
        if not len(some):
            return np.zeros(0, dtype=np.int64)
        counts, words = self.counts[some], self.words[self._of(some)]
        first = np.cumsum(counts) - counts
        lanes = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        parts = -(-counts // 255)
        of = np.repeat(np.arange(len(counts)), parts)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        sums = np.add.reduceat(lanes, first[of] + 255 * inner, axis=0).view(np.uint8).astype(np.int64)
        if len(of) > len(counts):
            sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
        return np.packbits(2 * sums > counts[:, None], axis=1).view(np.int64).ravel()

    def _of(self, some: np.ndarray) -> np.ndarray:
        """The places of the words of some lines."""
        counts = self.counts[some]
        return np.repeat(self.first[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def word_blocks(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that draw words, and four bits of every draw, 16 draws a number."""
        counts, at = self.counts[some], self._of(some)
        return drawn(self.words[at], np.cumsum(counts) - counts, BLOCKS, DRAWS, 0, self.brief[at])

    def gram_blocks(self, some: np.ndarray) -> np.ndarray:
        """Blocks that draw n-grams, or the whole line if it is shorter."""
        sizes = self.sizes[some]
        ends = np.cumsum(sizes + GRAM)
        at = ends - sizes - GRAM
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
        place = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        flat[place] = self._flat[np.repeat(self._from[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        grams = np.zeros(max(0, len(flat) - GRAM + 1), dtype=np.uint64)
        for k in range(GRAM):
            grams = mix64(grams + flat[k : k + len(grams)] + np.uint64(1))
        counts = np.maximum(1, sizes - GRAM + 1)
        first = np.cumsum(counts) - counts
        return drawn(grams[np.repeat(at - first, counts) + np.arange(counts.sum())], first, GRAM_BLOCKS, GRAM_DRAWS, 1)[0]

    def bitmaps(self, some: np.ndarray) -> np.ndarray:
        """A row a line: BITMAP longs with a bit for every pair of neighbouring characters, the second and later occurrences of a pair apart."""
        counts = self.sizes[some] - 1
        row = np.repeat(np.arange(len(some)), counts)
        at = np.repeat(self._from[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pairs = np.stack([self._flat[at], self._flat[at + 1]]).astype(np.uint64)
        pairs = mix64(pairs[0] << np.uint64(21) | pairs[1]) >> np.uint64(32) | row.astype(np.uint64) << np.uint64(32)
        pairs.sort()  # by line, so that row stays as it is
        begins = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
        occurrence = np.arange(len(pairs)) - np.repeat(begins, np.diff(np.append(begins, len(pairs))))
        out = np.zeros((len(some), 64 * BITMAP), dtype=bool)
        out[row, mix64((pairs & np.uint64(0xFFFFFFFF)) + (occurrence.astype(np.uint64) << np.uint64(32))) % np.uint64(64 * BITMAP)] = True
        return np.packbits(out, axis=1).view(np.int64)


def drawn(hashes: np.ndarray, first: np.ndarray, blocks: int, draws: int, kind: int, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row a line (its hashes begin at first), a column a block: the SimHash of the ``draws`` (three or four) hashes that are the
    least under as many permutations, with the number of the block mixed in. Late ones come in the last eighth of the order.
    Then four bits of each draw, 16 draws a number."""
    out = np.zeros((len(first), blocks), dtype=np.uint64)
    bits_of = np.zeros((len(first), blocks * draws // 16), dtype=np.uint64)
    low = hashes.astype(np.uint32)
    shift, top = (np.uint32(0), np.uint32(0)) if late is None else (late * np.uint32(3), late * np.uint32(7 << 29))
    lots = mix64(np.arange(1, blocks * draws + 1, dtype=np.uint64))
    odd, flip = lots.astype(np.uint32) | np.uint32(1), (lots >> np.uint64(32)).astype(np.uint32)
    for b in range(blocks if len(first) else 0):
        x, y, z, *w = got = [mix64(np.minimum.reduceat((low ^ flip[k]) * odd[k] >> shift | top, first).astype(np.uint64) + np.uint64(1)) for k in range(b * draws, (b + 1) * draws)]
        for k, draw in enumerate(got, b * draws):
            bits_of[:, k // 16] |= (draw & np.uint64(15)) << np.uint64(k % 16 * 4)
        bits = x & y & (z | w[0]) | z & w[0] & (x | y) if w else x & y | y & z | x & z
        out[:, b] = mix64(bits + np.uint64(2 * b + kind))
    return out, bits_of.view(np.int64)


def normal(line: str) -> str:
    """A line in normal form, empty if it has no letter or digit."""
    found = Lines([line], letters())
    return found.text(0) if len(found) else ""


def deletions(line: str, similarity: float) -> set[str]:
    """What is left of a line after as many deletions as there may be edits to any line of at most TINY characters."""
    share = round(1000 - 1000 * similarity)
    most = max((m * share // 1000 for m in range(len(line), TINY + 1) if m - len(line) <= m * share // 1000), default=0)
    found = last = {line}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


def line_keys(lines: Lines, some: np.ndarray, similarity: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The keys of some lines: their blocks, and what deletions leave of tiny ones. Then which of them draw words alone, and the bits of these draws."""
    sizes, counts = lines.sizes[some], lines.counts[some]
    wordy = np.flatnonzero(sizes >= WORDS_FROM)
    short = np.flatnonzero((sizes <= SHORT) | (sizes > LONG_WORDS * counts))
    owners = [np.repeat(wordy, BLOCKS), np.repeat(short, GRAM_BLOCKS)]
    blocks, draws = lines.word_blocks(some[wordy])
    long = ~np.isin(wordy, short)
    keys = [blocks.ravel(), lines.gram_blocks(some[short]).ravel()]
    for i in np.flatnonzero(sizes <= TINY).tolist():
        left = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in deletions(lines.text(some[i]), similarity)]
        owners.append(np.full(len(left), i))
        keys.append(np.array(left, dtype=np.uint64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(some)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(keys)[order].view(np.int64))), wordy[long], draws[long]


MAPS = [f"map{k}" for k in range(BITMAP)]
OCCURRENCE = f"doc_id bigint, line int, id bigint, tail bigint, sim bigint, draw1 bigint, draw2 bigint, {', '.join(f'{m} bigint' for m in MAPS)}, size int, keys array<bigint>"
_OCCURRENCE = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), *((c, pa.int64()) for c in ("id", "tail", "sim", "draw1", "draw2", *MAPS)), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])


def _numbered(batches: Iterator[pa.RecordBatch], of: np.ndarray, rows: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Lines]]:
    """For a few documents at a time (a task holds no more): where the doc_id is null, and of each normalised line its doc_id, its number in the document and the lines."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            part = part.filter(part.column("text").is_valid())
            texts = part.column("text").to_pylist()
            if not texts:
                continue
            lines = Lines(texts, of)
            ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
            first = np.searchsorted(lines.starts, np.append(0, ends[:-1]))  # of each document among all lines
            doc = np.searchsorted(first, lines.number, side="right") - 1
            ids = part.column("doc_id")
            yield ids.is_null().to_numpy(zero_copy_only=False)[doc], ids.fill_null(-1).to_numpy(zero_copy_only=False)[doc], lines.number - first[doc], lines


def _occurrences(of, similarity: float):
    """OCCURRENCE of every line with a letter or digit; size and keys are null where the task has met the line (it remembers
    up to REMEMBERED lines at a time; giving keys once more changes nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for none, doc, number, lines in _numbered(batches, of.value):
            ids, tails = lines.ids()
            some = np.sort(np.unique(ids, return_index=True)[1])
            some = some[[i not in known for i in ids[some].tolist()]] if known else some
            if len(known) + len(some) > REMEMBERED:
                known.clear()
            known.update(ids[some].tolist())
            fresh = np.zeros(len(ids), dtype=bool)
            fresh[some] = True
            sims, few = np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
            wordy = some[lines.counts[some] >= WORDY]
            sims[wordy], few[wordy] = lines.simhashes(wordy), False
            keys, worded, bits = line_keys(lines, some, similarity)
            draws, none_drawn = np.zeros((len(ids), 2), dtype=np.int64), few.copy()
            none_drawn[some] = True
            draws[some[worded]], none_drawn[some[worded]] = bits, few[some[worded]]
            brief = some[lines.sizes[some] <= SHORT]
            maps, unmapped = np.zeros((len(ids), BITMAP), dtype=np.int64), np.ones(len(ids), dtype=bool)
            maps[brief], unmapped[brief] = lines.bitmaps(brief), False
            counts = np.zeros(len(ids) + 1, dtype=np.int32)
            counts[some + 1] = np.diff(keys.offsets.to_numpy())
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), keys.values, mask=pa.array(~fresh))
            columns = [pa.array(doc, mask=none), pa.array(number, pa.int32()), pa.array(ids), pa.array(tails), pa.array(sims, mask=few), *(pa.array(d, mask=none_drawn) for d in draws.T.copy()), *(pa.array(m, mask=unmapped) for m in maps.T.copy()), pa.array(lines.sizes, pa.int32(), mask=~fresh), keys]
            yield pa.RecordBatch.from_arrays(columns, schema=_OCCURRENCE)

    return run


def _slot(doc_id, line, size: int):
    """The place in a filter of a line of a document, of numpy arrays as of Columns."""
    return (doc_id % size * 1000003 + line * 7919) % size


def _texts(of, wanted, size: int):
    """(id, plain) of lines at flagged places; no others are normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(batch.column("text").is_valid())
            parts = [x.split("\n") for x in part.column("text").to_pylist()]
            counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            doc = np.repeat(part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), counts)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = [x for one in parts for x in one]
            at = np.flatnonzero(in_filter(wanted.value, _slot(doc, number, size))).tolist()
            for k in range(0, len(at), 10000):
                lines = Lines([flat[i] for i in at[k : k + 10000]], of.value)
                ids, some = np.unique(lines.ids()[0], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([lines.text(i) for i in some.tolist()], pa.string())], names=["id", "plain"])

    return run


def _alike(similarity: float):
    """Pairs whose lines differ by at most a share of the longer one."""
    share = round(1000 - 1000 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                pairs = list(zip(part.column("pa").to_pylist(), part.column("pb").to_pylist(), strict=True))
                keep = within(pairs, [max(len(x), len(y)) * share // 1000 for x, y in pairs])
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: What decides, before any text is read, whether two lines can be alike.
FACTS = ["sim", "size", "draw1", "draw2", *MAPS]


def unlike(x: Column, y: Column) -> Column:
    """How many of the 16 draws in two numbers differ."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x1111111111111111)))


def apart(x: Callable, y: Callable) -> Column:
    """The most pairs of characters that one of two lines is known to have and the other lacks (null unless both have bitmaps). An edit
    takes away two at most, so of lines within d edits there are 2 d at most."""

    def only(one: Callable, two: Callable) -> Column:
        return reduce(Column.__add__, [F.bit_count(one(m).bitwiseAND(F.bitwise_not(two(m)))) for m in MAPS])

    return F.greatest(only(x, y), only(y, x))


def _dealt(parts: int):
    """Keys and ids of many lines as packed arrays, a row for each part of the keys that a task has met."""

    def packed(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, id = np.concatenate(keys), np.concatenate(ids)
        part = (key.view(np.uint64) >> np.uint64(24)) % np.uint64(parts)
        order = np.argsort(part)
        part, key, id = part[order], key[order], id[order]
        first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)).tolist()
        ends = [*first[1:], len(part)]
        columns = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (key, id)]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "keys", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            lists = batch.column("keys")
            keys.append(lists.flatten().to_numpy())
            ids.append(np.repeat(batch.column("id").to_numpy(), lists.value_lengths().to_numpy()))
            held += len(keys[-1])
            if held >= HELD:
                yield packed(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield packed(keys, ids)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, n) of the keys of a partition that two lines or more have, each pair once; n is how many lines."""
    keys, ids = [], []
    for batch in batches:
        for out, name in ((keys, "keys"), (ids, "ids")):
            out += [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(name)]
    if not keys:
        return
    key, id = np.concatenate(keys), np.concatenate(ids)
    del keys, ids
    order = np.argsort(key)
    key, id = key[order], id[order]
    same = key[1:] == key[:-1]
    some = np.append(same, False) | np.append(False, same)
    key, id = key[some], id[some]
    order = np.lexsort((id, key))
    key, id = key[order], id[order]
    once = np.append(True, (key[1:] != key[:-1]) | (id[1:] != id[:-1]))[: len(key)]
    key, id = key[once], id[once]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    counts = np.diff(np.append(first, len(key)))
    n = np.repeat(counts, counts)
    key, id, n = key[n > 1], id[n > 1], n[n > 1]
    for k in range(0, len(key), 10000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 10000]) for x in (key, id, n)], names=["key", "id", "n"])


def _of_ids(wanted, size: int):
    """Rows whose ids are flagged: all that are wanted and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(wanted.value, batch.column("id").to_numpy() % size)))

    return run


def line_buckets(firsts: DataFrame, similarity: float) -> DataFrame:
    """(key, id, *FACTS, n) of keys that two lines or more share. Crowded keys are split by length, into classes of which two similar lines share one."""
    dealt = firsts.select("id", "keys").mapInArrow(_dealt(4 * shuffle_parts(firsts.sparkSession)), "part int, keys binary, ids binary")
    found = materialize(dealt.repartition("part").mapInArrow(_shared, "key bigint, id bigint, n bigint"))
    ids = found.select("id").distinct()
    size = filter_size(ids.count())
    wanted = firsts.sparkSession.sparkContext.broadcast(filter_bits(ids, F.pmod("id", F.lit(size)), size))
    facts = firsts.select("id", *FACTS)
    facts = facts.mapInArrow(_of_ids(wanted, size), facts.schema).groupBy("id").agg(*[F.min(c).alias(c) for c in FACTS])
    found = materialize(found.join(facts, "id"))
    step = F.floor(F.log("size") / F.lit(-math.log(similarity)) * F.lit(1 - 1e-9)) if 0 < similarity < 1 else F.lit(0)
    classes = F.array(*[F.xxhash64(F.col("key"), (step + k).cast("bigint")) for k in (0, 1)])
    crowded = found.where(F.col("n") > SMALL).select("id", *FACTS, F.explode(classes).alias("key"))
    columns = ["key", "id", *FACTS, "n"]
    return materialize(found.where(F.col("n") <= SMALL).select(*columns).unionAll(sized(crowded, FACTS).select(*columns)))


def dropped_lines(docs: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """(doc_id, line) of every occurrence that goes."""
    with temporary(docs.sparkSession):
        return materialize(_dropped(docs, similarity), keep=True)


def _dropped(docs: DataFrame, similarity: float) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    of = sc.broadcast(letters())
    found = materialize(docs.mapInArrow(_occurrences(of, similarity), OCCURRENCE))
    firsts = found.where("size is not null")
    share = round(1000 - 1000 * similarity)

    def fits(x, y):
        return 1000 * F.abs(x("size") - y("size")) <= share * F.greatest(x("size"), y("size")).cast("bigint")

    def admissible(x, y):
        near = F.bit_count(x("sim").bitwiseXOR(y("sim"))) <= SKETCH
        same = unlike(x("draw1"), y("draw1")) + unlike(x("draw2"), y("draw2")) <= UNLIKE
        edits = F.floor(share * F.greatest(x("size"), y("size")) / 1000)
        return F.coalesce(near, F.lit(True)) & F.coalesce(same, F.lit(True)) & fits(x, y) & F.coalesce(apart(x, y) <= 2 * edits, F.lit(True))

    def prepare(ids: DataFrame):
        places = materialize(firsts.join(ids.distinct(), "id", "left_semi").select("doc_id", "line"))
        size = filter_size(places.count())
        slot = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(size)) * 1000003 + F.col("line").cast("bigint") * 7919, F.lit(size))
        wanted = sc.broadcast(filter_bits(places, slot, size))
        texts = materialize(docs.mapInArrow(_texts(of, wanted, size), "id bigint, plain string").groupBy("id").agg(F.first("plain").alias("plain")))

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(texts.select(F.col("id").alias("a"), F.col("plain").alias("pa")), "a").join(texts.select(F.col("id").alias("b"), F.col("plain").alias("pb")), "b")
            return both.select("a", "b", "pa", "pb").mapInArrow(_alike(similarity), "a bigint, b bigint")

        return verify

    groups = components(linked(line_buckets(firsts, similarity), FACTS, admissible, prepare, pairwise=PAIRWISE, rounds=8, worth=WORTH, once=True))
    # a line that is linked to none is a group of its own
    group = [F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("tail")).alias("of")]
    seen = found.groupBy("id", "tail").agg(F.count("*").alias("n")).join(groups, "id", "left").where("n > 1 or root is not null").select("id", "tail", *group)
    met = materialize(found.select("doc_id", "line", "id", "tail").join(seen, ["id", "tail"]).select("doc_id", "line", "root", "of"))
    stays = met.groupBy("root", "of").agg(F.min(F.struct("doc_id", "line")).alias("stays")).withColumnsRenamed({"root": "r", "of": "o"})
    repeated = met.join(stays, (F.col("root") == F.col("r")) & F.col("of").eqNullSafe(F.col("o")))
    return repeated.where(~F.struct("doc_id", "line").eqNullSafe(F.col("stays"))).select("doc_id", "line")


def dedup_lines(docs: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """docs with the lines that go taken out of text, and two more columns, the numbers of its ``__lines`` and of those ``__gone``."""
    gone = dropped_lines(docs, similarity=similarity).distinct().groupBy("doc_id").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(gone, docs.doc_id.cast("bigint").eqNullSafe(F.col("__id")), "left").drop("__id")
    schema = StructType([*docs.schema.fields]).add("__lines", IntegerType()).add("__gone", IntegerType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, went = [], [], []
            for t, drop in zip(batch.column("text").to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                parts = [] if t is None else t.split("\n")
                lines.append(len(parts))
                went.append(len(drop or ()))
                if drop:
                    out = set(drop)
                    t = "\n".join(x for k, x in enumerate(parts) if k not in out)
                texts.append(t)
            columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema if f.name != "__drop"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(went, pa.int32())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op4_line_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__lines").cast("bigint").alias("n_lines"), F.col("__gone").cast("bigint").alias("n_dropped"), "text")
