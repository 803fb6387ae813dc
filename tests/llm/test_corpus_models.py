"""Language-model scores, token alignment and hard negatives against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from motiondeck.llm import chunks, hard_negatives, interpolation, token_align
from tests.llm.test_operators import AWKWARD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_packed_arrays_come_back():
    for values in ([], [0], [255, 0], [256] * 9, [2**40, 1]):
        assert chunks.unpack(chunks.pack(np.array(values, np.int64))).tolist() == values
    signed = np.array([[-5, 3], [2**40, -(2**40)]])
    assert (hard_negatives.unsqueeze(hard_negatives.squeeze(signed), 2) == signed).all()
    assert chunks.sums(np.arange(5), np.array([2, 0, 3])).tolist() == [1, 0, 9]


# 11: deleted interpolation


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_word_hashes_are_those_of_the_words(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAb é\n\t漢") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " ", "x" * 500, "y " * 300]
    ids = {}
    for size in (1 << 20, 64):
        monkeypatch.setattr(interpolation, "SLICE", size)
        hashes, counts = interpolation.WordHash().texts(pa.array(texts))
        assert counts.tolist() == [len(words(t)) - 1 for t in texts]
        for h, w in zip(hashes.tolist(), (w for t in texts for w in words(t)[:-1]), strict=True):
            assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


def brute_scores(rows):
    """(n_tokens, n_known, base, score) by dictionaries, with the weights of a plain EM over single held-out tokens."""
    fold = lambda d, m: zlib.crc32(str(d).encode()) % m
    role = {d: (2 if fold(d, 7) == 2 else deleted) for d, _, deleted in rows}

    def count(roles):
        one, two = Counter(), Counter()
        for d, t, _ in rows:
            if role[d] in roles:
                one.update(words(t))
                two.update(zip([None, *words(t)], words(t)))
        return one, two

    (c1, c2), (s1, s2) = count({0, 1}), count({0})
    n, v, n_stays = sum(c1.values()), len(c1), sum(s1.values())

    def parts(u, w, one, two, total):
        return [two[u, w] / one[u] if one[u] else 0.0, one[w] / total if total else 0.0, 1 / (v + 1)]

    events = {}
    for d, t, _ in rows:
        if role[d] == 1:
            for u, w in zip([None, *words(t)], words(t)):
                events.setdefault(s1[u].bit_length(), []).append(parts(u, w, s1, s2, n_stays))
    weights = {b: interpolation.expect(np.ones(len(e)), np.array(e)) for b, e in events.items()}
    return n, v, weights, {
        d: (len(words(t)), sum(c1[w] > 0 for w in words(t)), sum(math.log10((c1[w] + 1) / ((n + 1) * (v + 1))) for w in words(t)), [(c1[u].bit_length(), parts(u, w, c1, c2, n)) for u, w in zip([None, *words(t)], words(t))])
        for d, t, _ in rows
    }


def test_scores_are_those_of_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "THE", "the", "é", "漢"]
    texts = [(d, rng.choice(["", None]) if d % 29 == 0 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 60), weights=range(len(vocabulary), 0, -1)))) for d in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    deleted = {r.doc_id: int(r.d) for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).alias("d")).collect()}
    n, v, weights, expected = brute_scores([(d, t, deleted[d]) for d, t in texts])
    found, model = interpolation.score_texts(docs)
    assert (model.n, model.v) == (n, v) and np.allclose(model.weights.sum(axis=1), 1)
    for b, w in weights.items():
        assert np.allclose(model.weights[b], w, atol=0.02)
    for r in found.collect():
        n_tokens, n_known, base, tokens = expected[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n_tokens, n_known) and r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(sum(math.log10(model.weights[b] @ np.array(p)) for b, p in tokens))


def test_em_finds_the_weights_that_made_the_counts():
    rng = np.random.default_rng(2)
    parts = rng.dirichlet(np.ones(3), 5000)
    picked = rng.choice(3, 200_000, p=[0.6, 0.3, 0.1])
    events = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]])
    seen = np.array([rng.choice(3, p=events[k]) for k in picked[:20000]])
    estimates = events[:, seen].T
    assert np.allclose(interpolation.expect(np.ones(len(seen)), estimates), [0.6, 0.3, 0.1], atol=0.02) and len(parts)
    assert interpolation.expect(np.ones(2), np.array([[0.0, 0.5], [0.0, 0.1]]))[0] == 0


def test_held_out_texts_score_above_the_base(spark, sf_dir):
    found = interpolation.op11_deleted_interpolation(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert found[2] > 0 and found[0] > found[1]


def test_base_of_the_query_is_add_one(spark, tmp_path):
    texts = [(d, t) for d, t in enumerate(["The the A\x0bb", "", None, " \t", "a a a é\u00a0É x", "THE end", "b\rc\x00 c", "unseen"] * 5)] + [(0, "again"), (None, "the none")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {d: None if d is None else zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    counts = Counter(w for d, t in texts if held[d] is False for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(d), held[d], len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in words(t)), 9)) for d, t in texts)
    found = interpolation.op11_deleted_interpolation(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in found) == expected


def test_scores_of_awkward_rows_and_none(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    rows = interpolation.score_texts(docs)[0].collect()
    assert len(rows) == len(AWKWARD) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and Counter(r.doc_id for r in rows)[4] == 2
    assert [r.role for r in rows if r.doc_id is None] == [interpolation.SCORED]
    assert interpolation.score_texts(docs.limit(0))[0].count() == 0
    alone = interpolation.score_texts(docs.where("doc_id is null"))[0].collect()
    assert [(r.n_known, r.base_score) for r in alone] == [(0, 0.0)]


def test_scores_do_not_depend_on_chunks(spark, docs_small, monkeypatch):
    before = sorted(map(tuple, interpolation.score_texts(docs_small)[0].collect()))
    monkeypatch.setattr(interpolation, "CHUNK", 3000)
    after = sorted(map(tuple, interpolation.score_texts(docs_small.repartition(5))[0].collect()))
    assert [r[:4] for r in before] == [r[:4] for r in after] and np.allclose([r[4:] for r in before], [r[4:] for r in after])


@pytest.fixture(scope="module")
def docs_small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


# 12: token alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    of = token_align.byte_level()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    done = []
    for d, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        one, two = [bytes(of[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if text and (b"".join(one) != (" " + text).encode() or b"".join(two) != (" " + text).encode()):
            x = y = one = two = []
        ends = [{int(e): k for k, e in enumerate(np.cumsum([len(z) for z in side]))} for side in (one, two)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append((x[i : ends[0][cut] + 1], y[j : ends[1][cut] + 1]))
            i, j = ends[0][cut] + 1, ends[1][cut] + 1
        done.append((d, len(x), len(y), groups))
    n = Counter((g[0][-1], g[1][-1]) for *_, gs in done for g in gs)
    most = Counter()
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    out = []
    for d, x, y, gs in done:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in gs)
        out.append((d, x, y, len(gs), len(links), sum(n[z] == most[z[1]] for z in links), sum(n[z] for z in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


ODD = ["  two  spaces ", "a▁b", "ﬁ ﬀ① 漢字 \U0001f600é", "x\x00 y\x1f z\x85 w　v  ​", "<|endoftext|> <s> <0x41> </s>", "\n\n a\t b \r\n", "é ä \xa0 ᠎ q", "ÿ 👩‍👩‍👧 zé", " ", "don't we'll 12 345,6 ...!?"]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_alignment_is_that_of_brute_force(spark, docs_small):
    rng = random.Random(4)
    texts = [(10**9 + k, t) for k, t in enumerate([None, "", *ODD])]
    texts += [(2 * 10**9 + k, "".join(rng.choice("the é漢 \n\U0001f600a's9 ") for _ in range(rng.randint(1, 40)))) for k in range(200)]
    rows = [tuple(r) for r in docs_small.collect()] + texts
    found = token_align.align_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(brute_alignment(rows))


def test_stretches_are_whole_texts_cut_where_nothing_joins():
    aligner = token_align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert aligner.cuts and aligner.stretches("a b  c\n d") == ["a", "b  c\n d"] and aligner.stretches(" ") == [" "]


def test_ends_inside_a_character_come_from_bytes():
    def ends(spans, lengths):
        begin, end = np.array(spans).T
        return token_align.refined_ends(begin, end, np.array(lengths)).tolist()

    assert ends([(0, 4), (1, 4), (1, 4), (4, 6)], [2, 1, 1, 2]) == [2, 3, 4, 6]
    assert ends([(0, 1), (1, 1), (1, 1), (1, 4)], [1, 1, 1, 1]) == [1, 2, 3, 4]
    assert ends([(0, 0), (0, 3)], [1, 2]) == [1, 3]


def test_alignment_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(token_align, "LINKS", 50)
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    rows = [tuple(r) for r in token_align.align_documents(docs).collect()]
    assert sorted(rows, key=key) == sorted(brute_alignment([r[:2] for r in AWKWARD]), key=key)
    assert token_align.align_documents(docs.limit(0)).count() == 0


# 13: hard negatives


def brute_negatives(rows, k=5, m=3):
    part = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(256 * np.float64(x)) for x in v])
        part[i] = min(part.get(i, x), x)
    part = {i: ((lab + 1) % 10 if i % 7 == 0 else lab, v) for i, (lab, v) in part.items()}
    out = []
    for a, (lab, v) in part.items():
        if a % 50:
            continue
        scores = sorted((-sum(map(int.__mul__, v, w)), i, l2 == lab) for i, (l2, w) in part.items() if i != a)
        for p, positive, _ in [s for s in scores if s[2]][:k]:
            hard = [s for s in scores if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:m]
            out += [(a, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(rng, n, dim, spread):
    return [[float(np.float32(rng.gauss(0, spread))) for _ in range(dim)] for _ in range(n)]


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [{}, {"shard": 64, "block": 2, "sample": 40, "centroids": 3}])
def test_negatives_are_those_of_brute_force(spark, sizes):
    rng = random.Random(8)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(rng, 500, 6, 0.4))]
    rows += [(500 + i, rows[i % 3][1], i % 3) for i in range(150)]  # ties and copies
    rows += [(-50, rows[0][1], 1), (-49, [0.0] * 6, 0), (700, [1e5] * 6, 2)]
    rng.shuffle(rows)
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), **sizes)
    expected = brute_negatives(rows)
    assert len(expected) > 100 and sorted(map(tuple, found.collect())) == expected


def test_negatives_of_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.7, 0.1], 2), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 2), (None, [1.0, 1.0], 2), (8, [0.8, 0.0], None), (9, [0.6, 9.0], 3), (50, [-1.0, 0.0], 5), (51, [], 5)]
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("cell", F.lit(1)))
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows[:2], VECTORS)).count() == 0


def test_negatives_are_those_of_the_oracle(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = hard_negatives.op13_hard_negatives(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(hard_negatives.ORACLE).fetchall())


def test_bounds_hold_and_visits_descend():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (400, 7))
    books = (hard_negatives.codebook(v[:, :3], 4), hard_negatives.codebook(v[:, 3:], 5))
    shard = hard_negatives.Shard(np.arange(400), np.zeros(400, np.int64), v, books)
    for anchor in v[:20]:
        seen, last = 0, math.inf
        for most, least, a, b in shard.visits(anchor):
            scores = shard.v[a:b] @ anchor
            assert most <= last + 1e-6 and scores.max() <= most and scores.min() >= least
            seen, last = seen + b - a, most
        assert seen == 400
