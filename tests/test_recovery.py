"""Matching by edges, neighbours by cells, native smoothing, whole-body tracks and the fallback ladder: tables, streams and brute force."""

import json
import math
import random
import tracemalloc
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiondeck.operators import fallback, fusion, grading, graph, matching, near, report
from motiondeck.plans import recovery
from motiondeck.streaming import wholebody
from motiondeck.streaming.filters import Euro, euro_step
from motiondeck.streaming.ordered import run_ordered_stream

# matching by edges


def best_matching(edges):
    """(pairs, cost) of the largest and then cheapest matching, by trying all."""
    best = (0, 0.0)

    def go(k, left, right, n, cost):
        nonlocal best
        best = min(best, (-n, cost))
        for i in range(k, len(edges)):
            a, b, c = edges[i]
            if a not in left and b not in right:
                go(i + 1, left | {a}, right | {b}, n + 1, cost + c)

    go(0, frozenset(), frozenset(), 0, 0.0)
    return -best[0], best[1]


def test_sparse_assignment_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        edges = [(i, j, rng.choice([rng.random(), float(rng.randint(-3, 3))])) for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5)) if rng.random() < 0.5]
        a, b, c = (np.array([e[k] for e in edges]) for k in range(3))
        chosen = matching.sparse_assignment(a, b, c.astype(float))
        n, cost = best_matching(edges)
        assert len(chosen) == n == len(set(a[chosen])) == len(set(b[chosen])) and c[chosen].sum() == pytest.approx(cost)


def test_matching_by_connected_groups_is_the_whole_one(spark):
    rng = random.Random(2)
    rows = [(k, i, j, rng.random()) for k in ("a", None) for i in range(60) for j in range(60) if rng.random() < 0.03]
    rows += [("a", 1, None, 0.1), ("a", 1, 2, float("nan")), ("a", 1, 3, None), ("b", 1, 1, 0.5), ("b", 1, 1, 0.4)]
    df = spark.createDataFrame(rows, "k string, l int, r int, cost double")
    whole = sorted(map(str, matching.match(df, ["k"], "l", "r").collect()))
    assert sorted(map(str, matching.match(df, ["k"], "l", "r", whole=0).collect())) == whole
    assert "Row(k='b', l=1, r=1, cost=0.4)" in whole
    for k in ("a", None):
        edges = [(i, j, c) for g, i, j, c in rows if g == k and j is not None and c is not None and c == c]
        mine = matching.sparse_assignment(*(np.array([e[n] for e in edges]) for n in range(3)))
        assert len(mine) == sum(f"k={k!r}," in r for r in whole)
    assert matching.match(df.limit(0), ["k"], "l", "r").count() == 0
    assert len(matching.match(df.where("k = 'a'").drop("k"), [], "l", "r", whole=5).collect()) == sum("k='a'" in r for r in whole)


def test_connected_groups(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 200)] + [(500, 500)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert sorted(map(tuple, found)) == sorted((x, find(x)) for x in root)


def test_near_pairs_and_overlap_by_cells(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, rng.uniform(-1, 1) if i % 17 else None, rng.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, k int, x double, y double")
    right = df.select("k", F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    found = graph.near_pairs(df, right, ["k"], ["x", "y"], ["u", "v"], 0.2).select("i", "j").collect()
    close = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and None not in (a[2], b[2]) and math.hypot(a[2] - b[2], a[3] - b[3]) < 0.2}
    assert len(found) == len(close) and set(map(tuple, found)) == close
    spots = df.withColumnsRenamed({"x": "cx", "y": "cy"})
    left = matching.without_overlap(spots.where("i % 3 = 0"), spots.where("i % 3 = 1"), ["k"], 0.2).select("i").collect()
    assert {r.i for r in left} == {a[0] for a in rows if a[0] % 3 == 0 and not any((a[0], b[0]) in close for b in rows if b[0] % 3 == 1)}


# smoothing by windows


@pytest.mark.parametrize("window, order", [(11, 3), (5, 2)])
def test_savgol_by_windows_is_the_kernel(spark, window, order):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for n, series in enumerate([40, 11, 12, 10, 9, 7, 5, 4, 3, 1, 60]):
        v = rng.normal(size=series).cumsum()
        if n in (0, 10):
            v[[3, 4, 5, 12, 20, 21, 22, 23, 24, 25, 26]] = np.nan
            v[0] = np.nan
        seen = rng.random(series) > 0.1 if n == 10 else np.ones(series, bool)
        expected[n] = matching.savgol(np.where(seen, v, np.nan), window, order)
        rows += [(n, i, None if np.isnan(x) and i % 2 else float(x), float(i), [1.0, [0.0, -1.0, None, float("nan"), float("inf")][i % 5]][not s], f"t{i}") for i, (x, s) in enumerate(zip(v, seen, strict=True))]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "k int, i int, x double, y double, x_vis double, note string")
    found = matching.savgol_series(df, ["k"], ["i"], ["x", "y"], window, order, {"x": "x_vis"})
    assert found.columns == df.columns and found.count() == len(rows)
    for n, e in expected.items():
        got = [np.nan if r.x is None else r.x for r in found.where(F.col("k") == n).orderBy("i").collect()]
        assert np.allclose(got, e, equal_nan=True), n
    assert all(r.note == f"t{r.i}" for r in found.collect())
    with pytest.raises(ValueError):
        matching.savgol_series(df, ["k"], ["i"], ["x"], 4, 2)


def test_short_gaps_are_filled_and_carried_points_have_no_say(spark):
    rows = [(0, i, float(i * i), 1.0) for i in range(9)]
    out = []
    for wild in (1e6, -1e6):
        df = spark.createDataFrame([(k, i, wild if i == 4 else x, 0.0 if i == 4 else c) for k, i, x, c in rows], "k int, i int, x double, c double")
        out.append([r.x for r in matching.savgol_series(df, ["k"], ["i"], ["x"], 5, 2, {"x": "c"}).orderBy("i").collect()])
    assert out[0] == out[1] and None not in out[0] and max(out[0]) < 100


def test_clamped_joints_are_those_of_the_kernel(spark):
    rng = random.Random(6)
    limits = [(0, 1, 2, [2, 3], 30.0, 170.0), (1, 2, 3, [3], 60.0, 90.0), (3, 0, 1, [1], 0.0, 10.0)]
    rows = [(n, [(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.random()) for _ in range(4)]) for n in range(60)]
    rows[0] = (0, [(0.0, 0.0, 0.0)] * 4)
    rows[1] = (1, [(float("nan"), 0.0, 0.0), *rows[1][1][1:]])
    df = spark.createDataFrame(rows, "n int, points array<struct<x: double, y: double, z: double>>")
    for r in matching.clamp_joints(df, "points", limits).collect():
        p, hits = np.array(rows[r.n][1]), 0
        for limit in limits:
            p, hit = matching.clamp_joint(p, *limit)
            hits += hit
        assert r.clamps == hits and np.allclose([tuple(q) for q in r.points], p, equal_nan=True)


# whole bodies


def brute_tracks(frames, p):
    """The rule written out track by track and point by point; people are so far apart that who is who is plain."""
    tracks, number, out = [], 0, []
    for f, t, people in frames:
        matched, born = {}, []
        for k, (points, scores) in enumerate(people):
            s = [min(1.0, max(0.0, c)) if math.isfinite(x) and math.isfinite(y) and math.isfinite(c) else 0.0 for (x, y), c in zip(points, scores, strict=True)]
            if not any(s):
                continue
            mid = [sum(w * q[d] for w, q in zip(s, points, strict=True) if w) / sum(s) for d in (0, 1)]
            best = min((j for j in range(len(tracks)) if j not in matched), key=lambda j: math.dist(mid, tracks[j]["mid"]), default=None)
            if best is not None and math.dist(mid, tracks[best]["mid"]) < p.reach:
                matched[best] = (k, points, s)
            else:
                born.append((k, points, s))
        after = []
        for j, k, points, s in sorted([(j, *m) for j, m in matched.items()] + [(None, *b) for b in born], key=lambda x: x[1]):
            tr = tracks[j] if j is not None else {"id": number, "age": 0, "scores": s, "euro": [None] * len(p.regions(len(points)))}
            number += j is None
            parts = [euro_step(e, np.array(points[a:b]), t, np.array(s[a:b]), q) for e, (a, b, q) in zip(tr["euro"], p.regions(len(points)), strict=True)]
            pts = [tuple(x) for _, o in parts for x in o.tolist()]
            mean = [p.score_alpha * c + (1 - p.score_alpha) * o for c, o in zip(s, tr["scores"], strict=True)]
            speed = [v for e, _ in parts for v in e["dx"]]
            after.append({"id": tr["id"], "age": tr["age"] + 1, "misses": 0, "scores": mean, "euro": [e for e, _ in parts], "pts": pts, "speed": speed, "t": t, "row": (k, [min(m, c) for m, c in zip(mean, s, strict=True)])})
        for j, tr in enumerate(tracks):
            if j in matched or tr["misses"] >= p.carry:
                continue
            misses = tr["misses"] + 1
            pts = []
            for (x, y), (vx, vy) in zip(tr["pts"], tr["speed"], strict=True):
                dx, dy = (v * (t - tr["t"]) * p.damping**misses for v in (vx, vy))
                size = math.hypot(dx, dy)
                scale = min(1.0, p.reach / size) if size else 1.0
                pts.append((x + dx * scale, y + dy * scale))
            after.append({**tr, "age": max(0, tr["age"] - 1), "misses": misses, "scores": [c * p.fade for c in tr["scores"]], "pts": pts, "t": t, "row": (None, [0.0] * len(pts))})
        for tr in after:
            total = sum(tr["scores"])
            tr["mid"] = [sum(w * q[d] for w, q in zip(tr["scores"], tr["pts"], strict=True)) / total for d in (0, 1)]
        tracks = after
        out += [(f, tr["id"], tr["row"][0], tr["age"], tr["misses"], tr["pts"], tr["row"][1]) for tr in tracks if tr["age"] >= p.min_age]
    return out


def people_of(rng, n, frames, gone=0.2):
    out = []
    for f in range(frames):
        people = []
        for k in range(2):
            if rng.random() > gone:
                scores = [rng.random() if rng.random() > 0.1 else rng.choice([0.0, float("nan"), 1.5]) for _ in range(n)]
                people.append(([(2000.0 * k + f + i + rng.gauss(0, 1), float(i) + rng.gauss(0, 1)) for i in range(n)], scores))
        if f % 11 == 5:
            people.append(([(float("nan"), 1.0)] * n, [1.0] * n))
        out.append((f, f / 30, people))
    return out


def as_rows(video, frames):
    return [(video, f, t, [{"points": [{"x": x, "y": y} for x, y in points], "scores": scores} for points, scores in people]) for f, t, people in frames]


@pytest.mark.parametrize("known", [1 << 24, 0])
@pytest.mark.parametrize("seed", range(30))
def test_near_points_match_as_their_pairs_do(monkeypatch, seed, known):
    monkeypatch.setattr(near, "KNOWN", known)
    rng = np.random.default_rng(seed)
    (n, m), wide = rng.integers(1, 60, 2), rng.choice([0.2, 0.5, 1.0])
    a, b = (rng.random((k, 3)) * wide - 0.1 for k in (n, m))
    if seed % 3 == 0:  # ties
        a, b = np.round(a * 20) / 20, np.round(b * 20) / 20
    ids, others = (rng.integers(0, k, k) if seed % 5 == 0 else np.arange(k) for k in (n, m))
    (_, ids), (_, others) = (np.unique(x, return_inverse=True) for x in (ids, others))
    cost = {}
    for i, j in product(range(n), range(m)):
        if (c := float(np.sqrt(((a[i] - b[j]) ** 2).sum()))) < 0.17:
            cost[ids[i], others[j]] = min(c, cost.get((ids[i], others[j]), 1.0))
    edges = [np.array([e[k] for e in cost], dtype=int) for k in (0, 1)]
    best = matching.sparse_assignment(*edges, np.array(list(cost.values())))
    points = near.Near(a, ids, b, others, 0.17)
    found = near.near_assignment(points, ids.max() + 1, others.max() + 1)
    assert len(found) == len(best) == len({i for i, _ in found}) == len({j for _, j in found})
    assert sum(points.cost(i, j) for i, j in found) == pytest.approx(sum(list(cost.values())[e] for e in best), abs=1e-9)
    assert seed % 3 == 0 or found == sorted((edges[0][e], edges[1][e]) for e in best)


@pytest.mark.parametrize("whole", [10**6, 20])
def test_near_matches_are_those_of_all_pairs_whole_or_split(spark, whole):
    rng = random.Random(3)
    rows = [(k, i, *(rng.random() + 3 * (rng.random() < 0.2) for _ in "xyz")) for k in ("a", "b", None) for i in range(40 if k == "a" else 8)] + [("a", 99, float("nan"), 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0)]
    a, b = (spark.createDataFrame([r for n, r in enumerate(rows) if n % 2 == s], f"k string, {i} bigint, {u} double, {v} double, {w} double") for s, (i, u, v, w) in enumerate((("l", "u", "v", "w"), ("r", "x", "y", "z"))))
    expected = matching.match(graph.near_pairs(a, b, ["k"], [*"uvw"], [*"xyz"], 0.7), ["k"], "l", "r")
    found = near.match_near(a, b, ["k"], "l", "r", [*"uvw"], [*"xyz"], 0.7, whole)
    assert found.dtypes == expected.dtypes
    got, wanted = ({(r.k, r.l, r.r): r.cost for r in f.collect()} for f in (found, expected))
    assert got.keys() == wanted.keys() and len(got) > 10 and all(got[e] == pytest.approx(wanted[e]) for e in got)


def test_many_near_pairs_take_memory_of_their_points(monkeypatch):
    monkeypatch.setattr(near, "KNOWN", 10000)
    rng = np.random.default_rng(0)
    a, b = rng.random((2, 1500, 3))
    tracemalloc.start()
    points = near.Near(a, np.arange(1500), b, np.arange(1500), 0.5)
    assert len(near.near_assignment(points, 1500, 1500)) == 1500  # of some 700,000 pairs
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


@pytest.mark.parametrize("n", [5, 133])
def test_whole_bodies_are_those_of_brute_force(spark, n):
    rng, p = random.Random(7), wholebody.WholeBody()
    recordings = {v: people_of(rng, n, 40) for v in ("a", "b")}
    df = spark.createDataFrame([r for v, fs in recordings.items() for r in as_rows(v, fs)], f"video string, {wholebody.FRAME}").repartition(3)
    found = wholebody.smooth_frames(df, ["video"], p)
    for v, fs in recordings.items():
        got = {(r.frame, r.track_id): r for r in found.where(F.col("video") == v).collect()}
        expected = brute_tracks(fs, p)
        assert len(got) == len(expected) and any(e[4] for e in expected)
        for f, i, person, age, misses, points, scores in expected:
            r = got[f, i]
            assert (r.person, r.age, r.misses) == (person, age, misses)
            assert np.allclose([tuple(q) for q in r.points], points, atol=1e-6) and np.allclose(r.scores, scores)


def test_regions_have_their_own_filters():
    p = wholebody.WholeBody()
    assert [(a, b) for a, b, _ in p.regions(133)] == [(0, 17), (17, 23), (23, 91), (91, 133)] and p.regions(133)[3][2].min_cutoff == 0.5
    assert p.regions(17) == [(0, 17, p.euro)] and isinstance(p.euro, Euro)


def test_frames_without_people_carry_and_then_end():
    p = wholebody.WholeBody(min_age=1, carry=2)
    state, rows = wholebody.wholebody_step(None, 0.0, [(np.zeros((3, 2)), np.ones(3))], p)
    assert [r["person"] for r in rows] == [0]
    for misses in (1, 2):
        state, rows = wholebody.wholebody_step(state, misses / 30, [], p)
        assert [(r["misses"], r["scores"].tolist()) for r in rows] == ([(misses, [0.0] * 3)] if misses == 1 and p.min_age <= 1 and rows else [])
    state, rows = wholebody.wholebody_step(state, 1.0, [], p)
    assert rows == [] and state["tracks"] == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def streamed(spark, tmp_path, batches, end, make):
    """What a stream makes of batches of rows, a file each; ``end`` is a far later row of another key, which moves the watermark."""
    schema = batches[0].schema
    for df in [*batches, end]:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out{random.randrange(10**9)}"
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name)


STAMP = "timestamp_millis(CAST(t * 1000 AS BIGINT) + 1700000000000)"


def test_stream_of_whole_bodies_is_the_table(spark, rocks, tmp_path):
    rng = random.Random(8)
    df = spark.createDataFrame([r for v in "ab" for r in as_rows(v, people_of(rng, 4, 30))], f"video string, {wholebody.FRAME}").withColumn("at", F.expr(STAMP))
    rows = df.collect()
    rng.shuffle(rows)
    rows.sort(key=lambda r: r.frame // 10 + (r.frame % 10 == 9))  # each file's last frame comes with the next file
    batches = [spark.createDataFrame([r for r in rows if r.frame // 10 + (r.frame % 10 == 9) == k], df.schema) for k in range(4)]
    end = spark.createDataFrame([("z", 0, 9000.0, [])], f"video string, {wholebody.FRAME}").withColumn("at", F.expr(STAMP))
    found = streamed(spark, tmp_path, batches, end, lambda s: wholebody.smooth_stream(s, ["video"], "at", late="1 second"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wholebody.smooth_frames(df, ["video"]).collect()))


# the ladder


def brute_ladder(rows, limit):
    out = []
    for k in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == k}
        seen = body = None
        for f in range(min(own), max(own) + limit + 1):
            if f in own and own[f][2] is not None:
                seen, body = f, own[f][2]
                out.append((k, f, "primary", body, True, 0, False))
            elif seen is not None and f - seen <= limit:
                out.append((k, f, "carried", body, False, f - seen, f not in own))
            elif f in own:
                out.append((k, f, "hands" if own[f][3] else "none", None, False, None, False))
    return sorted(out, key=str)


def ladder_rows(rng):
    rows = [(k, f, rng.random() if rng.random() < 0.3 else None, rng.randrange(2)) for k in ("a", "b", "c") for f in range(0, 120) if rng.random() < 0.5]
    return [r for r in rows if not (r[0] == "b" and 30 < r[1] < 80)]


def test_ladder_is_that_of_brute_force(spark):
    rows = ladder_rows(random.Random(9))
    df = spark.createDataFrame(rows, "k string, frame bigint, body double, hands int")
    assert sorted(map(tuple, fallback.ladder(df, ["k"], "frame", 5).collect()), key=str) == brute_ladder(rows, 5)
    assert fallback.ladder(df.limit(0), ["k"], "frame", 5).count() == 0


def test_stream_of_the_ladder_is_the_table(spark, rocks, tmp_path):
    rng = random.Random(10)
    rows = ladder_rows(rng)
    df = spark.createDataFrame(rows, "k string, frame bigint, body double, hands int").withColumn("at", F.timestamp_millis(F.col("frame") * 100 + 1_700_000_000_000))
    own = df.collect()
    rng.shuffle(own)
    batches = [spark.createDataFrame([r for r in own if r.frame // 40 == k], df.schema) for k in range(3)]
    end = spark.createDataFrame([("z", 10**6, None, 0)], "k string, frame bigint, body double, hands int").withColumn("at", F.timestamp_millis(F.col("frame") * 100 + 1_700_000_000_000))
    step, finish = fallback.ladder_step(5)
    schema = "frame bigint, rung string, body double, observed boolean, age bigint, made boolean"
    found = streamed(spark, tmp_path, batches, end, lambda s: run_ordered_stream(s, ["k"], "at", ["frame"], step, schema, late="2 seconds", idle_ms=5000, finish=finish))
    assert sorted(map(tuple, found.collect()), key=str) == brute_ladder(rows, 5)


def test_subject_is_the_largest_of_a_frame(spark):
    people = spark.createDataFrame([("v", 0, 1, 5.0), ("v", 0, 0, 5.0), ("v", 0, 2, None), ("v", 2, 0, None)], "k string, frame int, person_idx int, size double")
    hands = spark.createDataFrame([("v", 0), ("v", 1), ("v", 1)], "k string, frame int")
    found = fallback.single_subject(people, hands, ["k"], "frame", F.col("size"), ["person_idx"]).orderBy("frame").collect()
    assert [(r.frame, r.body.person_idx if r.body else None, r.hands) for r in found] == [(0, 0, 1), (1, None, 2), (2, 0, 0)]


def test_whole_body_query_covers_all_vectors(spark, sf_dir):
    frames = recovery.body_frames(spark, sf_dir).agg(F.sum(F.size("people"))).first()[0]
    assert frames == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() and json.dumps(frames)


# fusion of doubtful views


def brute_consensus(rig, pixels, conf, gate):
    """The views that the rule chooses for one keypoint, hypothesis by hypothesis."""
    ideal, best, chosen = rig.ideal(pixels[None]), None, []
    for a in range(len(conf)):
        for b in range(a + 1, len(conf)):
            w = np.zeros((1, len(conf)))
            w[0, [a, b]] = conf[[a, b]]
            x = fusion.triangulate(rig.p, ideal, w)
            if not np.isfinite(x).all():
                continue
            _, size, depth = fusion.errors(rig, pixels[None], x)
            ok = size[0] <= gate
            score = (int(ok.sum()), float(conf[ok].sum()), int((ok & (depth[0] > 0)).sum()), -float((conf * np.minimum(size[0], gate) ** 2).sum()))
            if best is None or score > best:
                best, chosen = score, ok
    return np.array(chosen)


def test_consensus_is_that_of_brute_force_and_refinement_reaches_the_best_fit():
    rng = np.random.default_rng(12)
    rig = fusion.Rig.of(list(recovery.BENT.values()))
    truth = rng.uniform(-0.6, 0.6, (120, 3))
    pixels = rig.pixels(truth)[0] + rng.normal(0, 1.0, (120, 4, 2))
    conf = rng.uniform(0.2, 1.0, (120, 4))
    for i in range(0, 120, 3):
        pixels[i, rng.integers(4)] += rng.choice([-1, 1], 2) * rng.uniform(40, 200, 2)
    for i in range(0, 120, 10):
        pixels[i] += rng.uniform(-300, 300, (4, 2))  # nothing fits
    x, error, count, front, angle = fusion.fuse_views(rig, pixels, conf)
    hard = 0
    for i in range(120):
        use = brute_consensus(rig, pixels[i], conf[i], 20.0)
        if use.sum() < 2:
            assert np.isnan(x[i]).all() and count[i] == 4
            continue
        assert count[i] == use.sum()
        if not np.isfinite(x[i]).all():
            hard += 1
            continue
        own = rig.some(np.flatnonzero(use).tolist())
        seed = fusion.triangulate(own.p, rig.ideal(pixels[i][None])[:, use], conf[i][None][:, use])
        loss = lambda p, own=own, use=use, i=i: (conf[i][use] * fusion.errors(own, pixels[i][None][:, use], p)[1][0] ** 2).sum()
        assert loss(x[i][None]) <= loss(seed) + 1e-9 and error[i] <= 20 and (front[i] or i % 10 == 0)
        assert error[i] <= fusion.errors(own, pixels[i][None][:, use], seed)[1].mean() + 1e-9
    assert hard < 12 and np.isfinite(x).all(axis=1).sum() > 90
    good = np.setdiff1d(np.arange(120), np.arange(0, 120, 3))
    good = good[good % 10 != 0]
    assert np.median(np.linalg.norm(x[good] - truth[good], axis=1)) < 0.01 and np.nanmin(angle[good]) > 1


def test_refinement_moves_points_that_the_query_disturbs(spark, sf_dir):
    rows = recovery.disturbed_views(spark, sf_dir).where("noisy").groupBy("frame", "keypoint").agg(F.sort_array(F.collect_list(F.struct("camera", "px", "py"))).alias("v")).limit(200).collect()
    rig = fusion.Rig.of(list(recovery.BENT.values()))
    pixels = np.array([[(v.px, v.py) for v in r.v] for r in rows])
    assert len(rows) == 200
    conf = np.full(pixels.shape[:2], 0.9)
    seed = fusion.triangulate(rig.p, rig.ideal(pixels), conf)
    fitted = fusion.refine(rig, pixels, conf, seed, 20.0)
    moved = np.linalg.norm(fitted - seed, axis=1)
    assert np.median(moved) > 1e-5 and np.allclose(fusion.errors(rig, pixels, fitted)[1], recovery.NOISE_PX, atol=1e-3)


def test_failed_fusion_tells_why(spark):
    schema = "session string, frame int, keypoint string, camera string, px double, py double, confidence double"
    rig = fusion.Rig.of(list(recovery.BENT.values()))
    at = rig.pixels(np.array([[0.1, 0.2, 0.0]]))[0][0]
    rows = [("s", 0, "far", c, float(p), float(q), 0.9) for c, (p, q) in zip("abcd", at + [[0, 0], [0, 300], [0, -300], [250, 500]], strict=True)]
    rows += [("s", 0, "one", "a", 1.0, 1.0, 0.9), ("s", 0, "none", "a", None, 1.0, 0.9), ("s", 0, "none", "other", 1.0, 1.0, 0.9)]
    found = {r.keypoint: r for r in fusion.fuse(spark.createDataFrame(rows, schema), recovery.BENT).collect()}
    assert all(found[k].x is None and found[k].reproj_err_px is None for k in ("one", "none"))
    assert [found[k].candidate_n_views for k in ("far", "one", "none")] == [4, 1, 0] and found["far"].n_views in (2, 4)
    assert (found["far"].x is None) == (found["far"].reproj_err_px is None)


# reports


def test_tracking_finds_the_interval_and_charges_absent_frames(spark):
    cameras = spark.createDataFrame([("s", "zero", 4, 2, 2), ("s", "one", 4, 2, None), ("s", "tie", 4, 0, 2), ("s", "gone", 4, None, 2), ("s", "empty", 0, 0, None)], "session string, camera string, expected_frames int, sync_offset int, keypoints int")
    rows = [("s", "zero", f, k, 1.0, 1.0, 0.2 if f == 3 else 0.9) for f in range(0, 6) for k in (0, 1)]
    rows += [("s", "one", f, k, 1.0, 1.0, 0.9) for f in range(3, 7) for k in (0, 1)]
    rows += [("s", "tie", f, 0, 1.0 if f else float("nan"), 1.0, 0.0 if f == 2 else 0.9) for f in range(0, 4)] + [("s", "tie", 4, 0, 1.0, 1.0, 0.1)]
    found = {r.camera: r for r in report.tracking(spark.createDataFrame(rows, "session string, camera string, frame int, keypoint int, x double, y double, confidence double"), cameras, ["session"]).collect()}
    assert (found["zero"].observed_frames, found["zero"].dropped_frames, found["zero"].detection_rate, found["zero"].low_confidence_fraction) == (4, 0, 1.0, 0.25)
    assert (found["one"].observed_frames, found["one"].detection_rate) == (4, 1.0)
    assert (found["tie"].observed_frames, found["tie"].dropped_frames, found["tie"].detection_rate) == (4, 2, 2 / 8)
    assert (found["gone"].observed_frames, found["gone"].dropped_frames, found["gone"].detection_rate, found["gone"].low_confidence_fraction) == (0, 4, 0.0, None)
    assert found["empty"].detection_rate is None
    worst = report.worst_cameras(spark.createDataFrame([("s", None, None), ("s", 0.5, float("nan"))], "session string, detection_rate double, low_confidence_fraction double"), ["session"]).first()
    assert (worst.worst_detection_rate, worst.worst_low_confidence_fraction) == (0.5, None)


def test_expected_frames_and_keypoints_that_never_fuse(spark):
    counts = spark.createDataFrame([("s", 10), ("s", 8), ("s", 12), ("t", 5)], "session string, expected_frames int")
    expected = report.expected_fused(counts, ["session"])
    assert {r.session: r.expected_frames for r in expected.collect()} == {"s": 10, "t": 0}
    rows = [("s", f, "good", 1.0, 2.0, 3, 3, True, True) for f in range(1, 11)] + [("s", f, "tried", None, None, 2, 2, False, False) for f in range(1, 11)] + [("s", f, "blind", None, None, 0, 0, False, False) for f in range(1, 11)] + [("s", 40, "good", 1.0, 2.0, 3, 3, True, True)]
    df = spark.createDataFrame(rows, "session string, frame int, keypoint string, x double, reproj_err_px double, n_views int, candidate_n_views int, cheirality_ok boolean, trusted boolean").withColumns({"y": F.col("x"), "z": F.col("x"), "triangulation_angle_deg": F.col("x") * 5})
    found = report.fusion(df, expected, ["session"]).first()
    assert (found.n_frames_fused, found.fused_frame_fraction, found.n_active_keypoints, found.trusted_keypoint_fraction, found.unfused_keypoint_fraction, found.n_views_min) == (10, 1.0, 2, 0.5, 0.5, 3)
    old = report.fusion(df.drop("triangulation_angle_deg", "candidate_n_views"), expected, ["session"], angles=False, candidates=False)
    names = {r.check for r in report.fusion_checks(old, ["session"]).collect()}
    assert "fusion.triangulation_angle_deg_p05" not in names and "fusion.view_rejection_fraction" not in names and len(names) == 8


def test_grades_floors_and_what_is_missing(spark):
    rows = [("s", "fusion.n_views_min", "n_views_floor", 1.0), ("s", "timing.throughput_fps", "min_throughput_fps", 0.1), ("s", "agreement.mean_symmetry_rel_diff", "max_symmetry_rel_diff", 9.0), ("t", "calibration.reprojection_error_px", "calib_reproj_rms_px", None), ("t", "timing.throughput_fps", "min_throughput_fps", 0.1)]
    made = spark.createDataFrame(rows, "session string, check string, metric string, value double")
    found = report.graded(made, ["session"])
    assert {(r.session, r.check.split(".")[0]): (r.grade, r.informational) for r in found.collect()} == {("s", "fusion"): ("FAIL", False), ("s", "timing"): ("FAIL", True), ("s", "agreement"): ("FAIL", True), ("t", "calibration"): ("WARN", False), ("t", "timing"): ("FAIL", True)}
    assert {r.session: r.verdict for r in grading.verdict(found, ["session"]).collect()} == {"s": "FAIL", "t": "WARN"}
    gone = report.missing_sections(made, made, ["session"], ["calibration", "fusion", "timing"]).collect()
    assert sorted(map(tuple, gone)) == [("s", "calibration"), ("t", "fusion")]


def test_all_bands_are_reached(spark, sf_dir):
    used = {r.metric for r in recovery.session_report(spark, sf_dir).select("metric").distinct().collect()}
    assert used == {m for m, *_ in grading.THRESHOLDS} | {"n_views_floor"}
