"""Recursive per-track filters: one step function over a plain state, run over ordered groups or as a keyed stream.

State is a dictionary of lists and numbers, so that it can be written as JSON into a stream's state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from motiondeck.operators.matching import assignment


@dataclass(frozen=True)
class Euro:
    """Parameters of the speed-adaptive low-pass filter."""

    min_cutoff: float = 0.3
    beta: float = 0.5
    d_cutoff: float = 1.0
    gamma: float = 2.0
    cap: float = 30.0
    rest_cutoff: float | None = 0.05
    rest_speed: float = 2.0
    fast_speed: float = 10.0
    speed_alpha: float = 0.1


def euro_step(state: dict | None, x: np.ndarray, t: float, confidence: np.ndarray | None, p: Euro) -> tuple[dict, np.ndarray]:
    """The next state and the smoothed points (n by dims) of one track.

    Confidence to the power gamma weighs both velocity and position; no confidence or no number is no evidence. The
    first genuine observation of a coordinate is taken as it is. A step beyond the velocity's prediction is capped.
    """
    w = np.ones(len(x)) if confidence is None else np.nan_to_num(np.clip(np.asarray(confidence, float), 0, 1)) ** p.gamma
    w = w[:, None]
    seen = np.isfinite(x) & (w > 0)
    if state is None:
        start = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        return {"x": start.tolist(), "dx": np.zeros_like(start).tolist(), "t": t, "met": seen.tolist(), "speed": None}, start
    prev, vel, met = np.array(state["x"], float), np.array(state["dx"], float), np.array(state["met"], bool)
    new = seen & ~met
    prev[new], vel[new] = x[new], 0.0
    dt = max(t - state["t"], 1e-6)
    diff = np.nan_to_num(np.where(np.isfinite(x), x, prev) - prev, nan=0.0, posinf=0.0, neginf=0.0)
    if p.cap > 0:
        odd = (diff - vel * dt)[:, :2]
        size = np.hypot(*odd.T)
        over = size > p.cap
        diff[over, :2] = (vel * dt)[over, :2] + odd[over] * (p.cap / size[over])[:, None]
    a = dt / (dt + 1 / (2 * np.pi * p.d_cutoff))
    wanted = diff * (a / dt) + vel * (1 - a)
    vel = vel + (wanted - vel) * w
    cutoff, speed = np.full((len(x), 1), p.min_cutoff), state["speed"]
    if p.rest_cutoff is not None:
        now = np.hypot(*vel[:, :2].T) * dt
        speed = now if speed is None else np.array(speed) + p.speed_alpha * (now - np.array(speed))
        if p.fast_speed > p.rest_speed:
            share = np.clip((speed - p.rest_speed) / (p.fast_speed - p.rest_speed), 0, 1)
            cutoff = (p.rest_cutoff + share * (p.min_cutoff - p.rest_cutoff))[:, None]
        speed = speed.tolist()
    rate = (np.abs(vel) * p.beta + cutoff) * 2 * np.pi * dt
    out = prev + rate / (rate + 1) * diff * w
    return {"x": out.tolist(), "dx": vel.tolist(), "t": t, "met": (met | seen).tolist(), "speed": speed}, out


@dataclass(frozen=True)
class Tracker:
    """Parameters of the multi-track smoother."""

    reach: float = 150.0
    grace: int = 10
    damping: float = 0.8
    step_cap: float = 150.0
    most: int | None = None
    still: bool = False
    euro: Euro = Euro()


def anchor(points: np.ndarray, shoulders: tuple[int, int] | None) -> np.ndarray:
    """The shoulders' middle, else the known shoulder, else the median of the known points."""
    known = points[np.isfinite(points[:, :2]).all(1), :2]
    if shoulders:
        own = points[list(shoulders), :2]
        own = own[np.isfinite(own).all(1)]
        if len(own):
            return own.mean(0)
    return np.median(known, axis=0) if len(known) else np.full(2, np.nan)


def track_step(state: dict | None, t: float, found: list[tuple[np.ndarray, np.ndarray | None]], p: Tracker, shoulders=None) -> tuple[dict, list[dict]]:
    """One frame: detections are assigned to predicted anchors, filtered, born, or carried for some frames.

    Returns the next state and a row a track: track_id, det (NULL if carried), age, misses, points.
    """
    state = state or {"tracks": [], "next": 0}
    tracks = state["tracks"]
    cost = np.full((len(found), len(tracks)), np.nan)
    for j, k in enumerate(tracks):
        ahead = np.array(k["euro"]["x"], float) + np.array(k["euro"]["dx"], float) * (t - k["euro"]["t"]) * (k["misses"] == 0)
        spot = anchor(ahead, shoulders) if k["misses"] == 0 else np.array(k["anchor"], float)
        for i, (x, _) in enumerate(found):
            cost[i, j] = np.hypot(*(anchor(x, shoulders) - spot))
    pairs = assignment(cost, p.reach)
    if p.most is not None and len(pairs) > p.most:
        pairs = sorted(sorted(pairs, key=lambda ij: (cost[ij], *ij))[: p.most])
    of, used = dict(pairs), {j for _, j in pairs}
    alive = sum(j in used or k["misses"] < p.grace for j, k in enumerate(tracks))
    births = len(found) if p.most is None else max(0, p.most - alive)
    after, rows, number = [], [], state["next"]
    for i, (x, c) in enumerate(found):
        if i in of:
            old = tracks[of[i]]
            own, age = old["id"], old["age"] + 1
            euro, out = euro_step(old["euro"], x, t, c, p.euro)
        elif births > 0:
            births -= 1
            own, age, number = number, 1, number + 1
            euro, out = euro_step(None, x, t, c, p.euro)
        else:
            continue
        after.append({"id": own, "euro": euro, "anchor": anchor(out, shoulders).tolist(), "age": age, "misses": 0, "last": out.tolist()})
        rows.append({"track_id": own, "det": i, "age": age, "misses": 0, "points": out})
    for j, k in enumerate(tracks):
        if j in used or k["misses"] >= p.grace or p.most is not None and len(after) >= p.most:
            continue
        misses, last = k["misses"] + 1, np.array(k["last"], float)
        if not p.still:
            move = np.array(k["euro"]["dx"], float) * p.damping**misses * max(0.0, t - k.get("at", k["euro"]["t"]))
            size = np.hypot(*move[:, :2].T)
            last = last + move * np.where(size > p.step_cap, p.step_cap / np.maximum(size, 1e-12), 1.0)[:, None]
        after.append({**k, "misses": misses, "age": max(0, k["age"] - 1), "last": last.tolist(), "anchor": anchor(last, shoulders).tolist(), "at": t})
        rows.append({"track_id": k["id"], "det": None, "age": max(0, k["age"] - 1), "misses": misses, "points": last})
    return {"tracks": after, "next": number}, rows


def bone_step(state: dict | None, points: np.ndarray, bones: list[tuple[int, int]], *, valid: np.ndarray | None = None, rate: float = 0.05, tolerance: float = 0.4, passes: int = 8, distal: float = 0.8) -> tuple[dict, np.ndarray, float]:
    """The next lengths, the points with bones of a wrong length set right, and the sum of what they were off by; z is left alone.

    A bone's length is a moving average of lengths clipped to the tolerance. One that is off by more than
    the tolerance is set to the length known before this frame, the distal end taking most of the move, until all that were seen
    before fit. A bone with an invalid end neither learns nor moves; the first time that it is seen only sets its length.
    """
    before, p, off = dict(state or {}), points.copy(), 0.0
    lengths, known = dict(before), []
    ok = np.isfinite(points[:, :2]).all(1) & (True if valid is None else np.asarray(valid, bool))
    for n, (a, b) in enumerate(bones):
        d = float(np.hypot(*(p[b, :2] - p[a, :2])))
        if ok[a] and ok[b] and d > 1e-6:
            old = before.get(str(n))
            if old is None:
                lengths[str(n)] = d
            elif old > 1e-6:
                known.append((a, b, old, abs(d - old) > tolerance * old))
                lengths[str(n)] = old + rate * (float(np.clip(d, max(1e-6, old * (1 - tolerance)), old * (1 + tolerance))) - old)
    for _ in range(passes if any(wrong for *_, wrong in known) else 0):
        moved = False
        for a, b, length, _ in known:
            v = p[b, :2] - p[a, :2]
            d = float(np.hypot(*v))
            if d >= 1e-6 and abs(d - length) > tolerance * length:
                shift = v / d * (length - d)
                p[b, :2] += distal * shift
                p[a, :2] -= (1 - distal) * shift
                off, moved = off + abs(d - length), True
        if not moved:
            break
    return lengths, p, off


def detection_step(state: list | None, found: list[dict], *, reach: float = 0.10, alpha: float = 0.35, carry: int = 3, decay: float = 0.7) -> tuple[list, list[dict]]:
    """Boxes blended with those of the frame before; a lost one is carried a few frames, moved on by its last step (to the new place, unblended) and fading."""
    old = state or []
    cost = np.array([[np.hypot(f["cx"] - o["cx"], f["cy"] - o["cy"]) for o in old] for f in found], float).reshape(len(found), len(old))
    of = dict(assignment(cost, reach))
    out = []
    for i, f in enumerate(found):
        o = old[of[i]] if i in of else None
        x, y = (alpha * f[c] + (1 - alpha) * o[c] if o else f[c] for c in ("cx", "cy"))
        out.append({"cx": x, "cy": y, "score": f["score"], "vx": f["cx"] - o["cx"] if o else 0.0, "vy": f["cy"] - o["cy"] if o else 0.0, "carried": 0})
    for j, o in enumerate(old):
        if j not in of.values() and o["carried"] < carry:
            out.append({**o, "cx": o["cx"] + o["vx"], "cy": o["cy"] + o["vy"], "score": o["score"] * decay, "carried": o["carried"] + 1})
    return out, out


def clock_step(last: float | None, media: float | None, frame: int, fps: float) -> float:
    """A strictly increasing source time: the medium's, else frame / fps, else a frame after the last."""
    for t in (media, frame / fps):
        if t is not None and np.isfinite(t) and (last is None or t > last):
            return float(t)
    return (last or 0.0) + 1 / fps


Step = Callable[[dict | None, pd.Series], tuple[dict, list[tuple]]]


#: What a task holds as Python objects at once: rows in of so many bytes of Arrow's (one row at least), so many rows out.
HELD_BYTES, HELD_ROWS = 1 << 18, 256


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as dictionaries, a few of them at a time; missing numbers are NaN."""
    numbers = [f.name for f in batch.schema if pa.types.is_integer(f.type) or pa.types.is_floating(f.type)]
    some = max(1, batch.num_rows * HELD_BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, some):
        for row in batch.slice(i, some).to_pylist():
            yield row | {c: np.nan for c in numbers if row[c] is None}


def run_grouped(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """A step function over each group's rows in order. A task streams through sorted rows and holds a batch, a few of its rows as Python
    objects and one group's state, so a group of any size and rows of any width fit; groups run side by side. Rows whose order is NULL come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for row in records(batch):
                own = tuple(None if v != v else v for v in (row[k] for k in keys))
                if own != key:
                    key, state = own, None
                state, out = step(state, row)
                rows += [(*own, *r) for r in out]
                if len(rows) >= HELD_ROWS:
                    yield packed(rows)
                    rows = []
        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, kind, strict=True)], schema=kind)

    kinds = dict(df.dtypes)
    whole = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema])
    kind = to_arrow_schema(StructType.fromDDL(whole))
    by = [*keys, *[F.col(c).asc_nulls_last() for c in order]]
    return df.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, whole)


def run_stream(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, idle_ms: int | None = None) -> DataFrame:
    """The same as a keyed stream: the state of a key waits, as JSON, for its next rows; rows of one batch are put in order.

    With idle_ms a key's state is dropped after that long without rows.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else None
        rows = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            state, out = step(state, row)
            rows += [(*key, *r) for r in out]
        held.update((json.dumps(state),))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    kinds = dict(df.dtypes)
    whole = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema])
    names = StructType.fromDDL(whole).names
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, whole, "state string", "append", timeout)


def euro_of(columns: list[str], time: str, confidence: str | None = None, p: Euro | None = None) -> Step:
    """A step that filters one point a row: yields (order time, smoothed coordinates)."""
    p = p or Euro()

    def step(state, row):
        x = np.array([[np.nan if row[c] is None else row[c] for c in columns]], dtype=float)
        c = None if confidence is None else np.array([row[confidence] if row[confidence] is not None else 0.0], dtype=float)
        state, out = euro_step(state, x, float(row[time]), c, p)
        return state, [(float(row[time]), *map(float, out[0]))]

    return step
