"""The multi-track smoother over many series at once: their first frames together, then their second ones, and so on.

The rule is that of ``filters.track_step`` for tracks of one point and detections of full confidence; what one step of one series does is done
here for a column of series. A task streams through sorted rows, holds some of them as numbers, and hands a series that goes on its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from motiondeck.operators.matching import assignment
from motiondeck.streaming.filters import Tracker

#: Detections that a task holds, costs that it computes at once, rows that it gives out together.
HELD, COSTS, OUT = 1 << 20, 1 << 21, 1 << 14
#: What is known of a track: filtered place and speed, when, blended speed, last place shown and when, age, frames missed, id, coordinates met.
X, Y, VX, VY, T, SPEED, LX, LY, AT, AGE, MISSES, ID, MX, MY = range(14)
_FIELDS = 14


def _smoothed(old: np.ndarray, x: np.ndarray, t: np.ndarray, p) -> np.ndarray:
    """``filters.euro_step`` of one point a track: the tracks' fields after a detection each; x of two rows."""
    seen, prev, vel = np.isfinite(x), old[[X, Y]], old[[VX, VY]]
    new = seen & (old[[MX, MY]] == 0)
    prev, vel = np.where(new, x, prev), np.where(new, 0.0, vel)
    dt = np.maximum(t - old[T], 1e-6)
    diff = np.nan_to_num(np.where(seen, x, prev) - prev, nan=0.0, posinf=0.0, neginf=0.0)
    if p.cap > 0:
        odd = diff - vel * dt
        size = np.hypot(*odd)
        over = size > p.cap
        diff = np.where(over, vel * dt + odd * (p.cap / np.where(over, size, 1.0)), diff)
    a = dt / (dt + 1 / (2 * np.pi * p.d_cutoff))
    vel = vel + (diff * (a / dt) + vel * (1 - a) - vel)
    cutoff, speed = p.min_cutoff, old[SPEED]
    if p.rest_cutoff is not None:
        now = np.hypot(*vel) * dt
        speed = np.where(np.isnan(speed), now, speed + p.speed_alpha * (now - speed))
        if p.fast_speed > p.rest_speed:
            share = np.clip((speed - p.rest_speed) / (p.fast_speed - p.rest_speed), 0, 1)
            cutoff = p.rest_cutoff + share * (p.min_cutoff - p.rest_cutoff)
    rate = (np.abs(vel) * p.beta + cutoff) * 2 * np.pi * dt
    out = prev + rate / (rate + 1) * diff
    return np.stack([*out, *vel, t, speed, *out, t, old[AGE] + 1, np.zeros(len(t)), old[ID], *((old[[MX, MY]] > 0) | seen)])


def _assigned(cost: np.ndarray, dets: np.ndarray, tracks: np.ndarray, reach: float) -> np.ndarray:
    """The track of each detection (series by detection by track), -1 where there is none, as ``assignment`` finds it.

    Where the nearest tracks of a series' detections are different ones and nothing is as near, they are the only best assignment.
    """
    n, d, k = cost.shape
    if not k:
        return np.full((n, d), -1)
    c = np.where(np.isfinite(cost) & (cost < reach), cost, np.inf)
    of, least = c.argmin(2), c.min(2)
    some = np.isfinite(least)
    of[~some] = -1
    hard = (((c == least[:, :, None]).sum(2) > 1) & some).any(1)
    if d > 1:
        apart = np.sort(np.where(some, of, -1 - np.arange(d)), axis=1)
        hard |= (apart[:, 1:] == apart[:, :-1]).any(1)
    for i in np.flatnonzero(hard):
        of[i] = -1
        for a, b in assignment(cost[i, : dets[i], : tracks[i]], reach):
            of[i, a] = b
    return of


def _step(s: np.ndarray, count: np.ndarray, number: np.ndarray, t: np.ndarray, x: np.ndarray, dets: np.ndarray, p: Tracker) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One frame of each series. s: fields by series by track, of which the first count are; number: the next id; t: the frames' times;
    x: two rows of all detections, the first dets of them the first series'. The fields and counts after, detections' and then carried tracks'."""
    n, k, d = len(count), s.shape[2], int(dets.max(initial=0))
    starts = np.cumsum(dets) - dets
    of_series = np.repeat(np.arange(n), dets)
    place = np.arange(len(of_series)) - starts[of_series]
    held = np.arange(k) < count[:, None]
    fresh = s[MISSES] == 0
    spot = np.where(fresh, s[[X, Y]] + s[[VX, VY]] * (t[:, None] - s[T]), s[[LX, LY]])
    seen = np.full((2, n, d), np.nan)
    seen[:, of_series, place] = x
    cost = np.where(held[:, None, :], np.hypot(seen[0][:, :, None] - spot[0][:, None, :], seen[1][:, :, None] - spot[1][:, None, :]), np.nan)
    track = _assigned(cost, dets, count, p.reach)[of_series, place]
    met = track >= 0
    used = np.zeros((n, k), dtype=bool)
    used[of_series[met], track[met]] = True
    carried = held & ~used & (s[MISSES] < p.grace)
    after = dets + carried.sum(1)
    out = np.zeros((_FIELDS, n, int(after.max(initial=0))))
    out[:, of_series[met], place[met]] = _smoothed(s[:, of_series[met], track[met]], x[:, met], t[of_series[met]], p.euro)
    born = ~met
    rank = np.cumsum(born)
    first = np.concatenate([[0], rank])[starts]
    at, when, own = np.nan_to_num(x[:, born], nan=0.0, posinf=0.0, neginf=0.0), t[of_series[born]], of_series[born]
    zero = np.zeros(len(when))
    out[:, own, place[born]] = np.stack([*at, zero, zero, when, zero + np.nan, *at, when, zero + 1, zero, number[own] + (rank[born] - 1 - first[own]), *np.isfinite(x[:, born])])
    number += np.bincount(own, minlength=n)
    i, j = np.nonzero(carried)
    old = s[:, i, j]
    misses = old[MISSES] + 1
    if not p.still:
        damped = np.array([p.damping**m for m in range(p.grace + 2)])
        move = old[[VX, VY]] * damped[misses.astype(int)] * np.maximum(0.0, t[i] - old[AT])
        size = np.hypot(*move)
        old[[LX, LY]] += move * np.where(size > p.step_cap, p.step_cap / np.maximum(size, 1e-12), 1.0)
    old[MISSES], old[AGE], old[AT] = misses, np.maximum(0, old[AGE] - 1), t[i]
    out[:, i, (dets[:, None] + np.cumsum(carried, axis=1) - 1)[i, j]] = old
    return out, after, dets


def _together(frames: list[tuple[np.ndarray, np.ndarray]], start: list, x: np.ndarray, p: Tracker) -> Iterator[tuple]:
    """Series side by side, longest first: their frames' (times, offsets into x) and states (fields, next id) before. Yields what a frame of
    the series lo to hi left: its number, lo, the fields, counts, detections and the next ids."""
    length = np.array([len(t) for t, _ in frames])
    most = max((f.shape[1] for f, _ in start), default=0)
    s, count = np.zeros((_FIELDS, len(frames), most)), np.array([f.shape[1] for f, _ in start])
    for u, (f, _) in enumerate(start):
        s[:, u, : f.shape[1]] = f
    number = np.array([i for _, i in start], dtype=float)
    base = np.cumsum(length) - length
    times, begins, ends = np.concatenate([t for t, _ in frames]), np.concatenate([o[:-1] for _, o in frames]), np.concatenate([o[1:] for _, o in frames])
    for n in range(int(length[0])):
        alive = int(np.searchsorted(-length, -n, side="left"))
        row = base[:alive] + n
        dets = ends[row] - begins[row]
        where = np.repeat(begins[row] - np.cumsum(dets) + dets, dets) + np.arange(dets.sum())
        cut = np.concatenate([[0], np.cumsum(dets)])
        wide = max(1, COSTS // max(1, int(dets.max()) * max(1, s.shape[2])))
        parts = []
        for lo in range(0, alive, wide):
            hi = min(alive, lo + wide)
            got = _step(s[:, lo:hi], count[lo:hi], number[lo:hi], times[row[lo:hi]], x[:, where[cut[lo] : cut[hi]]], dets[lo:hi], p)
            parts.append(got)
            yield (n, lo, *got, number[lo:hi])
        if len(parts) == 1:
            s, count = parts[0][:2]
        else:
            s = np.zeros((_FIELDS, alive, max(f.shape[2] for f, *_ in parts)))
            for f, lo in zip((f for f, *_ in parts), range(0, alive, wide), strict=True):
                s[:, lo : lo + f.shape[1], : f.shape[2]] = f
            count = np.concatenate([c for _, c, _ in parts])
        number = number[:alive]


def tracked(keys: list[str], frame: str, x: str, y: str, fps: float, p: Tracker, kind: pa.Schema):
    """What a task runs over the detections of whole series in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held, last = [], 0, None
        for batch in batches:
            some.append(batch)
            held += batch.num_rows
            if held >= HELD:
                rows = pa.Table.from_batches(some).combine_chunks()
                cut = int(np.flatnonzero(_changes(rows, [*keys, frame]))[-1])  # the last frame may go on
                if cut:
                    last = yield from solved(rows.slice(0, cut), last)
                some = rows.slice(cut).to_batches()
                held = len(rows) - cut
        if held:
            yield from solved(pa.Table.from_batches(some).combine_chunks(), last)

    def solved(rows: pa.Table, last: tuple | None):
        """Yields what whole frames give. last: the keys of the series before and what it left; returns those of the last series here."""
        number, spots = rows[frame].to_numpy(), np.stack([rows[c].to_numpy().astype(float) for c in (x, y)])
        own = _changes(rows, keys)
        first = np.flatnonzero(own | _changes(rows, [frame]))  # row of each frame
        series = np.flatnonzero(own[first])  # first frame of each series
        until, bounds = np.append(series[1:], len(first)), np.append(first, len(rows))
        names = rows.select(keys).take(pa.array(first[series]))
        name = lambda i: tuple(c[i].as_py() for c in names.columns)
        before = [(np.zeros((_FIELDS, 0)), 0)] * len(series)
        if last is not None and last[0] == name(0):
            before[0] = last[1]
        final, left = len(series) - 1, None
        breadth = np.maximum(3, np.ceil(np.log2(np.maximum.reduceat(np.diff(bounds), series))))  # a crowded series is not one of many
        out, ready = [], 0
        for b in np.unique(breadth):
            chosen = np.flatnonzero(breadth == b)
            chosen = chosen[np.argsort(series[chosen] - until[chosen], kind="stable")]
            frames = [(number[first[i:j]] / fps, bounds[i : j + 1]) for i, j in zip(series[chosen], until[chosen], strict=True)]
            for n, lo, f, count, dets, ids in _together(frames, [before[u] for u in chosen], spots, p):
                i, j = np.nonzero(np.arange(f.shape[2]) < count[:, None])
                who = chosen[lo + i]
                out.append((who, number[first[series[who] + n]], np.where(j < dets[i], j, -1), f[:, i, j]))
                ready += len(i)
                if n == until[final] - series[final] - 1:
                    for u in np.flatnonzero(chosen[lo : lo + len(count)] == final):
                        left = (f[:, u, : count[u]].copy(), int(ids[u]))
                if ready >= OUT:
                    yield packed(names, out)
                    out, ready = [], 0
        if out:
            yield packed(names, out)
        return name(final), left

    def packed(names: pa.Table, out: list[tuple]) -> pa.RecordBatch:
        who, frames, det = (np.concatenate([o[i] for o in out]) for i in range(3))
        f = np.concatenate([o[3] for o in out], axis=1)
        numbers = [frames, f[ID].astype(np.int64), pa.array(det, mask=det < 0), f[AGE].astype(np.int64), f[MISSES].astype(np.int64), pa.array(f[LX], from_pandas=True), pa.array(f[LY], from_pandas=True)]
        columns = [c.combine_chunks() for c in names.take(pa.array(who)).columns] + [pa.array(c) if isinstance(c, np.ndarray) else c for c in numbers]
        return pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kind, strict=True)], schema=kind)

    return run


def track_points(df: DataFrame, keys: list[str], frame: str, order: list[str], x: str, y: str, fps: float, p: Tracker) -> DataFrame:
    """(keys, frame, track_id, det, age, misses, x, y) of each series' detections (a row each, keys, frame, x, y; by order within a frame)
    tracked as ``filters.track_step`` does it. det is the detection's place in its frame, NULL for a carried track."""
    if p.most is not None:
        raise ValueError("the number of tracks is not limited here")
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{frame}` bigint, track_id int, det int, age int, misses int, x double, y double"])
    rows = df.repartition(*keys).sortWithinPartitions(*keys, frame, *order).select(*keys, frame, x, y)
    return rows.mapInArrow(tracked(keys, frame, x, y, fps, p, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in one of the columns; the first one does."""
    out = np.ones(len(rows), dtype=bool)
    out[1:] = False
    for column in map(rows.column, columns):
        a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
        gone = column.is_null().to_numpy()
        out[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (gone[1:] != gone[:-1])
    return out
