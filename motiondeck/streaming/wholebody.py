"""Whole-body smoothing (133 points a person): tracks matched by weighted centroids, filtered region by region, carried and faded.

One frame is one step (``wholebody_step``). ``smooth_frames`` runs it over a table of recordings, ``smooth_stream``
over a stream; both give the same rows, as the stream holds frames back until the watermark has passed them
and steps through them in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiondeck.operators.matching import assignment
from motiondeck.streaming.filters import Euro, Step, euro_step, run_grouped
from motiondeck.streaming.ordered import run_ordered_stream

#: Regions of the 133-point layout (first, end, cut-off, speed coefficient).
REGIONS = {"body": (0, 17, 0.3, 0.5), "feet": (17, 23, 0.3, 0.5), "face": (23, 91, 0.3, 0.5), "hands": (91, 133, 0.5, 0.3)}


@dataclass(frozen=True)
class WholeBody:
    """Parameters. Layouts that are not of 133 points are one region with ``euro``."""

    reach: float = 150.0
    carry: int = 5
    damping: float = 0.8
    score_alpha: float = 0.5
    fade: float = 0.9
    min_age: int = 3
    hand_rest_cutoff: float | None = None
    euro: Euro = field(default_factory=lambda: Euro(min_cutoff=0.5, beta=0.5, rest_cutoff=None))

    def regions(self, n: int) -> list[tuple[int, int, Euro]]:
        if n != 133:
            return [(0, n, self.euro)]
        return [(a, b, replace(self.euro, min_cutoff=c, beta=s, rest_cutoff=self.hand_rest_cutoff if name == "hands" else self.euro.rest_cutoff)) for name, (a, b, c, s) in REGIONS.items()]


def centroid(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted middle of the known points; plain if no known point weighs anything; NaN if none is known."""
    known = np.isfinite(points[:, :2]).all(axis=1)
    w = np.where(known, np.nan_to_num(np.clip(weights, 0, 1)), 0.0)
    if not w.sum() > 0:
        w = known.astype(float)
    return np.average(np.where(known[:, None], points[:, :2], 0), axis=0, weights=w) if w.sum() > 0 else np.full(2, np.nan)


def _capped(move: np.ndarray, most: float) -> np.ndarray:
    size = np.hypot(move[..., 0], move[..., 1])
    scale = np.where(size > most, most / np.maximum(size, 1e-9), 1.0)
    out = move.copy()
    out[..., :2] *= scale[..., None]
    return out


def _speed(track: dict) -> np.ndarray:
    return np.concatenate([np.array(e["dx"], float) for e in track["euro"]])


def _expected(track: dict, t: float, p: WholeBody) -> np.ndarray:
    """Where a track's centroid should be at t: moved on by the median of its points' speeds, damped after misses."""
    spot, dt = np.array(track["centroid"], float), t - track["t"]
    v = _speed(track)[:, :2]
    v = v[np.isfinite(v).all(axis=1)]
    if dt <= 0 or not len(v):
        return spot
    return spot + _capped(np.median(v, axis=0) * dt * (p.damping ** (track["misses"] + 1) if track["misses"] else 1.0), p.reach)


def wholebody_step(state: dict | None, t: float, people: list[tuple[np.ndarray, np.ndarray]], p: WholeBody) -> tuple[dict, list[dict]]:
    """One frame of people (points, scores). Returns the next state and a row for each track of at least ``min_age``:
    track_id, person (place in the frame; None if carried), age, misses, points, scores.

    A person without any point that is known and scored is no detection. Scores are averaged from frame to frame, yet none is
    higher than the frame's own; those of carried tracks are 0.
    """
    state = state or {"tracks": [], "next": 0}
    tracks = state["tracks"]
    seen = [(k, np.asarray(x, float), np.asarray(s, float)) for k, (x, s) in enumerate(people)]
    seen = [(k, x, np.where(np.isfinite(x[:, :2]).all(axis=1), np.nan_to_num(np.clip(s, 0, 1)), 0.0)) for k, x, s in seen]
    seen = [(k, x, s) for k, x, s in seen if (s > 0).any()]
    spots = [_expected(track, t, p) for track in tracks] if seen else []
    cost = np.array([[np.hypot(*(centroid(x, s) - spot)) for spot in spots] for _, x, s in seen], float).reshape(len(seen), len(spots))
    of = dict(assignment(cost, p.reach))
    after, rows, number = [], [], state["next"]
    for i, (k, x, s) in enumerate(seen):
        old = tracks[of[i]] if i in of else None
        parts = [euro_step(old["euro"][r] if old else None, x[a:b], t, s[a:b], e) for r, (a, b, e) in enumerate(p.regions(len(x)))]
        points = np.concatenate([out for _, out in parts])
        mean = p.score_alpha * s + (1 - p.score_alpha) * (np.array(old["scores"]) if old else s)
        if old is None:
            number += 1
        track = {"id": old["id"] if old else number - 1, "euro": [e for e, _ in parts], "centroid": centroid(points, mean).tolist(), "scores": mean.tolist(), "age": (old["age"] if old else 0) + 1, "misses": 0, "points": points.tolist(), "t": t}
        after.append(track)
        rows.append((track, k, points, np.minimum(mean, s)))
    for j, old in enumerate(tracks):
        if j in of.values() or old["misses"] >= p.carry:
            continue
        misses, points, faded = old["misses"] + 1, np.array(old["points"], float), np.array(old["scores"]) * p.fade
        if t > old["t"]:
            points = points + _capped(np.nan_to_num(_speed(old) * (t - old["t"]) * p.damping**misses, nan=0.0, posinf=0.0, neginf=0.0), p.reach)
        track = {**old, "centroid": centroid(points, faded).tolist(), "scores": faded.tolist(), "age": max(0, old["age"] - 1), "misses": misses, "points": points.tolist(), "t": t}
        after.append(track)
        rows.append((track, None, points, np.zeros(len(points))))
    rows = [{"track_id": r["id"], "person": k, "age": r["age"], "misses": r["misses"], "points": x, "scores": s} for r, k, x, s in rows if r["age"] >= p.min_age]
    return {"tracks": after, "next": number}, rows


_POINTS = "array<struct<x: double, y: double>>"
#: A frame: its people in order, each with points and scores.
FRAME = f"frame bigint, t double, people array<struct<points: {_POINTS}, scores: array<double>>>"
OUT = f"frame bigint, t double, track_id int, person int, age int, misses int, points {_POINTS}, scores array<double>"


def frames_of(rows: DataFrame, keys: list[str], also: list[str] = ()) -> DataFrame:
    """A row a frame from a row a person (keys, frame, t, person_idx, points, scores); a frame's people are few."""
    person = F.struct("person_idx", "points", "scores")
    found = rows.groupBy(*keys, "frame").agg(F.min("t").alias("t"), *[F.min(c).alias(c) for c in also], F.sort_array(F.collect_list(F.when(F.col("points").isNotNull(), person))).alias("p"))
    return found.select(*keys, "frame", "t", *also, F.transform("p", lambda x: F.struct(x["points"].alias("points"), x["scores"].alias("scores"))).alias("people"))


def _person(one) -> tuple[np.ndarray, np.ndarray]:
    points = np.array([[np.nan if q is None or q[c] is None else q[c] for c in "xy"] for q in one["points"]], float).reshape(-1, 2)
    scores = np.array([np.nan if s is None else s for s in (one["scores"] if one["scores"] is not None else [])], float)
    return points, np.concatenate([scores, np.zeros(max(0, len(points) - len(scores)))])[: len(points)]


def _rows(frame: int, t: float, found: list[dict]) -> list[tuple]:
    return [(int(frame), float(t), int(r["track_id"]), r["person"], int(r["age"]), int(r["misses"]), [{"x": float(x), "y": float(y)} for x, y in r["points"][:, :2]], r["scores"].tolist()) for r in found]


def step_of(p: WholeBody) -> Step:
    def step(state, row):
        people = [_person(one) for one in (row["people"] if row["people"] is not None else [])]
        state, found = wholebody_step(state, float(row["t"]), people, p)
        return state, _rows(row["frame"], row["t"], found)

    return step


def smooth_frames(frames: DataFrame, keys: list[str], p: WholeBody | None = None) -> DataFrame:
    """keys and OUT of a table of frames; each recording in order of t."""
    return run_grouped(frames.select(*keys, "frame", "t", "people"), keys, ["t", "frame"], step_of(p or WholeBody()), OUT)


def smooth_stream(frames: DataFrame, keys: list[str], event_time: str, p: WholeBody | None = None, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """The same rows from a stream of frames (keys, frame, t, people and a time stamp that grows with t). Frames may come out of order
    by up to ``late``; a frame's rows come once the watermark is past it. Tracks are entries of a map in the state store."""
    df = frames.select(*keys, "frame", "t", "people", event_time)
    return run_ordered_stream(df, keys, event_time, ["t", "frame"], step_of(p or WholeBody()), OUT, late=late, idle_ms=idle_ms)
