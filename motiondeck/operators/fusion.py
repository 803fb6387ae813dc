"""Multi-view fusion: frames of several cameras joined by logical index, keypoints triangulated robustly.

The join is a union of cameras grouped by (session, frame, keypoint); each group is a few views, so one Arrow
batch holds thousands of groups. Calibration is a small table (a row a camera) given as a dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def logical_frames(views: DataFrame, least: int = 2) -> DataFrame:
    """(session, logical_idx, cameras, ts): frames seen by ``least`` cameras at raw index minus the camera's offset.

    views has session, camera, camera_pos, raw_idx, sync_offset, ts. The time is that of the first camera, by position, that has one.
    """
    df = views.withColumn("logical_idx", F.col("raw_idx") - F.col("sync_offset")).where("logical_idx >= 0")
    ts = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("camera_pos")))
    return df.groupBy("session", "logical_idx").agg(F.count_distinct("camera").alias("cameras"), ts.alias("ts")).where(F.col("cameras") >= least)


def lock_step(views: DataFrame) -> DataFrame:
    """Views up to the first exhausted camera of their session: the least, over cameras, of the last logical index."""
    df = views.withColumn("logical_idx", F.col("raw_idx") - F.col("sync_offset")).where("logical_idx >= 0")
    ends = df.groupBy("session", "camera").agg(F.max("logical_idx").alias("last")).groupBy("session").agg(F.min("last").alias("last"))
    return df.join(ends, "session").where("logical_idx <= last").drop("last")


def last_by_frame(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key: the one that comes last in the source."""
    w = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def projection(k: np.ndarray, rvec: np.ndarray, tvec: np.ndarray) -> np.ndarray:
    """K [R | t], R by Rodrigues' formula."""
    angle = np.linalg.norm(rvec)
    r = np.eye(3)
    if angle > 1e-12:
        x, y, z = rvec / angle
        c = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        r = np.eye(3) + np.sin(angle) * c + (1 - np.cos(angle)) * c @ c
    return k @ np.column_stack([r, tvec])


def distort(xy: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Normalised points bent by radial and tangential distortion (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = (*d, 0, 0, 0, 0, 0)[:5]
    x, y = xy[:, 0], xy[:, 1]
    r = x * x + y * y
    f = 1 + k1 * r + k2 * r * r + k3 * r**3
    return np.column_stack([x * f + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * f + p1 * (r + 2 * y * y) + 2 * p2 * x * y])


def undistort(px: np.ndarray, k: np.ndarray, d: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Pixels as an ideal lens would give them, by fixed-point iteration."""
    n = np.column_stack([(px[:, 0] - k[0, 2]) / k[0, 0], (px[:, 1] - k[1, 2]) / k[1, 1]])
    x = n.copy()
    for _ in range(rounds):
        x = x + n - distort(x, d)
    return np.column_stack([x[:, 0] * k[0, 0] + k[0, 2], x[:, 1] * k[1, 1] + k[1, 2]])


def triangulate(ps: np.ndarray, pts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted linear triangulation by singular values: (n, 3) points of ideal pixels pts (n, views, 2) and weights (n, views) of cameras
    ps; NaN below two views of some weight or for a point at infinity."""
    w = np.sqrt(weights)[..., None]
    a = np.concatenate([w * (pts[..., :1] * ps[:, 2] - ps[:, 0]), w * (pts[..., 1:] * ps[:, 2] - ps[:, 1])], axis=1)
    x = np.linalg.svd(a)[2][:, -1]
    ok = (np.abs(x[:, 3]) > 1e-12) & ((weights > 0).sum(axis=1) >= 2)
    return np.where(ok[:, None], x[:, :3] / np.where(ok, x[:, 3], 1)[:, None], np.nan)


@dataclass(frozen=True)
class Rig:
    """Cameras side by side: matrices K [R | t] and K, distortion, and what follows from them."""

    p: np.ndarray
    k: np.ndarray
    d: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, cameras: list[dict]) -> Rig:
        p = [projection(np.array(c["K"], float), np.array(c["rvec"], float), np.array(c["tvec"], float)) for c in cameras]
        return cls(np.stack(p), np.stack([np.array(c["K"], float) for c in cameras]), tuple(np.array(c.get("distortion", [0.0]), float) for c in cameras))

    def pixels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pixels as the lenses bend them, depths) of points (n, 3): (n, views, 2) and (n, views)."""
        h = np.einsum("vij,nj->nvi", self.p, np.column_stack([x, np.ones(len(x))]))
        ideal = h[..., :2] / h[..., 2:]
        for v, d in enumerate(self.d):
            if np.any(d):
                k = self.k[v]
                bent = distort((ideal[:, v] - k[:2, 2]) / k[[0, 1], [0, 1]], d)
                ideal[:, v] = bent * k[[0, 1], [0, 1]] + k[:2, 2]
        return ideal, h[..., 2]

    def ideal(self, pixels: np.ndarray) -> np.ndarray:
        return np.stack([undistort(pixels[:, v], self.k[v], d) if np.any(d) else pixels[:, v] for v, d in enumerate(self.d)], axis=1)

    def rays(self, ideal: np.ndarray) -> np.ndarray:
        """Unit rays into the world through ideal pixels (n, views, 2)."""
        back = np.linalg.inv(self.p[:, :, :3])
        r = np.einsum("vij,nvj->nvi", back, np.concatenate([ideal, np.ones_like(ideal[..., :1])], axis=2))
        return r / np.linalg.norm(r, axis=2, keepdims=True)

    def some(self, views: list[int]) -> Rig:
        return Rig(self.p[views], self.k[views], tuple(self.d[v] for v in views))


def errors(rig: Rig, pixels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(differences, their sizes, depths) of points and what was seen of them, in pixels of the real lenses; unknown sizes are infinite."""
    seen, depth = rig.pixels(x)
    off = seen - pixels
    size = np.hypot(off[..., 0], off[..., 1])
    return off, np.where(np.isfinite(size), size, np.inf), depth


def ray_angle(rays: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The largest acute angle between the rays of used views, in degrees."""
    out = np.zeros(len(rays))
    for a, b in combinations(range(rays.shape[1]), 2):
        angle = np.degrees(np.arccos(np.clip(np.abs((rays[:, a] * rays[:, b]).sum(axis=1)), 0, 1)))
        out = np.where(use[:, a] & use[:, b], np.maximum(out, angle), out)
    return out


def refine(rig: Rig, pixels: np.ndarray, weights: np.ndarray, x: np.ndarray, delta: float, rounds: int = 8) -> np.ndarray:
    """Damped, reweighted Gauss-Newton steps of many points at once, in pixels of the real lenses, under a Huber loss that turns linear at delta.

    A step is at most a quarter of the point's distance from the origin (or of 1) and is halved up to three times; it is taken if neither
    the loss nor the mean error gets worse. All views count.
    """

    def judge(size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        huber = np.where(size <= delta, 0.5 * size * size, delta * (size - 0.5 * delta))
        return np.where(np.isfinite(size).all(axis=1), (weights[of] * huber).sum(axis=1), np.inf), size.mean(axis=1)

    x = x.copy()
    off, size, _ = errors(rig, pixels, x)
    loss, mean = judge(size, np.arange(len(x)))
    going = np.flatnonzero(np.isfinite(loss))
    for _ in range(rounds):
        if not len(going):
            break
        at = x[going]
        eps = 1e-5 * np.maximum(1.0, np.linalg.norm(at, axis=1))
        slopes = [(rig.pixels(at + eps[:, None] * axis)[0] - rig.pixels(at - eps[:, None] * axis)[0]) / (2 * eps[:, None, None]) for axis in np.eye(3)]
        j = np.stack(slopes, axis=-1)
        w = weights[going] * np.where(size[going] > delta, delta / np.maximum(size[going], 1e-300), 1.0)
        normal = np.einsum("nv,nvki,nvkj->nij", w, j, j)
        normal += (1e-8 * np.maximum(1.0, np.trace(normal, axis1=1, axis2=2) / 3))[:, None, None] * np.eye(3)
        step = -np.linalg.solve(normal, np.einsum("nv,nvki,nvk->ni", w, j, off[going])[..., None])[..., 0]
        length = np.linalg.norm(step, axis=1)
        step *= np.minimum(1.0, 0.25 * np.maximum(1.0, np.linalg.norm(at, axis=1)) / np.maximum(length, 1e-15))[:, None]
        open_ = np.isfinite(step).all(axis=1) & (length >= 1e-8)
        moved = np.zeros(len(going), dtype=bool)
        for part in (1.0, 0.5, 0.25, 0.125):
            left = np.flatnonzero(open_ & ~moved)
            if not len(left):
                break
            new = at[left] + part * step[left]
            o, s, _ = errors(rig, pixels[going[left]], new)
            new_loss, new_mean = judge(s, going[left])
            won = (new_loss <= loss[going[left]] + 1e-12) & (new_mean <= mean[going[left]] + 1e-12)
            of = going[left[won]]
            x[of], off[of], size[of], loss[of], mean[of] = new[won], o[won], s[won], new_loss[won], new_mean[won]
            moved[left[won]] = True
        going = going[moved]
    return x


def fuse_views(rig: Rig, pixels: np.ndarray, conf: np.ndarray, gate_px: float = 20.0, gate_deg: float = 1.0) -> tuple[np.ndarray, ...]:
    """(points, mean errors, views, cheirality, angles) of keypoints (n, views, 2) that the same cameras saw; NaN points where fusion fails.

    Each pair of views is a hypothesis; the one with most views inside the gate wins, then the largest summed confidence, then most views
    that see it in front, then the least weighted truncated squared error; ties keep the first. Its views are triangulated again
    and refined. It fails below two views, below the least angle between rays, or if a view ends outside the gate; then views
    are those of the consensus, or all if there is none.
    """
    n, views = conf.shape
    ideal = rig.ideal(pixels)
    use, rank = np.zeros((n, views), dtype=bool), np.full((n, 4), -np.inf)
    at = np.arange(n)
    for pair in combinations(range(views), 2):
        only = np.zeros((n, views))
        only[:, pair] = conf[:, pair]
        x = triangulate(rig.p, ideal, only)
        _, size, depth = errors(rig, pixels, x)
        inside = size <= gate_px
        new = np.column_stack([inside.sum(axis=1), np.where(inside, conf, 0).sum(axis=1), (inside & (depth > 0)).sum(axis=1), -(conf * np.minimum(size, gate_px) ** 2).sum(axis=1)])
        first = np.argmax(new != rank, axis=1)  # the first place in which they differ; if none, equal
        wins = (new[at, first] > rank[at, first]) & np.isfinite(x).all(axis=1)
        rank[wins], use[wins] = new[wins], inside[wins]
    count = use.sum(axis=1)
    angle = np.where(count >= 2, ray_angle(rig.rays(ideal), use), np.nan)
    points, error, front = np.full((n, 3), np.nan), np.full(n, np.nan), np.zeros(n, dtype=bool)
    good = (count >= 2) & (angle >= gate_deg)
    for kind in np.unique(use[good], axis=0):
        own, of = np.flatnonzero(kind), np.flatnonzero(good & (use == kind).all(axis=1))
        part, seen, weights = rig.some(own.tolist()), pixels[of][:, own], conf[of][:, own]
        x = refine(part, seen, weights, triangulate(part.p, ideal[of][:, own], weights), gate_px)
        _, size, depth = errors(part, seen, x)
        fits = np.isfinite(x).all(axis=1) & (size.max(axis=1) <= gate_px)
        points[of[fits]], error[of[fits]], front[of[fits]] = x[fits], size[fits].mean(axis=1), (depth[fits] > 0).all(axis=1)
    return points, error, np.where(count >= 2, count, views), front, angle


def fuse(observations: DataFrame, cameras: dict[str, dict], *, least: int = 2) -> DataFrame:
    """(session, frame, keypoint, x, y, z, reproj_err_px, candidate_n_views, n_views, cheirality_ok, triangulation_angle_deg).

    observations has a row a view: session, frame, keypoint, camera, px, py, confidence. cameras: name -> K, rvec, tvec, distortion.
    Views without a position or with confidence 0 are no candidates. A keypoint that fails keeps its row, its position NULL.
    """
    views = F.array_sort(F.collect_list(F.when(F.col("px").isNotNull() & F.col("py").isNotNull() & (F.col("confidence") > 0) & F.col("camera").isin(list(cameras)), F.struct("camera", "px", "py", "confidence"))))
    grouped = observations.groupBy("session", "frame", "keypoint").agg(views.alias("views"))

    @F.pandas_udf("x double, y double, z double, reproj_err_px double, n_views int, cheirality_ok int, triangulation_angle_deg double")
    def solve(views: pd.Series) -> pd.DataFrame:
        # keypoints that the same cameras saw are solved together
        rows: list[tuple] = [(None, None, None, None, len(vs), None, None) for vs in views]
        sizes = views.map(len).to_numpy()
        flat = pd.DataFrame.from_records(chain.from_iterable(views), columns=["camera", "px", "py", "confidence"])
        starts = np.cumsum(sizes) - sizes
        values = flat[["px", "py", "confidence"]].to_numpy(float)
        names = flat["camera"].to_numpy(object)
        alike: dict[tuple, list[int]] = {}
        for i, (k, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            if n >= least:
                alike.setdefault(tuple(names[k : k + n]), []).append(i)
        for seen_by, some in alike.items():
            seen = values[starts[some][:, None] + np.arange(len(seen_by))]
            rig = Rig.of([cameras[c] for c in seen_by])
            x, error, count, front, angle = fuse_views(rig, seen[..., :2], np.clip(seen[..., 2], 0, 1))
            known = np.isfinite(x).all(axis=1)
            for k, i in enumerate(some):
                rows[i] = (*x[k].tolist(), float(error[k]), int(count[k]), int(front[k]), float(angle[k])) if known[k] else (None, None, None, None, int(count[k]), 0, float(angle[k]) if np.isfinite(angle[k]) else None)
        return pd.DataFrame(rows, columns=["x", "y", "z", "reproj_err_px", "n_views", "cheirality_ok", "triangulation_angle_deg"])

    out = grouped.withColumn("s", solve("views"))
    return out.select("session", "frame", "keypoint", "s.x", "s.y", "s.z", "s.reproj_err_px", F.size("views").alias("candidate_n_views"), "s.n_views", "s.cheirality_ok", "s.triangulation_angle_deg")
