"""Observation and trust gates: a coordinate counts only with evidence. NULL is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiondeck.functions.geometry import finite
from motiondeck.sources.schema import coordinate_columns

# Fixed values of the quality gates.
REPROJECTION_GATE_PX = 20.0
ANGLE_GATE_DEG = 1.0


def observed(value: Column, evidence: Column) -> Column:
    """The value where its evidence is finite and positive; zero, NULL, NaN and infinity are no evidence."""
    return F.when((evidence > 0) & ~F.isnan(evidence) & (evidence < float("inf")), value)


def gate_2d(df: DataFrame, only: str | None = None) -> DataFrame:
    """Coordinates NULL where the keypoint's _vis or _conf is no evidence; keypoints without such a column stay.
    ``only`` restricts the gate to columns of that prefix pattern, for instance hands."""
    import re

    changed = {}
    for c in coordinate_columns(df.columns):
        if only and not re.search(only, c):
            continue
        base = c[:-2]
        for e in (f"{base}_vis", f"{base}_conf"):
            if e in df.columns:
                changed[c] = observed(finite(F.col(c).cast("double")), F.col(e).cast("double"))
                break
        else:
            changed[c] = finite(F.col(c).cast("double"))
    return df.withColumns(changed) if changed else df


def trusted(x: Column, y: Column, z: Column, reprojection: Column, cheirality: Column, angle: Column | None = None) -> Column:
    """Whether a 3D point passes every gate. A blank diagnostic fails; an absent angle column is no gate."""
    ok = finite(x).isNotNull() & finite(y).isNotNull() & finite(z).isNotNull()
    ok = ok & (F.coalesce(finite(reprojection), F.lit(1e300)) <= REPROJECTION_GATE_PX) & (F.coalesce(cheirality, F.lit(0)) == 1)
    if angle is not None:
        ok = ok & (F.coalesce(finite(angle), F.lit(-1.0)) >= ANGLE_GATE_DEG)
    return ok


def gate_3d(df: DataFrame) -> DataFrame:
    """A world table with untrusted coordinates NULL, ``_x_m`` renamed ``_x``, diagnostics dropped."""
    names = [c[: -len("_x_m")] for c in df.columns if c.endswith("_x_m")]
    kept, done = [], set()
    for n in names:
        own = [c for c in df.columns if c.startswith(f"{n}_") and c[len(n) + 1 :] in ("x_m", "y_m", "z_m", "confidence", "reproj_err_px", "candidate_n_views", "n_views", "cheirality_ok", "triangulation_angle_deg")]
        done.update(own)
        angle = f"{n}_triangulation_angle_deg"
        ok = trusted(*(F.col(f"{n}_{c}_m") for c in "xyz"), F.col(f"{n}_reproj_err_px"), F.col(f"{n}_cheirality_ok"), F.col(angle) if angle in df.columns else None)
        kept += [F.when(ok, F.col(f"{n}_{c}_m")).alias(f"{n}_{c}") for c in "xyz"]
    return df.select(*[c for c in df.columns if c not in done], *kept)


def in_scope(score: Column, index: Column, kept: list[int]) -> Column:
    """A keypoint's score, 0 outside the tracked set."""
    return F.when(index.isin(kept), score).otherwise(F.lit(0.0))


def older_than(df: DataFrame, fps: Column, age: str = "age") -> DataFrame:
    """Tracks seen for a tenth of a second at least."""
    return df.where(F.col(age) >= F.greatest(F.lit(1), F.floor(fps * 0.1)))


def single_capture(df: DataFrame) -> DataFrame:
    """df, failing when it runs unless it holds exactly one non-blank video (or no row)."""
    facts = df.agg(F.count("*").alias("n"), F.count_distinct("video").alias("videos"), F.count_if(F.coalesce(F.trim("video"), F.lit("")) == "").alias("blank")).first()
    if facts.n and (facts.videos != 1 or facts.blank):
        raise ValueError(f"one non-blank video expected; found {facts.videos}, {facts.blank} rows blank")
    return df
