"""Whole-body points of 133 or 17 in the order of the arm (12) and body (33) schemes, and their hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiondeck.operators.tables import hand_confidences, hand_present

# For each point of a scheme, the point of the 133 that stands for it. In the arm scheme shoulders, elbows, wrists, then
# bases of index, middle and little finger, left and right; in the body scheme nose, eyes (inner, middle, outer), ears, mouth, shoulders, elbows,
# wrists, tips of little finger, index and thumb, hips, knees, ankles, heels, toes.
ARM = [5, 6, 7, 8, 9, 10, 96, 117, 100, 121, 108, 129]
BODY = [0, 59, 1, 62, 65, 2, 68, 3, 4, 71, 77, 5, 6, 7, 8, 9, 10, 111, 132, 99, 120, 95, 116, 11, 12, 13, 14, 15, 16, 19, 22, 17, 20]
#: First points of the hands, each of 21, and their wrists in the two schemes.
HANDS = {"left": (91, {"arms": 4, "body": 15}), "right": (112, {"arms": 5, "body": 16})}


def indices(tracking: str, points: int) -> list[int | None]:
    """The source index of each target point; None where a layout of so many points has none (17: nothing but the first 17)."""
    return [k if k < points else None for k in (ARM if tracking == "arms" else BODY)]


def _picked(array: str, which: list[int | None], make, nothing: Column) -> Column:
    return F.array(*[nothing if k is None else make(F.get(array, F.lit(k))) for k in which])


def bodies(people: DataFrame, keys: list[str], tracking: str, points: int = 133) -> DataFrame:
    """(keys, person_idx, points, vis): the body of each person (points, scores) in the scheme ``arms`` or ``body``; points that the layout
    lacks are at 0 with visibility 0. With ``hands`` there are none."""
    if tracking == "hands":
        return people.limit(0).select(*keys, "person_idx", F.array().cast("array<struct<x: double, y: double, z: double>>").alias("points"), F.array().cast("array<double>").alias("vis"))
    which, zero = indices(tracking, points), F.lit(0.0)
    place = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), zero.alias("z"))
    none = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("z"))
    return people.select(*keys, "person_idx", _picked("points", which, place, none).alias("points"), _picked("scores", which, lambda s: s.cast("double"), zero).alias("vis"))


def hands(people: DataFrame, keys: list[str], tracking: str, points: int = 133) -> DataFrame:
    """(keys, person_idx, side, flag, wrist, points, confidences) of the hands that are there (mean score above 0.1): the side follows from the
    layout, so its flag is 1; wrist is the body's point that the hand belongs to, NULL if only hands are tracked."""
    made = []
    for side, (start, wrists) in HANDS.items() if points == 133 else ():
        known = F.transform("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
        own = F.transform(F.slice("points", start + 1, 21), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), F.lit(0.0).alias("z")))
        made.append(F.when(hand_present(F.col("scores"), start), F.struct(F.lit(side).alias("side"), F.lit(1.0).alias("flag"), F.lit(wrists.get(tracking)).cast("int").alias("wrist"), own.alias("points"), hand_confidences(F.col("scores"), known, start).alias("confidences"))))
    if not made:
        return people.limit(0).select(*keys, "person_idx", F.inline(F.array().cast("array<struct<side: string, flag: double, wrist: int, points: array<struct<x: double, y: double, z: double>>, confidences: array<double>>>")))
    return people.select(*keys, "person_idx", F.inline(F.filter(F.array(*made), lambda h: h.isNotNull())))
