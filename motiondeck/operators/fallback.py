"""One subject's frames when its body is lost: the primary body, else the last one carried for a while, else hands alone.

``ladder`` is the table form (windows only), ``ladder_step`` the same for streams (``streaming.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rungs, from the best down.
PRIMARY, CARRIED, HANDS, NONE = "primary", "carried", "hands", "none"


def single_subject(people: DataFrame, hands: DataFrame, keys: list[str], frame: str, size: Column, body: list[str]) -> DataFrame:
    """(keys, frame, body, hands): of each frame's people the largest (the first of equals, by person_idx) and the number of its hands."""
    best = people.groupBy(*keys, frame).agg(F.max_by(F.struct(*body), F.struct(F.coalesce(size, F.lit(float("-inf"))), -F.col("person_idx"))).alias("body"))
    return best.join(hands.groupBy(*keys, frame).agg(F.count("*").alias("hands")), [*keys, frame], "full").withColumn("hands", F.coalesce("hands", F.lit(0)))


def ladder(frames: DataFrame, keys: list[str], frame: str, limit: int, body: str = "body", hands: str = "hands") -> DataFrame:
    """(keys, frame, rung, body, observed, age, made): what stands for the subject in every frame.

    A frame with a body has it (``primary``). One without has the last body, not observed, if that was seen at most ``limit`` frames
    before (``carried``); else ``hands`` if it has any; else ``none``. Frames that are missing between two of a recording, or after its
    last, are made as far as a body is carried (``made``), and no further: a long gap costs ``limit`` rows.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    seen = F.when(F.col(body).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(body).alias("b")))
    df = frames.select(*keys, frame, F.col(body).alias("__body"), F.col(hands).alias("__hands"), F.last(seen, True).over(w).alias("__last"), F.lead(frame).over(w).alias("__next"))
    age = F.col(frame) - F.col("__last.f")
    rung = F.when(F.col("__body").isNotNull(), PRIMARY).when(age <= limit, CARRIED).when(F.col("__hands") > 0, HANDS).otherwise(NONE)
    own = F.struct(F.col(frame).alias("f"), rung.alias("rung"), F.lit(False).alias("made"))
    until = F.least(F.col("__next") - 1, F.col("__last.f") + limit)
    gap = F.when(F.col("__last").isNotNull() & (until > F.col(frame)), F.transform(F.sequence(F.col(frame) + 1, until), lambda f: F.struct(f.alias("f"), F.lit(CARRIED).alias("rung"), F.lit(True).alias("made"))))
    rows = df.select(*keys, "__last", F.explode(F.concat(F.array(own), F.coalesce(gap, F.array().cast(f"array<struct<f: {dict(frames.dtypes)[frame]}, rung: string, made: boolean>>")))).alias("r"))
    held = F.col("r.rung").isin(PRIMARY, CARRIED)
    return rows.select(*keys, F.col("r.f").alias(frame), F.col("r.rung").alias("rung"), F.when(held, F.col("__last.b")).alias("body"), (F.col("r.rung") == PRIMARY).alias("observed"), F.when(held, F.col("r.f") - F.col("__last.f")).alias("age"), F.col("r.made").alias("made"))


def ladder_step(limit: int, frame: str = "frame", body: str = "body", hands: str = "hands"):
    """The step of a stream, and what ends a recording. Rows: (frame, rung, body, observed, age, made)."""

    def carry(state: dict, until: int) -> list[tuple]:
        end = min(until, state["seen"] + limit) if state["seen"] is not None else state["at"]
        return [(f, CARRIED, state["body"], False, f - state["seen"], True) for f in range(state["at"] + 1, end + 1)]

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        f, own = row[frame], row[body]
        rows = carry(state, f - 1) if state else []
        state = dict(state or {"seen": None, "body": None}, at=f)
        if own is not None:
            state.update(seen=f, body=own)
            return state, [*rows, (f, PRIMARY, own, True, 0, False)]
        if state["seen"] is not None and f - state["seen"] <= limit:
            return state, [*rows, (f, CARRIED, state["body"], False, f - state["seen"], False)]
        return state, [*rows, (f, HANDS if (row[hands] or 0) > 0 else NONE, None, False, None, False)]

    def finish(state: dict) -> list[tuple]:
        return carry(state, state["at"] + limit)

    return step, finish
