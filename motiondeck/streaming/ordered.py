"""Step functions over a stream whose rows come out of order: rows wait in state until the watermark has passed them.

The same step gives the same rows as ``filters.run_grouped`` over the finished table. State lives in the state store:
waiting rows as a list, the entries of ``state["tracks"]`` (by their ``id``) as a map, whatever else the state holds as one value.
A step writes the map's entries that changed. A key without rows for ``idle_ms`` of event time is ended by a timer: ``finish`` may
make its last rows out of the state, without any input, and the state goes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from motiondeck.streaming.filters import Step


class OrderedSteps(StatefulProcessor):
    def __init__(self, step: Step, names: list[str], order: list[str], idle_ms: int, finish: Callable[[dict], list[tuple]] | None) -> None:
        self.step, self.names, self.order, self.idle_ms, self.finish = step, names, order, idle_ms, finish

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, data string")
        self.tracks = handle.getMapState("tracks", "track_id bigint", "data string")
        self.rest = handle.getValueState("rest", "data string")
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top = self.last.get()[0] if self.last.exists() else None
        for batch in rows:
            millis = batch["event_time"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            for at, data in zip(millis, batch["data"], strict=True):
                self.waiting.appendValue((at, data))
                self.handle.registerTimer(at)
                top = at if top is None else max(top, at)
        self.last.update((top,))
        self.handle.registerTimer(top + self.idle_ms)
        yield pd.DataFrame([], columns=self.names)

    def _state(self) -> dict | None:
        if not self.rest.exists():
            return None
        state = json.loads(self.rest.get()[0])
        if state.pop("__tracked"):
            state["tracks"] = sorted((json.loads(v[0]) for _, v in self.tracks.iterator()), key=lambda x: x["__place"])
        return state

    def _keep(self, before: dict | None, state: dict) -> None:
        tracks = state.get("tracks")
        old = {x["id"]: json.dumps(x) for x in (before or {}).get("tracks", [])}
        for place, track in enumerate(tracks or []):
            data = json.dumps({**track, "__place": place})
            if old.pop(track["id"], None) != data:
                self.tracks.updateValue((track["id"],), (data,))
        for gone in old:
            self.tracks.removeKey((gone,))
        self.rest.update((json.dumps({**{k: v for k, v in state.items() if k != "tracks"}, "__tracked": tracks is not None}),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = [json.loads(data) for at, data in held if at <= now]
        left = [r for r in held if r[0] > now]
        out = []
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
            due.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in self.order))
            before = self._state()
            state = before
            for row in due:
                state, rows = self.step(state, row)
                out += [(*key, *r) for r in rows]
            self._keep(before, state)
        if not left and self.last.exists() and now >= self.last.get()[0] + self.idle_ms:
            if self.finish and (state := self._state()) is not None:
                out += [(*key, *r) for r in self.finish(state)]
            for held_state in (self.waiting, self.tracks, self.rest, self.last):
                held_state.clear()
        yield pd.DataFrame(out, columns=self.names)


def run_ordered_stream(df: DataFrame, keys: list[str], event_time: str, order: list[str], step: Step, schema: str, *, late: str = "10 seconds", idle_ms: int = 3_600_000, finish: Callable[[dict], list[tuple]] | None = None) -> DataFrame:
    """keys and schema: what the step makes of each key's rows in order, once the watermark (``late`` behind the newest row) has passed them.

    Rows of one key at one event time are put in order; ``order`` must not contradict event time. Rows later than the watermark
    are dropped, as by any watermark. Needs the RocksDB state store provider.
    """
    kinds = dict(df.dtypes)
    whole = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema])
    packed = df.withWatermark(event_time, late).select(*keys, F.col(event_time).alias("event_time"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in {*keys, event_time}]), {"ignoreNullFields": "false"}).alias("data"))
    return packed.groupBy(*keys).transformWithStateInPandas(OrderedSteps(step, StructType.fromDDL(whole).names, order, idle_ms, finish), whole, "Append", "EventTime")
