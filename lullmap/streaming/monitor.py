"""Progress and stall monitoring of running work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lullmap.operators.telemetry import EMA_ALPHA, ETA_MIN_FRACTION, KILL_S, WARN_S
from lullmap.streaming.detect import _key_ddl


class _ProgressProcessor(StatefulProcessor):
    """Per run and phase: first time, highest fraction and smoothed remaining time."""

    def __init__(self, keys: Sequence[str], alpha: float) -> None:
        self.keys, self.alpha = list(keys), alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phases = handle.getMapState("phases", "phase string", "first_us bigint, top double, smoothed double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("row_us", kind="stable")
        out, known = [], {}
        for at, phase, fraction in zip(batch["row_us"], batch["phase"], batch["fraction"]):
            if phase not in known:
                stored = self.phases.containsKey((phase,))
                known[phase] = list(self.phases.getValue((phase,))) if stored else [int(at), 0.0, None]
            first, top, smoothed = known[phase]
            if pd.isna(fraction) or fraction < top:
                continue
            elapsed = (int(at) - first) / 1e6
            if fraction > ETA_MIN_FRACTION:
                raw = max(0.0, elapsed / fraction - elapsed)
                smoothed = raw if smoothed is None else smoothed + self.alpha * (raw - smoothed)
            known[phase] = [first, float(fraction), smoothed]
            out.append((*key, int(at), phase, float(fraction), elapsed, smoothed))
        for phase, value in known.items():
            self.phases.updateValue((phase,), tuple(value))
        names = [*self.keys, "at_us", "phase", "fraction", "elapsed_s", "eta_s"]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def stream_progress(
    sdf: DataFrame, keys: Sequence[str], ts: str, alpha: float = EMA_ALPHA
) -> DataFrame:
    """Progress that never goes back, with elapsed and smoothed remaining seconds.

    ``sdf`` holds the run keys, ``ts`` (TIMESTAMP), ``phase`` and ``fraction``. The first
    row of a phase starts its clock.
    """
    rows = sdf.select(*keys, F.unix_micros(ts).alias("row_us"), "phase", "fraction")
    out = "at_us bigint, phase string, fraction double, elapsed_s double, eta_s double"
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_ProgressProcessor(keys, alpha),
        outputStructType=T.StructType.fromDDL(f"{_key_ddl(sdf, keys)}, {out}"),
        outputMode="append",
        timeMode="none",
    )


class _StallProcessor(StatefulProcessor):
    """Warns and gives up on a run whose events stop; every event re-arms both."""

    def __init__(self, keys: Sequence[str], warn_s: float, kill_s: float, event_time: bool) -> None:
        self.keys, self.event_time = list(keys), event_time
        self.limits = (("warn", warn_s), ("kill", kill_s))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "armed_ms bigint, event_us bigint")

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "kind", "last_event_us", "silent_s"])

    def _arm(self, at_ms: int, floor_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A limit is exceeded strictly, so each timer fires one millisecond past it.
        for _, limit_s in self.limits:
            self.handle.registerTimer(max(at_ms + round(limit_s * 1000) + 1, floor_ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        if self.event_time:
            last = self.seen.get()[1] if self.seen.exists() else None
            times = sorted(int(at) for batch in rows for at in batch["row_us"])
            for at in (t for t in times if last is None or t >= last):
                silent = 0 if last is None else at - last
                found += [(*key, k, last, s) for k, s in self.limits if silent > s * 1e6 and not self._told(last, s, timerValues)]
                last = at
            armed = last // 1000
            self._arm(armed, timerValues.getCurrentWatermarkInMs() + 1)
        else:
            last = max(int(batch["row_us"].max()) for batch in rows)
            armed = timerValues.getCurrentProcessingTimeInMs()
            self._arm(armed, 0)
        self.seen.update((armed, last))
        yield self._rows(found)

    def _told(self, last: int, limit_s: float, timerValues) -> bool:
        """Whether the timer of this limit has already reported the silence after ``last``."""
        return last // 1000 + round(limit_s * 1000) + 1 <= timerValues.getCurrentWatermarkInMs()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        armed, event = self.seen.get()
        reached = (expiredTimerInfo.getExpiryTimeInMs() - 1 - armed) / 1000.0
        kind, limit_s = max((l for l in self.limits if l[1] <= reached), key=lambda l: l[1], default=self.limits[0])
        yield self._rows([(*key, kind, event, limit_s)])

    def close(self) -> None:
        pass


def stream_stalls(
    sdf: DataFrame,
    keys: Sequence[str],
    ts: str,
    warn_s: float = WARN_S,
    kill_s: float = KILL_S,
    watermark: str | None = None,
) -> DataFrame:
    """A ``warn`` and then a ``kill`` row for every silence of a run beyond either limit.

    Silence is measured in processing time, as a watchdog over live runs does. With a
    ``watermark`` it is measured in event time instead, between events and from the last
    one to the watermark, so that a replay reports what a live run would have.
    """
    if not warn_s < kill_s:
        raise ValueError("the warning must come before the kill")
    timed = sdf.withWatermark(ts, watermark) if watermark else sdf
    rows = timed.select(*keys, *([ts] if watermark else []), F.unix_micros(ts).alias("row_us"))
    out = "kind string, last_event_us bigint, silent_s double"
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_StallProcessor(keys, warn_s, kill_s, watermark is not None),
        outputStructType=T.StructType.fromDDL(f"{_key_ddl(sdf, keys)}, {out}"),
        outputMode="append",
        timeMode="eventTime" if watermark else "processingTime",
    )
