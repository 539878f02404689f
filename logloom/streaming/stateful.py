"""Stream rules that need state of their own per key: ordered lists with expiry, quiet times, and timers.

Both rules read rows that an aggregate has closed behind the watermark, so a busy source or host is counted in all input tasks first and reaches its state as one row per minute or moment, in the
order of time. What a key remembers is bounded by the rule's window, not by its traffic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE_MS = 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """`rows` (with a watermark) handed to `processor` key by key, with timers in event time."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


class Timed(StatefulProcessor):
    """State is one row of bigint lists and numbers; a timer is set for the next moment at which the key has something to do."""

    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def timer(self, at_ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at_ms:
                self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class DriftRule(Timed):
    """Minutes of one source (minute_ms, a received, c unparsed): a row when the last `span` minutes reach the threshold, then quiet.

    The rule is asked at every full minute, also when no line came: a share rises as good lines leave the hour. Rows: until_ms (the minute), received, unparsed.
    """

    fields = "minutes array<bigint>, received array<bigint>, unparsed array<bigint>, asked bigint, alerted bigint"
    schema = "ref_id bigint, until_ms bigint, received bigint, unparsed bigint"

    def __init__(self, min_lines: int, threshold_pct: float, span: int, quiet_minutes: int):
        self.min_lines, self.threshold_pct, self.span_ms, self.quiet_ms = min_lines, threshold_pct, span * MINUTE_MS, quiet_minutes * MINUTE_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hour, asked, alerted = self._load()
        for r in rows:
            for m, a, c in zip(r["minute_ms"].tolist(), r["a"].tolist(), r["c"].tolist()):
                if asked is None or m > asked:  # a minute asked about is closed
                    old = hour.get(m, (0, 0))
                    hour[m] = (old[0] + a, old[1] + c)
        yield from self._ask(key, hour, asked, alerted, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ask(key, *self._load(), timerValues)

    def _load(self) -> tuple[dict[int, tuple[int, int]], int | None, int | None]:
        if not self.state.exists():
            return {}, None, None
        minutes, received, unparsed, asked, alerted = self.state.get()
        return dict(zip(minutes, zip(received, unparsed))), asked, alerted

    def _ask(self, key, hour, asked, alerted, timers) -> Iterator[pd.DataFrame]:
        closed = timers.getCurrentWatermarkInMs() // MINUTE_MS * MINUTE_MS - MINUTE_MS  # the last minute that is over
        out = []
        if hour:
            at = min(hour) if asked is None else asked + MINUTE_MS
            received = unparsed = 0
            for m, (a, c) in hour.items():
                if at - self.span_ms <= m < at:
                    received, unparsed = received + a, unparsed + c
            while at <= min(closed, max(hour) + self.span_ms):
                new, old = hour.get(at, (0, 0)), hour.get(at - self.span_ms, (0, 0))
                received, unparsed = received + new[0] - old[0], unparsed + new[1] - old[1]
                hit = received >= self.min_lines and 100.0 * unparsed >= self.threshold_pct * received
                if hit and (alerted is None or at - alerted >= self.quiet_ms):
                    alerted = at
                    out.append((key[0], at, received, unparsed))
                asked = at
                at += MINUTE_MS
            hour = {m: v for m, v in hour.items() if asked is None or m > asked - self.span_ms}
        if asked is not None and not hour and (alerted is None or closed - alerted >= self.quiet_ms):
            self.timer(None)
            self.state.clear()
        else:
            following = [asked + 2 * MINUTE_MS if asked is not None else min(hour) + MINUTE_MS] if hour else [alerted + self.quiet_ms + MINUTE_MS]
            self.timer(max(following[0], closed + 2 * MINUTE_MS))
            minutes = sorted(hour)
            self.state.update((minutes, [hour[m][0] for m in minutes], [hour[m][1] for m in minutes], asked, alerted))
        if out:
            yield pd.DataFrame(out, columns=["ref_id", "until_ms", "received", "unparsed"])


class BurstRule(Timed):
    """Moments of one host and slice (at_us, n, own): those of its own at which the window before them holds `least` failures.

    Moments come in the order of time. The list holds one window; a timer drops it when the slice is over.
    """

    fields = "moments array<bigint>, counts array<bigint>"
    schema = "host string, slice bigint, at_us bigint, failures bigint"

    def __init__(self, window_us: int, least: int):
        self.window_us, self.least = window_us, least

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = list(zip(*self.state.get())) if self.state.exists() else []
        new = sorted((m, n) for r in rows for m, n in zip(r["at_us"].tolist(), r["n"].tolist()))
        known, out = len(seen), []
        seen += new
        first = total = 0
        for i, (m, n) in enumerate(seen):
            total += n
            while seen[first][0] < m - self.window_us:
                total -= seen[first][1]
                first += 1
            if i >= known and m // self.window_us == key[1] and total >= self.least:
                out.append((key[0], key[1], m, total))
        kept = seen[first:]
        self.state.update(([m for m, _ in kept], [n for _, n in kept]))
        self.timer((key[1] + 1) * self.window_us // 1000 + 1000)
        if out:
            yield pd.DataFrame(out, columns=["host", "slice", "at_us", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())
