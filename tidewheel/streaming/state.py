"""Keyed stateful processors: count windows, the join of latest values, interval send."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import throttle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ordered(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    parts = list(rows)
    if not parts:
        return pd.DataFrame()
    part = parts[0] if len(parts) == 1 else pd.concat(parts)
    return part if part[order].is_monotonic_increasing else part.sort_values(order)


class CountWindow(StatefulProcessor):
    """Counts and sums over each size rows of a key; what does not fill a window stays in the state."""

    def __init__(self, size: int, order: str, value: str):
        self.size, self.order, self.value = size, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "win long, n long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        win, n, total = self.state.get() if self.state.exists() else (0, 0, 0.0)
        out = []
        for value in _ordered(rows, self.order)[self.value]:
            n, total = n + 1, total + float(value)
            if n == self.size:
                out.append((key[0], win, round(total, 2)))
                win, n, total = win + 1, 0, 0.0
        self.state.update((win, n, total))
        yield pd.DataFrame(out, columns=["k", "win", "total"])

    def close(self) -> None:
        pass


class SlidingCountWindow(StatefulProcessor):
    """On every slide-th row of a key, the number and sum of its last size rows at most."""

    def __init__(self, size: int, slide: int, order: str, value: str):
        self.size, self.slide, self.order, self.value = size, slide, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.last = handle.getListState("last", "v double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        held = [v[0] for v in self.last.get()] if self.last.exists() else []
        values = held + _ordered(rows, self.order)[self.value].astype(float).tolist()
        n = before + len(values) - len(held)
        sums = [0.0, *pd.Series(values, dtype=float).cumsum().tolist()]
        out = []
        for at in range(before + self.slide - before % self.slide, n + 1, self.slide):
            end = at - before + len(held)
            start = max(0, end - self.size)
            out.append((key[0], at, round(sums[end] - sums[start], 2), end - start))
        self.seen.update((n,))
        self.last.put([(v,) for v in values[-(self.size - 1) :]] if self.size > 1 else [])
        yield pd.DataFrame(out, columns=["k", "rn", "total", "n"])

    def close(self) -> None:
        pass


class Reminders(StatefulProcessor):
    """Each row again, delay_ms after its event time. A key's rows wait in chunks of at most most rows, in the order in which
    they are due, and the key has one timer, at the earliest of them. When it is due, the chunks with rows that are due by
    the watermark are read, and no others; how far a chunk has been put out is kept beside. So calls to the state follow keys and
    chunks of a micro-batch, not rows."""

    def __init__(self, delay_ms: int, time_ms: str, value: str, most: int = 1024):
        self.delay_ms, self.time_ms, self.value, self.most = delay_ms, time_ms, value, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk long", "dues array<long>, vs array<double>")
        self.heads = handle.getValueState("heads", "chunk array<long>, due array<long>, at array<long>")

    def _keep(self, heads: list[tuple[int, int, int]], before: int | None) -> None:
        """heads: of each chunk its number, when its next row is due, and that row's place."""
        due = min((d for _, d, _ in heads), default=None)
        if due != before and before is not None:
            self.handle.deleteTimer(before)
        if due is None:
            self.heads.clear()
            return
        if due != before:
            self.handle.registerTimer(due)
        self.heads.update(tuple(list(x) for x in zip(*heads, strict=True)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _ordered(rows, self.time_ms)
        dues = (part[self.time_ms].to_numpy(np.int64) + self.delay_ms).tolist()
        values = part[self.value].to_numpy(float).tolist()
        heads = list(zip(*self.heads.get(), strict=True)) if self.heads.exists() else []
        before = min((d for _, d, _ in heads), default=None)
        chunk = max((c for c, _, _ in heads), default=-1) + 1
        for a in range(0, len(dues), self.most):
            self.waiting.updateValue((chunk,), (dues[a : a + self.most], values[a : a + self.most]))
            heads.append((chunk, dues[a], 0))
            chunk += 1
        self._keep(heads, before)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        heads, out_due, out_v = [], [], []
        for chunk, due, at in zip(*self.heads.get(), strict=True):
            if due > mark:
                heads.append((chunk, due, at))
                continue
            dues, vs = self.waiting.getValue((chunk,))
            end = bisect.bisect_right(dues, mark)
            out_due += dues[at:end]
            out_v += vs[at:end]
            if end < len(dues):
                heads.append((chunk, dues[end], end))
            else:
                self.waiting.removeKey((chunk,))
        self._keep(heads, None)
        yield pd.DataFrame({"k": [key[0]] * len(out_due), "due_ms": out_due, "v": out_v})

    def close(self) -> None:
        pass


Hook = Callable[[float, float], tuple[bool, bool]]


class UnionJoin(StatefulProcessor):
    """The join of two streams in one: the newest value of each side of a key, and one timer.

    A row whose key has the other side gives the pair and ends the timer. One that finds the other side missing starts the
    timer, if none runs; when it is due, find_left and find_right are asked for the side that is still missing, what they find
    is kept, and the key's values go out as they are. replace_left and replace_right, given a side's new and old value, say
    whether the new one is kept and whether it is worked on further. Values older than ttl_us are as if they were not there.

    The clock is the rows' time_us, in the order of a whole-number column; a timer is due before the first row of its key that
    is later, or when the watermark is. Without delay_us there are no timers. Columns: k, kind (pair or timeout), o (the order
    of a pair's row), at_us, opened_us (when a timeout's timer began), left_value, right_value."""

    FIELDS = "k long, kind string, o long, at_us long, opened_us long, left_value double, right_value double"

    def __init__(
        self,
        order: str,
        side: str,
        value: str,
        time_us: str,
        delay_us: int | None = None,
        ttl_us: int | None = None,
        replace_left: Hook | None = None,
        replace_right: Hook | None = None,
        find_left: Callable[[Any], float | None] | None = None,
        find_right: Callable[[Any], float | None] | None = None,
    ):
        self.order, self.side, self.value, self.time_us, self.delay_us, self.ttl_us = order, side, value, time_us, delay_us, ttl_us
        self.replace, self.find = {True: replace_left, False: replace_right}, {True: find_left, False: find_right}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value holds all of a key, as each call to the state has its price
        self.all = handle.getValueState("all", "left double, left_at long, right double, right_at long, opened long, due long")

    def _live(self, held: tuple[float, int] | None, now: int) -> float | None:
        return None if held is None or (self.ttl_us is not None and now - held[1] >= self.ttl_us) else held[0]

    def _fire(self, key: Any, held: dict[bool, tuple[float, int] | None], timer: tuple[int, int]) -> list[tuple]:
        opened, due = timer
        found = {left: self._live(held[left], due) for left in held}
        if found[True] is not None and found[False] is not None:
            return []
        for left, v in found.items():
            if v is None and self.find[left] is not None and (v := self.find[left](key[0])) is not None:
                held[left], found[left] = (v, due), v
        return [(key[0], "timeout", None, due, opened, found[True], found[False])]

    def _read(self) -> tuple[dict[bool, tuple[float, int] | None], tuple[int, int] | None]:
        """The newest value of each side with its time, and the timer."""
        a, a_at, b, b_at, opened, due = self.all.get() if self.all.exists() else (None,) * 6
        held = {True: None if a_at is None else (a, a_at), False: None if b_at is None else (b, b_at)}
        return held, None if due is None else (opened, due)

    def _keep(self, held: dict[bool, tuple[float, int] | None], before: tuple[int, int] | None, timer: tuple[int, int] | None) -> None:
        self.all.update((*(held[True] or (None, None)), *(held[False] or (None, None)), *(timer or (None, None))))
        if timer == before:
            return
        if before is not None:
            self.handle.deleteTimer(before[1] // 1000 + 1)
        if timer is not None:
            self.handle.registerTimer(timer[1] // 1000 + 1)

    def _columns(self, part: pd.DataFrame) -> list[list]:
        kinds = {self.order: None, self.side: bool, self.value: float, self.time_us: int}
        return [part[c].to_numpy(kind).tolist() for c, kind in kinds.items()]

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in self.FIELDS.split(", ")]
        kinds = {c: "Int64" for c in ("k", "o", "at_us", "opened_us")} | {"kind": object, "left_value": "float64", "right_value": "float64"}
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pd.DataFrame({c: pd.Series(list(v), dtype=kinds[c]) for c, v in zip(names, columns, strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (held, before), out = self._read(), []
        timer = before
        part = _ordered(rows, self.order)
        for o, left, v, now in zip(*self._columns(part), strict=True):
            if timer is not None and timer[1] < now:
                out += self._fire(key, held, timer)
                timer = None
            old = self._live(held[left], now)
            replace, handle = self.replace[left](v, old) if old is not None and self.replace[left] else (True, True)
            if replace:
                held[left] = (v, now)
            if not (replace and handle):
                continue
            other = self._live(held[not left], now)
            if other is not None:
                pair = (v, other) if left else (other, v)
                out.append((key[0], "pair", o, now, None, *pair))
                timer = None
            elif timer is None and self.delay_us is not None:
                timer = (now, now + self.delay_us)
        self._keep(held, before, timer)
        yield self._table(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held, timer = self._read()
        if timer is not None and timer[1] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            out = self._fire(key, held, timer)
            self._keep(held, None, None)
        yield self._table(out)

    def close(self) -> None:
        pass


class IntervalSend(StatefulProcessor):
    """At most the newest row of a key for each interval. A row that finds no interval open opens one; at its end the buffer is
    sent. Eager: the row that opens it is sent at once. Ends fall on multiples of round_ms, so that timers of many keys fall
    together. newer: a column of whole numbers; a row whose is smaller than the buffer's does not replace it. The rows of a
    micro-batch are looked at together (operators/throttle.py)."""

    def __init__(self, interval_ms: int, time_ms: str, value: str, eager: bool = True, round_ms: int = 1, newer: str | None = None):
        self.interval_ms, self.time_ms, self.value, self.eager, self.round_ms, self.newer = interval_ms, time_ms, value, eager, round_ms, newer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the buffer, if ver is there, and when the timer is due
        self.all = handle.getValueState("all", "v double, ver long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _ordered(rows, self.time_ms)
        at, values = part[self.time_ms].to_numpy(np.int64), part[self.value].to_numpy(float)
        version = part[self.newer].to_numpy(np.int64) if self.newer else np.zeros(len(at), np.int64)
        v, ver, before = self.all.get() if self.all.exists() else (None, None, throttle.NONE)
        held = None if ver is None else (v, ver)
        jumps = throttle.Jumps(np.zeros(len(at), np.int64), at, self.interval_ms, self.round_ms)
        (row, due, timed), ends = throttle.sends(version, jumps, np.array([before]), self.eager)
        out = [(key[0], int(t), float(values[r])) for r, t in zip(row[~timed], due[~timed], strict=True)]
        newest = {int(t): (float(values[r]), int(version[r])) for r, t in zip(row[timed], due[timed], strict=True)}
        if held is not None and (before not in newest or newest[before][1] < held[1]):
            newest[before] = held
        end = int(ends[-1])
        kept = newest.pop(end, None)
        out += [(key[0], t, v) for t, (v, _) in newest.items()]
        self.all.update((*(kept or (None, None)), end))
        if end != before:
            if before != throttle.NONE:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(end)
        yield pd.DataFrame(sorted(out), columns=["k", "sent_ms", "v"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        v, ver, _ = self.all.get() if self.all.exists() else (None, None, None)
        out = [] if ver is None else [(key[0], int(expiredTimerInfo.getExpiryTimeInMs()), v)]
        self.all.clear()
        yield pd.DataFrame(out, columns=["k", "sent_ms", "v"])

    def close(self) -> None:
        pass
