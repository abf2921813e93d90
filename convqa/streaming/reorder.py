"""Streams whose rows come in any order within their lateness: a buffer per key hands them on in order.

Rows wait in list state until the watermark has passed their time; then nothing earlier can come, and they go to a small
machine in order. They are stored and fetched as lists, because every single access to state is a call out of Python. One
event-time timer per key stands at the next thing to do: the earliest waiting row or the machine's own deadline. When the
machine has nothing open and no row waits, the key has no state left.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(Protocol):
    """What is done with the rows of a key. Methods return output rows without the key."""

    def take(self, row: Any) -> list[tuple]:
        """The next row in order."""

    def reach(self, ms: int) -> list[tuple]:
        """Event time has come to ``ms``."""

    def due(self) -> int | None:
        """When it wants to be called next, if no row comes."""

    def values(self) -> tuple | None:
        """What it has to remember; nothing when it has nothing open."""


class InOrder(StatefulProcessor):
    """``columns`` after the key: the order columns, then the rest; ``at`` (event time in ms) is one of them."""

    def __init__(self, machine: Callable[[tuple | None], Machine], order: Sequence[str], columns: Sequence[str], order_type: StructType, rest_type: StructType, state: str, out: Sequence[str]):
        self.machine, self.order, self.rest, self.out = machine, list(order), [c for c in columns if c not in order], list(out)
        self.order_type, self.rest_type, self.state = order_type, rest_type, state
        self.at = self.order.index("at")
        self.whole = [isinstance(f.dataType, IntegralType) for f in (*order_type, *rest_type)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([*self.order_type, *self.rest_type]))
        # when the earliest row waits, when the machine wants to be called, and where the timer stands
        self.plan = handle.getValueState("plan", "first bigint, due bigint, timer bigint")
        self.kept = handle.getValueState("kept", self.state)
        self.row = namedtuple("row", [*self.order, *self.rest])

    def _next(self, first: int | None, due: int | None, timer: int | None, now: int, before: tuple) -> None:
        """Set the timer (``timer`` is the one standing) and remember what changed."""
        times = [ms for ms in (first, due) if ms is not None]
        wanted = max(min(times), now + 1) if times else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None:
            self.plan.clear()
        elif (first, due, wanted) != before:
            self.plan.update((first, due, wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.plan.get() or (None, None, None))
        first, due, timer = before
        for batch in rows:
            cells = [[_plain(v, whole) for v in batch[c].tolist()] for c, whole in zip((*self.order, *self.rest), self.whole)]
            if cells[0]:
                self.waiting.appendList(list(zip(*cells)))
                first = min(cells[self.at]) if first is None else min(first, *cells[self.at])
        self._next(first, due, timer, timerValues.getCurrentWatermarkInMs(), before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, n = timerValues.getCurrentWatermarkInMs(), len(self.order)
        before = tuple(self.plan.get() or (None, None, None))
        first = before[0]
        kept = self.kept.get()
        machine, found = self.machine(None if kept is None else tuple(kept)), []
        if first is not None and first <= now:
            # of rows with one place the last that came holds
            rows = {row[:n]: row[n:] for row in map(tuple, self.waiting.get())}
            for place in sorted(place for place in rows if place[self.at] <= now):
                found += machine.take(self.row(*place, *rows.pop(place)))
            first = min((place[self.at] for place in rows), default=None)
            if rows:
                self.waiting.put([place + rest for place, rest in rows.items()])
            else:
                self.waiting.clear()
        found += machine.reach(now)
        values = machine.values()
        if values is not None:
            self.kept.update(values)
        elif kept is not None:
            self.kept.clear()
        # the timer that came is gone
        self._next(first, machine.due(), None, now, before)
        if found:
            yield pd.DataFrame([(key[0], *x) for x in found], columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def _plain(v: Any, whole: bool) -> Any:
    """A cell as state takes it: missing values as None, arrays as lists, whole numbers whole (pandas makes a column with gaps a float one)."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return int(v) if whole else v


def in_order(rows: DataFrame, key: str, order: Sequence[str], machine: Callable[[tuple | None], Machine], state: str, output: str) -> DataFrame:
    """``machine`` over the rows of each key in ``order``, as a stream.

    ``rows`` have event time ``ts`` with a watermark and ``at``, the same in milliseconds, among the order columns, which
    must tell the rows of a key apart. ``state`` and ``output`` are schemas; the output starts with the key.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the only store that keeps timers and maps
    columns = [c for c in rows.columns if c not in (key, "ts")]
    kind = lambda names: StructType([rows.schema[c] for c in names])
    rest = [c for c in columns if c not in order]
    out = [f.split()[0] for f in _fields(output)]
    processor = InOrder(machine, order, columns, kind(order), kind(rest), state, out)
    return rows.select(F.col(key), *columns, "ts").groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime")


def _fields(ddl: str) -> list[str]:
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]
