from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql.types import StructType

from convqa.streaming import reorder


class Store:
    """State of any kind in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] += 1
            if name == "get":
                return iter(list(self.held)) if isinstance(self.held, list) else self.held
            if name == "appendList":
                self.held = (self.held or []) + list(args[0])
            elif name in ("update", "put"):
                self.held = args[0]
            elif name == "clear":
                self.held = None
            elif name == "exists":
                return self.held is not None
            elif name in ("keys", "values"):
                return iter(())
        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def _store(self, *_):
        return Store(self.calls)

    getListState = getMapState = getValueState = _store
    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.discard(ms)


class Echo:
    def __init__(self, values=None):
        pass

    take = lambda self, row: [(row.at, row.text)]
    reach = lambda self, ms: []
    due = values = lambda self: None


def test_rows_go_to_state_and_back_by_the_list(spark):
    ddl = StructType.fromDDL
    work, handle = reorder.InOrder(Echo, ["at"], ["at", "text"], ddl("at bigint"), ddl("text string"), "x bigint", ["k", "at", "text"]), Handle()
    work.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = pd.DataFrame({"at": [(n * 37) % 1000 for n in range(1000)], "text": [f"t{(n * 37) % 1000}" for n in range(1000)]})
    list(work.handleInputRows((1,), iter([rows[:600], rows[600:]]), clock(0)))
    assert handle.timers == {1}
    handle.timers.clear()
    out = pd.concat(list(work.handleExpiredTimer((1,), clock(399), None)))
    assert list(out["at"]) == list(range(400)) and handle.timers == {400}
    handle.timers.clear()
    out = pd.concat(list(work.handleExpiredTimer((1,), clock(5000), None)))
    assert list(out["text"]) == [f"t{n}" for n in range(400, 1000)] and not handle.timers
    assert sum(handle.calls.values()) < 30
