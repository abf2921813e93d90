"""Memory that the arrays of a batch took does not stay with the worker."""

import numpy as np
import pyarrow as pa

from convqa.llm.arrow import small_batches


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_freed_arrays_leave_the_process():
    batches = iter([pa.RecordBatch.from_arrays([pa.array(["some text"])], names=["text"])])
    begin, pins = resident(), []
    for _ in small_batches(batches, 0, tidy=True):
        held = [np.ones(7_500) for _ in range(4_000)]  # 240 MB in pieces too small for maps of their own
        pins.append(held[-1])  # the last one keeps the heap from shrinking at its end
        assert resident() - begin > 150
        del held
    assert resident() - begin < 100
