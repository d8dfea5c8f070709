"""Guids already seen, as keyed streaming state bounded by their number.

The state of a key (a feed) is the list of its newest ``keep`` guids, oldest
first.  A guid in the list is dropped; a new one is passed on and appended, and
the oldest is forgotten beyond the bound.  Rows are taken in order, so where
batches end changes nothing, and a replayed batch starts from the state before it.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# as in tick_state: the driver's Python worker has no files added with addPyFile
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class GuidMemory(StatefulProcessor):
    """Passes on the first row of every guid that is not among the newest ``keep`` of its key."""

    def __init__(self, keep: int, order_col: str):
        self.keep, self.order_col = keep, order_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.guids = handle.getListState("guids", "guid string")

    def handleInputRows(self, key, rows, timerValues):
        stored = [r[0] for r in self.guids.get()] if self.guids.exists() else []
        memory = dict.fromkeys(stored)  # keeps the order of arrival
        new = pd.concat(list(rows), ignore_index=True).sort_values([self.order_col, "guid"], kind="stable").reset_index(drop=True)
        first = []
        for i, guid in enumerate(new["guid"]):
            if guid not in memory:
                first.append(i)
                memory[guid] = None
                if len(memory) > self.keep:
                    del memory[next(iter(memory))]
        if first:
            self.guids.put([(g,) for g in memory])
            yield new.iloc[first]

    def close(self) -> None:
        pass
