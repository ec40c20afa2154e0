"""The job state machine over a stream of moves: keyed state, the same verdicts as ``operators.state.applied``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quirework.operators.state import STATES, moved

#: A session that judges moves must keep state with this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Machine(StatefulProcessor):
    """One state a job; a refused move leaves it.  Moves of one batch are taken in order."""

    def __init__(self, order: str, to: str):
        self.order, self.to = order, to

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "code int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        code = self.state.get()[0] if self.state.exists() else 0
        frame = pd.concat(list(rows))
        asked = frame[self.to].map({s: k + 1 for k, s in enumerate(STATES)}).fillna(0).astype(int)
        frame = frame.assign(_k=asked).sort_values([self.order, "_k"])
        before, error = [], []
        for k in frame["_k"]:
            after = moved(code, k)
            before.append(STATES[code - 1] if code else None)
            error.append("INVALID_JOB_TRANSITION" if after is None else None)
            code = code if after is None else after
        self.state.update((code,))
        yield frame.drop(columns="_k").assign(before=before, error=error)

    def close(self) -> None:
        pass


def applied(moves: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """The stream with ``before`` and ``error``; moves that arrive late meet the state as it is then."""
    schema = StructType(list(moves.schema.fields)).add("before", "string").add("error", "string")
    return moves.groupBy(F.col(key)).transformWithStateInPandas(Machine(order, to), schema, "Append", "None")
