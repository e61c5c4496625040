"""Leases and waiting lines as the state of a stream.

The key is the containment root. Its leases lie in state maps by symbol, by agent and by the symbols around them, the lines by
symbol, so a command reads and writes the entries near its symbol and not all that the root holds. The rules are those of the
batch replay: the same commands give the same outcomes however they are cut into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.state import COLUMNS, Leases, outcomes
from loomgraph.sources.tables import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept:
    """A state map with lists for values, read like a dict; entries that a batch has met are remembered while it lasts."""

    def __init__(self, state):
        self.state, self.met = state, {}

    def get(self, key: str):
        if key not in self.met:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.met[key] = json.loads(found[0]) if found else None
        return self.met[key]

    def __setitem__(self, key: str, value: list) -> None:
        self.met[key] = value
        self.state.updateValue((key,), (json.dumps(value),))

    def pop(self, key: str, default=None):
        self.met[key] = None
        self.state.removeKey((key,))
        return default


class LeaseProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {name: handle.getMapState(name, "key string", "value string") for name in Leases.MAPS}
        self.clock = handle.getValueState("clock", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = json.loads(self.clock.get()[0]) if self.clock.exists() else None
        state = Leases({name: Kept(m) for name, m in self.maps.items()}, clock)
        out = outcomes(state, pd.concat(list(rows)))
        self.clock.update((json.dumps(state.clock),))
        yield out

    def close(self) -> None:
        pass


def lease_stream(commands: DataFrame) -> DataFrame:
    """(id, outcome, lease, holder) of a stream of commands as operators.state.replay takes them, with `root`; commands of a key come in the order of (ts, id), within a micro-batch in any.

    The state lies in RocksDB, which transformWithState asks for: the session's setting is changed if it names another store.
    """
    spark = commands.sparkSession
    ship(spark)
    spark.conf.set(PROVIDER, ROCKS)
    return commands.groupBy("root").transformWithStateInPandas(LeaseProcessor(), COLUMNS, "append", "None")
