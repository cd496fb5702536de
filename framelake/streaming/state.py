"""Keyed state of several kinds (values, lists, maps) over streams and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stored(df: DataFrame) -> DataFrame:
    """df, in a session that has a store for state of several kinds."""
    if not df.sparkSession.conf.get(_STORE, None):
        df.sparkSession.conf.set(_STORE, _ROCKS)
    _ = df.sparkSession.streams.active  # over a table too, the state stores report to the session's manager of streams, which starts when it is asked for
    return df


def keyed(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """The rows that a processor makes of each key's rows. State of several kinds needs the RocksDB store, which is set where the session has none set."""
    return _stored(df).groupBy(*keys).transformWithState(processor, schema, "Append", "None")


def keyed_frames(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """As keyed(), for a processor that takes and makes pandas frames: columns go between Spark and Python as a whole, which many rows a key need."""
    return _stored(df).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")
