"""What keyed processors on streams share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Processors with timers need the RocksDB state store."""
    spark.conf.set(PROVIDER, ROCKS)


def in_order(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, sorted."""
    return pd.concat(list(rows)).sort_values(list(columns), ignore_index=True)

