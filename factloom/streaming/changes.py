"""Streams (an extension; the batch operators are the reference): windowed rates with late data, and the latest state of a log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rates(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """begin, event_type, n, total by window; rows later than the watermark are dropped, and windows leave when it passes them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def latest(decisions: DataFrame) -> DataFrame:
    """assertion_id, action, seq: the latest decision of each assertion, emitted whenever a later one arrives; state is one row per id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, action = state.get if state.exists else (-1, None)
        before = seq
        for b in batches:
            i = b["seq"].idxmax()
            if b["seq"][i] > seq:
                seq, action = int(b["seq"][i]), b["action"][i]
        if seq > before:
            state.update((seq, action))
            yield pd.DataFrame({"assertion_id": [key[0]], "action": [action], "seq": [seq]})

    return decisions.groupBy("assertion_id").applyInPandasWithState(step, "assertion_id long, action string, seq long", "seq long, action string", "append", GroupStateTimeout.NoTimeout)
