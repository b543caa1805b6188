"""Continuous ingestion: each micro-batch of a mutation log becomes a run; newest versions kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators.state import latest


def write_runs(log: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each micro-batch as ``run_id=<batch>``.  A repeated micro-batch overwrites its own run, so results are exactly once."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("key", F.desc("seq")).write.mode("overwrite").parquet(f"{folder}/run_id={number}")

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_versions(log: DataFrame, ttl: str | None = None) -> DataFrame:
    """The newest version of each key as state: a row whenever it changes (update mode).

    Late rows are harmless, since the sequence number decides.  With ``ttl`` (such as
    "3 seconds") a key's state expires that long after its last change.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        seq, kind, value = held.get if held.exists else (-1, 0, None)
        before = seq
        for frame in frames:
            top = frame.loc[frame["seq"].idxmax()]
            if top["seq"] > seq:
                seq, kind, value = int(top["seq"]), int(top["kind"]), top["value"]
        held.update((seq, kind, value))
        if ttl:
            held.setTimeoutDuration(ttl)
        if seq > before:
            yield pd.DataFrame({"key": [key[0]], "seq": [seq], "kind": [kind], "value": [value]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return log.groupBy("key").applyInPandasWithState(step, "key string, seq long, kind int, value string", "seq long, kind int, value string", "update", timeout)


def state_of_runs(log_runs: DataFrame) -> DataFrame:
    """The newest versions over all runs that :func:`write_runs` has written."""
    return latest(log_runs.drop("run_id"))
