"""Replay of a stream of commands: the state of a key is its value or its absence.

Commands are dealt by key and applied in order of ``seq``, so the order within
a key is kept from micro-batch to micro-batch as long as the source delivers it.
State and progress live in the checkpoint and survive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tombolo.functions.commands import reply

REPLIES = "session string, seq long, op string, key string, value string, error string, found string"
STATE = "value string"
#: Commands without a key are spread over this many groups, as they share nothing.
LOOSE = 64


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    found = []
    for op, new in zip(rows["op"], rows["value"], strict=True):
        found.append(value)
        if op == "set":
            value = new
        elif op == "delete":
            value = None
    if key[0] is not None and not pd.isna(key[0]):
        state.update((value,))
    yield rows.drop(columns=["_group"]).assign(found=pd.Series(found, index=rows.index, dtype=object))


def replayed(commands: DataFrame) -> DataFrame:
    """Adds ``found`` and ``response`` to a stream of parsed commands (session, seq, op, key, value, error)."""
    rows = commands.select("session", "seq", "op", "key", "value", "error")
    rows = rows.withColumn("_group", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("seq"), F.lit(LOOSE))).cast("int"))
    applied = rows.groupBy("key", "_group").applyInPandasWithState(_apply, REPLIES, STATE, "append", GroupStateTimeout.NoTimeout)
    return applied.withColumn("response", reply(F.col("found")))


def run_available(replies: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what a source has now, in exactly-once file output, and stop."""
    replies.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def into_store(lines: DataFrame, store, checkpoint: str, name: str = "stream"):
    """A stream of lines (session, seq, line) executed on a store, one micro-batch at a time; returns the writer to start.

    The store's manifest records the number of the last batch of stream
    ``name`` in the commit that publishes its changes, so a batch that is run
    once more after a crash changes nothing and gives the same replies.
    """
    return lines.writeStream.foreachBatch(lambda batch, number: store.execute(batch, (name, number)) and None).option("checkpointLocation", checkpoint)
