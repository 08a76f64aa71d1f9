"""Segments: immutable runs of a changelog with one change per key, and their merge.

The newest segment that has a key decides on it. Segments are rows with a
``segment_id``, larger for newer ones; merging is the aggregate of the latest
change, and the shuffle by key does what a merge of sorted runs would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tombolo.operators.changelog import DELETE, SET, entry_size, latest

#: Tracked bytes beyond which a memtable is flushed, and flushes after which all segments are merged.
FLUSH_BYTES, COMPACT_EVERY = 4 << 20, 10


def by_count(rows: int) -> Column:
    """Segment of a change where every segment takes ``rows`` consecutive ones."""
    return F.floor(F.col("seq") / rows).cast("long")


def flushed(changes: DataFrame, segment: Column) -> DataFrame:
    """(segment_id, seq, op, key, value): per segment the latest change of every key, tombstones included."""
    row = F.max_by(F.struct("seq", "op", "value"), "seq").alias("last")
    return changes.withColumn("segment_id", segment).groupBy("segment_id", "key").agg(row).select("segment_id", "last.seq", "last.op", "key", "last.value")


def summaries(segments: DataFrame) -> DataFrame:
    """(segment_id, n_keys, n_tombstones, min_key, max_key), newest segment first."""
    return (
        segments.groupBy("segment_id")
        .agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("op") == DELETE, 1)).alias("n_tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
        .orderBy(F.desc("segment_id"))
    )


def layered(segments: DataFrame) -> DataFrame:
    """(key, segment_id, op, value): for every key the newest segment that holds it, and what it says."""
    row = F.max_by(F.struct("segment_id", "op", "value"), F.struct("segment_id", "seq")).alias("hit")
    return segments.groupBy("key").agg(row).select("key", "hit.*")


def compacted(segments: DataFrame) -> DataFrame:
    """(seq, op, key, value) of one merged segment. Tombstones go, as nothing older is left outside."""
    return latest(segments).filter(F.col("op") == SET).select("seq", "op", "key", "value")


def compaction_stats(segments: DataFrame) -> DataFrame:
    """One row: segments_in, rows_in, rows_out, versions_dropped, tombstones_dropped."""
    keys = segments.groupBy("key").agg(F.max_by("op", "seq").alias("op"), F.count(F.lit(1)).alias("n"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = keys.agg(
        whole("n").alias("rows_in"),
        F.count(F.when(F.col("op") == SET, 1)).alias("rows_out"),
        whole(F.col("n") - 1).alias("versions_dropped"),
        F.count(F.when(F.col("op") == DELETE, 1)).alias("tombstones_dropped"),
    )
    return segments.agg(F.count_distinct("segment_id").alias("segments_in")).join(counted)  # one row each


def shadowed(segments: DataFrame) -> DataFrame:
    """(segment_id, key, seq) of the versions that a newer segment hides."""
    newest = segments.groupBy("key").agg(F.max("segment_id").alias("newest"))
    return segments.join(newest, "key").filter("segment_id < newest").select("segment_id", "key", "seq")


def flush_points(changes: DataFrame, threshold: int = FLUSH_BYTES, shards: int = 1, spread: Column | None = None) -> DataFrame:
    """(shard, flush_no, seq, tracked_bytes): where memtables that hold more than ``threshold`` bytes are flushed.

    The size counts every key once, with its present value, and starts anew
    after a flush, so that it depends on where the last flush was and has to be
    followed in order. Keys are dealt to shards by ``spread``, a number made from
    the key, with a memtable each, which run side by side; one shard is one
    memtable for all. The rows of a shard stream
    through in order, and a task holds no more than one memtable.
    """
    number = F.xxhash64("key") if spread is None else spread
    rows = changes.select(F.pmod(number, F.lit(shards)).cast("int").alias("shard"), "seq", "key", entry_size().alias("size"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, sizes, total, number = None, {}, 0, 0
        for batch in batches:
            found = []
            for s, seq, key, n in zip(batch["shard"], batch["seq"], batch["key"], batch["size"], strict=True):
                if s != shard:
                    shard, sizes, total, number = s, {}, 0, 0
                total += n - sizes.get(key, 0)
                sizes[key] = n
                if total > threshold:
                    number += 1
                    found.append((s, number, seq, total))
                    sizes, total = {}, 0
            yield pd.DataFrame(found, columns=["shard", "flush_no", "seq", "tracked_bytes"])

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(follow, "shard int, flush_no long, seq long, tracked_bytes long")
