"""Views over a changelog (seq, op, key, value).

All of them rest on one aggregate, the latest change per key, which combines on
the map side, so that a hot key costs no more than its share of the input.
Tombstones are removed after it, never before: a tombstone hides what is older.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET, DELETE = "set", "delete"
#: Bytes of an encoded entry beside its strings, one tag and a length per string.
TAG_BYTES, LENGTH_BYTES = 4, 8


def latest(changes: DataFrame, *extra: str) -> DataFrame:
    """(key, seq, op, value, *extra) of the change with the largest ``seq`` of every key."""
    row = F.max_by(F.struct("seq", "op", "value", *extra), "seq").alias("last")
    return changes.groupBy("key").agg(row).select("key", "last.*")


def live(changes: DataFrame) -> DataFrame:
    """(key, value) of all visible keys."""
    return latest(changes).filter(F.col("op") == SET).select("key", "value")


def tombstones(changes: DataFrame) -> DataFrame:
    """(key, seq) of the keys whose last change is a deletion."""
    return latest(changes).filter(F.col("op") == DELETE).select("key", "seq")


def get(changes: DataFrame, key: str) -> DataFrame:
    """(key, value) of one key, or no row. The filter reaches the scan, as it is on the grouping column."""
    return live(changes.filter(F.col("key") == key))


def multi_get(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of every distinct key asked for, the value null where it is not visible.

    Changes of other keys are left out by a semi join before they are aggregated.
    """
    asked = keys.select("key").distinct()
    return asked.join(live(changes.join(asked, "key", "left_semi")), "key", "left")


def contains(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, present) of every distinct key asked for."""
    return multi_get(changes, keys).select("key", F.col("value").isNotNull().alias("present"))


def delete_if_present(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key): the tombstones that deleting these keys would append; absent keys append nothing."""
    return contains(changes, keys).filter("present").select("key")


def range_scan(changes: DataFrame, low: str, high: str) -> DataFrame:
    """(key, value) of the visible keys from ``low`` to ``high``, both included, in order of bytes."""
    return live(changes.filter(F.col("key").between(low, high))).orderBy("key")


def as_of(changes: DataFrame, seq: int) -> DataFrame:
    """The visible keys as they were when ``seq`` had just been applied."""
    return live(changes.filter(F.col("seq") <= seq))


def entry_size() -> Column:
    """Tracked bytes of a change: its key as the key of the table, and the encoded entry, which holds the key again and the value of a ``set``."""
    value = F.coalesce(LENGTH_BYTES + F.octet_length("value"), F.lit(0))
    return (TAG_BYTES + LENGTH_BYTES + 2 * F.octet_length("key") + value).cast("long")


def stats(changes: DataFrame) -> DataFrame:
    """One row: n_changes, n_keys, n_live, n_tombstones, tracked_bytes, is_empty."""
    per_key = changes.groupBy("key").agg(F.max_by(F.struct("op", "key", "value"), "seq").alias("last"), F.count(F.lit(1)).alias("n")).select("last.*", "n")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(
        whole("n").alias("n_changes"),
        F.count(F.lit(1)).alias("n_keys"),
        whole(F.when(F.col("op") == SET, 1).otherwise(0)).alias("n_live"),
        whole(F.when(F.col("op") == DELETE, 1).otherwise(0)).alias("n_tombstones"),
        whole(entry_size()).alias("tracked_bytes"),
        (F.count(F.lit(1)) == 0).alias("is_empty"),
    )


def union_replayed(changes: DataFrame, tail: DataFrame) -> DataFrame:
    """A changelog with a part of itself applied once more: every (key, seq) counts once."""
    return changes.unionByName(tail).dropDuplicates(["key", "seq"])
