"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the small side in a salted join: a key that holds a third of all
#: rows is dealt to this many partitions.
SALTS = 32
#: Rows of a key beyond which a join splits it.
HOT_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join on ``key`` where a key may hold a large part of ``left``.

    ``right`` has one row per key. Its rows are repeated once per salt and the
    rows of ``left`` pick a salt from ``spread`` (any column that varies inside
    a key), so no task gets all rows of a hot key.
    """
    salt = unused("salt", left, right)
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [key, salt], "left").drop(salt)


def split_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", rows: str | None = None, most: int = HOT_ROWS) -> DataFrame:
    """Join on ``key``, of which ``right`` has one row each, where a key may hold a large part of ``left``.

    Keys with more than ``most`` rows are counted first, or known from column
    ``rows`` of ``right``; they are fewer than the rows by that factor, so they
    are broadcast. Their row of ``right`` is repeated once per lane of ``most``
    rows, and rows of ``left`` pick a lane from ``spread``.
    """
    lanes, lane = unused("lanes", left, right), unused("lane", left, right)
    counts = right.select(key, F.col(rows).alias(lanes)) if rows else left.groupBy(key).agg(F.count(F.lit(1)).alias(lanes))
    hot = F.broadcast(counts.filter(F.col(lanes) > most).select(key, F.ceil(F.col(lanes) / most).alias(lanes)))
    many = F.coalesce(F.col(lanes), F.lit(1))
    dealt = left.join(hot, key, "left").withColumn(lane, F.pmod(F.xxhash64(spread), many)).drop(lanes)
    repeated = right.join(hot, key, "left").withColumn(lane, F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop(lanes)
    return dealt.join(repeated, [key, lane], how).drop(lane)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until no column of the tables has it in either case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine, as in tests, a session may name none; a folder of the
    local user is set then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = Path(os.environ.get("TOMBOLO_CHECKPOINTS", "/tmp/checkpoints")).as_uri()
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths that were written below the shared folder and not yet removed.
_kept: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes at the latest when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    _kept.append(path)
    return path


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def mark() -> int:
    """A point in what has been written, for ``clear``."""
    return len(_kept)


def clear(spark: SparkSession, since: int) -> None:
    """Remove what was written since ``mark`` gave ``since``, but for the table written last, which the others were for."""
    for path in _kept[since:-1]:
        where, files = _files(spark, path)
        files.delete(where, True)
    del _kept[since:-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: a lost executor then costs no recomputation of what came before."""
    path = f"{shared_path(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in out)}


def in_parts(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to ``most`` at most, or that are one row."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            out.append((begin, k))
            begin, total = k, 0
        total += n
    return out + [(begin, len(sizes))] if sizes else []


def text_parts(column, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end, texts) of an Arrow column of texts, as many at once as hold ``most`` characters; null is empty."""
    for i, j in in_parts(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), most):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]
