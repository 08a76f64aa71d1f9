"""Sources of command lines. A script needs a total order, which a set of text files does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_list(spark: SparkSession, lines: list[str], session: str = "local", first: int = 0) -> DataFrame:
    """(session, seq, line) of lines at hand, as a prompt would read them."""
    return spark.createDataFrame([(session, first + i, line) for i, line in enumerate(lines)], "session string, seq long, line string")


def from_table(table: DataFrame, session: str, seq: str, line: str) -> DataFrame:
    """(session, seq, line) of a table that has an order of its own."""
    return table.select(F.col(session).cast("string").alias("session"), F.col(seq).cast("long").alias("seq"), F.col(line).cast("string").alias("line"))


def from_file(spark: SparkSession, path: str, session: str = "local") -> DataFrame:
    """(session, seq, line) of one text file, its lines in order; more than one file is refused.

    A file is read whole, as one row; a script too long for that belongs in a table.
    """
    text = spark.read.text(path, wholetext=True)
    if len(text.inputFiles()) != 1:
        raise ValueError("a script of several files needs an order: read them as a table and use from_table")
    body = F.regexp_replace("value", "\\r?\\n\\z", "")
    lines = text.filter("value <> ''").select(F.posexplode(F.split(body, "\\r?\\n")).alias("seq", "line"))
    return lines.select(F.lit(session).alias("session"), F.col("seq").cast("long").alias("seq"), "line")


def from_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream (line, timestamp) from a socket of raw lines; for tests and demonstrations, as Spark's socket source cannot be replayed.

    It has no order inside a millisecond; ``server`` takes sessions and gives
    their lines an order.
    """
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().withColumnRenamed("value", "line")
