"""The driver's tables as changelogs, command scripts and probe keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes of a segment, and the one key of the point lookups.
SEGMENT_ROWS = 1000
HIT, MISS = "user-1", "nobody"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands_of(events: DataFrame) -> DataFrame:
    """(session, seq, op, key, value, error): views look a user up, errors delete it, the rest set it."""
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "delete").otherwise("set")
    value = F.concat("event_type", F.lit("#"), F.col("event_id").cast("string"))
    rows = events.select((F.col("user_id") % 8).cast("string").alias("session"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), value.alias("value"))
    return rows.withColumn("value", F.when(F.col("op") == "set", F.col("value"))).withColumn("error", F.lit(None).cast("string"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_of(table(spark, sf_dir, "events"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).filter("op <> 'get'").select("seq", "op", "key", "value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "events"))


def lines_of(events: DataFrame) -> DataFrame:
    """(session, seq, line): the commands as typed, in several spellings, with faulty and padded lines and a few quits."""
    verb = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % 3 + 1).cast("int"))
    good = (
        F.when(F.col("op") == "get", F.concat_ws(" ", verb("get", "g", "GET"), "key"))
        .when(F.col("op") == "delete", F.concat_ws(" ", verb("del", "d", "DELETE"), "key"))
        .otherwise(F.concat_ws(" ", verb("set", "s", "SET"), "key", "value"))
    )
    n = F.col("seq") % 97
    line = (
        F.when(F.col("seq") % 1231 == 7, "quit now").when(n == 0, "").when(n == 1, "frobnicate x").when(n == 2, "set onlykey").when(n == 3, "get a b").when(n == 4, "help")
        .when(n == 5, F.concat(F.lit("\t  "), good, F.lit("　 "))).otherwise(good)
    )
    return commands_of(events).select("session", "seq", line.alias("line"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key): ten times as many keys as there are users."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys and their orders as changes; an order of status P deletes."""
    gone = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(gone, "delete").otherwise("set").alias("op"), F.col("o_custkey").cast("string").alias("key"), F.when(~gone, F.col("o_orderpriority")).alias("value"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as keys and their turns as changes."""
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("seq"), F.lit("set").alias("op"), F.col("conv_id").cast("string").alias("key"), F.col("role").alias("value"))
