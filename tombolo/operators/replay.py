"""Running a script of commands: every command sees the store as it was just before.

No command touches two keys, so the order within a key is all that matters, and
a window over the key's commands gives each its view. A script is one DataFrame
with a total order ``seq``; sessions share the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tombolo.functions.commands import parsed, reply


def before_quit(commands: DataFrame, session: str = "session", keep_quit: bool = True) -> DataFrame:
    """The commands of each session up to its first ``quit``.

    The first ``quit`` of a session is an aggregate that combines on the map
    side; sessions without one take no part in the join's right side.
    """
    ends = commands.filter(F.col("op") == "quit").groupBy(session).agg(F.min("seq").alias("_end"))
    last = F.col("seq") <= F.col("_end") if keep_quit else F.col("seq") < F.col("_end")
    return commands.join(ends, session, "left").filter(F.col("_end").isNull() | last).drop("_end")


def replayed(commands: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Adds ``found``, the value a command's key had before it, and ``response`` to parsed commands.

    ``initial`` has the (key, value) that are visible before the first command.
    Commands without a key, errors among them, need no view and skip the window.
    """
    columns = commands.columns
    keyed = commands.filter(F.col("key").isNotNull())
    if initial is not None:
        touched = keyed.select("key").distinct()
        seed = initial.join(touched, "key", "left_semi").select(F.lit(-1).cast("long").alias("seq"), F.lit("seed").alias("op"), "key", "value")
        keyed = keyed.unionByName(seed, allowMissingColumns=True)
    past = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("op") != "get", F.struct(F.when(F.col("op") != "delete", F.col("value")).alias("value")))
    viewed = keyed.withColumn("found", F.last(written, ignorenulls=True).over(past)["value"])
    rest = commands.filter(F.col("key").isNull()).withColumn("found", F.lit(None).cast("string"))
    both = viewed.filter(F.col("op") != "seed").select(*columns, "found").unionByName(rest)
    return both.withColumn("response", reply(F.col("found")))


def effects(replies: DataFrame) -> DataFrame:
    """(seq, op, key, value): the changes that replayed commands append; a deletion that found nothing appends none."""
    acted = (F.col("op") == "set") | ((F.col("op") == "delete") & F.col("found").isNotNull())
    return replies.filter(acted).select("seq", "op", "key", "value")


def run_script(lines: DataFrame, initial: DataFrame | None = None, line: str = "line") -> DataFrame:
    """Parse, end sessions at ``quit``, replay: (session, seq, line, ..., response)."""
    return replayed(before_quit(parsed(lines, line)), initial)
