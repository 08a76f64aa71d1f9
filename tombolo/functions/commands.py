"""The command language, as column expressions: a line is parsed into a
command or an error, and a command with what it found is rendered as its reply.

Words are parted by Unicode white space. The verb is read in either case; keys
and values are taken as they stand. A line without a word lacks its arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tombolo.schema import MISSING, TOO_MANY, UNRECOGNIZED, VERBS, WORDS

_SPACE = r"(?U)\s+"
#: Fixed value: the reply to ``help``.
HELP_TEXT = """set <key> <value>    (alias: s)
get <key>            (alias: g)
delete <key>         (alias: d, del)
quit                 (alias: q, exit)"""

#: Fixed value: the width of the rule around the banner.
RULE_WIDTH = 36


def rule(width: int = RULE_WIDTH) -> Column:
    """A horizontal rule."""
    return F.repeat(F.lit("-"), F.lit(width))


def words_of(line: Column) -> Column:
    """The words of a line, without empty ones; a null line has none."""
    return F.filter(F.split(F.coalesce(line, F.lit("")), _SPACE), lambda w: w != "")


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds op, key, value and error to ``lines``; exactly one of op and error is null."""
    words, n = F.col("_words"), F.size("_words")
    # maps and not chains of conditions, so that the plan stays small where expressions are put into each other
    verbs = _map({spelling: name for name, spellings in VERBS.items() for spelling in spellings})
    wanted = F.try_element_at(_map(WORDS), F.col("_op"))
    error = (
        F.when(n == 0, MISSING).when(F.col("_op").isNull(), UNRECOGNIZED)
        .when(n < wanted, MISSING).when(n > wanted, TOO_MANY)
    )
    rows = lines.withColumn("_words", words_of(F.col(line))).withColumn("_op", F.try_element_at(verbs, F.lower(F.get(words, F.lit(0))))).withColumn("error", error)
    good = F.when(F.col("error").isNull(), F.col("_op"))
    return rows.select(
        *[c for c in lines.columns if c not in ("op", "key", "value", "error")],
        good.alias("op"),
        F.when(good.isin(*WORDS), F.get(words, F.lit(1))).alias("key"),
        F.when(good == "set", F.get(words, F.lit(2))).alias("value"),
        "error",
    )


def _map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def reply(found: Column) -> Column:
    """The reply to a parsed command; ``found`` is the value that its key had just before, null for none. ``quit`` has no reply."""
    key, op = F.col("key"), F.col("op")
    absent = F.concat(key, F.lit(" not found"))
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .when(op == "set", F.concat(key, F.lit(" => "), F.col("value")))
        .when(op == "get", F.when(found.isNull(), absent).otherwise(F.concat(key, F.lit(" => "), found)))
        .when(op == "delete", F.when(found.isNull(), absent).otherwise(F.concat(key, F.lit(" deleted"))))
        .when(op == "help", F.lit(HELP_TEXT))
    )
