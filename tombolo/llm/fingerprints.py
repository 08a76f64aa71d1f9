"""Document fingerprints by winnowing.

Words are maximal runs of letters and digits, lower-cased. Every run of five
words has a rolling hash, the polynomial of its words' hashes modulo the prime
2**31 - 1, so that a word is hashed once and not once per run; of every eight
hashes in a row the smallest is chosen, the rightmost of equal ones, and kept
with its place. Two
texts that share twelve words in a row (window + k - 1) therefore share a
chosen hash at the two places where that passage has it, and no passage of
fewer than five words can make them share one. A text of one to four words has
the one hash of all of its words; one without words has an empty fingerprint.

All of it is SQL on arrays, without a loop from place to place: the hash of a
run of a + b words comes from those of its first a and last b, for all places
at once, and the minima of windows of eight come from three rounds of pairwise
minima, over numbers that hold the hash above and the place, counted down,
below.

Likeness is the Jaccard similarity of the sets of chosen hashes; of two texts
without words it is 1.

Defined results: a null text is the empty text; the document after a document
is the one with the next smaller id, after the smallest the largest, so that a
lone document follows itself; very long texts are hashed whole, in time linear
in their length; rows with a null id come last; rows that repeat an
id have the same next document, and for such an id the smallest text stands as
the next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
#: Ranges of ids per shuffle partition; the driver's sample of ids grows with it.
RANGES = 4
#: The modulus and the base of the rolling hash.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_BITS = 31
#: Places and hashes are kept in 31 bits each.
_MASK = (1 << _BITS) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def rolled(k: int) -> str:
    """SQL for the hashes of all runs of ``k`` words of the array ``w``; of fewer words the one hash of all, of none no hash.

    The hash is h(1) B**(k-1) + ... + h(k). Runs of twice the words come from two
    runs, and one word more from a run and a word, as the bits of ``k`` say.
    """
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    added = lambda a, b, n, m: f"zip_with(slice({a}, 1, size(h) - {n + m - 1}), slice({b}, {n + 1}, size(h) - {n + m - 1}), (x, y) -> (x * {pow(BASE, m, PRIME)}L + y) % {PRIME}L)"
    steps, n = [], 1
    for bit in bin(k)[3:]:
        now = f"g{n}" if n > 1 else "h"
        steps.append((added(now, now, n, n), f"g{2 * n}"))
        n *= 2
        if bit == "1":
            steps.append((added(f"g{n}", "h", n, 1), f"g{n + 1}"))
            n += 1
    body = steps[-1][1] if steps else "h"
    for value, name in reversed(steps):
        body = let(value, name, body)
    few = f"CASE WHEN size(h) = 0 THEN h ELSE array(aggregate(h, 0L, (a, x) -> (a * {BASE}L + x) % {PRIME}L)) END"
    return let(f"transform(w, x -> pmod(xxhash64(x), {PRIME}L))", "h", f"CASE WHEN size(h) < {k} THEN {few} ELSE {body} END")


def winnowed(text: str, k: int = K, window: int = WINDOW) -> Column:
    """The chosen (hash, place) of column ``text`` in order of place, as an array of longs, hash above and place below.

    A window of w is covered by doubling: minima over 1, 2, 4, ... places, then
    one overlap; a text of fewer hashes than a window is one window.
    """
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    # numbers sort by hash, then by place from the right
    hashed = f"transform({rolled(k)}, (x, i) -> shiftleft(x, {_BITS}) | ({_MASK}L - i))"
    steps, reach, body = [], 1, None
    while reach * 2 <= window:
        steps.append(reach)
        reach *= 2
    if reach < window:
        steps.append(window - reach)
    names = [f"m{i}" for i in range(len(steps) + 1)]
    last = names[-1]
    body = f"transform(array_distinct({last}), x -> (x & {~_MASK}L) | ({_MASK}L - (x & {_MASK}L)))"
    for i in range(len(steps) - 1, -1, -1):
        a, b, s = names[i], names[i + 1], steps[i]
        # where a text has too few hashes for a full window, what there is gives the minimum
        step = f"CASE WHEN size({a}) <= {s} THEN slice(array(array_min({a})), 1, size({a})) ELSE zip_with(slice({a}, 1, size({a}) - {s}), slice({a}, {s} + 1, size({a}) - {s}), (x, y) -> least(x, y)) END"
        body = let(step, b, body)
    body = let(hashed, names[0], body)
    return F.expr(let(text, "w", body))


def hashes_of(fingerprint: str) -> Column:
    return F.expr(f"array_distinct(transform({fingerprint}, x -> shiftright(x, {_BITS})))")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    return F.expr(
        f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE transform(array(size(array_intersect({a}, {b}))), n -> CAST(n AS DOUBLE) / (size({a}) + size({b}) - n))[0] END"
    )


def as_string(fingerprint: str) -> Column:
    """``hash@place`` of all that were chosen, hashes in hexadecimal."""
    return F.expr(f"array_join(transform({fingerprint}, x -> concat(hex(shiftright(x, {_BITS})), '@', x & {_MASK}L)), ' ')")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, chosen): every document's winnowed hashes with their places."""
    text = F.coalesce(F.col(content), F.lit(""))
    return docs.select(doc_id, text.alias("text"), words_of(text).alias("_words")).select(doc_id, "text", winnowed("_words", k, window).alias("chosen"))


def ranges(docs: DataFrame, doc_id: str, parts: int) -> tuple[list[int], list[int | None]]:
    """(least id of each range but the first, greatest id of each range) of ranges of about equal size.

    Ids alone are dealt by range; what reaches the driver is one row per range,
    a number that follows the partitions and not the rows. A null id counts as
    the smallest.
    """
    ids = docs.select(F.col(doc_id).alias("id")).repartitionByRange(parts, F.asc_nulls_first("id"))
    heads = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("least"), F.max("id").alias("most")).collect()
    heads = sorted(heads, key=lambda r: r["part"])
    return [r["least"] for r in heads[1:]], [r["most"] for r in heads] or [None]


def range_of(key: str, edges: list[int]) -> Column:
    """The number of ``edges`` that are ``key`` or less, in two steps: among every n-th edge, then between two of those."""
    size = max(1, math.isqrt(len(edges)))
    blocks = [edges[i : i + size] for i in range(0, len(edges), size)]
    literal = lambda values, kind: f"from_json('{json.dumps(values)}', '{kind}')"
    at_most = f"size(filter({literal([b[0] for b in blocks], 'array<bigint>')}, e -> e <= `{key}`))"
    inside = f"size(filter(get({literal(blocks, 'array<array<bigint>>')}, t - 1), e -> e <= `{key}`))"
    return F.expr(f"transform(array({at_most}), t -> CASE WHEN t = 0 THEN 0 ELSE (t - 1) * {size} + {inside} END)[0]") if edges else F.lit(0)


def with_edits(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and the likenesses.

    A document's second half is replaced by as much of the beginning of the next
    document, or all of it. Documents are dealt once, by ranges of ids, and
    sorted inside a range; the last documents of a range are dealt to the next
    one as well, where its first ones find them.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(content), F.lit("")).alias("text"))
    edges, last = ranges(docs, "doc_id", RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = F.expr(f"get(from_json('{json.dumps(last)}', 'array<bigint>'), part)")
    own, guest = F.struct("part", F.lit(0).alias("guest")), F.struct(F.pmod(F.col("part") + 1, F.lit(len(last))).alias("part"), F.lit(1).alias("guest"))
    placed = docs.withColumn("part", range_of("doc_id", edges)).withColumn("at", F.explode(F.when(ends.eqNullSafe(F.col("doc_id")), F.array(own, guest)).otherwise(F.array(own))))
    dealt = placed.select("at.part", "at.guest", "doc_id", "text").repartition("part").withColumn("_words", words_of(F.col("text")))
    marked = dealt.withColumn("f", winnowed("_words", k, window)).drop("_words").withColumn("fh", hashes_of("f"))
    # guests come first; of texts of one id the smallest is next to the following id
    order = Window.partitionBy("part").orderBy(F.desc("guest"), F.asc_nulls_first("doc_id"), F.desc("text"))
    before = F.lag(F.struct("guest", "doc_id", "text", "fh")).over(order)
    changed = (F.col("before.guest") != F.col("guest")) | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id"))
    follow = F.last(F.when(changed, F.col("before")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = marked.withColumn("before", before).withColumn("next", follow).filter("guest = 0")
    edited = joined.select(
        "doc_id", "text", "f", "fh", F.col("next.fh").alias("next_hashes"),
        F.expr("concat(substring(text, 1, CAST(length(text) - length(text) div 2 AS INT)), substring(next.text, 1, CAST(length(text) div 2 AS INT)))").alias("edited"),
    )
    worded = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "f", "fh", "next_hashes", words_of(F.col("edited")).alias("_e"))
    hashed = worded.withColumn("e", winnowed("_e", k, window)).withColumn("eh", hashes_of("e"))
    return hashed.select(
        "doc_id", "n_chars", "edited_sha256", as_string("f").alias("fingerprint"), as_string("e").alias("edited_fingerprint"),
        likeness("fh", "eh").alias("near_edited"), likeness("fh", "next_hashes").alias("near_next"),
    )
