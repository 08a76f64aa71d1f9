"""Bloom filters in logical form: sets of bit positions, and bitmaps of them.

Parquet's own filters skip row groups; these columns make the same test
visible and portable, ten bits a key and seven positions by double hashing.
Every key of a segment goes in, tombstones too, or a tombstone could be skipped
and an older value come back.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 10, 7
#: Bits of a filter that lie in one row of its bitmap, and the most that a filter may have.
_BLOCK_BITS, MOST_BITS = 16, (1 << 32) - 1
BLOCK = 1 << _BLOCK_BITS
#: Filters of a lane at most; keys of a packed row, words of a part of the lanes and pairs of a task, about.
LANE, PACKED, PART_WORDS, TASK_PAIRS = 64, 1 << 8, 1 << 20, 1 << 25


def size_of(keys: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    """Bits of a filter for that many keys; an error where they are more than a filter may have."""
    bits = F.try_multiply(keys.cast("long"), F.lit(bits_per_key).cast("long"))
    return F.when(bits <= MOST_BITS, bits).otherwise(F.raise_error(F.lit("bloom filter bit count overflow")).cast("long"))


def byte_size(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def fast_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds."""
    return F.xxhash64(key, F.lit(0)), F.xxhash64(key, F.lit(1))


def portable_hashes(key: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers from MD5, the same in any SQL engine."""
    digest = F.md5(key.cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return part(1), part(9)


def positions(one: Column, two: Column, bits: Column, k: int = HASHES) -> Column:
    """The ``k`` positions of a key with hashes ``one`` and ``two``, (one + i two) mod bits; none where there are no bits.

    Both hashes are reduced first, so that no product leaves 64 bits.
    """
    # an array of expressions is compiled, a function over a sequence is not
    found = F.array(*_places(one, two, F.nullif(bits, F.lit(0)), k))
    return F.when(bits > 0, found).otherwise(F.array().cast("array<bigint>"))


def _places(one: Column, two: Column, bits: Column, k: int = HASHES) -> list[Column]:
    one, two = F.pmod(one, bits), F.pmod(two, bits)
    return [F.pmod(one + i * two, bits) for i in range(k)]


def build(keys: DataFrame, by: str = "segment_id", key: str = "key", hashes=fast_hashes, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(by, position, bit_count): the set bits of each group's filter, one row per bit.

    A filter is a set of rows and not an array, so that no filter has to fit in
    one row or task.
    """
    one, two = hashes(F.col(key))
    # hashes go through the aggregate, or the optimizer would put them into the expression of each position
    distinct = keys.select(by, key, one.alias("_one"), two.alias("_two")).distinct()
    sizes = distinct.groupBy(by).agg(size_of(F.count(F.lit(1)), bits_per_key).alias("bit_count"))
    sized = distinct.join(sizes, by)
    return sized.select(by, "bit_count", F.explode(positions(F.col("_one"), F.col("_two"), F.col("bit_count"))).alias("position")).distinct()


def bitmaps(bits: DataFrame, by: str = "segment_id") -> DataFrame:
    """(by, block, words): filters as bitmaps, a row for each ``BLOCK`` bits, a word for each 64; rows have a bounded size."""
    one = F.expr("shiftleft(1L, CAST(position % 64 AS INT))")
    set_bits = bits.select(by, F.floor(F.col("position") / 64).alias("word"), one.alias("bits"))
    words = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bit_count") - 1) / 64)))
    every = bits.select(by, "bit_count").distinct().select(by, words.alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = set_bits.unionByName(every).groupBy(by, "word").agg(F.bit_or("bits").alias("bits"))
    block = F.floor(F.col("word") / (BLOCK // 64)).alias("block")
    return filled.groupBy(by, block).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def probe(maps: DataFrame, asked: DataFrame, by: str = "segment_id", key: str = "key") -> DataFrame:
    """(by, key, may_contain) of the pairs ``asked`` (by, key, bit_count, _one, _two), which have their key's hashes; an empty filter may contain anything.

    A pair meets the blocks of its filter that its positions lie in by an
    equi-join, and tests all its bits there; one small filter is one block.
    """
    wanted = asked.select(by, key, positions(F.col("_one"), F.col("_two"), F.col("bit_count")).alias("_found"))
    block_of = lambda p: F.shiftright(p, _BLOCK_BITS)
    place = [F.get("_found", F.lit(i)) for i in range(HASHES)]
    placed = wanted.withColumn("block", F.explode_outer(F.when(F.size("_found") > 0, F.array_distinct(F.array(*map(block_of, place))))))
    met = placed.join(maps, [by, "block"], "left")
    held = F.col("words").isNull()
    bits = F.lit(True)
    for p in place:
        word = F.get("words", F.shiftright(p.bitwiseAND(BLOCK - 1), 6).cast("int"))
        bits &= (block_of(p) != F.col("block")) | (F.call_function("getbit", word, p.bitwiseAND(63).cast("int")) == 1)
    held |= F.coalesce(bits, F.lit(True))
    return met.groupBy(by, key).agg(F.bool_and(held).alias("may_contain"))


def all_pairs(keys: DataFrame, sizes: list[tuple[int, int]], by: str = "segment_id", key: str = "key", hashes=fast_hashes) -> DataFrame:
    """What ``probe`` asks: every distinct key for every filter of ``sizes`` (by, bit_count), which is a manifest's list of segments."""
    one, two = hashes(F.col(key))
    listed = F.from_json(F.lit(json.dumps([{"i": i, "n": n} for i, n in sizes])), "array<struct<i:bigint,n:bigint>>")
    pairs = keys.select(key, one.alias("_one"), two.alias("_two")).distinct().withColumn("_f", F.explode(listed))
    return pairs.select(F.col("_f.i").alias(by), key, F.col("_f.n").alias("bit_count"), "_one", "_two")


def lanes(keys: DataFrame, sizes: list[tuple[int, int]], by: str = "segment_id", key: str = "key", hashes=fast_hashes) -> tuple[DataFrame, int]:
    """(ids, bit_count, words), and in how many parts: filters of one size side by side, up to ``LANE`` of them; bit i of ``words[p]`` is bit p of the filter of ``ids[i]``.

    A key's positions depend on the size alone, so seven words answer it for all
    filters of a lane. Each of ``sizes`` (by, bit_count) has 1 to ``BLOCK`` bits.
    """
    same = {}
    for i, n in sorted(sizes):
        same.setdefault(n, []).append(i)
    listed = [{"n": n, "ids": ids[at : at + LANE]} for n, ids in sorted(same.items()) for at in range(0, len(ids), LANE)]
    listed = [x | {"lane": at} for at, x in enumerate(listed)]
    rows = F.explode(F.from_json(F.lit(json.dumps(listed)), "array<struct<lane:int,n:bigint,ids:array<bigint>>>"))
    every = keys.sparkSession.range(1).select(rows.alias("_l")).select("_l.lane", "_l.ids", F.col("_l.n").alias("bit_count"))
    one, two = hashes(F.col(key))
    placed = keys.select(by, one.alias("_one"), two.alias("_two")).join(F.broadcast(every.select("lane", "bit_count", F.posexplode("ids").alias("_slot", by))), by)
    set_bits = placed.select("lane", F.explode(positions(F.col("_one"), F.col("_two"), F.col("bit_count"))).alias("position"), F.expr("shiftleft(1L, _slot)").alias("bits"))
    zero = F.lit(0).cast("long")
    blank = every.select("lane", F.explode(F.sequence(zero, F.col("bit_count") - 1)).alias("position"), zero.alias("bits"))
    filled = set_bits.filter("position IS NOT NULL").unionByName(blank).groupBy("lane", "position").agg(F.bit_or("bits").alias("bits"))
    parts = -(-sum(x["n"] for x in listed) // PART_WORDS)
    words = F.transform(F.array_sort(F.collect_list(F.struct("position", "bits"))), lambda x: x["bits"])
    found = filled.repartition(parts, "lane").groupBy("lane").agg(words.alias("words"))
    return found.join(F.broadcast(every), "lane").select("ids", "bit_count", "words"), parts


def probe_all(keys: DataFrame, asked: DataFrame, sizes: list[tuple[int, int]], by: str = "segment_id", key: str = "key", hashes=fast_hashes) -> DataFrame:
    """(by, key, may_contain): every distinct key of ``asked`` for every filter over ``keys``, whose ``sizes`` (by, bit_count) are a manifest's list of segments.

    Packed keys meet lanes of filters, part by part, and a pair becomes a row
    only as it is returned: keys and filters are shuffled, pairs are not. Filters
    of more than ``BLOCK`` bits, or of none, are asked by ``probe``.
    """
    sizes = [(i, n) for i, n in sizes if i is not None]
    small = [(i, n) for i, n in sizes if 0 < n <= BLOCK]
    large = [(i, n) for i, n in sizes if not 0 < n <= BLOCK]
    found = []
    if small:
        filters, parts = lanes(keys, small, by, key, hashes)
        n_keys = max(1, asked.count())
        rows, tasks = -(-n_keys // PACKED), -(-n_keys * len(small) // (TASK_PAIRS * parts))
        one, two = hashes(F.col(key))
        bucket = F.pmod(F.xxhash64(key), F.lit(rows)).alias("_bucket")
        # in a struct, as a set drops nulls
        packed = asked.groupBy(bucket).agg(F.collect_set(F.struct(F.col(key), one.alias("one"), two.alias("two"))).alias("_keys")).select("_keys").repartition(min(rows, tasks))
        met = packed.hint("shuffle_replicate_nl").crossJoin(filters).select("ids", "bit_count", "words", F.explode("_keys").alias("_k"))
        held = reduce(Column.bitwiseAND, [F.get("words", p.cast("int")) for p in _places(F.col("_k.one"), F.col("_k.two"), F.col("bit_count"))])
        lane = met.select("ids", F.col(f"_k.{key}").alias(key), F.coalesce(held, F.lit(-1).cast("long")).alias("_held")).select(key, "_held", F.posexplode("ids").alias("_slot", by))
        found.append(lane.select(by, key, (F.call_function("getbit", F.col("_held"), F.col("_slot")) == 1).alias("may_contain")))
    if large or not small:
        ids = [i for i, _ in large]
        found.append(probe(bitmaps(build(keys.filter(F.col(by).isin(ids)), by, key, hashes), by), all_pairs(asked, large, by, key, hashes), by, key))
    return reduce(DataFrame.unionByName, found)
