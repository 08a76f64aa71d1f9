"""The registered queries: each applies one operator to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tombolo.functions import bloom
from tombolo.functions.commands import HELP_TEXT, parsed, reply, rule
from tombolo.operators import changelog, replay, segments
from tombolo.plans import inputs
from tombolo.sources import frames
from tombolo.sources.shared import shared_folder
from tombolo.sources.store import Store
from tombolo.streaming import replay as streams


def kv_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.live(inputs.changes(spark, sf_dir))


def kv_latest_with_tombstones(spark, sf_dir):
    return changelog.latest(inputs.changes(spark, sf_dir))


def kv_tombstones(spark, sf_dir):
    return changelog.tombstones(inputs.changes(spark, sf_dir))


def _get(spark, sf_dir, key):
    asked = spark.range(1).select(F.lit("get").alias("op"), F.lit(key).alias("key"), F.lit(None).cast("string").alias("error"))
    found = changelog.get(inputs.changes(spark, sf_dir), key).withColumnRenamed("value", "found")
    return asked.join(found, "key", "left").withColumn("value", F.lit(None).cast("string")).select("key", reply(F.col("found")).alias("response"))


def kv_get_hit(spark, sf_dir):
    return _get(spark, sf_dir, inputs.HIT)


def kv_get_miss(spark, sf_dir):
    return _get(spark, sf_dir, inputs.MISS)


def kv_multi_get(spark, sf_dir):
    return changelog.multi_get(inputs.changes(spark, sf_dir), inputs.probes(spark, sf_dir))


def kv_contains(spark, sf_dir):
    return changelog.contains(inputs.changes(spark, sf_dir), inputs.probes(spark, sf_dir))


def kv_delete_if_present(spark, sf_dir):
    return changelog.delete_if_present(inputs.changes(spark, sf_dir), inputs.probes(spark, sf_dir))


def kv_range_scan(spark, sf_dir):
    return changelog.range_scan(inputs.changes(spark, sf_dir), "user-1", "user-5")


def kv_as_of(spark, sf_dir):
    return changelog.as_of(inputs.changes(spark, sf_dir), 500)


def kv_stats(spark, sf_dir):
    return changelog.stats(inputs.changes(spark, sf_dir))


def kv_memtable_size(spark, sf_dir):
    rows = changelog.latest(inputs.changes(spark, sf_dir))
    return rows.groupBy("op").agg(F.sum(changelog.entry_size()).alias("tracked_bytes"), F.count(F.lit(1)).alias("n_keys"))


def kv_wal_replay_idempotent(spark, sf_dir):
    rows = inputs.changes(spark, sf_dir)
    return changelog.latest(changelog.union_replayed(rows, rows.filter("seq % 10 < 4")))


def kv_parse(spark, sf_dir):
    return parsed(inputs.lines(spark, sf_dir)).select("seq", "op", "key", "value", "error")


def kv_replay(spark, sf_dir):
    return replay.replayed(inputs.commands(spark, sf_dir)).select("seq", "response")


def kv_replay_sessions(spark, sf_dir):
    return replay.run_script(inputs.lines(spark, sf_dir)).select("session", "seq", "response")


def kv_effects(spark, sf_dir):
    return replay.effects(replay.replayed(inputs.commands(spark, sf_dir)))


def _segments(spark, sf_dir):
    return segments.flushed(inputs.changes(spark, sf_dir), segments.by_count(inputs.SEGMENT_ROWS))


def kv_flush_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def kv_segment_summaries(spark, sf_dir):
    return segments.summaries(_segments(spark, sf_dir))


def kv_layered_get(spark, sf_dir):
    return segments.layered(_segments(spark, sf_dir))


def kv_compact(spark, sf_dir):
    return segments.compacted(_segments(spark, sf_dir))


def kv_compact_stats(spark, sf_dir):
    return segments.compaction_stats(_segments(spark, sf_dir))


def kv_shadowed_versions(spark, sf_dir):
    return segments.shadowed(_segments(spark, sf_dir))


def kv_flush_points(spark, sf_dir):
    return segments.flush_points(inputs.changes(spark, sf_dir), 1000, 8, bloom.portable_hashes(F.col("key"))[0])


def _bits(spark, sf_dir):
    return bloom.build(_segments(spark, sf_dir), hashes=bloom.portable_hashes)


def kv_bloom_bits(spark, sf_dir):
    return _bits(spark, sf_dir)


def _sizes(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("segment_id").agg(bloom.size_of(F.count(F.lit(1))).alias("bit_count"))


def kv_filter_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir).withColumn("bytes", bloom.byte_size(F.col("bit_count")))


def kv_bloom_probe(spark, sf_dir):
    sizes = [tuple(r) for r in _sizes(spark, sf_dir).collect()]  # a store has them in its manifest
    return bloom.probe_all(_segments(spark, sf_dir), inputs.probes(spark, sf_dir), sizes, hashes=bloom.portable_hashes)


def kv_bloom_rates(spark, sf_dir):
    """One row: keys in the filter of all users that it denies, and whether it takes few of the other probes for users."""
    keys = inputs.changes(spark, sf_dir).select(F.lit(0).cast("long").alias("segment_id"), "key").distinct()
    asked = bloom.all_pairs(inputs.probes(spark, sf_dir).union(keys.select("key")), [(0, keys.count() * bloom.BITS_PER_KEY)])
    found = bloom.probe(bloom.bitmaps(bloom.build(keys)), asked).join(keys.withColumn("there", F.lit(True)), ["segment_id", "key"], "left")
    wrong = F.count(F.when(F.col("there") & ~F.col("may_contain"), 1))
    taken, absent = F.count(F.when(F.col("there").isNull() & F.col("may_contain"), 1)), F.count(F.when(F.col("there").isNull(), 1))
    return found.agg(wrong.alias("false_negatives"), (taken <= 0.03 * absent).alias("few_false_positives"))


def kv_checksum_recovery(spark, sf_dir):
    payload = F.concat_ws(" ", "op", "key", F.coalesce("value", F.lit("")))
    stored = inputs.changes(spark, sf_dir).withColumn("checksum", F.when(F.col("seq") % 97 == 13, F.lit("damaged")).otherwise(F.md5(payload.cast("binary"))))
    return changelog.live(stored.filter(F.col("checksum") == F.md5(payload.cast("binary"))))


def _files(spark, sf_dir, torn=0):
    """(path, content): frames in files of a bounded number of changes, every 97th with a byte of its payload damaged, the last bytes of each file torn off."""
    framed = frames.encoded(inputs.changes(spark, sf_dir))
    broken = F.expr("overlay(frame PLACING X'58' FROM 12 FOR 1)")
    damaged = framed.withColumn("frame", F.when(F.col("seq") % 97 == 13, broken).otherwise(F.col("frame")))
    grouped = damaged.groupBy(F.floor(F.col("seq") / inputs.SEGMENT_ROWS).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("all"))
    whole = grouped.select("path", F.expr("unhex(array_join(transform(all, x -> hex(x.frame)), ''))").alias("content"))
    return whole.select("path", F.expr(f"substring(content, 1, octet_length(content) - {torn})").alias("content"))


def kv_frames_roundtrip(spark, sf_dir):
    """What is read back of files with damaged frames."""
    return frames.read(_files(spark, sf_dir)).select("path", "op", "key", "value")


def kv_frames_status(spark, sf_dir):
    """(path, status, n): whole frames, and places where reading broke off, in files whose last frame is torn."""
    return frames.read(_files(spark, sf_dir, 3), report=True).groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


def kv_frames_non_empty(spark, sf_dir):
    files = _files(spark, sf_dir)
    torn = files.select(F.concat(F.lit("torn-"), "path").alias("path"), F.expr("substring(content, 1, 20)").alias("content"))
    return frames.non_empty(files.union(torn))


def kv_help(spark, sf_dir):
    return spark.range(1).select(rule().alias("rule"), F.lit(HELP_TEXT).alias("help"))


def _event_stream(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def kv_stream_replay(spark, sf_dir):
    out = shared_folder(spark, "stream")
    streams.run_available(streams.replayed(inputs.commands_of(_event_stream(spark, sf_dir))), f"{out}/replies", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/replies").select("seq", "response")


def kv_stream_restart(spark, sf_dir):
    """The same in two runs, the second of which starts with the state that the first has left."""
    out, events = shared_folder(spark, "stream"), inputs.table(spark, sf_dir, "events")
    middle = events.agg(F.avg("event_id")).first()[0]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.filter(part).write.mode("append").parquet(f"{out}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/events")
        streams.run_available(streams.replayed(inputs.commands_of(stream)), f"{out}/replies", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/replies").select("seq", "response")


def kv_stream_into_store(spark, sf_dir):
    """A stream of lines executed on a store, and what is visible then."""
    out = shared_folder(spark, "stream")
    store = Store(spark, f"{out}/store")
    streams.into_store(inputs.lines_of(_event_stream(spark, sf_dir)), store, f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    store.refresh()
    return store.live()


def kv_store_script(spark, sf_dir):
    """The script run on a store in three parts, with a flush after each and a merge; what is visible then.

    ``quit`` ends its session; who types on after it has a new one. A quit is the last line of its 1231.
    """
    store = Store(spark, shared_folder(spark, "store"))
    lines = inputs.lines(spark, sf_dir).withColumn("session", F.concat_ws("#", "session", F.floor((F.col("seq") - 8) / 1231)))
    for part in range(3):
        store.execute(lines.filter(F.floor(F.col("seq") / 400) % 3 == part))
        store.flush()
    store.compact()
    return store.live()


def kv_store_truncated(spark, sf_dir):
    """Users are flushed, orders stay in the log, which opening the store anew with ``truncate`` drops; what is visible then."""
    path = shared_folder(spark, "store")
    store = Store(spark, path)
    store.append(inputs.changes(spark, sf_dir))
    store.flush()
    store.append(inputs.orders(spark, sf_dir))
    return Store(spark, path, truncate=True).live()


def kv_store_maybe_flush(spark, sf_dir):
    """(flush_bytes, flushed, segments, wal_bytes): all changes appended to stores of a small memtable and of the usual one."""
    rows = []
    for most in (1000, segments.FLUSH_BYTES):
        store = Store(spark, shared_folder(spark, "store"), flush_bytes=most)
        store.append(inputs.changes(spark, sf_dir))
        rows.append((most, store.maybe_flush(), len(store.manifest.segments), store.tracked_bytes()))
    return spark.createDataFrame(rows, "flush_bytes long, flushed boolean, segments long, wal_bytes long")


def kv_store_tenth_flush(spark, sf_dir):
    """(flush_no, segments, n_live) after each of ten flushes with a tenth of the changes; the tenth merges all segments."""
    store, rows, changes = Store(spark, shared_folder(spark, "store")), [], inputs.changes(spark, sf_dir)
    for part in range(10):
        store.append(changes.filter(F.floor(F.col("seq") / 100) % 10 == part))
        store.flush()
        rows.append((store.manifest.flush_no, len(store.manifest.segments), store.live().count()))
    return spark.createDataFrame(rows, "flush_no long, segments long, n_live long")


def kv_orders_live(spark, sf_dir):
    return changelog.live(inputs.orders(spark, sf_dir))


def kv_conversations_latest(spark, sf_dir):
    return changelog.latest(inputs.conversations(spark, sf_dir))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("kv_")}
