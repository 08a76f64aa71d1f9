import random
import socket
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tombolo.functions import bloom
from tombolo.functions.commands import HELP_TEXT, parsed
from tombolo.operators import changelog, replay, segments
from tombolo.plans import oracle, queries
from tombolo.schema import CHANGE
from tombolo.sources import frames, lines, server
from tombolo.sources.store import Conflict, Store
from tombolo.streaming import replay as streams

SF = "/root/testdata/sf0.001"


def answers(spark, script):
    return [r["response"] for r in replay.run_script(lines.from_list(spark, script)).orderBy("seq").collect()]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("events", "customer", "orders", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_replies(spark):
    missing, many = "Error: missing required arguments", "Error: too many arguments"
    assert answers(spark, ["set a 1", "get a", "s a 2", "G a", "del a", "get a", "d a", "DELETE b"]) == ["a => 1", "a => 1", "a => 2", "a => 2", "a deleted", "a not found", "a not found", "b not found"]
    assert answers(spark, ["", "set", "set a", "get", "delete", "  \t "]) == [missing] * 6
    assert answers(spark, ["set a b c", "get a b", "delete a b"]) == [many] * 3
    assert answers(spark, ["invalid", "help", "h me"]) == ["Error: unrecognized command", HELP_TEXT, HELP_TEXT]
    assert answers(spark, ["set a 1", "Quit now", "get a"]) == ["a => 1", None]
    assert answers(spark, ["set Key　V", "get key", "GET Key"]) == ["Key => V", "key not found", "Key => V"]


def test_sessions_share_keys_and_end_alone(spark):
    rows = [("x", 0, "set a 1"), ("y", 1, "get a"), ("x", 2, "q"), ("y", 3, "set a 2"), ("x", 4, "get a"), ("y", 5, "get a")]
    got = replay.run_script(spark.createDataFrame(rows, "session string, seq long, line string")).orderBy("seq").collect()
    assert [(r["seq"], r["response"]) for r in got] == [(0, "a => 1"), (1, "a => 1"), (2, None), (3, "a => 2"), (5, "a => 2")]


def random_script(seed, n=300):
    rng = random.Random(seed)
    verbs = lambda: rng.choice(["set k{} {}", "s k{} {}", "get k{}", "del k{}", "bad k{}", "help"])
    return [verbs().format(rng.randrange(12), rng.randrange(99)) for _ in range(n)]


def model(script):
    store, out = {}, []
    for line in script:
        w = line.split()
        if w[0] in ("set", "s"):
            store[w[1]] = w[2]
            out.append(f"{w[1]} => {w[2]}")
        elif w[0] == "get":
            out.append(f"{w[1]} => {store[w[1]]}" if w[1] in store else f"{w[1]} not found")
        elif w[0] == "del":
            out.append(f"{w[1]} deleted" if w[1] in store else f"{w[1]} not found")
            store.pop(w[1], None)
        else:
            out.append(HELP_TEXT if w[0] == "help" else "Error: unrecognized command")
    return out, store


def test_random_script_against_a_dictionary(spark):
    script = random_script(4)
    assert answers(spark, script) == model(script)[0]


def changes(spark, *rows):
    return spark.createDataFrame([(i, *r, *([None] * (3 - len(r)))) for i, r in enumerate(rows)], CHANGE)


def test_views_of_a_changelog(spark):
    c = changes(spark, ("set", "b", "1"), ("set", "a", "2"), ("delete", "b"), ("set", "", "é"), ("delete", "z"), ("set", "a", "3"))
    assert {tuple(r) for r in changelog.live(c).collect()} == {("a", "3"), ("", "é")}
    assert {r["key"] for r in changelog.tombstones(c).collect()} == {"b", "z"}
    assert changelog.get(c, "b").count() == 0
    assert {tuple(r) for r in changelog.as_of(c, 1).collect()} == {("b", "1"), ("a", "2")}
    assert sorted(r["key"] for r in changelog.delete_if_present(c, c).collect()) == ["", "a"]
    s = changelog.stats(c).first()
    assert (s["n_changes"], s["n_keys"], s["n_live"], s["n_tombstones"], s["tracked_bytes"]) == (6, 4, 2, 2, (20 + 3) + (20 + 2) + (12 + 2) + (12 + 2))
    assert changelog.stats(c.limit(0)).first()["is_empty"]


def test_segments_and_merge(spark):
    c = changes(spark, ("set", "a", "1"), ("set", "b", "1"), ("set", "a", "2"), ("set", "c", "1"), ("delete", "b"), ("set", "a", "3"))
    s = segments.flushed(c, segments.by_count(2))
    assert {(r["key"], r["segment_id"], r["op"]) for r in segments.layered(s).collect()} == {("a", 2, "set"), ("b", 2, "delete"), ("c", 1, "set")}
    assert {(r["key"], r["value"]) for r in segments.compacted(s).collect()} == {("a", "3"), ("c", "1")}
    assert segments.compaction_stats(s).first().asDict() == {"segments_in": 3, "rows_in": 6, "rows_out": 2, "versions_dropped": 3, "tombstones_dropped": 1}


@pytest.mark.parametrize("shards", [1, 3])
def test_flush_points_against_a_dictionary(spark, shards):
    rng = random.Random(1)
    rows = [("set", f"k{rng.randrange(40)}", "v" * rng.randrange(30)) for _ in range(500)]
    frame = changes(spark, *rows).repartition(4)
    shard_of = {r["key"]: r["s"] for r in frame.selectExpr("key", f"CAST(pmod(xxhash64(key), {shards}) AS INT) AS s").collect()}
    want = []
    for shard in range(shards):
        held, number = {}, 0
        for seq, (_, key, value) in enumerate(rows):
            if shard_of[key] == shard:
                held[key] = 20 + 2 * len(key) + len(value)
                if sum(held.values()) > 900:
                    number += 1
                    want.append((shard, number, seq, sum(held.values())))
                    held = {}
    assert sorted(tuple(r) for r in segments.flush_points(frame, 900, shards).collect()) == sorted(want)


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(150).selectExpr("0L AS segment_id", "concat('k', id) AS key")
    asked = bloom.all_pairs(spark.range(5150).selectExpr("concat('k', id) AS key"), [(0, 1500), (1, 0)])
    got = {(r["segment_id"], r["key"]): r["may_contain"] for r in bloom.probe(bloom.bitmaps(bloom.build(keys)), asked).collect()}
    assert all(got[0, f"k{i}"] for i in range(150)) and all(got[1, f"k{i}"] for i in range(5150))
    assert sum(got[0, f"k{i}"] for i in range(150, 5150)) < 100
    assert spark.range(1).select(bloom.byte_size(bloom.size_of(parsed_lit(3)))).first()[0] == 4


def test_bloom_filters_of_several_blocks_and_too_many_bits(spark, monkeypatch):
    monkeypatch.setattr(bloom, "_BLOCK_BITS", 7)
    monkeypatch.setattr(bloom, "BLOCK", 128)
    keys = spark.range(300).selectExpr("id % 2 AS segment_id", "concat('k', id) AS key")
    bits = bloom.build(keys)
    set_bits = {(r["segment_id"], r["position"]) for r in bits.collect()}
    asked = bloom.all_pairs(spark.range(2000).selectExpr("concat('k', id) AS key"), [(0, 1500), (1, 1500)])
    places = asked.select("segment_id", "key", bloom.positions(*bloom.fast_hashes(F.col("key")), F.col("bit_count")).alias("p")).collect()
    want = {(r["segment_id"], r["key"]): all((r["segment_id"], p) in set_bits for p in r["p"]) for r in places}
    assert {(r["segment_id"], r["key"]): r["may_contain"] for r in bloom.probe(bloom.bitmaps(bits), asked).collect()} == want
    with pytest.raises(Exception, match="overflow"):
        spark.range(1).select(bloom.size_of(F.lit(1 << 62))).collect()


def test_all_pairs_are_probed_without_a_shuffle_of_pairs(spark, monkeypatch):
    for name, small in {"LANE": 3, "PACKED": 16, "PART_WORDS": 300, "TASK_PAIRS": 1000, "BLOCK": 256}.items():
        monkeypatch.setattr(bloom, name, small)
    monkeypatch.setattr(bloom, "_BLOCK_BITS", 8)
    keys = spark.range(230).selectExpr("CASE WHEN id < 160 THEN id % 8 ELSE 8 + id % 2 END AS segment_id", "concat('k', id) AS key").union(spark.createDataFrame([(None, "k1"), (11, None)], "segment_id long, key string"))
    sizes = [(i, 200) for i in range(8)] + [(8, 350), (9, 350), (10, 0), (11, 10), (None, 10)]
    asked = spark.range(900).selectExpr("CASE WHEN id < 899 THEN concat('k', id % 300) END AS key")
    held = {}
    for r in keys.collect():
        held.setdefault(r["segment_id"], []).append(r["key"])
    hashes = {r["key"]: (r["a"], r["b"]) for r in asked.distinct().select("key", *[h.alias(n) for n, h in zip("ab", bloom.fast_hashes(F.col("key")), strict=True)]).collect()}
    places = lambda key, n: {(hashes[key][0] % n + i * (hashes[key][1] % n)) % n for i in range(bloom.HASHES)}
    want = []
    for i, n in sizes[:-1]:
        bits = set().union(*(places(k, n) for k in held.get(i, []))) if n else set()
        want += [(i, k, not n or places(k, n) <= bits) for k in hashes]
    got = bloom.probe_all(keys, asked, sizes)
    assert got.columns == ["segment_id", "key", "may_contain"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bloom.probe_all(keys, asked, []).collect() == []


def test_bloom_query_shuffles_no_pairs(spark):
    plan = queries.QUERIES["kv_bloom_probe"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    above = plan.partition("CartesianProduct")
    assert above[1] and "Aggregate" not in above[0] and "Join" not in above[0]


def parsed_lit(n):
    return F.lit(n)


def test_frames_and_their_damage(spark):
    frame = lambda *e: frames.encode(frames.entry_payload(*e))
    a, b = frame("set", "city", "Rom"), frame("delete", "bird", None)
    good = lambda content: [(s, p) for _, s, p in frames.scan(content)]
    assert len(good(a + b)) == 2 and len(good(b"\xff" * 5 + a)) == 1 and good(b"") == []
    flipped = a[:12] + bytes([a[12] ^ 1]) + a[13:]
    assert [p for _, p in good(flipped + b)] == [b[10:]]
    assert len(good(a[:-3] + b)) == 1 and len(good(a + b[:-1])) == 1
    assert frames.has_at_least_one(b"xx" + a) and not frames.has_at_least_one(a[:-1]) and not frames.has_at_least_one(b"")
    assert frames.status_at(b"abcde", 0)[0] == "not_enough_bytes"
    assert frames.status_at(b"\0\0" + a[2:], 0)[0] == "magic_mismatch"
    assert frames.status_at(a[:2] + bytes(4) + a[6:], 0)[0] == "checksum_mismatch"
    assert frames.status_at(frames.encode(b"garbage"), 0)[0] == "parse_error"
    files = spark.createDataFrame([("f", flipped + b), ("g", None)], "path string, content binary")
    assert [(r["status"], r["key"]) for r in frames.read(files, report=True).orderBy("offset").collect()] == [("checksum_mismatch", None), ("ok", "bird")]


def test_store_layers_reopening_and_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = Store(spark, path, compact_every=3)
    s.set("a", "1")
    s.flush()
    s.write(("set", "b", "1"), ("set", "a", "2"))
    s.flush()
    assert s.get("a") == "2" and not s.contains("d") and len(s.manifest.segments) == 2
    assert not s.delete_if_present("d") and s.delete_if_present("a")
    assert Store(spark, path).get("a") is None
    old = Store(spark, path)
    s.flush()  # the third flush merges
    assert len(s.manifest.segments) == 1 and [r["key"] for r in s.segments().collect()] == ["b"]
    with pytest.raises(Conflict):
        old.set("x", "1")
    s.set("c", "1")
    t = Store(spark, path, truncate=True)
    assert t.get("c") is None and t.get("b") == "1"
    t.write(("delete", "b"))
    t.flush()
    t.compact()
    assert t.manifest.segments == () and t.live().count() == 0
    assert not t.maybe_flush() and t.stats()["n_keys"] == 0


def test_merges_leave_open_views_alone_and_vacuum_takes_old_folders(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.set("a", "1")
    s.flush()
    view = s.live()
    s.set("b", "2")
    s.flush()
    s.compact()
    assert [tuple(r) for r in view.collect()] == [("a", "1")]
    assert s.vacuum() == [] and [tuple(r) for r in view.collect()] == [("a", "1")]
    assert sorted(n.split("/")[0] for n in s.vacuum(0)) == ["segments", "segments", "wal", "wal"]
    assert sorted(tuple(r) for r in s.live().collect()) == [("a", "1"), ("b", "2")]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    first, second = ["set a 1", "del a", "get a"], ["get a", "set a 2"]
    for number, script in ((0, first), (0, first), (1, second), (0, first), (1, second)):
        replies = [r["response"] for r in s.execute(lines.from_list(spark, script), ("x", number)).orderBy("seq").collect()]
        assert replies == model(["s" + x[1:] if x.startswith("set") else x for x in script])[0]
        s = Store(spark, s.path)
    assert s.manifest.batches == (("x", 1),) and s.changes().count() == 3 and s.get("a") == "2"
    s.execute(lines.from_list(spark, ["help"]), ("x", 2))
    assert s.manifest.batches == (("x", 2),)


def test_line_server_shares_a_store_between_clients(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        server.address_of(spark)
    spark.conf.set("tombolo.address", "127.0.0.1")
    spark.conf.set("tombolo.port", "0")
    front = server.LineServer(s, server.address_of(spark))
    front.start()
    try:
        one, two = (socket.create_connection(front.address) for _ in range(2))
        told = lambda c: c.makefile("rb")
        a, b = told(one), told(two)

        def run(*typed):
            n = front._seq
            for c, line in typed:
                c.sendall(line.encode() + b"\n")
                n += 1
                while front._seq < n:
                    time.sleep(0.01)
            front.step()

        run((one, "set a 1"), (two, "get a"), (two, "nonsense"), (one, ""))
        assert [a.readline(), a.readline()] == [b"a => 1\n", b"Error: missing required arguments\n"]
        assert [b.readline(), b.readline()] == [b"a => 1\n", b"Error: unrecognized command\n"]
        run((two, "del a"), (two, "quit"), (one, "get a"))
        assert b.read() == b"a deleted\n" and a.readline() == b"a not found\n"
        a.close()
        one.close()
        for _ in range(500):
            front.step()
            if not front._ends:
                break
            time.sleep(0.01)
        assert not front._ends and s.live().count() == 0
    finally:
        front.stop()
        spark.conf.unset("tombolo.address")
        spark.conf.unset("tombolo.port")


def test_store_runs_a_script_and_flushes_when_large(spark, tmp_path):
    script = random_script(9, 120)
    s = Store(spark, f"file://{tmp_path}/store", flush_bytes=50)
    replies = [r["response"] for r in s.execute(lines.from_list(spark, script[:60])).orderBy("seq").collect()]
    assert s.manifest.flush_no == 1
    replies += [r["response"] for r in s.execute(lines.from_list(spark, script[60:])).orderBy("seq").collect()]
    want, left = model(script)
    assert replies == want and {r["key"]: r["value"] for r in s.live().collect()} == left


def test_stream_keeps_state_over_batches_and_restarts(spark, tmp_path):
    script = random_script(11, 90)
    source = f"{tmp_path}/in"
    for part in range(3):
        rows = [("x", i, script[i]) for i in range(part * 30, part * 30 + 30)]
        spark.createDataFrame(rows, "session string, seq long, line string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session string, seq long, line string").parquet(source)
        streams.run_available(streams.replayed(parsed(stream)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [r["response"] for r in got] == model(script)[0]


def test_text_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("set a 1\n\nget a\r\n")
    assert [r["line"] for r in lines.from_file(spark, f"file://{tmp_path}/a.txt").orderBy("seq").collect()] == ["set a 1", "", "get a"]
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(ValueError):
        lines.from_file(spark, f"file://{tmp_path}/*.txt")


def test_store_script_runs_every_line(spark, monkeypatch):
    seen, execute = [], Store.execute

    def recording(self, lines):
        seen.extend(lines.select("seq", "line").collect())
        out = execute(self, lines)
        seen_replies.extend(r["seq"] for r in out.select("seq").collect())
        return out

    seen_replies = []
    monkeypatch.setattr(Store, "execute", recording)
    queries.kv_store_script(spark, SF)
    whole = sorted(r["seq"] for r in queries.inputs.lines(spark, SF).select("seq").collect())
    assert sorted(r["seq"] for r in seen) == whole == sorted(seen_replies)
    assert any(r["line"] == "quit now" for r in seen)
