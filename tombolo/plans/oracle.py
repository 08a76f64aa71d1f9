"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tombolo.functions.commands import HELP_TEXT
from tombolo.plans.inputs import HIT, MISS, SEGMENT_ROWS

_COMMANDS = """cmd AS (SELECT (user_id % 8)::VARCHAR AS session, event_id AS seq, 'user-' || user_id AS key,
  CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'set' END AS op,
  CASE WHEN event_type NOT IN ('view', 'error') THEN event_type || '#' || event_id END AS value FROM events)"""
_CHANGES = _COMMANDS + ", c AS (SELECT seq, op, key, value FROM cmd WHERE op <> 'get')"
_LATEST = _CHANGES + ", l AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, max_by(coalesce(value, ''), seq) AS v FROM c GROUP BY key), latest AS (SELECT key, seq, op, CASE WHEN op = 'set' THEN v END AS value FROM l)"
_LIVE = _LATEST + ", live AS (SELECT key, value FROM latest WHERE op = 'set')"
#: Bytes of an entry: tag and lengths, the key twice, the value of a set.
_SIZE = "(12 + 2 * strlen(key) + coalesce(8 + strlen(value), 0))"
_PROBES = ", p AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer)"
_REPLY = """CASE WHEN error IS NOT NULL THEN 'Error: ' || error WHEN op = 'set' THEN key || ' => ' || value WHEN op = 'help' THEN '""" + HELP_TEXT + """'
  WHEN op = 'get' THEN coalesce(key || ' => ' || found, key || ' not found')
  WHEN op = 'delete' THEN CASE WHEN found IS NULL THEN key || ' not found' ELSE key || ' deleted' END END"""
_FOUND = """nullif(last_value(CASE WHEN op = 'set' THEN value WHEN op = 'delete' THEN '' END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"""
_VERB = lambda a, b, c: f"(CASE seq % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END)"
_LINES = _COMMANDS + f""", typed AS (SELECT *, CASE op WHEN 'get' THEN {_VERB('get', 'g', 'GET')} || ' ' || key WHEN 'delete' THEN {_VERB('del', 'd', 'DELETE')} || ' ' || key
  ELSE {_VERB('set', 's', 'SET')} || ' ' || key || ' ' || value END AS good FROM cmd),
lines AS (SELECT session, seq, CASE WHEN seq % 1231 = 7 THEN 'quit now' WHEN seq % 97 = 0 THEN '' WHEN seq % 97 = 1 THEN 'frobnicate x' WHEN seq % 97 = 2 THEN 'set onlykey'
  WHEN seq % 97 = 3 THEN 'get a b' WHEN seq % 97 = 4 THEN 'help' WHEN seq % 97 = 5 THEN chr(9) || '  ' || good || chr(12288) || ' ' ELSE good END AS line FROM typed),
split AS (SELECT *, list_filter(string_split_regex(line, '[\\s\\x{{3000}}]+'), lambda w: w <> '') AS w FROM lines),
verbs AS (SELECT *, CASE WHEN lower(w[1]) IN ('set', 's') THEN 'set' WHEN lower(w[1]) IN ('get', 'g') THEN 'get' WHEN lower(w[1]) IN ('delete', 'del', 'd') THEN 'delete'
  WHEN lower(w[1]) IN ('quit', 'q', 'exit') THEN 'quit' WHEN lower(w[1]) IN ('help', 'h') THEN 'help' END AS verb FROM split),
errs AS (SELECT *, CASE WHEN len(w) = 0 THEN 'missing required arguments' WHEN verb IS NULL THEN 'unrecognized command'
  WHEN len(w) < CASE verb WHEN 'set' THEN 3 WHEN 'get' THEN 2 WHEN 'delete' THEN 2 ELSE 0 END THEN 'missing required arguments'
  WHEN verb IN ('set', 'get', 'delete') AND len(w) > CASE verb WHEN 'set' THEN 3 ELSE 2 END THEN 'too many arguments' END AS error FROM verbs),
parsed AS (SELECT session, seq, CASE WHEN error IS NULL THEN verb END AS op, CASE WHEN error IS NULL AND verb IN ('set', 'get', 'delete') THEN w[2] END AS key,
  CASE WHEN error IS NULL AND verb = 'set' THEN w[3] END AS value, error FROM errs)"""
_SEGMENTS = _CHANGES + f""", g AS (SELECT seq // {SEGMENT_ROWS} AS segment_id, key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(coalesce(value, ''), seq) AS v FROM c GROUP BY ALL),
s AS (SELECT segment_id, seq, op, key, CASE WHEN op = 'set' THEN v END AS value FROM g)"""
_BITS = _SEGMENTS + """, z AS (SELECT segment_id, count(*) * 10 AS bit_count FROM s GROUP BY segment_id)"""
_POSITIONS = "list_transform(range(7), lambda i: (('0x' || substr(md5(key), 1, 8))::BIGINT % bit_count + i * (('0x' || substr(md5(key), 9, 8))::BIGINT % bit_count)) % bit_count)"


def _get(key: str) -> str:
    return f"WITH {_LIVE} SELECT '{key}' AS key, coalesce((SELECT key || ' => ' || value FROM live WHERE key = '{key}'), '{key} not found') AS response"


_REPLAY = f"WITH {_COMMANDS}, v AS (SELECT *, NULL AS error, {_FOUND} AS found FROM cmd) SELECT seq, {_REPLY} AS response FROM v"
_STORE = _LINES + """, ops AS (SELECT * FROM parsed WHERE seq % 1231 <> 7 AND op IN ('set', 'delete')),
  r AS (SELECT *, ((seq // 400) % 3) * 1000000000 + seq AS o FROM ops), w AS (SELECT key, arg_max(op, o) AS op, arg_max(coalesce(value, ''), o) AS value FROM r GROUP BY key)"""

SQL = {
    "kv_live": f"WITH {_LIVE} SELECT * FROM live",
    "kv_latest_with_tombstones": f"WITH {_LATEST} SELECT key, seq, op, value FROM latest",
    "kv_tombstones": f"WITH {_LATEST} SELECT key, seq FROM latest WHERE op = 'delete'",
    "kv_get_hit": _get(HIT),
    "kv_get_miss": _get(MISS),
    "kv_multi_get": f"WITH {_LIVE}{_PROBES} SELECT key, value FROM p LEFT JOIN live USING (key)",
    "kv_contains": f"WITH {_LIVE}{_PROBES} SELECT key, EXISTS (SELECT 1 FROM live WHERE live.key = p.key) AS present FROM p",
    "kv_delete_if_present": f"WITH {_LIVE}{_PROBES} SELECT key FROM p SEMI JOIN live USING (key)",
    "kv_range_scan": f"WITH {_LIVE} SELECT key, value FROM live WHERE key BETWEEN 'user-1' AND 'user-5' ORDER BY key",
    "kv_as_of": f"WITH {_CHANGES}, h AS (SELECT key, arg_max(op, seq) AS op, arg_max(coalesce(value, ''), seq) AS value FROM c WHERE seq <= 500 GROUP BY key) SELECT key, value FROM h WHERE op = 'set'",
    "kv_stats": f"""WITH {_LATEST} SELECT (SELECT count(*) FROM c) AS n_changes, count(*) AS n_keys, count(*) FILTER (op = 'set') AS n_live, count(*) FILTER (op = 'delete') AS n_tombstones,
      coalesce(sum({_SIZE}), 0)::BIGINT AS tracked_bytes, count(*) = 0 AS is_empty FROM latest""",
    "kv_memtable_size": f"WITH {_LATEST} SELECT op, sum({_SIZE})::BIGINT AS tracked_bytes, count(*) AS n_keys FROM latest GROUP BY op",
    "kv_wal_replay_idempotent": f"WITH {_LATEST} SELECT key, seq, op, value FROM latest",
    "kv_parse": f"WITH {_LINES} SELECT seq, op, key, value, error FROM parsed",
    "kv_replay": _REPLAY,
    "kv_replay_sessions": f"""WITH {_LINES}, e AS (SELECT session, min(seq) AS stop FROM parsed WHERE op = 'quit' GROUP BY session),
      k AS (SELECT parsed.* FROM parsed LEFT JOIN e USING (session) WHERE stop IS NULL OR seq <= stop), v AS (SELECT *, {_FOUND} AS found FROM k)
      SELECT session, seq, {_REPLY} AS response FROM v""",
    "kv_effects": f"WITH {_COMMANDS}, v AS (SELECT *, {_FOUND} AS found FROM cmd) SELECT seq, op, key, value FROM v WHERE op = 'set' OR op = 'delete' AND found IS NOT NULL",
    "kv_flush_segments": f"WITH {_SEGMENTS} SELECT * FROM s",
    "kv_segment_summaries": f"WITH {_SEGMENTS} SELECT segment_id, count(*) AS n_keys, count(*) FILTER (op = 'delete') AS n_tombstones, min(key) AS min_key, max(key) AS max_key FROM s GROUP BY segment_id ORDER BY segment_id DESC",
    "kv_layered_get": f"WITH {_SEGMENTS} SELECT key, segment_id, op, value FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment_id DESC) = 1",
    "kv_compact": f"WITH {_SEGMENTS}, w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT seq, op, key, value FROM w WHERE op = 'set'",
    "kv_compact_stats": f"""WITH {_SEGMENTS}, w AS (SELECT key, count(*) AS n, arg_max(op, seq) AS op FROM s GROUP BY key)
      SELECT (SELECT count(DISTINCT segment_id) FROM s) AS segments_in, sum(n)::BIGINT AS rows_in, count(*) FILTER (op = 'set') AS rows_out, sum(n - 1)::BIGINT AS versions_dropped, count(*) FILTER (op = 'delete') AS tombstones_dropped FROM w""",
    "kv_shadowed_versions": f"WITH {_SEGMENTS} SELECT segment_id, key, seq FROM s WHERE EXISTS (SELECT 1 FROM s n WHERE n.key = s.key AND n.segment_id > s.segment_id)",
    "kv_flush_points": f"""WITH RECURSIVE {_CHANGES}, z AS (SELECT (('0x' || substr(md5(key), 1, 8))::BIGINT % 8)::INTEGER AS shard, seq, key, {_SIZE}::BIGINT AS size FROM c),
      r AS (SELECT *, lag(seq) OVER w AS prev, lag(size) OVER w AS old FROM z WINDOW w AS (PARTITION BY key ORDER BY seq)),
      f AS (SELECT DISTINCT shard, 0::BIGINT AS flush_no, (-1)::BIGINT AS seq, 0::BIGINT AS tracked_bytes FROM r
        UNION ALL SELECT shard, flush_no + 1, min(seq), arg_min(total, seq)::BIGINT FROM (
          SELECT f.shard, f.flush_no, r.seq, sum(CASE WHEN prev > f.seq THEN size - old ELSE size END) OVER (PARTITION BY f.shard ORDER BY r.seq) AS total
          FROM f JOIN r ON r.shard = f.shard AND r.seq > f.seq) WHERE total > 1000 GROUP BY shard, flush_no)
      SELECT * FROM f WHERE flush_no > 0""",
    "kv_filter_sizes": f"WITH {_BITS} SELECT segment_id, bit_count, ceil(bit_count / 8)::BIGINT AS bytes FROM z",
    "kv_bloom_rates": "SELECT 0::BIGINT AS false_negatives, true AS few_false_positives",
    "kv_bloom_bits": f"WITH {_BITS} SELECT DISTINCT segment_id, bit_count, unnest({_POSITIONS}) AS position FROM s JOIN z USING (segment_id)",
    "kv_bloom_probe": f"""WITH {_BITS}{_PROBES}, b AS (SELECT segment_id, list(DISTINCT position) AS bits FROM (SELECT segment_id, unnest({_POSITIONS}) AS position FROM s JOIN z USING (segment_id)) GROUP BY segment_id)
      SELECT segment_id, key, list_has_all(bits, {_POSITIONS}) AS may_contain FROM p CROSS JOIN (SELECT * FROM z JOIN b USING (segment_id))""",
    "kv_checksum_recovery": f"WITH {_CHANGES}, h AS (SELECT key, arg_max(op, seq) AS op, arg_max(coalesce(value, ''), seq) AS value FROM c WHERE seq % 97 <> 13 GROUP BY key) SELECT key, value FROM h WHERE op = 'set'",
    "kv_frames_roundtrip": f"WITH {_CHANGES} SELECT (seq // {SEGMENT_ROWS})::VARCHAR AS path, op, key, value FROM c WHERE seq % 97 <> 13",
    "kv_frames_status": f"""WITH {_CHANGES}, p AS (SELECT (seq // {SEGMENT_ROWS})::VARCHAR AS path, seq, max(seq) OVER (PARTITION BY seq // {SEGMENT_ROWS}) AS last FROM c),
      s AS (SELECT path, seq, CASE WHEN seq = last THEN 'not_enough_bytes' WHEN seq % 97 = 13 THEN 'checksum_mismatch' ELSE 'ok' END AS status FROM p),
      q AS (SELECT *, lag(status, 1, 'ok') OVER (PARTITION BY path ORDER BY seq) AS before FROM s)
      SELECT path, status, count(*) AS n FROM q WHERE status = 'ok' OR before = 'ok' GROUP BY path, status""",
    "kv_frames_non_empty": f"""WITH {_CHANGES}, p AS (SELECT (seq // {SEGMENT_ROWS})::VARCHAR AS path, bool_or(seq % 97 <> 13) AS "any" FROM c GROUP BY 1)
      SELECT path, "any" FROM p UNION ALL SELECT 'torn-' || path, false FROM p""",
    "kv_help": f"SELECT repeat('-', 36) AS rule, '{HELP_TEXT}' AS help",
    "kv_stream_replay": _REPLAY,
    "kv_stream_restart": _REPLAY,
    "kv_stream_into_store": f"""WITH {_LINES}, e AS (SELECT session, min(seq) AS stop FROM parsed WHERE op = 'quit' GROUP BY session),
      k AS (SELECT parsed.* FROM parsed LEFT JOIN e USING (session) WHERE (stop IS NULL OR seq < stop) AND op IN ('set', 'delete')),
      h AS (SELECT key, arg_max(op, seq) AS op, arg_max(coalesce(value, ''), seq) AS value FROM k GROUP BY key) SELECT key, value FROM h WHERE op = 'set'""",
    "kv_store_truncated": f"WITH {_LIVE} SELECT * FROM live",
    "kv_store_maybe_flush": f"""WITH {_LATEST}, t AS (SELECT sum({_SIZE})::BIGINT AS n FROM latest), m AS (SELECT unnest([1000, 4194304]::BIGINT[]) AS flush_bytes)
      SELECT flush_bytes, n > flush_bytes AS flushed, (n > flush_bytes)::BIGINT AS segments, CASE WHEN n > flush_bytes THEN 0 ELSE n END AS wal_bytes FROM t, m""",
    "kv_store_tenth_flush": f"""WITH {_CHANGES}, p AS (SELECT *, (seq // 100) % 10 AS part FROM c), n AS (SELECT unnest(range(1, 11)) AS flush_no),
      h AS (SELECT flush_no, key, arg_max(op, part * 1000000000 + seq) AS op FROM n JOIN p ON part < flush_no GROUP BY ALL)
      SELECT flush_no, CASE WHEN flush_no = 10 THEN 1 ELSE flush_no END AS segments, count(*) FILTER (op = 'set') AS n_live FROM h GROUP BY flush_no""",
    "kv_store_script": f"WITH {_STORE} SELECT key, value FROM w WHERE op = 'set'",
    "kv_orders_live": "WITH h AS (SELECT o_custkey::VARCHAR AS key, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL) SELECT key, value FROM h WHERE st <> 'P'",
    "kv_conversations_latest": "SELECT conv_id::VARCHAR AS key, max(turn) AS seq, 'set' AS op, arg_max(role, turn) AS value FROM conversations GROUP BY ALL",
}
