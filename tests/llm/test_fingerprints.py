import hashlib
import random

import regex
import xxhash

from tombolo.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, words string"


def brute(text, k=fp.K, window=fp.WINDOW):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    if not words:
        return []
    hashes = []
    for i in range(max(1, len(words) - k + 1)):
        h = 0
        for w in words[i : i + k]:
            signed = (xxhash.xxh64_intdigest(w.encode(), 42) + 2**63) % 2**64 - 2**63
            h = (h * fp.BASE + signed) % fp.PRIME
        hashes.append(h)
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = max(j for j, h in enumerate(part) if h == min(part))
        chosen.add(i + at)
    return [(hashes[i], i) for i in sorted(chosen)]


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Élan", "δέλτα", "x1", "the"]
    out = [" ".join(rng.choice(words) for _ in range(n)) for n in [*range(0, 20), 50, 300]]
    return out + ["same same same same same same same same same same same same same", "", None, "a  b\n\n c!", "long " * 3000, out[10], "日本 語"]


def test_all_columns_against_brute_force(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in fp.with_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    by_id = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for n, (i, t) in enumerate(by_id):
        follow = by_id[(n + 1) % len(by_id)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        string = lambda x: " ".join(f"{h:X}@{p}" for h, p in brute(x))
        like = lambda a, b: 1.0 if not brute(a) and not brute(b) else (lambda x, y: len(x & y) / len(x | y))({h for h, _ in brute(a)}, {h for h, _ in brute(b)})
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (string(t), string(edited))
        assert abs(r["near_edited"] - like(t, edited)) < 1e-12 and abs(r["near_next"] - like(t, follow)) < 1e-12


def test_shared_passage_is_always_seen(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(fp.K + fp.WINDOW - 1))
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(i)), "") for i in range(12)]
    found = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).select(fp.hashes_of("chosen").alias("h")).collect()
    assert set.intersection(*[set(r["h"]) for r in found])


def test_lone_empty_repeated_and_null_ids(spark):
    assert fp.with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = fp.with_edits(spark.createDataFrame([(7, "one two three four", "")], SCHEMA)).collect()
    assert r["near_next"] == 1.0
    got = fp.with_edits(spark.createDataFrame([(1, "a b c", ""), (1, "a b c", ""), (None, "x y", ""), (2, "q", "")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 3), (1, 5), (1, 5), (2, 1)]


def test_ranges_of_ids(spark):
    frame = spark.createDataFrame([(i * i - 50,) for i in range(400)] + [(None,)], "doc_id long")
    edges, last = fp.ranges(frame, "doc_id", 23)
    assert len(last) == len(edges) + 1 and edges == sorted(edges)
    for r in frame.withColumn("part", fp.range_of("doc_id", edges)).collect():
        assert r["part"] == (0 if r["doc_id"] is None else sum(e <= r["doc_id"] for e in edges))
