import random
import re

from pyspark.sql import functions as F

from tombolo.llm import secret_scan as ss

SCHEMA = "doc_id string, text string"
NEW = ss.Rule("pin", r"pin=[0-9]+")


def by_path(spark, versions, ledger, rules):
    found = ss.findings_by_path(versions, ledger.findings(rules)).select("doc_id", ss.joined_spans("spans").alias("s")).collect()
    return sorted((r["doc_id"] or "", r["s"]) for r in found)


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_three_runs_equal_a_full_scan(spark, tmp_path):
    """New paths with old blobs, new blobs and new rules: what is stored and what is new are joined."""
    ledger = ss.Ledger(spark, f"file://{tmp_path}/ledger")
    secret, clean, pin = "x token=abcdef12 y", "nothing here", "pin=12 and token=abcdef12"
    one = [("p1", secret), ("p2", clean), (None, None)]
    two = [*one, ("p1", pin), ("p3", secret), ("p4", secret)]
    scanned = []
    for rows, rules in ((one, ss.RULES), (two, ss.RULES), (two, (*ss.RULES, NEW))):
        versions = table(spark, *rows)
        scanned.append({r["text"]: len(r["todo"]) for r in ledger.unseen(ss.blobs(versions), rules).collect()})
        ledger.update(versions, rules)
        whole = ss.Ledger(spark, f"file://{tmp_path}/whole{len(scanned)}")
        whole.update(versions, rules)
        assert by_path(spark, versions, ledger, rules) == by_path(spark, versions, whole, rules)
    n = len(ss.RULES)
    assert scanned == [{secret: n, clean: n, "": n}, {pin: n}, {secret: 1, clean: 1, "": 1, pin: 1}]
    got = by_path(spark, versions, ledger, (*ss.RULES, NEW))
    assert got == [("", ""), ("p1", "assign:2:16"), ("p1", "pin:0:6,assign:11:25"), ("p2", ""), ("p3", "assign:2:16"), ("p4", "assign:2:16")]
    # an unfinished folder and an old version of a rule play no part
    (tmp_path / "ledger" / "broken").mkdir()
    (tmp_path / "ledger" / "broken" / "part-0.parquet").write_bytes(b"no")
    assert by_path(spark, versions, ledger, (*ss.RULES, NEW)) == got
    assert {r["text"] for r in ledger.unseen(ss.blobs(versions), (ss.Rule("pin", r"pin=[0-9]+", version=2),)).collect()} == {secret, clean, "", pin}


def test_empty_table(spark, tmp_path):
    ledger = ss.Ledger(spark, f"file://{tmp_path}/ledger")
    empty = spark.createDataFrame([], SCHEMA)
    assert ledger.findings().count() == 0
    ledger.update(empty)
    assert ss.findings_by_path(empty, ledger.findings()).count() == 0
    assert ss.redact(empty, ledger.findings()).count() == 0


def redacted(text, rules):
    spans = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text):
            if len(m[r.group]) >= r.least:
                spans.append((m.start(), rank, m.end()))
    out, at = "", 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[X]"
        at = max(at, end)
    return out + text[at:], spans


def test_redaction_of_overlapping_and_many_spans_against_plain_loops(spark, tmp_path):
    rng = random.Random(1)
    rules = (ss.Rule("ab", "a[bc]+"), ss.Rule("cd", "[cd]{2,}"), ss.Rule("long", "b[^e]*e", 0, 3), ss.Rule("smile", "\U0001F642+"))
    texts = ["".join(rng.choice("abcdef é\U0001F642") for _ in range(n)) for n in (0, 1, 5, 40, 300, 4095, 4096, 4097, 9000, 20000) for _ in range(3)] + [None, "e" * 9000]
    rows = [(str(i), t) for i, t in enumerate(texts)] * 2
    versions = table(spark, *rows)
    ledger = ss.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.update(versions, rules)
    got = {r["doc_id"]: r["text"] for r in ss.redact(versions, ledger.findings(rules), mark="[X]").collect()}
    spans = {r["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in r["spans"]] for r in ss.findings_by_path(versions, ledger.findings(rules)).collect()}
    for i, t in enumerate(texts):
        clean, found = redacted(t or "", rules)
        assert got[str(i)] == (None if t is None else clean) and spans[str(i)] == sorted(found)


def test_columns_of_any_name_stay(spark, tmp_path):
    names = ["blob", "spans", "salt", "row", "spread", "pieces", "tail", "blocks", "_salt", "a b", "M"]
    versions = table(spark, ("1", "password=abcdef"), ("1", "password=abcdef"), (None, "fine")).select("doc_id", "text", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit(1), F.lit(2)).alias("map"))
    ledger = ss.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.update(versions)
    got = ss.redact(versions, ledger.findings())
    assert got.columns == versions.columns
    assert sorted((r["doc_id"] or "", r["text"], *(r[n] for n in names)) for r in got.collect()) == [("", "fine", *names), ("1", "[SECRET]", *names), ("1", "[SECRET]", *names)]
