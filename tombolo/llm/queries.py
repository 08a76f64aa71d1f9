"""The registered ``opN_<name>`` queries: each applies one operator, with
production parameters, to its whole table and shapes the digest columns.

``QUERIES`` maps a name to a callable (spark, sf_dir) -> DataFrame and ``SQL``
maps a name to DuckDB SQL for the same rows where SQL can express them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tombolo.llm import bpe, fingerprints, langid, license_scan, lm_score, near_dup, oracle, packing, secret_scan, token_counts, topk
from tombolo.llm.common import shared_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.Ledger(spark, shared_path(spark, "secret-ledger"))
    ledger.update(docs)
    found = secret_scan.findings_by_path(docs, ledger.findings())
    count = lambda kind: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secret_scan.BASE_RULES],
        F.sha2(secret_scan.joined_spans("spans", f"x.rank < {len(secret_scan.BASE_RULES)}"), 256).alias("base_sha256"),
        secret_scan.joined_spans("spans").alias("spans"),
        "blob",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    names, prototypes = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes, _ = near_dup.near_duplicates(docs)
    return classes.select("doc_id", "class_id")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_fingerprints, op3_best_fit_packing, op4_exact_top_k, op5_language_id, op6_license_scan, op7_minhash_near_dup, op8_stupid_backoff, op9_token_counts, op10_bpe)}
SQL = {"op1_secret_scan": oracle.op1(), "op4_exact_top_k": oracle.op4(), "op6_license_scan": oracle.op6()}
SQL = {name: sql for name, sql in SQL.items() if sql}
