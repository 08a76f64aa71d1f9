"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes the documents that its predecessor kept, as they were written
and read again, and returns the rows that go on; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tombolo.llm import langid, near_dup, packing, secret_scan
from tombolo.llm.common import clear, mark, shared_path, table, unused, written

#: Texts whose distinct words have so many letters, and are no nearer to a learned
#: language than this, are in none of them; a text of fewer letters says too little
#: to be rejected, and so does a word that is repeated.
FOREIGN = ((100, 0.08), (200, 0.2))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and long ones that resemble no learned language."""
    names, prototypes = langid.fit(docs.filter(~langid.held_out()))
    predicted, score, letters = added = tuple(unused(name, docs) for name in ("lang_pred", "score", "letters"))
    judged = langid.predict(docs, names, prototypes, distinct=True, added=added)
    foreign = F.lit(False)
    for fewest, least in FOREIGN if names else ():
        foreign |= (F.col(letters) >= fewest) & (F.col(score) < least)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rejected = foreign | ((F.col(predicted) == langid.UND) & ~(has_letter & F.lit(not names)))
    return judged.filter(~rejected).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    return near_dup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found gives way to a mark; no document goes."""
    ledger = secret_scan.Ledger(spark, shared_path(spark, "secret-ledger"))
    ledger.update(docs)
    clean = secret_scan.redact(docs, ledger.findings())
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: No SQL: hypervectors, consistent samples, the tokenizer and the fitted plan have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begin = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        clear(spark, begin)
    return STAGES[-1][1](spark, docs, sf_dir)
