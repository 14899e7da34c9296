"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), calls one operator of ``tessera.llm`` on all
that the stage before kept, and returns a DataFrame; ``run`` writes each as Parquet
in the shared folder and reads it back as the next stage's docs.  All but the last
return the columns of documents.  A null or empty text has no language and goes at
the first stage; repeated rows are exact copies and one stays; an empty table passes
through as an empty table; extra columns are carried along.  A document without a doc_id
can't be told from others and goes at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language_id, near_dedup, secrets
from tessera.llm.common import table, write_shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without letters, or that equal pieces
    explain better than any language does, go, however many languages there are."""
    found = language_id.identify(docs, docs)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lead") > 0)).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, once."""
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decimal and comma-joined, and whether they decode to the text."""
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL can't express language identification and BPE; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
