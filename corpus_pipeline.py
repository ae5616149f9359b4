"""A corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. Between
stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import jaccard, line_dedup, packing, quality, secrets
from keyloom.llm.common import WORD, written
from keyloom.sources import folders

TOKENIZER = "byte_bpe_50k.json"


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go; so do documents of which nothing else is left."""
    out = line_dedup.dedup(docs, extra=True)
    return with_length(out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).drop("n_lines", "n_removed"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles the one with the least doc_id stays."""
    return jaccard.keep_one(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by [kind]."""
    return with_length(secrets.redact(docs, secrets.scan(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", packed),
]

#: The isolation forest and the tokenizer can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. When a stage's rows are written, what the operators wrote on the way, and its input, go."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        at = folders.made()
        docs = written(stage(spark, docs, sf_dir))
        out = folders.last_made()
        folders.drop_since(at, keep=out)
        if read is not None:
            folders.delete(spark, read)
        read = out
    return STAGES[-1][1](spark, docs, sf_dir)
