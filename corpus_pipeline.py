"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets and tokens, each on what is left before it.

A stage takes (spark, docs, sf_dir) and returns a table; every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontam, langid, minhash, secrets
from weftline.llm.common import read_table, shared_dir

#: Bytes of rows that go to a Python worker at a time, about; a longer row goes alone.  Operators cut what they get to such sizes anyway,
#: while Spark's own bound of 64 MB has an executor hold each batch in both the JVM and the worker, beside a heap that grows with every stage.
BATCH_BYTES = 2 << 20


def _bound_batches(docs: DataFrame) -> None:
    """Have Spark cut batches at ``BATCH_BYTES``.  It reads this setting when a table is evaluated, so it stays in the session."""
    spark = docs.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the likeliest language into ``lang``; only null texts and texts without letters go, and mixtures stay.

    Where no language could be learned, all rows stay as they are.
    """
    _bound_batches(docs)
    model = langid.train(docs)
    if not model.langs:
        return docs
    # Only a text without letters has score 0; a learned language may be called ``und``.
    told = langid.annotate(docs, model).where("lang_score > 0")
    return told.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    _bound_batches(docs)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; ``n_chars`` follows the text."""
    out = secrets.redact_documents(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again."""
    _bound_batches(docs)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: SQL has no forward-backward pass and no merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
