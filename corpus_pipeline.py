"""From raw documents to packed training sequences.

Each stage is a function of (spark, documents, folder of tables) and works on all documents that the one before kept. Its result is
written to the shared folder and read again, so a lost executor never costs more than the stage that runs.
All but the last return the columns of ``documents``.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.llm import decontamination, language_id, ngram_join, packing, pii
from txnflow.workspace import materialize

#: Documents whose nearest language profile is farther than this are rejected, as are those without a letter.
LEAST_SCORE = 0.15
#: Near copies: documents that share this percentage of their shingles of so many words.
SHINGLE_WORDS, ALIKE_PERCENT = 5, 80
#: Rows that go to a Python worker and come back at once. Of the 10,000 that are Spark's own bound every task holds several copies, of whole texts.
BATCH_ROWS = 2000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session whose Arrow batches have at most ``BATCH_ROWS`` rows; a smaller bound stays."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
            spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return bounded


@_in_small_batches
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones."""
    profiles = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, profiles, keep=docs.columns)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@_in_small_batches
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return ngram_join.one_of_each(docs, n=SHINGLE_WORDS, percent=ALIKE_PERCENT)


@_in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.redact(docs)


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [("language ID", identified), ("n-gram join", distinct), ("decontamination", decontaminated),
          ("personal data", redacted), ("packing", packed)]

#: Language profiles, prefix trees and tokens are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
