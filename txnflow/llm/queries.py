"""The registered queries of this package, with SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txnflow.llm import (decontamination, geometric_kmeans, html_template, language_id, licence_scan, ngram_join, packing, pii, quality_rules,
                         quotes, suffix_array, token_counts, vector_codes)
from txnflow.workspace import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by anchor expansion."""
    return pii.digest(_table(spark, sf_dir, "documents"))


@query()
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by the Jaccard similarity of their 4-word shingles, by prefix trees."""
    return ngram_join.link(_table(spark, sf_dir, "documents"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token totals at every encoded length of the documents."""
    # Stored, since the sums read it several times.
    return token_counts.suffix_sums(materialize(token_counts.histogram(_table(spark, sf_dir, "documents").select("text")), "lengths"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of several lengths."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, by a positional inverted index."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by rank-order profiles."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


@query(quality_rules.ORACLE_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured and judged by the threshold table."""
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


@query()
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that documents repeat, by a sparse suffix array."""
    return suffix_array.repeated_spans(_table(spark, sf_dir, "documents"))


@query()
def op8_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by template deduction."""
    return html_template.extract(_table(spark, sf_dir, "pages"))


@query(quotes.ORACLE_SQL)
def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, linked to the message it answers."""
    return quotes.in_reply_order(quotes.linked(_table(spark, sf_dir, "conversations")))


@query()
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and texts in every document, by a generalised suffix automaton."""
    return licence_scan.report(_table(spark, sf_dir, "documents"))


@query(vector_codes.ORACLE_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code by 16 codebooks, nearest entries found by equal-average search."""
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


@query(geometric_kmeans.ORACLE_SQL)
def op13_geometric_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster by exact K-means with geometric drift bounds."""
    return geometric_kmeans.report(_table(spark, sf_dir, "embeddings"))
