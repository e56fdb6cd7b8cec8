"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are aggregated by encoded length. Sums over all lengths from the longest down then answer, for any limit, how many
documents and tokens reach it, what is kept if every document is cut there, and which length is a quantile, without
another look at a document. A missing or empty text has length 0. An empty table has no lengths.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts
from txnflow.llm.tokens import WORD_BPE, shared

#: Lengths that one task sums at once.
RANGE = 4096


def histogram(docs: DataFrame, text: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """length, n_docs: documents are counted by length in their own task, then over all."""
    def made(texts: list[str | None]) -> Iterator:
        yield None, {"length": shared(tokenizer).lengths(texts)}

    lengths = map_texts(docs, text, made, {"length": "bigint"}, keep=docs.columns[:1])
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length: documents and tokens of at least it, documents below it, what a cut there keeps, of how much.

    Lengths are summed within ranges of ``width``, and the ranges' totals, few as they are, by themselves.
    """
    by_range = lengths.withColumn("part", F.floor(F.col("length") / width))
    tokens = F.col("length") * F.col("n_docs")
    down = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = by_range.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = totals.select(
        "part", F.coalesce(F.sum("docs").over(down), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(down), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(everything).alias("docs_in_all"), F.sum("tokens").over(everything).alias("tokens_in_all"))
    within = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (by_range.withColumn("docs_within", F.sum("n_docs").over(within)).withColumn("tokens_within", F.sum(tokens).over(within))
            .join(after, "part")
            .withColumn("docs_from", F.col("docs_within") + F.col("docs_after"))
            .withColumn("tokens_from", F.col("tokens_within") + F.col("tokens_after"))
            .select("length", "n_docs", "docs_from", "tokens_from",
                    (F.col("docs_in_all") - F.col("docs_from")).alias("docs_below"),
                    (F.col("tokens_in_all") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("truncated_total"),
                    "docs_in_all", "tokens_in_all"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_cut (documents longer than it) and kept (tokens left if every document is cut at the limit)."""
    def answer(limit: int) -> F.Column:
        # The first length beyond the limit knows how many documents and tokens lie from there on.
        beyond = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") > limit, F.col("length")))
        n_cut, cut_tokens = F.coalesce(beyond["docs_from"], F.lit(0)), F.coalesce(beyond["tokens_from"], F.lit(0))
        kept = F.coalesce(F.max("tokens_in_all"), F.lit(0)) - cut_tokens + n_cut * F.lit(limit)
        return F.struct(F.lit(limit).cast("bigint").alias("limit"), n_cut.cast("bigint").alias("n_cut"), kept.cast("bigint").alias("kept"))

    return sums.agg(F.array(*map(answer, limits)).alias("answers")).select(F.inline("answers"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least that share of the documents doesn't exceed; none without documents."""
    def answer(share: float) -> F.Column:
        reached = F.col("docs_below") + F.col("n_docs") >= F.lit(float(share)) * F.col("docs_in_all")
        return F.struct(F.lit(float(share)).alias("share"), F.min(F.when(reached, F.col("length"))).alias("length"))

    return sums.agg(F.array(*map(answer, shares)).alias("answers")).select(F.inline("answers"))
