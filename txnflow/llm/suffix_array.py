"""Repeated passages by hashed suffix heads at minimisers.

Of all suffixes of all documents (from each word on) those are kept that start at a minimiser: the position with the least hash of
five words in some window of consecutive positions, so equal passages keep the same positions. A suffix is represented by a
64-bit hash of its first words. Rows are sorted by it over the whole table, each group of equal ones spread by document, and
compared with their neighbours; the order between different hashes means nothing, and no common lengths are taken. Around those
with an equal neighbour, to the left over all positions whose minimiser they are, every passage of the full length is
hashed, and these are sorted and compared in the same way. What has an equal neighbour is repeated.

The result is exact: a word is in a reported span if and only if some passage of ``length`` words around it occurs at least twice
in the table, be it in one document or in two. Two passages are equal if their words are, whatever white space stands between
them; letters are compared as they are.

Documents with equal texts are extended once, by the one with the smallest id; if they have ``length`` words, each is one
span. Missing, empty and shorter texts have no spans. Ids must be unique; rows with a missing id are left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts
from txnflow.llm.text import mixed, windows, words
from txnflow.workspace import materialize

#: Words of the shortest passage that counts.
LENGTH = 50
#: Consecutive positions of which one at least is kept.
STRETCH = 32
_SEED_WORDS = 5


def minimisers(hashes: np.ndarray, stretch: int = STRETCH, seed: int = _SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that hold the least seed hash, the last of equal ones, of some ``stretch`` consecutive positions.

    With each position the first stretch whose least it is, and the number of such stretches, which follow one another.
    """
    seeds = mixed(windows(hashes, seed))
    if len(seeds) < stretch:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    backwards = np.lib.stride_tricks.sliding_window_view(seeds[::-1], stretch).argmin(1)
    least = (len(seeds) - 1 - np.arange(len(backwards)) - backwards)[::-1]
    return np.unique(least, return_index=True, return_counts=True)


def _suffixes(docs: DataFrame, length: int, stretch: int) -> DataFrame:
    """head (hash of the first words from a minimiser), doc_id, and the stretches it is the least of: ``since`` and ``span``."""
    head = length - stretch + 1

    def made(texts: list[str | None]) -> Iterator:
        for k, text in enumerate(texts):
            hashes, _, _ = words(text, lower=False)
            if len(hashes) < length:
                continue
            places, since, span = minimisers(hashes, stretch)
            fits = places + head <= len(hashes)
            heads = windows(hashes, head)[places[fits]].astype(np.int64)
            yield np.full(len(heads), k), {"head": heads, "since": since[fits].astype(np.int32), "span": span[fits].astype(np.int32)}

    return (map_texts(docs, "text", made, {"head": "bigint", "since": "int", "span": "int"})
            .select("head", "row.doc_id", "since", "span"))


def _flagged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition that equal a neighbour in the first column, and the first and last row anyway."""
    part, before, held, begun = TaskContext.get().partitionId(), None, None, False

    def judged(batch: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        nonlocal begun
        key = batch.column(0).to_numpy(zero_copy_only=False)
        beside = np.concatenate([key[:1] if before is None else [before], key, key[-1:] if after is None else [after]])
        like_before, like_after = beside[:-2] == key, beside[2:] == key
        edge = np.zeros(len(key), np.int32)
        if before is None:
            like_before[0] = False
            edge[0] += 1
        if after is None:
            like_after[-1] = False
            edge[-1] += 2
        keep = np.flatnonzero(like_before | like_after | (edge > 0))
        arrays = [pa.array(like_before), pa.array(like_after), pa.array(edge), pa.array(np.full(len(key), part, np.int32))]
        whole = pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "like_before", "like_after", "edge", "part"])
        return whole.take(pa.array(keep))

    for batch in stream:
        if not batch.num_rows:
            continue
        if held is not None:
            yield judged(held, batch.column(0)[0].as_py())
            before = held.column(0)[held.num_rows - 1].as_py()
        held = batch
    if held is not None:
        yield judged(held, None)


def equal_neighbours(table: DataFrame, name: str) -> DataFrame:
    """The rows whose first column equals that of another row, with ``first``: whether none of those equal to it sorts before it.

    The table is sorted over all partitions by all its columns, so that the rows of a frequent key spread over many tasks. What
    lies at the ends of partitions, two rows each, is settled by the driver.
    """
    columns = table.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    schema += ", like_before boolean, like_after boolean, edge int, part int"
    found = materialize(table.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(_flagged, schema), name)
    edges = sorted(found.where("edge > 0").select("part", "edge", columns[0]).collect(), key=lambda r: (r.part, r.edge))
    ends: dict[int, list] = {}
    for part, edge, key in edges:
        ends.setdefault(part, [None, None])
        if edge & 1:
            ends[part][0] = key
        if edge & 2:
            ends[part][1] = key
    parts = sorted(ends)
    joined = [(p, q) for p, q in zip(parts, parts[1:]) if ends[p][1] == ends[q][0]]
    after = F.col("like_after") | (F.col("edge").bitwiseAND(2) > 0) & F.col("part").isin([p for p, _ in joined])
    before = F.col("like_before") | (F.col("edge").bitwiseAND(1) > 0) & F.col("part").isin([q for _, q in joined])
    return found.where(before | after).select(*columns, (~before).alias("first"))


def _extended(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc_id, text, places (structs of since and span). The passages of the full length that start in those stretches."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for k, (text, places) in enumerate(zip(texts, batch.column(2), strict=True)):
                hashes, begin, end = words(text, lower=False)
                flat = places.values
                since, span = (flat.field(f).to_numpy().astype(np.int64) for f in (0, 1))
                starts = np.repeat(since, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                starts = np.unique(starts[starts + length <= len(hashes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows(hashes, length)[starts].astype(np.int64)), ids.take(pa.array(np.full(len(starts), k))),
                     pa.array(starts.astype(np.int32)), pa.array(begin[starts].astype(np.int32)), pa.array(end[starts + length - 1].astype(np.int32))],
                    ["passage", "doc_id", "word", "start", "end"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "places").mapInArrow(batches, f"passage bigint, doc_id {key}, word int, start int, end int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words of each maximal span of repeated passages, and n_removable:
    how many of its words lie in passages that a document with a smaller id, or an earlier place, holds as well."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    white = F.lit(" \t\n\x0b\x0c\r")
    texts = docs.select("doc_id", F.md5("text").alias("digest"), F.regexp_count("text", F.lit(r"[^ \t-\r]+")).alias("n_words"),
                        (F.length("text") - F.length(F.ltrim("text", white))).alias("start"), F.length(F.rtrim("text", white)).alias("end"))
    texts = materialize(texts.where(F.col("n_words") >= length), "texts")
    classes = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = materialize(texts.join(classes, "digest").select("doc_id", "rep", "n_words", "start", "end"), "copies")

    shared = equal_neighbours(_suffixes(docs, length, stretch), "suffixes")
    others = copies.where("doc_id <> rep").select("doc_id")
    places = (shared.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("since", "span"))).alias("places"))
              .join(others, "doc_id", "left_anti"))
    passages = equal_neighbours(materialize(_extended(docs.join(places, "doc_id"), length), "extended"), "passages")

    # Passages of a document whose words touch or overlap are one span.
    down = Window.partitionBy("doc_id").orderBy("word")
    step = F.col("word") - F.lag("word").over(down)
    again = F.when(~F.col("first"), F.col("word"))
    since = F.last(again, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    removable = F.when(F.col("first"), 0).otherwise(F.least(F.lit(length), F.coalesce(F.col("word") - since, F.lit(length))))
    spans = (passages.select("*", F.coalesce(step > length, F.lit(True)).cast("int").alias("new"), removable.alias("removable"))
             .withColumn("span", F.sum("new").over(down)).groupBy("doc_id", "span")
             .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") - F.min("word") + length).alias("n_words"),
                  F.sum("removable").alias("n_removable")))
    partly = spans.join(copies.select("doc_id"), "doc_id", "left_anti").drop("span")
    held = spans.groupBy("doc_id").agg(F.sum("n_removable").alias("held"))
    whole = copies.join(held, "doc_id", "left").select(
        "doc_id", "start", "end", "n_words",
        F.when(F.col("doc_id") == F.col("rep"), F.coalesce("held", F.lit(0))).otherwise(F.col("n_words")).alias("n_removable"))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("start", "end", "n_words", "n_removable")]
    return partly.select("doc_id", *longs).union(whole.select("doc_id", *longs))
