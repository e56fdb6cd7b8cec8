"""Streaming sinks, and starting, awaiting and stopping queries."""

import json
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from txnflow.operators.keyed import latest_by_key
from txnflow.operators.route import route_by_label
from txnflow.schemas import FRAUD, LABEL, NON_FRAUD, TRANSACTION_KEY, TRANSACTION_TIES
from txnflow.sinks.keyed import notes_of, upsert_keyed_table
from txnflow.sinks.tables import save_routes, save_table
from txnflow.workspace import COMPRESSION


def start_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  name: str | None = None, output_mode: str = "update", **trigger) -> StreamingQuery:
    """Hand every micro-batch with its number to ``write``.

    A batch may be handed over again after a failure, with the same number and rows; ``write`` should then
    replace what it wrote. ``trigger`` goes to Spark, e.g. ``availableNow=True`` to stop when caught up.
    """
    writer = stream.writeStream.foreachBatch(write).outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(**trigger) if trigger else writer).start()


def _tie(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Bind ``path`` to one checkpoint: another one would number its batches from 0 and replace stored ones."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    mark = make(f"{path}/_bound/checkpoint")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(mark):
        bound = json.loads(spark.read.option("wholetext", True).text(f"{path}/_bound/checkpoint").first()[0])["checkpoint"]
        if bound != checkpoint:
            raise ValueError(f"{path} holds the batches of checkpoint {bound}, not of {checkpoint}")
        return
    draft = make(f"{path}/_bound/draft-{uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps({"checkpoint": checkpoint}).encode()))
    stream.close()
    if not files.rename(draft, mark):
        raise RuntimeError(f"another query has just been bound to {path}")


def start_routed(stream: DataFrame, path: str, checkpoint: str | None = None, label: str = LABEL,
                 name: str | None = None, fmt: str = "parquet", options: dict | None = None, **trigger) -> StreamingQuery:
    """Both routes of a stream from one query, each batch once as ``batch_id=<n>/route=<route>`` below ``path``.

    Repeating a batch overwrites its own folder, so no row is stored twice. The checkpoint numbers the batches and therefore
    belongs to ``path``, where it is kept unless given; a ``path`` with batches of another checkpoint is refused.
    """
    routed = route_by_label(stream, label, rest_is_negative=True)
    checkpoint = checkpoint or f"{path}/_checkpoint"
    _tie(stream.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        save_routes(batch, fmt, path=f"{path}/batch_id={batch_id}", **(options or {}))

    return start_batches(routed, write, checkpoint, name, **trigger)


def routed_schema(schema: StructType) -> StructType:
    """The schema of a routed stream's stored rows, given that of the stream."""
    return StructType([*schema.fields, StructField("batch_id", LongType()), StructField("route", StringType())])


def read_routed(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """All stored rows of a routed stream with ``batch_id`` and ``route``."""
    return spark.read.format(fmt).schema(schema).option("basePath", path).load(path)


def keyed_view(routed: DataFrame, keys=TRANSACTION_KEY, order=TRANSACTION_TIES) -> DataFrame:
    """What keyed tables would hold after these batches: per route and key the row of the latest batch."""
    return latest_by_key(routed, ["route", *keys], ["batch_id", *order])


def committed_batches(spark: SparkSession, path: str) -> int:
    """Number of the last batch of a routed stream that Spark has committed; -1 without one.

    Folders of later batches may be incomplete, or be written anew.
    """
    jvm = spark.sparkContext._jvm
    bound = spark.read.option("wholetext", True).text(f"{path}/_bound/checkpoint").first()
    folder = jvm.org.apache.hadoop.fs.Path(f"{json.loads(bound[0])['checkpoint']}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def fold(spark: SparkSession, path: str, tables: str, schema, fmt: str = "parquet", keys=TRANSACTION_KEY, order=TRANSACTION_TIES) -> None:
    """Write the batches of a routed stream since the last fold into the keyed tables ``fraud`` and ``non_fraud`` below ``tables``.

    Only committed batches are read: one that is being written, or that a failure left half written, waits for the next fold. Only new
    ones are read and only their periods written anew. The number of the last batch comes into force with its rows, so a
    fold that failed is simply repeated. ``schema`` is that of the stored rows, see :func:`routed_schema`. A stream that is to be
    in its tables without a second job writes them itself: :func:`txnflow.streaming.keyed.start_keyed`.
    """
    newest = committed_batches(spark, path)
    if newest < 0:
        return
    routed = read_routed(spark, path, schema, fmt)
    for route in (FRAUD, NON_FRAUD):
        table = f"{tables}/{route}"
        last = notes_of(spark, table).get("batch_id", -1)
        if last < newest:
            new = routed.where((F.col("route") == route) & (F.col("batch_id") > last) & (F.col("batch_id") <= newest))
            upsert_keyed_table(spark, table, new.drop("route"), keys, ["batch_id", *order], {"batch_id": newest}, stored=True, beside=["batch_id"])


def compact(routed: DataFrame, target: str, keys=TRANSACTION_KEY, order=TRANSACTION_TIES) -> None:
    """Store the keyed view as one table at ``target``, a new path. For regular use see :func:`fold`."""
    save_table(keyed_view(routed, keys, order).drop("batch_id"), mode="error", partition_by=["route"], path=target)


def start_named(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None,
                watermark: tuple[str, str] | None = ("timestamp", "1 minute"), **trigger) -> StreamingQuery:
    """Append a stream to a table that SQL can read under ``name``.

    With a ``path`` the rows go to files there; see :func:`read_named`. Without one they go to Spark's memory
    sink, which keeps every row on the driver and suits only streams known to be short. The watermark has no
    effect on a query without state.
    """
    marked = stream.withWatermark(*watermark) if watermark else stream
    writer = marked.writeStream.outputMode("append").queryName(name)
    if path is None:
        writer = writer.format("memory")
    else:
        writer = writer.format("parquet").option("path", path).option("compression", COMPRESSION)
        writer = writer.option("checkpointLocation", checkpoint or f"{path}/_checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_named(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The rows stored so far, also registered as the view ``name``. Call again to see later batches."""
    rows = spark.read.parquet(path)
    rows.createOrReplaceTempView(name)
    return spark.table(name)


def await_all(spark: SparkSession, timeout: float | None = None) -> bool:
    """Wait until every query has ended, ``timeout`` seconds at most for all together; False if one still runs.

    The failure of any query is raised, as soon as it happens or at once if it happened before the call. What has ended is then
    forgotten (``resetTerminated``), so that the next call doesn't report it again.
    """
    deadline = None if timeout is None else time.monotonic() + timeout
    while True:
        running = spark.streams.active
        try:
            spark.streams.awaitAnyTermination(0.05)
        except Exception:
            spark.streams.resetTerminated()
            raise
        if not running:
            spark.streams.resetTerminated()
            return True
        if deadline is not None and time.monotonic() >= deadline:
            return False
        time.sleep(0.05)


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()
