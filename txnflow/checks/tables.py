"""Customers, transactions and messages derived from the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.functions.messages import encode_json
from txnflow.operators.sizing import broadcast_if_small, hinted_by_size
from txnflow.sinks.replay import MESSAGE_FIELDS

# Time of the test tables: wall clock without a zone.
TIME = "timestamp_ntz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream, be it one file or a folder of files."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 100)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def _thousandths(start: int, number: str, factor: int, span: int):
    return F.expr(f"{start} + ({number} * {factor} % {span}) / cast(1000 as double)")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card holder per customer."""
    holders = table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # 25 nations and 5 regions at every scale.
    places = nations.join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey)
    return holders.join(F.broadcast(places), holders.c_nationkey == places.n_nationkey).select(
        F.expr("cast(c_custkey as string)").alias("cc_num"),
        F.col("c_name").alias("first"),
        F.col("c_mktsegment").alias("last"),
        F.expr("case when c_custkey % 2 = 0 then 'F' else 'M' end").alias("gender"),
        F.col("c_name").alias("street"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.expr("lpad(cast(c_custkey % 100000 as string), 5, '0')").alias("zip"),
        _thousandths(25, "c_custkey", 7919, 24000).alias("lat"),
        _thousandths(-124, "c_custkey", 104729, 57000).alias("long"),
        F.col("c_mktsegment").alias("job"),
        F.expr(f"cast(date '1940-01-01' + cast(c_custkey * 31 % 22000 as int) as {TIME})").alias("dob"),
    )


# What is read of each table that line items are joined with.
_SIDES = {"orders": ("o_orderkey", "o_custkey", "o_orderdate"), "part": ("p_partkey", "p_type"), "supplier": ("s_suppkey", "s_name")}
# What each transaction column is computed from. Columns that need no joined table come from line items alone.
_FROM_LINEITEM = {
    "trans_num": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "trans_time": "concat(lpad(cast(l_linenumber as string), 2, '0'), ':00:00')",
    "amt": "l_extendedprice",
    "merch_lat": "25 + (l_suppkey * 6007 % 24000) / cast(1000 as double)",
    "merch_long": "-124 + (l_suppkey * 50021 % 57000) / cast(1000 as double)",
    "is_fraud": "case when (l_orderkey * 7 + l_linenumber * 13) % 200 = 0 then 1D else 0D end",
}
_FROM_ORDERS = {
    "cc_num": "cast(o_custkey as string)",
    "trans_date": "concat(cast(cast(o_orderdate as date) as string), 'T00:00:00.000Z')",
    "ts": f"cast(cast(o_orderdate as date) as {TIME}) + make_dt_interval(0, l_linenumber)",
}
_FROM_PART = {"category": "p_type"}
_FROM_SUPPLIER = {"merchant": "s_name"}
RAW = ["cc_num", "trans_num", "trans_date", "trans_time", "category", "merchant", "amt",
       "merch_lat", "merch_long", "is_fraud"]


def transactions(spark: SparkSession, sf_dir: str, columns=RAW, lines: DataFrame | None = None, holders: DataFrame | None = None) -> DataFrame:
    """One transaction per line item, reading only the tables that ``columns`` need.

    ``lines`` may bring the line items as a stream. With ``holders``, which have a ``cc_num``, each transaction is joined with its holder and
    has the holder's other columns too. They are joined with the orders, which are fewer and narrower than the finished transactions.
    """
    made = {**_FROM_LINEITEM, **_FROM_ORDERS, **_FROM_PART, **_FROM_SUPPLIER}
    needed = [(name, left, right) for name, provided, left, right in [
        ("orders", _FROM_ORDERS, "l_orderkey", "o_orderkey"),
        ("part", _FROM_PART, "l_partkey", "p_partkey"),
        ("supplier", _FROM_SUPPLIER, "l_suppkey", "s_suppkey"),
    ] if any(c in provided for c in columns)]
    rows = table(spark, sf_dir, "lineitem") if lines is None else lines
    for name, left, right in needed:
        side = table(spark, sf_dir, name).select(*_SIDES[name])
        if name == "orders" and holders is not None:
            held = broadcast_if_small(holders.withColumnRenamed("cc_num", "held"))
            side = side.join(held, F.expr(made["cc_num"]) == F.col("held"))
        else:
            side = hinted_by_size(side)
        rows = rows.join(side, F.col(left) == F.col(right))
    more = [c for c in holders.columns if c != "cc_num"] if holders is not None else []
    return rows.select(*[F.expr(made[c]).alias(c) for c in columns], *more)


def timed_transactions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Transactions as stored before enrichment: the full time in ``trans_time``."""
    columns = [c for c in RAW if c not in ("trans_date", "trans_time")] + ["ts"]
    return transactions(spark, sf_dir, columns, lines).withColumnRenamed("ts", "trans_time")


def transaction_messages(spark: SparkSession, sf_dir: str, stream: bool = False, parts: int = 0) -> DataFrame:
    """Topic messages of all transactions, their values as text. A stream of line items gives a stream. Of ``parts`` each has all messages
    of its cards; transactions are dealt to them before they are text, which is longer."""
    lines = stream_table(spark, sf_dir, "lineitem") if stream else None
    rows = timed_transactions(spark, sf_dir, lines)
    rows = (rows.repartition(parts, "cc_num") if parts else rows).withColumns({
        "first": F.concat(F.lit("holder "), "cc_num"), "last": F.lit("of card"),
    })
    return rows.select(
        F.col("cc_num").cast("binary").alias("key"),
        encode_json(*MESSAGE_FIELDS).cast("binary").alias("value"),
        F.lit("transactions").alias("topic"),
        F.expr("cast(cast(cc_num as bigint) % 4 as int)").alias("partition"),
        # The numbers of order and line, which the transaction's number begins with.
        F.expr("cast(split(trans_num, '-')[0] as bigint) * 8 + cast(split(trans_num, '-')[1] as bigint)").alias("offset"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    """Topic messages of the events, with their JSON properties as values."""
    return events.select(
        F.expr("cast(cast(user_id as string) as binary)").alias("key"),
        F.expr("cast(props as binary)").alias("value"),
        F.lit("events").alias("topic"),
        F.expr("cast(event_id % 4 as int)").alias("partition"),
        F.expr("event_id div 4").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
