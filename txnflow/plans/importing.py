"""Import: raw transactions and customers to keyed tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from txnflow.functions.times import normalize_time
from txnflow.operators.enrich import enrich
from txnflow.operators.keyed import latest_by_key
from txnflow.operators.route import route_of
from txnflow.operators.sizing import BROADCAST_LIMIT_BYTES
from txnflow.schemas import CUSTOMER, CUSTOMER_KEY, LABELLED_TRANSACTION, TRANSACTION_KEY
from txnflow.sinks.tables import save_routes, save_routes_apart, save_table
from txnflow.sources.tables import BAD_LINE, load_table, read_csv, read_csv_marked, rejects
from txnflow.workspace import job_scope, materialize


def import_transactions(transactions: DataFrame, customers: DataFrame, as_of=None, time_type: str = "timestamp",
                        counts: Observation | None = None, cards: Observation | None = None,
                        broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Rows of both keyed transaction tables, tagged with ``route``.

    Raw times are combined, rows enriched and routed by label, and per route one row is kept for each card
    and time. Up to there all is one pass without a shuffle if the customers fit a broadcast. ``counts``
    receives the fields of :class:`ImportCounts` from that pass but the cards', which go to ``cards``.
    """
    enriched = enrich(normalize_time(transactions, time_type), customers, as_of, broadcast_limit=broadcast_limit, counts=cards)
    tagged = enriched.withColumn("route", route_of())
    has_route, has_time = F.col("route").isNotNull(), F.col("trans_time").isNotNull()
    if counts is not None:
        tagged = tagged.observe(
            counts,
            F.count_if(has_route & has_time).alias("routed"),
            F.count_if(~has_route).alias("unrouted"),
            F.count_if(has_route & ~has_time).alias("rejected"),
        )
    return latest_by_key(tagged.where(has_route & has_time), ["route", *TRANSACTION_KEY])


@dataclass
class ImportCounts:
    """Enriched rows: ``routed`` ones with a complete key, ``unrouted`` ones with a label other than 0 and 1,
    and ``rejected`` ones, which have no usable time and so no key. Only the first are stored. ``unknown_card``
    counts rows whose card has no customer; those without a card aren't counted anywhere. ``bad_lines`` counts
    transaction lines in quarantine."""

    routed: int
    unrouted: int
    rejected: int
    unknown_card: int
    bad_lines: int = 0


def run_import(spark: SparkSession, transactions_path: str, customers_path: str, output: str, as_of=None,
               time_type: str = "timestamp", source: tuple[str, dict] | None = None, target: str = "parquet",
               targets: dict[str, dict] | None = None, quarantine: str | None = None) -> ImportCounts:
    """Raw tables to ``customer`` and ``transaction`` (partitioned by route) below ``output``.

    The input is CSV with a header, or with ``source`` any other (format, options) with the same columns. ``target`` is the format of
    what is written. A target without folders takes the options of its tables ``customer``, ``fraud`` and ``non_fraud`` from
    ``targets``; the routes are then written apart. With ``quarantine``, a folder, transaction lines of a CSV with a bad cell are written
    there with the reason, and nowhere else; without it such a cell is NULL.
    """
    if quarantine and source is not None:
        raise ValueError("only CSV input has lines to put into quarantine")
    bad_lines = 0
    if source is None:
        customers, transactions = read_csv(spark, customers_path, CUSTOMER), read_csv(spark, transactions_path, LABELLED_TRANSACTION)
    else:
        fmt, options = source
        customers = load_table(spark, fmt, CUSTOMER, path=customers_path, **options)
        transactions = load_table(spark, fmt, LABELLED_TRANSACTION, path=transactions_path, **options)
    if quarantine:
        marked, bad = read_csv_marked(spark, transactions_path, LABELLED_TRANSACTION), Observation("quarantine")
        save_table(rejects(marked).observe(bad, F.count(F.lit(1)).alias("n")), "parquet", path=quarantine)
        bad_lines = bad.get["n"]
        transactions = marked.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    # Stored with one row per card, but joined as they are in the input.
    others = [c for c in customers.columns if c not in CUSTOMER_KEY]
    holders = latest_by_key(customers, CUSTOMER_KEY, others)
    save_table(holders, target, **(targets["customer"] if targets else {"path": f"{output}/customer"}))
    counts, cards = Observation("import"), Observation("cards")
    rows = import_transactions(transactions, customers, as_of, time_type, counts, cards)
    if targets:
        # Stored first, since each route's write passes over the rows, and the counts are of one pass.
        with job_scope(spark):
            save_routes_apart(materialize(rows, "imported"), targets, target)
    else:
        save_routes(rows, target, path=f"{output}/transaction")
    return ImportCounts(**counts.get, unknown_card=cards.get["unknown_card"], bad_lines=bad_lines)
