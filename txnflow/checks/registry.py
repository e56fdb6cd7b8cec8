"""Named queries over the test tables, most with SQL that gives the same rows."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2023, 12, 27)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUSTOMERS_SQL = """
customers as (
  select cast(c_custkey as varchar) as cc_num, c_name as first, c_mktsegment as last,
    case when c_custkey % 2 = 0 then 'F' else 'M' end as gender, c_name as street,
    n_name as city, r_name as state, lpad(cast(c_custkey % 100000 as varchar), 5, '0') as zip,
    25 + (c_custkey * 7919 % 24000) / cast(1000 as double) as lat,
    -124 + (c_custkey * 104729 % 57000) / cast(1000 as double) as long,
    c_mktsegment as job, cast(date '1940-01-01' + cast(c_custkey * 31 % 22000 as int) as timestamp) as dob
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

# Columns of a transaction by the table they come from, beside those of the line item.
_LINE_COLUMNS = """
    concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as trans_num,
    concat(lpad(cast(l_linenumber as varchar), 2, '0'), ':00:00') as trans_time,
    l_extendedprice as amt,
    25 + (l_suppkey * 6007 % 24000) / cast(1000 as double) as merch_lat,
    -124 + (l_suppkey * 50021 % 57000) / cast(1000 as double) as merch_long,
    case when (l_orderkey * 7 + l_linenumber * 13) % 200 = 0 then cast(1 as double) else cast(0 as double) end
      as is_fraud"""
_JOINED_COLUMNS = {
    "orders": """
    cast(o_custkey as varchar) as cc_num,
    concat(cast(cast(o_orderdate as date) as varchar), 'T00:00:00.000Z') as trans_date,
    cast(concat(cast(cast(o_orderdate as date) as varchar), ' ',
      lpad(cast(l_linenumber as varchar), 2, '0'), ':00:00') as timestamp) as ts""",
    "part": """
    p_type as category""",
    "supplier": """
    s_name as merchant""",
}
_JOINS = {"orders": "l_orderkey = o_orderkey", "part": "l_partkey = p_partkey", "supplier": "l_suppkey = s_suppkey"}


def transactions_sql(*tables: str) -> str:
    """Transactions from the line items and the named tables only, with the columns that these provide."""
    columns = ",".join([_LINE_COLUMNS, *(_JOINED_COLUMNS[t] for t in tables)])
    joins = "".join(f" join {t} on {_JOINS[t]}" for t in tables)
    return f"""
transactions as (
  select{columns}
  from lineitem{joins})"""


TRANSACTIONS_SQL = transactions_sql(*_JOINS)


def distance_sql(lat1: str, long1: str, lat2: str, long2: str, angle: str = "radians") -> str:
    """Haversine distance in SQL, NULL where the inner term leaves [0, 1]."""
    chord = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos({angle}({lat1})) * cos({angle}({lat2})) * pow(sin((radians({long2}) - radians({long1})) / 2), 2))"
    )
    return (f"case when {chord} between 0 and 1 then "
            f"2 * 6371 * atan2(sqrt(greatest({chord}, 0)), sqrt(greatest(1 - {chord}, 0))) end")


ENRICHED_SQL = f"""
enriched as (
  select cc_num, ts as trans_time, trans_num, category, merchant, amt, merch_lat, merch_long,
    round({distance_sql("lat", "long", "merch_lat", "merch_long")}, 2) as distance,
    cast(trunc(date_diff('day', cast(dob as date), date '{AS_OF}') / cast(365 as double)) as integer) as age,
    is_fraud
  from transactions join customers using (cc_num))"""

_PARTS = {"customers": CUSTOMERS_SQL, "transactions": TRANSACTIONS_SQL, "enriched": ENRICHED_SQL}


def with_parts(sql: str, *parts: str) -> str:
    """``sql`` after the named common tables."""
    return "with " + ",".join(_PARTS[p] for p in parts) + "\n" + sql if parts else sql


def with_transactions(sql: str, tables=tuple(_JOINS)) -> str:
    """``sql`` after the transactions over the line items and ``tables``, by default all."""
    return f"with {transactions_sql(*tables)}\n{sql}"


def with_enriched(sql: str) -> str:
    return with_parts(sql, "customers", "transactions", "enriched")


def query(sql: str | None = None):
    """Register a function of (spark, folder of tables) under its name, with its SQL if it has one."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register
