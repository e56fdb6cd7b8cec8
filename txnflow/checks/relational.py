"""Projections, scalar functions, joins, aggregates, sorts and set operations."""

from pyspark.sql import functions as F

from txnflow.checks.registry import (
    AS_OF, CUSTOMERS_SQL, distance_sql, query, with_enriched, with_parts, with_transactions,
)
from txnflow.checks.tables import (
    TIME, customers, event_messages, table, timed_transactions, transactions,
)
from txnflow.functions.geo import haversine as haversine_km
from txnflow.functions.hashing import key_fraction
from txnflow.functions.messages import cast_numbers, flatten_json
from txnflow.functions.times import age_in_years, date_prefix as date_part, normalize_time as full_times
from txnflow.operators import history, keyed, metrics, route, split
from txnflow.operators.enrich import enrich as with_holder
from txnflow.operators.sizing import broadcast_if_small
from txnflow.plans.importing import import_transactions as imported
from txnflow.schemas import ENRICHED, LABEL
from txnflow.sinks.keyed import read_keyed_table, store_offsets
from txnflow.sources.tables import load_table, rows_to_df
from txnflow.workspace import materialize, scratch_path


def enriched(spark, sf_dir):
    return with_holder(timed_transactions(spark, sf_dir), customers(spark, sf_dir), AS_OF)


# --- flagship ---

IMPORTED_SQL = """
select route, cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud
from (
  select *, case when is_fraud = 1 then 'fraud' when is_fraud = 0 then 'non_fraud' end as route,
    row_number() over (partition by is_fraud, cc_num, trans_time order by trans_num desc, amt desc) as key_rank
  from enriched)
where key_rank = 1 and route is not null"""


@query(with_enriched(IMPORTED_SQL))
def import_transactions(spark, sf_dir):
    """Raw transactions to the rows of both keyed tables."""
    return imported(transactions(spark, sf_dir), customers(spark, sf_dir), AS_OF, TIME)


# --- scans, projections, filters ---

@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def table_scan(spark, sf_dir):
    return load_table(spark, path=f"{sf_dir}/customer.parquet")


@query(with_transactions("""
select route, count(*) as n, round(sum(amt), 2) as total from transactions
join (values (cast(1 as double), 'fraud'), (cast(0 as double), 'non_fraud')) as names(is_fraud, route) using (is_fraud)
group by route""", ()))
def inline_relation(spark, sf_dir):
    """Two rows given by the caller, joined with all transactions."""
    names = rows_to_df(spark, [(1.0, "fraud"), (0.0, "non_fraud")], "is_fraud double, route string")
    rows = transactions(spark, sf_dir, ["amt", LABEL])
    return rows.join(F.broadcast(names), LABEL).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("total")
    )


@query(with_enriched(
    "select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age from enriched"
))
def project_canonical(spark, sf_dir):
    return enriched(spark, sf_dir).select(*ENRICHED)


@query("""
select cast(event_id % 4 as integer) as "partition", event_id // 4 as "offset",
  cast(json_extract(props, '$.k') as bigint) as k
from events""")
def json_flatten(spark, sf_dir):
    return flatten_json(event_messages(table(spark, sf_dir, "events")), "k bigint", keep=["partition", "offset"])


@query(with_transactions("""
select cc_num, trans_num, trans_date, category, amt from transactions where is_fraud = 1""", ("orders", "part")))
def filter_label(spark, sf_dir):
    columns = ["cc_num", "trans_num", "trans_date", "category", "amt", LABEL]
    return route.with_label(transactions(spark, sf_dir, columns), 1).drop(LABEL)


@query(with_transactions("""
select trans_num, is_fraud, case when is_fraud = 1 then 'fraud' else 'non_fraud' end as route
from transactions where is_fraud in (0, 1)""", ()))
def route_by_label(spark, sf_dir):
    return route.route_by_label(transactions(spark, sf_dir, ["trans_num", LABEL]))


# --- scalar functions ---

@query(with_transactions("select trans_num, split_part(trans_date, 'T', 1) as trans_date from transactions", ("orders",)))
def date_prefix(spark, sf_dir):
    rows = transactions(spark, sf_dir, ["trans_num", "trans_date"])
    return rows.withColumn("trans_date", date_part("trans_date"))


@query(with_transactions("select trans_num, split_part(trans_date, 'T', 1) as trans_date, ts as trans_time from transactions", ("orders",)))
def normalize_time(spark, sf_dir):
    return full_times(transactions(spark, sf_dir, ["trans_num", "trans_date", "trans_time"]), TIME)


@query(with_parts(f"""
select cc_num, cast(dob as date) as born,
  cast(trunc(date_diff('day', cast(dob as date), date '{AS_OF}') / cast(365 as double)) as integer) as age
from customers""", "customers"))
def customer_age(spark, sf_dir):
    return customers(spark, sf_dir).select("cc_num", F.to_date("dob").alias("born"), age_in_years("dob", AS_OF).alias("age"))


def _distances(spark, sf_dir, variant):
    rows = transactions(spark, sf_dir, ["cc_num", "trans_num", "merch_lat", "merch_long"])
    homes = broadcast_if_small(customers(spark, sf_dir).select("cc_num", "lat", "long"))
    km = F.round(haversine_km("lat", "long", "merch_lat", "merch_long", variant), 6)
    return rows.join(homes, "cc_num").select("trans_num", km.alias("km"))


def _distances_sql(angle):
    return with_transactions(
        f",{CUSTOMERS_SQL} select trans_num, round({distance_sql('lat', 'long', 'merch_lat', 'merch_long', angle)}, 6) as km "
        "from transactions join customers using (cc_num)", ("orders",))


@query(_distances_sql("radians"))
def haversine(spark, sf_dir):
    return _distances(spark, sf_dir, "radians")


@query(_distances_sql(""))
def haversine_degrees(spark, sf_dir):
    """The variant that leaves the latitudes in degrees."""
    return _distances(spark, sf_dir, "degrees")


@query(with_transactions("""
select trans_num, try_cast(cast(amt as varchar) as double) as amt, try_cast(category as double) as merch_lat,
  try_cast(concat(' ', cast(merch_long as varchar)) as double) as merch_long
from transactions""", ("part",)))
def cast_numeric(spark, sf_dir):
    """Text to double; ``merch_lat`` holds words here, so all of it becomes NULL."""
    rows = transactions(spark, sf_dir, ["trans_num", "amt", "category", "merch_long"]).select(
        "trans_num", F.col("amt").cast("string").alias("amt"), F.col("category").alias("merch_lat"),
        F.concat(F.lit(" "), F.col("merch_long").cast("string")).alias("merch_long"),
    )
    return cast_numbers(rows)


# --- joins ---

@query(with_enriched("select * from enriched"))
def enrich(spark, sf_dir):
    return enriched(spark, sf_dir)


@query(with_enriched("select * from enriched"))
def enrich_shuffled(spark, sf_dir):
    """The same join without a broadcast, as for customers that are too many for one."""
    return with_holder(timed_transactions(spark, sf_dir), customers(spark, sf_dir), AS_OF, broadcast_limit=0)


# --- aggregates ---

@query(with_transactions("select is_fraud, count(*) as n from transactions group by is_fraud", ()))
def count_by_label(spark, sf_dir):
    return metrics.count_by_label(transactions(spark, sf_dir, [LABEL]))


@query(with_transactions("select round(sum(amt), 2) as total from transactions", ()))
def sum_amount(spark, sf_dir):
    return metrics.sum_amount(transactions(spark, sf_dir, ["amt"])).select(F.round("total", 2).alias("total"))


FRACTION_SQL = "cast(concat('0x', substr(md5(trans_num), 1, 8)) as ubigint) / cast(4294967296 as double)"


@query(with_transactions(f"""
, predicted as (
  select is_fraud as label, case when {FRACTION_SQL} < 0.1 then cast(1 as double) else cast(0 as double) end as prediction
  from transactions),
classes as (
  select class, sum(actual) as actual, sum(predicted) as predicted, sum(hit) as hits from (
    select label as class, 1 as actual, 0 as predicted, case when label = prediction then 1 else 0 end as hit from predicted
    union all
    select prediction, 0, 1, 0 from predicted)
  group by class)
select round(sum(2 * hits / cast(actual + predicted as double) * actual) / sum(actual), 12) as weighted_f1 from classes""", ()))
def weighted_f1(spark, sf_dir):
    rows = transactions(spark, sf_dir, ["trans_num", LABEL])
    guess = F.when(key_fraction("trans_num") < 0.1, 1.0).otherwise(0.0)
    scored = metrics.weighted_f1(rows.withColumn("prediction", guess), LABEL)
    return scored.select(F.round("weighted_f1", 12).alias("weighted_f1"))


@query("""
select cast(event_id % 4 as integer) as "partition", max(event_id // 4) as "offset" from events group by all""")
def offset_ledger(spark, sf_dir):
    """The ledger written in two parts, the later part of the topic first, and read back."""
    path = scratch_path(spark, "offsets")
    messages = event_messages(table(spark, sf_dir, "events"))
    for part in (F.col("offset") % 2 == 1, F.col("offset") % 2 == 0):
        store_offsets(spark, path, keyed.latest_offsets(messages.where(part)))
    return read_keyed_table(spark, path, "partition int, offset bigint")


# --- sorts and limits ---

@query('select user_id, event_type, value, ts as "timestamp" from events order by ts desc')
def latest_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").alias("timestamp"))
    return history.newest_first(events)


@query('select event_id, user_id, event_type, value, ts as "timestamp" from events order by ts desc, event_id desc limit 5')
def top_k_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").alias("timestamp"))
    return history.newest(events, 5, ties=["event_id"])


@query(with_transactions("select cc_num, ts as trans_time, trans_num, amt from transactions order by 1, 2 desc, 3 desc, 4 desc", ("orders",)))
def card_history(spark, sf_dir):
    rows = transactions(spark, sf_dir, ["cc_num", "ts", "trans_num", "amt"]).withColumnRenamed("ts", "trans_time")
    return history.card_history(rows, ties=["trans_num", "amt"])


# --- set operations and splits ---

@query(with_transactions("select cc_num, trans_num, trans_date, amt, is_fraud from transactions where is_fraud in (0, 1)", ("orders",)))
def union_tables(spark, sf_dir):
    rows = transactions(spark, sf_dir, ["cc_num", "trans_num", "trans_date", "amt", LABEL])
    return route.union_tables(route.with_label(rows, 1), route.with_label(rows, 0))


@query(with_transactions("""
select trans_num, amt, cast(1 as double) as label from transactions where is_fraud = 1
union all
select concat(cc_num, '/', category) as trans_num, round(avg(amt), 6) as amt, cast(0 as double) as label
from transactions where is_fraud = 0 group by cc_num, category""", ("orders", "part")))
def label_union(spark, sf_dir):
    """Fraud rows and averages standing in for cluster centres, with their labels."""
    rows = transactions(spark, sf_dir, ["cc_num", "trans_num", "category", "amt", LABEL])
    positives = route.with_label(rows, 1).select("trans_num", "amt")
    negatives = route.with_label(rows, 0).groupBy(F.concat_ws("/", "cc_num", "category").alias("trans_num")).agg(
        F.round(F.avg("amt"), 6).alias("amt"))
    return route.label_union(positives, negatives)


@query(with_transactions(f"""
select trans_num, amt, is_fraud, case when {FRACTION_SQL} < 0.7 then 'train' else 'test' end as side from transactions""", ()))
def hash_split(spark, sf_dir):
    train, test = split.hash_split(transactions(spark, sf_dir, ["trans_num", "amt", LABEL]))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("""
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as trans_num, l_extendedprice as amt,
  case when (l_orderkey * 7 + l_linenumber * 13) % 200 = 0 then cast(1 as double) else cast(0 as double) end as is_fraud
from lineitem""")
def random_split(spark, sf_dir):
    """Both sides together: all rows once. Which side a row is on depends on the partitioning."""
    rows = materialize(transactions(spark, sf_dir, ["trans_num", "amt", LABEL]), "rows")
    train, test = split.random_split(rows)
    return train.unionByName(test)
