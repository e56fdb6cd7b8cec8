"""Sources and sinks, written and read back."""

from pyspark.sql import functions as F

from txnflow.checks.registry import AS_OF, query, with_enriched, with_parts
from txnflow.checks.relational import IMPORTED_SQL, enriched
from txnflow.checks.tables import TIME, customers, event_messages, table, transactions
from txnflow.functions.messages import decode_json
from txnflow.operators.history import card_history, cluster_by_card
from txnflow.operators.keyed import latest_by_key, upsert
from txnflow.operators.route import route_by_label, union_tables
from txnflow.plans.importing import run_import
from txnflow.schemas import CUSTOMER, FRAUD, LABELLED_TRANSACTION, NON_FRAUD, TRANSACTION_KEY
from txnflow.sinks.keyed import create_keyed_table, read_keyed_table, upsert_keyed_table
from txnflow.sinks.replay import await_replay, publish, replay_messages, replay_rows, start_replay
from txnflow.sinks.tables import save_routes_apart, save_table
from txnflow.sources.json_schema import infer_json_schema
from txnflow.sources.tables import load_table, read_csv, read_csv_infer, read_csv_marked, rejects
from txnflow.sources.topics import dump_topic
from txnflow.workspace import exists, job_scope, materialize, path_of, scratch_path


def raw_transactions(spark, sf_dir):
    """Transactions with all columns of the CSV input."""
    day = F.datediff(F.to_date(F.substring("trans_date", 1, 10)), F.lit("1970-01-01").cast("date"))
    names = customers(spark, sf_dir).select("cc_num", "first", "last")
    rows = transactions(spark, sf_dir, holders=names).withColumn(
        "unix_time", day.cast("bigint") * 86400 + F.substring("trans_time", 1, 2).cast("bigint") * 3600)
    return rows.select(*[c.split()[0] for c in LABELLED_TRANSACTION.split(", ")])


def _write_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    # As files of text these rows take several times what they take in parquet.
    save_table(df, "csv", path=path, header=True, compression="gzip")
    return path


@query(with_parts("""
select cc_num, first, last, trans_num, trans_date, trans_time, cast(epoch(ts) as bigint) as unix_time, category,
  merchant, amt, merch_lat, merch_long, is_fraud
from transactions join (select cc_num, first, last from customers) using (cc_num)""", "customers", "transactions"))
def csv_scan_schema(spark, sf_dir):
    return read_csv(spark, _write_csv(raw_transactions(spark, sf_dir), "transactions-csv"), LABELLED_TRANSACTION)


@query(with_parts("""
select trans_num, case when trans_time = '07:00:00' then 'amt' else 'amt, is_fraud' end as reason
from transactions where trans_time in ('06:00:00', '07:00:00')""", "transactions"))
def csv_rejects(spark, sf_dir):
    """Two of the hours have amounts that are no numbers, one also such labels."""
    bad, worse = F.col("trans_time").isin("06:00:00", "07:00:00"), F.col("trans_time") == "06:00:00"
    rows = raw_transactions(spark, sf_dir).withColumn("amt", F.when(bad, F.lit("n/a")).otherwise(F.col("amt").cast("string"))).withColumn(
        "is_fraud", F.when(worse, F.lit("?")).otherwise(F.col("is_fraud").cast("string")))
    return rejects(read_csv_marked(spark, _write_csv(rows, "transactions-csv"), LABELLED_TRANSACTION)).select("trans_num", "reason")


@query(with_parts("select * from customers", "customers"))
def csv_scan_customers(spark, sf_dir):
    rows = read_csv(spark, _write_csv(customers(spark, sf_dir), "customers-csv"), CUSTOMER)
    return rows.withColumn("dob", F.col("dob").cast(TIME))


@query(with_parts("""
select cast(cc_num as integer) as cc_num, first, last, gender, street, city, state, cast(zip as integer) as zip,
  lat, long, job, dob from customers""", "customers"))
def csv_scan_infer(spark, sf_dir):
    """Inference takes card numbers and zip codes for integers."""
    rows = read_csv_infer(spark, _write_csv(customers(spark, sf_dir), "customers-csv"))
    return rows.withColumn("dob", F.col("dob").cast(TIME))


@query("""
select 'events' as topic, cast(event_id % 4 as integer) as "partition", event_id // 4 as "offset",
  cast(user_id as varchar) as key, cast(json_extract(props, '$.k') as bigint) as k
from events""")
def topic_dump(spark, sf_dir):
    path = scratch_path(spark, "topic")
    publish(event_messages(table(spark, sf_dir, "events")), "parquet", path=path)
    return dump_topic(spark, "k bigint", fmt="parquet", path=path)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_schema_infer(spark, sf_dir):
    """The events' properties under the schema found in them."""
    events = table(spark, sf_dir, "events")
    schema = infer_json_schema(events, "props")
    return events.select("event_id", decode_json("props", schema).alias("found")).select("event_id", "found.*")


@query(with_parts("select * from customers", "customers"))
def table_overwrite(spark, sf_dir):
    """A table written twice; the second write replaces the first."""
    path = scratch_path(spark, "customer")
    rows = customers(spark, sf_dir)
    save_table(rows.withColumn("city", F.lit("to be replaced")), path=path)
    save_table(rows, path=path)
    return load_table(spark, path=path)


@query(with_enriched("""
select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud
from (
  select *, row_number() over (partition by cc_num, trans_time
    order by category = 'ECONOMY' desc, trans_num desc, amt desc) as key_rank
  from enriched)
where key_rank = 1"""))
def keyed_upsert(spark, sf_dir):
    """All transactions but one category's as the stored table, that category's as the later writes."""
    rows = enriched(spark, sf_dir).withColumn("later", (F.col("category") == "ECONOMY").cast("int")).where(F.col("later").isNotNull())
    path = scratch_path(spark, "keyed")
    # Both are ranked and written by one pass, so that the transactions are derived once.
    save_table(latest_by_key(rows, [*TRANSACTION_KEY, "later"]), partition_by=["later"], path=path)
    stored = load_table(spark, path=path)
    return upsert(stored.where("later = 0").drop("later"), stored.where("later = 1").drop("later"), ranked=True)


@query(with_parts("""
select cc_num as key, to_json({
  'cc_num': cc_num, 'first': first, 'last': last, 'trans_num': trans_num, 'trans_time': '2024-01-01 00:00:00',
  'category': category, 'merchant': merchant, 'amt': cast(amt as varchar), 'merch_lat': cast(merch_lat as varchar),
  'merch_long': cast(merch_long as varchar)})::varchar as value
from transactions join (select cc_num, first, last from customers) using (cc_num)
where is_fraud = 1 order by trans_num, amt limit 10""", "customers", "transactions"))
def replay_json(spark, sf_dir):
    rows = raw_transactions(spark, sf_dir)
    return replay_messages(rows, 10, "2024-01-01 00:00:00", ["trans_num", "amt"])


@query(with_parts("""
select cc_num as key, trans_num, cast(number // 100 as integer) as batch_id,
  strftime(timestamp '2024-01-01 00:00:00' + to_seconds(number // 100 * 6), '%Y-%m-%d %H:%M:%S') as trans_time
from (select cc_num, trans_num, row_number() over (order by trans_num) - 1 as number
      from transactions join (select cc_num from customers) using (cc_num) where is_fraud = 1)""", "customers", "transactions"))
def replay_paced(spark, sf_dir):
    """All fraud rows sent in batches of 100, each stamped 6 seconds after the one before; what each batch has sent."""
    rows, path = replay_rows(raw_transactions(spark, sf_dir)), scratch_path(spark, "topic")
    clock = start_replay(rows, scratch_path(spark, "checkpoint"), 100, "0 seconds", "2024-01-01 00:00:00", 6, fmt="parquet", path=path)
    await_replay(clock, rows, 100)
    sent = spark.read.schema("key string, value string, batch_id int").option("basePath", path).parquet(path)
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return sent.select("key", field("trans_num"), "batch_id", field("trans_time"))


@query(with_enriched(IMPORTED_SQL))
def import_from_csv(spark, sf_dir):
    """The import job from CSV files to stored tables."""
    output = scratch_path(spark, "imported")
    run_import(spark, _write_csv(raw_transactions(spark, sf_dir), "transactions-csv"),
               _write_csv(customers(spark, sf_dir), "customers-csv"), output, AS_OF, TIME)
    return load_table(spark, path=f"{output}/transaction")


@query(with_enriched("""
select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud
from enriched where is_fraud in (0, 1)"""))
def save_routes_separately(spark, sf_dir):
    """Both routes written to tables of their own, read back and united."""
    targets = {r: {"path": scratch_path(spark, r)} for r in (FRAUD, NON_FRAUD)}
    save_routes_apart(route_by_label(enriched(spark, sf_dir)), targets, "parquet")
    return union_tables(*[load_table(spark, **targets[r]) for r in (FRAUD, NON_FRAUD)])


@query(with_enriched("""
select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud
from (
  select *, row_number() over (partition by cc_num, trans_time
    order by category = 'ECONOMY' desc, trans_num desc, amt desc) as key_rank
  from enriched)
where key_rank = 1"""))
def keyed_table_upsert(spark, sf_dir):
    """All transactions but one category's as a stored keyed table, that category's written into it; the rows in force."""
    later = F.col("category") == "ECONOMY"
    # Stored once, for the joins behind both writes would be made twice; of what each write keeps, since keys are together behind the join with the holders.
    rows = enriched(spark, sf_dir).withColumn("later", later).where(F.col("later").isNotNull())
    rows = materialize(latest_by_key(rows, [*TRANSACTION_KEY, "later"]).drop("later"), "transaction")
    path = scratch_path(spark, "keyed")
    create_keyed_table(rows.where(~later), path)
    upsert_keyed_table(spark, path, rows.where(later), stored=True)
    return read_keyed_table(spark, path, rows.schema)


@query(with_enriched("""
select cc_num, trans_time, trans_num, category, merchant, amt, merch_lat, merch_long, distance, age, is_fraud
from (
  select *, row_number() over (partition by cc_num, trans_time order by trans_num desc, amt desc) as key_rank
  from enriched)
where key_rank = 1 and cc_num = (select min(cast(o_custkey as varchar)) from orders)"""))
def keyed_read_card(spark, sf_dir):
    """One card's rows from a keyed table whose months are dealt by card."""
    path, rows = scratch_path(spark, "keyed"), enriched(spark, sf_dir)
    create_keyed_table(rows, path, shards=4)
    card = rows.agg(F.min("cc_num")).first()[0]
    return read_keyed_table(spark, path, rows.schema, card=card)


@query(with_enriched("select cc_num, trans_time, trans_num, amt from enriched order by 1, 2 desc, 3 desc, 4 desc"))
def clustered_history(spark, sf_dir):
    """The history of every card from a stored table laid out by card."""
    path = scratch_path(spark, "clustered")
    save_table(cluster_by_card(enriched(spark, sf_dir)), path=path)
    stored = load_table(spark, path=path).select("cc_num", "trans_time", "trans_num", "amt")
    return card_history(stored, ties=["trans_num", "amt"])


@query(with_enriched("""
select category, count(*) as n, round(sum(amt), 2) as total, cast(1 as bigint) as tables_left from enriched group by category"""))
def scoped_tables(spark, sf_dir):
    """Totals of a stored table that a scope removes, kept beyond it, and how many of its three stored tables are left."""
    with job_scope(spark) as scope:
        rows = materialize(enriched(spark, sf_dir), "scoped")
        label = materialize(rows.groupBy("category", "is_fraud").agg(F.count(F.lit(1)).alias("n"), F.sum("amt").alias("total")), "scoped")
        kept = scope.keep(label.groupBy("category").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total")), "scoped")
    left = sum(exists(spark, path_of(df)) for df in (rows, label, kept))
    return kept.withColumn("tables_left", F.lit(left).cast("bigint"))
