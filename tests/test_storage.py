"""Sources and sinks."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow import workspace
from txnflow.checks import storage
from txnflow.operators.route import route_by_label
from txnflow.plans.importing import run_import
from txnflow.schemas import CUSTOMER, LABELLED_TRANSACTION, OFFSETS, POINT_MESSAGE, TRANSACTION
from txnflow.sinks import keyed, manifests, replay
from txnflow.sinks.replay import MESSAGE_FIELDS, publish, replay_messages
from txnflow.sinks.tables import save_routes, save_routes_apart, save_table
from txnflow.sources.json_schema import infer_json_schema
from txnflow.sources.tables import BAD_LINE, load_table, read_csv, read_csv_infer, read_csv_marked, rejects, rows_to_df
from txnflow.sources.topics import dump_topic, read_topic

TS = datetime.datetime


def test_schemas_are_separate():
    from pyspark.sql.types import StructType

    assert len(StructType.fromDDL(TRANSACTION)) == 12
    assert len(StructType.fromDDL(LABELLED_TRANSACTION)) == 13
    assert len(StructType.fromDDL(OFFSETS)) == 2


def test_csv_binds_by_position_and_keeps_bad_rows(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text('a,b,c\n1.5,2,"x, y"\nno number,3,z\n,,\n')
    rows = read_csv(spark, str(path), POINT_MESSAGE).collect()
    assert [tuple(r) for r in rows] == [(1.5, 2.0, "x, y"), (None, 3.0, "z"), (None, None, None)]
    assert read_csv_infer(spark, str(path)).dtypes == [("a", "string"), ("b", "int"), ("c", "string")]


def test_bad_lines_have_reasons(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b,c\n1,2,x\nq,2,y\n3,w,\n4\n5,6,z,more\n,,\n")
    marked = read_csv_marked(spark, str(tmp_path / "in.csv"), "a int, b double, c string")
    found = {r.line: (r.reason, r.a, r.b) for r in rejects(marked).collect()}
    assert found == {"q,2,y": ("a", None, 2.0), "3,w,": ("b", 3, None), "4": ("cells", 4, None), "5,6,z,more": ("cells", 5, 6.0)}
    # What is selected doesn't change which lines are bad.
    assert [r.c for r in marked.select("c", F.col(BAD_LINE).isNotNull().alias("bad")).collect() if r.bad] == ["y", None, None, "z"]
    assert [r.a for r in marked.where(F.col(BAD_LINE).isNull()).select("a").collect()] == [1, None]
    assert marked.where(F.col(BAD_LINE).isNotNull()).count() == 4


def test_import_puts_bad_lines_into_quarantine(spark, customers, make_transactions, as_of, tmp_path):
    rows = make_transactions(dict(trans_num="t1"), dict(trans_num="t2", trans_date="2023-01-06T00:00:00.000Z"), dict(trans_num="t3"))
    spoilt = rows.withColumn("amt", F.when(F.col("trans_num") == "t3", "q").otherwise(F.col("amt").cast("string")))
    for df, name in ((spoilt, "transactions"), (customers, "customers")):
        save_table(df, "csv", path=str(tmp_path / name), header=True)
    counts = run_import(spark, str(tmp_path / "transactions"), str(tmp_path / "customers"), str(tmp_path / "out"), as_of,
                        quarantine=str(tmp_path / "bad"))
    assert (counts.routed, counts.unrouted, counts.rejected, counts.unknown_card, counts.bad_lines) == (2, 0, 0, 0, 1)
    assert [(r.trans_num, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("t3", "amt")]
    assert {r.trans_num for r in spark.read.parquet(str(tmp_path / "out" / "transaction")).collect()} == {"t1", "t2"}
    with pytest.raises(ValueError, match="quarantine"):
        run_import(spark, "t", "c", "o", source=("parquet", {}), quarantine="q")


def test_overwrite_replaces_and_append_adds(spark, tmp_path):
    path, rows = str(tmp_path / "t"), rows_to_df(spark, [(1, "a")], "n int, s string")
    for mode, count in [("overwrite", 1), ("append", 2), ("overwrite", 1)]:
        save_table(rows, mode=mode, path=path)
        assert load_table(spark, path=path).count() == count
    assert load_table(spark, schema="s string", path=path).columns == ["s"]


def test_routes_as_partitions_and_apart(spark, tmp_path):
    rows = route_by_label(rows_to_df(spark, [(1, 1.0), (2, 0.0), (3, None)], "n int, is_fraud double"))
    save_routes(rows, path=str(tmp_path / "one"))
    one = load_table(spark, path=str(tmp_path / "one"))
    assert {(r["n"], r["route"]) for r in one.collect()} == {(1, "fraud"), (2, "non_fraud")}
    save_routes_apart(rows, {r: {"path": str(tmp_path / r)} for r in ("fraud", "non_fraud")}, "parquet")
    assert [r["n"] for r in load_table(spark, path=str(tmp_path / "fraud")).collect()] == [1]


KEYED = "cc_num string, trans_time timestamp, trans_num string, amt double"
D1, D2, D3 = TS(2023, 1, 1, 5), TS(2023, 1, 2, 5), TS(2023, 1, 3, 5)


def stored_rows(spark, path):
    return {tuple(r) for r in keyed.read_keyed_table(spark, path, KEYED).collect()}


def test_keyed_table_writes_only_the_days_that_come_in(spark, tmp_path):
    path = str(tmp_path / "keyed")
    keyed.create_keyed_table(rows_to_df(spark, [("1", D1, "a", 1.0), ("1", D1, "b", 2.0), ("1", D2, "c", 3.0)], KEYED), path, granularity="day")
    assert stored_rows(spark, path) == {("1", D1, "b", 2.0), ("1", D2, "c", 3.0)}
    later = rows_to_df(spark, [("1", D2, "a", 7.0), ("2", D2, "x", 8.0), ("2", D3, "y", 9.0), ("2", None, "n", 1.0)], KEYED)
    keyed.upsert_keyed_table(spark, path, later)
    expected = {("1", D1, "b", 2.0), ("1", D2, "a", 7.0), ("2", D2, "x", 8.0), ("2", D3, "y", 9.0)}
    assert stored_rows(spark, path) == expected
    assert [len(list(tmp_path.glob(f"keyed/version=*/day={d}"))) for d in ("2023-01-01", "2023-01-02", "2023-01-03")] == [1, 2, 1]
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [], KEYED))
    keyed.remove_unused_versions(spark, path)
    assert stored_rows(spark, path) == expected and len(list(tmp_path.glob("keyed/_manifest/0*"))) == 1
    assert keyed.read_keyed_table(spark, path, KEYED, ["2023-01-03"]).count() == 1


def test_a_write_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keyed")
    rows = rows_to_df(spark, [(str(i), D1, "a", float(i)) for i in range(5)], KEYED)
    keyed.upsert_keyed_table(spark, path, rows)
    change = rows_to_df(spark, [("3", D1, "b", 99.0)], KEYED)
    switch = keyed.put_manifest

    def lost(*_):
        raise RuntimeError("lost before the switch")

    monkeypatch.setattr(keyed, "put_manifest", lost)
    with pytest.raises(RuntimeError, match="lost"):
        keyed.upsert_keyed_table(spark, path, change)
    assert len(stored_rows(spark, path)) == 5 and ("3", D1, "a", 3.0) in stored_rows(spark, path)
    monkeypatch.setattr(keyed, "put_manifest", switch)
    keyed.upsert_keyed_table(spark, path, change)
    assert len(stored_rows(spark, path)) == 5 and ("3", D1, "b", 99.0) in stored_rows(spark, path)
    # Of two writers that began from the same state the second is told so.
    before = keyed._manifest(spark, path)
    switch(spark, path, before[0] + 1, before[1])
    with pytest.raises(RuntimeError, match="another writer"):
        switch(spark, path, before[0] + 1, before[1])


def test_a_new_keyed_table_is_written_once(spark, tmp_path, monkeypatch):
    """No copy of the rows is stored before the version, and its periods are those that rows were written for."""
    def refuse(df, name):
        raise AssertionError(f"{name} stored on the way")

    rows = [(str(i % 3), TS(2023, 1 + i % 4, 1 + i // 4), f"t{i}", float(i)) for i in range(40)] + [("1", None, "no time", 0.0), (None, TS(2024, 1, 1), "no card", 0.0)]
    monkeypatch.setattr(keyed, "materialize", refuse)
    for granularity, shards, expected in (("month", 0, 4), ("month", 2, 4), ("day", 0, 40), ("year", 0, 1)):
        path = str(tmp_path / f"{granularity}{shards}")
        keyed.create_keyed_table(rows_to_df(spark, rows, KEYED), path, granularity=granularity, shards=shards)
        assert len(keyed._manifest(spark, path)[1]["periods"]) == expected
        assert sorted(r["trans_num"] for r in keyed.read_keyed_table(spark, path, KEYED).collect()) == sorted(f"t{i}" for i in range(40))
    keyed.create_keyed_table(rows_to_df(spark, rows[-1:], KEYED), str(tmp_path / "none"))
    assert keyed.read_keyed_table(spark, str(tmp_path / "none"), KEYED).isEmpty()


def test_the_first_upsert_is_written_once(spark, tmp_path, monkeypatch):
    """Into a table without rows: no copy is stored before the version, notes come with it, and without rows or notes nothing is noted."""
    def refuse(df, name):
        raise AssertionError(f"{name} stored on the way")

    path, rows = str(tmp_path / "keyed"), [("1", D1, "a", 1.0), ("1", D1, "b", 2.0), ("2", D3, "c", 3.0), ("2", None, "n", 1.0)]
    with monkeypatch.context() as patched:
        patched.setattr(keyed, "materialize", refuse)
        keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [], KEYED))
        assert keyed._manifest(spark, path)[0] == 0
        keyed.upsert_keyed_table(spark, path, rows_to_df(spark, rows[3:], KEYED), notes={"batch_id": 0}, granularity="day")
        assert keyed.notes_of(spark, path) == {"batch_id": 0}
        keyed.upsert_keyed_table(spark, path, rows_to_df(spark, rows, KEYED), notes={"batch_id": 1})
    assert stored_rows(spark, path) == {("1", D1, "b", 2.0), ("2", D3, "c", 3.0)}
    assert keyed.notes_of(spark, path) == {"batch_id": 1} and len(list(tmp_path.glob("keyed/version=*/day=*"))) == 2
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [("1", D1, "a", 9.0)], KEYED), ranked=True)
    assert stored_rows(spark, path) == {("1", D1, "a", 9.0), ("2", D3, "c", 3.0)}


def test_periods_are_months_unless_told(spark, tmp_path):
    path = str(tmp_path / "keyed")
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [("1", D1, "a", 1.0), ("1", D3, "b", 2.0), ("1", TS(2023, 2, 1), "c", 3.0)], KEYED))
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [("2", D2, "d", 4.0)], KEYED), granularity="day")
    assert [len(list(tmp_path.glob(f"keyed/version=*/month=2023-{m}"))) for m in ("01", "02")] == [2, 1]
    assert keyed.read_keyed_table(spark, path, KEYED, ["2023-01"]).count() == 3 and len(stored_rows(spark, path)) == 4


def test_a_writer_that_died_in_its_switch_blocks_nobody_for_long(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keyed")
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [("1", D1, "a", 1.0)], KEYED))
    (tmp_path / "keyed" / "_manifest" / f"{2:012d}").touch()
    assert stored_rows(spark, path) == {("1", D1, "a", 1.0)}
    later = rows_to_df(spark, [("2", D1, "b", 2.0)], KEYED)
    with pytest.raises(RuntimeError, match="another writer"):
        keyed.upsert_keyed_table(spark, path, later)
    monkeypatch.setattr(manifests, "DEAD_SECONDS", -1)
    keyed.upsert_keyed_table(spark, path, later)
    assert stored_rows(spark, path) == {("1", D1, "a", 1.0), ("2", D1, "b", 2.0)}


def files_read(df):
    """Files that the scan of ``df`` is planned to open."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.selectedPartitions().totalNumberOfFiles()


def test_one_card_reads_the_files_of_its_shard(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = [(str(i % 40), TS(2023, 1 + i % 3, 1, i % 24, i % 60), f"t{i:03}", float(i)) for i in range(600)]
    # One card has a third of all rows.
    rows += [("7", TS(2023, 1 + i % 3, 2, i % 24, i % 60), f"u{i:03}", float(i)) for i in range(300)]
    keyed.create_keyed_table(rows_to_df(spark, rows, KEYED), path, shards=8)
    whole = keyed.read_keyed_table(spark, path, KEYED)
    assert whole.columns == ["cc_num", "trans_time", "trans_num", "amt"]
    for card in ("7", "12", "none"):
        one = keyed.read_keyed_table(spark, path, KEYED, card=card)
        assert one.columns == whole.columns and sorted(one.collect()) == sorted(whole.where(F.col("cc_num") == card).collect())
        assert files_read(one) <= 3 < 20 < files_read(whole)
    january = keyed.read_keyed_table(spark, path, KEYED, ["2023-01"], card="7")
    assert files_read(january) == 1 and january.count() == whole.where("cc_num = '7' and month(trans_time) = 1").count()
    # Later writes keep the shards, whatever they ask for, and replace rows of equal key.
    keyed.upsert_keyed_table(spark, path, rows_to_df(spark, [("7", TS(2023, 1, 2, 0, 0), "z", -1.0), ("7", TS(2024, 5, 1), "y", -2.0)], KEYED))
    again = keyed.read_keyed_table(spark, path, KEYED, card="7")
    assert sorted(r["trans_num"] for r in again.where("amt < 0").collect()) == ["y", "z"] and files_read(again) == 4
    assert keyed.read_keyed_table(spark, path, KEYED).count() == whole.count() + 1


def test_paced_replay(spark, make_transactions, tmp_path):
    """Seven rows, three a batch and one batch a second; killed in the second batch and begun again."""
    rows = make_transactions(*[dict(trans_num=f"t{i}", cc_num=str(i % 2), is_fraud=1.0) for i in range(7)], dict(trans_num="t9"))
    waiting = replay.replay_rows(rows, ["trans_num"])
    out, cp, begun = str(tmp_path / "out"), str(tmp_path / "cp"), time.monotonic()
    send = lambda **options: replay.start_replay(
        waiting, cp, 3, "1 second", "2024-01-01 00:00:00", 6, fmt="parquet", path=out, **options)
    with pytest.raises(Exception, match="mode|Mode"):
        send(compression="mode that is none").awaitTermination()
    spark.streams.resetTerminated()
    replay.await_replay(send(), waiting, 3)
    assert time.monotonic() - begun >= 2 and not spark.streams.active
    sent = {(r["batch_id"], r["key"], *(json.loads(r["value"])[c] for c in ("trans_num", "trans_time"))) for r in spark.read.parquet(out).collect()}
    assert sent == {(i // 3, str(i % 2), f"t{i}", f"2024-01-01 00:00:{i // 3 * 6:02}") for i in range(7)}
    empty = replay.replay_rows(rows.where("is_fraud = 7"), ["trans_num"])
    replay.await_replay(replay.start_replay(empty, str(tmp_path / "cp2"), 3, fmt="parquet", path=str(tmp_path / "none")), empty, 3)
    assert not (tmp_path / "none").exists() and not spark.streams.active


def test_batches_without_time_between_them_go_out_together(spark, make_transactions, tmp_path):
    """300 batches of two rows in one trigger, each in its folder and with its stamp; a trigger that is repeated replaces them."""
    rows = make_transactions(*[dict(trans_num=f"t{i:04}", is_fraud=1.0) for i in range(600)])
    waiting, out = replay.replay_rows(rows, ["trans_num"]), str(tmp_path / "out")
    for checkpoint in ("cp1", "cp2"):
        query = replay.start_replay(waiting, str(tmp_path / checkpoint), 2, "0 seconds", "2024-01-01 00:00:00", 6, fmt="parquet", path=out)
        replay.await_replay(query, waiting, 2)
        assert query.recentProgress[0]["sources"][0]["numInputRows"] >= 600
        sent = sorted((r["batch_id"], *(json.loads(r["value"])[c] for c in ("trans_num", "trans_time"))) for r in spark.read.parquet(out).collect())
        stamp = lambda batch: str(TS(2024, 1, 1) + datetime.timedelta(seconds=6 * batch))
        assert sent == [(i // 2, f"t{i:04}", stamp(i // 2)) for i in range(600)]


def test_offsets_only_grow(spark, tmp_path):
    path = str(tmp_path / "offsets")
    for rows in ([(0, 5), (1, 7)], [(0, 3), (2, 1)], [(1, 9)]):
        keyed.store_offsets(spark, path, rows_to_df(spark, rows, OFFSETS))
    assert {tuple(r) for r in keyed.read_keyed_table(spark, path, OFFSETS).collect()} == {(0, 5), (1, 9), (2, 1)}


def test_topic_of_files(spark, tmp_path):
    path = str(tmp_path / "topic")
    rows = [(bytearray(b"k"), bytearray(b'{"x":1,"y":2,"z":"3"}'), "t", 0, 1, TS(2023, 1, 1)),
            (None, bytearray(b"bad"), "t", 1, 2, TS(2023, 1, 1))]
    publish(rows_to_df(spark, rows, "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"),
            "parquet", path=path)
    found = dump_topic(spark, POINT_MESSAGE, fmt="parquet", path=path).orderBy("offset").collect()
    assert [tuple(r) for r in found] == [("t", 0, 1, "k", 1.0, 2.0, "3"), ("t", 1, 2, None, None, None, None)]
    assert read_topic(spark, "parquet", path=path).isStreaming


def test_json_schema_of_all_rows(spark):
    texts = ['{"a": 1, "b": {"c": [1, 2]}}', '{"a": 2.5, "VOID": "x", "e OBJECT<": null}', "not json", None]
    found = infer_json_schema(spark.createDataFrame([(t,) for t in texts], "s string"), "s")
    kinds = {f.name: f.dataType for f in found.fields}
    assert kinds == {"a": T.DoubleType(), "b": T.StructType([T.StructField("c", T.ArrayType(T.LongType()))]),
                     "VOID": T.StringType(), "e OBJECT<": T.StringType()}
    with pytest.raises(ValueError):
        infer_json_schema(spark.createDataFrame([("1",)], "s string"), "s")


def test_replay(spark, make_transactions):
    raw = make_transactions(*[{"trans_num": f"t{i:02}", "is_fraud": float(i % 2)} for i in range(30)])
    found = replay_messages(raw, 10, "2024-01-01 00:00:00").collect()
    assert len(found) == 10 and replay_messages(raw).count() == 15
    first = json.loads(found[0]["value"])
    assert list(first) == MESSAGE_FIELDS and first["trans_num"] == "t01" and first["amt"] == "10.5"
    assert first["trans_time"] == "2024-01-01 00:00:00" and found[0]["key"] == "1"
    stamped = json.loads(replay_messages(raw, n=1).first()["value"])["trans_time"]
    assert abs(TS.fromisoformat(stamped) - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)) < datetime.timedelta(hours=1)


def test_import_job(spark, customers, make_transactions, as_of, tmp_path):
    raw = make_transactions({}, {"trans_num": "t2", "is_fraud": 1.0, "trans_time": "01:00:00"},
                            {"trans_num": "t3", "trans_date": "bad"}, {"trans_num": "t4", "is_fraud": 5.0},
                            {"trans_num": "t5", "cc_num": "unheard of"})
    for name, rows in [("transactions", raw), ("customers", customers.unionByName(customers))]:
        save_table(rows, "csv", path=str(tmp_path / name), header=True)
    counts = run_import(spark, str(tmp_path / "transactions"), str(tmp_path / "customers"), str(tmp_path / "out"), as_of)
    # The card is listed twice in the input, so the join sees every row twice and the keyed table folds them.
    assert (counts.routed, counts.unrouted, counts.rejected, counts.unknown_card) == (4, 2, 2, 1)
    stored = load_table(spark, path=str(tmp_path / "out" / "transaction"))
    assert {(r["trans_num"], r["route"], r["age"]) for r in stored.collect()} == {("t1", "non_fraud", 24), ("t2", "fraud", 24)}
    assert load_table(spark, path=str(tmp_path / "out" / "customer")).count() == 2
    assert load_table(spark, path=str(tmp_path / "out" / "customer")).columns == [c.split()[0] for c in CUSTOMER.split(", ")]
    # From another format into tables of another, one for each route.
    save_table(raw, "orc", path=str(tmp_path / "raw"))
    save_table(customers, "orc", path=str(tmp_path / "holders"))
    targets = {t: {"path": str(tmp_path / "apart" / t)} for t in ("customer", "fraud", "non_fraud")}
    counts = run_import(spark, str(tmp_path / "raw"), str(tmp_path / "holders"), "", as_of, source=("orc", {}), target="orc", targets=targets)
    assert (counts.routed, counts.unknown_card) == (2, 1)
    assert [load_table(spark, "orc", **targets[t]).count() for t in ("customer", "fraud", "non_fraud")] == [2, 1, 1]


def test_workspace_uses_the_shared_folder(spark, monkeypatch):
    assert workspace.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert workspace.scratch_path(spark, "x") != workspace.scratch_path(spark, "x")

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "app"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError):
        workspace.shared_root(Session)


def test_a_scope_removes_what_was_stored_in_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_root", lambda _: str(tmp_path))
    rows = spark.range(5)
    with workspace.job_scope(spark) as outer:
        first = workspace.materialize(rows, "first")
        with workspace.job_scope(spark) as inner:
            second = workspace.materialize(first, "second")
            third = workspace.materialize(second, "third")
            workspace.release(second)
            assert len(list(tmp_path.iterdir())) == 2
            kept = inner.keep(third)
        assert kept.count() == 5 and len(list(tmp_path.iterdir())) == 2
        result = outer.keep(kept)
    assert result.count() == 5 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(RuntimeError), workspace.job_scope(spark):
        workspace.materialize(rows, "lost")
        raise RuntimeError
    assert len(list(tmp_path.iterdir())) == 1


def test_jobs_leave_the_shared_folder_empty(spark, customers, make_transactions, as_of, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(workspace, "shared_root", lambda _: str(shared))
    for name, rows in [("transactions", make_transactions({}, {"trans_num": "t2", "is_fraud": 1.0})), ("customers", customers)]:
        save_table(rows, "orc", path=str(tmp_path / name))
    targets = {t: {"path": str(tmp_path / "apart" / t)} for t in ("customer", "fraud", "non_fraud")}
    run_import(spark, str(tmp_path / "transactions"), str(tmp_path / "customers"), "", as_of, source=("orc", {}), targets=targets)
    assert not list(shared.iterdir())


def test_the_upsert_query_derives_its_rows_once(spark, tmp_path, monkeypatch):
    """Rows of a later write win over stored ones; rows of neither part, and repeated ones, are kept out."""
    seen = spark.sparkContext.accumulator(0)
    schema = "cc_num string, trans_time timestamp, trans_num string, category string, amt double"
    day = [datetime.datetime(2023, 1, d) for d in range(1, 5)]
    rows = [("1", day[0], "9", "STANDARD", 1.0), ("1", day[0], "1", "ECONOMY", 2.0), ("1", day[0], "2", "ECONOMY", 3.0), ("1", day[1], "3", "STANDARD", 4.0),
            ("1", day[1], "4", "STANDARD", 5.0), ("1", day[1], "4", "STANDARD", 5.0), ("2", day[2], "5", None, 6.0), (None, day[3], "6", "PROMO", 7.0),
            (None, day[3], "5", "ECONOMY", 8.0)]

    def counted(key):
        seen.add(1)
        return key

    derived = spark.createDataFrame(rows, schema).withColumn("trans_num", F.udf(counted, "string").asNondeterministic()("trans_num"))
    monkeypatch.setattr(storage, "enriched", lambda *_: derived)
    found = storage.keyed_upsert(spark, str(tmp_path)).collect()
    assert sorted((r.cc_num or "", r.trans_num, r.amt) for r in found) == [("", "5", 8.0), ("1", "2", 3.0), ("1", "4", 5.0)]
    assert found[0].__fields__ == [c.split()[0] for c in schema.split(", ")]
    assert seen.value == len(rows)


def test_keyed_writes_move_their_rows_once(spark, tmp_path, monkeypatch):
    """What is written into a keyed table, new or not, passes one shuffle, by period and piece; order columns beside the table's aren't stored."""
    plans, save = [], keyed.save_table

    def saved(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        save(df, *args, **kwargs)

    monkeypatch.setattr(keyed, "save_table", saved)
    path = str(tmp_path / "keyed")
    rows = [(str(i % 7), TS(2023, 1 + i % 4, 1 + i // 28), f"t{i:03}", float(i)) for i in range(200)]
    keyed.create_keyed_table(rows_to_df(spark, rows, KEYED), path)
    newer = rows_to_df(spark, [(*r[:2], "n", r[3]) for r in rows[::9]] + [("9", TS(2023, 2, 2), "x", 0.0)], KEYED)
    expected = {(r[0], r[1]): r for r in rows} | {(r[0], r[1]): (*r[:2], "n", r[3]) for r in rows[::9]} | {("9", TS(2023, 2, 2)): ("9", TS(2023, 2, 2), "x", 0.0)}
    keyed.upsert_keyed_table(spark, path, newer.withColumn("batch_id", F.lit(1)), order=["batch_id", "trans_num", "amt"], beside=["batch_id"])
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1] and not any("Rebalance" in p.title() for p in plans)
    assert stored_rows(spark, path) == set(expected.values())
    for file in tmp_path.glob("keyed/version=*/month=*/*.parquet"):
        cards = [(r.cc_num, r.trans_time) for r in spark.read.parquet(str(file)).collect()]
        assert cards == sorted(cards)
