import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def as_of():
    return datetime.date(2023, 12, 27)


@pytest.fixture
def customers(spark):
    """Two cards."""
    ts = datetime.datetime
    rows = [
        ("1", "A", "B", "F", "s", "c", "st", "01234", 40.0, -100.0, "job", ts(2000, 1, 1)),
        ("2", "C", "D", "M", "s", "c", "st", "99999", 30.0, -90.0, "job", ts(1990, 6, 1)),
    ]
    from txnflow.schemas import CUSTOMER

    return spark.createDataFrame(rows, CUSTOMER)


def transaction(**changes):
    """A raw labelled transaction of card 1, with the given fields changed."""
    row = dict(
        cc_num="1", first="A", last="B", trans_num="t1", trans_date="2023-01-05T00:00:00.000Z",
        trans_time="12:34:56", unix_time=1672922096, category="food", merchant="m1", amt=10.5,
        merch_lat=41.0, merch_long=-101.0, is_fraud=0.0,
    )
    row.update(changes)
    return row


@pytest.fixture
def make_transactions(spark):
    from txnflow.schemas import LABELLED_TRANSACTION

    def make(*changes):
        names = [c.split()[0] for c in LABELLED_TRANSACTION.split(", ")]
        rows = [transaction(**c) for c in changes]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LABELLED_TRANSACTION)

    return make
