from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from roomledger import schema  # noqa: E402
from roomledger.session import local_session  # noqa: E402

EDGE_CSV = """\
hotel,is_canceled,lead_time,arrival_date_year,arrival_date_month,arrival_date_day_of_month,\
stays_in_weekend_nights,stays_in_week_nights,children,agent,company,country,market_segment,reserved_room_type,\
customer_type,adr,reservation_status_date
City Hotel,0,0,2017,July,1,1,2,0,1,NULL,PRT,Direct,A,Transient,100.0,2017-07-04
City Hotel,1,30,2017,July,31,0,1,NA,NULL,NULL,PRT,Online TA,A,Transient,80.0,2017-06-30
Resort Hotel,0,31,2017,September,15,2,5,2,9,10,GBR,Online TA,D,Contract,120.5,2017-09-22
Resort Hotel,0,31,2017,September,15,2,5,2,9,10,GBR,Online TA,D,Contract,120.5,2017-09-22
Resort Hotel,1,90,2017,February,30,0,0,0,NULL,NULL,NULL,Groups,A,Group,50.0,2017-01-10
City Hotel,0,180,2017,May,9,1,1,1,1,NULL,GBR,,B,Transient,60.0,2017-05-11
City Hotel,1,20,2017,July,2,0,3,0,9,NULL,ESP,Groups,A,Transient-Party,75.25,2017-06-01
Resort Hotel,0,181,2017,July,3,2,2,0,,20,ESP,Direct,A,Transient,40.0,2017-07-07
"""


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def edge_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("edge") / "bookings.csv"
    path.write_text(EDGE_CSV)
    return str(path)


@pytest.fixture(scope="session")
def edge(spark, edge_csv):
    from roomledger.sources.csv_bookings import read_bookings

    return read_bookings(spark, edge_csv)


@pytest.fixture(scope="session")
def clean(edge):
    from roomledger.operators.cleaning import clean_bookings

    return clean_bookings(edge).cache()


@pytest.fixture(scope="session")
def booking(spark):
    """A frame of bookings from dicts; columns left out are NULL."""

    def make(*rows: dict):
        filled = [tuple(row.get(f.name) for f in schema.BOOKINGS) for row in rows]
        return spark.createDataFrame(filled, schema.BOOKINGS)

    return make


def pairs(df, key, value):
    return {r[key]: r[value] for r in df.select(F.col(key), F.col(value)).collect()}
