from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("netloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def flows(spark):
    from netloom.sources.flows import load_flows

    return load_flows(spark, SF_DIR)


FLOW = dict(
    flow_id=0, te=dt.datetime(2024, 1, 5), td=0.5, sa="42.219.1.1", da="8.8.8.8", sp=2000, dp=80, pr="TCP",
    pkt=2, byt=100, lable="background", this_ip="42.219.1.1",
)
FLOW_DDL = (
    "flow_id long, te timestamp_ntz, td double, sa string, da string, sp int, dp int, pr string, "
    "pkt long, byt long, lable string, this_ip string"
)


@pytest.fixture
def make_flows(spark):
    """Flows from dicts of the fields that matter; the rest is filled in."""
    def make(*rows: dict):
        full = [FLOW | {"flow_id": i} | row for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[k] for k in FLOW) for r in full], FLOW_DDL)

    return make
