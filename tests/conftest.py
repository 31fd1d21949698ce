import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import build_session

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def stream(spark):
    """``stream([(pid, seconds, *values)], "names types")`` -> DataFrame with ``ts``."""

    def make(rows, columns="value double", pid="string"):
        data = [(r[0], T0 + dt.timedelta(seconds=r[1]), *r[2:]) for r in rows]
        return spark.createDataFrame(data, f"participant_id {pid}, ts timestamp_ntz" + (f", {columns}" if columns else ""))

    return make


@pytest.fixture(scope="session")
def us0():
    return int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
