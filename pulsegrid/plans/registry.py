"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables, read lazily, plus the streams derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def readings(self) -> DataFrame:
        """The event stream as sensor readings of participants."""
        return self.events.select(
            F.col("user_id").alias("participant_id"), "ts", "value", F.col("event_type").alias("state")
        )

    @property
    def channels(self) -> DataFrame:
        """The same stream keyed by event type: five dense series."""
        return self.events.select(
            F.col("event_type").alias("participant_id"), "ts", "value", F.col("user_id").alias("source")
        )


#: SQL form of ``Tables.readings`` and ``Tables.channels`` with exact microseconds.
READINGS = "r AS (SELECT user_id AS participant_id, ts, epoch_us(ts) AS us, value, event_type AS state FROM events)"
CHANNELS = "r AS (SELECT event_type AS participant_id, ts, epoch_us(ts) AS us, value, user_id AS source FROM events)"


#: Where the rounding step lies.  Results are rounded off-centre on both sides
#: of a comparison: at one half, sums taken in another order would tip exact
#: ties (a mean of two prices, say) either way.
OFFSET = "0.3718281828"


def near(c, digits: int) -> Column:
    """Round for comparison; ``round(x, d)`` in a query's SQL means the same."""
    scale = F.lit(float(10**digits))
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + F.lit(float(OFFSET))) / scale


def _expand_rounds(sql: str) -> str:
    """Write ``round(x, d)`` as the off-centre form (``ROUND`` stays as it is)."""
    while (at := sql.find("round(")) >= 0:
        depth, comma, i = 1, -1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        scale = f"1e{int(sql[comma + 1 : i - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {scale} + {OFFSET}) / {scale}){sql[i:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``{readings}``/``{channels}`` expand in ``sql``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            text = textwrap.dedent(sql).replace("{readings}", READINGS).replace("{channels}", CHANNELS)
            ORACLES[name] = _expand_rounds(text).strip()
        return fn

    return wrap
