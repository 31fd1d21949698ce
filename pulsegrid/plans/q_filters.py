"""Completeness and threshold filters."""

from pyspark.sql import functions as F

from ..functions.time import day_number
from ..operators import filters as FL, sessions as S
from .q_intervals import SES
from .registry import near, query


@query("having_count", """
    WITH {readings} SELECT participant_id, us, value FROM r WHERE participant_id IN (SELECT participant_id FROM r GROUP BY 1 HAVING count(*) >= 70)""")
def having_count(t):
    from ..functions.time import us
    return FL.having_count(t.readings, 70).select("participant_id", us("ts").alias("us"), "value")


@query("complete_periods", """
    WITH {readings} SELECT participant_id, us // 86400000000 AS day, count(*) AS n, count(CASE WHEN value > 20 THEN 1 END) AS valid
    FROM r GROUP BY 1, 2 HAVING count(CASE WHEN value > 20 THEN 1 END) / count(*) >= 0.75""")
def complete_periods(t):
    r = t.readings.withColumn("day", day_number("ts")).withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    return FL.complete_periods(r, "v", 0.75, ["participant_id", "day"])


@query("min_days", """
    WITH {readings} SELECT participant_id, count(DISTINCT us // 86400000000) AS days FROM r WHERE value > 50 GROUP BY 1 HAVING days >= 10""")
def min_days(t):
    return FL.min_days(t.readings.filter("value > 50").withColumn("day", day_number("ts")), 10)


@query("load_periods", f"""
    WITH {{readings}}, {SES}, p AS (SELECT participant_id, start_us, end_us FROM iv WHERE n % 2 = 0 AND end_us - start_us BETWEEN 36000000000 AND 180000000000),
    j AS (SELECT p.*, r.value - 20 AS v FROM p JOIN r ON p.participant_id = r.participant_id AND us BETWEEN start_us AND end_us)
    SELECT participant_id, start_us, count(*) AS n, round(avg(v), 6) AS mean_value FROM j
    GROUP BY 1, 2 HAVING avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0 END) >= 0.6""")
def load_periods(t):
    p = S.sessions(t.readings, 43200).select("participant_id", "start_us", "end_us", (F.col("n") % 2 == 0).cast("int").alias("work"))
    src = t.readings.withColumn("value", F.col("value") - 20)
    out = FL.load_periods(p, src, "work", 10, 50, 0.6)
    return out.groupBy("participant_id", "start_us").agg(F.count(F.lit(1)).alias("n"), near(F.avg("value"), 6).alias("mean_value"))


@query("min_distinct", """
    WITH {readings} SELECT participant_id, us // 604800000000 AS week, count(DISTINCT state) AS distinct_values FROM r GROUP BY 1, 2 HAVING distinct_values >= 5""")
def min_distinct(t):
    r = t.readings.withColumn("week", F.floor(day_number("ts") / 7))
    return FL.min_distinct(r, "state", 5, ["participant_id", "week"])


@query("usable_days", """
    WITH {readings}, a AS (SELECT participant_id, us // 86400000000 AS day, sum(value) AS s FROM r WHERE state IN ('click', 'view') GROUP BY 1, 2 HAVING sum(value) >= 60),
    b AS (SELECT participant_id, us // 86400000000 AS day, count(*) AS valid FROM r WHERE state NOT IN ('click', 'view') GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT participant_id, day, round(s, 5) AS seconds, valid FROM a JOIN b USING (participant_id, day)
    WHERE participant_id IN (SELECT participant_id FROM a JOIN b USING (participant_id, day) GROUP BY 1 HAVING sum(s) >= 200)""")
def usable_days(t):
    r = t.readings.withColumn("day", day_number("ts"))
    phone = F.col("state").isin("click", "view")
    out = FL.usable_days(r.filter(phone), r.filter(~phone), "value", "value", 60, 2, min_total=200)
    return out.withColumn("seconds", near("seconds", 5))


@query("known_location_share", """
    WITH {readings} SELECT participant_id, us // 86400000000 AS day, round(avg(CASE WHEN state IN ('error', 'signup') THEN 1.0 ELSE 0 END), 6) AS unknown_share
    FROM r GROUP BY 1, 2 HAVING avg(CASE WHEN state IN ('error', 'signup') THEN 1.0 ELSE 0 END) < 0.5""")
def known_location_share(t):
    r = t.readings.withColumn("day", day_number("ts"))
    out = FL.known_location_share(r, "state", ["participant_id", "day"], unknown=("error", "signup"))
    return out.withColumn("unknown_share", near("unknown_share", 6))


@query("clip_and_dropna", """
    WITH {readings}, c AS (SELECT participant_id, CASE WHEN value - 30 < 0 THEN 0 WHEN value - 30 > 60 THEN 60 ELSE value - 30 END AS v,
                                  CASE WHEN state <> 'error' THEN value END AS k FROM r)
    SELECT participant_id, count(*) AS n, round(avg(v), 6) AS mean_value FROM c WHERE k IS NOT NULL GROUP BY 1""")
def clip_and_dropna(t):
    r = t.readings.withColumn("v", FL.clip(F.col("value") - 30, 0, 60)).withColumn("k", F.when(F.col("state") != "error", F.col("value")))
    return r.dropna(subset=["k"]).groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), near(F.avg("v"), 6).alias("mean_value"))
