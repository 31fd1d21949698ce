"""Interval joins."""

from pyspark.sql import functions as F

from ..functions.time import DAY, HOUR, SECOND, day_number, us
from ..operators import excitation as EX, filters as FL, intervals as I, sessions as S
from .q_sessions import gaps
from .registry import near, query

SES = f"{gaps(12)}, iv AS (SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid)"


def halves(t):
    """Two streams of one participant: clicks and views as points, the rest as recordings."""
    points = t.readings.filter(F.col("state").isin("click", "view"))
    return points, S.sessions(t.readings.filter(~F.col("state").isin("click", "view")), 12 * 3600)


HALVES = """
    pt AS (SELECT * FROM r0 WHERE state IN ('click', 'view')), r AS (SELECT * FROM r0 WHERE state NOT IN ('click', 'view')), """ + SES
READ0 = "r0 AS (SELECT user_id AS participant_id, ts, epoch_us(ts) AS us, value, event_type AS state FROM events)"


@query("interval_point_join", f"""
    WITH {READ0}, {HALVES}
    SELECT iv.participant_id, start_us, end_us, count(*) AS points, round(avg(value), 6) AS mean_value
    FROM iv JOIN pt ON iv.participant_id = pt.participant_id AND pt.us BETWEEN start_us AND end_us GROUP BY 1, 2, 3""")
def interval_point_join(t):
    points, ivals = halves(t)
    return I.points_in_intervals(points, ivals, bucket_seconds=6 * 3600).groupBy("participant_id", "start_us", "end_us").agg(
        F.count(F.lit(1)).alias("points"), near(F.avg("value"), 6).alias("mean_value")
    )


@query("before_after_12h", f"""
    WITH {READ0}, {HALVES}, w AS (
      SELECT participant_id, start_us, end_us, 'before' AS side, start_us - 43200000000 AS lo, start_us AS hi FROM iv
      UNION ALL SELECT participant_id, start_us, end_us, 'after', end_us, end_us + 43200000000 FROM iv)
    SELECT w.participant_id, start_us, side, count(*) AS points, round(sum(value), 5) AS total
    FROM w JOIN pt ON w.participant_id = pt.participant_id AND us BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def before_after_12h(t):
    points, ivals = halves(t)
    close = I.around_intervals(points, ivals.drop("n"), 43200, 43200, bucket_seconds=6 * 3600)
    return close.groupBy("participant_id", "start_us", "side").agg(F.count(F.lit(1)).alias("points"), near(F.sum("value"), 5).alias("total"))


@query("pre_post_sleep_30min", f"""
    WITH {READ0}, {HALVES}, w AS (
      SELECT participant_id, start_us, end_us, 'before' AS side, start_us - 1800000000 AS lo, start_us AS hi FROM iv
      UNION ALL SELECT participant_id, start_us, end_us, 'after', end_us, end_us + 1800000000 FROM iv)
    SELECT w.participant_id, side, count(*) AS points, round(avg(value), 6) AS mean_value
    FROM w JOIN pt ON w.participant_id = pt.participant_id AND us BETWEEN lo AND hi GROUP BY 1, 2""")
def pre_post_sleep_30min(t):
    points, ivals = halves(t)
    close = I.around_intervals(points, ivals.drop("n"), 1800, 1800, bucket_seconds=1800)
    return close.groupBy("participant_id", "side").agg(F.count(F.lit(1)).alias("points"), near(F.avg("value"), 6).alias("mean_value"))


@query("band_join_30s", """
    WITH {channels}, a AS (SELECT * FROM r WHERE source % 2 = 0), b AS (SELECT * FROM r WHERE source % 2 = 1)
    SELECT a.participant_id, a.us AS a_us, count(*) AS near, round(avg(b.value), 6) AS mean_value
    FROM a JOIN b ON a.participant_id = b.participant_id AND a.us BETWEEN b.us - 300000000 AND b.us + 300000000 GROUP BY 1, 2""")
def band_join_30s(t):
    a, b = t.channels.filter("source % 2 = 0"), t.channels.filter("source % 2 = 1")
    out = I.band_join(a, b, 300).groupBy("participant_id", us("ts").alias("a_us"))
    return out.agg(F.count(F.lit(1)).alias("near"), near(F.avg("b_value"), 6).alias("mean_value"))


def two_tables(t):
    sleep = S.sessions(t.readings.filter(F.col("state").isin("click", "view", "error")), 12 * 3600)
    work = S.sessions(t.readings.filter(F.col("state").isin("signup", "purchase")), 12 * 3600)
    return sleep.drop("n"), work.drop("n")


def ses_sql(name, states):
    return f"""
    {name}_g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS brk FROM r WHERE state IN ({states})
          WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    {name}_s AS (SELECT *, sum(brk) OVER (PARTITION BY participant_id ORDER BY us) AS sid FROM {name}_g),
    {name} AS (SELECT participant_id, min(us) AS start_us, max(us) AS end_us FROM {name}_s GROUP BY participant_id, sid)"""


TWO = ses_sql("sleep", "'click', 'view', 'error'") + "," + ses_sql("work", "'signup', 'purchase'")


@query("prev_next_interval_flags", f"""
    WITH {{readings}}, {TWO}
    SELECT participant_id, start_us, end_us,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND w.start_us > sleep.end_us AND w.start_us - sleep.end_us < 28800000000) AS INT) AS before_work_nearest,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND w.start_us > sleep.end_us AND w.start_us - sleep.end_us < 57600000000) AS INT) AS before_work,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND sleep.start_us > w.end_us AND sleep.start_us - w.end_us < 28800000000) AS INT) AS after_work
    FROM sleep""")
def prev_next_interval_flags(t):
    return I.interval_proximity(*two_tables(t))


@query("shift_anti_join", f"""
    WITH {READ0}, {HALVES}
    SELECT participant_id, start_us, end_us, n FROM iv
    WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.participant_id = iv.participant_id AND pt.us BETWEEN start_us AND end_us)""")
def shift_anti_join(t):
    points, ivals = halves(t)
    return I.intervals_without_points(ivals, points, bucket_seconds=6 * 3600)


@query("segment_in_recording", f"""
    WITH {{readings}}, {TWO}
    SELECT sleep.participant_id, sleep.start_us, sleep.end_us, work.start_us AS rec_start_us, work.end_us AS rec_end_us
    FROM sleep JOIN work ON sleep.participant_id = work.participant_id AND sleep.start_us BETWEEN work.start_us AND work.end_us""")
def segment_in_recording(t):
    segs, recs = two_tables(t)
    recs = recs.withColumnRenamed("start_us", "rec_start_us").withColumnRenamed("end_us", "rec_end_us")
    return I.intervals_starting_in(segs, recs, bucket_seconds=6 * 3600)


@query("tolerance_match_300s", f"""
    WITH {{readings}}, {TWO}
    SELECT sleep.participant_id, sleep.start_us, sleep.end_us, work.start_us AS b_start_us, work.end_us AS b_end_us
    FROM sleep JOIN work ON sleep.participant_id = work.participant_id AND abs(sleep.start_us - work.start_us) <= 7200000000
    QUALIFY row_number() OVER (PARTITION BY sleep.participant_id, sleep.start_us ORDER BY abs(sleep.start_us - work.start_us), work.start_us) = 1""")
def tolerance_match_300s(t):
    return I.nearest_within(*two_tables(t), 7200)


@query("stream_align", """
    WITH {readings}, h AS (SELECT participant_id, us // 21600000000 AS b, state, sum(value) AS v, count(*) AS n FROM r GROUP BY 1, 2, 3)
    SELECT a.participant_id, a.b, a.n, round(v.v, 5) AS view_value, c.n AS click_n
    FROM (SELECT participant_id, b, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2) a
    LEFT JOIN (SELECT * FROM h WHERE state = 'view') v ON a.participant_id = v.participant_id AND a.b = v.b
    LEFT JOIN (SELECT * FROM h WHERE state = 'click') c ON a.participant_id = c.participant_id AND a.b = c.b""")
def stream_align(t):
    r = t.readings.withColumn("b", F.floor(us("ts") / (21600 * SECOND)))
    base = r.groupBy("participant_id", "b").agg(F.count(F.lit(1)).alias("n"))
    view = r.filter("state = 'view'").groupBy("participant_id", "b").agg(near(F.sum("value"), 5).alias("view_value"))
    click = r.filter("state = 'click'").groupBy("participant_id", "b").agg(F.count(F.lit(1)).alias("click_n"))
    return I.align(base, view, click, on=["participant_id", "b"])


@query("attach_attributes", """
    SELECT c_mktsegment AS segment, event_type AS state, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""")
def attach_attributes(t):
    dim = t.customer.select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("segment"))
    out = I.attach_attributes(t.readings, dim, how="inner").groupBy("segment", "state")
    return out.agg(F.count(F.lit(1)).alias("n"), near(F.avg("value"), 6).alias("mean_value"))


@query("merge_profiles", """
    WITH a AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0),
    b AS (SELECT user_id AS id, count(*) AS n_events FROM events GROUP BY 1),
    c AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
    SELECT id, segment, n_events, n_orders FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)""")
def merge_profiles(t):
    a = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    c = t.orders.filter("o_custkey % 5 <> 0").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return I.full_merge(a, b, c, on=["id"])


@query("outer_merge_days", """
    WITH {readings}, a AS (SELECT participant_id, us // 86400000000 AS day, count(*) AS clicks FROM r WHERE state = 'click' GROUP BY 1, 2),
    b AS (SELECT participant_id, us // 86400000000 AS day, round(sum(value), 5) AS view_total FROM r WHERE state = 'view' GROUP BY 1, 2)
    SELECT participant_id, day, clicks, view_total FROM a FULL JOIN b USING (participant_id, day)""")
def outer_merge_days(t):
    r = t.readings.withColumn("day", day_number("ts"))
    a = r.filter("state = 'click'").groupBy("participant_id", "day").agg(F.count(F.lit(1)).alias("clicks"))
    b = r.filter("state = 'view'").groupBy("participant_id", "day").agg(near(F.sum("value"), 5).alias("view_total"))
    return I.full_merge(a, b, on=["participant_id", "day"])


@query("calendar_semi", """
    WITH {readings}, d AS (SELECT DISTINCT user_id AS participant_id, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_type = 'purchase')
    SELECT participant_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM r
    WHERE EXISTS (SELECT 1 FROM d WHERE d.participant_id = r.participant_id AND d.day = r.us // 86400000000) GROUP BY 1""")
def calendar_semi(t):
    r = t.readings.withColumn("day", day_number("ts"))
    out = I.on_days(r, r.filter("state = 'purchase'")).groupBy("participant_id")
    return out.agg(F.count(F.lit(1)).alias("n"), near(F.avg("value"), 6).alias("mean_value"))


@query("gps_round_join", """
    WITH e AS (SELECT user_id, ROUND(value / 1000, 2) AS lat, ROUND((user_id % 7) / 10.0, 2) AS lon FROM events),
    p AS (SELECT DISTINCT 'S' || s_suppkey AS place, ROUND(s_suppkey / 1000.0, 2) AS lat, ROUND((s_suppkey % 7) / 10.0, 2) AS lon FROM supplier WHERE s_suppkey % 4 <> 0)
    SELECT place, count(*) AS n FROM e JOIN p USING (lat, lon) WHERE place <> 'S1' GROUP BY 1""")
def gps_round_join(t):
    e = t.events.select("user_id", (F.col("value") / 1000).alias("lat"), ((F.col("user_id") % 7) / 10.0).alias("lon"))
    p = t.supplier.filter("s_suppkey % 4 <> 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("place"), (F.col("s_suppkey") / 1000.0).alias("lat"), ((F.col("s_suppkey") % 7) / 10.0).alias("lon")
    )
    return I.match_places(e, p, digits=2, exclude=["S1"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


TYPES = ("click", "error", "purchase", "signup", "view")


def lag_pairs(t):
    r = t.readings.withColumn("us", us("ts")).withColumn("day", day_number("ts"))
    return I.pair_lags(r, TYPES, "state", "us", ["participant_id", "day"], origin=F.col("day") * DAY)


PAIRS = """
    n AS (SELECT *, us // 86400000000 AS day, row_number() OVER (PARTITION BY participant_id, us // 86400000000 ORDER BY us) AS i FROM r),
    p AS (SELECT a.participant_id, a.day, b.state AS from_type, a.state AS to_type, a.us - b.us AS lag_us, (a.us - b.us) / 1000000.0 AS lag
          FROM n a JOIN n b ON a.participant_id = b.participant_id AND a.day = b.day AND b.i < a.i - 1)"""


@query("self_pair_lags", f"""
    WITH {{readings}}, {PAIRS}
    SELECT participant_id, day, from_type, to_type, count(*) AS n, CAST(sum(lag_us) AS BIGINT) AS lag_us FROM p GROUP BY 1, 2, 3, 4""")
def self_pair_lags(t):
    return lag_pairs(t).groupBy("participant_id", "day", "from_type", "to_type").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("lag_us").alias("lag_us")
    )


@query("lag_summary", f"""
    WITH {{readings}}, {PAIRS}, a AS (SELECT from_type, to_type, count(*) AS n, avg(lag) AS m, stddev_pop(lag) AS sd FROM p GROUP BY 1, 2)
    SELECT from_type, to_type, n, round(m, 2) AS mean_lag, round(sd, 2) AS std_lag, round(n / sum(n) OVER (PARTITION BY from_type), 6) AS share,
           round(1.06 * sd * pow(n, -0.2), 2) AS bandwidth, round(greatest(m - sd, 0), 2) AS landmark_low, round(m + sd, 2) AS landmark_high FROM a""")
def lag_summary(t):
    out = I.lag_summary(lag_pairs(t))
    out = out.withColumn("share", near("share", 6))
    return out.withColumns({c: near(c, 2) for c in ("mean_lag", "std_lag", "bandwidth", "landmark_low", "landmark_high")})


def _round_sql(r: int) -> str:
    return f"""
    l{r} AS MATERIALIZED (SELECT participant_id, us, s.i, any_value(s.n) AS n, any_value(mu) AS mu, any_value(mu) + coalesce(sum(alpha * s.s), 0) / 86400 AS rate
          FROM s JOIN m{r} ON m{r}.i = s.i LEFT JOIN a{r} ON a{r}.i = s.i AND a{r}.j = s.j GROUP BY 1, 2, 3),
    m{r + 1} AS MATERIALIZED (SELECT i, sum(n * mu / rate) / any_value(watched) AS mu FROM l{r}, w GROUP BY i),
    a{r + 1} AS MATERIALIZED (SELECT a{r}.i, a{r}.j, coalesce(x.g, 0) / k.k AS alpha FROM a{r} JOIN k ON k.j = a{r}.j LEFT JOIN (
          SELECT s.i, s.j, sum(s.n * alpha * s.s / 86400 / rate) AS g FROM s JOIN l{r} ON l{r}.participant_id = s.participant_id AND l{r}.us = s.us AND l{r}.i = s.i
          JOIN a{r} ON a{r}.i = s.i AND a{r}.j = s.j GROUP BY s.i, s.j) x ON x.i = a{r}.i AND x.j = a{r}.j)"""


@query("infectivity", f"""
    WITH {{readings}}, ev AS MATERIALIZED (SELECT participant_id, us, state, count(*) AS n FROM r GROUP BY 1, 2, 3),
    sp AS (SELECT participant_id, min(us) AS a, max(us) AS b FROM ev GROUP BY 1), w AS MATERIALIZED (SELECT sum(b - a) / 1e6 AS watched FROM sp),
    k AS MATERIALIZED (SELECT state AS j, sum(n * (1 - exp(-(b - us) / 86400e6))) AS k, sum(n) AS n FROM ev JOIN sp ON sp.participant_id = ev.participant_id GROUP BY 1),
    s AS MATERIALIZED (SELECT e.participant_id, e.us, e.state AS i, e.n, o.state AS j, sum(o.n * exp(-(e.us - o.us) / 86400e6)) AS s
          FROM ev e LEFT JOIN ev o ON o.participant_id = e.participant_id AND o.us < e.us GROUP BY 1, 2, 3, 4, 5),
    m0 AS (SELECT j AS i, 0.5 * n / watched AS mu FROM k, w), a0 AS (SELECT x.j AS i, y.j AS j, 0.1 AS alpha FROM k x, k y),
    {",".join(_round_sql(r) for r in range(3))},
    f AS (SELECT (SELECT sum(n * ln(rate)) FROM l2) - (SELECT sum(mu) FROM m2) * (SELECT watched FROM w)
          - (SELECT sum(alpha * k.k) FROM a2 JOIN k ON k.j = a2.j) AS fit)
    SELECT a3.j AS from_type, a3.i AS to_type, round(alpha, 6) AS infectivity, round(mu * 86400, 6) AS per_day, round(fit / 1000.0, 4) AS fit
    FROM a3 JOIN m3 ON m3.i = a3.i, f""")
def infectivity(t):
    """Three rounds over all participants as one model; effects last a day on average."""
    out = EX.infectivity(t.readings.withColumn("us", us("ts")), TYPES, "state", "us", ["participant_id"], 86400.0, rounds=3, tolerance=0)
    return out.select("from_type", "to_type", near("infectivity", 6).alias("infectivity"), near(F.col("base_rate") * 86400, 6).alias("per_day"),
                      near(F.col("log_likelihood") / 1000.0, 4).alias("fit"))


@query("work_windows", """
    WITH {readings}, d AS (SELECT DISTINCT participant_id, us // 86400000000 AS day, CASE WHEN participant_id % 2 = 0 THEN 'day' ELSE 'night' END AS shift FROM r),
    n AS (SELECT *, lead(day) OVER (PARTITION BY participant_id ORDER BY day) AS nx FROM d),
    w AS (SELECT participant_id, day * 86400000000 + CASE WHEN shift = 'day' THEN 25200000000 ELSE 68400000000 END AS start_us FROM n WHERE shift = 'day' OR nx = day + 1)
    SELECT w.participant_id, start_us, start_us + 43200000000 AS end_us, count(r.us) AS n
    FROM w JOIN r ON w.participant_id = r.participant_id AND r.us >= start_us AND r.us < start_us + 43200000000 GROUP BY 1, 2""")
def work_windows(t):
    days = t.readings.select("participant_id", day_number("ts").alias("day")).withColumn(
        "shift", F.when(F.col("participant_id") % 2 == 0, "day").otherwise("night")
    )
    wins = I.work_windows(days, "shift", hours=12)
    inside = I.points_in_intervals(t.readings, wins, closed="left", bucket_seconds=12 * 3600)
    return inside.groupBy("participant_id", "start_us", "end_us").agg(F.count(F.lit(1)).alias("n"))
