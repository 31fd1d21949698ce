"""Time-grid resampling."""

from pyspark.sql import functions as F

from ..functions.time import HOUR, MINUTE, SECOND, bucket, clock_hour, day_number, from_us, relative_hour, shift_window, truncate, us
from ..operators import grid as G, sessions as S
from .registry import near, query


def r6(df, *cols):
    return df.withColumns({c: near(c, 6) for c in cols})


def windows_sql(step, low, high, src="r"):
    """Rows of ``src`` times the grid points whose closed window holds them (all in us)."""
    return f"""w AS (SELECT *, k * {step} AS t_us FROM (
        SELECT *, unnest(generate_series((us - {high} + {step * 1001 - 1}) // {step} - 1000,
                                         (us - {low} + {step * 1000}) // {step} - 1000)) AS k FROM {src}))"""


H = 3_600_000_000


@query("minute_resample_centered", f"""
    WITH {{readings}}, {windows_sql(6 * H, -3 * H, 3 * H)}
    SELECT participant_id, t_us, CASE WHEN count(*) > 1 THEN round(avg(value), 6) END AS value, count(*) AS n
    FROM w GROUP BY 1, 2""")
def minute_resample_centered(t):
    src = t.readings.withColumn("n", F.lit(1).cast("bigint"))
    return r6(G.resample_centered(src, 6 * 3600, ["value"], ["n"]), "value")


@query("resample_whole_days", f"""
    WITH {{channels}}, {windows_sql(1800_000_000, -900_000_000, 900_000_000)}
    SELECT participant_id, t_us, CASE WHEN count(*) > 1 THEN round(avg(value), 6) END AS value
    FROM w WHERE t_us // 86400000000 = us // 86400000000 GROUP BY 1, 2""")
def resample_whole_days(t):
    return r6(G.resample_centered(t.channels, 1800, ["value"], whole_days=True), "value")


@query("sliding_resample", f"""
    WITH {{channels}}, {windows_sql(H, -1_000_000, int(1.5 * H) - 1_000_000)}
    SELECT participant_id, t_us, CASE WHEN count(*) > 2 THEN round(avg(value), 6) END AS value FROM w GROUP BY 1, 2""")
def sliding_resample(t):
    return r6(G.resample_overlap(t.channels, 3600, 1800, ["value"]), "value")


@query("multi_stat_resample", f"""
    WITH {{channels}}, {windows_sql(H, 0, int(1.5 * H))}, v AS (
      SELECT *, nullif(value, 0) AS x, CASE WHEN source % 3 = 0 THEN 0 ELSE value END AS steps FROM w)
    SELECT participant_id, t_us + {int(1.5 * H)} AS t_us,
      CASE WHEN count(x) > 2 THEN max(x) END AS value_max, CASE WHEN count(x) > 2 THEN min(x) END AS value_min,
      CASE WHEN count(x) > 2 THEN round(avg(x), 6) END AS value_mean,
      CASE WHEN count(x) > 2 THEN round(stddev_pop(x), 5) END AS value_std,
      max(steps) AS steps_max, round(avg(steps), 6) AS steps_mean, round(stddev_pop(steps), 5) AS steps_std,
      round(sum(steps), 5) AS steps_sum
    FROM v GROUP BY 1, 2""")
def multi_stat_resample(t):
    src = t.channels.withColumn("steps", F.when(F.col("source") % 3 == 0, 0.0).otherwise(F.col("value")))
    out = G.resample_multi(src, 3600, 1800, {"value": "full", "steps": "sum"}, threshold=2)
    out = r6(out, "value_mean", "steps_mean")
    return out.withColumns({c: near(c, 5) for c in ("value_std", "steps_std", "steps_sum")})


@query("full_grid_counts", """
    WITH {readings}, h AS (SELECT participant_id, us // 21600000000 AS b, count(*) AS n FROM r GROUP BY 1, 2),
    s AS (SELECT participant_id, min(b) AS a, max(b) AS z FROM h GROUP BY 1),
    g AS (SELECT participant_id, unnest(generate_series(a, z)) AS b FROM s)
    SELECT g.participant_id, g.b * 21600000000 AS t_us, coalesce(n, 0) AS n
    FROM g LEFT JOIN h ON g.participant_id = h.participant_id AND g.b = h.b""")
def full_grid_counts(t):
    n = t.readings.groupBy("participant_id", (bucket("ts", 21600) * 21600 * SECOND).alias("t_us")).agg(F.count(F.lit(1)).alias("n"))
    return G.pad(G.densify(n, 21600), ["n"], 0).withColumn("n", F.col("n").cast("bigint"))


@query("spread_sessions", """
    WITH {readings}, x AS (SELECT *, us + CAST(value * 10 * 1000000 AS BIGINT) AS b FROM r),
    e AS (SELECT *, unnest(generate_series(us // 300000000, b // 300000000)) AS k FROM x)
    SELECT participant_id, k * 300000000 AS t_us, count(*) AS sessions,
           round(sum((least(b, (k + 1) * 300000000) - greatest(us, k * 300000000)) / 1000000.0), 6) AS seconds
    FROM e GROUP BY 1, 2""")
def spread_sessions(t):
    src = t.readings.withColumn("secs", near(F.col("value") * 10, 6))
    return G.spread_sessions(src, "secs", 300).withColumn("seconds", near("seconds", 6))


@query("foreground_share", """
    WITH {channels}, c AS (SELECT participant_id, (us // 3600000000 + 1) * 3600000000 AS t_us, count(*) AS n FROM r GROUP BY 1, 2),
    s AS (SELECT participant_id, min(us) // 3600000000 AS a, max(us) // 3600000000 AS z FROM r GROUP BY 1),
    g AS (SELECT participant_id, unnest(generate_series(a, z)) * 3600000000 AS t_us FROM s)
    SELECT g.participant_id, g.t_us, round(greatest(coalesce(n, 0) - 1, 0) * 0.01 / 3600, 9) AS foreground
    FROM g LEFT JOIN c USING (participant_id, t_us)""")
def foreground_share(t):
    return G.foreground_share(t.channels, 3600).withColumn("foreground", near("foreground", 9))


@query("locate_strongest", """
    WITH {readings}, m AS (SELECT participant_id, us // 60000000 * 60000000 AS m_us, state, max(value) AS v FROM r WHERE value >= 5 GROUP BY 1, 2, 3),
    w AS (SELECT participant_id, state, v, unnest(generate_series((m_us - 1740000000 + 1799999999) // 1800000000, (m_us + 1800000000) // 1800000000)) * 1800000000 AS t_us FROM m)
    SELECT participant_id, t_us, state AS location, max(v) AS signal FROM w GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY participant_id, t_us ORDER BY max(v) DESC, state) = 1""")
def locate_strongest(t):
    return G.locate(t.readings.filter(F.col("value") >= 5), "state", "value", interval=30)


@query("locate_on_grid", """
    WITH {readings}, m AS (SELECT participant_id, us // 60000000 * 60000000 AS m_us, state, max(value) AS v FROM r GROUP BY 1, 2, 3 HAVING max(value) > 0),
    w AS (SELECT participant_id, state, v, unnest(generate_series((m_us - 1740000000 + 1799999999) // 1800000000, (m_us + 1800000000) // 1800000000)) * 1800000000 AS t_us FROM m),
    b AS (SELECT participant_id, t_us, state AS location, max(v) AS signal FROM w GROUP BY 1, 2, 3
          QUALIFY row_number() OVER (PARTITION BY participant_id, t_us ORDER BY max(v) DESC, state) = 1),
    s AS (SELECT participant_id, min(us) // 1800000000 AS a, max(us) // 1800000000 AS z FROM r GROUP BY 1),
    g AS (SELECT participant_id, unnest(generate_series(a, z)) * 1800000000 AS t_us FROM s)
    SELECT participant_id, coalesce(location, 'unknown') AS location, count(*) AS points
    FROM g LEFT JOIN b USING (participant_id, t_us) GROUP BY 1, 2""")
def locate_on_grid(t):
    full = G.locate(t.readings, "state", "value", interval=30, spans=G.spans_of(t.readings))
    return full.groupBy("participant_id", "location").agg(F.count(F.lit(1)).alias("points"))


@query("local_peaks", f"""
    WITH {{channels}}, p AS (SELECT *, max(value) OVER (PARTITION BY participant_id ORDER BY us ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM r),
    q AS (SELECT * FROM p WHERE value = top AND value > 3),
    {windows_sql(6 * H, -2_000_000, 6 * H + 2_000_000, "q")}
    SELECT participant_id, t_us, count(*) AS peaks, max(value) AS peak_max, min(value) AS peak_min, round(avg(value), 6) AS peak_mean
    FROM w GROUP BY 1, 2""")
def local_peaks(t):
    return r6(G.peak_stats(t.channels, "value", 6 * 3600), "peak_mean")


@query("hrv_metrics", """
    WITH {channels}, b AS (
      SELECT participant_id, us, us // 21600000000 * 21600000000 AS t_us, 0 AS beat, CAST(floor(value) AS INT) AS tick FROM r
      UNION ALL SELECT participant_id, us, us // 21600000000 * 21600000000, 1, CAST(floor(value / 2) AS INT) FROM r),
    d AS (SELECT participant_id, t_us, tick * 4.0::DOUBLE AS nn, tick * 4.0::DOUBLE - lag(tick * 4.0::DOUBLE) OVER (PARTITION BY participant_id, t_us ORDER BY us, beat) AS d FROM b WHERE tick <> 0)
    SELECT participant_id, t_us, count(*) AS n, round(avg(nn), 5) AS mean_nni, median(nn) AS median_nni, max(nn) - min(nn) AS range_nni,
      round(stddev_samp(nn), 5) AS sdnn, round(stddev_pop(d), 5) AS sdsd, round(sqrt(avg(d * d)), 5) AS rmssd,
      count(*) FILTER (abs(d) > 50) AS nni_50, round(100.0 * count(*) FILTER (abs(d) > 50) / count(*), 5) AS pnni_50,
      count(*) FILTER (abs(d) > 20) AS nni_20, round(100.0 * count(*) FILTER (abs(d) > 20) / count(*), 5) AS pnni_20,
      round(stddev_samp(nn) / avg(nn), 5) AS cvnni, round(sqrt(avg(d * d)) / avg(nn), 5) AS cvsd,
      round(avg(60000 / nn), 4) AS mean_hr, round(min(60000 / nn), 4) AS min_hr, round(max(60000 / nn), 4) AS max_hr, round(stddev_pop(60000 / nn), 4) AS std_hr
    FROM d GROUP BY 1, 2 HAVING count(*) > 5""")
def hrv_metrics(t):
    src = t.channels.withColumn("rr0", F.floor("value").cast("int")).withColumn("rr1", F.floor(F.col("value") / 2).cast("int"))
    out = G.hrv(src, 21600, ["rr0", "rr1"], threshold=5)
    five = ["mean_nni", "sdnn", "sdsd", "rmssd", "pnni_50", "pnni_20", "cvnni", "cvsd"]
    out = out.withColumns({c: near(c, 5) for c in five})
    return out.withColumns({c: near(c, 4) for c in ("mean_hr", "min_hr", "max_hr", "std_hr")})


@query("subwindow_rms", """
    WITH {channels}, f AS (SELECT *, value > 15 AS state FROM r),
    c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY participant_id ORDER BY us) THEN 1 ELSE 0 END AS chg FROM f),
    k AS (SELECT *, sum(chg) OVER (PARTITION BY participant_id ORDER BY us) AS rid FROM c),
    s AS (SELECT participant_id, rid, state, min(us) AS start_us, max(us) AS end_us FROM k GROUP BY 1, 2, 3
          HAVING max(us) - min(us) >= 300000000 AND count(*) >= 3),
    j AS (SELECT k.participant_id, k.us, k.value, s.state, s.start_us, s.end_us FROM k JOIN s USING (participant_id, rid)),
    w AS (SELECT *, start_us + unnest(generate_series(greatest(0, (us - start_us - 3600000000 + 1799999999) // 1800000000), (us - start_us) // 1800000000)) * 1800000000 AS t_us FROM j)
    SELECT participant_id, state, start_us, t_us, round(avg(nullif(value, 0)), 5) AS mean_value, round(sqrt(avg(value * value)), 5) AS rms_energy
    FROM w WHERE t_us + 3600000000 <= end_us GROUP BY 1, 2, 3, 4""")
def subwindow_rms(t):
    src = t.channels.withColumn("state", F.col("value") > 15).withColumn("energy", F.col("value"))
    out = G.subwindow_rms(S.state_runs(src, "state"), src, "value", "energy", 3600, 1800, min_rows=3)
    return out.withColumns({c: near(c, 5) for c in ("mean_value", "rms_energy")})


@query("tod_points", f"""
    WITH {{readings}}, {windows_sql(3 * H, -H, H)}
    SELECT participant_id, t_us // 86400000000 AS day, CAST(t_us % 86400000000 // {3 * H} AS INT) AS point, round(sum(value), 5) AS value
    FROM w GROUP BY 1, 2, 3""")
def tod_points(t):
    return G.tod_points(t.readings, "value", 8, 120).withColumn("value", near("value", 5))


@query("section_shift", """
    WITH {channels}, x AS (SELECT *, us // 86400000000 * 86400000000 + 25200000000 AS shift_us FROM r WHERE hour(ts) BETWEEN 7 AND 18)
    SELECT participant_id, shift_us, CAST((us - shift_us) // 10800000000 AS INT) AS section, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 4""")
def section_shift(t):
    src = t.channels.filter(F.hour("ts").between(7, 18)).withColumn("shift_us", day_number("ts") * 24 * HOUR + 7 * HOUR)
    return r6(G.shift_sections(src, "shift_us", min_rows=4, measures={"mean_value": F.avg("value")}), "mean_value")


@query("diurnal_bins", """
    WITH {readings} SELECT participant_id, CASE hour(ts) // 6 WHEN 0 THEN 'night' WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' ELSE 'evening' END AS part,
      count(*) AS n, round(avg(value), 6) AS mean_value FROM r GROUP BY 1, 2""")
def diurnal_bins(t):
    out = t.readings.groupBy("participant_id", G.diurnal("ts").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return r6(out, "mean_value")


@query("doc_windows", f"""
    WITH {{channels}}, {windows_sql(2 * H, 0, 4 * H)}
    SELECT participant_id, t_us, string_agg(CAST(source AS VARCHAR), ' ' ORDER BY us) AS words FROM w GROUP BY 1, 2 HAVING count(*) >= 3""")
def doc_windows(t):
    docs = G.doc_windows(t.channels.withColumn("word", F.col("source").cast("string")), "word", 120, 240, min_words=3)
    return docs.withColumn("words", F.array_join("words", " "))


@query("bucket_truncate", """
    WITH {readings} SELECT participant_id, us // 900000000 AS b, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def bucket_truncate(t):
    return t.readings.groupBy("participant_id", bucket("ts", 900).alias("b"), us(truncate("ts", 60)).alias("hour_us")).agg(F.count(F.lit(1)).alias("n"))


@query("clock_hours", """
    WITH {readings}, h AS (SELECT participant_id, hour(ts) + minute(ts) / 60.0 AS h FROM r)
    SELECT participant_id, round(avg(h), 5) AS mean_hour, round(avg(CASE WHEN h >= 12 THEN h - 24 ELSE h END), 5) AS mean_wrapped FROM h GROUP BY 1""")
def clock_hours(t):
    return t.readings.groupBy("participant_id").agg(
        near(F.avg(clock_hour("ts")), 5).alias("mean_hour"), near(F.avg(clock_hour("ts", wrap=True)), 5).alias("mean_wrapped")
    )


ASSIGN = """
    x AS (SELECT *, CASE WHEN participant_id % 2 = 0 THEN 'day' ELSE 'night' END AS shift, us // 86400000000 * 86400000000 AS d0 FROM r),
    y AS (SELECT *, CASE WHEN shift = 'day' AND hour(ts) BETWEEN 5 AND 23 THEN d0 + 25200000000
                         WHEN shift = 'night' AND hour(ts) >= 16 THEN d0 + 68400000000
                         WHEN shift = 'night' AND hour(ts) <= 12 THEN d0 - 18000000000 END AS shift_start FROM x)"""


@query("assign_shift", f"""
    WITH {{readings}}, {ASSIGN}
    SELECT participant_id, shift_start, shift_start + 43200000000 AS shift_end, count(*) AS n FROM y WHERE shift_start IS NOT NULL GROUP BY 1, 2, 3""")
def assign_shift(t):
    start, end = shift_window("ts", "shift")
    src = t.readings.withColumn("shift", F.when(F.col("participant_id") % 2 == 0, "day").otherwise("night"))
    src = src.select("participant_id", start.alias("shift_start"), end.alias("shift_end")).filter("shift_start is not null")
    return src.groupBy("participant_id", "shift_start", "shift_end").agg(F.count(F.lit(1)).alias("n"))


@query("relative_hours", """
    WITH {readings}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY participant_id ORDER BY us) AS sid FROM g),
    a AS (SELECT participant_id, min(us) AS start_us, max(us) AS end_us, min(ts) AS t0 FROM s GROUP BY participant_id, sid),
    b AS (SELECT *, CASE WHEN hour(t0) <= 4 THEN start_us // 86400000000 * 86400000000 - 18000000000
                         WHEN hour(t0) > 17 THEN start_us // 86400000000 * 86400000000 + 68400000000
                         ELSE start_us // 86400000000 * 86400000000 + 25200000000 END AS base FROM a)
    SELECT participant_id, start_us, round((end_us - base) / 3600000000.0, 6) AS end_hour FROM b""")
def relative_hours(t):
    s = S.sessions(t.readings, 12 * 3600)
    return s.select("participant_id", "start_us", near(relative_hour(from_us("end_us"), from_us("start_us")), 6).alias("end_hour"))
