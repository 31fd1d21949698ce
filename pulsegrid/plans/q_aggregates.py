"""Summaries of segments, days, participants and cohorts."""

from pyspark.sql import functions as F

from ..functions.time import DAY, HOUR, day_number, minute_of_day, shift_window, us
from ..operators import aggregates as A, grid as G, intervals as I, sessions as S
from .q_grid import ASSIGN, r6
from .q_intervals import SES, TWO, two_tables
from .registry import near, query

STATES = ("click", "error", "purchase", "signup", "view")


def rounded(df, digits, *skip):
    """Round every double column but ``skip``."""
    return df.withColumns({c: near(c, digits) for c, d in df.dtypes if d == "double" and c not in skip})


@query("nan_stats", """
    WITH {readings}, v AS (SELECT participant_id, CASE WHEN state <> 'error' THEN value END AS value FROM r)
    SELECT participant_id, count(value) AS value_n, round(avg(value), 5) AS value_mean, round(stddev_pop(value), 5) AS value_std, round(var_pop(value), 4) AS value_var,
      min(value) AS value_min, max(value) AS value_max, round(sum(value), 5) AS value_sum, round(max(value) - min(value), 5) AS value_range, round(median(value), 5) AS value_median FROM v GROUP BY 1""")
def nan_stats(t):
    src = t.readings.withColumn("value", F.when(F.col("state") != "error", F.col("value")))
    out = A.nan_stats(src, ["participant_id"], ["value"]).withColumn("value_var", near("value_var", 4))
    return rounded(out, 5, "value_var")


@query("segment_gaussian", f"""
    WITH {{readings}}, {SES}
    SELECT iv.participant_id, start_us, end_us, count(*) AS n, round(avg(value), 6) AS value_mean, round(var_samp(value), 4) AS value_var
    FROM iv JOIN r ON iv.participant_id = r.participant_id AND us BETWEEN start_us AND end_us GROUP BY 1, 2, 3""")
def segment_gaussian(t):
    out = A.segment_gaussian(t.readings, S.sessions(t.readings, 43200), ["value"], bucket_seconds=6 * 3600)
    return r6(out, "value_mean").withColumn("value_var", near("value_var", 4))


@query("segment_covariance", f"""
    WITH {{readings}}, {SES}, x AS (SELECT iv.participant_id, start_us, end_us, value, hour(ts) + 0.0::DOUBLE AS h
      FROM iv JOIN r ON iv.participant_id = r.participant_id AND us BETWEEN start_us AND end_us)
    SELECT participant_id, start_us, end_us, count(*) AS n, round(avg(value), 5) AS mean_x, round(avg(h), 5) AS mean_y, round(var_samp(value), 4) AS var_x,
      round(covar_samp(value, h), 4) AS cov_xy, round(var_samp(h), 4) AS var_y FROM x GROUP BY 1, 2, 3""")
def segment_covariance(t):
    src = t.readings.withColumn("h", F.hour("ts").cast("double"))
    out = A.segment_cov(src, S.sessions(t.readings, 43200), "value", "h", bucket_seconds=6 * 3600)
    out = out.withColumns({c: near(c, 5) for c in ("mean_x", "mean_y")})
    return out.withColumns({c: near(c, 4) for c in ("var_x", "cov_xy", "var_y")})


@query("segment_location_ratio", f"""
    WITH {{readings}}, {SES}
    SELECT iv.participant_id, start_us, end_us, {", ".join(f"round(avg(CASE WHEN state = '{s}' THEN 1.0 ELSE 0 END), 6) AS {s}_ratio" for s in STATES)}
    FROM iv JOIN r ON iv.participant_id = r.participant_id AND us BETWEEN start_us AND end_us GROUP BY 1, 2, 3""")
def segment_location_ratio(t):
    return rounded(A.location_ratio(t.readings, S.sessions(t.readings, 43200), "state", STATES, bucket_seconds=6 * 3600), 6)


@query("segment_features", f"""
    WITH {{readings}}, {TWO},
    p AS (SELECT s.participant_id, s.start_us, s.end_us, w.start_us AS rec_start_us, w.end_us AS rec_end_us FROM sleep s JOIN work w ON s.participant_id = w.participant_id AND s.start_us BETWEEN w.start_us AND w.end_us),
    f AS (SELECT p.participant_id, start_us, end_us, rec_start_us, avg(value) AS m, stddev_pop(value) AS sd, max(value) AS mx, min(value) AS mn, count(*) FILTER (state = 'click') AS click_minutes, count(*) FILTER (state = 'view') AS view_minutes
          FROM p JOIN r ON p.participant_id = r.participant_id AND us BETWEEN start_us AND end_us GROUP BY 1, 2, 3, 4),
    n AS (SELECT w.participant_id, w.start_us AS rec_start_us, avg(value) AS nm, stddev_pop(value) AS ns FROM work w JOIN r ON w.participant_id = r.participant_id AND us BETWEEN w.start_us AND w.end_us GROUP BY 1, 2)
    SELECT participant_id, start_us, end_us, rec_start_us, round(m, 5) AS value_mean, round(sd, 5) AS value_std, mx AS value_max, mn AS value_min, round(mx - mn, 5) AS value_range, click_minutes, view_minutes,
      round(nm, 5) AS norm_value_mean, round(ns, 5) AS norm_value_std, round((end_us - start_us) / 60000000.0 + 1, 5) AS duration_minutes,
      round(hour(make_timestamp(start_us)) + minute(make_timestamp(start_us)) / 60.0, 5) AS start_hour, round(hour(make_timestamp(end_us)) + minute(make_timestamp(end_us)) / 60.0, 5) AS end_hour,
      round((start_us - CASE WHEN hour(make_timestamp(rec_start_us)) <= 4 THEN rec_start_us // 86400000000 * 86400000000 - 18000000000 WHEN hour(make_timestamp(rec_start_us)) > 17 THEN rec_start_us // 86400000000 * 86400000000 + 68400000000
            ELSE rec_start_us // 86400000000 * 86400000000 + 25200000000 END) / 3600000000.0, 5) AS relative_start_hour
    FROM f JOIN n USING (participant_id, rec_start_us)""")
def segment_features(t):
    segs, recs = two_tables(t)
    recs = recs.withColumnRenamed("start_us", "rec_start_us").withColumnRenamed("end_us", "rec_end_us")
    return rounded(A.segment_features(t.readings, t.readings, segs, recs, ["value"], "state", ["click", "view"], bucket_seconds=6 * 3600), 5)


@query("workday_matrix", """
    WITH {readings}, m AS (SELECT DISTINCT participant_id, us // 86400000000 AS day FROM r WHERE state IN ('click', 'view') UNION SELECT DISTINCT participant_id, us // 86400000000 FROM r WHERE state = 'signup' AND value > 30),
    c AS (SELECT DISTINCT us // 86400000000 AS day FROM r), p AS (SELECT DISTINCT participant_id FROM m)
    SELECT p.participant_id, c.day, CASE WHEN m.day IS NULL THEN 0 ELSE 1 END AS work FROM p CROSS JOIN c LEFT JOIN m ON m.participant_id = p.participant_id AND m.day = c.day""")
def workday_matrix(t):
    r = t.readings.withColumn("day", day_number("ts"))
    sources = {"stream": r.filter(F.col("state").isin("click", "view")), "survey": r.filter("state = 'signup' and value > 30")}
    return A.workday_flags(sources, r.select("day").distinct())


@query("shift_provenance", f"""
    WITH {{readings}}, {ASSIGN}, c AS (SELECT *, CASE state WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rk, CASE state WHEN 'signup' THEN 'survey' WHEN 'view' THEN 'proximity' ELSE 'garment' END AS source
      FROM y WHERE state IN ('signup', 'view', 'click') AND shift_start IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM r s WHERE s.state = 'error' AND s.participant_id = y.participant_id AND s.us BETWEEN y.shift_start AND y.shift_start + 43200000000))
    SELECT participant_id, shift_start // 86400000000 AS day, shift_start AS shift_start_us, shift_start + 43200000000 AS shift_end_us, source, us AS seen_us FROM c
    QUALIFY row_number() OVER (PARTITION BY participant_id, shift_start // 86400000000 ORDER BY rk DESC, us DESC) = 1""")
def shift_provenance(t):
    start, end = shift_window("ts", "shift")
    r = t.readings.withColumn("shift", F.when(F.col("participant_id") % 2 == 0, "day").otherwise("night"))
    r = r.select("participant_id", "state", us("ts").alias("seen_us"), start.alias("shift_start_us"), end.alias("shift_end_us"))
    kinds = [("survey", "signup"), ("proximity", "view"), ("garment", "click")]
    sleep = t.readings.filter("state = 'error'").select("participant_id", us("ts").alias("start_us"))
    return A.shift_table([(n, r.filter(F.col("state") == s)) for n, s in kinds], sleep)


@query("compliance_ratio", f"""
    WITH {{readings}}, {SES}, a AS (SELECT participant_id, count(*) AS recordings, avg((end_us - start_us) / 3600000000.0) AS h FROM iv WHERE n BETWEEN 2 AND 900 GROUP BY 1),
    d AS (SELECT participant_id, count(DISTINCT us // 86400000000) AS work_days FROM r WHERE state = 'click' GROUP BY 1)
    SELECT a.participant_id, recordings, round(h, 5) AS mean_hours, work_days, round(recordings / work_days, 5) AS ratio FROM a LEFT JOIN d USING (participant_id)""")
def compliance_ratio(t):
    days = t.readings.filter("state = 'click'").withColumn("day", day_number("ts"))
    return rounded(A.compliance(t.readings, days, 43200), 5)


@query("day_compliance", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 AS day, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT participant_id, count(*) AS days, round(least(1, count(*) / 25), 6) AS ratio, round(avg(n / 60), 6) AS mean_hours FROM d GROUP BY 1""")
def day_compliance(t):
    return rounded(A.day_compliance(t.readings, "value", 25), 6)


FLAGS = """
    fl AS (SELECT participant_id, start_us, end_us,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND w.start_us > sleep.end_us AND w.start_us - sleep.end_us < 28800000000) AS INT) AS before_work_nearest,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND w.start_us > sleep.end_us AND w.start_us - sleep.end_us < 57600000000) AS INT) AS before_work,
      CAST(EXISTS (SELECT 1 FROM work w WHERE w.participant_id = sleep.participant_id AND sleep.start_us > w.end_us AND sleep.start_us - w.end_us < 28800000000) AS INT) AS after_work FROM sleep)"""


@query("sleep_summary", f"""
    WITH {{readings}}, {TWO}, {FLAGS},
    nr AS (SELECT s.participant_id, start_us, end_us, 'b' AS side, value, hour(ts) AS st FROM sleep s JOIN r ON s.participant_id = r.participant_id AND us BETWEEN start_us - 43200000000 AND start_us
           UNION ALL SELECT s.participant_id, start_us, end_us, 'a', value, hour(ts) FROM sleep s JOIN r ON s.participant_id = r.participant_id AND us BETWEEN end_us AND end_us + 43200000000),
    tp AS (SELECT participant_id, start_us, side, max(value) AS top FROM nr GROUP BY 1, 2, 3 HAVING count(*) > 1),
    z AS (SELECT nr.*, top, value / top AS q FROM nr JOIN tp USING (participant_id, start_us, side)),
    g AS (SELECT participant_id, start_us, side, sum(st) AS steps, max(top) AS mh, max(st) AS ms, avg(CASE WHEN q >= .85 THEN 1.0 ELSE 0 END) AS pk, avg(CASE WHEN q >= .7 AND q < .85 THEN 1.0 ELSE 0 END) AS ca,
          avg(CASE WHEN q >= .5 AND q < .7 THEN 1.0 ELSE 0 END) AS fb, avg(CASE WHEN q < .5 THEN 1.0 ELSE 0 END) AS oo FROM z GROUP BY 1, 2, 3),
    mv AS (SELECT s.participant_id, start_us, count(*) FILTER (hour(ts) > 0) AS k FROM sleep s JOIN r ON s.participant_id = r.participant_id AND us BETWEEN start_us AND end_us GROUP BY 1, 2)
    SELECT fl.*, round((fl.end_us - fl.start_us) / 3600000000.0, 5) AS hours, coalesce(k, 0) AS minutes_with_steps,
      CAST(b.steps AS BIGINT) AS steps_before, b.mh AS max_hr_before, b.ms AS max_steps_before, round(b.pk, 5) AS peak_before, round(b.ca, 5) AS cardio_before, round(b.fb, 5) AS fat_burn_before, round(b.oo, 5) AS out_of_range_before,
      CAST(a.steps AS BIGINT) AS steps_after, a.mh AS max_hr_after, a.ms AS max_steps_after, round(a.pk, 5) AS peak_after, round(a.ca, 5) AS cardio_after, round(a.fb, 5) AS fat_burn_after, round(a.oo, 5) AS out_of_range_after
    FROM fl LEFT JOIN g b ON b.participant_id = fl.participant_id AND b.start_us = fl.start_us AND b.side = 'b' LEFT JOIN g a ON a.participant_id = fl.participant_id AND a.start_us = fl.start_us AND a.side = 'a'
    LEFT JOIN mv ON mv.participant_id = fl.participant_id AND mv.start_us = fl.start_us""")
def sleep_summary(t):
    sleep, work = two_tables(t)
    minutes = t.readings.select("participant_id", "ts", F.col("value").alias("heart_rate"), F.hour("ts").cast("bigint").alias("step_count"))
    return rounded(A.sleep_summary(sleep, minutes, work, min_rows=1), 5)


@query("sleep_slots", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 AS day, min(us) AS a, max(us) AS b, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1),
    u AS (SELECT participant_id, a AS start_us, a + 3600000000 * n AS end_us FROM d UNION ALL SELECT participant_id, a, b FROM d)
    SELECT participant_id, start_us, max(end_us) AS end_us FROM u GROUP BY 1, 2""")
def sleep_slots(t):
    d = t.readings.groupBy("participant_id", day_number("ts").alias("day")).agg(F.min(us("ts")).alias("a"), F.max(us("ts")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    wide = d.select("participant_id", F.timestamp_micros("a").alias("b1"), F.timestamp_micros(F.col("a") + F.col("n") * HOUR).alias("e1"), F.timestamp_micros("b").alias("e2"))
    return A.sleep_slots(wide, [("b1", "e1"), ("b1", "e2")]).drop("efficiency")


@query("awake_table", f"""
    WITH {{readings}}, {TWO}, v AS (SELECT *, value - 10 AS x FROM r),
    a AS (SELECT s.participant_id, start_us, end_us, count(*) FILTER (x >= 0) AS valid_length, avg(CASE WHEN x >= 0 THEN x END) AS m, stddev_pop(CASE WHEN x >= 0 THEN x END) AS sd
          FROM sleep s JOIN v ON s.participant_id = v.participant_id AND us BETWEEN start_us AND end_us GROUP BY 1, 2, 3 HAVING count(*) FILTER (x >= 0) > 1)
    SELECT participant_id, start_us, end_us, valid_length, round(m, 5) AS x_mean, round(sd, 5) AS x_std,
      CASE WHEN (SELECT count(*) FROM r q WHERE q.participant_id = a.participant_id AND q.state = 'purchase' AND q.us BETWEEN start_us AND end_us) > 1
             OR (SELECT count(*) FROM r q WHERE q.participant_id = a.participant_id AND q.state = 'signup' AND q.us BETWEEN start_us AND end_us) > 0 THEN 1 ELSE 0 END AS work FROM a""")
def awake_table(t):
    periods, _ = two_tables(t)
    r = t.readings
    minutes = r.withColumn("x", F.col("value") - 10)
    return rounded(A.awake_table(periods, minutes, ["x"], r.filter("state = 'purchase'"), None, r.filter("state = 'signup'"), min_valid=1, min_proximity=1), 5)


PHONE = """
    ph AS (SELECT *, value * 10 AS secs, us // 86400000000 AS day FROM r),
    pl AS (SELECT *, (lead(us) OVER (PARTITION BY participant_id, day ORDER BY us) - us) / 1000000.0 - floor(secs) AS pause FROM ph),
    dp AS (SELECT participant_id, day, count(*) AS frequency, sum(secs) AS total_time, avg(secs) AS mean_time, count(*) FILTER (secs <= 60) AS less_than_1min, count(*) FILTER (secs > 60 AND secs <= 300) AS "1min_5min",
      count(*) FILTER (secs > 60) AS above_1min, count(*) FILTER (secs >= 300) AS above_5min, avg(CASE WHEN pause <= 14400 THEN pause END) AS mean_inter FROM pl GROUP BY 1, 2),
    wd AS (SELECT DISTINCT participant_id, us // 86400000000 AS day FROM r WHERE state = 'purchase'),
    dw AS (SELECT dp.*, CASE WHEN wd.day IS NULL THEN 0 ELSE 1 END AS work FROM dp LEFT JOIN wd ON wd.participant_id = dp.participant_id AND wd.day = dp.day)"""


def daily_phone(t):
    src = t.readings.withColumn("secs", F.col("value") * 10)
    days = t.readings.filter("state = 'purchase'").withColumn("day", day_number("ts"))
    return A.daily_phone(src, "secs", days)


@query("daily_usage_summary", f"""
    WITH {{readings}}, {PHONE} SELECT participant_id, day, frequency, round(total_time, 4) AS total_time, round(mean_time, 4) AS mean_time, less_than_1min, "1min_5min", above_1min, above_5min, round(mean_inter, 4) AS mean_inter, work FROM dw""")
def daily_usage_summary(t):
    return rounded(daily_phone(t), 4)


@query("daily_features", f"""
    WITH {{readings}}, {PHONE}, w AS (SELECT participant_id, us // 86400000000 AS day, count(value) AS valid, avg(value) AS m, stddev_pop(value) AS sd, sum(value) AS s FROM r GROUP BY 1, 2 HAVING count(value) >= 3),
    sm AS (SELECT participant_id, us // 86400000000 AS day, min(value) AS resting FROM r WHERE state = 'view' GROUP BY 1, 2)
    SELECT dw.participant_id, dw.day, frequency, work, valid, round(m, 5) AS value_mean, round(sd, 5) AS value_std, round(s, 5) AS value_sum, resting
    FROM dw JOIN w ON w.participant_id = dw.participant_id AND w.day = dw.day LEFT JOIN sm ON sm.participant_id = dw.participant_id AND sm.day = dw.day""")
def daily_features(t):
    r = t.readings
    summary = r.filter("state = 'view'").groupBy("participant_id", day_number("ts").alias("day")).agg(F.min("value").alias("resting"))
    phone = daily_phone(t).select("participant_id", "day", "frequency", "work")
    return rounded(A.daily_features(phone, r, summary, ["value"], min_valid=3), 5)


@query("participant_profile_work_off", f"""
    WITH {{readings}}, {PHONE}
    SELECT participant_id, {", ".join(f"round(avg({c}), 4) AS {p}{m}_mean, round(stddev_pop({c}), 3) AS {p}{m}_std" for m in ("frequency", "total_time") for p, c in (("", m), ("work_", f"CASE WHEN work = 1 THEN {m} END"), ("off_", f"CASE WHEN work = 0 THEN {m} END")))}
    FROM dw GROUP BY 1""")
def participant_profile_work_off(t):
    out = A.profile(daily_phone(t), ["frequency", "total_time"])
    return out.withColumns({c: near(c, 4 if c.endswith("_mean") else 3) for c in out.columns if c != "participant_id"})


@query("phone_around_sleep", f"""
    WITH {{readings}}, {TWO}, l AS (SELECT * FROM sleep WHERE end_us - start_us >= 14400000000), q AS (SELECT *, value * 10 AS secs FROM r WHERE state IN ('signup', 'purchase')),
    w AS (SELECT participant_id, start_us, end_us, 'before' AS side, start_us - 3600000000 AS lo, start_us AS hi FROM l UNION ALL SELECT participant_id, start_us, end_us, 'during', start_us, end_us FROM l
          UNION ALL SELECT participant_id, start_us, end_us, 'after', end_us, end_us + 3600000000 FROM l)
    SELECT w.participant_id, start_us, end_us, side, count(us) AS frequency, round(coalesce(sum(secs), 0), 4) AS total_time, round(avg(secs), 4) AS mean_time,
      round(avg(CASE WHEN secs <= 60 THEN 1.0 WHEN secs > 60 THEN 0 END), 6) AS less_than_1min, round(avg(CASE WHEN secs > 60 THEN 1.0 WHEN secs <= 60 THEN 0 END), 6) AS above_1min
    FROM w LEFT JOIN q ON q.participant_id = w.participant_id AND us BETWEEN lo AND hi GROUP BY 1, 2, 3, 4""")
def phone_around_sleep(t):
    sleep, _ = two_tables(t)
    src = t.readings.filter(F.col("state").isin("signup", "purchase")).withColumn("secs", F.col("value") * 10)
    out = A.phone_around_sleep(src, sleep, "secs", margin_seconds=3600)
    return out.withColumns({c: near(c, 4) for c in ("total_time", "mean_time")}).withColumns({c: near(c, 6) for c in ("less_than_1min", "above_1min")})


@query("metrics_by_run_day", f"""
    WITH {{readings}}, {TWO}, d AS (SELECT DISTINCT participant_id, us // 86400000000 AS day FROM r WHERE state IN ('signup', 'purchase')),
    i AS (SELECT *, day - row_number() OVER (PARTITION BY participant_id ORDER BY day) AS k FROM d),
    rn AS (SELECT participant_id, min(day) AS first_day, count(*) AS days FROM i GROUP BY participant_id, k HAVING count(*) >= 2),
    ps AS (SELECT *, unnest(generate_series(0, days + 1)) AS position FROM rn), pw AS (SELECT *, (first_day + position - 1) * 86400000000 + 25200000000 AS lo FROM ps),
    u AS (SELECT pw.*, us, value * 10 AS secs, (lead(us) OVER (PARTITION BY pw.participant_id, first_day, position ORDER BY us) - us) / 1000000.0 - floor(value * 10) AS pause
          FROM pw LEFT JOIN r ON r.participant_id = pw.participant_id AND us >= lo AND us < lo + 86400000000),
    sl AS (SELECT pw.participant_id, first_day, position, sum((end_us - start_us) / 3600000000.0) AS h FROM pw JOIN sleep s ON s.participant_id = pw.participant_id AND start_us >= lo AND start_us < lo + 86400000000 GROUP BY 1, 2, 3)
    SELECT u.participant_id, u.first_day, days, u.position, count(us) AS frequency, round(coalesce(sum(secs), 0), 4) AS total_time, round(avg(secs), 4) AS mean_time, count(*) FILTER (secs > 60) AS above_1min, count(*) FILTER (secs <= 60) AS less_than_1min,
      round(CASE WHEN count(us) > 3 THEN avg(CASE WHEN pause <= 14400 THEN pause END) END, 4) AS mean_inter, round(max(CASE WHEN h > 2 THEN h END), 4) AS sleep_hours
    FROM u LEFT JOIN sl ON sl.participant_id = u.participant_id AND sl.first_day = u.first_day AND sl.position = u.position GROUP BY 1, 2, 3, 4""")
def metrics_by_run_day(t):
    sleep, _ = two_tables(t)
    runs = S.work_runs(t.readings.filter(F.col("state").isin("signup", "purchase")).withColumn("day", day_number("ts")))
    return rounded(A.metrics_by_run_day(t.readings.withColumn("secs", F.col("value") * 10), sleep, runs, "secs"), 4)


@query("tod_profile", """
    WITH {readings} SELECT participant_id, state, CAST(hour(ts) // 2 AS INT) AS slot, round(avg(value), 6) AS profile, count(value) AS n FROM r GROUP BY 1, 2, 3""")
def tod_profile(t):
    return r6(A.day_profile(t.readings, "value", F.floor(F.hour("ts") / 2).cast("int"), ["participant_id", "state"]), "profile")


@query("weekly_profile_fill", """
    WITH {readings}, p AS (SELECT participant_id, CAST(hour(ts) // 3 AS INT) AS slot, avg(value) AS profile FROM r GROUP BY 1, 2),
    s AS (SELECT participant_id, us // 86400000000 // 7 AS week, CAST(hour(ts) // 3 AS INT) AS slot, avg(value) AS v FROM r GROUP BY 1, 2, 3),
    k AS (SELECT participant_id, week FROM s GROUP BY 1, 2 HAVING 8 - count(*) < 4), c AS (SELECT participant_id, week, CAST(unnest(generate_series(0, 7)) AS INT) AS slot FROM k)
    SELECT c.participant_id, c.week, c.slot, round(coalesce(v, profile), 6) AS value FROM c LEFT JOIN s USING (participant_id, week, slot) LEFT JOIN p ON p.participant_id = c.participant_id AND p.slot = c.slot""")
def weekly_profile_fill(t):
    slot = F.floor(F.hour("ts") / 3).cast("int")
    prof = A.day_profile(t.readings, "value", slot)
    return r6(A.weekly_profile(t.readings, "value", prof, 8, 4, slot=slot), "value")


@query("tod_histogram_pdf", f"""
    WITH {{readings}}, c AS (SELECT participant_id, CAST(us % 86400000000 // 10800000000 AS INT) AS bin, state, count(*) AS n FROM r GROUP BY 1, 2, 3),
    g AS (SELECT * FROM (SELECT DISTINCT participant_id FROM r) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS bin) CROSS JOIN (SELECT unnest({list(STATES)}) AS state)),
    f AS (SELECT g.*, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN c USING (participant_id, bin, state))
    SELECT participant_id, bin, state, round(n / sum(n) OVER (PARTITION BY participant_id, bin), 8) AS p FROM f""")
def tod_histogram_pdf(t):
    return rounded(A.tod_pdf(t.readings, "state", STATES, 8), 8)


@query("location_quantiles", """
    WITH {readings}, x AS (SELECT participant_id, state, CAST(hour(ts) // 12 AS VARCHAR) AS section, value - 40 AS v FROM r),
    y AS (SELECT * FROM x UNION ALL SELECT participant_id, state, 'global', v FROM x)
    SELECT participant_id, section, state, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 5) AS share_above, round(avg(CASE WHEN v > 0 THEN 0 ELSE 1.0 END), 5) AS share_below,
      round(sum(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN v > 0 THEN 0 ELSE 1.0 END), 0), 5) AS ratio,
      round(quantile_cont(v, 0.1), 5) AS q10, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.75), 5) AS q75, round(quantile_cont(v, 0.9), 5) AS q90 FROM y GROUP BY 1, 2, 3""")
def location_quantiles(t):
    src = t.readings.withColumn("v", F.col("value") - 40).withColumn("section", F.floor(F.hour("ts") / 12))
    return rounded(A.location_distribution(src, "v", "state", "section"), 5)


@query("rate_by_location", """
    WITH {readings}, c AS (SELECT participant_id, hour(ts) // 6 AS section, state, count(*) AS stay, count(CASE WHEN value > 40 THEN 1 END) AS speak FROM r GROUP BY 1, 2, 3)
    SELECT *, round(stay / sum(stay) OVER (PARTITION BY participant_id, section), 6) AS stay_rate, round(speak / stay, 6) AS speak_rate FROM c""")
def rate_by_location(t):
    src = t.readings.withColumn("section", F.floor(F.hour("ts") / 6)).withColumn("spoke", F.when(F.col("value") > 40, F.col("value")))
    return rounded(A.stay_speak_rate(src, "spoke", "state", ["participant_id", "section"]), 6)


@query("snippet_features", """
    WITH {channels}, i AS (SELECT *, us - lag(us) OVER (PARTITION BY participant_id ORDER BY us) AS gap FROM r),
    j AS (SELECT *, sum(CASE WHEN gap > 600000000 THEN 1 ELSE 0 END) OVER w AS sub, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER w AS utt FROM i WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    k AS (SELECT participant_id, utt, sub, count(*) AS c FROM j GROUP BY 1, 2, 3), m AS (SELECT participant_id, utt, count(*) AS segments, avg(c) AS mean_segment FROM k GROUP BY 1, 2 HAVING sum(c) > 5 AND sum(c) < 2000),
    f AS (SELECT j.participant_id, j.utt, min(us) AS start_us, max(us) AS end_us, count(*) AS n, avg(CASE WHEN value > 0 THEN value END) AS p, stddev_pop(CASE WHEN value > 0 THEN value END) AS ps,
       quantile_cont(CASE WHEN value > 0 THEN value END, 0.1) AS p1, quantile_cont(CASE WHEN value > 0 THEN value END, 0.9) AS p9, avg(CASE WHEN source > 20 THEN source END) AS h, stddev_pop(CASE WHEN source > 20 THEN source END) AS hs,
       quantile_cont(CASE WHEN source > 20 THEN source + 0.0::DOUBLE END, 0.1) AS h1, quantile_cont(CASE WHEN source > 20 THEN source + 0.0::DOUBLE END, 0.9) AS h9 FROM j GROUP BY 1, 2 HAVING count(*) FILTER (value > 0) > 0)
    SELECT f.participant_id, start_us, end_us, segments, round(mean_segment, 5) AS mean_segment, n, round(p, 5) AS value_mean, round(ps, 5) AS value_std, round(p1, 5) AS value_q10, round(p9, 5) AS value_q90,
      round(h, 5) AS source_mean, round(hs, 5) AS source_std, round(h1, 5) AS source_q10, round(h9, 5) AS source_q90, round(n / 2000, 6) AS foreground_ratio FROM f JOIN m USING (participant_id, utt)""")
def snippet_features(t):
    u = S.utterances(t.channels, pause=3600, sub_gap=600, min_n=5).select("participant_id", "start_us", "end_us", "segments", "mean_segment")
    out = A.snippet_features(t.channels, u, positive=["value"], above={"source": 20}, bucket_seconds=3600)
    return r6(rounded(out, 5, "foreground_ratio"), "foreground_ratio")


SPEECH = """
    w AS (SELECT DISTINCT participant_id, us // 86400000000 * 86400000000 AS start_us FROM r),
    x AS (SELECT w.participant_id, start_us, start_us + 86399000000 AS end_us, value / 20 AS v, row_number() OVER (PARTITION BY w.participant_id, start_us ORDER BY us) AS i FROM w JOIN r ON r.participant_id = w.participant_id AND us BETWEEN start_us AND start_us + 86399000000),
    y AS (SELECT *, CASE WHEN v > 3 THEN max(CASE WHEN v > 3 THEN i END) OVER (PARTITION BY participant_id, start_us ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS b FROM x),
    z AS (SELECT *, CASE WHEN v > 3 AND b IS NULL AND i <= 100 THEN i - 1 WHEN v > 3 AND i - b > 1 THEN i - b END AS gap FROM y),
    d AS (SELECT participant_id, start_us, end_us, count(*) AS duration, coalesce(max(gap), 0) AS longest_silence, {cols}
          FROM z GROUP BY 1, 2, 3 HAVING count(*) > 30 AND count(*) < 800 AND count(*) FILTER (v > 3) >= 5 AND coalesce(max(gap), 0) <= 15)"""
SPEECH_COLS = ", ".join(f"count(*) FILTER (v > {k}) AS above_{k}s, count(*) FILTER (v > {k}) / count(*) AS above_{k}s_share" for k in (0, 1, 2, 3, 5, 6))


def speech(t):
    src = t.channels.withColumn("v", F.col("value") / 20)
    days = src.select("participant_id", (day_number("ts") * DAY).alias("start_us")).distinct().withColumn("end_us", F.col("start_us") + 86399000000)
    return A.speech_days(src, days, "v", min_minutes=30, min_speak=5, max_silence=15, bucket_seconds=86400)


@query("speech_days", f"WITH {{channels}}, {SPEECH.replace('{cols}', SPEECH_COLS)} SELECT participant_id, start_us, end_us, duration, longest_silence, {', '.join(f'above_{k}s, round(above_{k}s_share, 6) AS above_{k}s_share' for k in (0, 1, 2, 3, 5, 6))} FROM d")
def speech_days(t):
    return rounded(speech(t).withColumn("longest_silence", F.col("longest_silence").cast("bigint")), 6)


@query("speech_day_stats", f"WITH {{channels}}, {SPEECH.replace('{cols}', SPEECH_COLS)} SELECT participant_id, count(*) AS shifts, {', '.join(f'round(avg({c}), 5) AS {c}_mean, round(stddev_pop({c}), 5) AS {c}_std' for k in (0, 1, 2, 3, 5, 6) for c in (f'above_{k}s', f'above_{k}s_share'))} FROM d GROUP BY 1 HAVING count(*) > 5")
def speech_day_stats(t):
    return rounded(A.speech_day_stats(speech(t)), 5)


def flagged_sleep(t):
    sleep, work = two_tables(t)
    return I.interval_proximity(sleep, work)


@query("sleep_by_class", f"""
    WITH {{readings}}, {TWO}, {FLAGS}, k AS (SELECT *, (end_us - start_us) / 3600000000.0 AS h, hour(make_timestamp(start_us)) AS hh, (start_us // 1000000) % 100 / 100.0 AS eff FROM fl),
    c AS (SELECT *, CASE WHEN before_work = 1 AND h >= 2 THEN 'work' WHEN before_work = 0 AND h >= 2 THEN 'off' WHEN before_work = 0 THEN 'nap' END AS kind, CASE WHEN hh >= 12 THEN hh - 24 ELSE hh END AS st FROM k)
    SELECT participant_id, kind, count(*) AS n, round(avg(h), 5) AS duration_mean, round(stddev_pop(h), 5) AS duration_std, round(avg(eff), 5) AS efficiency_mean, round(stddev_pop(eff), 5) AS efficiency_std, round(stddev_pop(st), 5) AS start_std FROM c WHERE kind IS NOT NULL GROUP BY 1, 2""")
def sleep_by_class(t):
    src = flagged_sleep(t).withColumn("efficiency", F.floor(F.col("start_us") / 1000000) % 100 / 100.0)
    return rounded(A.sleep_by_class(src), 5)


@query("scores_by_unit", """
    WITH c AS (SELECT n_name AS unit, r_name AS kind, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'unit' AS level, unit AS name, count(*) AS n, round(avg(bal), 5) AS bal_mean, round(stddev_pop(bal), 4) AS bal_std FROM c GROUP BY unit
    UNION ALL SELECT 'type', kind, count(*), round(avg(bal), 5), round(stddev_pop(bal), 4) FROM c GROUP BY kind""")
def scores_by_unit(t):
    dim = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    dim = dim.select(F.col("n_name").alias("unit"), F.col("r_name").alias("kind"), F.col("c_acctbal").alias("bal"))
    out = A.scores_by_unit(dim, "unit", "kind", ["bal"])
    return out.withColumn("bal_mean", near("bal_mean", 5)).withColumn("bal_std", near("bal_std", 4))


@query("cohort_shares", """
    SELECT c_mktsegment AS segment, count(*) AS n, round(avg(CASE WHEN c_nationkey BETWEEN 10 AND 19 THEN 1.0 ELSE 0 END), 6) AS middle, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 6) AS negative FROM customer GROUP BY 1""")
def cohort_shares(t):
    dim = t.customer.withColumnRenamed("c_mktsegment", "segment")
    return rounded(A.cohort_shares(dim, {"middle": F.col("c_nationkey").between(10, 19), "negative": F.col("c_acctbal") < 0}, ["segment"]), 6)


@query("mode_unit", """
    WITH {readings}, c AS (SELECT participant_id, state, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY n DESC, state) = 1""")
def mode_unit(t):
    return A.mode_of(t.readings, ["participant_id"], "state")


def transitions_sql(back):
    return f"""an AS (SELECT participant_id, start_us AS anchor_us FROM fl WHERE before_work_nearest = 1 AND after_work = 0),
    sn AS (SELECT an.participant_id, anchor_us, start_us, end_us, after_work, (end_us - start_us) / 3600000000.0 AS h, hour(make_timestamp(start_us)) AS hh, hour(make_timestamp(start_us)) + minute(make_timestamp(start_us)) / 60.0 AS hf
           FROM an JOIN fl USING (participant_id) WHERE start_us BETWEEN anchor_us - {back} * 3600000000 AND anchor_us + 60000000)"""


@query("sleep_transitions_night", f"""
    WITH {{readings}}, {TWO}, {FLAGS}, {transitions_sql(24)},
    w AS (SELECT participant_id, anchor_us, count(*) AS k, min(start_us) AS s1, max(start_us) AS s2, arg_min(end_us, start_us) AS e1, arg_max(end_us, start_us) AS e2, arg_min(hh, start_us) AS h1, arg_max(hh, start_us) AS h2 FROM sn GROUP BY 1, 2),
    c AS (SELECT *, (s2 - e1) / 3600000000.0 AS gap, (e2 - s1) / 3600000000.0 AS span, (e1 - s1) / 3600000000.0 > 8 AS lg, h1 >= 18 OR h1 < 3 AS ev FROM w),
    d AS (SELECT participant_id, anchor_us, CASE WHEN k = 2 THEN CASE WHEN gap < 2 AND ev AND span < 8 THEN 'no_sleep' WHEN gap < 2 AND ev THEN 'switch' WHEN gap < 2 THEN 'incomplete' WHEN h2 BETWEEN 10 AND 17 AND (h1 >= 20 OR h1 < 8) THEN 'nap' END
      WHEN k = 1 THEN CASE WHEN h1 BETWEEN 3 AND 11 AND NOT lg THEN 'incomplete' WHEN ev AND NOT lg THEN 'no_sleep' WHEN ev THEN 'switch' WHEN h1 BETWEEN 10 AND 17 THEN 'nap' END END AS kind FROM c)
    SELECT participant_id, count(*) AS n, {", ".join(f"round(avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0 END), 6) AS {k}" for k in ("nap", "incomplete", "switch", "no_sleep"))} FROM d WHERE kind IS NOT NULL GROUP BY 1""")
def sleep_transitions_night(t):
    kinds = A.sleep_transitions(flagged_sleep(t), "night")
    return rounded(A.class_frequency(kinds, ["nap", "incomplete", "switch", "no_sleep"]), 6)


@query("sleep_transitions_day", f"""
    WITH {{readings}}, {TWO}, {FLAGS}, {transitions_sql(36)}, m AS (SELECT *, CASE WHEN hf > 12 THEN hf - 24 ELSE hf END AS x, row_number() OVER (PARTITION BY participant_id, anchor_us ORDER BY start_us DESC) AS k FROM sn WHERE after_work = 0 AND h > 4)
    SELECT a.participant_id, a.anchor_us, CASE WHEN abs(a.x - b.x) < 1 THEN 'con' ELSE 'non_con' END AS kind FROM m a JOIN m b ON a.participant_id = b.participant_id AND a.anchor_us = b.anchor_us AND a.k = 1 AND b.k = 2""")
def sleep_transitions_day(t):
    return A.sleep_transitions(flagged_sleep(t), "day")


@query("sleep_development", f"""
    WITH {{readings}}, {TWO}, {FLAGS}, a AS (SELECT *, (end_us - start_us) / 3600000000.0 AS h, before_work = 1 OR after_work = 1 AS tied, before_work = 1 AND after_work = 0 AS fst FROM fl),
    b AS (SELECT *, lag(tied) OVER w AS ptied, lag(fst) OVER w AS pfst, coalesce((start_us - lag(start_us) OVER w) / 3600000000.0, 1e9) AS gap FROM a WINDOW w AS (PARTITION BY participant_id ORDER BY start_us)),
    c AS (SELECT *, NOT tied OR NOT coalesce(ptied, false) OR gap >= 72 OR (fst AND NOT (coalesce(pfst, false) AND gap < 8)) AS opens FROM b),
    d AS (SELECT *, max(CASE WHEN opens THEN start_us END) OVER w AS run, max(CASE WHEN opens OR gap >= 8 THEN start_us END) OVER w AS night FROM c WINDOW w AS (PARTITION BY participant_id ORDER BY start_us)),
    e AS (SELECT participant_id, run, night, sum(h) AS h FROM d WHERE tied GROUP BY 1, 2, 3),
    f AS (SELECT participant_id, run, count(*) AS k, arg_min(h, night) AS first, arg_max(h, night) AS last, sum(h) AS s FROM e GROUP BY 1, 2 HAVING count(*) >= 3 AND min(h) >= 0),
    g AS (SELECT participant_id, count(*) AS runs, avg(first) AS first, avg((s - first - last) / (k - 2)) AS middle, avg(last) AS last FROM f GROUP BY 1)
    SELECT participant_id, runs, round(first, 5) AS first, round(middle, 5) AS middle, round(last, 5) AS last, round((last - first) / 2, 5) AS slope,
      CASE WHEN (last - first) / 2 > 0.1 THEN 'increase' WHEN (last - first) / 2 < -0.1 THEN 'decrease' ELSE 'unchanged' END AS trend FROM g""")
def sleep_development(t):
    return rounded(A.sleep_development(flagged_sleep(t), run_gap_hours=72, min_hours=-1.0), 5)


@query("room_contrast", """
    WITH {readings}, s AS (SELECT participant_id % 10 AS team, state, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM r GROUP BY 1, 2)
    SELECT a.team, a.state AS room_a, b.state AS room_b, a.n AS n_a, round(a.mean, 5) AS mean_a, round(a.q25, 5) AS q25_a, round(a.median, 5) AS median_a, round(a.q75, 5) AS q75_a,
      b.n AS n_b, round(b.mean, 5) AS mean_b, round(b.q25, 5) AS q25_b, round(b.median, 5) AS median_b, round(b.q75, 5) AS q75_b, round(a.median - b.median, 5) AS difference, abs(a.median - b.median) > 5 AS differs
    FROM s a JOIN s b ON a.team = b.team AND a.state < b.state""")
def room_contrast(t):
    src = t.readings.withColumn("team", F.col("participant_id") % 10)
    return rounded(A.room_contrast(src, "value", "state", 5, ["team"]), 5)


@query("state_transitions", """
    WITH {readings}, f AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY participant_id ORDER BY us) THEN 1 ELSE 0 END AS chg FROM r),
    c AS (SELECT participant_id, us, state FROM f WHERE chg = 1), n AS (SELECT participant_id, state AS from_state, lead(state) OVER (PARTITION BY participant_id ORDER BY us) AS to_state FROM c)
    SELECT participant_id, from_state, to_state, count(*) AS n FROM n WHERE to_state IS NOT NULL GROUP BY 1, 2, 3""")
def state_transitions(t):
    return A.transition_counts(S.state_runs(t.readings, "state"), "state")


@query("state_shares", """
    WITH {readings}, c AS (SELECT participant_id, us // 86400000000 AS day, state, count(*) AS n FROM r GROUP BY 1, 2, 3)
    SELECT *, round(n / sum(n) OVER (PARTITION BY participant_id, day), 6) AS share FROM c""")
def state_shares(t):
    return rounded(A.state_shares(t.readings.withColumn("day", day_number("ts")), "state", ["participant_id", "day"]), 6)
