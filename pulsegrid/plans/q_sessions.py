"""Sessions, runs and islands."""

from pyspark.sql import functions as F

from ..functions.time import HOUR, MINUTE, SECOND, day_number
from ..operators import sessions as S
from .registry import near, query

GAPS = """
    g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {gap} THEN 1 ELSE 0 END AS brk FROM r
          WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY participant_id ORDER BY us) AS sid FROM g)"""


def gaps(hours):
    return GAPS.replace("{gap}", str(int(hours * 3600 * 1_000_000)))


@query("gap_sessions", f"""
    WITH {{readings}}, {gaps(12)}
    SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n,
           round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value
    FROM s GROUP BY participant_id, sid""")
def gap_sessions(t):
    out = S.sessions(t.readings, 12 * 3600, measures={"m": ("avg", F.col("value")), "s": ("std", F.col("value"))})
    return out.select(
        "participant_id", "start_us", "end_us", "n", near("m", 6).alias("mean_value"), near("s", 6).alias("std_value")
    )


@query("shift_sessions", f"""
    WITH {{readings}}, {gaps(6)}, a AS (
      SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid)
    SELECT * FROM a WHERE (end_us - start_us) / 60000000.0 BETWEEN 30 AND 900""")
def shift_sessions(t):
    return S.shift_sessions(t.readings)


@query("recordings_min_rows", f"""
    WITH {{readings}}, {gaps(8)}, a AS (
      SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid)
    SELECT *, round((end_us - start_us) / 3600000000.0, 6) AS hours FROM a WHERE n BETWEEN 2 AND 900""")
def recordings_min_rows(t):
    return S.recordings(t.readings, min_rows=2).withColumn("hours", near("hours", 6))


@query("session_filter_minmax", f"""
    WITH {{readings}}, {gaps(12)}, a AS (
      SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid
      HAVING count(*) BETWEEN 3 AND 900)
    SELECT * FROM a WHERE participant_id IN (SELECT participant_id FROM a GROUP BY 1 HAVING count(*) >= 5)""")
def session_filter_minmax(t):
    return S.valid_recordings(t.readings, 12 * 3600, min_rows=3, max_rows=900, min_kept=5)


@query("long_recordings", f"""
    WITH {{readings}}, {gaps(12)}, a AS (
      SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid
      HAVING max(us) - min(us) >= 7200000000)
    SELECT * FROM a WHERE participant_id IN (SELECT participant_id FROM a GROUP BY 1 HAVING count(*) >= 10)""")
def long_recordings(t):
    return S.long_recordings(t.readings, 12 * 3600)


@query("dense_blocks", f"""
    WITH {{channels}}, {gaps(1)}
    SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid
    HAVING max(us) - min(us) >= 10800000000""")
def dense_blocks(t):
    return S.blocks(t.channels, 3600, 180)


@query("utterances", f"""
    WITH {{channels}}, i AS (SELECT *, us - lag(us) OVER (PARTITION BY participant_id ORDER BY us) AS gap FROM r),
    j AS (SELECT *, sum(CASE WHEN gap > 600000000 THEN 1 ELSE 0 END) OVER w AS sub,
                    sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER w AS utt FROM i
          WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    k AS (SELECT participant_id, utt, sub, min(us) AS a, max(us) AS b, count(*) AS c FROM j GROUP BY 1, 2, 3)
    SELECT participant_id, min(a) AS start_us, max(b) AS end_us, CAST(sum(c) AS BIGINT) AS n, count(*) AS segments,
           round(avg(c), 6) AS mean_segment, max(c) AS longest_segment
    FROM k GROUP BY participant_id, utt HAVING sum(c) > 5 AND sum(c) < 2000""")
def utterances(t):
    out = S.utterances(t.channels, pause=3600, sub_gap=600, min_n=5)
    return out.withColumn("mean_segment", near("mean_segment", 6))


@query("frame_runs", f"""
    WITH {{channels}}, {gaps(0.25)}
    SELECT participant_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY participant_id, sid""")
def frame_runs(t):
    return S.frame_runs(t.channels, 900)


DAYS = "d AS (SELECT DISTINCT participant_id, us // 86400000000 AS day FROM r)"


@query("work_runs", f"""
    WITH {{readings}}, {DAYS},
    i AS (SELECT *, day - row_number() OVER (PARTITION BY participant_id ORDER BY day) AS k FROM d)
    SELECT participant_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days
    FROM i GROUP BY participant_id, k HAVING count(*) >= 2""")
def work_runs(t):
    return S.work_runs(t.readings.select("participant_id", day_number("ts").alias("day")))


@query("longest_valid_run", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 AS day, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS share
                           FROM r GROUP BY 1, 2),
    i AS (SELECT *, day - row_number() OVER (PARTITION BY participant_id ORDER BY day) AS k FROM d WHERE share > 0.5),
    a AS (SELECT participant_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i
          GROUP BY participant_id, k HAVING count(*) >= 2)
    SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY days DESC, first_day) = 1""")
def longest_valid_run(t):
    days = t.readings.groupBy("participant_id", day_number("ts").alias("day")).agg(
        F.avg((F.col("value") > 30).cast("double")).alias("share")
    )
    return S.longest_valid_run(days, min_days=2)


RLE = """
    f AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS chg FROM r
          WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    k AS (SELECT *, sum(chg) OVER (PARTITION BY participant_id ORDER BY us) AS rid FROM f),
    runs AS (SELECT participant_id, min(state) AS state, min(us) AS start_us, max(us) AS end_us, count(*) AS n
             FROM k GROUP BY participant_id, rid)"""


@query("rle_runs", f"WITH {{readings}}, {RLE} SELECT * FROM runs")
def rle_runs(t):
    return S.state_runs(t.readings, "state")


@query("conversation_runs", """
    WITH r AS (SELECT conv_id, turn, role, length(text) AS chars FROM conversations),
    f AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS chg FROM r),
    k AS (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn) AS rid FROM f)
    SELECT conv_id, min(role) AS role, min(turn) AS start_us, max(turn) AS end_us, count(*) AS n,
           CAST(sum(chars) AS BIGINT) AS chars FROM k GROUP BY conv_id, rid""")
def conversation_runs(t):
    turns = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("c"))
    return S.state_runs(turns, "role", pid="conv_id", ts="turn", time_is_us=True, measures={"chars": ("sum", F.col("c"))})


@query("speak_silence", """
    WITH {channels}, b AS (SELECT *, value > 40 AS speaking FROM r),
    f AS (SELECT *, CASE WHEN speaking IS DISTINCT FROM lag(speaking) OVER (PARTITION BY participant_id ORDER BY us) THEN 1 ELSE 0 END AS chg FROM b),
    k AS (SELECT *, sum(chg) OVER (PARTITION BY participant_id ORDER BY us) AS rid FROM f),
    runs AS (SELECT participant_id, speaking, rid, count(*) AS n FROM k GROUP BY 1, 2, 3)
    SELECT participant_id, speaking, count(*) AS runs, CAST(sum(n) AS BIGINT) AS minutes, round(avg(n), 6) AS mean_run,
           round(stddev_pop(n), 6) AS std_run, max(n) AS longest_run FROM runs GROUP BY 1, 2""")
def speak_silence(t):
    out = S.speak_silence(t.channels, "value", 40)
    return out.withColumn("mean_run", near("mean_run", 6)).withColumn("std_run", near("std_run", 6))


@query("cycle_starts", """
    WITH {readings}, p AS (SELECT participant_id, us, value > 60 AS on_flag,
                                  row_number() OVER (PARTITION BY participant_id ORDER BY us) AS step FROM r),
    o AS (SELECT *, step - coalesce(lag(step) OVER (PARTITION BY participant_id ORDER BY us), 0) AS d FROM p WHERE on_flag),
    s AS (SELECT * FROM o WHERE d > 3)
    SELECT participant_id, us AS start_us, step, lead(step) OVER (PARTITION BY participant_id ORDER BY us) - step AS cycle_steps FROM s""")
def cycle_starts(t):
    return S.cycle_starts(t.readings.withColumn("on_flag", F.col("value") > 60), "on_flag")


@query("inter_session_gap", """
    WITH {readings}, x AS (SELECT *, (lead(us) OVER (PARTITION BY participant_id ORDER BY us) - us) / 1000000.0 - value AS pause FROM r)
    SELECT participant_id, count(*) AS pauses, round(avg(pause), 5) AS mean_pause FROM x WHERE pause <= 14400 GROUP BY 1""")
def inter_session_gap(t):
    return S.inter_session(t.readings, "value").withColumn("mean_pause", near("mean_pause", 5))
