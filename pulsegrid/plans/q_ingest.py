"""Ingest hygiene, scalar functions, labels, scores."""

import uuid

from pyspark.sql import functions as F, types as T

from ..functions import labels as L, scoring as SC, signal as SG
from ..functions.time import from_unix, to_local, to_unix, us
from ..session import cut_lineage, shared_folder
from ..sources import hygiene as HY, readers as R, sinks as SK
from .registry import near, query


@query("dedupe_first", """
    WITH {readings} SELECT participant_id, us, value, state FROM r
    QUALIFY row_number() OVER (PARTITION BY state, value ORDER BY us, participant_id) = 1""")
def dedupe_first(t):
    src = t.readings.withColumn("us", us("ts")).drop("ts")
    return HY.dedupe(src, ["state", "value"], ["us", "participant_id"])


@query("dedupe_last", """
    WITH {readings} SELECT participant_id, day, us, value FROM (SELECT *, us // 86400000000 AS day FROM r)
    QUALIFY row_number() OVER (PARTITION BY participant_id, day ORDER BY us DESC) = 1""")
def dedupe_last(t):
    src = t.readings.withColumn("us", us("ts")).withColumn("day", F.floor(F.col("us") / 86400000000))
    return HY.dedupe(src.select("participant_id", "day", "us", "value"), ["participant_id", "day"], ["us"], keep="last")


@query("proximity_cut", """
    SELECT user_id AS participant_id, count(*) AS n, min(value) AS lowest FROM events WHERE value >= 80 GROUP BY 1""")
def proximity_cut(t):
    return R.proximity_cut(t.readings, 80, "value", ["state"]).groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"))


@query("survey_of_type", "SELECT user_id AS participant_id, event_id, value FROM events WHERE event_type = 'signup'")
def survey_of_type(t):
    return HY.survey_of_type(t.events, "signup", "event_type").select(F.col("user_id").alias("participant_id"), "event_id", "value")


@query("union_cohorts", """
    SELECT cohort, key, balance, size FROM (
      SELECT 'customer' AS cohort, c_custkey AS key, c_acctbal AS balance, NULL::INTEGER AS size FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier
      UNION ALL SELECT 'part', p_partkey, NULL, p_size FROM part) WHERE key <> 7""")
def union_cohorts(t):
    a = t.customer.select(F.lit("customer").alias("cohort"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.lit("supplier").alias("cohort"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = t.part.select(F.lit("part").alias("cohort"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return HY.union_cohorts(a, b, c, header=("key", 7))


@query("fill_const", """
    SELECT c_custkey AS id, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM customer
    LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 5) AS v FROM events GROUP BY 1) ON user_id = c_custkey""")
def fill_const(t):
    e = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), near(F.sum("value"), 5).alias("v"))
    return HY.fill_const(t.customer.select(F.col("c_custkey").alias("id")).join(e, "id", "left"), 0, ["n", "v"])


@query("parse_json_props", """
    SELECT user_id AS participant_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1""")
def parse_json_props(t):
    parsed = R.parse_json_lines(t.events.select("user_id", "props"), "props", "k BIGINT")
    return parsed.groupBy(F.col("user_id").alias("participant_id")).agg(F.sum("k").alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("parse_csv_names", """
    SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word, p_size * 2 AS doubled FROM part""")
def parse_csv_names(t):
    lines = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(",", F.split("p_name", " ")[0], F.split("p_name", " ")[1], "p_size").alias("line"))
    out = R.parse_csv_lines(lines, "line", "first_word STRING, second_word STRING, size INT")
    return out.select("id", "first_word", "second_word", (F.col("size") * 2).alias("doubled"))


@query("local_time", """
    SELECT user_id AS participant_id, hour(ts - INTERVAL 8 HOUR) AS local_hour, count(*) AS n, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first_second
    FROM events GROUP BY 1, 2""")
def local_time(t):
    local = to_local(F.col("ts").cast("timestamp"), "America/Los_Angeles")  # January: eight hours behind
    return t.readings.groupBy("participant_id", F.hour(local).cast("bigint").alias("local_hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min(to_unix("ts")).alias("first_second"))


@query("unix_round_trip", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events")
def unix_round_trip(t):
    return t.events.select("event_id", to_unix(from_unix(to_unix("ts"))).alias("sec"))


@query("clean_numeric", """
    WITH a AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_size || 'a' ELSE ' ' || p_size END AS answer FROM part)
    SELECT id, CASE WHEN regexp_full_match(trim(answer), '[-+]?[0-9]*\\.?[0-9]+') AND length(trim(answer)) <= 2 THEN TRY_CAST(trim(answer) AS DOUBLE) END AS number FROM a""")
def clean_numeric(t):
    size = F.col("p_size")
    answer = F.when(size % 4 == 0, " ").when(size % 4 == 1, F.concat(size, F.lit("a"))).otherwise(F.concat(F.lit(" "), size))
    return t.part.select(F.col("p_partkey").alias("id"), SC.clean_numeric(answer, 2).alias("number"))


@query("participants", """
    SELECT user_id AS participant_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def participants(t):
    a = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("participant_id"))
    b = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("participant_id"))
    return R.participants_union(a, b)


@query("unit_and_room", """
    WITH p AS (SELECT o_orderkey AS id, 'site:floor' || (o_custkey % 3) || ':' || o_orderstatus || ':' ||
        CASE o_orderkey % 7 WHEN 0 THEN 'pat1' WHEN 1 THEN 'lounge' WHEN 2 THEN 'ns2' WHEN 3 THEN 'med' WHEN 4 THEN 'lab' WHEN 5 THEN 'receiving' ELSE 'hall' END AS path FROM orders),
    u AS (SELECT *, regexp_replace(path, ':[^:]*$', '') AS unit FROM p),
    c AS (SELECT *, CASE WHEN contains(path, 'site:floor1:P:') THEN
        CASE WHEN contains(path, 'pat') THEN 'pat' WHEN contains(path, 'lounge') THEN 'lounge' WHEN contains(path, 'ns') THEN 'ns'
             WHEN contains(path, 'med') THEN 'med' WHEN contains(path, 'lab') THEN 'lab' WHEN contains(path, 'receiving') THEN 'receiving' END
        WHEN contains(path, 'floor2') THEN 'floor2' ELSE 'other_floor' END AS room FROM u)
    SELECT unit, room, CASE WHEN room IN ('other_floor', 'unknown', 'floor2') THEN 'other' ELSE room END AS coarse, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def unit_and_room(t):
    rooms = F.array(*[F.lit(x) for x in ("pat1", "lounge", "ns2", "med", "lab", "receiving", "hall")])
    path = F.concat(F.lit("site:floor"), F.col("o_custkey") % 3, F.lit(":"), "o_orderstatus", F.lit(":"),
                    F.element_at(rooms, (F.col("o_orderkey") % 7 + 1).cast("int")))
    src = t.orders.select(path.alias("path")).withColumn("primary", F.lit("site:floor1:P"))
    room = src.select(L.unit_of("path").alias("unit"), L.room_class("path", "primary").alias("room"))
    return room.withColumn("coarse", L.coarse_location("room")).groupBy("unit", "room", "coarse").agg(F.count(F.lit(1)).alias("n"))


@query("cohort_labels", """
    WITH a AS (SELECT c_custkey AS id, c_custkey % 5 AS pos, CASE c_custkey % 4 WHEN 0 THEN '5 South ICU' WHEN 1 THEN 'Laboratory' WHEN 2 THEN '7 West' ELSE '9 East' END AS unit,
      CASE WHEN c_nationkey % 2 = 0 THEN 'Day shift' ELSE 'Night shift' END AS sh FROM customer)
    SELECT id, CASE WHEN pos = 1 THEN 'nurse' WHEN unit = 'Laboratory' OR pos = 3 THEN 'lab' ELSE 'non_nurse' END AS job,
      CASE WHEN sh = 'Day shift' THEN 'day' ELSE 'night' END AS shift, CASE WHEN pos = 1 THEN 'Supervise' ELSE 'Non-Supervise' END AS supervise,
      CASE WHEN pos = 1 THEN 'English' ELSE 'Non-English' END AS language, CASE WHEN unit IN ('5 South ICU', '7 West') THEN 'icu' ELSE 'non_icu' END AS icu FROM a""")
def cohort_labels(t):
    units = F.array(*[F.lit(x) for x in ("5 South ICU", "Laboratory", "7 West", "9 East")])
    src = t.customer.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("pos"), F.element_at(units, (F.col("c_custkey") % 4 + 1).cast("int")).alias("unit"),
        F.when(F.col("c_nationkey") % 2 == 0, "Day shift").otherwise("Night shift").alias("sh"))
    return src.select("id", *[c.alias(n) for n, c in L.cohort_labels("pos", "unit", "sh", "pos", "pos").items()])


@query("questionnaire_scoring", """
    WITH a AS (SELECT p_partkey AS id, p_size % 4 AS q, p_size AS latency, 4 + p_partkey % 5 AS slept, 9 + p_partkey % 3 AS bed, (p_partkey % 4) * 15 AS bed_min, 5 + p_partkey % 4 AS rise FROM part),
    b AS (SELECT *, CASE WHEN latency <= 15 THEN 0 WHEN latency <= 30 THEN 1 WHEN latency <= 60 THEN 2 ELSE 3 END + q AS lat,
                 slept / (CASE WHEN q = 2 THEN rise + 0.5 - (bed + bed_min / 60.0) ELSE 12 - (bed + bed_min / 60.0) + rise + 0.5 END) AS eff, q * 8 + q AS dist, 2 * q - 1 AS dys FROM a)
    SELECT id, CAST(q AS INT) AS subject_quality, CASE WHEN lat = 0 THEN 0 WHEN lat <= 2 THEN 1 WHEN lat <= 4 THEN 2 ELSE 3 END AS sleep_latency,
      CASE WHEN slept > 7 THEN 0 WHEN slept > 6 THEN 1 WHEN slept > 5 THEN 2 ELSE 3 END AS sleep_duration,
      CASE WHEN eff > 0.85 THEN 0 WHEN eff > 0.75 THEN 1 WHEN eff > 0.65 THEN 2 ELSE 3 END AS sleep_efficiency,
      CASE WHEN dist < 1 THEN 0 WHEN dist <= 9 THEN 1 WHEN dist <= 18 THEN 2 ELSE 3 END AS sleep_disturbance, CAST(q AS INT) AS sleep_medication,
      CASE WHEN dys = 0 THEN 0 WHEN dys IN (1, 2) THEN 1 WHEN dys IN (3, 4) THEN 2 WHEN dys IN (5, 6) THEN 3 END AS day_dysfunction FROM b""")
def questionnaire_scoring(t):
    q = (F.col("p_size") % 4).cast("string")
    key = F.col("p_partkey")
    cols = {f"psqi5{x}": q for x in "abcdefghi"} | {"psqi5jb": q, "psqi6": q, "psqi7": q, "psqi8": q, "psqi9": q}
    cols |= {"psqi2": F.col("p_size").cast("string"), "psqi4": (4 + key % 5).cast("string"),
             "psqi1": F.concat((9 + key % 3).cast("string"), F.lpad(((key % 4) * 15).cast("string"), 2, "0")),
             "psqi3": F.concat((5 + key % 4).cast("string"), F.lit("30")),
             "psqi1ampm": F.lit("2"), "psqi3ampm": F.when(F.col("p_size") % 4 == 2, "2").otherwise("1")}
    out = SC.score_sleep_quality(t.part.select(key.alias("id"), *[c.alias(n) for n, c in cols.items()]))
    return out.drop(*cols)


@query("scale_scores", """
    SELECT p_partkey AS id, round((p_size - 1) / 49.0, 8) AS neu_igtb, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 8) AS price FROM part""")
def scale_scores(t):
    src = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("neu_igtb"), F.col("p_retailprice").alias("price"))
    out = SC.scale_scores(src, {"neu_igtb": (1, 50), "price": None})
    return out.withColumns({c: near(c, 8) for c in ("neu_igtb", "price")})


@query("audio_derive", """
    SELECT event_id, round(ln(nullif(CASE WHEN user_id % 5 = 0 THEN 0 ELSE value END, 0)), 8) AS log_pitch, round(value / nullif(user_id % 9, 0), 8) AS ratio,
      round(10 * log10(nullif(value, 0) * 1e12), 8) AS db, round(0.3 * value + 0.7 * (2 * value / 600 - 1), 8) AS blended FROM events""")
def audio_derive(t):
    e = t.events.withColumn("f0", F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value")))
    return e.select(
        "event_id", near(SG.log_pitch("f0"), 8).alias("log_pitch"), near(SG.band_ratio("value", F.col("user_id") % 9), 8).alias("ratio"),
        near(SG.decibel("value"), 8).alias("db"), near(SG.blend("value", SG.arousal(F.col("value") / 600), 0.3), 8).alias("blended"))


@query("state_words", """
    WITH {readings} SELECT chr(97 + CAST(least(floor(value / 50), 4) AS INT)) || chr(97 + CAST(hour(ts) // 6 AS INT)) AS word, count(*) AS n FROM r GROUP BY 1""")
def state_words(t):
    level = F.least(F.floor(F.col("value") / 50), F.lit(4)).cast("int")
    return t.readings.groupBy(L.state_word([level, F.floor(F.hour("ts") / 6).cast("int")]).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("hr_zones", """
    WITH {readings}, m AS (SELECT participant_id, max(value) AS top FROM r GROUP BY 1),
    z AS (SELECT participant_id, CASE WHEN value / top >= 0.85 THEN 'peak' WHEN value / top >= 0.7 THEN 'cardio' WHEN value / top >= 0.5 THEN 'fat_burn' ELSE 'out' END AS z FROM r JOIN m USING (participant_id)),
    c AS (SELECT participant_id, count(*) FILTER (z = 'peak') AS peak, count(*) FILTER (z = 'cardio') AS cardio, count(*) FILTER (z = 'fat_burn') AS fat_burn, count(*) FILTER (z = 'out') AS out_of_range FROM z GROUP BY 1)
    SELECT *, round(peak / (peak + cardio + fat_burn + out_of_range), 8) AS peak_ratio, round(cardio / (peak + cardio + fat_burn + out_of_range), 8) AS cardio_ratio,
      round(fat_burn / (peak + cardio + fat_burn + out_of_range), 8) AS fat_burn_ratio, round(out_of_range / (peak + cardio + fat_burn + out_of_range), 8) AS out_of_range_ratio FROM c""")
def hr_zones(t):
    from ..operators.ordered import salted_join

    top = t.readings.groupBy("participant_id").agg(F.max("value").alias("top"))
    z = salted_join(t.readings, top, ["participant_id"]).withColumn("z", SG.hr_zone("value", "top"))
    c = z.groupBy("participant_id").agg(*[F.count_if(F.col("z") == n).alias(n) for n in SG.ZONES])
    return c.withColumns({n: near(e, 8) for n, e in SG.zone_ratio(SG.ZONES).items()})


@query("parts_round_trip", """
    WITH {channels}
    SELECT participant_id, CAST(us // 86400000000 AS BIGINT) AS day, count(*) AS n, CAST(sum(us) AS BIGINT) AS us, round(sum(value), 4) AS total
    FROM r WHERE participant_id IN ('click', 'view') GROUP BY 1, 2""")
def parts_round_trip(t):
    """Daily parts are written, a second write skips them, and two participants are read back."""
    path = f"{shared_folder(t.spark)}/parts-{uuid.uuid4().hex}"
    rows = t.channels.select("participant_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    SK.write_parts(rows, path)
    SK.write_parts(rows.where("value > 0"), path, mode="ignore")
    back = R.read_dated_parts(t.spark, path, T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())]))
    back = back.where(F.col("participant_id").isin("click", "view"))
    days = cut_lineage(back.groupBy("participant_id", F.unix_date("day").cast("bigint").alias("day")).agg(
        F.count("*").alias("n"), F.sum(us("ts").cast("decimal(20,0)")).cast("decimal(38,0)").alias("us"), near(F.sum("value"), 4).alias("total")))
    # some 5000 rows a day fill 64 bits: beyond them the sums stay exact as decimals
    fits = days.where(F.abs("us") > F.lit((1 << 63) - 1)).isEmpty()
    return days.withColumn("us", F.col("us").cast("bigint")) if fits else days
