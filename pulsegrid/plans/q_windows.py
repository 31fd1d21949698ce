"""Ordered analytics, gap filling, ranking and set operations."""

from pyspark.sql import functions as F

from ..functions.time import DAY, day_number, us
from ..operators import aggregates as A, grid as G, impute as IM, neighbours as NB, sessions as S, topk as TK, windows as W
from .q_aggregates import STATES, rounded
from .q_intervals import SES, TWO, two_tables
from .registry import near, query


def keyed(df):
    """Sort key columns of a reading for output."""
    return df.withColumn("us", us("ts")).drop("ts")


@query("time_diff", """
    WITH {readings} SELECT participant_id, us, round((us - lag(us) OVER (PARTITION BY participant_id ORDER BY us)) / 1000000.0, 6) AS gap_seconds FROM r""")
def time_diff(t):
    return rounded(keyed(W.time_diff(t.readings)).select("participant_id", "us", "gap_seconds"), 6)


@query("change_events", """
    WITH {readings}, n AS (SELECT participant_id, us, state, lag(state) OVER w AS from_state, row_number() OVER w - 1 AS index FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us))
    SELECT participant_id, from_state, state AS to_state, index, us AS t_us FROM n WHERE from_state <> state AND from_state <> 'error' AND state <> 'error'""")
def change_events(t):
    return W.change_events(t.readings, "state", drop_state="error")


@query("rolling_mean_fill", """
    WITH {readings}, v AS (SELECT participant_id, us, CASE WHEN state <> 'view' THEN value END AS v FROM r),
    x AS (SELECT *, avg(v) OVER (PARTITION BY participant_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS ra, avg(v) OVER (PARTITION BY participant_id) AS m,
          row_number() OVER (PARTITION BY participant_id ORDER BY us) AS pos FROM v)
    SELECT participant_id, us, round(coalesce(v, CASE WHEN pos <= 5 THEN m ELSE coalesce(ra, m) END), 6) AS v FROM x""")
def rolling_mean_fill(t):
    src = t.readings.withColumn("v", F.when(F.col("state") != "view", F.col("value")))
    return rounded(keyed(IM.fill_local(src, "v")).select("participant_id", "us", "v"), 6)


@query("rolling_mean", """
    WITH {channels} SELECT participant_id, us, round(avg(value) OVER (PARTITION BY participant_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS rolling FROM r""")
def rolling_mean(t):
    return rounded(keyed(W.rolling_mean(t.channels, "value")).select("participant_id", "us", "rolling"), 6)


@query("moving_average", """
    WITH {channels}, m AS (SELECT participant_id, us, avg(value) OVER w AS moving, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT participant_id, us, round(moving, 6) AS moving FROM m WHERE k = 10""")
def moving_average(t):
    return rounded(keyed(W.moving_average(t.channels, "value", 10)).select("participant_id", "us", "moving"), 6)


@query("centered_week_normalize", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 AS day, sum(value) AS s, count(value) AS n FROM r GROUP BY 1, 2),
    l AS (SELECT participant_id, day, sum(s) OVER w / sum(n) OVER w AS level FROM d WINDOW w AS (PARTITION BY participant_id ORDER BY day RANGE BETWEEN 7 PRECEDING AND 6 FOLLOWING))
    SELECT r.participant_id, us, round(value - level, 6) AS value FROM r JOIN l ON l.participant_id = r.participant_id AND l.day = r.us // 86400000000""")
def centered_week_normalize(t):
    return rounded(keyed(W.remove_weekly_level(t.readings, ["value"])).select("participant_id", "us", "value"), 6)


@query("circular_smooth", f"""
    WITH {{readings}}, c AS (SELECT participant_id, CAST(us % 86400000000 // 10800000000 AS INT) AS bin, state, count(*) AS n FROM r GROUP BY 1, 2, 3),
    g AS (SELECT * FROM (SELECT DISTINCT participant_id FROM r) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS bin) CROSS JOIN (SELECT unnest({list(STATES)}) AS state)),
    f AS (SELECT g.*, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN c USING (participant_id, bin, state)), p AS (SELECT participant_id, bin, state, n / sum(n) OVER (PARTITION BY participant_id, bin) AS p FROM f),
    s AS (SELECT a.participant_id, a.bin, a.state, (a.p + b.p + c.p) / 3 AS p FROM p a JOIN p b ON b.participant_id = a.participant_id AND b.state = a.state AND b.bin = (a.bin + 1) % 8
          JOIN p c ON c.participant_id = a.participant_id AND c.state = a.state AND c.bin = (a.bin + 7) % 8)
    SELECT participant_id, bin, state, round(p / sum(p) OVER (PARTITION BY participant_id, bin), 8) AS p FROM s""")
def circular_smooth(t):
    return rounded(W.circular_smooth(A.tod_pdf(t.readings, "state", STATES, 8), 8, ["participant_id"], "state"), 8)


@query("savgol_5_3", """
    WITH {readings}, n AS (SELECT participant_id, us, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY participant_id) AS c,
      lag(value, 1) OVER w AS a1, lag(value, 2) OVER w AS a2, lag(value, 3) OVER w AS a3, lag(value, 4) OVER w AS a4, lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2, lead(value, 3) OVER w AS b3, lead(value, 4) OVER w AS b4
      FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us))
    SELECT participant_id, us, round(CASE WHEN c < 5 THEN v WHEN i = 1 THEN (69 * v + 4 * b1 - 6 * b2 + 4 * b3 - b4) / 70 WHEN i = 2 THEN (2 * a1 + 27 * v + 12 * b1 - 8 * b2 + 2 * b3) / 35
      WHEN i = c THEN (69 * v + 4 * a1 - 6 * a2 + 4 * a3 - a4) / 70 WHEN i = c - 1 THEN (2 * b1 + 27 * v + 12 * a1 - 8 * a2 + 2 * a3) / 35 ELSE (-3 * a2 + 12 * a1 + 17 * v + 12 * b1 - 3 * b2) / 35 END, 6) AS smooth FROM n""")
def savgol_5_3(t):
    return rounded(keyed(W.savgol_5_3(t.readings, "value")).select("participant_id", "us", "smooth"), 6)


@query("zscore", """
    WITH {readings} SELECT participant_id, us, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS value FROM r WINDOW w AS (PARTITION BY participant_id)""")
def zscore(t):
    return rounded(keyed(W.normalize(t.readings, ["value"])).select("participant_id", "us", "value"), 6)


@query("minmax_cohort", """
    WITH {readings} SELECT participant_id, us, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 8) AS value FROM r""")
def minmax_cohort(t):
    return rounded(keyed(W.normalize(t.readings, ["value"], [], "minmax")).select("participant_id", "us", "value"), 8)


@query("awake_periods", f"""
    WITH RECURSIVE {{readings}}, {TWO}, n AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY start_us) AS i, count(*) OVER (PARTITION BY participant_id) AS c,
       end_us + CASE WHEN end_us - start_us > 14400000000 THEN 36000000000 ELSE 57600000000 END AS b FROM sleep),
    f AS (SELECT participant_id, i, start_us AS ks, end_us AS ke, b AS kb, NULL::BIGINT AS ps, NULL::BIGINT AS pe, NULL::BIGINT AS px FROM n WHERE i = 1 AND c >= 5
      UNION ALL SELECT n.participant_id, n.i, CASE WHEN n.start_us > f.kb THEN n.start_us ELSE f.ks END, CASE WHEN n.start_us > f.kb THEN n.end_us ELSE f.ke END, CASE WHEN n.start_us > f.kb THEN n.b ELSE f.kb END,
        CASE WHEN n.start_us > f.kb THEN f.ks END, CASE WHEN n.start_us > f.kb THEN f.ke END, CASE WHEN n.start_us > f.kb THEN n.start_us END FROM f JOIN n ON n.participant_id = f.participant_id AND n.i = f.i + 1)
    SELECT participant_id, ps AS start_us, pe AS sleep_end_us, px AS end_us FROM f WHERE ps IS NOT NULL""")
def awake_periods(t):
    return W.awake_periods(two_tables(t)[0])


@query("between_sleep_spans", f"""
    WITH RECURSIVE {{readings}}, {TWO}, n AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY start_us) AS i FROM sleep),
    e AS (SELECT participant_id, min(us) AS a, max(us) AS z FROM r GROUP BY 1),
    f AS (SELECT participant_id, 0::BIGINT AS i, a AS at_us, NULL::BIGINT AS ps, NULL::BIGINT AS pe FROM e
      UNION ALL SELECT n.participant_id, n.i, CASE WHEN n.start_us - f.at_us >= 36000000000 THEN n.end_us ELSE f.at_us END, CASE WHEN n.start_us - f.at_us >= 36000000000 THEN f.at_us END, CASE WHEN n.start_us - f.at_us >= 36000000000 THEN n.start_us END
      FROM f JOIN n ON n.participant_id = f.participant_id AND n.i = f.i + 1)
    SELECT participant_id, ps AS start_us, pe AS end_us FROM f WHERE ps IS NOT NULL
    UNION ALL SELECT participant_id, max(at_us), any_value(z) FROM f JOIN e USING (participant_id) GROUP BY 1 HAVING any_value(z) > max(at_us)""")
def between_sleep_spans(t):
    return W.between_sleep_spans(two_tables(t)[0], t.readings)


@query("percentile_in_reference", """
    WITH {readings}, q AS (SELECT participant_id, state, us // 86400000000 AS day, avg(value) AS m FROM r GROUP BY 1, 2, 3)
    SELECT participant_id, state, day, round((SELECT count(*) FROM r WHERE r.state = q.state AND r.value <= q.m) / (SELECT count(*) FROM r WHERE r.state = q.state), 8) AS percentile FROM q""")
def percentile_in_reference(t):
    q = t.readings.groupBy("participant_id", "state", day_number("ts").alias("day")).agg(F.avg("value").alias("value"))
    return rounded(W.percentile_in(t.readings, q, "value", ["state"]).drop("value"), 8)


@query("top_bottom_k", """
    WITH s AS (SELECT p_partkey AS id, p_size + 0.0::DOUBLE AS size, p_retailprice AS price FROM part), l AS (SELECT id, 'size' AS score, size AS value FROM s UNION ALL SELECT id, 'price', price FROM s),
    k AS (SELECT score, row_number() OVER (ORDER BY stddev_pop(value) DESC, score) AS score_rank FROM l GROUP BY 1),
    e AS (SELECT *, 'high' AS status, row_number() OVER (PARTITION BY score ORDER BY value DESC, id) AS rank FROM l UNION ALL SELECT *, 'low', row_number() OVER (PARTITION BY score ORDER BY value, id) FROM l)
    SELECT e.score, id, value, CAST(rank AS INT) AS rank, status, CAST(score_rank AS INT) AS score_rank FROM e JOIN k USING (score) WHERE rank <= 5""")
def top_bottom_k(t):
    dim = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return W.rank_extremes(dim, ["size", "price"], 5, "id")


@query("median_split", """
    SELECT c_custkey AS id, c_acctbal AS value, CASE WHEN c_acctbal >= (SELECT median(c_acctbal) FROM customer) THEN 'high' ELSE 'low' END AS cohort FROM customer""")
def median_split(t):
    return W.split_cohort(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), "value")


@query("window_stack", """
    WITH {readings}, s AS (SELECT participant_id, us, list_value(value, lead(value) OVER w, lead(value, 2) OVER w) AS win FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us))
    SELECT participant_id, us, round(win[1] + 10 * win[2] + 100 * win[3], 5) AS code FROM s WHERE win[3] IS NOT NULL""")
def window_stack(t):
    out = keyed(W.stack_windows(t.readings, ["value"], 3))
    return out.select("participant_id", "us", near(F.col("window")[0] + 10 * F.col("window")[1] + 100 * F.col("window")[2], 5).alias("code"))


@query("lag_matrix", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 AS day, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT participant_id, day, n, lag(n) OVER w AS n_1, lag(n, 2) OVER w AS n_2 FROM d WINDOW w AS (PARTITION BY participant_id ORDER BY day)""")
def lag_matrix(t):
    d = t.readings.groupBy("participant_id", day_number("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return W.lag_matrix(d, ["n"], 2).drop("pos")


@query("breaks_to_segments", """
    WITH {readings}, b AS (SELECT participant_id, us FROM r WHERE state = 'error'), s AS (SELECT participant_id, us AS start_us, lead(us) OVER (PARTITION BY participant_id ORDER BY us) AS end_us FROM b)
    SELECT * FROM s WHERE end_us - start_us >= 7200000000""")
def breaks_to_segments(t):
    b = t.readings.filter("state = 'error'").select("participant_id", us("ts").alias("t_us"))
    return W.breaks_to_segments(b, min_seconds=7200)


@query("mask_and_delta", """
    WITH {readings}, v AS (SELECT participant_id, us, CASE WHEN state IN ('click', 'view') THEN value END AS v FROM r)
    SELECT participant_id, us, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS mask, round((us - coalesce(max(CASE WHEN v IS NOT NULL THEN us END) OVER w, min(us) OVER w, us)) / 1000000.0, 6) AS delta
    FROM v WINDOW w AS (PARTITION BY participant_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def mask_and_delta(t):
    src = t.readings.withColumn("v", F.when(F.col("state").isin("click", "view"), F.col("value")))
    return rounded(keyed(W.mask_and_delta(src, "v")).select("participant_id", "us", "mask", "delta"), 6)


@query("chunks", """
    WITH {readings}, n AS (SELECT *, (row_number() OVER (PARTITION BY participant_id ORDER BY us) - 1) // 8 AS chunk FROM r)
    SELECT participant_id, chunk, string_agg(state, '>' ORDER BY us) AS states FROM n GROUP BY 1, 2 HAVING count(*) = 8""")
def chunks(t):
    return W.chunks(t.readings, ["state"], 8).select("participant_id", "chunk", F.array_join("state", ">").alias("states"))


GAPPY = "v AS (SELECT participant_id, us, ts, state, CASE WHEN us // 1000000 % 5 <> 0 THEN value END AS v FROM r)"


def gappy(t):
    return t.readings.withColumn("v", F.when(F.floor(us("ts") / 1000000) % 5 != 0, F.col("value")))


@query("mean_impute", f"WITH {{readings}}, {GAPPY} SELECT participant_id, us, round(coalesce(v, avg(v) OVER (PARTITION BY participant_id)), 6) AS v FROM v")
def mean_impute(t):
    return rounded(keyed(IM.fill_mean(gappy(t), ["v"])).select("participant_id", "us", "v"), 6)


@query("profile_impute", f"""
    WITH {{readings}}, {GAPPY}, s AS (SELECT *, hour(ts) // 6 AS slot, state IN ('click', 'view') AS work FROM v)
    SELECT participant_id, us, round(coalesce(v, avg(v) OVER (PARTITION BY participant_id, work, slot), avg(v) OVER (PARTITION BY participant_id, slot), avg(v) OVER (PARTITION BY participant_id)), 6) AS v FROM s""")
def profile_impute(t):
    src = gappy(t).withColumn("work", F.col("state").isin("click", "view"))
    return rounded(keyed(IM.fill_profile(src, "v", F.floor(F.hour("ts") / 6), "work")).select("participant_id", "us", "v"), 6)


@query("fill_by_profile", f"""
    WITH {{readings}}, {GAPPY}, p AS (SELECT state, hour(ts) // 6 AS slot, avg(v) AS profile FROM v GROUP BY 1, 2)
    SELECT participant_id, us, round(coalesce(v, profile), 6) AS v FROM v JOIN p ON p.state = v.state AND p.slot = hour(v.ts) // 6""")
def fill_by_profile(t):
    from ..operators.intervals import fill_by_profile as fill

    src = gappy(t).withColumn("slot", F.floor(F.hour("ts") / 6))
    prof = src.groupBy("state", "slot").agg(F.avg("v").alias("profile"))
    return rounded(keyed(fill(src, prof, ["state", "slot"], "v")).select("participant_id", "us", "v"), 6)


@query("knn_impute", f"""
    WITH {{channels}}, v AS (SELECT participant_id, us, us // 86400000000 AS band, source + us % 1000 / 1000.0 AS f, CASE WHEN us // 1000000 % 5 <> 0 THEN value END AS v FROM r),
    p AS (SELECT g.participant_id, g.us, c.v, abs(c.f - g.f) AS d FROM v g JOIN v c ON c.participant_id = g.participant_id AND c.band = g.band WHERE g.v IS NULL AND c.v IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY g.participant_id, g.us ORDER BY abs(c.f - g.f), c.f, c.us) <= 5),
    f AS (SELECT participant_id, us, sum(v / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS fill FROM p GROUP BY 1, 2)
    SELECT v.participant_id, v.us, round(coalesce(v.v, fill), 4) AS v FROM v LEFT JOIN f ON f.participant_id = v.participant_id AND f.us = v.us""")
def knn_impute(t):
    src = t.channels.withColumn("v", F.when(F.floor(us("ts") / 1000000) % 5 != 0, F.col("value")))
    src = src.withColumn("f", F.col("source") + us("ts") % 1000 / 1000.0)
    return rounded(keyed(IM.fill_knn(src, "v", "f")).select("participant_id", "us", "v"), 4)


@query("knn_fill_columns", f"""
    WITH {{readings}}, v AS (SELECT participant_id, row_number() OVER () AS i, us, CASE WHEN us // 1000000 % 5 <> 0 THEN value / 50 END AS a, CASE WHEN us // 1000000 % 7 <> 0 THEN hour(ts)::DOUBLE END AS b, (us // 86400000000 % 7)::DOUBLE AS c FROM r),
    g AS (SELECT participant_id, i, unnest(CASE WHEN a IS NULL AND b IS NULL THEN ['a', 'b'] WHEN a IS NULL THEN ['a'] ELSE ['b'] END) AS j FROM v WHERE a IS NULL OR b IS NULL),
    d AS (SELECT g.i, g.j, CASE g.j WHEN 'a' THEN o.a ELSE o.b END AS x, sqrt((coalesce((q.a - o.a) ** 2, 0) + coalesce((q.b - o.b) ** 2, 0) + (q.c - o.c) ** 2) / (1 + CASE WHEN q.a - o.a IS NULL THEN 0 ELSE 1 END + CASE WHEN q.b - o.b IS NULL THEN 0 ELSE 1 END)) AS d
      FROM g JOIN v q USING (i) JOIN v o ON o.participant_id = q.participant_id AND CASE g.j WHEN 'a' THEN o.a ELSE o.b END IS NOT NULL QUALIFY rank() OVER (PARTITION BY g.i, g.j ORDER BY d) <= 5),
    f AS (SELECT i, j, sum(x / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS f FROM d GROUP BY 1, 2)
    SELECT participant_id, us, round(coalesce(a, fa.f), 4) AS a, round(coalesce(b, fb.f), 4) AS b, round(c, 4) AS c FROM v LEFT JOIN f fa ON fa.i = v.i AND fa.j = 'a' LEFT JOIN f fb ON fb.i = v.i AND fb.j = 'b'""")
def knn_fill_columns(t):
    second = F.floor(us("ts") / 1000000)
    src = t.readings.select("participant_id", us("ts").alias("us"), F.when(second % 5 != 0, F.col("value") / 50).alias("a"), F.when(second % 7 != 0, F.hour("ts").cast("double")).alias("b"), (F.floor(us("ts") / 86400000000) % 7).cast("double").alias("c"))  # whole numbers: equal distances are equal
    return rounded(NB.fill_nearest(src, ["a", "b", "c"], 5), 4)


@query("complete_groups", f"WITH {{readings}}, {GAPPY} SELECT participant_id, us FROM v WHERE participant_id IN (SELECT participant_id FROM v GROUP BY 1 HAVING avg(CASE WHEN v IS NULL THEN 0 ELSE 1.0 END) >= 0.8)")
def complete_groups(t):
    return keyed(IM.only_if_complete(gappy(t), ["v"], 0.8)).select("participant_id", "us")


@query("dataset_mean_impute", f"WITH {{readings}}, {GAPPY} SELECT participant_id, us, round(coalesce(v, (SELECT avg(v) FROM v)), 6) AS v FROM v")
def dataset_mean_impute(t):
    return rounded(keyed(IM.fill_dataset_mean(gappy(t), ["v"])).select("participant_id", "us", "v"), 6)


@query("null_below", "WITH {readings} SELECT participant_id, us, CASE WHEN value >= 24 THEN value END AS value, CASE WHEN value >= 24 THEN state END AS state FROM r")
def null_below(t):
    return keyed(IM.null_below(t.readings, "value", 24, ["state"]))


@query("pad_missing", """
    WITH {readings}, h AS (SELECT participant_id, us // 43200000000 AS b, avg(value) AS v FROM r GROUP BY 1, 2), s AS (SELECT participant_id, min(b) AS a, max(b) AS z FROM h GROUP BY 1),
    g AS (SELECT participant_id, unnest(generate_series(a, z)) AS b FROM s)
    SELECT g.participant_id, g.b * 43200000000 AS t_us, round(coalesce(v, -50), 6) AS v FROM g LEFT JOIN h USING (participant_id, b)""")
def pad_missing(t):
    h = t.readings.groupBy("participant_id", (F.floor(us("ts") / (DAY // 2)) * (DAY // 2)).alias("t_us")).agg(F.avg("value").alias("v"))
    return rounded(G.pad(G.densify(h, 43200), ["v"], -50.0), 6)


@query("top_k_by_count", "SELECT user_id AS participant_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, participant_id LIMIT 20")
def top_k_by_count(t):
    return TK.top_by_count(t.readings, 20)


@query("top_k_by_sum", "SELECT user_id AS participant_id, round(sum(value), 5) AS total FROM events GROUP BY 1 ORDER BY sum(value) DESC, participant_id LIMIT 20")
def top_k_by_sum(t):
    return rounded(TK.top_by_sum(t.readings, "value", 20), 5)


@query("words_top10", """
    WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2)
    SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INT) AS rank FROM c QUALIFY rank <= 10""")
def words_top10(t):
    words = t.documents.select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    return TK.top_words(words, "word", 10, ["lang"])


@query("sample_days")
def sample_days(t):
    d = t.readings.select("participant_id", "state", day_number("ts").alias("day")).distinct()
    return TK.sample_days(d, 3, 7, ["participant_id", "state"])


@query("grid_minus_observed", """
    WITH {readings}, h AS (SELECT DISTINCT participant_id, us // 43200000000 AS b FROM r), s AS (SELECT participant_id, min(us) // 43200000000 AS a, max(us) // 43200000000 AS z FROM r GROUP BY 1),
    g AS (SELECT participant_id, unnest(generate_series(a, z)) AS b FROM s) SELECT participant_id, b * 43200000000 AS t_us FROM (SELECT * FROM g EXCEPT SELECT * FROM h)""")
def grid_minus_observed(t):
    seen = t.readings.select("participant_id", (F.floor(us("ts") / (DAY // 2)) * (DAY // 2)).alias("t_us"))
    return TK.grid_minus(G.grid(G.spans_of(t.readings), 43200), seen, ["participant_id", "t_us"])


@query("union_all_distinct", """
    WITH {readings} SELECT DISTINCT participant_id, state FROM (SELECT participant_id, state FROM r WHERE value > 100 UNION ALL SELECT participant_id, state FROM r WHERE value < 5)""")
def union_all_distinct(t):
    return TK.distinct_values(TK.union_all(t.readings.filter("value > 100"), t.readings.filter("value < 5")), "participant_id", "state")
