"""Cohort statistics, regression and change tests."""

from pyspark.sql import functions as F

from ..functions.time import clock_hour, day_number, us
from ..operators import aggregates as A, neighbours as NB, regression as R, stats as ST, windows as W
from .q_aggregates import STATES, rounded
from .registry import near, query

LI = "l_quantity, l_extendedprice, l_discount"


@query("ks_two_sample", """
    WITH v AS (SELECT l_linestatus AS g, 'l_quantity' AS measure, l_quantity AS x FROM lineitem UNION ALL SELECT l_linestatus, 'l_extendedprice', l_extendedprice FROM lineitem),
    c AS (SELECT measure, x, count(*) FILTER (g = 'O') AS a, count(*) FILTER (g = 'F') AS b FROM v WHERE g IN ('O', 'F') GROUP BY 1, 2),
    s AS (SELECT measure, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM c WINDOW w AS (PARTITION BY measure ORDER BY x), t AS (PARTITION BY measure))
    SELECT measure, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 9) AS d FROM s GROUP BY 1""")
def ks_two_sample(t):
    return rounded(ST.ks_2samp(t.lineitem, "l_linestatus", "O", "F", ["l_quantity", "l_extendedprice"]).drop("p"), 9)


@query("ks_cohort_pairs")
def ks_cohort_pairs(t):
    pairs = [("BUILDING", "FURNITURE"), ("BUILDING", "MACHINERY"), ("HOUSEHOLD", "AUTOMOBILE")]
    return ST.ks_pairs(t.customer, "c_mktsegment", pairs, ["c_acctbal", "c_nationkey"])


@query("welch_t", """
    WITH a AS (SELECT l_returnflag AS rf, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS ma, avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS mb,
      var_samp(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS va, var_samp(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS vb, count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus = 'F') AS nb FROM lineitem GROUP BY 1)
    SELECT rf, na AS n_a, nb AS n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t,
      round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS dof FROM a""")
def welch_t(t):
    out = ST.welch_t(t.lineitem.withColumnRenamed("l_returnflag", "rf"), "l_linestatus", "O", "F", ["l_extendedprice"], ["rf"])
    return out.select("rf", "n_a", "n_b", near("mean_a", 4).alias("mean_a"), near("mean_b", 4).alias("mean_b"), near("t", 6).alias("t"), near("dof", 4).alias("dof"))


@query("anova_f", """
    WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS w FROM lineitem GROUP BY 1)
    SELECT 'l_quantity' AS measure, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round((sum(n * pow(m - (SELECT avg(l_quantity) FROM lineitem), 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS f FROM g""")
def anova_f(t):
    return ST.anova(t.lineitem, "l_returnflag", ["l_quantity"]).select("measure", "groups", "n", near("f", 5).alias("f"))


@query("pearson_matrix", """
    SELECT l_returnflag AS rf, x, y, n, round(r, 9) AS r FROM (
      SELECT l_returnflag, 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', count(*), corr(l_quantity, l_discount) FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', count(*), corr(l_extendedprice, l_discount) FROM lineitem GROUP BY 1)""")
def pearson_matrix(t):
    out = ST.pearson(t.lineitem.withColumnRenamed("l_returnflag", "rf"), LI.split(", "), ["rf"])
    return rounded(out.drop("p"), 9)


@query("spearman", """
    WITH k AS (SELECT l_returnflag AS rf, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
    SELECT rf, 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, round(corr(a, b), 9) AS r FROM k GROUP BY 1""")
def spearman(t):
    out = ST.spearman(t.lineitem.withColumnRenamed("l_returnflag", "rf"), ["l_quantity", "l_extendedprice"], ["rf"])
    return rounded(out.drop("p"), 9)


@query("lin_slope", """
    WITH {readings}, d AS (SELECT participant_id, us // 86400000000 - 19723 AS day, sum(value) AS v FROM r GROUP BY 1, 2)
    SELECT participant_id, count(*) AS n, round(regr_slope(v, day), 6) AS slope, round(regr_intercept(v, day), 5) AS intercept, round(corr(v, day), 7) AS r FROM d GROUP BY 1""")
def lin_slope(t):
    d = t.readings.groupBy("participant_id", (day_number("ts") - 19723).alias("day")).agg(F.sum("value").alias("v"))
    out = R.lin_slope(d, "day", "v", ["participant_id"]).drop("p")
    return out.withColumns({"slope": near("slope", 6), "intercept": near("intercept", 5), "r": near("r", 7)})


@query("ols_grouped", """
    WITH s AS (SELECT l_returnflag AS rf, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
      covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, var_pop(l_extendedprice) AS syy FROM lineitem GROUP BY 1),
    b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s), e AS (SELECT *, syy - b1 * s1y - b2 * s2y AS se FROM b)
    SELECT rf, x, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(1 - se / syy, 7) AS r2, round(CASE x WHEN 'l_quantity' THEN b1 ELSE b2 END, 3) AS beta, round(n * se / (n - 3) / 1000000, 5) AS mse_m,
      round(((syy - se) / 2) / (se / (n - 3)), 4) AS f FROM e CROSS JOIN (SELECT unnest(['l_quantity', 'l_discount']) AS x)""")
def ols_grouped(t):
    out = R.ols_by(t.lineitem.withColumnRenamed("l_returnflag", "rf"), "l_extendedprice", ["l_quantity", "l_discount"], ["rf"])
    return out.select("rf", "x", "n", near("intercept", 3).alias("intercept"), near("r2", 7).alias("r2"), near("beta", 3).alias("beta"),
                      near(F.col("mse") / 1000000, 5).alias("mse_m"), near("f", 4).alias("f"))


@query("cosinor_fit", """
    WITH {readings}, h AS (SELECT participant_id, value, cos((hour(ts) + minute(ts) / 60.0) * 2 * pi() / 24) AS c, sin((hour(ts) + minute(ts) / 60.0) * 2 * pi() / 24) AS s FROM r),
    m AS (SELECT participant_id, count(*) AS n, avg(value) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, value) AS cy, covar_pop(s, value) AS sy FROM h GROUP BY 1),
    b AS (SELECT *, (ss * cy - cs * sy) / (cc * ss - cs * cs) AS b, (cc * sy - cs * cy) / (cc * ss - cs * cs) AS g FROM m)
    SELECT participant_id, n, round(my - b * mc - g * ms, 5) AS mesor, round(sqrt(b * b + g * g), 5) AS amplitude, round(atan2(g, b), 6) AS acrophase FROM b""")
def cosinor_fit(t):
    out = R.cosinor(t.readings, "value", clock_hour("ts")).select("participant_id", "n", "mesor", "amplitude", "acrophase")
    return out.withColumns({"mesor": near("mesor", 5), "amplitude": near("amplitude", 5), "acrophase": near("acrophase", 6)})


GRANGER = "d AS (SELECT participant_id, us // 86400000000 AS day, count(*) + 0.0::DOUBLE AS x, sum(value) AS y FROM r GROUP BY 1, 2)"


@query("granger_f", f"""
    WITH {{readings}}, {GRANGER}, l AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM d WINDOW w AS (PARTITION BY participant_id ORDER BY day)),
    p AS (SELECT participant_id, 'x' AS cause, 'y' AS effect, y AS e, y1 AS own, x1 AS oth FROM l WHERE x1 IS NOT NULL UNION ALL SELECT participant_id, 'y', 'x', x, x1, y1 FROM l WHERE x1 IS NOT NULL),
    s AS (SELECT participant_id, cause, effect, count(*) AS n, var_pop(e) AS ee, var_pop(own) AS aa, var_pop(oth) AS bb, covar_pop(own, oth) AS ab, covar_pop(own, e) AS ae, covar_pop(oth, e) AS be FROM p GROUP BY 1, 2, 3),
    f AS (SELECT *, n * (ee - ae * ae / aa) AS sr, n * (ee - ((bb * ae - ab * be) * ae + (aa * be - ab * ae) * be) / (aa * bb - ab * ab)) AS sf FROM s)
    SELECT participant_id, cause, effect, n, n - 3 + 0.0::DOUBLE AS dof, round((sr - sf) / (sf / (n - 3)), 5) AS f, round(n * (sr - sf) / sf, 5) AS chi2 FROM f WHERE n > 3 AND sf > 0""")
def granger_f(t):
    d = t.readings.groupBy("participant_id", day_number("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("value").alias("y"))
    out = R.granger(d, "x", "y", 1).drop("f_p", "chi2_p")
    return out.withColumns({"f": near("f", 5), "chi2": near("chi2", 5)})


PDF = f"""
    c AS (SELECT participant_id % 2 AS grp, participant_id // 2 AS pair, CAST(us % 86400000000 // 21600000000 AS INT) AS bin, state, count(*) AS n FROM r GROUP BY 1, 2, 3, 4),
    ids AS (SELECT DISTINCT participant_id % 2 AS grp, participant_id // 2 AS pair FROM r),
    g AS (SELECT * FROM ids CROSS JOIN (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS bin) CROSS JOIN (SELECT unnest({list(STATES)}) AS state)),
    f AS (SELECT g.*, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN c USING (grp, pair, bin, state)), p AS (SELECT grp, pair, bin, state, n / sum(n) OVER (PARTITION BY grp, pair, bin) AS p FROM f)"""


@query("kl_symmetric", f"""
    WITH {{readings}}, {PDF} SELECT a.pair, a.bin, round(sum((a.p * ln(a.p / b.p) + b.p * ln(b.p / a.p)) / 2), 8) AS kl
    FROM p a JOIN p b ON a.pair = b.pair AND a.bin = b.bin AND a.state = b.state AND a.grp = 0 AND b.grp = 1 GROUP BY 1, 2""")
def kl_symmetric(t):
    r = t.readings.withColumn("grp", F.col("participant_id") % 2).withColumn("pair", F.floor(F.col("participant_id") / 2))
    pdf = lambda g: A.tod_pdf(r.filter(F.col("grp") == g), "state", STATES, 4, ["pair"])
    return rounded(ST.sym_kl(pdf(0), pdf(1), "state", ["pair"]), 8)


def tests(t):
    src = t.readings.withColumn("day", day_number("ts")).withColumn("bin", F.floor(F.hour("ts") / 6).cast("int"))
    return lambda states: ST.change_test(src.filter(F.col("state").isin(*states)), "state", states, 4, agg=4, slide=2, seed=11, packed=True)


@query("permutation_change")
def permutation_change(t):
    return ST.change_score(tests(t)(STATES))


@query("permutation_change_actual", f"""
    WITH {{channels}}, c AS (SELECT participant_id, us // 86400000000 AS day, CAST(us % 86400000000 // 21600000000 AS INT) AS bin, source % 3 AS st, count(*) AS n FROM r GROUP BY 1, 2, 3, 4),
    d AS (SELECT DISTINCT participant_id, day, day - min(day) OVER (PARTITION BY participant_id) AS off FROM c), w AS (SELECT participant_id, CAST(unnest(generate_series(0, 14)) AS BIGINT) AS win FROM (SELECT DISTINCT participant_id FROM d)),
    x AS (SELECT w.participant_id, win, day, off - win * 2 AS i FROM w JOIN d ON d.participant_id = w.participant_id AND off BETWEEN win * 2 AND win * 2 + 5 JOIN (SELECT participant_id, max(off) AS last FROM d GROUP BY 1) z ON z.participant_id = w.participant_id AND win * 2 + 5 <= last),
    y AS (SELECT participant_id, win, day, CASE WHEN i < 4 THEN 1 ELSE 2 END AS g FROM x),
    s AS (SELECT y.participant_id, win, g, bin, st, sum(n) AS n FROM y JOIN c USING (participant_id, day) GROUP BY 1, 2, 3, 4, 5),
    gr AS (SELECT * FROM (SELECT DISTINCT participant_id, win FROM y) CROSS JOIN (SELECT unnest([1, 2]) AS g) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS bin) CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS st)),
    f AS (SELECT gr.*, coalesce(n, 0) + 1 AS n FROM gr LEFT JOIN s USING (participant_id, win, g, bin, st)), p AS (SELECT *, n / sum(n) OVER (PARTITION BY participant_id, win, g, bin) AS p FROM f),
    m AS (SELECT a.participant_id, a.win, a.g, a.bin, a.st, (a.p + b.p + e.p) / 3 AS p FROM p a JOIN p b ON (b.participant_id, b.win, b.g, b.st, b.bin) = (a.participant_id, a.win, a.g, a.st, (a.bin + 1) % 4) JOIN p e ON (e.participant_id, e.win, e.g, e.st, e.bin) = (a.participant_id, a.win, a.g, a.st, (a.bin + 3) % 4))
    SELECT a.participant_id, a.win AS window, a.bin, round(sum((a.p - b.p) * ln(a.p / b.p) / 2), 8) AS distance FROM m a JOIN m b ON (a.participant_id, a.win, a.bin, a.st) = (b.participant_id, b.win, b.bin, b.st) AND a.g = 1 AND b.g = 2 GROUP BY 1, 2, 3""")
def permutation_change_actual(t):
    src = t.channels.withColumn("day", day_number("ts")).withColumn("bin", F.floor(F.hour("ts") / 6).cast("int")).withColumn("st", F.col("source") % 3)
    out = ST.change_test(src, "st", [0, 1, 2], 4, agg=4, slide=2, shuffles=0)
    return rounded(out.drop("shuffle"), 8)


@query("synchrony")
def synchrony(t):
    run = tests(t)
    return ST.synchrony(ST.change_score(run(("click", "view")), 0.2), ST.change_score(run(("error", "signup")), 0.2))


@query("bh_correction", """
    WITH {readings}, p AS (SELECT state, participant_id, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.001 END) AS p FROM r GROUP BY 1, 2),
    k AS (SELECT *, max(rk) OVER (PARTITION BY state, p) AS rank_top, count(*) OVER (PARTITION BY state) AS m FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p) AS rk FROM p)),
    a AS (SELECT *, least(1, min(p * m / rank_top) OVER (PARTITION BY state ORDER BY p DESC)) AS q FROM k)
    SELECT participant_id, state, round(p, 8) AS p, round(q, 8) AS p_adjusted, q <= 0.3 AS reject FROM a""")
def bh_correction(t):
    p = t.readings.groupBy("state", "participant_id").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.001)).alias("p"))
    return rounded(ST.bh_adjust(p, "p", 0.3, ["state"]), 8)


@query("score_spread", """
    WITH s AS (SELECT (p_size - 1) / 49.0 AS neu, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS price FROM part),
    a AS (SELECT 'neu' AS measure, stddev_pop(neu) AS spread FROM s UNION ALL SELECT 'price', stddev_pop(price) FROM s)
    SELECT measure, round(spread, 8) AS spread, CAST(row_number() OVER (ORDER BY spread DESC) AS INT) AS rank FROM a""")
def score_spread(t):
    src = t.part.select(F.col("p_size").cast("double").alias("neu"), F.col("p_retailprice").alias("price"))
    return rounded(ST.score_spread(src, {"neu": (1, 50), "price": None}), 8)


@query("cohort_table", """
    WITH g AS (SELECT c_mktsegment AS segment, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    c AS (SELECT x, count(*) FILTER (segment = 'BUILDING') AS a, count(*) FILTER (segment = 'MACHINERY') AS b FROM g GROUP BY 1),
    k AS (SELECT max(abs(ca / na - cb / nb)) AS d FROM (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)),
    m AS (SELECT segment, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM g GROUP BY 1)
    SELECT 'c_acctbal' AS measure, m.segment, any_value(n) AS n, round(any_value(mu), 4) AS mean, round(any_value(sd), 4) AS std, round(avg(pow((x - mu) / sd, 3)), 6) AS skewness, round(any_value(d), 8) AS ks
    FROM g JOIN m USING (segment) CROSS JOIN k GROUP BY m.segment""")
def cohort_table(t):
    out = ST.cohort_table(t.customer.withColumnRenamed("c_mktsegment", "segment"), "segment", "BUILDING", "MACHINERY", ["c_acctbal"]).drop("ks_p")
    return out.withColumns({"mean": near("mean", 4), "std": near("std", 4), "skewness": near("skewness", 6), "ks": near("ks", 8)})


def mi_sql(src, a, b):
    return f"""j AS (SELECT k, {a} AS a, {b} AS b, count(*) AS n FROM {src} GROUP BY 1, 2, 3), t AS (SELECT k, sum(n) AS nn FROM j GROUP BY 1),
    ma AS (SELECT k, a, sum(n) AS na FROM j GROUP BY 1, 2), mb AS (SELECT k, b, sum(n) AS nb FROM j GROUP BY 1, 2)
    SELECT j.k, CAST(any_value(nn) AS BIGINT) AS n, round(sum(n / nn * ln(n * nn / (na * nb))), 7) AS mi FROM j JOIN t USING (k) JOIN ma USING (k, a) JOIN mb USING (k, b) GROUP BY 1"""


@query("mutual_information", "WITH {readings}, x AS (SELECT participant_id AS k, state, hour(ts) // 6 AS part FROM r), " + mi_sql("x", "state", "part"))
def mutual_information(t):
    src = t.readings.select(F.col("participant_id").alias("k"), "state", F.floor(F.hour("ts") / 6).alias("part"))
    return rounded(ST.discrete_mi(src, "state", "part", ["k"]), 7)


@query("hist_mi", """
    WITH x AS (SELECT l_returnflag AS k, l_quantity AS p, l_extendedprice AS q, min(l_quantity) OVER w AS p0, max(l_quantity) OVER w AS p1, min(l_extendedprice) OVER w AS q0, max(l_extendedprice) OVER w AS q1 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)), """
       + mi_sql("x", "least(floor((p - p0) / (p1 - p0) * 64), 63)", "least(floor((q - q0) / (q1 - q0) * 64), 63)"))
def hist_mi(t):
    return rounded(ST.hist_mi(t.lineitem.withColumnRenamed("l_returnflag", "k"), "l_quantity", "l_extendedprice", 64, ["k"]), 7)


@query("knn_entropy")
def knn_entropy(t):
    return ST.knn_entropy(t.readings.withColumn("us", us("ts")), "value", 3, tie=["us"])


@query("knn_entropy_joint", """
    WITH {readings}, p AS (SELECT participant_id, row_number() OVER () AS i, value / 50 AS x, hour(ts) / 12.0::DOUBLE AS y FROM r),
    d AS (SELECT a.participant_id, a.i, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.participant_id = b.participant_id AND a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY d) = 3)
    SELECT participant_id, count(*) AS n, round(2 * avg(ln(d + 2.220446049250313e-16)) + ln(pi()) + list_sum(list_transform(range(1, count(*)), lambda j: 1.0::DOUBLE / j)) - 1.5, 6) AS entropy FROM d GROUP BY 1 HAVING count(*) > 3""")
def knn_entropy_joint(t):
    rows = t.readings.withColumns({"x": F.col("value") / 50, "y": F.hour("ts") / 12.0})
    out = NB.knn_entropy(rows, ["x", "y"], 3)
    return out.select("participant_id", "n", near("entropy", 6).alias("entropy"))
