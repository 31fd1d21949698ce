"""Segmentation, clustering, state models, topics and motifs."""

from pyspark.sql import functions as F

from ..functions.time import clock_hour, day_number, us
from ..operators import aggregates as A, clustering as C, gram as GM, grid as G, impute as IM, mixtures as MX, segment as SG, sessions as S, states as SM, stats as ST, topk as TK, ward as WD, windows as W
from .q_aggregates import STATES, rounded
from .q_sessions import RLE
from .registry import near, query


def segments(t):
    """Sessions as points: length, mean and spread of the readings."""
    out = S.sessions(t.readings, 43200, measures={"mean": ("avg", F.col("value")), "spread": ("std", F.col("value"))})
    return out.withColumn("hours", (F.col("end_us") - F.col("start_us")) / 3.6e9)


def scores(t):
    """Participant score table: order and balance figures of customers."""
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("price"), F.stddev_pop("o_totalprice").alias("price_std"))
    dim = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return dim.join(o, "id")


@query("split_scan_best", """
    WITH {channels}, p AS (SELECT participant_id, us, row_number() OVER w AS i, count(*) OVER (PARTITION BY participant_id) AS m, value AS x, hour(ts) + 0.0::DOUBLE AS y, sum(value) OVER w AS sx, sum(hour(ts)) OVER w AS sy, sum(value * value) OVER w AS sxx,
      sum(hour(ts) * hour(ts)) OVER w AS syy, sum(value * hour(ts)) OVER w AS sxy FROM r WINDOW w AS (PARTITION BY participant_id ORDER BY us)),
    e AS (SELECT participant_id, sx AS ex, sy AS ey, sxx AS exx, syy AS eyy, sxy AS exy FROM p WHERE i = m),
    c AS (SELECT p.*, e.* EXCLUDE (participant_id), i AS nl, m - i AS nr FROM p JOIN e USING (participant_id) WHERE i BETWEEN 2 AND m - 2),
    q AS (SELECT participant_id, us, i, m, unnest([{'k': 0, 'n': m, 'a': exx / m - pow(ex / m, 2) + 1 / m, 'b': eyy / m - pow(ey / m, 2) + 1 / m, 'c': exy / m - ex / m * ey / m},
        {'k': 1, 'n': nl, 'a': sxx / nl - pow(sx / nl, 2) + 1 / nl, 'b': syy / nl - pow(sy / nl, 2) + 1 / nl, 'c': sxy / nl - sx / nl * sy / nl},
        {'k': 2, 'n': nr, 'a': (exx - sxx) / nr - pow((ex - sx) / nr, 2) + 1 / nr, 'b': (eyy - syy) / nr - pow((ey - sy) / nr, 2) + 1 / nr, 'c': (exy - sxy) / nr - (ex - sx) / nr * (ey - sy) / nr}]) AS z FROM c),
    g AS (SELECT participant_id, us, i, m, sum(CASE WHEN z.k = 0 THEN 1 ELSE -1 END * (z.n * ln(z.a * z.b - z.c * z.c) - (z.a + z.b) / (z.a * z.b - z.c * z.c))) AS gain FROM q GROUP BY 1, 2, 3, 4)
    SELECT participant_id, m AS n, i AS best, us AS t_us, round(gain, 3) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY gain DESC, i) = 1""")
def split_scan_best(t):
    src = t.channels.withColumn("hour", F.hour("ts"))
    return rounded(SG.split_scan(src, "value", "hour", 1.0), 3)


@query("greedy_segments")
def greedy_segments(t):
    return SG.greedy_segments(t.channels.withColumn("hour", F.hour("ts")), "value", "hour", 3)


@query("kmeans_segments")
def kmeans_segments(t):
    return C.kmeans_by(W.normalize(segments(t), ["hours", "mean"]), ["hours", "mean"], 3).select("participant_id", "start_us", "cluster", "distance2")


@query("kmeans_pooled")
def kmeans_pooled(t):
    return C.kmeans_pooled(segments(t), ["hours", "mean", "spread"], 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"))


@query("gmm_states")
def gmm_states(t):
    out = C.mixture(W.normalize(segments(t), ["hours", "mean"]), ["hours", "mean"], [2, 3, 4])
    return out.groupBy("cluster", "components").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"))


@query("gmm_by_participant")
def gmm_by_participant(t):
    rows = W.normalize(segments(t), ["hours", "mean"], ["participant_id"])
    out = MX.mixture_by(rows, ["hours", "mean"], [1, 2, 3], ["participant_id"])
    return out.select("participant_id", "start_us", "cluster", "components", "bic")


@query("mixture_of_one", """
    WITH {readings}, m AS (SELECT participant_id, count(*) AS n, avg(value) AS mx, avg(hour(ts)) AS my, var_pop(value) AS a, var_pop(hour(ts)) AS b, covar_pop(value, hour(ts)) AS c FROM r GROUP BY 1),
    s AS (SELECT *, a + 0.01 / n AS ra, b + 0.01 / n AS rb FROM m), e AS (SELECT *, ra * rb - c * c AS det FROM s),
    l AS (SELECT *, -n / 2 * (2 * ln(2 * pi()) + ln(det) + (rb * a + ra * b - 2 * c * c) / det) AS loglik FROM e)
    SELECT participant_id, n, round(mx, 6) AS mean, round(my, 6) AS hour, round(loglik, 5) AS loglik, round(5 * ln(n) - 2 * loglik, 5) AS bic FROM l""")
def mixture_of_one(t):
    rows = t.readings.select("participant_id", F.array(F.col("value").cast("double"), F.hour("ts").cast("double")).alias("v"))
    fits = MX.fit_mixtures(rows, "v", [1], ["participant_id"], tol=1e-12)
    return fits.select("participant_id", "n", near(F.col("params")[1], 6).alias("mean"), near(F.col("params")[2], 6).alias("hour"), near("loglik", 5).alias("loglik"), near("bic", 5).alias("bic"))


@query("dp_means")
def dp_means(t):
    rows = W.normalize(segments(t), ["hours", "mean"], [])
    return C.dp_means(rows, ["hours", "mean"], 4.0).select("participant_id", "start_us", "cluster", "distance2")


@query("cluster_inertia")
def cluster_inertia(t):
    # one array: with all 64 values as columns the optimizer does not end
    return C.inertia(C.kmeans_by(t.embeddings.select("label", "embedding"), "embedding", 2, ["label"]), ["label"], n_params=2 * 64)


@query("subspace_states")
def subspace_states(t):
    out = C.subspace_states(segments(t), {"length_state": ["hours"], "level_state": ["mean"]}, 2)
    return out.groupBy("length_state", "level_state").agg(F.count(F.lit(1)).alias("n"))


@query("nmi_contingency", """
    WITH {readings}, j AS (SELECT state AS a, hour(ts) // 6 AS b, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT sum(n) AS nn FROM j),
    h AS (SELECT (SELECT -sum(n / nn * ln(n / nn)) FROM j, t) AS h_ab, (SELECT -sum(n / nn * ln(n / nn)) FROM (SELECT a, sum(n) AS n FROM j GROUP BY 1), t) AS h_a, (SELECT -sum(n / nn * ln(n / nn)) FROM (SELECT b, sum(n) AS n FROM j GROUP BY 1), t) AS h_b)
    SELECT round(h_a, 8) AS h_a, round(h_b, 8) AS h_b, round(h_ab, 8) AS h_ab, round(h_a + h_b - h_ab, 8) AS mi, round(2 * (h_a + h_b - h_ab) / (h_a + h_b), 8) AS nmi, round((h_a + h_b - h_ab) / sqrt(h_a * h_b), 8) AS nmi_sqrt, round(2 * h_ab - h_a - h_b, 8) AS vi FROM h""")
def nmi_contingency(t):
    return rounded(C.cluster_agreement(t.readings.withColumn("part", F.floor(F.hour("ts") / 6)), "state", "part"), 8)


@query("confusion_matrix", "WITH {readings} SELECT state, hour(ts) // 8 AS part, count(*) AS n FROM r GROUP BY 1, 2")
def confusion_matrix(t):
    return C.confusion(t.readings.withColumn("part", F.floor(F.hour("ts") / 8)), "state", "part")


@query("macro_f1")
def macro_f1(t):
    return C.macro_f1(t.readings.withColumn("part", F.floor(F.hour("ts") / 5)), "state", "part")


@query("hierarchy")
def hierarchy(t):
    return C.hierarchy(scores(t), ["orders", "price", "balance"], 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))


@query("ward")
def ward(t):
    rows = W.normalize(scores(t), ["orders", "price", "balance"], [])
    out = WD.ward(rows, ["orders", "price", "balance"], 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"), F.avg("balance").alias("balance"))


@query("ward_by_segment")
def ward_by_segment(t):
    rows = W.normalize(scores(t), ["orders", "price"], ["segment"])
    return WD.ward(rows, ["orders", "price"], 4, ["segment"]).select("id", "segment", "cluster")


@query("pca")
def pca(t):
    return C.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 20).select("vec_id", "components")


@query("label_moments", """
    WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.x, b.x) AS c, avg(a.x) AS m, count(*) AS n FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.label = b.label AND a.i <= b.i GROUP BY 1, 2, 3)
    SELECT label, n, i, j, round(m, 8) AS mean, round(c, 8) AS cov FROM c""")
def label_moments(t):
    rows = GM.array_moments(t.embeddings, "embedding", ["label"]).filter("label is not null")
    cells = F.flatten(F.transform(F.sequence(F.lit(1), F.size("means")), lambda i: F.transform(F.sequence(i, F.size("means")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cell = rows.select("label", "n", "means", F.explode(F.arrays_zip(cells.alias("at"), F.col("covs").alias("cov"))).alias("x"))
    return cell.select("label", "n", F.col("x.at.i").cast("long").alias("i"), F.col("x.at.j").cast("long").alias("j"), near(F.col("means")[F.col("x.at.i") - 1], 8).alias("mean"), near(F.col("x.cov"), 8).alias("cov"))


@query("cca")
def cca(t):
    return C.cca(scores(t), ["orders", "price"], ["balance", "nation"], 0.01, ["segment"])


@query("discriminant")
def discriminant(t):
    return C.discriminant(t.embeddings.select("vec_id", "label", "embedding"), "embedding", "label").select("vec_id", "label", "axis_1", "axis_2")


LASSO = [0.1, 10.0, 1000.0, 5000.0]


def lasso_sql(alphas, rounds=60):
    """Coordinate descent written out for three standardised columns, per fold left out (-1: none) and penalty."""
    soft = lambda x: f"sign({x}) * greatest(abs({x}) - alpha, 0)"
    b1, b2, b3 = "c1 - r12 * b2 - r13 * b3", "c2 - r12 * n1 - r23 * b3", "c3 - r13 * n1 - r23 * n2"
    return f"""
    WITH RECURSIVE r AS (SELECT (l_orderkey * 7 + l_linenumber) % 3 AS fold, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3 FROM lineitem),
    o AS (SELECT unnest([-1, 0, 1, 2]) AS out), al AS (SELECT unnest({alphas}) AS alpha),
    g AS (SELECT out, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3,
      covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2, covar_pop(x3, y) / stddev_pop(x3) AS c3, corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23 FROM r JOIN o ON fold <> out GROUP BY 1),
    it AS (SELECT out, alpha, 0 AS k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM o, al
      UNION ALL SELECT out, alpha, k + 1, n1, n2, {soft(b3)} FROM (SELECT *, {soft(b2)} AS n2 FROM (SELECT it.*, g.* EXCLUDE (out), {soft(b1)} AS n1 FROM it JOIN g USING (out) WHERE k < {rounds}))),
    f AS (SELECT out, alpha, b1 / s1 AS b1, b2 / s2 AS b2, b3 / s3 AS b3, my - b1 / s1 * m1 - b2 / s2 * m2 - b3 / s3 * m3 AS b0 FROM it JOIN g USING (out) WHERE k = {rounds}),
    t AS (SELECT fold, avg(y) AS ty FROM r GROUP BY 1),
    e AS (SELECT alpha, fold, 1 - sum((y - b0 - b1 * x1 - b2 * x2 - b3 * x3) ** 2) / sum((y - ty) ** 2) AS r2 FROM r JOIN t USING (fold) JOIN f ON f.out = r.fold GROUP BY 1, 2),
    w AS (SELECT alpha, avg(r2) AS r2, max(CASE WHEN fold = 0 THEN r2 END) AS r2_0, max(CASE WHEN fold = 1 THEN r2 END) AS r2_1, max(CASE WHEN fold = 2 THEN r2 END) AS r2_2 FROM e GROUP BY 1)
    SELECT alpha, round(r2, 8) AS r2, round(r2_0, 8) AS r2_0, round(r2_1, 8) AS r2_1, round(r2_2, 8) AS r2_2, r2 = max(r2) OVER () AS best, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(b3, 4) AS b3
    FROM w JOIN f USING (alpha) WHERE out = -1"""


@query("lasso_cv", lasso_sql(LASSO))
def lasso_cv(t):
    out = C.lasso_cv(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], LASSO, fold=(F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 3)
    b = [near(F.col("coefficients")[i], 4).alias(f"b{i + 1}") for i in range(3)]
    return out.select("alpha", near("r2", 8).alias("r2"), *[near(F.col("fold_r2")[i], 8).alias(f"r2_{i}") for i in range(3)], "best", near("intercept", 4).alias("b0"), *b)


@query("rf_cv")
def rf_cv(t):
    docs = t.documents.join(t.labels, "doc_id").select(
        "quality", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("vocabulary"))
    return C.forest_cv(docs, "quality", ["chars", "words", "lines", "vocabulary"], {"numTrees": [10], "maxDepth": [3, 5]}, folds=3)


def word_docs(t):
    docs = G.doc_windows(t.readings, "state", 24 * 60, 48 * 60, min_words=2)
    loc = t.readings
    placed = G.window_rows(loc, "ts", 24 * 3600 * 1_000_000, 0, 48 * 3600 * 1_000_000)
    shares = placed.groupBy("participant_id", "t_us").agg(*[F.avg((F.col("state") == s).cast("double")).alias(s) for s in STATES])
    return docs, shares


@query("lda_topics")
def lda_topics(t):
    docs = t.documents.select("doc_id", "lang", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    named, keys = C.topics(docs, 4, rounds=10, keep=["doc_id", "lang"])
    return named.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")).join(keys, "topic")


@query("topic_location_corr")
def topic_location_corr(t):
    docs, shares = word_docs(t)
    named, _ = C.topics(docs, 3, rounds=10, keep=["participant_id", "t_us"])
    corr = C.topic_location_corr(named.join(shares, ["participant_id", "t_us"]), "topics", 3, STATES, 0.4)
    return TK.top_abs_corr(corr, 3, value="r", tie=("topic", "location"))


@query("dominant_location", f"""
    WITH {{readings}}, w AS (SELECT *, unnest(generate_series((us - 172800000000 + 86399999999) // 86400000000, us // 86400000000)) AS k FROM r),
    c AS (SELECT participant_id, k * 86400000000 AS t_us, state, count(*) AS n FROM w GROUP BY 1, 2, 3)
    SELECT participant_id, t_us, state AS location, round(n / sum(n) OVER (PARTITION BY participant_id, t_us), 6) AS location_weight FROM c QUALIFY row_number() OVER (PARTITION BY participant_id, t_us ORDER BY n DESC, state) = 1""")
def dominant_location(t):
    _, shares = word_docs(t)
    out = C.dominant_location(shares, STATES).select("participant_id", "t_us", "location", "location_weight")
    return rounded(out, 6)


@query("top_abs_corr", """
    WITH x AS (SELECT l_returnflag AS rf, unnest([{'x': 'l_quantity', 'y': 'l_extendedprice', 'r': corr(l_quantity, l_extendedprice)}, {'x': 'l_quantity', 'y': 'l_discount', 'r': corr(l_quantity, l_discount)}, {'x': 'l_extendedprice', 'y': 'l_discount', 'r': corr(l_extendedprice, l_discount)}]) AS z FROM lineitem GROUP BY 1)
    SELECT rf, z.x AS x, z.y AS y, round(z.r, 8) AS r, CAST(row_number() OVER (PARTITION BY rf ORDER BY abs(z.r) DESC) AS INT) AS rank FROM x QUALIFY rank <= 2""")
def top_abs_corr(t):
    c = ST.pearson(t.lineitem.withColumnRenamed("l_returnflag", "rf"), ["l_quantity", "l_extendedprice", "l_discount"], ["rf"])
    return rounded(TK.top_abs_corr(c, 2, ["rf"]).select("rf", "x", "y", "r", "rank"), 8)


@query("run_features", f"""
    WITH {{readings}}, {RLE}
    SELECT participant_id, {", ".join(f"round(sum(CASE WHEN state = '{s}' THEN (end_us - start_us) / 1000000.0 ELSE 0 END), 4) AS duration_{s}, count(*) FILTER (state = '{s}') AS count_{s}" for s in STATES)} FROM runs GROUP BY 1""")
def run_features(t):
    return rounded(C.run_features(S.state_runs(t.readings, "state"), STATES), 4)


@query("bigram_logprob", f"""
    WITH {{readings}}, n AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY participant_id ORDER BY us) AS to_state FROM r), c AS (SELECT from_state, to_state, count(*) AS n FROM n WHERE to_state IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT * FROM (SELECT unnest({list(STATES)}) AS from_state) CROSS JOIN (SELECT unnest({list(STATES)}) AS to_state)), f AS (SELECT g.*, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN c USING (from_state, to_state))
    SELECT from_state, to_state, round(ln(n / sum(n) OVER (PARTITION BY from_state)), 8) AS logprob FROM f""")
def bigram_logprob(t):
    return rounded(SM.bigram_logprob(t.readings, "state", STATES), 8)


@query("ngram_motifs", f"""
    WITH {{readings}}, {RLE}, q AS (SELECT participant_id, row_number() OVER w AS pos, state || '>' || lead(state) OVER w AS m2, state || '>' || lead(state) OVER w || '>' || lead(state, 2) OVER w AS m3 FROM runs WINDOW w AS (PARTITION BY participant_id ORDER BY start_us)),
    o AS (SELECT participant_id, pos, m2 AS motif, 2 AS length FROM q WHERE m2 IS NOT NULL UNION ALL SELECT participant_id, pos, m3, 3 FROM q WHERE m3 IS NOT NULL),
    l AS (SELECT *, CASE WHEN pos - lag(pos) OVER w < length THEN 0 ELSE 1 END AS head FROM o WINDOW w AS (PARTITION BY participant_id, motif ORDER BY pos)),
    h AS (SELECT *, sum(head) OVER (PARTITION BY participant_id, motif ORDER BY pos) AS chain FROM l), ck AS (SELECT participant_id, motif, length, chain, (count(*) + 1) // 2 AS k FROM h GROUP BY 1, 2, 3, 4),
    n AS (SELECT participant_id, motif, length, CAST(sum(k) AS BIGINT) AS n FROM ck GROUP BY 1, 2, 3 HAVING sum(k) >= 3), tt AS (SELECT participant_id, count(*) AS total FROM runs GROUP BY 1), sh AS (SELECT participant_id, state, count(*) AS c FROM runs GROUP BY 1, 2)
    SELECT n.participant_id, motif, length, n, round((total - length + 1) * exp((SELECT sum(ln(c / total)) FROM (SELECT unnest(string_split(motif, '>')) AS s) u JOIN sh ON sh.state = u.s AND sh.participant_id = n.participant_id)), 6) AS expected FROM n JOIN tt USING (participant_id)""")
def ngram_motifs(t):
    out = SM.ngram_motifs(S.state_runs(t.readings, "state"), "state", 2, 3, 3)
    return rounded(out.select("participant_id", "motif", "length", "n", "expected"), 6)


@query("maximal_motifs", f"""
    WITH {{readings}}, {RLE}, sq AS (SELECT participant_id, list(state ORDER BY start_us) AS ss FROM runs GROUP BY 1),
    pp AS (SELECT participant_id, ss, unnest(range(1, len(ss) + 1)) AS pos FROM sq), oc AS (SELECT participant_id, ss, pos, unnest(range(2, len(ss) - pos + 2)) AS length FROM pp),
    gr AS (SELECT participant_id, array_to_string(ss[pos : pos + length - 1], '>') AS motif, length, list(pos ORDER BY pos) AS ps, list(DISTINCT CASE WHEN pos = 1 THEN '^' || pos ELSE ss[pos - 1] END) AS l,
      list(DISTINCT coalesce(ss[pos + length], '$')) AS r, any_value(ss) AS ss, any_value(pos) AS pos FROM oc GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    kp AS (SELECT *, list_reduce(list_prepend(1000000 + ps[1], ps[2:]), lambda a, x: CASE WHEN x - a % 1000000 >= length THEN (a // 1000000 + 1) * 1000000 + x ELSE a END) // 1000000 AS n FROM gr WHERE len(l) > 1 AND len(r) > 1),
    tt AS (SELECT participant_id, count(*) AS total FROM runs GROUP BY 1), sh AS (SELECT participant_id, state, count(*) AS c FROM runs GROUP BY 1, 2),
    ex AS (SELECT participant_id, motif, sum(ln(c / total)) AS lp FROM (SELECT participant_id, motif, unnest(string_split(motif, '>')) AS state FROM kp WHERE n >= 2) JOIN sh USING (participant_id, state) JOIN tt USING (participant_id) GROUP BY 1, 2)
    SELECT participant_id, motif, length::INTEGER AS length, n, round((total - length + 1) * exp(lp), 6) AS expected FROM kp JOIN tt USING (participant_id) JOIN ex USING (participant_id, motif) WHERE n >= 2""")
def maximal_motifs(t):
    out = SM.maximal_motifs(S.state_runs(t.readings, "state"), "state", 2)
    return rounded(out.select("participant_id", "motif", "length", "n", "expected"), 6)


def day_costs(t):
    v = F.col("value")
    return t.readings.select("participant_id", F.floor(day_number("ts") / 10).alias("period"), us("ts").alias("t_us"),
                             F.array(F.abs(v - 15), F.abs(v - 50), F.abs(v - 110)).alias("costs"))


@query("switching_path", """
    WITH RECURSIVE {readings}, n AS (SELECT participant_id, us // 864000000000 AS period, us, abs(value - 15) AS c0, abs(value - 50) AS c1, abs(value - 110) AS c2, row_number() OVER (PARTITION BY participant_id, us // 864000000000 ORDER BY us) AS i,
        count(*) OVER (PARTITION BY participant_id, us // 864000000000) AS m FROM r),
    f AS (SELECT participant_id, period, i, m, c0 AS v0, c1 AS v1, c2 AS v2 FROM n WHERE i = 1
      UNION ALL SELECT n.participant_id, n.period, n.i, n.m, least(v0, least(v0, v1, v2) + 25) + c0, least(v1, least(v0, v1, v2) + 25) + c1, least(v2, least(v0, v1, v2) + 25) + c2
      FROM f JOIN n ON n.participant_id = f.participant_id AND n.period = f.period AND n.i = f.i + 1)
    SELECT participant_id, period, m AS steps, round(least(v0, v1, v2), 5) AS path_cost FROM f WHERE i = m""")
def switching_path(t):
    path = SM.min_cost_path(day_costs(t), 25.0, ["participant_id", "period"], carry=["costs"])
    paid = F.sum(F.element_at("costs", F.col("state") + 1)) + 25.0 * F.count_if("switched")
    return path.groupBy("participant_id", "period").agg(F.count(F.lit(1)).alias("steps"), near(paid, 5).alias("path_cost"))


@query("state_model")
def state_model(t):
    win = W.stack_windows(W.normalize(t.channels, ["value"]).withColumn("hour", clock_hour("ts", True) / 12), ["value", "hour"], 2)
    rows = win.select("participant_id", F.floor(day_number("ts") / 10).alias("period"), us("ts").alias("t_us"), "window")
    out = SM.state_model(rows, 3, 2.0, ["participant_id", "period"])
    return out.groupBy("participant_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("sequence_bic", f"""
    WITH {{readings}}, {RLE}, p AS (SELECT unnest({list(STATES)}) AS state, unnest([2, 3, 4, 5, 6]) AS free), fr AS (SELECT participant_id, CAST(sum(free) AS BIGINT) AS free FROM runs JOIN p USING (state) GROUP BY 1),
    l AS (SELECT participant_id, -sum(value) / 50 AS loglik, count(*) AS length FROM r GROUP BY 1) SELECT participant_id, free, length, round(free * ln(length) - 2 * loglik, 5) AS bic FROM fr JOIN l USING (participant_id)""")
def sequence_bic(t):
    runs = S.state_runs(t.readings, "state")
    table = F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i + 2))])
    params = t.readings.select("state").distinct().withColumn("free", F.element_at(table, F.col("state")))
    lik = t.readings.groupBy("participant_id").agg((-F.sum("value") / 50).alias("loglik"), F.count(F.lit(1)).alias("length"))
    return rounded(SM.sequence_bic(runs, lik, params).drop("loglik"), 5)


@query("regression_impute")
def regression_impute(t):
    src = t.channels.select("participant_id", us("ts").alias("us"), F.when(F.col("source") % 5 != 0, F.col("value")).alias("v"), F.hour("ts").cast("double").alias("h"), F.when(F.col("source") % 7 != 0, F.col("source").cast("double")).alias("s"))
    return IM.fill_regression(src, ["v", "h", "s"])
