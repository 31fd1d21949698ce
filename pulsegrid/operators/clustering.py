"""Clustering on Spark: grouped rounds for many participants at once, MLlib for pooled fits (ML-1..4, ML-8..16, ML-22)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import LDA, BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.aggregate import safe_corr
from ..session import cut_lineage
from .gram import array_moments, array_sum, discriminant_axes, dot, lasso_folds, matrix_of, principal_axes, whole
from .ordered import salted_join
from .regression import full_matrix, moments
from .sessions import PID
from .wordtopics import topics_in_tables, word_counts


def _distances(cols: Sequence[str], centres: str = "_centres") -> Column:
    """Squared distance of the row to every centre of its group."""
    row = _as_row(cols)

    def one(c):
        return F.aggregate(F.zip_with(row, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)

    return F.transform(centres, one)


def _as_row(cols: Sequence[str] | str) -> Column:
    """The values as one array; ``cols`` as a string names a column that is one already."""
    if isinstance(cols, str):
        return F.col(cols).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in cols])


def _assign(rows: DataFrame, centres: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    placed = salted_join(rows, centres, list(by)).withColumn("_d", _distances(cols))
    least = F.array_min("_d")
    return placed.withColumn("cluster", (F.array_position("_d", least) - 1).cast("int")).withColumn("distance2", least).drop("_d", "_centres")


def seed_centres(rows: DataFrame, cols: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """``k`` distinct rows per group in hash order; the rank filter limits rows before the shuffle."""
    unique = rows.select(*by, _as_row(cols).alias("_c")).distinct()
    w = Window.partitionBy(*by).orderBy(F.xxhash64("_c"), "_c")
    first = unique.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    packed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_c"))).alias("_x"))
    return packed.select(*by, F.col("_x._c").alias("_centres"))


#: Rows of one group in a block (a smaller group is fitted inside one task), over how many tasks a larger one is dealt, and how many
#: doubles of larger groups' centres a round holds on the driver at once.
BLOCK_ROWS, SALTS, HELD_DOUBLES = 4096, 16, 1 << 20


def _nearest(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre; ``columns`` has a row per value.  Sums run as in :func:`_distances`."""
    out = np.zeros((len(centres), columns.shape[1]))
    for total, centre in zip(out, centres):
        for x, c in zip(columns, centre):
            total += (x - c) * (x - c)
    return np.where(np.isnan(out), np.inf, out).argmin(0)


def _cluster_sums(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per centre the count and the sums of the rows next to it."""
    own = _nearest(columns, centres)
    return np.array([[hit.sum(), *columns[:, hit].sum(1)] for hit in (own == j for j in range(len(centres)))])


def _moved(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """New centres; a cluster that lost all rows keeps its old one."""
    n = sums[:, :1]
    return np.where(n > 0, sums[:, 1:] / np.maximum(n, 1), centres)


def _settled(lean: DataFrame, centres: DataFrame, by: Sequence[str], rounds: int, tol: float) -> DataFrame:
    """``by, _centres`` after the last round of each group; ``lean`` is ``by, _v`` without nulls in ``by``.

    Groups of up to ``BLOCK_ROWS`` rows are fitted to the end where their rows lie, in one job.  The rows of larger ones are packed
    once; a round reads them in place and sends one row of sums per task and group, so its traffic does not grow with the rows.
    """
    stuck = f"centres still move after {rounds} rounds"
    group = F.struct(*by, F.lit(0).alias("_one")).alias("_g")  # also without ``by``
    rows, starts = lean.select(group, "_v"), centres.select(group, "_centres")
    large = [r._g for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_ROWS).select("_g").collect()]  # each stands for a block of rows
    key = rows.schema["_g"]
    names = rows.sparkSession.createDataFrame([(g, i) for i, g in enumerate(large)], T.StructType([key, T.StructField("_group", T.IntegerType())]))
    done_type = T.StructType([key, T.StructField("_centres", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def fit_whole(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x = matrix_of(batch.column("_x")[i].values).T.copy()
                now = np.array(batch.column("_centres")[i].as_py(), float)
                for _ in range(rounds):
                    new = _moved(_cluster_sums(x, now), now)
                    gap, now = np.abs(new - now).sum(), new
                    if gap <= tol:
                        break
                else:
                    raise RuntimeError(stuck)
                out.append(now.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("_g"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["_g", "_centres"])

    small = rows.join(names, "_g", "left_anti") if large else rows
    gathered = small.groupBy("_g").agg(F.collect_list("_v").alias("_x"))  # a block at most
    done = cut_lineage(gathered.join(starts, "_g").mapInArrow(fit_whole, done_type))
    if not large:
        return done.select("_g.*", "_centres").drop("_one")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                own, x = np.asarray(batch.column("_group")), matrix_of(batch.column("_v"))
                for g in np.unique(own):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([x[own == g].T.tobytes()], pa.binary())], ["_group", "_x"])

    dealt = rows.join(names, "_g").select("_group", "_v").repartition("_group", F.pmod(F.xxhash64("_v", F.spark_partition_id()), F.lit(SALTS)))
    blocks = cut_lineage(dealt.sortWithinPartitions("_group").mapInArrow(pack, "_group int, _x binary"))
    first = {r._group: np.array(r._centres, float) for r in starts.join(names, "_g").select("_group", "_centres").collect()}
    size = max(1, HELD_DOUBLES // max(c.size for c in first.values()))
    fitted: dict[int, np.ndarray] = {}
    for at in range(0, len(large), size):
        now = {g: first[g] for g in range(at, min(at + size, len(large)))}
        for _ in range(rounds):
            new = {g: _moved(sums, now[g]) for g, sums in _sums_of_blocks(blocks, now).items()}
            moving = {g: new[g] for g in new if not np.abs(new[g] - now[g]).sum() <= tol}
            fitted |= {g: new[g] for g in new if g not in moving}
            now = moving
            if not now:
                break
        else:
            raise RuntimeError(stuck)
    rest = rows.sparkSession.createDataFrame([(large[g], c.tolist()) for g, c in fitted.items()], done_type)
    return done.unionByName(rest).select("_g.*", "_centres").drop("_one")


def _sums_of_blocks(blocks: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Counts and sums per centre of the groups in ``centres``: one row per task and group crosses the network."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, x in zip(batch.column("_group").to_pylist(), batch.column("_x")):
                if g in centres:
                    sums = _cluster_sums(np.frombuffer(x.as_buffer()).reshape(centres[g].shape[1], -1), centres[g])
                    held[g] = held[g] + sums if g in held else sums
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([s.ravel().tolist() for s in held.values()], pa.list_(pa.float64()))], ["_group", "_s"])

    added = blocks.mapInArrow(run, "_group int, _s array<double>").groupBy("_group").agg(array_sum("_s").alias("_s"))
    return {r._group: np.array(r._s).reshape(len(centres[r._group]), -1) for r in added.collect()}


def kmeans_by(df: DataFrame, cols: Sequence[str] | str, k: int, by: Sequence[str] = (PID,), rounds: int = 1000, tol: float = 1e-9) -> DataFrame:
    """k-means fitted per group, all groups in the same jobs (ML-1).

    Rows keep their columns and gain ``cluster`` and ``distance2``.  Rounds go on until
    no centre moves by more than ``tol``; RuntimeError if some still do after ``rounds``.
    ``cols`` as a string names one array column whose lengths are equal; rows with a null in it go.
    """
    whole = df.filter(F.forall(cols, lambda x: x.isNotNull())) if isinstance(cols, str) else df.dropna(subset=list(cols))
    rows = cut_lineage(whole)  # read once more at the end
    lean = (rows.dropna(subset=list(by)) if by else rows).select(*by, _as_row(cols).alias("_v"))
    centres = cut_lineage(seed_centres(rows, cols, k, by))
    return _assign(rows, _settled(lean, centres, by, rounds, tol), cols, by)


def dp_means(df: DataFrame, cols: Sequence[str], lam: float, by: Sequence[str] = (PID,), rounds: int = 1000, tol: float = 1e-9) -> DataFrame:
    """Clusters grown while some row is farther than ``lam`` (squared) from all centres (ML-3).

    By turns, one round adds the farthest row of every group that still has one, the other moves all
    centres to their means; a round is one aggregate of the assigned rows.  It ends when no row is beyond ``lam``
    and no centre moves by more than ``tol``; RuntimeError if that takes more than ``rounds``.
    """
    rows = cut_lineage(df.dropna(subset=list(cols)))
    lean = cut_lineage(rows.select(*by, *cols))  # read by every round
    centres = cut_lineage(lean.groupBy(*by).agg(F.array(F.array(*[F.avg(c) for c in cols])).alias("_centres")))
    shift = F.aggregate(F.zip_with(F.flatten("_was"), F.flatten("_means"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    for turn in range(rounds):
        mean = F.array(*[F.avg(c) for c in cols])
        farthest = F.max(F.struct("distance2", _as_row(cols).alias("c")))
        parts = _assign(lean, centres, cols, by).groupBy(*by, "cluster").agg(mean.alias("_m"), farthest.alias("_f"))
        # one row per centre; a centre that lost all its rows goes
        moved = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster", "_m"))).alias("_x"), F.max("_f").alias("_f"))
        both = moved.join(centres.withColumnRenamed("_centres", "_was"), list(by)) if by else moved.withColumn("_one", F.lit(1)).join(
            centres.select(F.lit(1).alias("_one"), F.col("_centres").alias("_was")), "_one").drop("_one")
        means = both.withColumn("_means", F.col("_x._m")).withColumn("_far", (F.col("_f.distance2") > lam) & F.lit(turn % 2 == 0))
        settled = F.lit(turn % 2 == 0) & (~F.col("_far")) & (F.size("_means") == F.size("_was")) & (shift <= tol)
        grown = F.when(F.col("_far"), F.array_append("_was", F.col("_f.c"))).otherwise(F.col("_means"))
        state = cut_lineage(means.select(*by, grown.alias("_centres"), settled.alias("_done")))
        open_groups = not state.filter(~F.coalesce("_done", F.lit(False))).isEmpty()
        if not open_groups:
            return _assign(rows, centres, cols, by)
        centres = state.drop("_done")
    raise RuntimeError(f"rows beyond the distance or moving centres after {rounds} rounds")


def dp_lambda(df: DataFrame, cols: Sequence[str], k: int, by: Sequence[str] = (PID,)) -> DataFrame:
    """``lam`` per group that makes about ``k`` clusters: farthest-first spread after ``k`` picks."""
    rows = cut_lineage(df.dropna(subset=list(cols)))  # read by every round
    centres = cut_lineage(rows.groupBy(*by).agg(F.array(F.array(*[F.avg(c) for c in cols])).alias("_centres")))
    for i in range(k):
        far = _assign(rows, centres, cols, by).groupBy(*by).agg(F.max(F.struct("distance2", _as_row(cols).alias("c"))).alias("_f"))
        lam = far.select(*by, F.col("_f.distance2").alias("lam"))
        centres = cut_lineage(centres.join(far, list(by)).select(*by, F.array_append("_centres", F.col("_f.c")).alias("_centres")))
    return lam


def features(df: DataFrame, cols: Sequence[str], scale: bool = True, name="features") -> DataFrame:
    """Vector column of complete rows, standardised over the table."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df.dropna(subset=list(cols)))
    if not scale:
        return rows.withColumnRenamed("_raw", name)
    return StandardScaler(inputCol="_raw", outputCol=name, withMean=True).fit(rows).transform(rows).drop("_raw")


def kmeans_pooled(df: DataFrame, cols: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    rows = features(cut_lineage(df), cols)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).drop("features")


def mixture(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 0, scale: bool = True) -> DataFrame:
    """Gaussian mixture with the component count of least BIC (ML-2)."""
    rows = features(cut_lineage(df), cols, scale)
    n, d = rows.count(), len(cols)
    best = None
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, predictionCol="cluster", probabilityCol="_p").fit(rows)
        free = k * (d + d * (d + 1) / 2) + k - 1
        bic = free * np.log(n) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, k, model)
    return best[2].transform(rows).drop("features", "_p").withColumn("components", F.lit(best[1])).withColumn("bic", F.lit(float(best[0])))


BACKENDS = ("gmm", "kmeans", "dp_means", "bisecting")


def cluster(df: DataFrame, cols: Sequence[str], method: str, **kw) -> DataFrame:
    """Clustering back-end by name."""
    if method == "gmm":
        return mixture(df, cols, **kw)
    if method == "kmeans":
        return kmeans_by(df, cols, **kw)
    if method == "dp_means":
        return dp_means(df, cols, **kw)
    if method == "bisecting":
        return hierarchy(df, cols, **kw)
    raise ValueError(f"unknown method {method}; use one of {BACKENDS}")


def hierarchy(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 0) -> DataFrame:
    """Top-down hierarchical clusters of standardised scores (ML-13).

    Bisection starts its halves from the centre scaled by a little noise, so
    the scores are moved off zero; distances do not change.
    """
    from .windows import normalize

    named = {c: f"_z_{c}" for c in cols}
    base = df.dropna(subset=list(cols)).withColumns({z: F.col(c).cast("double") for c, z in named.items()})
    rows = normalize(base, list(named.values()), [])
    rows = cut_lineage(rows.withColumns({z: F.coalesce(F.col(z), F.lit(0.0)) + 1 for z in named.values()}))
    vectors = VectorAssembler(inputCols=list(named.values()), outputCol="features").transform(rows)
    model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features", *named.values())


def subspace_states(df: DataFrame, groups: dict[str, Sequence[str]], k: int, by: Sequence[str] = (PID,), rounds: int = 1000) -> DataFrame:
    """One state per column group, each clustered on its own (ML-22)."""
    from .windows import normalize

    rows = normalize(df, sorted({c for cols in groups.values() for c in cols}), by)
    for name, cols in groups.items():
        rows = kmeans_by(rows, cols, k, by, rounds).withColumnRenamed("cluster", name).drop("distance2")
    return rows


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies, mutual information, normalised forms and variation of information (ML-4)."""
    joint = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

    def entropy(counts, name):
        return counts.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name)).withColumn("_one", F.lit(1))

    ha = entropy(joint.groupBy(a).agg(F.sum("n").alias("n")), "h_a")
    hb = entropy(joint.groupBy(b).agg(F.sum("n").alias("n")), "h_b")
    # one row each
    out = entropy(joint, "h_ab").join(F.broadcast(ha), "_one").join(F.broadcast(hb), "_one").drop("_one")
    mi = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    return out.withColumn("mi", mi).withColumns({
        "nmi": F.try_divide(2 * F.col("mi"), F.col("h_a") + F.col("h_b")),
        "nmi_sqrt": F.try_divide("mi", F.sqrt(F.col("h_a") * F.col("h_b"))),
        "vi": F.col("h_a") + F.col("h_b") - 2 * F.col("mi"),
    })


def confusion(df: DataFrame, truth: str, cluster_col: str) -> DataFrame:
    return df.dropna(subset=[truth, cluster_col]).groupBy(truth, cluster_col).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, truth: str, cluster_col: str) -> DataFrame:
    """F1 per label after matching labels and clusters greedily by overlap (ML-4).

    The contingency table is labels x clusters; it alone is matched in rounds.
    """
    table = confusion(df, truth, cluster_col)
    cells = [(r[0], r[1], r[2]) for r in table.collect()]  # labels x clusters
    pairs, used_t, used_c = {}, set(), set()
    for tl, c, n in sorted(cells, key=lambda r: (-r[2], str(r[0]), str(r[1]))):
        if tl not in used_t and c not in used_c:
            pairs[tl] = (c, n)
            used_t.add(tl)
            used_c.add(c)
    size_t, size_c = {}, {}
    for tl, c, n in cells:
        size_t[tl] = size_t.get(tl, 0) + n
        size_c[c] = size_c.get(c, 0) + n
    rows = []
    for tl in sorted(size_t, key=str):
        c, hit = pairs.get(tl, (None, 0))
        p, r = (hit / size_c[c] if c is not None else 0.0), hit / size_t[tl]
        rows.append((str(tl), None if c is None else str(c), p, r, 0.0 if p + r == 0 else 2 * p * r / (p + r)))
    out = df.sparkSession.createDataFrame(rows, "label string, cluster string, precision double, recall double, f1 double")
    return out.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))


def inertia(assigned: DataFrame, by: Sequence[str] = (), n_params: int | None = None) -> DataFrame:
    """Sum of squared distances, and a BIC n ln(inertia / n) + params ln n (ML-4)."""
    out = assigned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("distance2").alias("inertia"))
    if n_params is not None:
        out = out.withColumn("bic", F.col("n") * F.log(F.col("inertia") / F.col("n")) + n_params * F.log("n"))
    return out


def lasso_cv(df: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float], folds: int = 5, seed: int = 0, fold: Column | None = None) -> DataFrame:
    """Lasso with cross-validated penalty (ML-8), see :func:`lasso_folds`; without ``fold`` rows are dealt by a hash of their values."""
    return lasso_folds(df, y, xs, alphas, F.pmod(F.xxhash64(y, *xs, F.lit(seed)), F.lit(folds)) if fold is None else fold)


def forest_cv(df: DataFrame, y: str, xs: Sequence[str], grid: dict[str, Sequence[int]], kind: str = "classifier", folds: int = 5, seed: int = 0, parallelism: int = 4) -> DataFrame:
    """Random forest with a cross-validated grid: F1 or r2 per setting (ML-9)."""
    rows = features(cut_lineage(df.dropna(subset=[y]).select(F.col(y).cast("double").alias(y), *xs)), xs, scale=False)
    forest = (RandomForestClassifier if kind == "classifier" else RandomForestRegressor)(labelCol=y, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    maps = builder.build()
    ev = MulticlassClassificationEvaluator(labelCol=y, metricName="f1") if kind == "classifier" else RegressionEvaluator(labelCol=y, metricName="r2")
    model = CrossValidator(estimator=forest, estimatorParamMaps=maps, numFolds=folds, seed=seed, evaluator=ev, parallelism=parallelism).fit(rows)
    best = int(np.argmax(model.avgMetrics))
    names = list(grid)
    out = [(", ".join(f"{n}={pm[forest.getParam(n)]}" for n in names), float(m), i == best) for i, (pm, m) in enumerate(zip(maps, model.avgMetrics))]
    return df.sparkSession.createDataFrame(out, "setting string, score double, best boolean")


def _as_vector(df: DataFrame, cols: str | Sequence[str]) -> tuple[DataFrame, str]:
    return (df, cols) if isinstance(cols, str) else (df.withColumn("_vector", _as_row(cols)), "_vector")


def pca(df: DataFrame, cols: str | Sequence[str], k: int = 20) -> DataFrame:
    """``components``: the first ``k`` principal components of standardised values (ML-10).

    ``cols`` names one array column, or several columns.  The largest weight of an axis is positive.
    Rows with a null inside go.
    """
    rows, name = _as_vector(df, cols)
    stats = array_moments(rows, name).collect()  # one row
    out = whole(rows, name)
    if not stats:
        return out.select(*df.columns, F.array().cast("array<double>").alias("components"))
    mean, inverse, axes, _ = principal_axes(stats[0], k)
    parts = [dot(name, axis * inverse, (axis * inverse) @ mean) for axis in axes]
    return out.select(*df.columns, F.array(*parts).alias("components"))


def cca(df: DataFrame, xs: Sequence[str], ys: Sequence[str], reg: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Canonical correlations and weights of two column sets per group (ML-11).

    Spark sums one covariance matrix per group; the small eigenproblem of each
    runs on its aggregated row.
    """
    p, q = len(xs), len(ys)
    src = df if by else df.withColumn("_all", F.lit(1))
    key = list(by) or ["_all"]
    stats = moments(src, [*xs, *ys], key)
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([stats.schema[k] for k in key] + [
        T.StructField("n", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("correlation", T.DoubleType()),
        T.StructField("x_weights", T.ArrayType(T.DoubleType())), T.StructField("y_weights", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                r = dict(zip(pdf.columns, values))
                cov = full_matrix(np.asarray(r["covs"], float), p + q)
                sd = np.sqrt(np.diag(cov))
                if not np.all(sd > 0):  # a constant column has no correlation
                    rows.extend([*(r[k] for k in key), r["n"], i + 1, None, None, None] for i in range(min(p, q)))
                    continue
                cor = cov / np.outer(sd, sd)
                a, b, c = cor[:p, :p] + reg * np.eye(p), cor[p:, p:] + reg * np.eye(q), cor[:p, p:]
                wa, va = np.linalg.eigh(a)
                wb, vb = np.linalg.eigh(b)
                ra = va @ np.diag(1 / np.sqrt(np.maximum(wa, 1e-12))) @ va.T
                rb = vb @ np.diag(1 / np.sqrt(np.maximum(wb, 1e-12))) @ vb.T
                u, s, vt = np.linalg.svd(ra @ c @ rb)
                for i in range(min(p, q)):
                    x, y = ra @ u[:, i], rb @ vt[i]
                    sign = 1.0 if x[np.argmax(np.abs(x))] >= 0 else -1.0
                    rows.append([*(r[k] for k in key), r["n"], i + 1, float(s[i]), list(sign * x), list(sign * y)])
            yield pd.DataFrame(rows, columns=schema.names)

    return stats.mapInPandas(solve, schema).drop("_all")


def discriminant(df: DataFrame, vector: str | Sequence[str], label: str, k: int = 2) -> DataFrame:
    """Projection on the directions that part the labels best (ML-12): ``axis_1, axis_2, ...``.

    ``vector`` names one array column, or several columns.  One packed row of moments per label and task is
    summed; a d x d eigenproblem runs on the driver.  Rows with a null inside go.  No rows give no axes.
    """
    rows, name = _as_vector(df, vector)
    stats = array_moments(rows, name, [label]).collect()  # one row per label
    out = whole(rows, name)
    if stats:
        grand, axes = discriminant_axes(stats, k)
        out = out.withColumns({f"axis_{j + 1}": dot(name, axis, axis @ grand) for j, axis in enumerate(axes)})
    return out.select(*df.columns, *[c for c in out.columns if c.startswith("axis_") and c not in df.columns])


#: Words whose names and weights a topic fit may hold on the driver.
HELD_WORDS = 1 << 19


def _top_topic(dist: DataFrame, keep: Sequence[str]) -> DataFrame:
    top = F.array_max("topics")
    return dist.select(*keep, "topics", (F.array_position("topics", top) - 1).cast("int").alias("topic"), top.alias("weight"))


def topics(docs: DataFrame, k: int, words: str = "words", min_df: float = 1.0, rounds: int = 10, seed: int = 0, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Topic model on word windows (ML-14): documents with their top topic, and key words per topic.

    All words count; null has none.  Variational fitting has no end of its own: ``rounds`` passes are the fit asked for.
    MLlib's fit holds words and weights on the driver; beyond ``HELD_WORDS`` words they stay in tables.
    """
    docs = docs.select(*keep, F.coalesce(words, F.array().cast("array<string>")).alias(words))
    vocabulary = word_counts(docs, words)
    size = vocabulary.count()
    if size > HELD_WORDS:
        dist, key_words = topics_in_tables(docs, vocabulary, k, words, min_df, rounds, seed)
        return _top_topic(dist, keep), key_words
    docs = cut_lineage(docs)
    counted = CountVectorizer(inputCol=words, outputCol="_tf", vocabSize=max(size, 1), minDF=min_df).fit(docs)
    rows = counted.transform(docs)
    rows = IDF(inputCol="_tf", outputCol="_idf").fit(rows).transform(rows)
    rows = Normalizer(p=1.0, inputCol="_idf", outputCol="features").transform(rows)
    model = LDA(k=k, seed=seed, maxIter=rounds, featuresCol="features").fit(rows)
    dist = model.transform(rows).withColumn("topics", vector_to_array("topicDistribution"))
    named = _top_topic(dist, keep)
    top_terms = model.describeTopics(10).select("topic", F.posexplode("termIndices").alias("_rank", "_term"))
    wanted = sorted({r._term for r in top_terms.select("_term").collect()})  # ten per topic
    names = docs.sparkSession.createDataFrame([(i, counted.vocabulary[i]) for i in wanted], "_term int, _word string")
    words_of = top_terms.join(names, "_term").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_rank", "_word"))).alias("_w"))
    return named, words_of.select("topic", F.col("_w._word").alias("key_words"))


def topic_location_corr(windows: DataFrame, topics_col: str, k: int, shares: Sequence[str], threshold: float, by: Sequence[str] = (PID,)) -> DataFrame:
    """Correlation of topic presence with place shares (ML-15).

    A topic is present in a window when its weight reaches the threshold.
    """
    cells = [
        F.struct(F.lit(i).alias("topic"), F.lit(s).alias("location"), safe_corr((F.col(topics_col)[i] >= threshold).cast("double"), F.col(s)).alias("r"))
        for i in range(k) for s in shares
    ]
    out = windows.groupBy(*by).agg(F.array(*cells).alias("_c"))
    return out.select(*by, F.explode("_c").alias("c")).select(*by, "c.*")


def dominant_location(windows: DataFrame, shares: Sequence[str]) -> DataFrame:
    """Place with the largest share per window and its weight (ML-15); ties to the first listed."""
    top = F.greatest(*[F.col(s) for s in shares])
    name = F.coalesce(*[F.when(F.col(s) == top, F.lit(s)) for s in shares])
    return windows.withColumn("location", name).withColumn("location_weight", top)


def run_features(runs: DataFrame, kinds: Sequence, state: str = "state", by: Sequence[str] = (PID,)) -> DataFrame:
    """Seconds and count of runs per known state, as columns (ML-16)."""
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    aggs = []
    for s in kinds:
        hit = F.col(state) == s
        aggs += [F.sum(F.when(hit, seconds).otherwise(0.0)).alias(f"duration_{s}"), F.count_if(hit).alias(f"count_{s}")]
    return runs.groupBy(*by).agg(*aggs)
