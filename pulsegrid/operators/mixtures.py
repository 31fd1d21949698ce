"""Gaussian mixtures fitted per group, all groups and component counts in the same jobs (ML-2)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .gram import array_moments, array_sum, group_codes, matrix_of, whole
from .regression import full_matrix

#: Rows of one group that are packed as one block at most (a smaller group is fitted inside one task), and over how many tasks a larger one is dealt.
BLOCK_ROWS, SALTS = 4096, 16
_DOUBLES = T.ArrayType(T.DoubleType())


def _split(flat, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of ``k`` components from one array."""
    flat = np.asarray(flat, float)
    return flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d, d)


def log_densities(x: np.ndarray, params, k: int) -> np.ndarray:
    """Log of weight times density of every row under every component."""
    d = x.shape[1]
    weights, means, covs = _split(params, k, d)
    out = np.full((len(x), k), -np.inf)
    for j in np.flatnonzero(weights > 0):
        low = np.linalg.cholesky(covs[j])
        z = np.linalg.solve(low, (x - means[j]).T)
        out[:, j] = np.log(weights[j]) - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(low)).sum()
    return out


def _shares(x: np.ndarray, params, k: int) -> tuple[np.ndarray, float]:
    """Responsibilities and the log-likelihood."""
    logs = log_densities(x, params, k)
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - total[:, None]), float(total.sum())


def expected(x: np.ndarray, params, k: int) -> np.ndarray:
    """Log-likelihood, then per component the responsibilities' sum and their sums of ``x`` and of products around the old mean."""
    r, ll = _shares(x, params, k)
    _, means, _ = _split(params, k, x.shape[1])
    parts = [np.array([ll])]
    for j in range(k):
        y = x - means[j]
        parts += [np.array([r[:, j].sum()]), r[:, j] @ y, ((y * r[:, j, None]).T @ y).ravel()]
    return np.concatenate(parts)


def maximised(sums: np.ndarray, params, k: int, d: int, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised likelihood of ``params`` and the parameters that follow.

    ``ridge`` is added to each component's scatter, which maximises the likelihood less
    ``ridge / 2`` times the traces of inverse covariances; this value never falls.
    """
    weights, means, covs = (x.copy() for x in _split(params, k, d))
    value = sums[0] - 0.5 * ridge * sum(np.trace(np.linalg.inv(covs[j])) for j in np.flatnonzero(weights > 0))
    per = sums[1:].reshape(k, 1 + d + d * d)
    for j in range(k):
        n = per[j, 0]
        weights[j] = n / per[:, 0].sum()
        if n > 1e-12:
            gap = per[j, 1 : 1 + d] / n
            scatter = per[j, 1 + d :].reshape(d, d) - n * np.outer(gap, gap)
            means[j] += gap
            covs[j] = (scatter + ridge * np.eye(d)) / n
        else:
            weights[j] = 0.0
    return float(value), np.concatenate([weights, means.ravel(), covs.ravel()])


#: Doubles of one array when many groups are fitted at once.
_AT_ONCE = 1 << 20


def _fit_together(xs: list[np.ndarray], starts: list[np.ndarray], k: int, d: int, rounds: int, tol: float, ridge: float) -> list[tuple]:
    """``params, value, loglik, turn`` of many groups' fits with ``k`` components, as arrays with a row per group.

    The same steps as :func:`expected` and :func:`maximised`; groups are padded to the longest, and settled ones leave.
    """
    n = np.array([len(x) for x in xs])
    x, there = np.zeros((len(xs), n.max(), d)), np.arange(n.max()) < n[:, None]
    x[there] = np.concatenate(xs)
    flat = np.array(starts, float)
    weights, means, covs = flat[:, :k].copy(), flat[:, k : k + k * d].reshape(-1, k, d).copy(), flat[:, k + k * d :].reshape(-1, k, d, d).copy()
    left, before, out = np.arange(len(xs)), np.full(len(xs), -np.inf), [None] * len(xs)
    for turn in range(1, rounds + 1):
        low = np.linalg.cholesky(covs)
        gaps = x[:, None] - means[:, :, None]  # group, component, row, value
        z = np.linalg.solve(low, gaps.swapaxes(2, 3))
        with np.errstate(divide="ignore"):
            share = np.log(weights)
        logs = (share - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(low, axis1=2, axis2=3)).sum(2))[:, :, None] - 0.5 * (z * z).sum(2)
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        loglik = np.where(there, total[:, 0], 0.0).sum(1)
        r = np.exp(logs - total) * there[:, None]
        alive = weights > 0
        value = loglik - 0.5 * ridge * np.where(alive, np.trace(np.linalg.inv(covs), axis1=2, axis2=3), 0.0).sum(1)
        stay = value - before <= tol * n
        for i in np.flatnonzero(stay):
            out[left[i]] = (np.concatenate([weights[i], means[i].ravel(), covs[i].ravel()]), float(value[i]), float(loglik[i]), turn)
        go = ~stay
        if not go.any():
            return out
        x, there, n, left, before = x[go], there[go], n[go], left[go], value[go]
        r, gaps, weights, means, covs = r[go], gaps[go], weights[go], means[go], covs[go]
        counts = r.sum(2)
        full = counts > 1e-12
        some = np.where(full, counts, 1.0)
        gap = np.where(full[:, :, None], (r[:, :, None] @ gaps)[:, :, 0] / some[:, :, None], 0.0)
        scatter = (gaps * r[:, :, :, None]).swapaxes(2, 3) @ gaps - some[:, :, None, None] * gap[:, :, :, None] * gap[:, :, None, :]
        weights = np.where(full, counts / counts.sum(1, keepdims=True), 0.0)
        means = means + gap
        covs = np.where(full[:, :, None, None], (scatter + ridge * np.eye(d)) / some[:, :, None, None], covs)
    raise RuntimeError(f"mixtures still move after {rounds} rounds")


def _blocks(rows: DataFrame) -> DataFrame:
    """``_g, _x``: rows of a group packed, dealt over tasks once; rounds read the blocks."""
    salt = F.pmod(F.xxhash64("_v", F.spark_partition_id()), F.lit(SALTS))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = group_codes([batch.column("_g")])
            x = matrix_of(batch.column("_v"))
            order = np.argsort(code, kind="stable")
            for own in np.split(order, np.cumsum(np.bincount(code))[:-1]):
                for i in range(0, len(own), BLOCK_ROWS):
                    part = own[i : i + BLOCK_ROWS]
                    if len(part):
                        yield pa.RecordBatch.from_arrays([batch.column("_g").take(pa.array(part[:1])), pa.array([x[part].ravel().tolist()], pa.list_(pa.float64()))], ["_g", "_x"])

    dealt = rows.select("_g", "_v").repartition("_g", salt).sortWithinPartitions("_g")
    return dealt.mapInArrow(run, T.StructType([rows.schema["_g"], T.StructField("_x", _DOUBLES)]))


def _starts(rows: DataFrame, ks: Sequence[int], d: int) -> DataFrame:
    """``_g, k, params``: the first distinct rows in hash order as means, the group's covariance everywhere.

    A group with fewer distinct rows than ``k`` starts that fit with as many components as it has.
    """
    most = max(ks)
    seen = rows.select("_g", "_v").distinct()
    first = seen.withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("_v"), "_v"))).filter(F.col("_i") <= most)
    seeds = first.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("s"))  # at most ``most`` rows
    stats = array_moments(rows, "_v", ["_g"]).select("_g", "n", "covs")
    key = rows.schema["_g"]

    def begin(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cov = full_matrix(np.asarray(r.covs, float), d) + 1e-3 * np.eye(d)
                means = np.array([np.asarray(x["_v"], float) for x in r.s])
                for k in sorted({min(k, len(means)) for k in ks}):
                    flat = np.concatenate([np.full(k, 1 / k), means[:k].ravel(), np.tile(cov.ravel(), k)])
                    out.append((r[0], int(r.n), k, flat.tolist()))
            yield pd.DataFrame(out, columns=["_g", "n", "k", "params"])

    shape = T.StructType([key, T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("params", _DOUBLES)])
    return seeds.join(stats, "_g").select("_g", "n", "covs", "s").mapInPandas(begin, shape)


def fit_mixtures(df: DataFrame, vector: str, ks: Sequence[int], by: Sequence[str], rounds: int = 1000, tol: float = 1e-5, ridge: float = 1e-2) -> DataFrame:
    """``by, n, k, params, value, loglik, bic, rounds`` of every group and component count.

    Groups of up to ``BLOCK_ROWS`` rows are fitted to the end where their rows lie, in one job.  Larger ones share rounds:
    a round sends, per task, group and count, one packed row of sums; fits that gain less than ``tol`` per row have settled and
    are not computed again.  ``value`` is the penalised likelihood, which no round lowers.  RuntimeError if some fit
    still moves after ``rounds``.  Rows with a null or NaN inside go; no rows give no fits.
    """
    rows = whole(df, vector).select(F.struct(*by).alias("_g"), F.col(vector).cast("array<double>").alias("_v"))
    rows = cut_lineage(rows)
    one = rows.select(F.size("_v").alias("d")).first()
    d = one.d if one else 0
    shape = T.StructType([rows.schema["_g"], *[T.StructField(*x) for x in (("n", T.LongType()), ("k", T.IntegerType()), ("params", _DOUBLES), ("value", T.DoubleType()), ("loglik", T.DoubleType()), ("done", T.BooleanType()))]])
    if not d:
        return df.sparkSession.createDataFrame([], T.StructType([*shape.fields[:-1], T.StructField("bic", T.DoubleType()), T.StructField("rounds", T.IntegerType())])).select("_g.*", "n", "k", "params", "value", "loglik", "bic", "rounds")
    fits = cut_lineage(_starts(rows, ks, d).withColumns({"value": F.lit(float("-inf")), "loglik": F.lit(float("-inf")), "done": F.lit(False)}))
    sizes = fits.select("_g", "n").distinct()
    small = sizes.filter(F.col("n") <= BLOCK_ROWS).select("_g")
    gathered = rows.join(small, "_g", "left_semi").groupBy("_g").agg(F.collect_list("_v").alias("_x"))  # a block at most

    def fit_whole(batches):
        for batch in batches:
            xs = [np.asarray(x.values.flatten()).reshape(-1, d) for x in batch.column("_x")]
            fits_of: dict[int, list] = {}
            for i, fits_ in enumerate(batch.column("fits").to_pylist()):
                for fit in fits_:
                    fits_of.setdefault(fit["k"], []).append((len(xs[i]), i, fit["params"]))
            out = []
            for k, todo in fits_of.items():
                todo.sort(key=lambda t: t[:2])  # groups of like size together
                while todo:
                    many = max(1, _AT_ONCE // (todo[-1][0] * k * d))
                    some, todo = todo[-many:], todo[:-many]
                    found = _fit_together([xs[i] for _, i, _ in some], [start for _, _, start in some], k, d, rounds, tol, ridge)
                    out += [{"_g": i, "n": n, "k": k, "params": params.tolist(), "value": value, "loglik": loglik, "rounds": turn} for (n, i, _), (params, value, loglik, turn) in zip(some, found)]
            groups = batch.column("_g").take(pa.array([r.pop("_g") for r in out], pa.int64()))
            rest = pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int64()), ("k", pa.int32()), ("params", pa.list_(pa.float64())), ("value", pa.float64()), ("loglik", pa.float64()), ("rounds", pa.int32())]))
            yield pa.RecordBatch.from_arrays([groups, *rest.columns], ["_g", *rest.schema.names])

    def packed(of: DataFrame) -> DataFrame:
        return of.groupBy("_g").agg(F.collect_list(F.struct("k", "params")).alias("fits"))  # one per component count

    settled = cut_lineage(gathered.join(packed(fits), "_g").mapInArrow(fit_whole, T.StructType([*shape.fields[:-1], T.StructField("rounds", T.IntegerType())])))
    fits = fits.join(small, "_g", "left_anti")
    blocks = cut_lineage(_blocks(rows.join(small, "_g", "left_anti")))

    def expect(batches):
        for batch in batches:
            gs, ks_, ss = [], [], []
            for i in range(batch.num_rows):
                x = np.asarray(batch.column("_x")[i].values).reshape(-1, d)
                for fit in batch.column("fits")[i].as_py():
                    gs.append(i)
                    ks_.append(fit["k"])
                    ss.append(expected(x, fit["params"], fit["k"]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("_g").take(pa.array(gs, pa.int64())), pa.array(ks_, pa.int32()), pa.array(ss, pa.list_(pa.float64()))], ["_g", "k", "_s"])

    def follow(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                sums = np.asarray(r[6], float)
                value, params = maximised(sums, r.params, r.k, d, ridge)
                if value - r.value <= tol * r.n:  # keep what was evaluated
                    out.append((r[0], r.n, r.k, r.params, value, float(sums[0]), True))
                else:
                    out.append((r[0], r.n, r.k, params.tolist(), value, float(sums[0]), False))
            yield pd.DataFrame(out, columns=shape.names)

    for turn in range(1, rounds + 2):
        if fits.isEmpty():
            free = F.col("k") * F.lit(1 + d + d * (d + 1) / 2) - 1
            return settled.withColumn("bic", free * F.log("n") - 2 * F.col("loglik")).select("_g.*", "n", "k", "params", "value", "loglik", "bic", "rounds")
        sums = blocks.join(packed(fits), "_g").mapInArrow(expect, T.StructType([rows.schema["_g"], T.StructField("k", T.IntegerType()), T.StructField("_s", _DOUBLES)]))
        sums = sums.groupBy("_g", "k").agg(array_sum("_s").alias("sums"))
        now = cut_lineage(fits.join(sums, ["_g", "k"]).select("_g", "n", "k", "params", "value", "loglik", "sums").mapInPandas(follow, shape).withColumn("rounds", F.lit(turn)))
        settled = settled.unionByName(now.filter("done").drop("done"))
        fits = now.filter("not done").drop("rounds")
    raise RuntimeError(f"mixtures still move after {rounds} rounds")


def mixture_by(df: DataFrame, cols: str | Sequence[str], ks: Sequence[int], by: Sequence[str], **options) -> DataFrame:
    """Rows with ``cluster, components, bic`` of the mixture of least BIC of their group (ML-2).

    ``cols`` names one array column, or several columns; normalise per group first.  Options as in :func:`fit_mixtures`.
    Of equal BIC the fewer components are taken.  Rows with a null inside go.
    """
    vector = cols if isinstance(cols, str) else "_vector"
    src = df if isinstance(cols, str) else df.withColumn("_vector", F.array(*[F.col(c).cast("double") for c in cols]))
    rows = cut_lineage(whole(src, vector))
    fits = fit_mixtures(rows, vector, ks, by, **options)
    best = fits.groupBy(F.struct(*by).alias("_g")).agg(F.min(F.struct("bic", "k", "params")).alias("_b"))

    @F.pandas_udf("int")
    def nearest(x: pd.Series, k: pd.Series, params: pd.Series) -> pd.Series:
        out = np.empty(len(x), np.int32)
        groups: dict[tuple, list[int]] = {}
        for i, (n, p) in enumerate(zip(k, params)):
            groups.setdefault((n, np.asarray(p).tobytes()), []).append(i)
        values = x.to_numpy()
        for (n, p), own in groups.items():
            out[own] = log_densities(np.stack(values[own]).astype(float), np.frombuffer(p), n).argmax(1)
        return pd.Series(out)

    placed = rows.withColumn("_g", F.struct(*by)).join(best, "_g")
    out = placed.withColumns({"cluster": nearest(F.col(vector).cast("array<double>"), F.col("_b.k"), F.col("_b.params")), "components": F.col("_b.k"), "bic": F.col("_b.bic")})
    return out.select(*df.columns, "cluster", "components", "bic")
