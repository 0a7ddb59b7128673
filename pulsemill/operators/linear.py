"""Scaler and ridge probe on embeddings, and the batch prediction hook.

A probe needs only sums: Spark adds up per-fold moment matrices of size
(dimension + 1)^2, and the small systems are solved from those.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.sources.storage import materialize


def pool_embeddings(segments: DataFrame, case: str = "case_key", col: str = "embedding",
                    dim: int = None, keep=()) -> DataFrame:
    """Mean vector and segment count per case; `dim` checks the vector length."""
    x = F.col(col).cast("array<double>")
    if dim is not None:
        x = F.when(F.size(x) == dim, x).otherwise(
            F.raise_error(F.lit(f"expected vectors of length {dim}")).cast("array<double>"))
    out = segments.select(case, *keep, array_to_vector(x).alias("__x")).groupBy(case, *keep).agg(
        Summarizer.mean(F.col("__x")).alias("__m"), F.count(F.lit(1)).alias("n_segments"))
    return out.select(case, *keep, vector_to_array("__m").alias("embedding"), "n_segments")


def fit_scaler(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row per position: mean and population deviation (0 or non-finite becomes 1)."""
    moments = df.select(array_to_vector(F.col(col).cast("array<double>")).alias("__x")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("__x")).alias("s"))
    arrays = moments.select(F.col("s.count").alias("n"), F.posexplode(F.arrays_zip(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))))
    n = F.col("n").cast("double")
    sd = F.sqrt(F.col("col.v") * (n - 1) / n)
    ok = sd.isNotNull() & ~F.isnan(sd) & (sd > 0) & (sd < float("inf"))
    return arrays.select("pos", F.col("col.m").alias("mean"),
                         F.when(ok, sd).otherwise(1.0).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, col: str = "embedding",
                 out: str = "scaled") -> DataFrame:
    """Scale vectors; the scaler has one row per dimension and is read once."""
    packed = scaler.agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "scale"))).alias("k"))
    rows = df.withColumn("__k", packed.scalar())
    return rows.withColumn(out, F.zip_with(
        col, "__k", lambda x, k: (x.cast("double") - k["mean"]) / k["scale"])).drop("__k")


FAN = 64


def moment_matrices(df: DataFrame, targets: list, col: str = "embedding", fold: str = None,
                    center: np.ndarray = None) -> DataFrame:
    """Sums of products of (1, x, y) per fold, one row (fold, m) with the upper triangle as one array.

    Position 0 is the constant, then the vector, then the targets. Every task adds up its own rows
    to one array per fold; the arrays are then added in a tree, FAN at a time, so no task holds more than FAN of
    them and what is shuffled is one row per task and fold.
    """
    names = list(targets)
    shift = None if center is None else np.asarray(center, dtype=np.float64)

    def partial(batches):
        sums = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["x"].to_numpy()).astype(np.float64)
            y = pdf[names].to_numpy(dtype=np.float64)
            z = np.hstack([np.ones((len(pdf), 1)), x if shift is None else x - shift, y])
            for f in np.unique(pdf["fold"]):
                part = z[(pdf["fold"] == f).to_numpy()]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        task = TaskContext.get().partitionId()
        for f, m in sums.items():
            yield pd.DataFrame({"fold": [int(f)], "part": [task], "m": [m[np.triu_indices(len(m))]]})

    def added(pdf):
        return pd.DataFrame({"fold": pdf["fold"][:1], "part": pdf["part"][:1], "m": [np.sum(list(pdf["m"]), axis=0)]})

    kind = "fold int, part long, m array<double>"
    rows = df.select(F.col(col).cast("array<double>").alias("x"),
                     (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                     *[F.col(t).cast("double").alias(t) for t in names])
    parts, most = rows.mapInPandas(partial, kind), None
    while most is None or most > 0:
        parts = materialize(parts.withColumn("part", F.floor(F.col("part") / F.lit(FAN)))
                            .groupBy("fold", "part").applyInPandas(added, kind))
        most = parts.agg(F.max("part")).first()[0] or 0
    return parts.select("fold", "m")


def gram_matrix(df: DataFrame, col: str = "embedding") -> DataFrame:
    """X'X as rows (a, b, total), positions from 0."""
    def square(batches):
        for pdf in batches:
            for m in pdf["m"]:
                whole = _whole(m)[1:, 1:]
                a, b = np.indices(whole.shape)
                yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "total": whole.ravel()})

    return moment_matrices(df, [], col).mapInPandas(square, "a int, b int, total double")


def _whole(packed) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(packed) + 1) - 1) / 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = packed
    return m + np.triu(m, 1).T


@dataclass
class Ridge:
    """Coefficients on scaled inputs, the scaler, and the penalty they were fitted with."""
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float


def _collect_folds(matrices: DataFrame) -> dict:
    """Moment matrices on the driver: folds x (dim + targets + 1)^2 / 2 numbers, whatever the data."""
    return {int(r["fold"]): _whole(r["m"]) for r in matrices.collect()}


def _solve(m: np.ndarray, dim: int, target: int, alpha: float):
    """Scaler and ridge solution from a moment matrix."""
    n = m[0, 0]
    mean, x, y = m[0, 1:dim + 1] / n, slice(1, dim + 1), dim + 1 + target
    cov = m[x, x] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[~np.isfinite(scale) | (scale == 0.0)] = 1.0
    intercept = m[0, y] / n
    gram = n * cov / np.outer(scale, scale)
    xy = (m[x, y] - m[0, x] * intercept) / scale
    return mean, scale, np.linalg.solve(gram + alpha * np.eye(dim), xy), float(intercept)


def _mse(m: np.ndarray, dim: int, target: int, mean, scale, coef, intercept) -> float:
    """Mean squared error of a linear model on the rows summed in `m`."""
    w = np.zeros(m.shape[0])
    w[1:dim + 1] = coef / scale
    w[0] = intercept - float(mean @ (coef / scale))
    w[dim + 1 + target] = -1.0
    return float(w @ m @ w / m[0, 0])


def fit_ridge_cv(df: DataFrame, targets: list, fold: str, dim: int, col: str = "embedding",
                 alphas=tuple(fixed.RIDGE_ALPHAS)) -> tuple:
    """Penalty by cross-validation, then a fit on everything, for each target.

    Returns ({target: Ridge}, rows of (target, alpha, mean_test_mse)). The scaler is
    refitted for every fold. The first penalty with the smallest mean error wins.
    One pass over the data serves every fold, penalty and target.
    """
    if any(a <= 0 for a in alphas):
        raise ValueError("penalties must be positive")
    # Centring on the overall mean keeps the sums of products well conditioned.
    center = np.array([r["mean"] for r in fit_scaler(df, col).orderBy("pos").collect()])
    folds = _collect_folds(moment_matrices(df, targets, col, fold, center))
    if len(folds) < 2:
        raise ValueError("need at least two folds")
    whole = sum(folds.values())
    models, scores = {}, []
    for t, name in enumerate(targets):
        best = None
        for alpha in alphas:
            errors = [_mse(m, dim, t, *_solve(whole - m, dim, t, alpha))
                      for _, m in sorted(folds.items())]
            mean_error = float(np.mean(errors))
            scores.append((name, float(alpha), mean_error))
            if best is None or mean_error < best[1]:
                best = (float(alpha), mean_error)
        mean, scale, coef, intercept = _solve(whole, dim, t, best[0])
        models[name] = Ridge(mean + center, scale, coef, intercept, best[0])
    return models, scores


def fit_ridge(df: DataFrame, target: str, alpha: float, dim: int,
              col: str = "embedding") -> Ridge:
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    center = np.array([r["mean"] for r in fit_scaler(df, col).orderBy("pos").collect()])
    m = _collect_folds(moment_matrices(df, [target], col, None, center))[0]
    mean, scale, coef, intercept = _solve(m, dim, 0, alpha)
    return Ridge(mean + center, scale, coef, intercept, alpha)


def predict_ridge(df: DataFrame, model: Ridge, out: str, col: str = "embedding") -> DataFrame:
    """Intercept plus the dot product with the scaled vector, as a column expression."""
    weights = [float(w) for w in model.coef / model.scale]
    base = float(model.intercept - model.mean @ (model.coef / model.scale))
    product = F.aggregate(F.zip_with(col, F.lit(weights), lambda x, w: x.cast("double") * w),
                          F.lit(base), lambda s, v: s + v)
    return df.withColumn(out, product)


def normal_equations(df: DataFrame, model: Ridge, target: str, col: str = "embedding") -> DataFrame:
    """(pos, mean, scale, intercept, residual): what is left of the ridge's normal equations, zero for the
    solution: the sum over rows of scaled input times error, less the penalty times the weight."""
    k = F.array(*[F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("scale"), F.lit(float(c)).alias("coef"))
                  for m, s, c in zip(model.mean, model.scale, model.coef)])
    rows = predict_ridge(df, model, "__p", col).withColumn("__e", F.col(target).cast("double") - F.col("__p"))
    cells = rows.select("__e", F.posexplode(F.zip_with(F.col(col), k, lambda x, y: F.struct(
        ((x.cast("double") - y["mean"]) / y["scale"]).alias("z"), y.alias("k")))).alias("pos", "c"))
    return cells.groupBy("pos").agg(
        F.first("c.k.mean").alias("mean"), F.first("c.k.scale").alias("scale"),
        F.lit(float(model.intercept)).alias("intercept"),
        (F.sum(F.col("c.z") * F.col("__e")) - F.lit(float(model.alpha)) * F.first("c.k.coef")).alias("residual"))


def predict_windows(windows: DataFrame, fn, schema: str, keep: list) -> DataFrame:
    """Run a user's batch prediction over windows.

    `fn(pdf)` gets a pandas batch and returns a pandas frame of predictions with the same
    number of rows; the `keep` columns are carried over. `schema` covers both.
    """
    def run(batches):
        for pdf in batches:
            made = fn(pdf)
            if len(made) != len(pdf):
                raise ValueError("the prediction must return one row per window")
            yield pd.concat([pdf[keep].reset_index(drop=True), made.reset_index(drop=True)], axis=1)
    return windows.mapInPandas(run, schema)
