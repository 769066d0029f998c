"""Regression, classification, projection, k-means and Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.operators.features import assemble
from tabscope.operators.pairwise import rows_of
from tabscope.scratch import remove, written

# Settings of the compared models.
CLUSTERS = 3
ELBOW_RANGE = range(2, 10)
# rows a task works on at a time: what a core keeps at hand
ROWS_AT_ONCE = 4096
# rows kept side by side for the steps of a fit
PACKED_ROWS = 1024
# class scores a task keeps at a time
SCORES_AT_ONCE = 4_000_000
CLASSES_AT_ONCE = 20_000


@contextmanager
def kept(df: DataFrame):
    """Keep the input of an iterative fit on the executors; a lost block is recomputed."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and R² in one aggregate; NULL where x (or for R², y) has no spread."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.filter(a.isNotNull() & b.isNotNull()).select(a.alias("x"), b.alias("y"))
    sums = rows.agg(
        F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    slope = F.try_divide(F.col("c"), F.col("vx"))
    return sums.select(
        slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")).alias("r2"),
    )


def multiple_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Least squares by the normal equations: one row per term, with R² on each."""
    data = assemble(df.select(*features, F.col(target).cast("double").alias("label")).na.drop(), features)
    model = LinearRegression(solver="normal", regParam=0.0).fit(data.select("features", "label"))
    rows = [("intercept", float(model.intercept))] + [(f, float(w)) for f, w in zip(features, model.coefficients)]
    r2 = float(model.summary.r2)
    return df.sparkSession.createDataFrame([(t, v, r2) for t, v in rows], "term string, coefficient double, r2 double")


def accuracy(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def principal_components(df: DataFrame, features: Sequence[str], keep: Sequence[str], k: int = 2) -> DataFrame:
    """Projection of centred features; each component's largest loading is positive."""
    data = assemble(df.select(*keep, *features), features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j])) or 1.0 for j in range(k)]
    scores = vector_to_array("pc")
    return model.transform(data).select(*keep, *[(scores[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])


# rows that may become the next centre, picked by a digest of their key
STARTS = 32
MAX_STEPS = 300
# a fit ends when its centres move (squared, all together) less than this part of the mean variance
MOVE = 1e-4
# and a mixture when its mean log-likelihood changes by less
GAIN = 1e-3
RIDGE = 1e-6


def _packed(vectors: DataFrame, width: int) -> DataFrame:
    """The rows side by side as bytes, so a step neither converts nor checks them again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(0), width)
            blocks = [x[at:at + PACKED_ROWS].tobytes() for at in range(0, len(x), PACKED_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["x"])

    return vectors.select(vector_to_array("features").alias("x")).mapInArrow(pack, "x binary")


def _summed(rows: DataFrame, width: int, size: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all packed rows of a vector of ``size`` numbers: one small vector per task, added up by Spark."""
    together = max(1, ROWS_AT_ONCE // PACKED_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            blocks = [np.frombuffer(v.as_buffer(), np.float64).reshape(-1, width) for v in batch.column(0)]
            for at in range(0, len(blocks), together):
                total += partial(np.concatenate(blocks[at:at + together]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "s"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances by plain sums, so equal distances are equal; by row and centre, a centre's side by side."""
    out, columns, gap = np.zeros((len(centers), len(x))), np.ascontiguousarray(x.T), np.empty(len(x))
    for total, center in zip(out, centers):
        for column, c in zip(columns, center):
            np.subtract(column, c, out=gap)
            gap *= gap
            total += gap
    return out.T


def _nearest(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each row, the first of equally near ones."""
    best, at = gaps[:, 0].copy(), np.zeros(len(gaps), np.int64)
    for g in range(1, gaps.shape[1]):
        nearer = gaps[:, g] < best
        at[nearer] = g
        np.minimum(best, gaps[:, g], out=best)
    return at, best


def _settled(rows: DataFrame, centers: np.ndarray, move: float, max_steps: int) -> tuple[np.ndarray, float]:
    """Centres after steps of assigning rows and averaging them, and the within-cluster cost of the last."""
    k, width = centers.shape

    def partial(x: np.ndarray) -> np.ndarray:
        nearest, least = _nearest(_gaps(x, centers))
        one = (nearest == np.arange(k)[:, None]).astype(np.float64)
        return np.concatenate([one.sum(axis=1), (one @ x).ravel(), [least.sum()]])

    for _ in range(max_steps):
        found = _summed(rows, width, k * (1 + width) + 1, partial)
        n, sums, cost = found[:k, None], found[k:-1].reshape(k, width), float(found[-1])
        moved = np.where(n > 0, sums / np.maximum(n, 1), centers)
        if ((moved - centers) ** 2).sum() <= move:
            return centers, cost
        centers = moved
    raise RuntimeError(f"k-means of {k} clusters still moves after {max_steps} steps")


def fit_kmeans(vectors: DataFrame, key: str, ks: Sequence[int] = (CLUSTERS,), max_steps: int = MAX_STEPS) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, within-cluster cost) for each k, the same on every run.

    One centre is the mean. Each further one starts, beside the settled centres before it, at the row
    that lowers the cost most, among ``STARTS`` rows picked by a digest of their key (the first in
    that order of equally good ones). So the cost never rises with k.
    """
    starts = vectors.select(vector_to_array("features").alias("x"), F.col(key).cast("string").alias("key")).orderBy(F.md5("key"), "key").limit(STARTS).collect()
    if not starts:
        return {}
    width = len(starts[0]["x"])
    candidates = np.array([r["x"] for r in starts], dtype=np.float64)
    found = {}
    with kept(_packed(vectors, width)) as rows:
        first = _summed(rows, width, width + 1, lambda x: np.append(x.sum(axis=0), len(x)))
        n, mean = first[-1], first[:-1] / first[-1]
        move = MOVE * float((_summed(rows, width, width, lambda x: np.square(x - mean).sum(axis=0)) / n).mean())
        centers, cost = _settled(rows, mean[None], move, max_steps)
        for k in range(1, max(ks) + 1):
            if k > 1:
                here = centers

                def costs(x: np.ndarray) -> np.ndarray:
                    return np.minimum(_nearest(_gaps(x, here))[1], _gaps(x, candidates).T).sum(axis=1)

                best = int(_summed(rows, width, len(candidates), costs).argmin())
                centers, cost = _settled(rows, np.vstack([centers, candidates[best]]), move, max_steps)
            if k in ks:
                found[k] = (centers, cost)
    return found


def elbow(vectors: DataFrame, key: str, ks: Sequence[int] = ELBOW_RANGE) -> DataFrame:
    """Within-cluster squared distance for each k."""
    rows = [(k, cost) for k, (_, cost) in fit_kmeans(vectors, key, ks).items()]
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double")


def _labelled(vectors: DataFrame, label: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    @F.pandas_udf("int")
    def cluster(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=np.float64)
        return pd.Series(np.concatenate([label(rows[at:at + ROWS_AT_ONCE]) for at in range(0, len(rows), ROWS_AT_ONCE)]) if len(rows) else np.zeros(0, int))

    return vectors.withColumn("cluster", cluster(vector_to_array("features")))


def kmeans_labels(vectors: DataFrame, key: str, k: int = CLUSTERS) -> DataFrame:
    """The rows with the nearest centre's number, the first of equally near ones."""
    fitted = fit_kmeans(vectors, key, [k])
    centers = fitted[k][0] if fitted else None
    return _labelled(vectors, lambda x: _gaps(x, centers).argmin(axis=1))


@dataclass
class Mixture:
    """Shares, means and covariances of Gaussian components."""

    shares: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of share times density, by row and component."""
        out = np.empty((len(x), len(self.shares)))
        for g, (share, mean, cov) in enumerate(zip(self.shares, self.means, self.covariances)):
            root = np.linalg.cholesky(cov)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, g] = np.log(share) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def weights(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of each component in each row, log-likelihood of each row)."""
        logs = self.densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - total[:, None]), total


def _maximised(rows: DataFrame, k: int, about: np.ndarray, weigh: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[Mixture, float]:
    """(mixture that fits the rows' weights best, mean log-likelihood of the one they come from). Sums are taken about ``about``."""
    width = about.shape[1]

    def partial(x: np.ndarray) -> np.ndarray:
        w, logs = weigh(x)
        parts = [w.sum(axis=0)]
        for g in range(k):
            gap = x - about[g]
            parts += [w[:, g] @ gap, ((gap * w[:, g:g + 1]).T @ gap).ravel()]
        return np.concatenate([*parts, [logs.sum(), len(x)]])

    found = _summed(rows, width, k * (1 + width + width * width) + 2, partial)
    n, logs, size = found[:k], found[-2], found[-1]
    first = found[k:-2].reshape(k, width + width * width)
    shift = first[:, :width] / n[:, None]
    spread = first[:, width:].reshape(k, width, width) / n[:, None, None] - shift[:, :, None] * shift[:, None, :]
    return Mixture(n / size, about + shift, spread + RIDGE * np.eye(width)), float(logs / size)


def fit_mixture(vectors: DataFrame, key: str, k: int = CLUSTERS, max_steps: int = MAX_STEPS) -> Mixture | None:
    """Gaussian mixture by expectation and maximisation, from the clusters of k-means; None without rows."""
    fitted = fit_kmeans(vectors, key, [k])
    if not fitted:
        return None
    centers = fitted[k][0]
    with kept(_packed(vectors, centers.shape[1])) as rows:
        model, _ = _maximised(rows, k, centers, lambda x: ((_gaps(x, centers).argmin(axis=1)[:, None] == np.arange(k)).astype(np.float64), np.zeros(len(x))))
        before = -np.inf
        for _ in range(max_steps):
            after, logs = _maximised(rows, k, model.means, model.weights)
            if abs(logs - before) < GAIN:
                return model
            model, before = after, logs
    raise RuntimeError(f"the mixture still changes after {max_steps} steps")


def mixture_labels(vectors: DataFrame, key: str, k: int = CLUSTERS) -> DataFrame:
    """The rows with their likeliest component of a Gaussian mixture."""
    model = fit_mixture(vectors, key, k)
    return _labelled(vectors, lambda x: model.densities(x).argmax(axis=1))


def logistic_accuracy(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Training accuracy of a logistic regression, or NULL with a note unless the target is binary.

    The penalty is half the squared weights against the summed loss, hence ``regParam = 1/n``.
    """
    classes = [r[target] for r in df.filter(F.col(target).isNotNull()).select(target).distinct().limit(3).collect()]
    empty = "accuracy double, note string"
    if len(classes) != 2:
        return df.sparkSession.createDataFrame([(None, "No aplica")], empty)
    low = min(classes)
    label = F.when(F.col(target) == low, 0.0).when(F.col(target).isNotNull(), 1.0)
    data = assemble(df.select(*features, label.alias("label")).na.drop(), features).select("features", "label")
    with kept(data) as held:
        fit = LogisticRegression(regParam=1.0 / held.count(), elasticNetParam=0.0, standardization=False, maxIter=100)
        score = accuracy(fit.fit(held).transform(held), "label", "prediction").first()["accuracy"]
    return df.sparkSession.createDataFrame([(score, "")], empty)


def _scatter(df: DataFrame, x: Column, center: np.ndarray) -> np.ndarray:
    """Sums of the products of centred features: one small matrix per task, added up by Spark."""
    p = len(center)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            gap = np.array(batch["x"].tolist(), dtype=np.float64).reshape(len(batch), p) - center
            total += gap.T @ gap
        yield pd.DataFrame({"at": np.arange(p * p), "s": total.ravel()})

    sums = df.select(x.alias("x")).mapInPandas(partial, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    out = np.zeros(p * p)
    for r in sums.collect():
        out[r["at"]] = r["s"]
    return out.reshape(p, p)


@dataclass
class Classes:
    """Some classes of a discriminant: a row of weights and an offset for each."""

    names: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest score, class) of each row, the first of equal ones."""
        step = max(1, SCORES_AT_ONCE // len(self.names))
        score, name = np.empty(len(x)), np.empty(len(x), dtype=object)
        for at in range(0, len(x), step):
            found = x[at:at + step] @ self.weights + self.offsets
            top = found.argmax(axis=1)
            score[at:at + step], name[at:at + step] = found[np.arange(len(top)), top], self.names[top]
        return score, name


def fit_discriminant(df: DataFrame, features: Sequence[str], target: str) -> Iterator[Classes]:
    """Linear discriminant classifier: class means, pooled covariance, class priors; in blocks of classes.

    The classes are a written table, of which ``CLASSES_AT_ONCE`` come to the driver at a time; else
    only numbers by pair of features do. Rows with a missing feature or class take no part in the fit.
    """
    p = len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    whole = df.filter(F.col(target).isNotNull() & ~F.exists(x, lambda v: v.isNull())).select(F.col(target).alias("cls"), x.alias("x"))
    table, path = written(
        whole.groupBy("cls").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(p)]).alias("mean")), "classes")
    total = table.agg(F.count("*").alias("k"), F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col("mean")[i]) / F.sum("n")).alias(f"m{i}") for i in range(p)]).first()
    if total["k"]:
        center = np.array([total[f"m{i}"] for i in range(p)])
        between = _scatter(table, F.transform("mean", lambda m, i: (m - F.element_at(F.lit(center.tolist()), i + 1)) * F.sqrt("n")), np.zeros(p))
        pooled = (_scatter(whole, F.col("x"), center) - between) / max(1.0, total["n"] - total["k"])
        inverse = np.linalg.pinv(pooled, hermitian=True)
        blocks = -(-total["k"] // CLASSES_AT_ONCE)
        for block in range(blocks):
            rows = table.filter(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == block).orderBy("cls").collect()
            if rows:
                means = np.array([r["mean"] for r in rows], dtype=np.float64).reshape(len(rows), p)
                weights = inverse @ means.T
                priors = np.log(np.array([r["n"] for r in rows], dtype=np.float64) / total["n"])
                yield Classes(np.array([r["cls"] for r in rows] + [None], dtype=object)[:-1], weights, priors - 0.5 * (means.T * weights).sum(axis=0))
    remove(df.sparkSession, path)


def _better(classes: Classes, width: int) -> Callable[[pd.Series, pd.DataFrame], pd.DataFrame]:
    """Replaces a row's best class so far where one of ``classes`` scores higher, or as high and is smaller."""

    def better(vectors: pd.Series, best: pd.DataFrame) -> pd.DataFrame:
        values = np.array([[np.nan] * width if v is None else v for v in vectors], dtype=np.float64).reshape(len(vectors), width)
        whole = ~np.isnan(values).any(axis=1)
        score, name = best["score"].to_numpy(np.float64, na_value=np.nan).copy(), best["cls"].to_numpy(dtype=object).copy()
        found, cls = classes.best(values[whole])
        old, old_name = score[whole], name[whole]
        wins = np.isnan(old) | (found > old)
        for i in np.flatnonzero(found == old):
            wins[i] = cls[i] < old_name[i]
        score[whole], name[whole] = np.where(wins, found, old), np.where(wins, cls, old_name)
        name[~whole] = None
        return pd.DataFrame({"score": score, "cls": pd.Series(name, dtype=object)})

    return better


def discriminant_predict(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``df`` with the class of the greatest score as ``prediction``; a missing feature gives NULL.

    Beyond the first block of classes, the rows are written with the best so far, and meet the next block.
    """
    p, kind = len(features), df.schema[target].dataType
    held = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("cls", kind)])
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.drop("prediction").withColumn("__best", F.lit(None).cast(held))
    last = None
    for k, classes in enumerate(fit_discriminant(df, features, target)):
        if k:
            rows, path = written(rows, "classified")
            if last:
                remove(df.sparkSession, last)
            last = path
        rows = rows.withColumn("__best", F.pandas_udf(_better(classes, p), held)(x, F.col("__best")))
    return rows.withColumn("prediction", F.col("__best")["cls"]).drop("__best")


def confusion(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows per (actual, predicted) pair."""
    return predicted.groupBy(label, prediction).agg(F.count("*").alias("n"))
