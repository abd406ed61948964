"""Models by pyspark.ml: components, clusters, regressions in walk-forward folds."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .supervised import split_of


def _vectors(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    return df.select(id_col, array_to_vector(F.col(array_col).cast("array<double>")).alias("raw"))


def principal_components(df: DataFrame, id_col: str, array_col: str, k: int) -> DataFrame:
    """(id, pc1 .. pck) of centred vectors; each component's largest loading is positive."""
    rows = _vectors(df, id_col, array_col)
    rows = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(rows)
    loading = model.pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loading.T]
    out = model.transform(rows).withColumn("a", vector_to_array("pc"))
    return out.select(id_col, *[(F.col("a")[i] * s).alias(f"pc{i + 1}") for i, s in enumerate(signs)])


def explained(df: DataFrame, id_col: str, array_col: str, k: int, target: float = 0.9) -> tuple[list[float], int | None]:
    """Cumulated share of variance of k components, and the first number of them that reaches ``target``."""
    rows = _vectors(df, id_col, array_col)
    rows = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=False).fit(rows).transform(rows)
    total, out = 0.0, []
    for v in PCA(k=k, inputCol="z", outputCol="pc").fit(rows).explainedVariance.toArray():
        total += float(v)
        out.append(total)
    return out, next((i + 1 for i, v in enumerate(out) if v >= target), None)


def loadings(df: DataFrame, id_col: str, array_col: str, k: int) -> list[list[float]]:
    """The k leading directions of centred vectors, one list each."""
    rows = _vectors(df, id_col, array_col)
    rows = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=False).fit(rows).transform(rows)
    return [list(map(float, c)) for c in PCA(k=k, inputCol="z", outputCol="pc").fit(rows).pc.toArray().T]


def component_stability(df: DataFrame, id_col: str, array_col: str, time: str, ends: list, k: int, least: float = 0.6) -> list[tuple]:
    """(end, component, similarity, stable): absolute cosine of each component fitted up to an end with the one fitted up to the last end.

    A model is fitted for each end, as many as there are folds; what comes back are directions, not rows.
    """
    df = df.cache()  # read once for each end
    found = [(e, loadings(df.where(F.col(time) <= F.lit(e)), id_col, array_col, k)) for e in ends]
    df.unpersist()
    last = found[-1][1]
    out = []
    for e, directions in found:
        for i, (a, b) in enumerate(zip(directions, last, strict=True)):
            same = abs(sum(x * y for x, y in zip(a, b, strict=True)))
            out.append((e, i + 1, min(1.0, same), same >= least))
    return out


def clusters(df: DataFrame, id_col: str, array_col: str, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means."""
    rows = _vectors(df, id_col, array_col)
    return KMeans(k=k, seed=seed, featuresCol="raw", predictionCol="cluster").fit(rows).transform(rows).select(id_col, "cluster")


def walk_forward_ridge(df: DataFrame, features: list[str], target: str, time: str, key: str, folds: list[dict], strength: float = 0.1) -> DataFrame:
    """(fold, key, time, y, p): predictions of each fold's test rows by a ridge regression fitted on its training rows."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.select(key, time, F.col(target).cast("double").alias("y"), *features))
    out = None
    for f in folds:
        marked = rows.withColumn("_split", split_of(time, f))
        model = LinearRegression(featuresCol="features", labelCol="y", predictionCol="p", regParam=strength).fit(marked.where("_split = 'train'"))
        part = model.transform(marked.where("_split = 'test'")).select(F.lit(f["fold"]).alias("fold"), key, time, "y", "p")
        out = part if out is None else out.unionByName(part)
    return out
