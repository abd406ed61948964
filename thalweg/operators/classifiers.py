"""Classifiers: a Gaussian Bayes model from sums, and those of pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_bayes(train: DataFrame, test: DataFrame, keys: list[str], label: str, features: list[str], floor: float = 1e-3) -> DataFrame:
    """(keys, label, predicted) of the test rows: the class of highest posterior, features independent and normal in each class.

    A class is one row of sums; every test row meets every class, of which there are few.
    """
    model = train.groupBy(F.col(label).alias("_p")).agg(F.count("*").alias("_n"), *[e for f in features for e in (F.avg(f).alias(f"_m_{f}"), (F.var_pop(f) + floor).alias(f"_v_{f}"))])
    score = F.log("_n")
    for f in features:
        score = score - (F.log(f"_v_{f}") + (F.col(f) - F.col(f"_m_{f}")) ** 2 / F.col(f"_v_{f}")) * 0.5
    rows = test.crossJoin(F.broadcast(model)).withColumn("_s", F.round(score, 9))
    return rows.groupBy(*keys, label).agg(F.max_by("_p", F.struct("_s", "_p")).alias("predicted"))


def classify(train: DataFrame, test: DataFrame, keys: list[str], label: str, features: list[str], model: str = "logistic", seed: int = 42) -> DataFrame:
    """(keys, label, p) of the test rows: probability of a 0 / 1 label by logistic regression, a random forest or boosted trees."""
    kinds = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}
    options = {"featuresCol": "_features", "labelCol": "_y"} | ({"seed": seed} if model != "logistic" else {"regParam": 0.01}) | ({"maxIter": 20} if model == "boosted" else {})
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    rows = lambda df: assembler.transform(df.withColumn("_y", F.col(label).cast("double")))
    fitted = kinds[model](**options).fit(rows(train))
    return fitted.transform(rows(test)).select(*keys, label, vector_to_array("probability")[1].alias("p"))
