"""Linear regression over daily features: split, fit, extrapolate, score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.functions.numeric import arithmetic_hash

# Fixed value: share of rows used for training, in percent.
TRAIN_PERCENT = 80


def in_training(key: Column, percent: int = TRAIN_PERCENT) -> Column:
    """Stable membership of the training set: depends on the key alone, not on partitioning."""
    return arithmetic_hash(key, 100) < percent


def with_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def fit_linear(train: DataFrame, features: Sequence[str], target: str) -> LinearRegressionModel:
    """Ordinary least squares with intercept.

    The normal-equation solver makes one distributed pass that adds up the small Gram matrix; only that and
    the coefficients reach the driver. Leave the target's own percentage out of the features: it all but
    equals the target.
    """
    data = with_features(train.na.drop("any", subset=[*features, target]), features)
    solver = LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0)
    return solver.fit(data)


def fit_by_series(df: DataFrame, key: str, features: Sequence[str], target: str) -> DataFrame:
    """Ordinary least squares with intercept for every value of ``key`` at once: (key, n, term, coefficient).

    One aggregation adds up means and covariances per series, partially before the shuffle, so a hot series is one row
    per task; they stand in columns, and the equations are solved there by elimination. Rows with a null in any column
    are left out. Features that depend on each other within a series, or a series of too few rows, have no unique
    solution: their coefficients are null. ``features`` are a handful: the plan grows with their number's square.
    """
    width = len(features)
    data = df.na.drop("any", subset=[*features, target]).select(key, *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    columns = [*features, target]
    sums = {f"_m{j}": F.avg(c) for j, c in enumerate(columns)}
    for i, one in enumerate(features):
        sums |= {f"_a{i}_{j}": F.covar_pop(one, columns[j]) for j in range(i, width + 1)}
    solved = data.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    solved = solved.withColumns({f"_v{i}": F.col(f"_a{i}_{i}") for i in range(width)})
    solved = solved.withColumns({f"_a{i}_{j}": F.col(f"_a{j}_{i}") for i in range(width) for j in range(i)})
    for k in range(width):
        # What is left of a feature's variance after the ones before it; next to nothing means that it depends on them.
        pivot = F.when(F.col(f"_a{k}_{k}") > 1e-10 * F.col(f"_v{k}"), F.col(f"_a{k}_{k}"))
        solved = solved.withColumns({f"_a{k}_{j}": F.col(f"_a{k}_{j}") / pivot for j in range(k, width + 1)})
        others = [i for i in range(width) if i != k]
        solved = solved.withColumns({f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.col(f"_a{i}_{k}") * F.col(f"_a{k}_{j}") for i in others for j in range(k + 1, width + 1)})
    answer = [F.col(f"_a{i}_{width}") for i in range(width)]
    intercept = F.col(f"_m{width}")
    for i, coefficient in enumerate(answer):
        intercept = intercept - coefficient * F.col(f"_m{i}")
    known = reduce(and_, [c.isNotNull() for c in answer], F.lit(True))
    terms = [F.struct(F.lit(name).alias("term"), F.when(known, c).alias("coefficient")) for name, c in zip(("intercept", *features), (intercept, *answer), strict=True)]
    return solved.select(key, "n", F.inline(F.array(*terms)))


def coefficient_frame(spark, model: LinearRegressionModel, features: Sequence[str]) -> DataFrame:
    rows = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients))]
    return spark.createDataFrame(rows, "term string, coefficient double")


def score(model: LinearRegressionModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(with_features(df, features)).drop("features")


def holdout_error(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Mean squared error and R2 of scored rows that were kept out of the fit."""
    error = F.col(target) - F.col(prediction)
    mse = F.avg(error * error)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(mse, 2).alias("mse"),
        F.round(1 - F.try_divide(mse, F.var_pop(target)), 6).alias("r2"),
    )


def trend(series: DataFrame) -> DataFrame:
    """Slope, intercept and fit of ``y`` on days since the series began, per series."""
    y, x = F.col("y").cast("double"), F.col("slot").cast("double")
    return series.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(y, x), 6).alias("slope"),
        F.round(F.regr_intercept(y, x), 4).alias("intercept"),
        F.round(F.regr_r2(y, x), 6).alias("r2"),
    )
