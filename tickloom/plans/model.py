"""Random-forest model of price direction."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.operators.rows import require_rows
from tickloom.operators.slices import running_total
from tickloom.plans.features import FEATURES, LABEL
from tickloom.session import materialise

# The model's parameters. The seed makes a run repeatable.
TREES = 20
DEPTH = 5
SEED = 42
TRAIN_SHARE = 0.8


def assemble(features: DataFrame) -> DataFrame:
    """Add the vector column; rows with NULL or NaN in it are skipped."""
    assembler = VectorAssembler(
        inputCols=list(FEATURES), outputCol="features", handleInvalid="skip"
    )
    return assembler.transform(features)


def _at(features: DataFrame) -> Column:
    """Second of a row in the order of time, days included."""
    second = F.col("timestamp_sec")
    return F.datediff("trade_date", F.lit("1970-01-01")) * F.lit(86_400) + second if (
        "trade_date" in features.columns
    ) else second


def split_time(features: DataFrame, share: float = TRAIN_SHARE) -> int:
    """The second up to which rows are for training: the first that holds `share` of them.

    Rows are counted per second and the counts summed up in time slices, so only
    the answer reaches the driver.
    """
    counts = features.groupBy(_at(features).cast("bigint").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    summed = running_total(counts, [], "at", F.col("n"), 3_600, "upto")
    return summed.filter(F.col("upto") >= math.ceil(share * total)).agg(F.min("at")).first()[0]


def chrono_split(
    features: DataFrame, share: float = TRAIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    """Earlier rows to train on, later rows to test on."""
    cut, at = split_time(features, share), _at(features)
    return features.filter(at <= cut), features.filter(at > cut)


def train_direction_model(
    train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED
) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed
    )
    return forest.fit(train)


def score(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows per (label, prediction)."""
    return predictions.groupBy(F.col(LABEL).alias("label"), "prediction").agg(
        F.count(F.lit(1)).alias("n")
    )


def evaluate(confused: list[Row]) -> dict[str, float]:
    """Accuracy and weighted precision from the rows of a confusion table.

    A class that is never predicted has a precision of 0; without rows both are 0.
    """
    total = sum(r["n"] for r in confused)
    of_label, of_prediction, right = Counter(), Counter(), Counter()
    for r in confused:
        of_label[r["label"]] += r["n"]
        of_prediction[r["prediction"]] += r["n"]
        right[r["label"]] += r["n"] * (r["label"] == r["prediction"])
    weighted = sum(of_label[c] * right[c] / of_prediction[c] for c in of_label if of_prediction[c])
    return {
        "accuracy": sum(right.values()) / total if total else 0.0,
        "weightedPrecision": weighted / total if total else 0.0,
    }


@dataclass
class Outcome:
    model: RandomForestClassificationModel
    predictions: DataFrame
    confusion: DataFrame
    metrics: dict[str, float]


def fit_and_evaluate(features: DataFrame) -> Outcome:
    """Write the features once, then split, train, score and evaluate from the table.

    The test rows are scored once, for the confusion table: one row per pair of classes.
    """
    table = require_rows(materialise(features, "features"), "complete feature rows")
    train, test = chrono_split(assemble(table))
    model = train_direction_model(train)
    predictions = score(model, test)
    counted = confusion(predictions)
    rows = counted.collect()
    return Outcome(model, predictions, features.sparkSession.createDataFrame(rows, counted.schema), evaluate(rows))
