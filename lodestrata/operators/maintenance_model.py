"""The failure-risk model: split, scaling, forest, folds and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42
BLOCK_BITS = 12


def placed(rows: DataFrame, label: str, key: list[str], seed: int) -> DataFrame:
    """``rows`` with ``_rank`` and ``_row``, from 0, in the order of a hash of the key within each label,
    and ``_all``, the label's rows.

    The leading bits of the hash cut a label into ``2**BLOCK_BITS`` blocks of like size, each of which is
    put in order by itself and starts after those before, so no task holds a label.
    """
    cut = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_block", F.shiftright("_h", 64 - BLOCK_BITS))
    sizes = cut.groupBy(label, "_block").agg(F.count("*").alias("_n"))
    blocks = Window.partitionBy(label)
    before = F.sum("_n").over(blocks.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(label).alias("_label"), F.col("_block").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(blocks).alias("_all"))
    within = Window.partitionBy(label, "_block").orderBy("_h", *key)
    ranked = cut.withColumns({"_rank": F.rank().over(within) - 1, "_row": F.row_number().over(within) - 1})
    joined = ranked.join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_block") == F.col("_of")))
    return joined.withColumns({"_rank": F.col("_rank") + F.col("_before"), "_row": F.col("_row") + F.col("_before")}).drop("_h", "_block", "_label", "_of", "_before")


def stratified_split(rows: DataFrame, label: str, key: list[str], train: float = 0.8, seed: int = SEED) -> DataFrame:
    """``is_train`` for the same share of each label, by the order of a hash of the key."""
    share = F.coalesce(F.try_divide(F.col("_rank"), F.col("_all") - 1), F.lit(0.0))
    return placed(rows, label, key, seed).withColumn("is_train", share < train).drop("_rank", "_row", "_all")


def folds(rows: DataFrame, label: str, key: list[str], n: int = 5, seed: int = SEED) -> DataFrame:
    return placed(rows, label, key, seed).withColumn("fold", ((F.col("_row") + 1) % n).cast("int")).drop("_rank", "_row", "_all")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: rows over classes times the class's rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(total).select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(weights, label)


def pipeline(features: list[str], label: str, trees: int = 100, depth: int = 12) -> Pipeline:
    """Scaling is fitted with the forest, on the rows that train it."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            RandomForestClassifier(featuresCol="_scaled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED),
        ]
    )


def train(rows: DataFrame, features: list[str], label: str, **options):
    return pipeline(features, label, **options).fit(balanced(rows, label))


def cross_validated(rows: DataFrame, features: list[str], label: str, key: list[str], n: int = 5, **options) -> tuple[float, float]:
    """Mean and deviation of the accuracy over n stratified folds; each fold's model, its scaling
    included, is fitted on the others."""
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    search = CrossValidator(estimator=pipeline(features, label, **options), estimatorParamMaps=[{}], evaluator=scorer, numFolds=n, foldCol="fold")
    found = search.fit(folds(balanced(rows, label), label, key, n))
    return found.avgMetrics[0], found.stdMetrics[0]


def probabilities(model, rows: DataFrame, classes: int) -> DataFrame:
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return out.withColumns({f"p_{k}": F.col("_p")[k] for k in range(classes)}).drop("_raw", "_scaled", "rawPrediction", "probability", "_p")


def confusion(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, and F1 averaged over the labels without weights."""
    own = F.col("label") == F.col("predicted")
    by_label = matrix.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("hits"))
    by_guess = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    f1 = F.coalesce(2 * F.col("hits") / (F.col("support") + F.coalesce("guessed", F.lit(0))), F.lit(0.0))
    return by_label.join(by_guess, "label", "left").agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("f1_macro"))


def forecast(history: DataFrame, key: str, z: float = 1.96) -> DataFrame:
    """The mean of each key's history and a band of z deviations around it."""
    return history.groupBy(key).agg(F.avg("quantity").alias("mean"), F.coalesce(F.stddev_samp("quantity"), F.lit(0.0)).alias("std")).select(
        key, F.round("mean", 6).alias("forecast"), F.round(F.greatest(F.col("mean") - z * F.col("std"), F.lit(0.0)), 6).alias("low"), F.round(F.col("mean") + z * F.col("std"), 6).alias("high")
    )
