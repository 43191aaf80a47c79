"""A small classifier of candidates: models, repeated stratified folds, report, importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sampling import folds
from tidewatch.runtime import materialise


ROWS_A_PARTITION = 50_000
#: Models that are fitted at a time.
FITS = 4


def matrix(rows: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count 0."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def model(kind: str, features: list[str], n: int, label: str = "label", seed: int = 42) -> Pipeline:
    assemble = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep")
    if kind == "logreg":
        return Pipeline(stages=[assemble, StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol=label, regParam=1 / (0.1 * max(n, 1)))])
    if kind == "gboost":
        return Pipeline(stages=[assemble, GBTClassifier(featuresCol="x", labelCol=label, maxIter=150, maxDepth=2, stepSize=0.05, seed=seed)])
    if kind == "forest":
        return Pipeline(stages=[assemble, RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=400, minInstancesPerNode=2, seed=seed)])
    raise ValueError(kind)


def predict(kind: str, train: DataFrame, test: DataFrame, features: list[str], key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """(key, label, p) of test."""
    n = train.count()
    rows = matrix(train, features).select(*features, label).coalesce(max(1, n // ROWS_A_PARTITION)).cache()  # boosting runs hundreds of small jobs over it
    fitted = model(kind, features, n, label, seed).fit(rows)
    rows.unpersist()
    return fitted.transform(matrix(test, features)).select(key, label, vector_to_array("probability")[1].alias("p"))


def cross_validate(rows: DataFrame, kind: str, features: list[str], key: str, label: str = "label", k: int = 5, repeats: int = 20, seed: int = 0) -> DataFrame:
    """(repeat, key, label, p): every row predicted once a repeat by a model that hasn't seen it.

    Fits don't depend on each other, so FITS of them are under way at a time; the folds of a repeat are written once."""

    def fold(job: tuple[DataFrame, int, int]) -> DataFrame:
        split, r, i = job
        return predict(kind, split.where(F.col("fold") != i), split.where(F.col("fold") == i), features, key, label, seed + r).withColumn("repeat", F.lit(r))

    splits = [materialise(folds(rows.select(key, label, *features), key, label, k, seed + r), "folds") for r in range(repeats)]
    with ThreadPoolExecutor(FITS) as pool:
        parts = list(pool.map(fold, [(split, r, i) for r, split in enumerate(splits) for i in range(k)]))
    return reduce(DataFrame.unionByName, parts)


def vote(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean of two models' probabilities."""
    return a.join(b.select("repeat", key, F.col("p").alias("q")), ["repeat", key]).withColumn("p", (F.col("p") + F.col("q")) / 2).drop("q")


def report(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row: accuracy over the repeats (mean, deviation, least, most), precision, recall, F1."""
    hit = ((F.col("p") >= 0.5) == (F.col(label) == 1)).cast("double")
    tp, fp, fn = (F.sum(((F.col("p") >= 0.5) == F.lit(a)).cast("long") * (F.col(label) == b).cast("long")) for a, b in ((True, 1), (True, 0), (False, 1)))
    per = predictions.groupBy("repeat").agg(F.avg(hit).alias("acc"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    per = per.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    return per.agg(
        F.round(F.avg("acc"), 4).alias("accuracy"), F.round(F.coalesce(F.stddev_samp("acc"), F.lit(0.0)), 4).alias("deviation"), F.round(F.min("acc"), 4).alias("least"), F.round(F.max("acc"), 4).alias("most"),
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg(F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)), 4).alias("f1"),
    )


def confusion(predictions: DataFrame, label: str = "label") -> DataFrame:
    """(label, predicted, n), all four cells."""
    said = predictions.select(F.col(label).cast("int").alias("label"), (F.col("p") >= 0.5).cast("int").alias("predicted"))
    cells = predictions.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "label int, predicted int")
    return cells.join(said.groupBy("label", "predicted").agg(F.count("*").alias("n")), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def errors(predictions: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, label, p) of the rows that are told wrong, the surest mistakes first."""
    wrong = predictions.where((F.col("p") >= 0.5) != (F.col(label) == 1))
    return wrong.select(key, label, "p").orderBy(F.desc(F.abs(F.col("p") - 0.5)), key)


def importance(rows: DataFrame, kind: str, features: list[str], label: str = "label") -> list[tuple[str, float]]:
    """Signed coefficients or impurity, largest first."""
    fitted = model(kind, features, rows.count(), label).fit(matrix(rows, features)).stages[-1]
    weights = fitted.coefficients if kind == "logreg" else fitted.featureImportances
    return sorted(zip(features, (float(w) for w in weights.toArray())), key=lambda x: (-abs(x[1]), x[0]))


def ablation(rows: DataFrame, kind: str, features: list[str], key: str, label: str = "label", repeats: int = 5) -> list[tuple[str, float]]:
    """Accuracy lost by leaving a feature out."""
    full = report(cross_validate(rows, kind, features, key, label, repeats=repeats), label).first().accuracy
    return [(f, full - report(cross_validate(rows, kind, [g for g in features if g != f], key, label, repeats=repeats), label).first().accuracy) for f in features]


def choose(reports: DataFrame, order: list[str], enough: float = 0.8, least: float = 0.75) -> DataFrame:
    """The simplest model (by order) whose accuracy is enough, else the best that has the least asked for; no row if there is none."""
    simple = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    ranked = reports.where(F.col("accuracy") >= least).withColumn("__a", F.col("accuracy") < enough).withColumn("__b", F.when(F.col("accuracy") >= enough, simple.cast("double")).otherwise(-F.col("accuracy")))
    return ranked.orderBy("__a", "__b", "model").limit(1).drop("__a", "__b")
