"""Survival classifiers: preparation, grid search by stratified folds, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cohort import confusion_report, roc_auc
from tidemark.session import written

# A linear fit reads its rows some hundred times, each time in a job of its own: a task has to
# hold this many rows to take longer than its start and the merging of its sums.
LINEAR_ROWS = 1 << 17


def feature_stages(columns: Sequence[str], scaled: bool = False) -> list:
    """Stages that turn number columns into ``features``, centered and scaled on demand."""
    if not scaled:
        return [VectorAssembler(inputCols=list(columns), outputCol="features")]
    return [VectorAssembler(inputCols=list(columns), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features",
                           withMean=True, withStd=True)]


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its mean, over its sample deviation; missing values as 0 before."""
    filled = df.na.fill(0, subset=list(columns))
    scaled = Pipeline(stages=feature_stages(columns, scaled=True)).fit(filled).transform(filled)
    values = vector_to_array("features")
    kept = [c for c in df.columns if c not in columns]
    return scaled.select(*kept, *[F.get(values, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def prepared(df: DataFrame, columns: Sequence[str], label: str = "survive",
             keep: Sequence[str] = ("fold",)) -> DataFrame:
    """Numbers only, missing ones as 0, with a double ``label``."""
    return df.select(*keep, F.col(label).cast("double").alias("label"), *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def svm_grid(rows: int, costs: Sequence[float] = (0.01, 0.1, 1, 5, 10)):
    """Linear SVM over a grid of error costs; a cost C is a penalty of 1 / (C rows)."""
    model = LinearSVC(labelCol="label", tol=1e-4)
    penalties = [1.0 / (c * max(rows, 1)) for c in costs]
    return model, ParamGridBuilder().addGrid(model.regParam, penalties).build()


def logistic_grid(rows: int, costs: Sequence[float] = (0.1, 1, 5, 100)):
    """Logistic regression over a grid of error costs."""
    model = LogisticRegression(labelCol="label", standardization=False, tol=1e-4)
    penalties = [1.0 / (c * max(rows, 1)) for c in costs]
    return model, ParamGridBuilder().addGrid(model.regParam, penalties).build()


def forest_grid(trees: Sequence[int] = (40,), seed: int = 0):
    """Random forest that tries log2 of the features at each split; trees grow as deep as
    Spark lets them, until their leaves are pure."""
    # Deep trees: rows remember their node, so that no level sends the trees to all tasks.
    model = RandomForestClassifier(labelCol="label", featureSubsetStrategy="log2", seed=seed,
                                   maxDepth=30, maxBins=128, cacheNodeIds=True)
    return model, ParamGridBuilder().addGrid(model.numTrees, list(trees)).build()


def boosting_grid(trees: Sequence[int] = (150, 250), depths: Sequence[int] = (4, 5, 6),
                  rates: Sequence[float] = (0.01,), seed: int = 0):
    """Gradient-boosted trees that try log2 of the features at each split."""
    model = GBTClassifier(labelCol="label", featureSubsetStrategy="log2", seed=seed)
    grid = (ParamGridBuilder().addGrid(model.maxIter, list(trees))
            .addGrid(model.maxDepth, list(depths)).addGrid(model.stepSize, list(rates)).build())
    return model, grid


def in_few_parts(df: DataFrame, rows: int = LINEAR_ROWS) -> DataFrame:
    """The same rows in partitions of some ``rows`` each, merged where they are."""
    return df.coalesce(max(-(-df.count() // rows), 1))


def grid_search(df: DataFrame, columns: Sequence[str], model: Estimator, grid: Sequence[Mapping],
                folds: int = 2, scaled: bool = False, parallelism: int = 4) -> CrossValidatorModel:
    """Fits the best of a grid by area under the ROC curve over the given folds.

    Linear models, whose fits are many short jobs, are fitted to few partitions and all
    settings of a fold at once.
    """
    if isinstance(model, (LinearSVC, LogisticRegression)):
        df, parallelism = in_few_parts(df), max(parallelism, len(grid))
    search = CrossValidator(
        estimator=Pipeline(stages=[*feature_stages(columns, scaled), model]),
        estimatorParamMaps=list(grid), numFolds=folds, foldCol="fold", parallelism=parallelism,
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"))
    return search.fit(df)


def best_model(df: DataFrame, columns: Sequence[str], model: Estimator, grid: Sequence[Mapping],
               folds: int = 2, scaled: bool = False) -> PipelineModel:
    """The winner of a grid, fitted to all rows; a grid of one setting needs no folds to tell it."""
    if len(grid) == 1:
        return fitted(df, columns, model.copy(grid[0]), scaled)
    return grid_search(df, columns, model, grid, folds, scaled).bestModel


def fitted(df: DataFrame, columns: Sequence[str], model: Estimator, scaled: bool = False) -> PipelineModel:
    """One model with its preparation, fitted to all rows."""
    return Pipeline(stages=[*feature_stages(columns, scaled), model]).fit(df)


def logistic_conditions(df: DataFrame, columns: Sequence[str], model: PipelineModel) -> DataFrame:
    """What a ridge logistic fit has to reproduce: (feature, moment).

    Where the gradient is zero, mean of P(class 1) times a feature, plus the penalty times its
    coefficient, equals the mean of the label times that feature. The row without feature is
    the intercept's: the mean of P(class 1).
    """
    last = model.stages[-1]
    chance, values = F.get(vector_to_array("probability"), F.lit(1)), vector_to_array("features")
    penalty = last.getOrDefault("regParam")
    sums = [(c, F.avg(chance * F.get(values, F.lit(i))) + float(penalty * b))
            for i, (c, b) in enumerate(zip(columns, last.coefficients, strict=True))]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), m.alias("moment"))
                     for c, m in [("", F.avg(chance)), *sums]])
    return model.transform(df).agg(rows.alias("rows")).select(F.inline("rows"))


def grid_scores(df: DataFrame, search: CrossValidatorModel) -> DataFrame:
    """One row per grid point: its parameters, mean score, half deviation, and whether it won.

    The grid is a handful of settings, so these rows are made on the driver.
    """
    rows = []
    best = max(search.avgMetrics)
    for number, setting in enumerate(search.getEstimatorParamMaps()):
        text = ", ".join(sorted(f"{p.name}={v:g}" for p, v in setting.items()))
        mean = float(search.avgMetrics[number])
        deviation = float(search.stdMetrics[number]) if search.stdMetrics else None
        rows.append((number, text, mean, None if deviation is None else deviation / 2.0,
                     bool(mean == best)))
    return df.sparkSession.createDataFrame(
        rows, "number INT, parameters STRING, mean_auc DOUBLE, half_deviation DOUBLE, best BOOLEAN")


def scored(model, df: DataFrame) -> DataFrame:
    """Predictions with one ``score`` column: the margin, or else P(class 1)."""
    predictions = model.transform(df)
    source = "rawPrediction" if "rawPrediction" in predictions.columns else "probability"
    return predictions.withColumn("score", F.get(vector_to_array(source), F.lit(1)))


def nested_report(df: DataFrame, columns: Sequence[str], model: Estimator, grid, folds: int = 2,
                  scaled: bool = False, refold=None) -> DataFrame:
    """Scored predictions of each fold by the grid winner of the other folds.

    ``refold`` deals the training rows into inner folds. The result goes into
    ``confusion_report`` and ``roc_auc``.
    """
    parts = None
    for fold in range(folds):
        train = df.where(F.col("fold") != fold)
        train = refold(train.drop("fold")) if refold else train
        search = grid_search(train, columns, model, grid, folds, scaled)
        part = scored(search.bestModel, df.where(F.col("fold") == fold)).select(
            "fold", "label", "prediction", "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def roc_by_fold(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve of each fold, with their mean and population deviation."""
    areas = written(roc_auc(predictions, "label", "score", ["fold"]), "areas")
    overall = areas.agg(F.avg("roc_auc"), F.stddev_pop("roc_auc")).first()
    return areas.select("fold", "positives", "negatives", "roc_auc",
                        F.lit(overall[0]).cast("double").alias("mean_auc"),
                        F.lit(overall[1]).cast("double").alias("auc_deviation"))


def holdout_report(model, test: DataFrame) -> DataFrame:
    """Area under the ROC curve and F1 of class 1 on held-out rows."""
    predictions = scored(model, test).select(F.lit(0).alias("fold"), "label", "prediction", "score")
    f_score = confusion_report(predictions).where(F.col("class") == 1).agg(
        F.max("f_score").alias("f1"))
    return roc_auc(predictions, "label", "score").select(
        "positives", "negatives", "roc_auc", f_score.scalar().alias("f1"))


def feature_importances(df: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Importance of each feature, the largest set to 100."""
    importances = model.stages[-1].featureImportances.toArray()
    top = importances.max() or 1.0
    rows = [(c, float(100.0 * v / top)) for c, v in zip(columns, importances)]
    return df.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE")


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 2):
    """Centered projection on the first k components, and their explained variance."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="features",
                             withMean=True, withStd=False),
              PCA(k=k, inputCol="features", outputCol="components")]
    model = Pipeline(stages=stages).fit(df)
    parts = vector_to_array("components")
    projected = model.transform(df).select("*", *[
        F.get(parts, F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])
    variance = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    return projected.drop("raw_features", "features", "components"), variance


def k_means(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """Adds the number of the nearest of k centers."""
    model = Pipeline(stages=[*feature_stages(columns, scaled=True),
                             KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(df)
    return model.transform(df).drop("raw_features", "features")


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a fitted model; its assembler stage holds the feature names."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Reads a model back."""
    return PipelineModel.load(path)
