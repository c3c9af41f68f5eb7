"""Classifiers, ablation and fusion on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import FEATURE_GROUPS, SEVERITY_LABELS, SEVERITY_NAMES
from adjudica.operators.encode import fit_encoder
from adjudica.operators.features import group_columns
from adjudica.operators.metrics import class_weights, group_modes, summary
from adjudica.operators.selection import drop_least_important, prune_raw
from adjudica.session import cut_lineage

LABEL = "penalty_severity"
PROBABILITIES = tuple(f"proba_{SEVERITY_NAMES[v]}" for v in SEVERITY_LABELS)

# Cumulative ablation steps (id, label, feature groups, selection).
ABLATION = (
    ("A", "V1 baseline", (), False),
    ("B", "+ race/championship", ("race", "championship"), False),
    ("C", "+ history", ("race", "championship", "history"), False),
    ("D", "+ precedent", ("race", "championship", "history", "precedent"), False),
    ("E", "full V2 + selection prune", ("race", "championship", "history", "precedent"), True),
)


def weighted(train: DataFrame, label: str = LABEL, fixed_labels: int | None = None) -> DataFrame:
    """Each row with the weight of its class; the weights, one row per class, go to the rows, which stay where they are."""
    return train.join(F.broadcast(class_weights(train, label, fixed_labels)), label, "left")


def is_feature(name: str) -> bool:
    return name.startswith(("cat__", "num__"))


def fit_tabular(train: DataFrame, features: Sequence[str] | None = None, trees: int = 20,
                depth: int = 4, seed: int = 42) -> PipelineModel:
    """Class-weighted random forest on encoded columns."""
    features = list(features or [c for c in train.columns if is_feature(c)])
    rows = weighted(train.withColumn(LABEL, F.col(LABEL).cast("double")))
    stages = [VectorAssembler(inputCols=features, outputCol="features"),
              RandomForestClassifier(labelCol=LABEL, weightCol="weight", numTrees=trees, maxDepth=depth,
                                     seed=seed, cacheNodeIds=False)]
    return Pipeline(stages=stages).fit(rows)


def fit_text(train: DataFrame, features: int = 1 << 16, iterations: int = 30) -> PipelineModel:
    """Class-weighted multinomial logistic regression on hashed, idf-scaled words."""
    rows = weighted(train.withColumn(LABEL, F.col(LABEL).cast("double")), fixed_labels=len(SEVERITY_LABELS))
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"),
              HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
              IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(labelCol=LABEL, weightCol="weight", family="multinomial",
                                 maxIter=iterations, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame, out: str,
          keep: Sequence[str] = ("row_id", "incident_id", "penalty", "session", LABEL)) -> DataFrame:
    """Predictions with one probability column per class; absent classes get 0."""
    scored = model.transform(rows)
    probability = vector_to_array("probability")
    return scored.select(
        *[c for c in keep if c in rows.columns], F.col("prediction").cast("int").alias(out),
        *[F.coalesce(F.get(probability, F.lit(v)), F.lit(0.0)).alias(name)
          for v, name in zip(SEVERITY_LABELS, PROBABILITIES)])


def importances(model: PipelineModel, like: DataFrame) -> DataFrame:
    """(feature, gain) of a fitted tabular model."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    return like.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, gain double")


def prune_by_importance(train: DataFrame, percentile: float = 20, trees: int = 20,
                        depth: int = 4) -> tuple[list[str], DataFrame]:
    """Preliminary model, then drop the least important encoded features."""
    gains = importances(fit_tabular(train, trees=trees, depth=depth), train)
    dropped = drop_least_important(gains, percentile)
    lost = {r.feature for r in dropped.collect()}
    return [c for c in train.columns if is_feature(c) and c not in lost], dropped


def baselines(train: DataFrame, validation: DataFrame, key: str = "session") -> DataFrame:
    """Validation rows with the majority and per-session predictions."""
    majority = group_modes(train, None, LABEL)
    named = train.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    modes = group_modes(named, key, LABEL).withColumnRenamed("mode", "_mode")
    joined = validation.join(modes, key, "left").withColumn("pred_majority", majority.scalar())
    return joined.withColumn("pred_session_stratified", F.coalesce("_mode", "pred_majority")).drop("_mode")


def argmax(columns: Sequence[Column]) -> Column:
    """Index of the largest value; ties go to the lowest class."""
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def merge_modalities(text: DataFrame, tabular: DataFrame) -> DataFrame:
    """Inner join of two prediction tables on row_id with prefixed probabilities."""
    left = text.select("row_id", LABEL, *[F.col(p).alias(f"nlp_{p}") for p in PROBABILITIES])
    right = tabular.select("row_id", *[F.col(p).alias(f"tab_{p}") for p in PROBABILITIES])
    return left.join(right, "row_id", "inner")


def assert_overlap(merged: DataFrame) -> DataFrame:
    if merged.limit(1).count() == 0:
        raise ValueError("no overlapping row_id between text and tabular predictions")
    return merged


def fuse_mean(merged: DataFrame) -> DataFrame:
    """Late fusion: mean of the two probability vectors."""
    mean = [(F.col(f"nlp_{p}") + F.col(f"tab_{p}")) / 2 for p in PROBABILITIES]
    return merged.withColumns({
        **{f"fused_{p}": m for p, m in zip(PROBABILITIES, mean)},
        "pred_nlp": argmax([F.col(f"nlp_{p}") for p in PROBABILITIES]),
        "pred_tabular": argmax([F.col(f"tab_{p}") for p in PROBABILITIES]),
        "pred_fused": argmax(mean)})


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


def out_of_fold(train: DataFrame, fit: Callable[[DataFrame], PipelineModel], out: str, folds: int = 3, key: str = "row_id") -> DataFrame:
    """Predictions for every training row by a model that has not seen it: one fit per hash fold of the key.

    Rows of one key share a fold, so no copy of a row teaches the model that scores it.
    """
    rows = cut_lineage(train.withColumn("_fold", fold_of(key, folds)))
    parts = []
    for k in range(folds):
        held = rows.where(F.col("_fold") == k)
        parts.append(score(fit(rows.where(F.col("_fold") != k).drop("_fold")), held.drop("_fold"), out))
    return reduce(DataFrame.unionByName, parts)


def cross_fitted_stack(train: DataFrame, validation: DataFrame, fit_left: Callable[[DataFrame], PipelineModel],
                       fit_right: Callable[[DataFrame], PipelineModel], folds: int = 3) -> DataFrame:
    """Validation rows scored by a stack that learned from out-of-fold probabilities of both modalities."""
    inner = merge_modalities(out_of_fold(train, fit_left, "p", folds), out_of_fold(train, fit_right, "p", folds))
    stack = fit_stack(cut_lineage(inner))
    outer = merge_modalities(score(fit_left(train), validation, "p"), score(fit_right(train), validation, "p"))
    return score(stack, outer, "pred_stacked")


def paired(left: DataFrame, right: DataFrame, left_pred: str, right_pred: str, label: str = LABEL) -> DataFrame:
    """How two models do on the rows both have scored, per class and in total: both right, either alone, none.

    One aggregate; ``discordant`` rows are those that tell the models apart.
    """
    rows = left.select("row_id", label, left_pred).join(right.select("row_id", right_pred), "row_id")
    a, b = F.col(label) == F.col(left_pred), F.col(label) == F.col(right_pred)
    return rows.rollup(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"),
        F.count_if(~a & ~b).alias("neither")).select(
        F.coalesce(F.col(label).cast("string"), F.lit("all")).alias("label"), "n", "both", "left_only", "right_only", "neither",
        (F.col("left_only") + F.col("right_only")).alias("discordant"))


def fit_stack(merged_train: DataFrame, iterations: int = 30) -> PipelineModel:
    """Stacked fusion: a classifier on the six probabilities."""
    inputs = [f"{side}_{p}" for side in ("nlp", "tab") for p in PROBABILITIES]
    rows = merged_train.withColumn(LABEL, F.col(LABEL).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"),
                            LogisticRegression(labelCol=LABEL, family="multinomial", maxIter=iterations,
                                               regParam=0.01)]).fit(rows)


def compare_modalities(fused: DataFrame) -> DataFrame:
    """Metrics of text, tabular and fused predictions and whether fusion is at least as good
    as the best single one."""
    parts = None
    for name, column in (("nlp_only", "pred_nlp"), ("tabular_only", "pred_tabular"), ("fused", "pred_fused")):
        row = summary(fused, LABEL, column).select(F.lit(name).alias("modality"), "*")
        parts = row if parts is None else parts.unionByName(row)
    single = parts.where("modality <> 'fused'").agg(
        F.max(F.struct("macro_f1", "modality")).alias("s"))
    best = parts.withColumn("_best", single.scalar())
    return best.withColumns({
        "best_single": F.col("_best.modality"), "best_single_f1": F.col("_best.macro_f1"),
        "beats_best": F.col("macro_f1") >= F.col("_best.macro_f1")}).drop("_best")


def ablation(frame: DataFrame, steps=ABLATION, trees: int = 10, depth: int = 4) -> DataFrame:
    """Train on cumulative feature groups; macro-F1 on validation and the step's gain.

    ``frame`` carries every engineered column and ``split``. Each step is a distributed fit;
    the driver keeps one number per step.
    """
    frame = cut_lineage(frame)
    train = frame.where("split = 'train'")
    # Statistics and codes are per column, so one encoding serves every step.
    encoder = fit_encoder(train, group_columns(frame, tuple(FEATURE_GROUPS)))
    coded = cut_lineage(encoder.transform(frame))
    coded_train, coded_val = coded.where("split = 'train'"), coded.where("split = 'validation'")
    results, previous = [], None
    for step, label, groups, select in steps:
        columns = group_columns(frame, groups)
        if select:
            columns, _ = prune_raw(train, columns)
        features = [c for c in encoder.output_columns if c.split("__", 1)[1] in columns]
        if select:
            features, _ = prune_by_importance(coded_train.select(LABEL, *features), trees=trees, depth=depth)
        model = fit_tabular(coded_train, features, trees, depth)
        score_ = summary(score(model, coded_val, "pred"), LABEL, "pred").first()["macro_f1"]
        results.append((step, label, ",".join(sorted(groups)), len(columns), len(features), float(score_),
                        None if previous is None else float(score_ - previous)))
        previous = score_
    return frame.sparkSession.createDataFrame(
        results, "experiment string, label string, groups string, n_raw_features int, "
                 "n_encoded_features int, macro_f1 double, delta_vs_previous double")


def errors(predictions: DataFrame, pred: str, label: str = LABEL) -> DataFrame:
    """Misclassified rows."""
    keep = [c for c in ("incident_id", "row_id", "penalty", "session") if c in predictions.columns]
    return predictions.where(F.col(label) != F.col(pred)).select(
        *keep, F.col(label).alias("actual_severity"), F.col(pred).alias("predicted_severity"))


