"""Training: preprocessing and classifiers as Spark ML pipelines, stratified folds, seeded guided search, evaluation."""

from __future__ import annotations

import math
import random
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, preprocess
from .scoring import PipelineScorer, score
from .staging import staged

MODELS = ("logistic_regression", "random_forest", "gradient_boosting", "linear_svm")


def classifier(name: str, params: dict | None, rows: int, seed: int):
    """A classifier over the columns features and label. rows: of the training table, for the scale of C."""
    p = dict(params or {})
    if name in ("logistic_regression", "linear_svm"):
        reg = 1.0 / (float(p.get("C", 1.0)) * max(1, rows))
        if name == "linear_svm":
            return LinearSVC(maxIter=int(p.get("max_iter", 1000)), regParam=reg, standardization=False)
        return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=reg, elasticNetParam=0.0, standardization=False)
    if name == "random_forest":  # a node of fewer rows than min_samples_split has no two children of half as many
        return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=min(30, int(p.get("max_depth") or 30)), minInstancesPerNode=max(int(p.get("min_samples_leaf", 1)), -(-int(p.get("min_samples_split", 2)) // 2)), featureSubsetStrategy=str(p.get("max_features", "sqrt")), seed=seed)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth", 3)), subsamplingRate=float(p.get("subsample", 1.0)), seed=seed)
    raise ValueError(f"unknown model {name!r}; there are {', '.join(MODELS)}")


def pipeline(train: DataFrame, model: str, numeric: list[str], categorical: list[str], target: str, params: dict | None = None, seed: int = 42) -> Pipeline:
    """Median imputing and population scaling of numeric columns, mode imputing and one-hot coding of categories, the model.

    The statistics come from train, as in fitting; columns that aren't listed are dropped.
    """
    model_stage = classifier(model, params, train.count(), seed)
    med = {r.feature: r.median for r in preprocess.medians(train, numeric).collect()} if numeric else {}
    filled = preprocess.impute(train, {c: med.get(c, 0.0) for c in numeric})
    mom = {r.feature: (r.mean, r.scale) for r in preprocess.moments(filled, numeric).collect()} if numeric else {}
    top = {r.feature: r.mode for r in preprocess.modes(train, categorical).collect()} if categorical else {}
    num = [f"(coalesce(nullif(cast(`{c}` as double), double('NaN')), {med.get(c, 0.0)!r}D) - {mom.get(c, (0.0, 1.0))[0]!r}D) / {mom.get(c, (0.0, 1.0))[1]!r}D as `{c}_n`" for c in numeric]
    quote = lambda s: "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"
    cat = [f"coalesce(cast(`{c}` as string), {quote(top.get(c, ''))}) as `{c}_c`" for c in categorical]
    stages = [SQLTransformer(statement=f"select *, {', '.join([*num, *cat])} from __THIS__")]
    if categorical:
        stages += [StringIndexer(inputCols=[f"{c}_c" for c in categorical], outputCols=[f"{c}_i" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_o" for c in categorical], dropLast=True)]
    stages.append(VectorAssembler(inputCols=[*(f"{c}_n" for c in numeric), *(f"{c}_o" for c in categorical)], outputCol="features"))
    return Pipeline(stages=[*stages, model_stage.setLabelCol(target).setFeaturesCol("features")])


# The search space of each model's parameters.
SPACES: dict[str, dict[str, tuple]] = {
    "logistic_regression": {"C": ("log", 1e-3, 10)},
    "linear_svm": {"C": ("log", 1e-3, 10)},
    "random_forest": {
        "n_estimators": ("step", 100, 500, 50), "max_depth": ("step", 3, 20, 1), "min_samples_split": ("step", 2, 20, 1), "min_samples_leaf": ("step", 1, 10, 1), "max_features": ("pick", "sqrt", "log2"),
    },
    "gradient_boosting": {"n_estimators": ("step", 100, 400, 50), "learning_rate": ("log", 0.01, 0.3), "max_depth": ("step", 2, 6, 1), "subsample": ("even", 0.6, 1)},
}
RANDOM_DRAWS, CANDIDATES, NEAR = 8, 24, 0.15


def value_at(kind: tuple, u: float) -> object:
    """The value of a parameter at a place from 0 to 1 in its space."""
    how, *of = kind
    if how == "pick":
        return of[min(int(u * len(of)), len(of) - 1)]
    if how == "step":
        low, high, step = of
        return low + step * min(int(u * ((high - low) // step + 1)), (high - low) // step)
    low, high = of
    return math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if how == "log" else low + u * (high - low)


def suggest(model: str, rng: random.Random, past: list[tuple[dict[str, float], float]] | None = None) -> dict[str, float]:
    """The places of the next draw in the model's space.

    The first RANDOM_DRAWS are random. Then the best quarter of the past draws (places, score) and the others give a density
    each, kernel by kernel; of candidates near the best, the one with the greatest ratio of the two is drawn.
    """
    if model not in SPACES:
        raise ValueError(f"unknown model {model!r}")
    space = SPACES[model]
    if len(past or ()) < RANDOM_DRAWS:
        return {name: rng.random() for name in space}
    ranked = [places for places, _ in sorted(past, key=lambda x: -x[1])]
    good, rest = ranked[: -(-len(ranked) // 4)], ranked[-(-len(ranked) // 4) :]
    density = lambda group, name, u: 0.1 + sum(math.exp(-(((u - p[name]) / NEAR) ** 2) / 2) for p in group) / len(group)
    candidates = [{name: min(1.0, max(0.0, rng.gauss(base[name], NEAR))) for name in space} for base in (rng.choice(good) for _ in range(CANDIDATES))]
    return max(candidates, key=lambda c: sum(math.log(density(good, n, u) / density(rest, n, u)) for n, u in c.items()))


def evaluate(model: PipelineModel, df: DataFrame, target: str, threshold: float = 0.5) -> dict[str, float]:
    """Metrics of a table. A model without probabilities is judged by its margin, whose line is 0 whatever the threshold."""
    if isinstance(model.stages[-1], LinearSVCModel):
        scored, threshold = model.transform(df).select(target, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("probability")), 0.0
    else:
        scored = score(df, PipelineScorer(model), threshold, keep_features=True).select(target, "probability")
    scored = staged(scored)
    out = metrics.threshold_suite(scored, target, "probability", threshold).first().asDict()
    out["roc_auc"] = metrics.roc_auc(scored, target, "probability").first()[0]
    out["pr_auc"] = metrics.average_precision(scored, target, "probability").first()[0]
    return out


def accuracy_by_split(df: DataFrame, key: str, model: str, numeric: list[str], categorical: list[str], target: str, test_shares: tuple[float, ...] = (0.25, 0.3, 0.15), seed: int = 42) -> dict[float, float]:
    """Accuracy on the held-out rows of a plain random split of each size."""
    found = {}
    for share in test_shares:
        split = staged(preprocess.random_split(df, key, share, seed))
        learning = split.where("not is_test").drop("is_test")
        fitted = pipeline(learning, model, numeric, categorical, target, None, seed).fit(learning)
        found[share] = evaluate(fitted, split.where("is_test").drop("is_test"), target)["accuracy"]
    return found


def cross_validate(folded: DataFrame, folds: int, model: str, numeric: list[str], categorical: list[str], target: str, params: dict | None = None, seed: int = 42) -> list[float]:
    """ROC-AUC on each fold of a table with the column fold, fitted on the others."""
    scores = []
    for k in range(folds):
        train = folded.where(F.col("fold") != k)
        fitted = pipeline(train, model, numeric, categorical, target, params, seed).fit(train)
        scores.append(evaluate(fitted, folded.where(F.col("fold") == k), target)["roc_auc"])
    return scores


def search(folded: DataFrame, folds: int, model: str, numeric: list[str], categorical: list[str], target: str, trials: int = 25, timeout: float | None = 120, seed: int = 42) -> tuple[dict, float]:
    """The best parameters and mean score of seeded, guided draws; no draw starts after timeout seconds."""
    rng, began, past = random.Random(seed), time.monotonic(), []
    for trial in range(trials):
        if trial and timeout is not None and time.monotonic() - began > timeout:
            break
        places = suggest(model, rng, past)
        got = cross_validate(folded, folds, model, numeric, categorical, target, {n: value_at(SPACES[model][n], u) for n, u in places.items()}, seed)
        past.append((places, sum(got) / len(got)))
    places, score = max(past, key=lambda x: x[1], default=({}, -math.inf))
    return {n: value_at(SPACES[model][n], u) for n, u in places.items()}, score


def train(df: DataFrame, key: str, model: str, numeric: list[str], categorical: list[str], target: str, test_share: float = 0.2, folds: int = 5, trials: int = 0, timeout: float | None = 120, threshold: float = 0.5, seed: int = 42) -> tuple[PipelineModel, dict]:
    """Split, search, cross-validate, fit and evaluate; the fitted pipeline and a record of the run."""
    split = staged(preprocess.stratified_split(df, target, key, test_share, seed))  # each of the fits below reads it
    learning, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    folded = staged(preprocess.stratified_folds(learning, target, key, folds, seed + 1))
    params = search(folded, folds, model, numeric, categorical, target, trials, timeout, seed)[0] if trials else {}
    scores = cross_validate(folded, folds, model, numeric, categorical, target, params, seed)
    mean = sum(scores) / len(scores)
    fitted = pipeline(learning, model, numeric, categorical, target, params, seed).fit(learning)
    record = {
        "model": model, "params": params, "cv_mean": mean, "cv_std": math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), "test": evaluate(fitted, test, target, threshold),
        "features": [*numeric, *categorical], "n_train": learning.count(), "n_test": test.count(),
    }
    return fitted, record


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the places of the features vector, from its metadata; empty if there is none."""
    meta = model.transform(df).schema["features"].metadata.get("ml_attr", {})
    found = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in meta.get("attrs", {}).values() for a in group)
    return [name for _, name in found]
