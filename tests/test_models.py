import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import metrics, neighbors, ordered, preprocess, regression, scoring, synthetic, tensor, training


def test_exact_quantiles_and_numbers(spark):
    values = np.round(np.random.default_rng(1).normal(size=500), 1)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, g int")
    for r in ordered.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect():
        assert r.quantile == pytest.approx(np.quantile(values[r.g :: 2], r.probability))
    keyed = spark.range(1000).withColumn("id", F.col("id") * 7 % 1000)
    assert all(r.id == r.row_number for r in ordered.numbered(keyed, "id").collect())


def test_scoring(spark):
    df = spark.createDataFrame([(i, i / 10, "a") for i in range(10)], "customer_id long, x double, y string")
    by_expression = scoring.score(df, scoring.ExpressionScorer("x"), 0.5, "customer_id")
    by_function = scoring.score(df, scoring.ArrowScorer(lambda f: np.column_stack([1 - f["x"], f["x"]])), 0.5, "customer_id", drop=("y", "absent"))
    assert by_expression.columns == ["customer_id", "probability", "prediction"]
    assert sorted(map(tuple, by_expression.collect())) == sorted(map(tuple, by_function.collect()))
    chunks = scoring.chunk_metrics(scoring.chunked(by_expression, "customer_id", 4)).orderBy("chunk").collect()
    assert [c.n for c in chunks] == [4, 4, 2]
    exact, compat = scoring.aggregate_exact(by_expression).first(), scoring.aggregate_compat(scoring.chunked(by_expression, "customer_id", 4)).first()
    assert exact.std == pytest.approx(compat.std) == pytest.approx(np.std(np.arange(10) / 10))
    empty = by_expression.where(F.lit(False))
    assert scoring.aggregate_exact(empty).first().asDict() == scoring.aggregate_compat(scoring.chunked(empty, "customer_id", 4)).first().asDict() | {"n": 0}
    with pytest.raises(Exception, match="two classes"):
        scoring.score(df, scoring.ArrowScorer(lambda f: np.ones((len(f), 1))), 0.5).collect()


def test_perfect_and_one_sided_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == metrics.average_precision(df, "y", "s").first()[0] == 1
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None
    assert metrics.threshold_suite(df, "y", "s", 2.0).first()["f1"] == 0


def test_preprocessing(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (3.0, None), (None, "a"), (8.0, "b")], "x double, c string")
    assert preprocess.medians(df, ["x"]).first().median == 3
    assert preprocess.modes(df, ["c"]).first().mode == "a"
    filled = preprocess.impute(df, {"x": 3.0, "c": "a"}).collect()
    assert [r.x for r in filled] == [1, 3, 3, 3, 8] and filled[2].c == "a"


def test_regression(spark):
    fit = regression.polynomial(synthetic.cubic(spark, 100, 1.5), "x", "y", 3)
    assert np.allclose(fit, [1.5, 0, 0, 1], atol=1e-8)
    last = regression.gradient_descent(synthetic.line(spark, noise=0.0), "x", "y").orderBy(F.desc("epoch")).first()
    assert last.w == pytest.approx(3) and last.b == pytest.approx(7, abs=1e-6)


def test_neighbours_against_plain_search(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, l int")
    for r in neighbors.nearest(df, df.where("id % 20 = 0"), "id", "v", "l", 2).collect():
        d = ((x - x[r.query]) ** 2).sum(1)
        d[r.query] = np.inf
        assert np.argsort(d)[r["rank"] - 1] == r.neighbour


def test_layers_against_numpy(spark):
    image, kernel = np.random.default_rng(4).normal(size=(5, 7)), np.random.default_rng(5).normal(size=(3, 3))
    wide = np.pad(image, 1)
    conv = np.array([[(wide[r : r + 3, c : c + 3] * kernel).sum() for c in range(7)] for r in range(5)])
    pooled = np.array([[conv[r : r + 2, c : c + 2].max() for c in range(0, 7, 2)] for r in range(0, 5, 2)])
    df = spark.createDataFrame([(image.ravel().tolist(),)], "v array<double>").select(tensor.conv2d_same(F.col("v"), 5, 7, kernel.tolist()).alias("z"))
    row = df.select("z", tensor.max_pool_2x2(F.col("z"), 5, 7).alias("p")).first()
    assert np.allclose(row.z, conv.ravel()) and np.allclose(row.p, pooled.ravel())


def test_network_layers_with_channels(spark):
    """One channel to three, pooled, to two, then a dense layer: as plain loops would have it."""
    rng = np.random.default_rng(6)
    images, first, second = rng.normal(size=(4, 6, 6)), rng.normal(size=(5, 5, 1, 3)), rng.normal(size=(3, 3, 3, 2))
    weights, bias, shift = rng.normal(size=(4, 18)), rng.normal(size=4), [0.1, -0.2, 0.3]

    def conv(x, k):
        wide = np.pad(x, [(k.shape[0] // 2,) * 2, (k.shape[1] // 2,) * 2, (0, 0)])
        return np.array([[[(wide[r : r + k.shape[0], c : c + k.shape[1]] * k[..., o]).sum() for o in range(k.shape[3])] for c in range(x.shape[1])] for r in range(x.shape[0])])

    def whole(x):
        x = np.maximum(conv(x[..., None], first) + shift, 0)
        x = np.array([[x[r : r + 2, c : c + 2].max((0, 1)) for c in range(0, 6, 2)] for r in range(0, 6, 2)])
        return weights @ conv(x, second).ravel() + bias

    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(images)] + [(9, None)], "i int, v array<double>")
    z = tensor.max_pool_2x2(tensor.relu(tensor.conv2d_same(F.col("v"), 6, 6, first), shift), 6, 6, 3)
    out = df.select("i", tensor.dense(tensor.conv2d_same(z, 3, 3, second), weights, bias).alias("o"))
    for r in out.collect():
        assert r.o is None if r.i == 9 else np.allclose(r.o, whole(images[r.i]))


def test_neighbours_in_several_blocks_and_ties(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 0.0], i % 3) for i in range(90)] + [(None, [0.0, 0.0], 1), (200, None, 1)], "id long, v array<double>, l int")
    got = neighbors.nearest(df, df.where("id % 20 = 0"), "id", "v", "l", 4, query_block=2, row_block=20)
    for q in range(0, 90, 20):
        d = sorted((((i % 5 - q % 5) ** 2), i) for i in range(90) if i != q)[:4]
        assert [(r.distance, r.neighbour) for r in got.where(f"query = {q}").orderBy("rank").collect()] == d


def test_plain_splits_and_accuracy(spark):
    df = synthetic.churn(spark, 800).withColumn("sure", F.col("churn") + F.rand(1) / 2)
    split = preprocess.random_split(df, "customer_id", 0.3, 5)
    assert split.where("is_test").count() == 240 and split.columns == [*df.columns, "is_test"]
    found = training.accuracy_by_split(df, "customer_id", "logistic_regression", ["sure"], [], "churn")
    assert list(found) == [0.25, 0.3, 0.15] and min(found.values()) > 0.95
    with pytest.raises(ValueError, match="test_share"):
        preprocess.random_split(df, "customer_id", 1.5)


def test_linear_svm_is_evaluated_by_its_margin(spark):
    df = synthetic.churn(spark, 400).withColumn("sure", F.col("churn") + F.rand(2) / 2)
    fitted, record = training.train(df, "customer_id", "linear_svm", ["sure"], ["contract_type"], "churn", folds=2)
    assert record["test"]["roc_auc"] > 0.95 and record["test"]["accuracy"] > 0.9
    assert training.feature_names(fitted, df)[0] == "sure_n"
    with pytest.raises(ValueError, match="two classes"):
        scoring.PipelineScorer(fitted).probability(df, "p")


def test_search_stays_in_its_space(spark):
    df = synthetic.churn(spark, 300).withColumn("fold", (F.col("customer_id") % 2).cast("int"))
    params, score = training.search(df, 2, "logistic_regression", list(synthetic.NUMERIC), [], "churn", trials=2, timeout=None)
    assert 1e-3 <= params["C"] <= 10 and 0.4 < score <= 1


def test_draws_go_where_scores_were_good():
    import random

    rng, past = random.Random(1), []
    for _ in range(40):
        places = training.suggest("gradient_boosting", rng, past)
        past.append((places, -sum((u - 0.3) ** 2 for u in places.values())))
    assert sum(s for _, s in past[-10:]) > 3 * sum(s for _, s in past[: training.RANDOM_DRAWS]) / training.RANDOM_DRAWS
    space = training.SPACES["random_forest"]
    assert [training.value_at(space["n_estimators"], u) for u in (0, 0.5, 1)] == [100, 300, 500] and training.value_at(space["max_features"], 1) == "log2"
    assert training.value_at(training.SPACES["linear_svm"]["C"], 0.5) == pytest.approx(0.1)
    with pytest.raises(ValueError, match="unknown model"):
        training.suggest("nothing", rng)


def test_chunks_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n" + "".join(f"{99 - i}\n" for i in range(100)))
    df = scoring.chunked_as_read(spark.read.option("header", True).schema("x int").csv(str(tmp_path / "a.csv")), 30)
    assert sorted(map(tuple, df.groupBy("chunk").agg(F.max("x"), F.min("x")).collect())) == [(0, 99, 70), (1, 69, 40), (2, 39, 10), (3, 9, 0)]


def test_unknown_model_and_synthetic_rate(spark):
    with pytest.raises(ValueError, match="unknown model"):
        training.classifier("nothing", None, 10, 1)
    df = synthetic.churn(spark, 4000)
    assert 0.2 < df.agg(F.avg("churn")).first()[0] < 0.45
    assert df.select(F.min("tenure_months"), F.max("monthly_charges")).first() == (0, 120)


@pytest.mark.parametrize("model", ["logistic_regression", "gradient_boosting"])
def test_fit_beats_chance(spark, model):
    df = synthetic.churn(spark, 600).coalesce(2)
    params = {"max_iter": 50} if model == "logistic_regression" else {"n_estimators": 5}
    fitted = training.pipeline(df, model, list(synthetic.NUMERIC), list(synthetic.CATEGORICAL), "churn", params).fit(df)
    assert training.evaluate(fitted, df, "churn")["roc_auc"] > 0.6


def test_dropout_and_first_weights(spark):
    df = spark.range(400).select(F.array(F.col("id").cast("double") + 1).alias("v"))
    kept = df.where(F.get(tensor.dropout(F.col("v"), 0.5, 3), F.lit(0)) > 0).count()
    assert 140 < kept < 260 and df.where(tensor.dropout(F.col("v"), 1.0) == F.col("v")).count() == 400
    weights = tensor.truncated_normal(500)
    assert max(map(abs, weights)) <= 0.2 and np.std(weights) > 0.05
