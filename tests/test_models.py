from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tablemend.operators import models
from tablemend.plans import flows
from tablemend.sources import models as store
from tablemend.spec import EditRule, RepairSpec

WORDS = {0: ["milk", "butter", "cream"], 1: ["wheat", "flour", "bread"], 2: ["soy", "bean", "tofu"]}


def texts(spark, classes, n=240, seed=3):
    """Texts whose words tell the class, a few of them labelled wrong."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = i % classes
        words = rng.sample(WORDS[c], 2) + rng.sample(["fresh", "good", "the", "Fine"], 2)
        rng.shuffle(words)
        rows.append((i, i // 4, f"s{i % 5}", " ".join(words), c))
    return spark.createDataFrame(rows, "id long, entity long, source string, text string, label int").repartition(2)


@pytest.mark.parametrize(
    "estimator",
    [
        models.Estimator("counts", "naive_bayes"),
        models.Estimator("tfidf", "logistic_regression"),
        models.Estimator("counts", "boosted_trees", 64, (("maxIter", 5), ("maxDepth", 3))),
        models.Estimator("counts", "decision_tree", 64),
        models.Estimator("tfidf", "random_forest", 64, (("numTrees", 20),)),
        models.Estimator("tfidf", "linear_svm", 64),
        models.Estimator("counts", "perceptron", 64, (("hidden", (16,)), ("maxIter", 50))),
    ],
    ids=lambda e: e.name,
)
def test_every_classifier_learns_two_classes(spark, estimator):
    df = texts(spark, 2)
    model = models.fit(df, "text", "label", (0, 1), estimator)
    out = models.predict(model, df, "text").collect()
    assert len(out) == 240 and any("Fine" in r["text"] for r in out)
    assert sum(r["pred"] == r["label"] for r in out) / len(out) > 0.95
    if estimator.classifier != "linear_svm":
        assert all(abs(sum(r["probability"]) - 1) < 1e-6 and abs(max(r["probability"]) - r["conf"]) < 1e-9 for r in out)
    else:
        assert all(r["conf"] is None for r in out)


def test_boosted_trees_for_three_classes(spark, tmp_path):
    df = texts(spark, 3)
    estimator = models.Estimator("counts", "boosted_trees", 64, (("maxDepth", 3),))
    grid = {"maxIter": [1, 4], "stepSize": [0.1, 0.3]}
    model, result = models.grid_search(df, "text", "label", (0, 1, 2), estimator, grid)
    assert set(result["best_params"]) == set(grid) and result["val_acc"] > 0.95
    out = models.predict(model, df, "text").collect()
    assert sum(r["pred"] == r["label"] for r in out) / len(out) > 0.95
    assert all(abs(sum(r["probability"]) - 1) < 1e-6 for r in out)
    store.save_model(model, f"{tmp_path}/three")
    again = models.predict(store.load_model(f"{tmp_path}/three"), df, "text").collect()
    assert sorted((r.id, r.pred, tuple(r.probability)) for r in again) == sorted((r.id, r.pred, tuple(r.probability)) for r in out)


def test_settings_replace_those_of_the_reference():
    assert models.classifier("boosted_trees", "y", 2).getMaxDepth() == 6 and models.classifier("boosted_trees", "y", 2, maxDepth=8).getMaxDepth() == 8
    assert models.classifier("boosted_trees", "y", 3).getMaxIter() == 100 and models.perceptron("y", 64, 3).getLayers() == [64, 1000, 5000, 3]
    with pytest.raises(ValueError):
        models.classifier("oracle", "y", 2)


def test_smoothed_idf(spark):
    import math

    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "c"],)], "_words array<string>")
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    counted = CountVectorizer(inputCol="_words", outputCol="_tf").fit(df)
    idf = models.SmoothedIDF(inputCol="_tf", outputCol="out").fit(counted.transform(df))
    row = idf.transform(counted.transform(df)).select(vector_to_array("out").alias("v")).first()["v"]
    weights = dict(zip(counted.vocabulary, row))
    assert math.isclose(weights["a"], 1.0) and math.isclose(weights["b"], math.log(4 / 2) + 1)


def test_learned_repair_fixes_wrong_labels(spark):
    spec = RepairSpec(
        name="t", partial_key="entity", source="source", text="text", labels=("label",), domains={"label": (0, 1)},
        rules=(EditRule.of(label=7),),
    )
    good = texts(spark, 2).withColumn("entity", F.col("id"))
    trained = flows.learn(good, spec, "id", models.Estimator("counts", "naive_bayes"))
    assert 0.5 < trained["label"].tau <= 0.9
    wrong = F.when(F.col("id") % 10 == 0, 1 - F.col("label")).when(F.col("id") % 10 == 1, None).otherwise(F.col("label"))
    dirty = good.withColumn("label", wrong)
    repaired = flows.model_repair(dirty, spec, trained)
    assert repaired.columns == dirty.columns
    gold = good.select("entity", "label")
    metrics = {r["attr"]: r for r in flows.repaired_metrics(dirty, repaired, gold, spec, "id", ["label"]).collect()}
    assert metrics["*"]["errors"] == 48 and metrics["*"]["correct"] > 40 and metrics["*"]["precision"] > 0.9
    everything = flows.model_repair(dirty, spec, trained, {"label": 0.0})
    predicted = models.predict(trained["label"].model, dirty, "text").select("id", "pred")
    assert everything.join(predicted, "id").filter("label <> pred").count() == 0
    nothing = flows.model_repair(dirty, spec, trained, {"label": 1.1})
    kept = nothing.join(dirty.select("id", F.col("label").alias("old")), "id")
    assert kept.filter("old is not null and label <> old").count() == 0 and kept.filter("label is null").count() == 0


def test_registered_models_give_one_row_per_text(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    queries = registry.queries()
    for name in ("naive_bayes_predictions", "model_then_group_repair", "stored_model_predictions"):
        df = queries[name](spark, sf)
        assert df.count() == documents
        if name == "stored_model_predictions":
            assert df.filter("pred <> pred_again").count() == 0


def test_documents_without_labels_are_predicted_and_repaired(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    queries = registry.queries()
    predicted = queries["logistic_regression_predictions"](spark, sf)
    assert predicted.count() == documents and predicted.filter("pred IS NULL").count() == 0
    repaired = queries["model_per_attribute_repair"](spark, sf)
    assert repaired.count() == documents and repaired.filter("quality IS NULL OR toxic IS NULL").count() == 0


def test_three_classes_end_to_end(spark, sf):
    out = registry.queries()["three_class_boosted_trees_repair"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.repaired is not None and (r.repaired == r.pred if r.original is None or r.conf >= 0.9 else r.repaired == r.original) for r in out)


def test_model_matrix_query_has_every_cell(spark, sf):
    out = registry.queries()["model_matrix"](spark, sf).select("model", "strategy").collect()
    wanted = {(e.name, s) for e in models.MODEL_MATRIX for s in ("with_constraints", "without_constraints")}
    assert len(out) == len(wanted) and set(map(tuple, out)) == wanted


def test_grid_search_returns_a_setting_of_the_grid(spark):
    _, result = models.grid_search(
        texts(spark, 2), "text", "label", (0, 1), models.Estimator("counts", "naive_bayes"), {"smoothing": [0.5, 0.8]}
    )
    assert result["best_params"]["smoothing"] in (0.5, 0.8) and result["val_acc"] > 0.9


def test_the_matrix_has_a_row_per_model_and_strategy(spark):
    df = texts(spark, 2)
    dirty = df.withColumn("label_gs", F.col("label")).withColumn(
        "label", F.when(F.col("id") % 8 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    )
    chosen = [models.Estimator("counts", "naive_bayes"), models.Estimator("tfidf", "naive_bayes")]
    out = flows.model_matrix(df, df, dirty, "text", "label", (0, 1), "label_gs", chosen)
    assert out.count() == 4
    best = models.best_model(out.withColumn("dataset", F.lit("t")), ["dataset"]).first()
    assert best["f1"] > 0.9 and best["model"] == "counts-naive_bayes"


def test_what_a_fit_keeps_is_vectors_where_words_are_hashed(spark):
    df = texts(spark, 2)
    ahead, between, model = models._stages(models.Estimator("tfidf", "decision_tree", 64), "text", "label", 2, None)
    with models._kept_rows(df, "text", "label", None, (0, 1), ahead) as rows:
        assert dict(rows.dtypes)["_tf"] == "vector" and models.WORDS not in rows.columns and rows.count() == 240


def test_the_matrix_fits_several_models_at_a_time_in_few_blocks(spark, monkeypatch):
    df = texts(spark, 2).withColumn("label_gs", F.col("label"))
    chosen = [models.Estimator("counts", "logistic_regression", 64, (("maxIter", n),)) for n in (1, 2, 3)]
    assert all(models._stages(e, "text", "label", 2, None)[2].getMaxBlockSizeInMB() == models.BLOCK_MB for e in chosen)
    together, real = threading.Barrier(3, timeout=60), flows.fit
    monkeypatch.setattr(flows, "fit", lambda *args: (together.wait(), real(*args))[1])  # goes on when three have come
    out = flows.model_matrix(df, df.where("id > 9"), df, "text", "label", (0, 1), "label_gs", chosen).collect()
    assert [r.strategy for r in out] == ["with_constraints", "without_constraints"] * 3 and all(r.accuracy > 0.5 for r in out)


def test_linear_models_and_the_matrix_have_a_bounded_number_of_features():
    from tablemend.catalog import learning

    assert all(e.n_features or (e.features, e.classifier) == ("counts", "naive_bayes") for e in learning.MATRIX)
    assert learning.SLOTS == 2**18


def test_content_words_are_the_words_of_letters_only(spark):
    from tablemend.functions import text

    odd = ["e120 Milk 1st a_b _ é1 naïve", "", "the a 1 2 3", "1 " * 20_000 + "end", "x" * 50_000, "Crème-brûlée ½ cup\x00salt", None]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    words = text.without_stop_words(text.tokens(text.strip_accents(F.lower("text"))))
    assert df.where(~text.content_words(F.col("text")).eqNullSafe(words)).count() == 0
    assert df.select(text.content_words(F.col("text")).alias("w")).first()["w"] == ["milk", "naive"]
