"""Naive Bayes as a table of terms: against the pipeline of the library, and its edge cases."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablemend.operators import models, term_models
from tablemend.operators.aggregates import with_sample_weights
from tablemend.plans import flows
from tablemend.sources import models as store
from tablemend.spec import RepairSpec

COUNTED = models.Estimator("counts", "naive_bayes")


def documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").where("text IS NOT NULL")
    return rows.select("doc_id", "text", "quality", "toxic", (F.col("quality") + F.col("toxic")).alias("both"))


@pytest.mark.parametrize(("label", "classes", "weighted"), [("toxic", (0, 1), True), ("quality", (0, 1), False), ("both", (0, 1, 2), True)])
def test_agrees_with_the_library(spark, sf, label, classes, weighted):
    rows = documents(spark, sf)
    weights = with_sample_weights(rows, label, "w", classes) if weighted else rows.withColumn("w", F.lit(1.0))
    stages = [*models.vectoriser("text", "counts"), NaiveBayes(labelCol=label, smoothing=0.8, weightCol="w")]
    fitted = Pipeline(stages=stages).fit(weights)
    expected = fitted.transform(rows).select("doc_id", F.col("prediction").cast("int").alias("p"), vector_to_array("probability").alias("shares"))
    model = models.fit(rows, "text", label, classes, COUNTED, weighted=weighted)
    out = models.predict(model, rows, "text").join(expected, "doc_id").collect()
    assert len(out) == rows.count() and all(r.pred == r.p for r in out)
    assert all(abs(a - b) < 1e-3 for r in out for a, b in zip(r.probability, r.shares))


def test_attributes_are_learned_together_as_alone(spark, sf):
    rows = documents(spark, sf)
    spec = RepairSpec("n", "text", "text", "text", ("quality", "toxic"), {"quality": (0, 1), "toxic": (0, 1)})
    together = flows.learn(rows, spec, "doc_id", COUNTED)
    assert together["quality"].model.model is together["toxic"].model.model
    for a in spec.labels:
        one = RepairSpec("n", "text", "text", "text", (a,), {a: (0, 1)})
        alone = flows.learn(rows, one, "doc_id", COUNTED)[a]
        assert alone.tau == together[a].tau
        both = flows.predictions(rows, spec, together).select("doc_id", f"{a}_pred", f"{a}_conf")
        single = models.predict(alone.model, rows, "text").select("doc_id", "pred", "conf")
        assert both.join(single, "doc_id").where(f"{a}_pred <> pred OR abs({a}_conf - conf) > 1e-12").count() == 0


def test_edge_cases(spark):
    rows = spark.createDataFrame(
        [(["a", "a", "b"], "x", 0), (["b", "c"], "x", 1), (["z"], "y", 1), (None, "x", 0), ([], "x", 1), (["a"], "x", 9), (["q"], "unknown", 0)],
        "words array<string>, attr string, class int",
    )
    model = term_models.fit_terms(rows, {"x": (0, 1), "y": (0, 1)}, 0.8)
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3), ("unseen", 4), ("z", 5)], "term string, w0 int")
    x, y = model.of("x"), model.of("y")
    out = models.predict(x, df, "term").collect()
    assert len(out) == 6 and [c for c in ("term", "w0", "probability", "pred", "conf")] == list(out[0].asDict())
    by = {r.term: r for r in out}
    assert by["a"].pred == 0
    # Without a known word the prior decides, and a word of another attribute only is no word.
    assert by[None].probability == by[""].probability == by["unseen"].probability == by["z"].probability
    assert {r.term: r for r in models.predict(y, df, "term").collect()}["z"].pred == 1
    assert models.predict(x, df.limit(0), "term").collect() == []
    nothing = term_models.fit_terms(rows.limit(0), {"x": (0, 1)}, 0.8).of("x")
    assert {r.pred for r in models.predict(nothing, df, "term").collect()} == {0}
    with pytest.raises(KeyError):
        model.of("w")


def test_stored_models_of_three_classes(spark, sf, tmp_path):
    rows = documents(spark, sf)
    model = models.fit(rows, "text", "both", (0, 1, 2), COUNTED)
    store.save_model(model, f"{tmp_path}/both")
    again = store.load_model(f"{tmp_path}/both")
    assert again.model.priors == model.model.priors and again.model.classes == {"both": (0, 1, 2)}
    first, second = (models.predict(m, rows, "text").select("doc_id", "pred", "probability") for m in (model, again))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_no_vocabulary_outside_the_table(spark, sf):
    rows = documents(spark, sf)
    model = models.fit(rows, "text", "toxic", (0, 1), COUNTED)
    plan = models.predict(model, rows, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "partial_count" in plan


def test_frequent_terms_are_not_shuffled(spark, monkeypatch):
    """The words that reach a shuffle are the rare ones; frequent, rare, unknown and repeated texts score as by hand."""
    monkeypatch.setattr(term_models, "FREQUENT", 4)
    rows = spark.createDataFrame([(["a"] * 9 + ["b"], "x", 0), (["a", "c", "c"], "x", 1)], "words array<string>, attr string, class int")
    model = term_models.fit_terms(rows, {"x": (0, 1)}, 0.8)
    weights = {r.term: (r.w0, r.w1, r.frequent) for r in model.table.collect()}
    assert {t for t, w in weights.items() if w[2]} == {"a"}
    texts = ["a b c", "a a a", "a b c", "b unknown", "unknown", "", None, "c c a a a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = {r.id: (r._w0, r._w1) for r in term_models.term_scores(model, df, F.split("text", " "), "text").collect()}
    for i, t in enumerate(texts):
        known = [weights[w] for w in (t or "").split() if w in weights]
        assert out[i] == (sum(w[0] for w in known), sum(w[1] for w in known))
    plan = term_models.term_scores(model, df, F.split("text", " "), "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "first(_own" not in plan
