"""Models learned from labelled documents. Naive Bayes is a relation and has SQL; the tests check the properties of the others."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tablemend.catalog.base import NOTES_SQL, counters_sql, notes, quality_sql, query, unlabelled
from tablemend.catalog.texts import COUNTS_SQL, WORDS_SQL
from tablemend.operators import models
from tablemend.operators.repair import gated
from tablemend.operators.selection import split_train_valid
from tablemend.plans import flows
from tablemend.session import scratch_path
from tablemend.sources import models as store
from tablemend.spec import RepairSpec

SPEC = RepairSpec(
    name="notes", partial_key="text", source="source", text="text", labels=("quality", "toxic"),
    domains={"quality": (0, 1), "toxic": (0, 1)}, order="doc_id",
)
HASHED = 1024
# Slots of the linear models, whose gradients and weights pass through the driver: a bound that does not grow with the vocabulary. Every word counts.
SLOTS = 2**18


COUNTED_BAYES = models.Estimator("counts", "naive_bayes")


def _order():
    return (F.col("doc_id") * 37 + 11) % 100


def _parts(spark, sf, label):
    return split_train_valid(notes(spark, sf), label, _order(), "doc_id")


def _predicted(spark, sf, estimator, label="toxic"):
    """Predictions for labelled rows, by part, and for documents without labels, whose part is null."""
    parts = _parts(spark, sf, label)
    model = models.fit(parts.filter("part = 'train'"), "text", label, (0, 1), estimator)
    parts = parts.unionByName(unlabelled(spark, sf).withColumn("part", F.lit(None).cast("string")))
    return models.predict(model, parts.select("doc_id", "text", label, "part"), "text").drop("text")


def _split_sql(a: str) -> str:
    """``split_<a>``: labelled documents with their part."""
    return f"""ranked_{a} AS (
      SELECT doc_id, text, {a} AS class, (doc_id * 37 + 11) % 100 AS ord,
        row_number() OVER (PARTITION BY {a} ORDER BY (doc_id * 37 + 11) % 100, doc_id) AS first_,
        row_number() OVER (PARTITION BY {a} ORDER BY (doc_id * 37 + 11) % 100 DESC, doc_id DESC) AS last_
      FROM notes WHERE {a} IS NOT NULL
    ), split_{a} AS (
      SELECT doc_id, text, class, CASE WHEN first_ = 1 AND last_ = 1 THEN 'train' WHEN first_ = 1 THEN 'valid'
        WHEN last_ = 1 THEN 'train' WHEN ord < 10 THEN 'valid' ELSE 'train' END AS part FROM ranked_{a}
    )"""


def _bayes_sql(a: str, train: str) -> str:
    """``scored_<a>`` (doc_id, pred, conf, p1) of all documents, learned from the rows ``train`` (doc_id, class) with classes 0 and 1."""
    return f"""train_{a} AS ({train}),
    texts_{a} AS (SELECT class, count(*) AS d FROM train_{a} GROUP BY class),
    shares_{a} AS (SELECT class, d, sum(d) OVER () / (count(*) OVER () * d) AS share FROM texts_{a}),
    seen_{a} AS (SELECT term, class, sum(n) AS n FROM train_{a} JOIN counts USING (doc_id) GROUP BY term, class),
    terms_{a} AS (SELECT DISTINCT term FROM seen_{a}),
    known_{a} AS (SELECT class, share, d, coalesce((SELECT sum(n) FROM seen_{a} s WHERE s.class = c.class), 0) AS total,
      (SELECT count(*) FROM terms_{a}) AS n_terms, (SELECT sum(share * d) FROM shares_{a}) AS everything FROM shares_{a} c),
    weights_{a} AS (SELECT term, k.class, floor(1000000 * ln((share * coalesce(n, 0) + 0.8::DOUBLE) / (share * total + 0.8::DOUBLE * n_terms)))::BIGINT AS w
      FROM terms_{a} CROSS JOIN known_{a} k LEFT JOIN seen_{a} USING (term, class)),
    sums_{a} AS (SELECT doc_id, class, sum(n * w)::BIGINT AS w FROM counts JOIN weights_{a} USING (term) GROUP BY doc_id, class),
    both_{a} AS (SELECT d.doc_id, max(s) FILTER (WHERE class = 0) AS s0, max(s) FILTER (WHERE class = 1) AS s1 FROM (
        SELECT d.doc_id, k.class, coalesce(w, 0) + floor(1000000 * ln((share * d + 0.8::DOUBLE) / (everything + 2 * 0.8::DOUBLE)))::BIGINT AS s
        FROM documents d CROSS JOIN known_{a} k LEFT JOIN sums_{a} x ON x.doc_id = d.doc_id AND x.class = k.class) d GROUP BY d.doc_id),
    scored_{a} AS (SELECT doc_id, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS pred, greatest(e0 / (e0 + e1), e1 / (e0 + e1)) AS conf, e1 / (e0 + e1) AS p1
      FROM (SELECT doc_id, s0, s1, exp((s0 - greatest(s0, s1)) / 1000000) AS e0, exp((s1 - greatest(s0, s1)) / 1000000) AS e1 FROM both_{a}))"""


WITH_SQL = f"WITH {NOTES_SQL}, {WORDS_SQL}, {COUNTS_SQL}"


@query(
    "naive_bayes_predictions",
    f"""{WITH_SQL}, {_split_sql("toxic")}, {_bayes_sql("toxic", "SELECT doc_id, class FROM split_toxic WHERE part = 'train'")}
    SELECT s.doc_id, class AS toxic, part, pred, round(conf, 6) AS conf, round(p1, 6) AS share_of_one FROM scored_toxic s LEFT JOIN split_toxic USING (doc_id)""",
)
def _(spark, sf):
    out = _predicted(spark, sf, COUNTED_BAYES).withColumn("share_of_one", F.round(F.get("probability", F.lit(1)), 6))
    return out.withColumn("conf", F.round("conf", 6)).drop("probability")


def _register(name: str, estimator: models.Estimator):
    @query(name)
    def _(spark, sf):
        return _predicted(spark, sf, estimator)


# Settings that keep these queries short; without them an estimator takes the reference's (`models.SETTINGS`).
SHORT_TREES = (("maxIter", 20), ("maxDepth", 5), ("stepSize", 0.1))

_register("logistic_regression_predictions", models.Estimator("tfidf", "logistic_regression", SLOTS, (("maxIter", 100),)))
_register("boosted_trees_predictions", models.Estimator("tfidf", "boosted_trees", HASHED, SHORT_TREES))
_register("decision_tree_predictions", models.Estimator("counts", "decision_tree", HASHED))
_register("random_forest_predictions", models.Estimator("counts", "random_forest", HASHED, (("numTrees", 50),)))
_register("linear_svm_predictions", models.Estimator("tfidf", "linear_svm", SLOTS, (("maxIter", 50),)))
_register("perceptron_predictions", models.Estimator("tfidf", "perceptron", HASHED, (("hidden", (64,)), ("maxIter", 50))))


@query("three_class_boosted_trees_predictions")
def _(spark, sf):
    rows = notes(spark, sf).withColumn("both", F.col("quality") + F.col("toxic"))
    model = models.fit(rows, "text", "both", (0, 1, 2), models.Estimator("counts", "boosted_trees", 256, SHORT_TREES))
    rest = unlabelled(spark, sf).withColumn("both", F.col("quality") + F.col("toxic"))
    return models.predict(model, rows.unionByName(rest).select("doc_id", "text", "both"), "text").drop("text")


@query("three_class_boosted_trees_repair")
def _(spark, sf):
    """Three classes end to end: depth, rounds and rate searched by cross-validation, the best model stored, read again, and used to overwrite labels."""
    rows = notes(spark, sf).withColumn("both", F.col("quality") + F.col("toxic"))
    rest = unlabelled(spark, sf).withColumn("both", F.lit(None).cast(rows.schema["both"].dataType))
    grid = {"maxDepth": [3], "maxIter": [2, 5], "stepSize": [0.1, 0.2]}
    estimator = models.Estimator("counts", "boosted_trees", 256)
    path = store.model_path(scratch_path(spark, "models"), "both", estimator.name, "without_constraints")
    model = store.load_or_train(spark, path, lambda: models.grid_search(rows, "text", "both", (0, 1, 2), estimator, grid)[0])
    scored = models.predict(model, rows.unionByName(rest).select("doc_id", "text", F.col("both").alias("original")), "text")
    fixed = gated(F.col("original"), F.col("pred").cast("int"), F.col("conf"), 0.9)
    return scored.select("doc_id", "original", "pred", "conf", fixed.alias("repaired"))


@query("grid_search")
def _(spark, sf):
    rows = _parts(spark, sf, "quality").filter("part = 'train'")
    _, result = models.grid_search(
        rows, "text", "quality", (0, 1), models.Estimator("counts", "naive_bayes"), {"smoothing": [0.2, 0.8, 2.0]}
    )
    return spark.createDataFrame([(result["best_params"]["smoothing"], result["val_acc"])], "smoothing double, val_acc double")


# Naive Bayes on counts is a table of all words. What the others learn per feature is held by tasks and the driver.
MATRIX = tuple(
    e if (e.features, e.classifier) == ("counts", "naive_bayes") else replace(
        e, n_features=HASHED if e.classifier == "boosted_trees" else SLOTS,
        settings={"boosted_trees": SHORT_TREES, "logistic_regression": (("maxIter", 100),)}.get(e.classifier, ()),
    )
    for e in models.MODEL_MATRIX
)


@query("model_matrix")
def _(spark, sf):
    parts = models.with_words(_parts(spark, sf, "toxic"), "text")
    train = parts.filter("part = 'train'")
    dirty = parts.withColumn("toxic_gs", F.col("toxic")).withColumn(
        "toxic", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    from tablemend.operators.selection import clean_for

    return flows.model_matrix(
        train, clean_for(train, "text", "text", "toxic"), dirty, "text", "toxic", (0, 1), "toxic_gs", MATRIX
    )


def _trained(spark, sf):
    rows = notes(spark, sf)
    return rows, flows.learn(rows, SPEC, "doc_id", COUNTED_BAYES, order=_order())


def _clean_sql(a: str) -> str:
    """Training rows whose text has one label only."""
    return f"""SELECT doc_id, class FROM split_{a} WHERE part = 'train' AND text IS NOT NULL
      AND text NOT IN (SELECT text FROM split_{a} WHERE part = 'train' AND text IS NOT NULL GROUP BY text HAVING min(class) <> max(class))"""


def _tau_sql(a: str) -> str:
    return f"""tau_{a} AS (SELECT round(avg(m) * 0.9, 2) AS tau FROM (SELECT class, coalesce(avg(CASE WHEN pred = class THEN conf END), 0) AS m
      FROM split_{a} JOIN scored_{a} USING (doc_id) WHERE part = 'valid' GROUP BY class))"""


LEARNED_SQL = WITH_SQL + "".join(f", {_split_sql(a)}, {_bayes_sql(a, _clean_sql(a))}, {_tau_sql(a)}" for a in ("quality", "toxic"))


def _gated_sql(a: str, original: str) -> str:
    return f"CASE WHEN s_{a}.conf >= (SELECT tau FROM tau_{a}) OR {original} IS NULL THEN s_{a}.pred ELSE {original} END AS {a}"


def _overwritten_sql(toxic: str) -> str:
    """All documents, labels overwritten where the models are sure."""
    return f"""SELECT d.doc_id, d.source, d.text, {_gated_sql("quality", "x.quality")}, {_gated_sql("toxic", toxic)}
      FROM documents d LEFT JOIN labels x USING (doc_id) JOIN scored_quality s_quality USING (doc_id) JOIN scored_toxic s_toxic USING (doc_id)"""


@query(
    "model_per_attribute_repair",
    f"{LEARNED_SQL} SELECT doc_id, quality, toxic FROM ({_overwritten_sql('(CASE WHEN doc_id % 7 <> 0 THEN x.toxic END)')})",
)
def _(spark, sf):
    rows, trained = _trained(spark, sf)
    dirty = rows.withColumn("toxic", F.when(F.col("doc_id") % 7 != 0, F.col("toxic"))).unionByName(unlabelled(spark, sf))
    return flows.model_repair(dirty, SPEC, trained).select("doc_id", "quality", "toxic")


def _voted_sql(a: str) -> str:
    return f"""won_{a} AS (SELECT text, {a} FROM (
      SELECT text, {a}, row_number() OVER (PARTITION BY text ORDER BY count(*) DESC, any_value(f.n) DESC, {a}) AS r
      FROM fixed JOIN (SELECT {a}, count(*) AS n FROM fixed GROUP BY {a}) f USING ({a}) WHERE text IS NOT NULL GROUP BY text, {a}) WHERE r = 1)"""


@query(
    "model_then_group_repair",
    f"""{LEARNED_SQL}, fixed AS ({_overwritten_sql("x.toxic")}), {_voted_sql("quality")}, {_voted_sql("toxic")}
    SELECT doc_id, source, coalesce(q.quality, f.quality) AS quality, coalesce(t.toxic, f.toxic) AS toxic
    FROM fixed f LEFT JOIN won_quality q USING (text) LEFT JOIN won_toxic t USING (text)""",
)
def _(spark, sf):
    rows, trained = _trained(spark, sf)
    rows = rows.unionByName(unlabelled(spark, sf))
    return flows.model_then_group(rows, SPEC, trained).select("doc_id", "source", "quality", "toxic")


FLIPPED_SQL = "CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END"
SWEPT_SQL = ", swept AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS attr, th AS threshold, {counters_sql(a, own, 'gs', f'(CASE WHEN conf >= th OR {own} IS NULL THEN pred ELSE {own} END)')}
    FROM (SELECT doc_id, {a} AS gs, {original} AS own, pred, conf FROM notes JOIN scored_{a} USING (doc_id)),
      (SELECT DISTINCT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[] || [(SELECT tau FROM tau_{a})]) AS th) GROUP BY th"""
    for a, original, own in (("quality", "quality", "own"), ("toxic", FLIPPED_SQL, "own"))
) + ")"


@query("learned_threshold_sweep", f"{LEARNED_SQL}{SWEPT_SQL} " + quality_sql("swept", "attr, threshold"))
def _(spark, sf):
    rows, trained = _trained(spark, sf)
    from tablemend.operators.evaluate import sweep_thresholds

    dirty = rows.withColumns({"quality_gs": F.col("quality"), "toxic_gs": F.col("toxic")}).withColumn(
        "toxic", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    return flows.sweep(dirty, SPEC, trained, {a: sweep_thresholds(t.tau) for a, t in trained.items()})


@query(
    "stored_model_predictions",
    f"""{WITH_SQL}, {_bayes_sql("toxic", "SELECT doc_id, toxic AS class FROM notes WHERE toxic IS NOT NULL AND text IS NOT NULL")}
    SELECT doc_id, pred, pred AS pred_again, round(conf, 6) AS conf FROM scored_toxic""",
)
def _(spark, sf):
    """The model is stored, read again, and asked about all documents; both answers beside each other."""
    rows = notes(spark, sf)
    path = store.model_path(scratch_path(spark, "models"), "toxic", "counts-naive_bayes", "with_constraints")
    model = store.load_or_train(spark, path, lambda: models.fit(rows, "text", "toxic", (0, 1), COUNTED_BAYES))
    again = store.load_or_train(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("trained twice")))
    every = rows.unionByName(unlabelled(spark, sf)).select("doc_id", "text")
    first = models.predict(model, every, "text").select("doc_id", "pred", F.round("conf", 6).alias("conf"))
    second = models.predict(again, every, "text").select("doc_id", F.col("pred").alias("pred_again"))
    return first.join(second, "doc_id").select("doc_id", "pred", "pred_again", "conf")
