"""Learning an attribute from text: estimators, grid search, prediction, thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator as Fitter
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.text import content_words
from tablemend.operators.aggregates import with_sample_weights
from tablemend.operators.boosting import BoostedTrees
from tablemend.operators.evaluate import confidence_threshold
from tablemend.operators.ranking import best_by, confidence, predicted_class
from tablemend.operators.selection import clean_for, split_train_valid
from tablemend.operators.term_models import TermClassifier, class_scores, fit_terms, likeliest, probabilities, term_scores
from tablemend.session import stored
from tablemend.spec import CONFIDENCE_SCALE, FOLDS, NAIVE_BAYES_SMOOTHING, PARALLEL_FITS, EditRule

SEED = 42


class ContentWords(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around the built-in expressions of `content_words`."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.getOutputCol() in df.columns:  # split before, see `with_words`
            return df
        return df.withColumn(self.getOutputCol(), words_of(self.getInputCol()))


WORDS = "_words"


def words_of(text: str) -> Column:
    """The words of a text column; a null text has none."""
    return content_words(F.coalesce(F.col(text), F.lit("")))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """The table with its texts split into words once, written out for all models that follow."""
    return stored(df.withColumn(WORDS, words_of(text)), "words")


@contextmanager
def _kept_rows(df: DataFrame, text: str, label: str, weight: str | None, classes: Sequence[int], ahead: Sequence[Transformer] = ()) -> Iterator[DataFrame]:
    """Words, class and weight of the labelled texts, kept while the passes of a fit read them.

    Stages ``ahead`` that need no fit are applied first and their last output is kept instead: a vector has each word of a text once, as a number.
    """
    if WORDS not in df.columns:
        df = df.withColumn(WORDS, words_of(text))
    rows = df.filter(F.col(text).isNotNull()).select(WORDS, F.col(label).cast("int").alias(label)).dropna(subset=[label])
    if weight:
        rows = with_sample_weights(rows, label, weight, classes)
    # A fit passes over these rows many times: spread them over all cores, however they were read.
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    for stage in ahead:
        rows = stage.transform(rows)
    rows = (rows.drop(WORDS) if len(ahead) > 1 else rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


class SmoothedIDF(Fitter, HasInputCol, HasOutputCol):
    """Term weights tf * (ln((1 + texts) / (1 + df)) + 1): the added 1 keeps words that occur everywhere.

    Fits to a plain per-feature scaling, so vectors stay sparse and the model is a built-in stage.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ElementwiseProduct:
        fitted = IDF(inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(df)
        scale = Vectors.dense(fitted.idf.toArray() + 1.0)
        return ElementwiseProduct(scalingVec=scale, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def vectoriser(text: str, kind: str, n_features: int | None = None) -> list:
    """Stages from text to ``features``: ``counts`` or ``tfidf``.

    Without ``n_features`` every word is a feature and the vocabulary lives in the model. For
    corpora whose vocabulary does not fit a driver give a power of two: words are then hashed.
    """
    stages = [ContentWords(inputCol=text, outputCol=WORDS)]
    out = "features" if kind == "counts" else "_tf"
    if n_features:
        stages.append(HashingTF(inputCol=WORDS, outputCol=out, numFeatures=n_features))
    else:
        stages.append(CountVectorizer(inputCol=WORDS, outputCol=out, vocabSize=2**31 - 1))
    if kind == "tfidf":
        stages += [SmoothedIDF(inputCol="_tf", outputCol="_weighted"), Normalizer(inputCol="_weighted", outputCol="features")]
    elif kind != "counts":
        raise ValueError(f"unknown text features {kind!r}")
    return stages


# The reference's settings of each classifier, and the ranges that it searches.
SETTINGS = {
    "naive_bayes": {"smoothing": NAIVE_BAYES_SMOOTHING},
    "logistic_regression": {"maxIter": 1000, "regParam": 0.01, "family": "multinomial"},
    "boosted_trees": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "decision_tree": {"maxDepth": 10},
    "random_forest": {"numTrees": 100},
    "linear_svm": {"maxIter": 1000},
    "perceptron": {"maxIter": 100},
}
HIDDEN_LAYERS = (1000, 5000)
# Rows are learned from in blocks, and each block of sparse rows costs a pass over all coefficients: few large blocks. Only rounding depends on it.
BLOCK_MB = 32.0
GRIDS = {
    "logistic_regression": {"regParam": (0.01, 1.0)},
    "boosted_trees": {"maxDepth": (6, 8, 10), "maxIter": (200, 300, 220), "stepSize": (0.1, 0.2)},
    "decision_tree": {"maxDepth": (10, 20, 28), "impurity": ("entropy", "gini")},
}


def classifier(name: str, label: str, n_classes: int, weight: str | None = None, **settings):
    """The named estimator; ``settings`` replace those of `SETTINGS`."""
    if name not in SETTINGS or name == "perceptron":
        raise ValueError(f"unknown classifier {name!r}")
    chosen = {**SETTINGS[name], **settings}
    weighted = {"weightCol": weight} if weight else {}
    if name == "naive_bayes":
        return NaiveBayes(labelCol=label, **chosen, **weighted)
    if name == "logistic_regression":
        return LogisticRegression(labelCol=label, **{"maxBlockSizeInMB": BLOCK_MB, **chosen}, **weighted)
    if name == "boosted_trees":
        if n_classes > 2:
            return BoostedTrees(labelCol=label, nClasses=n_classes, seed=SEED, **chosen, **weighted)
        return GBTClassifier(labelCol=label, seed=SEED, **chosen, **weighted)
    if name == "decision_tree":
        return DecisionTreeClassifier(labelCol=label, seed=SEED, **chosen, **weighted)
    if name == "random_forest":
        return RandomForestClassifier(labelCol=label, seed=SEED, **chosen, **weighted)
    svm = LinearSVC(labelCol=label, **chosen)
    return OneVsRest(classifier=svm, labelCol=label, parallelism=PARALLEL_FITS, **weighted)


def perceptron(
    label: str, n_features: int, n_classes: int, hidden: Sequence[int] = HIDDEN_LAYERS, **settings
) -> MultilayerPerceptronClassifier:
    """Feed-forward net; the number of hashed features fixes its input layer."""
    layers = [n_features, *hidden, n_classes]
    return MultilayerPerceptronClassifier(labelCol=label, layers=layers, seed=SEED, **{**SETTINGS["perceptron"], **settings})


@dataclass(frozen=True)
class Estimator:
    """A cell of the model matrix: text features x classifier.

    ``settings`` (pairs of name and value) replace those of `SETTINGS`; for the perceptron also ``hidden``, its hidden layers.
    """

    features: str = "tfidf"
    classifier: str = "boosted_trees"
    n_features: int | None = None
    settings: tuple[tuple[str, object], ...] = ()

    @property
    def name(self) -> str:
        return f"{self.features}-{self.classifier}"


MODEL_MATRIX = tuple(
    Estimator(f, c) for f in ("counts", "tfidf") for c in ("naive_bayes", "logistic_regression", "boosted_trees")
)


def _relational(estimator: Estimator) -> bool:
    """Naive Bayes on counts is a table, whatever the vocabulary; with ``n_features`` or other weights it is a pipeline."""
    return (estimator.features, estimator.classifier, estimator.n_features) == ("counts", "naive_bayes", None)


def _long(df: DataFrame, text: str, label: str) -> DataFrame:
    """(words, attr, class): the labelled texts as rows to learn from."""
    words = F.col(WORDS) if WORDS in df.columns else words_of(text)
    rows = df.filter(F.col(text).isNotNull()).select(words.alias("words"), F.lit(label).alias("attr"), F.col(label).cast("int").alias("class"))
    return rows.dropna(subset=["class"])


def _stages(estimator: Estimator, text: str, label: str, n_classes: int, weight: str | None) -> tuple[list, list, Fitter]:
    """The stages that need no fit, the others up to the features, and the classifier."""
    if estimator.classifier == "perceptron":
        if not estimator.n_features:
            raise ValueError("the perceptron needs n_features")
        model = perceptron(label, estimator.n_features, n_classes, **dict(estimator.settings))
    else:
        model = classifier(estimator.classifier, label, n_classes, weight, **dict(estimator.settings))
    stages = vectoriser(text, estimator.features, estimator.n_features)
    n = 2 if estimator.n_features else 1  # hashing needs no fit either
    return stages[:n], stages[n:], model


def fit(
    df: DataFrame,
    text: str,
    label: str,
    classes: Sequence[int],
    estimator: Estimator = Estimator(),
    weighted: bool = True,
):
    """Train ``text -> label`` on encoded classes 0..n-1. ``weighted`` balances the classes."""
    if _relational(estimator):
        smoothing = dict(estimator.settings).get("smoothing", NAIVE_BAYES_SMOOTHING)
        return fit_terms(_long(df, text, label), {label: classes}, smoothing, weighted).of(label)
    weight = "_weight" if weighted and estimator.classifier != "perceptron" else None
    ahead, between, model = _stages(estimator, text, label, len(classes), weight)
    with _kept_rows(df, text, label, weight, classes, ahead) as rows:
        return PipelineModel([*ahead, *Pipeline(stages=[*between, model]).fit(rows).stages])


def grid_search(
    df: DataFrame,
    text: str,
    label: str,
    classes: Sequence[int],
    estimator: Estimator,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = FOLDS,
    parallelism: int = PARALLEL_FITS,
) -> tuple[PipelineModel, dict]:
    """The best model of a k-fold cross-validated grid by accuracy, its settings and mean accuracy.

    Without a grid that of `GRIDS` is searched. Works for any number of classes.
    """
    grid = GRIDS[estimator.classifier] if grid is None else grid
    weight = None if estimator.classifier == "perceptron" else "_weight"
    ahead, between, last = _stages(estimator, text, label, len(classes), weight)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(last.getParam(name), list(values))
    settings = builder.build()
    metric = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    with _kept_rows(df, text, label, weight, classes, ahead) as rows:
        # The folds of `CrossValidator`; but the features are learned once for a fold, not once for each of its settings.
        drawn, edges = rows.withColumn("_drawn", F.rand(SEED)), [i / folds for i in range(folds + 1)]
        found = []
        for low, high in pairwise(edges):
            held = (F.col("_drawn") >= low) & (F.col("_drawn") < high)
            learned = Pipeline(stages=between).fit(drawn.filter(~held))
            train, valid = (_features(learned, part, label, weight).persist(StorageLevel.MEMORY_AND_DISK) for part in (drawn.filter(~held), drawn.filter(held)))
            try:
                with ThreadPool(parallelism) as pool:
                    score = inheritable_thread_target(rows.sparkSession)(lambda s: metric.evaluate(last.fit(train, s).transform(valid)))
                    found.append(pool.map(score, settings))
            finally:
                train.unpersist()
                valid.unpersist()
        means = [sum(own) / folds for own in zip(*found)]
        best = max(range(len(settings)), key=lambda i: means[i])
        learned = Pipeline(stages=between).fit(rows)
        train = _features(learned, rows, label, weight)
        model = PipelineModel([*ahead, *learned.stages, last.fit(train, settings[best])])
    chosen = {p.name: v for p, v in settings[best].items()}
    return model, {"best_params": chosen, "val_acc": float(means[best])}


def _features(learned: PipelineModel, rows: DataFrame, label: str, weight: str | None) -> DataFrame:
    return learned.transform(rows).select("features", label, *([weight] if weight else []))


def predict(model, df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``probability`` (array), ``pred`` and ``conf``; models without probabilities give null."""
    if isinstance(model, TermClassifier):
        scored = _term_scored(model.model, df, text)
        probability = probabilities(class_scores(model.model, model.attr))
        pred, conf = likeliest(model.model, model.attr)
        return scored.select(*df.columns, probability.alias("probability"), pred.alias("pred"), conf.alias("conf"))
    lowered = df.withColumn("_text", F.col(text)).withColumn(text, F.lower(text))
    out = model.transform(lowered)
    if "probability" in out.columns:
        probability: Column = vector_to_array("probability")
    else:
        probability = F.lit(None).cast("array<double>")
    pred = predicted_class(probability) if "prediction" not in out.columns else F.col("prediction").cast("int")
    kept = [F.col("_text").alias(c) if c == text else F.col(c) for c in df.columns]
    return out.select(*kept, probability.alias("probability"), pred.alias("pred"), confidence(probability).alias("conf"))


def _term_scored(model, df: DataFrame, text: str) -> DataFrame:
    return term_scores(model, df, F.col(WORDS) if WORDS in df.columns else words_of(text), text)


def predict_all(models: Mapping[str, object], df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``<attr>_pred`` and ``<attr>_conf`` of each model; models that share a table of terms are joined to it once."""
    out, done = df, set()
    for a, model in models.items():
        if a in done:
            continue
        if isinstance(model, TermClassifier):
            together = [b for b, m in models.items() if isinstance(m, TermClassifier) and m.model is model.model]
            found = [(b, likeliest(model.model, models[b].attr)) for b in together]
            scored = _term_scored(model.model, out, text)
            out = scored.select(*out.columns, *[c.alias(f"{b}_{n}") for b, own in found for c, n in zip(own, ("pred", "conf"))])
            done.update(together)
        else:
            scored = predict(model, out, text)
            out = scored.select(*out.columns, F.col("pred").alias(f"{a}_pred"), F.col("conf").alias(f"{a}_conf"))
    return out


@dataclass
class Trained:
    """What training an attribute yields: the model and its confidence threshold, in hundredths."""

    attr: str
    model: object
    tau: float


def train_attribute(
    df: DataFrame,
    key: str,
    text: str,
    label: str,
    classes: Sequence[int],
    order: Column,
    tie: str,
    rules: Sequence[EditRule] = (),
    estimator: Estimator = Estimator(),
    constrained: bool = True,
    scale: float = CONFIDENCE_SCALE,
) -> Trained:
    """Split, select clean training rows, fit, and measure the threshold on the unselected validation rows."""
    parts = split_train_valid(df.dropna(subset=[label]), label, order, tie, classes=classes)
    train = parts.filter(F.col("part") == "train")
    if constrained:
        train = clean_for(train, key, text, label, rules)
    model = fit(train, text, label, classes, estimator)
    valid = predict(model, parts.filter(F.col("part") == "valid"), text)
    tau = confidence_threshold(valid, label, "pred", "conf", scale).first()["tau"]
    return Trained(label, model, round(tau or 0.0, 2))


def train_all(
    df: DataFrame, text: str, labels: Sequence[str], classes: Mapping[str, Sequence[int]], **options
) -> dict[str, Trained]:
    """One model per attribute. The loop is over attributes; each fit is a distributed job on shared words."""
    rows = with_words(df, text)
    if _relational(options.get("estimator", Estimator())):
        return _train_terms(rows, text, labels, classes, **options)
    return {a: train_attribute(rows, text=text, label=a, classes=classes[a], **options) for a in labels}


def _train_terms(
    df: DataFrame, text: str, labels: Sequence[str], classes: Mapping[str, Sequence[int]], key: str, order: Column, tie: str,
    rules: Sequence[EditRule] = (), estimator: Estimator | None = None, constrained: bool = True, scale: float = CONFIDENCE_SCALE,
) -> dict[str, Trained]:
    """All attributes learned in one grouping of words, and their thresholds measured in one prediction."""
    train, valid = [], []
    for a in labels:
        parts = split_train_valid(df.dropna(subset=[a]), a, order, tie, classes=classes[a])
        rows = parts.filter(F.col("part") == "train")
        train.append(_long(clean_for(rows, key, text, a, rules) if constrained else rows, text, a))
        valid.append(parts.filter(F.col("part") == "valid").select(text, WORDS, F.lit(a).alias("attr"), F.col(a).cast("int").alias("class")))
    smoothing = dict((estimator or Estimator()).settings).get("smoothing", NAIVE_BAYES_SMOOTHING)
    model = fit_terms(reduce(DataFrame.unionAll, train), {a: classes[a] for a in labels}, smoothing)
    scored = _term_scored(model, reduce(DataFrame.unionAll, valid), text)
    own = {a: likeliest(model, a) for a in labels}
    pred, conf = (F.coalesce(*[F.when(F.col("attr") == a, found[i]) for a, found in own.items()]) for i in (0, 1))
    per_class = scored.groupBy("attr", "class").agg(F.coalesce(F.avg(F.when(pred == F.col("class"), conf)), F.lit(0.0)).alias("m"))
    taus = {r["attr"]: r["tau"] for r in per_class.groupBy("attr").agg((F.avg("m") * scale).alias("tau")).collect()}
    return {a: Trained(a, model.of(a), round(taus.get(a) or 0.0, 2)) for a in labels}


def best_model(metrics: DataFrame, keys: Sequence[str], score: str = "f1") -> DataFrame:
    """The best-scoring model per dataset."""
    return best_by(metrics, keys, score, ["model"])
