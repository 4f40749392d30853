"""Trained models on shared storage, keyed by attribute, model and strategy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tablemend.operators.term_models import TermClassifier, load_terms, save_terms


def model_path(root: str, attr: str, model: str, strategy: str) -> str:
    return f"{root.rstrip('/')}/{strategy}/{model}/{attr}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_model(model: PipelineModel | TermClassifier, path: str) -> None:
    if isinstance(model, TermClassifier):
        save_terms(model, path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | TermClassifier:
    spark = SparkSession.active()
    if _exists(spark, f"{path}/terms"):
        return load_terms(spark, path)
    return PipelineModel.load(path)


def load_or_train(spark: SparkSession, path: str, train: Callable[[], PipelineModel | TermClassifier]) -> PipelineModel | TermClassifier:
    """The stored model; trained and stored first where it is missing."""
    if not _exists(spark, f"{path}/metadata/_SUCCESS"):
        save_model(train(), path)
    return load_model(path)
