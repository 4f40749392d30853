"""Tables of partitions in versions: new files beside the old ones, and a manifest that says which files count.

A manifest is numbered and written once. Who publishes number n + 1 has seen number n; if another writer was first, the
publication fails and the writer starts again from the newer state. Readers take the newest manifest and see all of a
version or nothing of it. Only names of partitions pass through the driver. This is as safe as the file system's rename
without overwriting.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FILES, MANIFESTS, VERSION = "data", "_manifest", "v"


@dataclass(frozen=True)
class State:
    """The newest manifest: its number, and the version that holds each partition."""

    number: int = 0
    versions: Mapping[str, str] = field(default_factory=dict)


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> State:
    folder, fs = _path(spark, path, MANIFESTS)
    if not fs.exists(folder):
        return State()
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    if not numbers:
        return State()
    stream = fs.open(_path(spark, path, MANIFESTS, f"{max(numbers):020d}.json")[0])
    try:
        return State(max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, state: State) -> bool:
    """Make ``state`` the newest one; False if another writer has taken its number."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    draft, fs = _path(spark, path, MANIFESTS, f"draft-{uuid.uuid4().hex}")
    target, _ = _path(spark, path, MANIFESTS, f"{state.number:020d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(dict(state.versions)).encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    keeping = spark.sparkContext._gateway.new_array(rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, keeping)
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        fs.delete(draft, False)
        return False
    return True


def write_version(rows: DataFrame, path: str, by: Sequence[str]) -> dict[str, str]:
    """Files of a new version, which no reader sees yet: the partitions it holds, each with the version's name."""
    name = uuid.uuid4().hex
    rows.write.partitionBy(*by).parquet(f"{path}/{FILES}/{VERSION}={name}")
    pattern, fs = _path(rows.sparkSession, path, FILES, f"{VERSION}={name}", *["*"] * len(by))
    found = {}
    for status in fs.globStatus(pattern):
        leaf, parts = status.getPath(), []
        for _ in by:
            parts.append(leaf.getName())
            leaf = leaf.getParent()
        found["/".join(reversed(parts))] = name
    return found


def read_state(spark: SparkSession, path: str, state: State, schema: T.StructType | str | None = None) -> DataFrame:
    leaves = [f"{path}/{FILES}/{VERSION}={v}/{leaf}" for leaf, v in sorted(state.versions.items())]
    if schema is None:
        if not leaves:
            raise ValueError(f"{path} holds no rows: give a schema")
        return spark.read.option("basePath", f"{path}/{FILES}").parquet(*leaves).drop(VERSION)
    empty = spark.createDataFrame([], schema)
    if not leaves:
        return empty
    return spark.read.schema(schema).option("basePath", f"{path}/{FILES}").parquet(*leaves).select(*empty.columns)
