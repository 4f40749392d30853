"""Secrets in versioned texts, with a ledger of what has been scanned.

Every historical version of a path is addressed by the hash of its content (a blob). The ledger holds the findings of each
pair of blob and rule version. A run scans only pairs that the ledger lacks, each blob once, and then joins the
findings back to all paths and versions that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tablemend.llm.common import stored, text_slices
from tablemend.operators.joins import join_per_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that do not overlap, of which those with a short ``group`` drop."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base kinds, in the order in which they are listed.
# A run of 32 or more hexadecimal digits is the same match as a longest run that turns out to have 32 or more;
# likewise 12 or more characters after AKIA.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    # It starts where a run of its characters starts, so that no run is read again from each eyJ within.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]+)@", 1, 4),
)
RULES = BASE + ADDED
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
FINDING = StructType([StructField("blob", StringType()), StructField("spans", ArrayType(SPAN))])


def rules_version(rules: Sequence[Rule] = RULES) -> str:
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def spans_of(text: str, rules: Sequence[tuple[Rule, re.Pattern[str]]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    found = []
    for k, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.shortest:
                found.append((m.start(), k, m.end(), rule.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of every row of ``blobs`` (blob, text)."""
    arrow = to_arrow_schema(FINDING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        for batch, texts in text_slices(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", compiled)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("blob")), pa.array(spans, arrow[1].type)], schema=arrow)

    return blobs.select("blob", "text").mapInArrow(run, FINDING)


def _ledger(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Findings of the rule version, one row for each blob however often it was written; none where nothing has been written."""
    try:
        found = spark.read.schema(FINDING).parquet(f"{path}/rules={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDING)
    return found.groupBy("blob").agg(F.any_value("spans").alias("spans"))


def scan_history(versions: DataFrame, path: Sequence[str], text: str, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``versions`` without its text, with ``blob`` and ``spans`` (kind, start, end) of the version's content.

    ``path``: the columns that name a version (such as file and revision), kept beside the result; other columns are
    dropped. A path column of the name ``blob`` or ``spans`` keeps it, and the result's own column is called ``blob_`` or
    ``spans_``. ``ledger``: a folder in a store that all executors share; one sub-folder for each rule version,
    added to by each run. Writers that scan one blob at the same time leave several lines for it, which count as one.
    A null text counts as empty; a very long one is scanned whole, in time linear in its length. Rows repeated whole give
    repeated rows; an empty table gives an empty result. Copies are scanned once: a blob's representative is its smallest
    path, picked by an aggregate of hashes, so a group with a third of all rows moves no more text than any other rows.
    """
    spark, version = versions.sparkSession, rules_version(rules)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = versions.select(F.struct(*path).alias("path"), content.alias("text"))
    keyed = keyed.withColumn("blob", F.sha2("text", 256)).withColumn("spot", F.xxhash64("path", "blob"))
    known = _ledger(spark, ledger, version)
    fresh = keyed.groupBy("blob").agg(F.min("spot").alias("spot")).join(known.select("blob"), "blob", "left_anti")
    picked = keyed.select("spot", "blob", "text").join(fresh.withColumnRenamed("blob", "own"), "spot").where("blob = own")
    found = scan(picked, rules)
    # Whole copies of one row, path included, all stand for their blob; the ledger takes one line for it.
    found = found.groupBy("blob").agg(F.max("spans").alias("spans"))
    found.write.mode("append").option("compression", "zstd").parquet(f"{ledger}/rules={version}")
    known = _ledger(spark, ledger, version)
    joined = join_per_key(keyed.select("path", "blob"), known, ["blob"], "left")
    taken = {c.lower() for c in path}
    own = [F.col(c).alias(c + "_" if c in taken else c) for c in ("blob", "spans")]
    return joined.select(*[F.col("path")[c].alias(c) for c in path], *own)
