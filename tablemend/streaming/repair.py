"""Rule checks and the confidence gate are row expressions, so they hold for streams as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablemend.operators.filters import violated_rules
from tablemend.operators.repair import gated_repair
from tablemend.spec import EditRule


def mark_violations(stream: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    """Each row with the ids of the rules it breaks."""
    return stream.withColumn("rule_ids", violated_rules(rules))


def repair_stream(stream: DataFrame, attr: str, threshold: float, predicted: str = "pred", confidence: str = "conf") -> DataFrame:
    return gated_repair(stream, attr, threshold, predicted, confidence)


def append_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, each row once; the checkpoint lies on shared storage."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def violating_rows(stream: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    return mark_violations(stream, rules).filter(F.size("rule_ids") > 0)
