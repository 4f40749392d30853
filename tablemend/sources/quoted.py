"""Delimited files whose quoted cells hold line breaks, read by many tasks.

A task that starts in the middle of a file cannot tell whether it starts within a cell. The quotes before it can: it does if their number is
odd. So the quotes of each split are counted first; running sums over the splits of a file, one row each, give every split its start. Lines are then put
together to records where they are; only the pieces of a record that crosses splits meet, two for a split at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record, or a piece of one: of the record open at the split's start (head) or at its end (tail), or of one that does not end in the split (through).
PIECES = "file string, split long, kind string, first boolean, text string"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.option("lineSep", "\n").text(list(paths)).select("value", *meta)


def _starts(lines: DataFrame, quote: str) -> DataFrame:
    """(file, split, open): whether a split starts within a quoted cell. One row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote)))
    odd = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _pieces(lines: DataFrame, quote: str) -> DataFrame:
    """Whole records, and pieces of records that cross splits. The lines of a split come to one task, in order."""
    # One row per split of some megabytes: a millionth of the table, and not shuffled with the lines, whose order counts.
    located = lines.join(F.broadcast(_starts(lines, quote)), ["file", "split"], "left").select("file", "split", "open", "value")
    sign = quote.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, crossing, ended, parts = None, False, False, False, []

        def close() -> list[tuple]:
            """What is open at the end of a split: nothing, the start of a record, or a stretch within one."""
            if at is None or not parts:
                return []
            return [(*at, "through" if crossing and not ended else "tail", at[1] == 0 and not ended, "\n".join(parts))]

        for batch in batches:
            rows = []
            files, splits, opens = (batch.column(i) for i in range(3))
            new = np.concatenate([[True], np.diff(splits.to_numpy()) != 0]) if batch.num_rows else np.empty(0, bool)
            if batch.num_rows:
                new[1:] |= pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            values = batch.column(3).to_pylist()
            for i, line in enumerate(values):
                if new[i]:
                    here = (files[i].as_py(), splits[i].as_py())
                    if here != at:
                        rows += close()
                        at, inside, ended, parts = here, bool(opens[i].as_py()), False, []
                        crossing = inside
                parts.append(line)
                inside ^= line.encode().count(sign) % 2 == 1
                if not inside:
                    rows.append((*at, "head" if crossing and not ended else "whole", at[1] == 0 and not ended, "\n".join(parts)))
                    parts, ended = [], True
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHAPE.types)], schema=SHAPE)
        rows = close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHAPE.types)], schema=SHAPE)

    return located.mapInArrow(run, PIECES)


SHAPE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("text", pa.string())])


def records(spark: SparkSession, paths: Sequence[str], quote: str = '"') -> DataFrame:
    """(file, first, text): the records of the files, as text; ``first``: whether a record is the first one of its file.

    Quotes stand in quoted cells only, doubled within them. Empty lines are no records; a line break may be LF or CR LF. A cell that is still open at the
    end of a file ends there.
    """
    pieces = _pieces(_lines(spark, paths), quote)
    parts = pieces.where("kind <> 'whole'")
    # The pieces of a record: the tail that opened it, stretches through whole splits, and the head in which it ends.
    before = Window.partitionBy("file").orderBy("split", F.col("kind") == "tail")
    opened = F.max(F.when(F.col("kind") == "tail", F.col("split"))).over(before)
    pasted = parts.withColumn("opened", opened).groupBy("file", "opened").agg(
        F.max(F.col("first") & (F.col("kind") == "tail")).alias("first"), F.sort_array(F.collect_list(F.struct("split", (F.col("kind") == "tail").alias("is_tail"), "text"))).alias("p")
    )
    pasted = pasted.select("file", "first", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = pieces.where("kind = 'whole'").select("file", "first", "text").unionByName(pasted)
    return every.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")


def read_quoted(
    spark: SparkSession, paths: Sequence[str], sep: str, quote: str, escape: str, schema=None, options: dict[str, str] | None = None
) -> DataFrame:
    """The files as a table; names come from the first file's header, unless there is a schema. Every file has a header."""
    every = records(spark, paths, quote)
    given = {"sep": sep, "quote": quote, "escape": escape, "multiLine": "true", "nullValue": "", "emptyValue": "", **(options or {})}
    if schema is None:
        head = every.where("first").orderBy("file").select("text").first()
        if head is None:
            return spark.createDataFrame([], "value string").drop("value")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(spark, head["text"], given)])
    cells = F.from_csv("text", _ddl(schema), given)
    return every.where("NOT first").select(cells.alias("c")).select("c.*")


def _names(spark: SparkSession, header: str, options: dict[str, str]) -> list[str]:
    """Names of the columns: an empty one is named by its place, and one that comes again gets its place appended."""
    line = F.lit(header.replace("\n", " ").removeprefix("\ufeff"))
    kinds = spark.range(1).select(F.schema_of_csv(line, options).alias("s")).first()["s"]
    fields = len(T._parse_datatype_string(kinds).fields)
    wanted = ", ".join(f"_c{i} string" for i in range(fields))
    given = list(spark.range(1).select(F.from_csv(line, wanted, options).alias("c")).first()["c"])
    seen = [n.lower() for n in given if n]
    return [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(given)]


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
