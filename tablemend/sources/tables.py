"""CSV and JDBC tables, typed reads, and the roles a table plays in a repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.operators.filters import null_symbols
from tablemend.operators.selection import test_table, training_table
from tablemend.sources.quoted import read_quoted
from tablemend.spec import NULL_SYMBOLS, RepairSpec


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ",",
    quote: str | None = '"',
    symbols: Sequence[str] = NULL_SYMBOLS,
    schema: T.StructType | str | None = None,
    line_breaks: bool = True,
    escaped: bool = False,
    stray_quotes: bool = False,
) -> DataFrame:
    """CSV with a header, one file or many; every null symbol becomes null. All text without a schema.

    Cells may hold line breaks; files are split between tasks all the same, by counting quotes (`quoted.records`). Where quotes also stand unescaped in
    unquoted cells, say ``stray_quotes``: then a file is one task. ``line_breaks=False`` saves the counting for files known to have none.
    ``escaped``: the files come from `write_csv`, which writes line breaks as ``\\n``; they are split between tasks, and texts are
    read back as they were.
    """
    line_breaks = line_breaks and not escaped
    reader = spark.read.option("header", True).option("sep", sep).option("quote", quote or "\u0000")
    reader = reader.option("escape", quote or "\\").option("multiLine", line_breaks)
    # An unquoted empty cell is null; a quoted one is an empty text, which is a null symbol too.
    reader = reader.option("nullValue", "").option("emptyValue", "")
    if schema is not None:
        reader = reader.schema(schema)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if line_breaks and quote and not stray_quotes:
        df = read_quoted(spark, paths, sep, quote, quote, schema)
    else:
        df = reader.csv(paths)
    if escaped:
        df = df.withColumns({f.name: _unescaped(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    return null_symbols(df, symbols) if symbols else df


def _escaped(text: Column) -> Column:
    """Line breaks as two characters, and the backslash doubled."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.when(F.contains(text, F.lit("\\")), F.array_join(parts, "\\")).otherwise(text)


def inferred_schema(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ",",
    quote: str | None = '"',
    symbols: Sequence[str] = NULL_SYMBOLS,
    **options,
) -> T.StructType:
    """The narrowest of int, bigint, double, boolean and string that holds every value of a column, null symbols aside.

    All rows count, in one aggregate; only counters reach the driver. A column without values is text.
    """
    df = read_csv(spark, paths, sep, quote, symbols, **options)
    whole, number = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
    fits = {
        "int": lambda c: c.rlike(whole) & c.try_cast("int").isNotNull(),
        "bigint": lambda c: c.rlike(whole) & c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.rlike(number),
        "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
    }
    cells = {c: F.col(f"`{c}`") for c in df.columns}
    counts = [F.struct(F.count(v), *[F.count_if(fit(v)) for fit in fits.values()]) for v in cells.values()]
    row = df.agg(*counts).first() if counts else []
    schema = T.StructType()
    for c, (total, *fitting) in zip(df.columns, row):
        kind = next((k for k, n in zip(fits, fitting) if total and n == total), "string")
        schema.add(c, {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType()))
    return schema


def apply_contract(df: DataFrame, contract: Mapping[str, str | T.DataType]) -> DataFrame:
    """Named columns cast to their types, the rest untouched; what does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in contract.items() if c in df.columns})


def failed_casts(df: DataFrame, contract: Mapping[str, str | T.DataType]) -> DataFrame:
    """How many values of each contracted column do not fit its type."""
    checks = {c: F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in contract.items() if c in df.columns}
    row = df.agg(*[F.count_if(bad).alias(c) for c, bad in checks.items()])
    cells = [F.struct(F.lit(c).alias("attr"), F.col(c).alias("n_failed")) for c in checks]
    return row.select(F.inline(F.array(*cells)))


def spec_contract(spec: RepairSpec) -> dict[str, str]:
    """Repaired attributes are integers once they are codes; everything else stays text."""
    return {a: "int" for a in spec.labels if a not in spec.encoders}


def read_role(
    df: DataFrame, gold: DataFrame, spec: RepairSpec, role: str, order: Sequence[str] | None = None
) -> DataFrame:
    """The gold, training or test part of a dataset."""
    gold = gold.select(spec.partial_key, *spec.labels)
    if role == "gs":
        return gold
    if role == "train":
        if not (order or spec.order):
            raise ValueError("training rows need an order to keep the last duplicate")
        return training_table(df, gold, spec, order or [spec.order])
    if role == "test":
        return test_table(df, gold, spec)
    raise ValueError(f"unknown role {role!r}")


def suffixed(path: str, suffix: str) -> str:
    """x.csv -> x<suffix>.csv"""
    p = PurePosixPath(path)
    return str(p.with_name(p.stem + suffix + p.suffix)) if p.suffix else path + suffix


def write_csv(
    df: DataFrame, path: str, sep: str = ",", quote: str = '"', null_symbol: str = "", suffix: str = "", mode: str = "errorifexists"
) -> str:
    """Quoted CSV with a header, one file per partition; returns where it went.

    Line breaks in texts are written as ``\\n`` and ``\\r``, a backslash as two, so that a row is a line: read with ``escaped``.
    """
    target = suffixed(path, suffix)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: _escaped(F.col(f"`{c}`")) for c in texts}) if texts else df
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("quote", quote)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("quoteAll", True).option("escape", quote).option("nullValue", null_symbol).csv(target)
    return target


def jdbc_options(url: str, user: str | None = None, password: str | None = None, driver: str | None = None, **more: str) -> dict[str, str]:
    """Connection options; credentials come from the caller and are stored nowhere."""
    given = {"url": url, "user": user, "password": password, "driver": driver, **more}
    return {k: v for k, v in given.items() if v is not None}


def read_jdbc(spark: SparkSession, query: str, options: Mapping[str, str]) -> DataFrame:
    """A query scan. For parallel reads give ``dbtable`` and partition options instead of a query."""
    reader = spark.read.format("jdbc").options(**options)
    return (reader if "dbtable" in options else reader.option("query", query)).load()


def column_types(df: DataFrame, integers: Sequence[str]) -> str:
    """DDL of the given attributes of a target table: integers. All others keep the database's own type for their values."""
    return ", ".join(f"`{c}` INTEGER" for c in df.columns if c in integers)


def _whole(value: Column, name: str) -> Column:
    number = value.try_cast("int")
    lost = value.isNotNull() & (number.isNull() | ~value.try_cast("double").eqNullSafe(number.cast("double")))
    return F.when(lost, F.raise_error(F.concat(F.lit(f"{name} is no integer: "), value.cast("string")))).otherwise(number)


def write_jdbc(df: DataFrame, table: str, options: Mapping[str, str], integers: Sequence[str] = (), mode: str = "append") -> None:
    """Write with the given attributes as integers; a value that is none fails the write instead of getting lost."""
    typed = df.select(*[_whole(F.col(f"`{c}`"), c).alias(c) if c in integers else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    writer = typed.write.format("jdbc").options(**options).option("dbtable", table)
    if declared := column_types(df, integers):
        writer = writer.option("createTableColumnTypes", declared)
    writer.mode(mode).save()
