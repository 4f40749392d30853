"""Projection, null handling, domain and edit-rule checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.evidence import contradicts, row_is_supported
from tablemend.spec import NULL_SENTINEL, NULL_SYMBOLS, EditRule, Value, rules_about


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def project_away(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_texts(df: DataFrame, text: str, longer_than: int = 1) -> DataFrame:
    return df.filter(F.length(text) > longer_than)


def in_domain(df: DataFrame, domains: Mapping[str, Sequence[Value]]) -> DataFrame:
    """Rows whose attributes all hold an allowed value."""
    return df.filter(reduce(lambda x, y: x & y, [F.col(a).isin(*d) for a, d in domains.items()]))


def violates(rules: Sequence[EditRule]) -> Column:
    """True where any rule is broken."""
    return reduce(lambda x, y: x | y, [r.violated() for r in rules], F.lit(False))


def satisfying(df: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    return df.filter(~violates(rules))


def violating(df: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    return df.filter(violates(rules))


def satisfying_about(df: DataFrame, rules: Sequence[EditRule], attr: str) -> DataFrame:
    """Rows that break no rule about ``attr``: one fused filter."""
    return satisfying(df, rules_about(rules, attr))


def split_counts(df: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    """Numbers of satisfying and violating rows, in one pass."""
    broken = violates(rules)
    return df.agg(
        F.count_if(~broken).alias("satisfying"), F.count_if(broken).alias("violating"), F.count("*").alias("total")
    )


def violated_rules(rules: Sequence[EditRule]) -> Column:
    """Ids (positions) of the rules a row breaks."""
    marks = [F.when(r.violated(), F.lit(i)) for i, r in enumerate(rules)]
    return F.array_compact(F.array(*marks))


def violation_list(df: DataFrame, rules: Sequence[EditRule], keys: Sequence[str]) -> DataFrame:
    """The violating rows' keys with the ids of all rules they break."""
    return df.select(*keys, violated_rules(rules).alias("rule_ids")).filter(F.size("rule_ids") > 0)


def violation_counts(df: DataFrame, rules: Sequence[EditRule]) -> DataFrame:
    """Violations per rule, rules without any included: one global aggregate, unfolded afterwards."""
    counts = df.agg(*[F.count_if(r.violated()).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(i).alias("rule_id"), F.col(f"r{i}").alias("violations")) for i in range(len(rules))]
    return counts.select(F.inline(F.array(*rows)))


def drop_contradictions(df: DataFrame, text: str, keyword: str, label: str) -> DataFrame:
    return df.filter(~contradicts(F.col(text), keyword, F.col(label)))


def keep_supported(df: DataFrame, labels: Sequence[str], inclusion: str, exclusion: str, **options) -> DataFrame:
    """Rows whose labels agree with the inclusion and exclusion texts."""
    return df.filter(row_is_supported(labels, F.col(inclusion), F.col(exclusion), **options))


def null_symbols(df: DataFrame, symbols: Sequence[str] = NULL_SYMBOLS) -> DataFrame:
    """Every string cell that is a null symbol becomes null."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char")}
    return df.select(
        *[F.when(~F.col(c).isin(*symbols), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def null_sentinel(df: DataFrame, columns: Sequence[str], sentinel: str = NULL_SENTINEL) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def impute(df: DataFrame, columns: Sequence[str], value: Value = 0) -> DataFrame:
    return df.fillna({c: value for c in columns})


def snapshot(df: DataFrame, columns: Sequence[str], suffix: str = "_orig") -> DataFrame:
    """Copies of the columns before they are repaired; no self join needed."""
    return df.withColumns({c + suffix: F.col(c) for c in columns})
