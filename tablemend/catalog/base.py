"""Tables of the catalog as DataFrames and, beside them, as SQL for the independent check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.operators.joins import attach_gold
from tablemend.operators.repair import gated
from tablemend.operators.votes import decided, majority_vote
from tablemend.spec import EditRule


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked, in the tests."""

    def register(run):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- lines: line items as rows of several sources about one part ------------------------------

ROW = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]  # unique together
ROWS = ", ".join(ROW)
FLAGS = ["finished", "returned", "bulky", "cheap"]

LINES_SQL = """
lines AS (
  SELECT l_partkey AS code, l_suppkey % 5 AS source, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
    l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
    CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_returnflag END AS flag,
    CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END END AS finished,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS bulky,
    CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS cheap,
    CASE WHEN (l_orderkey + 2 * l_linenumber) % 13 <> 0
      THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END END AS level
  FROM lineitem)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    def bit(test):
        return F.when(test, 1).otherwise(0)

    spot = F.col("l_orderkey") + F.col("l_linenumber")
    level = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("code"),
        (F.col("l_suppkey") % 5).alias("source"),
        *ROW,
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(spot % 11 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(spot % 11 != 0, bit(F.col("l_linestatus") == "F")).alias("finished"),
        bit(F.col("l_returnflag") == "R").alias("returned"),
        bit(F.col("l_quantity") > 25).alias("bulky"),
        bit(F.col("l_discount") > 0.05).alias("cheap"),
        F.when((F.col("l_orderkey") + 2 * F.col("l_linenumber")) % 13 != 0, level).alias("level"),
    )


RULES = (
    EditRule.of(finished=0, returned=1),
    EditRule.of(bulky=0, cheap=1),
    EditRule.of(returned=1, level=0),
)
RULE_SQL = (
    "coalesce(finished = 0 AND returned = 1, false)",
    "coalesce(bulky = 0 AND cheap = 1, false)",
    "coalesce(returned = 1 AND level = 0, false)",
)
BROKEN_SQL = "(" + " OR ".join(RULE_SQL) + ")"
DOMAINS = {"finished": (0, 1), "returned": (0, 1), "bulky": (0, 1), "cheap": (0, 1), "level": (0, 1, 2)}

# --- gold: parts whose sources decide every flag ----------------------------------------------

VOTES_SQL = "votes AS (SELECT code, " + ", ".join(
    f"count(*) FILTER (WHERE {a} = 1) AS {a}_yes, count(*) FILTER (WHERE {a} = 0) AS {a}_no" for a in FLAGS
) + " FROM lines GROUP BY code)"
GOLD_SQL = (
    VOTES_SQL
    + ", gold AS (SELECT code, "
    + ", ".join(f"CASE WHEN {a}_yes > {a}_no THEN 1 ELSE 0 END AS {a}" for a in FLAGS)
    + " FROM votes WHERE "
    + " AND ".join(f"{a}_yes <> {a}_no" for a in FLAGS)
    + ")"
)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return decided(majority_vote(lines(spark, sf), "code", FLAGS), "code", FLAGS)


# --- cells: lines beside their gold values, a rule-made prediction and its confidence ----------

CELLS_SQL = """
cells AS (
  SELECT l.*, g.finished AS finished_gs, g.returned AS returned_gs, g.bulky AS bulky_gs, g.cheap AS cheap_gs,
    CASE WHEN l.l_quantity > 20 THEN 1 ELSE 0 END AS finished_pred,
    CASE WHEN l.l_tax > 0.04 THEN 1 ELSE 0 END AS bulky_pred,
    ((l.l_orderkey * 7 + l.l_linenumber) % 101) / 100.0::DOUBLE AS finished_conf,
    ((l.l_orderkey * 3 + l.l_suppkey) % 101) / 100.0::DOUBLE AS bulky_conf
  FROM lines l JOIN gold g USING (code))"""
GATED = ["finished", "bulky"]
GATE = {"finished": 0.6, "bulky": 0.8}
REPAIRED_SQL = "repaired AS (SELECT *, " + ", ".join(
    f"CASE WHEN {a}_conf >= {GATE[a]}::DOUBLE OR {a} IS NULL THEN {a}_pred ELSE {a} END AS {a}_rep" for a in GATED
) + " FROM cells)"
ALL_SQL = f"WITH {LINES_SQL}, {GOLD_SQL}, {CELLS_SQL}, {REPAIRED_SQL}"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    order, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    return attach_gold(lines(spark, sf), gold(spark, sf), "code", FLAGS).withColumns(
        {
            "finished_pred": F.when(F.col("l_quantity") > 20, 1).otherwise(0),
            "bulky_pred": F.when(F.col("l_tax") > 0.04, 1).otherwise(0),
            "finished_conf": ((order * 7 + line) % 101) / F.lit(100.0),
            "bulky_conf": ((order * 3 + supplier) % 101) / F.lit(100.0),
        }
    )


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    gate = {
        f"{a}_rep": gated(F.col(a), F.col(f"{a}_pred"), F.col(f"{a}_conf"), GATE[a]) for a in GATED
    }
    return cells(spark, sf).withColumns(gate)


def counters_sql(a: str, original: str, gold: str, final: str) -> str:
    """The three cell counters of one attribute."""
    return (
        f"count(*) FILTER (WHERE {original} IS DISTINCT FROM {gold}) AS errors, "
        f"count(*) FILTER (WHERE {original} IS DISTINCT FROM {final}) AS repairs, "
        f"count(*) FILTER (WHERE {original} IS DISTINCT FROM {final} AND {final} IS NOT DISTINCT FROM {gold}) AS correct"
    )


QUALITY_SQL = """
  CASE WHEN repairs = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / repairs::DOUBLE END AS precision,
  CASE WHEN errors = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / errors::DOUBLE END AS recall"""


def quality_sql(source: str, columns: str) -> str:
    """Precision, recall and F1 over a relation of counters."""
    return f"""
      SELECT {columns}, errors, repairs, correct, precision, recall,
        CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
          ELSE 2 * (precision * recall) / (precision + recall) END AS f1
      FROM (SELECT *, {QUALITY_SQL} FROM {source})"""


# --- notes: labelled documents ----------------------------------------------------------------

NOTES_SQL = """
notes AS (SELECT d.doc_id, d.doc_id % 50 AS entity, d.source, d.text, d.lang, x.quality, x.toxic
  FROM documents d JOIN labels x USING (doc_id))"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        "doc_id", (F.col("doc_id") % 50).alias("entity"), "source", "text", "lang", "quality", "toxic"
    )


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that `notes` leaves out, as its rows with null labels: what models are to fill."""
    labels = table(spark, sf, "labels")
    rest = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_anti")
    empty = [F.lit(None).cast(labels.schema[a].dataType).alias(a) for a in ("quality", "toxic")]
    return rest.select("doc_id", (F.col("doc_id") % 50).alias("entity"), "source", "text", "lang", *empty)
