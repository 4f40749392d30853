"""Rule mining and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import ROW, query, table
from tablemend.operators import mining
from tablemend.operators.filters import violates

MINED_SQL = """mined AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  floor(l_quantity / 25)::BIGINT::VARCHAR AS band,
  CASE WHEN l_quantity >= 25 OR l_quantity = 24 AND l_linenumber = 1 THEN '1' ELSE '0' END AS large,
  CASE WHEN l_linenumber = 1 AND l_quantity < 3 THEN NULL WHEN l_linenumber = 1 AND l_quantity < 4 AND l_tax = 0 THEN 'X'
    ELSE l_returnflag END AS flag,
  l_linestatus AS status FROM lineitem)"""
ATTRS = ["band", "large", "flag", "status"]


def mined(spark, sf):
    first, quantity = F.col("l_linenumber") == 1, F.col("l_quantity")
    flag = (
        F.when(first & (quantity < 3), None)
        .when(first & (quantity < 4) & (F.col("l_tax") == 0), "X")
        .otherwise(F.col("l_returnflag"))
    )
    return table(spark, sf, "lineitem").select(
        *ROW,
        F.floor(quantity / 25).cast("string").alias("band"),
        F.when((quantity >= 25) | ((quantity == 24) & first), "1").otherwise("0").alias("large"),
        flag.alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


LONG_SQL = MINED_SQL + ", singles AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attr, {a} AS value, count(*) AS n FROM mined WHERE {a} IS NOT NULL GROUP BY {a}" for a in ATTRS
) + ")"


def _pairs(both: bool) -> str:
    chosen = [(a, b) for i, a in enumerate(ATTRS) for j, b in enumerate(ATTRS) if (i != j if both else i < j)]
    return "pairs AS (" + " UNION ALL ".join(
        f"""SELECT '{a}' AS attr1, {a} AS value1, '{b}' AS attr2, {b} AS value2, count(*) AS n_pair FROM mined
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}""" for a, b in chosen
    ) + ")"


@query(
    "association_rules",
    f"""WITH {LONG_SQL}, {_pairs(True)}, strong AS (SELECT p.*, a.n AS n1, t.n AS nt FROM pairs p
        JOIN singles a ON a.attr = attr1 AND a.value = value1 JOIN singles b ON b.attr = attr2 AND b.value = value2,
        (SELECT count(*) AS n FROM mined) t
      WHERE n_pair / t.n >= 0.3::DOUBLE AND n_pair / a.n >= 0.98::DOUBLE AND n_pair * t.n / (a.n * b.n) >= 0.9::DOUBLE)
    SELECT DISTINCT s.attr1, s.value1, s.attr2, o.value AS value2, coalesce(q.n_pair, 0)::BIGINT AS n_pair FROM strong s
    JOIN singles o ON o.attr = s.attr2 AND o.value <> s.value2
    LEFT JOIN pairs q ON q.attr1 = s.attr1 AND q.value1 = s.value1 AND q.attr2 = s.attr2 AND q.value2 = o.value
    WHERE coalesce(q.n_pair, 0) * s.nt / (s.n1 * o.n) <= 1 - 0.9::DOUBLE""",
)
def _(spark, sf):
    return mining.association_rules(mined(spark, sf), ATTRS)


IMPLIED_SQL = f"""WITH {LONG_SQL}, {_pairs(True)}, strong AS (SELECT attr1, value1, attr2, value2, n_pair, n_pair / t.n AS support,
    n_pair / a.n AS confidence, n_pair * t.n / (a.n * b.n) AS lift FROM pairs
    JOIN singles a ON a.attr = attr1 AND a.value = value1 JOIN singles b ON b.attr = attr2 AND b.value = value2, (SELECT count(*) AS n FROM mined) t
  WHERE n_pair / t.n >= 0.3::DOUBLE AND n_pair / a.n >= 0.98::DOUBLE AND n_pair * t.n / (a.n * b.n) >= 0.9::DOUBLE)"""


@query("association_implications", f"{IMPLIED_SQL} SELECT * FROM strong")
def _(spark, sf):
    return mining.implications(mined(spark, sf), ATTRS)


@query(
    "implication_violations",
    f"""{IMPLIED_SQL}, cells AS ({" UNION ALL ".join(
        f"SELECT m.*, '{a}' AS attr1, {a} AS value1, '{b}' AS attr2, {b} AS value2 FROM mined m" for a in ATTRS for b in ATTRS if a != b
    )})
    SELECT DISTINCT {", ".join(f"c.{c}" for c in ROW)} FROM cells c JOIN strong s ON c.attr1 = s.attr1 AND c.value1 = s.value1 AND c.attr2 = s.attr2
    WHERE c.value2 <> s.value2""",
)
def _(spark, sf):
    """Rows that break a mined implication, checked without a list of the values that it rules out."""
    rows = mined(spark, sf)
    rules = mining.as_implications(mining.implications(rows, ATTRS), rows.schema)
    return rows.filter(violates(rules)).select(*ROW)


@query(
    "low_lift_pairs",
    f"""WITH {LONG_SQL}, {_pairs(False)} SELECT attr1, value1, attr2, value2, n_pair, n_pair / least(a.n, b.n) AS lift FROM pairs
    JOIN singles a ON a.attr = attr1 AND a.value = value1 JOIN singles b ON b.attr = attr2 AND b.value = value2
    WHERE n_pair / least(a.n, b.n) < 0.2::DOUBLE""",
)
def _(spark, sf):
    return mining.low_lift_pairs(mined(spark, sf), ATTRS, 0.2)


NUMBERS = ["l_linenumber", "l_quantity", "l_discount"]


@query(
    "rare_orderings",
    "WITH r AS (" + " UNION ALL ".join(
        f"""SELECT '{a}' AS attr1, '{sign}' AS ordering, '{b}' AS attr2, count(*) FILTER (WHERE {a} {sign} {b}) AS n_rows,
        count(*) FILTER (WHERE {a} {sign} {b}) / count(*) AS share FROM lineitem"""
        for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:] for sign in ("<", "=", ">")
    ) + ") SELECT * FROM r WHERE share < 0.1::DOUBLE",
)
def _(spark, sf):
    return mining.rare_orderings(table(spark, sf, "lineitem"), NUMBERS, 0.1)


@query(
    "zscore_outliers",
    """WITH s AS (SELECT avg(value) AS m, stddev(value) AS s, avg(user_id) AS mu, stddev(user_id) AS su FROM events)
    SELECT event_id, 'value' AS attr, value, round((value - m) / s, 6) AS z FROM events, s WHERE abs((value - m) / s) > 2
    UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE, round((user_id - mu) / su, 6) FROM events, s
    WHERE abs((user_id - mu) / su) > 2""",
)
def _(spark, sf):
    found = mining.zscores(table(spark, sf, "events"), ["event_id"], ["value", "user_id"], 2.0)
    return found.withColumn("z", F.round("z", 6))


@query(
    "isolation_forest_draw",
    "SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL ORDER BY md5('0|' || event_id) LIMIT 2560",
)
def _(spark, sf):
    """The rows that a forest of ten trees is grown on."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "value").dropna(subset=["user_id", "value"])
    return mining.smallest_hashes(rows, ["event_id"], 10 * 256).drop("_hash")


@query("isolation_forest_outliers")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "value")
    return mining.isolation_forest(rows, ["user_id", "value"], key=["event_id"])


