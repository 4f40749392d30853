"""Joins, set operations and row alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import (
    ALL_SQL,
    FLAGS,
    GATED,
    GOLD_SQL,
    LINES_SQL,
    ROW,
    ROWS,
    gold,
    lines,
    query,
    repaired,
    table,
)
from tablemend.operators import joins, sets

GOLDEN = f"WITH {LINES_SQL}, {GOLD_SQL}"


@query("entities_outside_gold", f"{GOLDEN} SELECT {ROWS} FROM lines WHERE code NOT IN (SELECT code FROM gold)")
def _(spark, sf):
    return joins.without_entities(lines(spark, sf), gold(spark, sf), "code").select(*ROW)


@query("entities_inside_gold", f"{GOLDEN} SELECT {ROWS} FROM lines WHERE code IN (SELECT code FROM gold)")
def _(spark, sf):
    return joins.with_entities(lines(spark, sf), gold(spark, sf), "code").select(*ROW)


@query(
    "attach_gold_values",
    f"{GOLDEN} SELECT {ROWS}, l.finished, g.finished AS finished_gs, g.cheap AS cheap_gs FROM lines l JOIN gold g USING (code)",
)
def _(spark, sf):
    out = joins.attach_gold(lines(spark, sf), gold(spark, sf), "code", ["finished", "cheap"])
    return out.select(*ROW, "finished", "finished_gs", "cheap_gs")


@query(
    "gold_per_source",
    f"""WITH {LINES_SQL}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {ROWS}) AS r
      FROM lines WHERE finished IS NOT NULL) WHERE r = 1)
    SELECT l.code, l.source, f.finished, f.returned FROM lines l JOIN firsts f USING (code)""",
)
def _(spark, sf):
    rows = lines(spark, sf)
    standard = rows.filter(F.col("finished").isNotNull()).select("code", *ROW, "finished", "returned")
    out = joins.expand_gold(rows, standard, "code", "source", ROW)
    return out.select("code", "source", "finished", "returned")


MATCH_SQL = f"""{ALL_SQL},
  keyed AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(finished_rep) AS f, any_value(bulky_rep) AS b
    FROM repaired GROUP BY l_orderkey, l_linenumber),
  golden AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(g.finished) AS f, any_value(g.bulky) AS b
    FROM lines l JOIN gold g USING (code) GROUP BY l_orderkey, l_linenumber),
  matched AS (SELECT l.l_orderkey, l.l_linenumber, l.finished, l.bulky, golden.f AS finished_gs, golden.b AS bulky_gs,
      keyed.f AS finished_rep, keyed.b AS bulky_rep,
      CASE WHEN golden.n IS NULL THEN 'none' WHEN golden.n > 1 THEN 'multiple'
        WHEN keyed.n IS NULL THEN 'none' WHEN keyed.n > 1 THEN 'multiple' ELSE 'ok' END AS match_status
    FROM lines l LEFT JOIN golden USING (l_orderkey, l_linenumber) LEFT JOIN keyed USING (l_orderkey, l_linenumber))"""


def matched(spark, sf):
    rows = lines(spark, sf)
    standard = joins.attach_gold(rows.select("code", *ROW[:2]), gold(spark, sf), "code", GATED, "")
    fixed = repaired(spark, sf).select(*ROW[:2], *[F.col(f"{a}_rep").alias(a) for a in GATED])
    return joins.match_three(rows, standard, fixed, ROW[:2], GATED)


@query("three_way_match", f"{MATCH_SQL} SELECT * FROM matched WHERE match_status = 'ok'")
def _(spark, sf):
    return matched(spark, sf).filter("match_status = 'ok'")


@query("three_way_match_counts", f"{MATCH_SQL} SELECT match_status, count(*) AS n_rows FROM matched GROUP BY match_status")
def _(spark, sf):
    return joins.match_counts(matched(spark, sf))


@query(
    "inner_join_using",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, o_orderpriority, c_mktsegment
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = table(spark, sf, "lineitem").join(orders, "l_orderkey").join(customers, "o_custkey")
    return joined.select(*ROW, "o_orderpriority", "c_mktsegment")


PER_SOURCE = "per AS (SELECT code, source, count(*) AS n_rows FROM lines WHERE returned = 1 GROUP BY code, source)"


@query(
    "left_join_composite",
    f"WITH {LINES_SQL}, {PER_SOURCE} SELECT {ROWS}, p.n_rows FROM lines l LEFT JOIN per p USING (code, source)",
)
def _(spark, sf):
    rows = lines(spark, sf)
    per = rows.filter("returned = 1").groupBy("code", "source").agg(F.count("*").alias("n_rows"))
    return joins.join_per_key(rows, per, ["code", "source"]).select(*ROW, "n_rows")


@query(
    "right_join_known_keys",
    """SELECT p_partkey, sum(l_linenumber)::BIGINT AS n_lines FROM (SELECT * FROM lineitem WHERE l_quantity > 45)
    RIGHT JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NOT NULL GROUP BY p_partkey""",
)
def _(spark, sf):
    big = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    joined = big.join(table(spark, sf, "part").select("p_partkey"), "p_partkey", "right").filter("p_partkey IS NOT NULL")
    return joined.groupBy("p_partkey").agg(F.sum("l_linenumber").alias("n_lines"))


@query(
    "registry_agreement",
    f"""WITH {LINES_SQL}, a AS (SELECT DISTINCT code, {', '.join(FLAGS)} FROM lines WHERE source < 3),
      b AS (SELECT DISTINCT code, {', '.join(FLAGS)} FROM lines WHERE source >= 3)
    SELECT DISTINCT a.* FROM a JOIN b ON a.code = b.code AND {' AND '.join(f'a.{x} = b.{x}' for x in FLAGS)}""",
)
def _(spark, sf):
    rows = lines(spark, sf)
    left = rows.filter("source < 3").select("code", *FLAGS).distinct()
    return joins.agreement(left, rows.filter("source >= 3"), "code", FLAGS)


@query(
    "merge_gold_into_descriptions",
    f"""{GOLDEN}, names AS (SELECT p_partkey AS code, p_name, p_size AS bulky FROM part)
    SELECT code, p_name, g.bulky, g.finished, g.returned, g.cheap FROM names JOIN gold g USING (code)""",
)
def _(spark, sf):
    names = table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"), "p_name", F.col("p_size").alias("bulky")
    )
    return joins.merge_entities(names, gold(spark, sf), "code", FLAGS)


@query(
    "append_columns_by_position",
    """SELECT a.o_orderkey, a.o_orderpriority, b.c_custkey FROM
      (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) a FULL JOIN
      (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) b USING (i)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    both = joins.append_columns(orders, customers, [F.desc("o_totalprice"), "o_orderkey"], ["c_acctbal", "c_custkey"])
    return both.select("o_orderkey", "o_orderpriority", "c_custkey")


@query(
    "overlap_counts",
    f"""{GOLDEN} SELECT count(*) AS n_rows, count(*) FILTER (WHERE code IN (SELECT code FROM gold)) AS n_overlap,
    4 AS n_attrs, 1 AS n_fds FROM lines""",
)
def _(spark, sf):
    return joins.overlap_counts(lines(spark, sf), gold(spark, sf), "code", FLAGS)


# --- set operations ---------------------------------------------------------------------------


@query(
    "stack_tables",
    f"{GOLDEN} SELECT {ROWS}, code IN (SELECT code FROM gold) AS known FROM lines",
)
def _(spark, sf):
    rows, standard = lines(spark, sf), gold(spark, sf)
    train = joins.without_entities(rows, standard, "code").select(*ROW, F.lit(False).alias("known"))
    test = joins.with_entities(rows, standard, "code").select(F.lit(True).alias("known"), *ROW)
    return sets.stack([train, test])


@query(
    "stack_tables_with_missing_columns",
    """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return sets.stack([customers, suppliers], missing=True)


@query(
    "shared_columns",
    f"{GOLDEN} SELECT code, finished, returned, bulky, cheap FROM lines",
)
def _(spark, sf):
    both = sets.shared_columns([lines(spark, sf), gold(spark, sf)])
    return both[0]


