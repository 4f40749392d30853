"""Entity repair, row repair, the confidence gate and chains of them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tablemend.catalog.base import (
    ALL_SQL,
    BROKEN_SQL,
    DOMAINS,
    FLAGS,
    GATE,
    GATED,
    LINES_SQL,
    ROW,
    ROWS,
    RULES,
    cells,
    counters_sql,
    lines,
    query,
    quality_sql,
    repaired,
    table,
)
from tablemend.operators import joins
from tablemend.operators.evaluate import Cells, cell_counts, compare_strategies, gate_counts, with_quality
from tablemend.operators.repair import gated, gated_repair, group_repair, group_winners, row_repair
from tablemend.plans.flows import compare_in_one_pass
from tablemend.session import stored
from tablemend.spec import BINARY_COST, CONSTANT_COST, THREE_LEVEL_COST, RepairSpec

FIVE = [*FLAGS, "level"]
GROUPS = (("finished", "returned", "level"), ("bulky", "cheap"))
LEGAL = {
    GROUPS[0]: [t for t in product((0, 1), (0, 1), (0, 1, 2)) if not (t[0] == 0 and t[1] == 1) and not (t[1] == 1 and t[2] == 0)],
    GROUPS[1]: [t for t in product((0, 1), (0, 1)) if t != (0, 1)],
}
MIXED_COST = {"finished": BINARY_COST, "level": THREE_LEVEL_COST}


# The same costs for SQL, stated anew (old, new, cost) so that the check does not rest on the code it checks.
BINARY_SQL = ((0, 1, 1), (1, 0, 2))
THREE_LEVEL_SQL = ((0, 1, 1), (0, 2, 1), (1, 0, 3), (1, 2, 1), (2, 0, 3), (2, 1, 3))
MIXED_SQL = {"finished": BINARY_SQL, "level": THREE_LEVEL_SQL}


def _price(attr: str, new: str, costs: dict[str, tuple]) -> str:
    """SQL cost of changing the cell ``l.attr`` into the expression ``new``."""
    listed = " ".join(f"WHEN l.{attr} = {o} AND {new} = {n} THEN {c}" for o, n, c in costs.get(attr, ()))
    return f"CASE WHEN l.{attr} IS NULL THEN 1 WHEN l.{attr} = {new} THEN 0 {listed} ELSE 1 END"


def _legal(group) -> str:
    rows = ", ".join(str(t) for t in LEGAL[group])
    return f"(VALUES {rows}) t({', '.join('v_' + a for a in group)})"


def _winners(i: int, group, costs: dict, rows: str = "lines") -> str:
    """SQL of the winners of one group: every row of an entity priced against every legal tuple."""
    columns = ", ".join("v_" + a for a in group)
    price = " + ".join(f"({_price(a, 'v_' + a, costs)})" for a in group)
    same = " AND ".join(f"c.{a} = v_{a}" for a in group)
    return f"""
    freq{i} AS (SELECT {columns}, count(c.code) AS freq FROM {_legal(group)} LEFT JOIN
      (SELECT * FROM {rows} WHERE NOT {BROKEN_SQL}) c ON {same} GROUP BY {columns}),
    priced{i} AS (SELECT l.code, {columns}, sum({price}) AS cost FROM {rows} l, {_legal(group)} GROUP BY l.code, {columns}),
    won{i} AS (SELECT code, {columns} FROM (SELECT p.*, row_number() OVER (PARTITION BY code
      ORDER BY cost, freq DESC, {columns}) AS r FROM priced{i} p JOIN freq{i} f USING ({columns})) WHERE r = 1)"""


def group_sql(costs: dict, rows: str = "lines") -> str:
    return ",".join(_winners(i, g, costs, rows) for i, g in enumerate(GROUPS))


WON = "won0 JOIN won1 USING (code)"
FIXED = ", ".join(f"v_{a} AS {a}" for a in FIVE)


@query(
    "group_repair_with_rules",
    f"""WITH {LINES_SQL}, {group_sql({})} SELECT {ROWS}, code, {FIXED}
    FROM lines JOIN won0 USING (code) JOIN won1 USING (code)""",
)
def _(spark, sf):
    out = group_repair(lines(spark, sf), "code", FIVE, domains=DOMAINS, rules=RULES)
    return out.select(*ROW, "code", *FIVE)


@query(
    "group_repair_asymmetric_costs",
    f"WITH {LINES_SQL}, {group_sql(MIXED_SQL)} SELECT code, {FIXED} FROM {WON}",
)
def _(spark, sf):
    won = group_winners(lines(spark, sf), "code", FIVE, domains=DOMAINS, rules=RULES, cost=MIXED_COST)
    return won.select("code", *[F.col(f"_win_{a}").alias(a) for a in FIVE])


@query(
    "group_repair_without_domains",
    f"""WITH {LINES_SQL}, long AS (SELECT code, 'flag' AS attr, flag AS value FROM lines
        UNION ALL SELECT code, 'status', l_linestatus FROM lines),
      n AS (SELECT code, attr, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
      f AS (SELECT attr, value, count(*) AS freq FROM long WHERE value IS NOT NULL GROUP BY ALL),
      w AS (SELECT code, attr, value FROM (SELECT *, row_number() OVER (PARTITION BY code, attr
        ORDER BY n DESC, freq DESC, value) AS r FROM n JOIN f USING (attr, value)) WHERE r = 1)
    SELECT {ROWS}, coalesce(a.value, l.flag) AS flag, coalesce(b.value, l_linestatus) AS status FROM lines l
    LEFT JOIN (SELECT * FROM w WHERE attr = 'flag') a ON a.code = l.code
    LEFT JOIN (SELECT * FROM w WHERE attr = 'status') b ON b.code = l.code""",
)
def _(spark, sf):
    rows = lines(spark, sf).select(*ROW, "code", "flag", F.col("l_linestatus").alias("status"))
    return group_repair(rows, "code", ["flag", "status"]).drop("code")


@query(
    "group_repair_open_values_with_costs",
    f"""WITH {LINES_SQL}, vals AS (SELECT DISTINCT code, level FROM lines WHERE level IS NOT NULL
        UNION SELECT code, 2 FROM lines WHERE level IN (0, 1) UNION SELECT code, 1 FROM lines WHERE level IN (0, 2)
        UNION SELECT code, 0 FROM lines WHERE level IN (1, 2)),
      f AS (SELECT level AS v, count(*) AS freq FROM lines WHERE level IS NOT NULL GROUP BY level),
      p AS (SELECT l.code, v.level AS v, sum({_price('level', 'v.level', {'level': THREE_LEVEL_SQL})}) AS cost
        FROM lines l JOIN vals v ON v.code = l.code GROUP BY l.code, v.level)
    SELECT code, v AS level FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cost, coalesce(freq, 0) DESC, v) AS r
      FROM p LEFT JOIN f USING (v)) WHERE r = 1""",
)
def _(spark, sf):
    won = group_winners(lines(spark, sf), "code", ["level"], cost=THREE_LEVEL_COST)
    return won.select("code", F.col("_win_level").alias("level"))


@query(
    "group_repair_of_order_priorities",
    """WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2),
      f AS (SELECT o_orderpriority AS v, count(*) AS freq FROM orders GROUP BY 1),
      w AS (SELECT o_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, freq DESC, v) AS r
        FROM n JOIN f USING (v)) WHERE r = 1)
    SELECT o_orderkey, o_custkey, v AS o_orderpriority FROM orders JOIN w USING (o_custkey)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return group_repair(orders, "o_custkey", ["o_orderpriority"])


MANY = 20_000


@query(
    "group_repair_long_domain",
    f"""WITH p AS (SELECT l_suppkey AS s, l_partkey + 2 AS v FROM lineitem),
      f AS (SELECT d.v, count(p.v) AS freq FROM (SELECT unnest(range(3, {MANY + 3})) AS v) d LEFT JOIN p USING (v) GROUP BY d.v),
      n AS (SELECT s, v, count(*) AS n, any_value(freq) AS freq FROM p JOIN f USING (v) GROUP BY s, v),
      w AS (SELECT s, v, n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, freq DESC, v) AS r FROM n) WHERE r = 1),
      rest AS (SELECT v FROM f ORDER BY freq DESC, v LIMIT 1)
    SELECT s AS supplier, coalesce(w.v, rest.v)::BIGINT AS part, coalesce(w.n, 0)::BIGINT AS agreeing
    FROM (SELECT DISTINCT s FROM p WHERE s IS NOT NULL) LEFT JOIN w USING (s), rest""",
)
def _(spark, sf):
    """The most agreed part of each supplier among a domain of 20,000 values, some of which nobody has, and how many lines agree."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") + 2).cast("long").alias("v"))
    won = group_winners(rows, "s", ["v"], domains={"v": range(3, MANY + 3)})
    joined = joins.join_per_key(rows, won, ["s"], "inner")
    agreeing = F.count_if(F.col("v") == F.col("_win_v"))
    return joined.groupBy(F.col("s").alias("supplier")).agg(F.any_value("_win_v").alias("part"), agreeing.alias("agreeing"))


@query(
    "change_costs",
    f"""WITH {LINES_SQL} SELECT {ROWS}, {_price('level', '2', {'level': THREE_LEVEL_SQL})} AS three_level,
    {_price('finished', '0', {'finished': BINARY_SQL})} AS binary, {_price('level', '1', {})} AS constant FROM lines l""",
)
def _(spark, sf):
    def price(attr, new, model):
        known = [F.when(F.col(attr) == old, model.cost(old, new)) for old in DOMAINS[attr]]
        return F.coalesce(*known, F.lit(model.null_cost))

    return lines(spark, sf).select(
        *ROW,
        price("level", 2, THREE_LEVEL_COST).alias("three_level"),
        price("finished", 0, BINARY_COST).alias("binary"),
        price("level", 1, CONSTANT_COST).alias("constant"),
    )


@query(
    "random_tie_repair_cost",
    f"""WITH {LINES_SQL}, {group_sql({})}, best AS (SELECT code, min(cost) AS c0 FROM priced0 GROUP BY code),
      best1 AS (SELECT code, min(cost) AS c1 FROM priced1 GROUP BY code)
    SELECT code, (c0 + c1)::BIGINT AS changed FROM best JOIN best1 USING (code)""",
)
def _(spark, sf):
    """Whatever tie is taken, the number of changed cells of an entity is the least possible one."""
    rows = lines(spark, sf)
    won = group_winners(rows, "code", FIVE, domains=DOMAINS, rules=RULES, select="random", seed=7)
    joined = joins.join_per_key(rows, won, ["code"], "inner")
    changes = [F.count_if(~F.col(a).eqNullSafe(F.col(f"_win_{a}"))) for a in FIVE]
    return joined.groupBy("code").agg(sum(changes[1:], changes[0]).alias("changed"))


def _row_sql(joint: bool, fill: bool) -> str:
    """SQL of row repair: every row that wants a repair against every legal tuple."""
    parts, picks = [f"ids AS (SELECT *, row_number() OVER (ORDER BY {ROWS}) AS id FROM lines)"], []
    for i, group in enumerate(GROUPS):
        columns = ", ".join("v_" + a for a in group)
        price = " + ".join(f"({_price(a, 'v_' + a, {})})" for a in group)
        rules = {0: "coalesce(finished = 0 AND returned = 1, false) OR coalesce(returned = 1 AND level = 0, false)",
                 1: "coalesce(bulky = 0 AND cheap = 1, false)"}[i]
        nulls = " OR ".join(f"{a} IS NULL" for a in group)
        clean = f"(SELECT * FROM lines WHERE NOT {BROKEN_SQL})"
        if joint:
            same = " AND ".join(f"c.{a} = v_{a}" for a in group)
            tie = f"(SELECT count(*) FROM {clean} c WHERE {same}) DESC"
        else:
            tie = ", ".join(f"(SELECT count(*) FROM {clean} c WHERE c.{a} = v_{a}) DESC" for a in group)
        parts.append(f"ranked{i} AS (SELECT {columns}, row_number() OVER (ORDER BY {tie}, {columns}) AS tie FROM {_legal(group)})")
        parts.append(
            f"fixed{i} AS (SELECT l.id, arg_min(({columns}), ({price}) * 1000 + tie) AS w FROM ids l, ranked{i} "
            f"WHERE ({rules}{' OR ' + nulls if fill else ''}) GROUP BY l.id)"
        )
        # A row of one value per column, read by position.
        picks += [f"coalesce(struct_extract(fixed{i}.w, {j + 1}), l.{a}) AS {a}" for j, a in enumerate(group)]
    ctes = ", ".join(parts)
    return f"WITH {LINES_SQL}, {ctes} SELECT {ROWS}, {', '.join(picks)} FROM ids l LEFT JOIN fixed0 USING (id) LEFT JOIN fixed1 USING (id)"


@query("row_repair_sequential", _row_sql(joint=False, fill=True))
def _(spark, sf):
    return row_repair(lines(spark, sf), FIVE, domains=DOMAINS, rules=RULES).select(*ROW, *FIVE)


@query("row_repair_joint", _row_sql(joint=True, fill=False))
def _(spark, sf):
    out = row_repair(lines(spark, sf), FIVE, domains=DOMAINS, rules=RULES, joint=True, fill_nulls=False)
    return out.select(*ROW, *FIVE)


@query(
    "confidence_gate",
    f"{ALL_SQL} SELECT {ROWS}, finished AS finished_orig, finished_rep AS finished FROM repaired",
)
def _(spark, sf):
    out = gated_repair(cells(spark, sf), "finished", GATE["finished"], "finished_pred", "finished_conf")
    return out.select(*ROW, "finished_orig", "finished")


@query(
    "gated_repair_with_metrics",
    ALL_SQL + ", c AS (SELECT " + counters_sql("finished", "finished", "finished_gs", "finished_rep") + " FROM repaired) "
    + quality_sql("c", "'finished' AS attr"),
)
def _(spark, sf):
    counts = gate_counts(cells(spark, sf), "finished", GATE["finished"], "finished_pred", "finished_conf", "finished_gs")
    return with_quality(counts).withColumn("attr", F.lit("finished"))


def _majority(a: str, rows: str) -> str:
    """SQL: constant-cost entity repair of one 0/1 attribute without rules."""
    return f"""(SELECT code, CASE WHEN y > n OR (y = n AND ally > alln) THEN 1 WHEN y + n > 0 OR true THEN 0 END AS v FROM
      (SELECT code, count(*) FILTER (WHERE {a} = 1) AS y, count(*) FILTER (WHERE {a} = 0) AS n FROM {rows} GROUP BY code),
      (SELECT count(*) FILTER (WHERE {a} = 1) AS ally, count(*) FILTER (WHERE {a} = 0) AS alln FROM {rows}))"""


CHAIN_SQL = f"""{ALL_SQL},
  modelled AS (SELECT {ROWS}, code, finished_rep AS finished, bulky_rep AS bulky, finished_gs, bulky_gs,
    finished AS finished_orig, bulky AS bulky_orig FROM repaired),
  chained AS (SELECT m.* EXCLUDE (finished, bulky), f.v AS finished, b.v AS bulky FROM modelled m
    JOIN {_majority('finished', 'modelled')} f ON f.code = m.code JOIN {_majority('bulky', 'modelled')} b ON b.code = m.code),
  grouped AS (SELECT c.* EXCLUDE (finished, bulky), c.finished AS finished_orig, c.bulky AS bulky_orig,
      CASE WHEN finished_conf >= {GATE['finished']}::DOUBLE THEN finished_pred ELSE f.v END AS finished,
      CASE WHEN bulky_conf >= {GATE['bulky']}::DOUBLE THEN bulky_pred ELSE b.v END AS bulky FROM cells c
    JOIN {_majority('finished', 'cells')} f ON f.code = c.code JOIN {_majority('bulky', 'cells')} b ON b.code = c.code)"""
BITS = {a: (0, 1) for a in GATED}


def _chain_counts(rows: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS attr, {counters_sql(a, a + '_orig', a + '_gs', a)} FROM {rows}" for a in GATED
    )
    return f", counted AS ({parts}) " + quality_sql("counted", "attr")


LINES = RepairSpec("lines", "code", "source", "flag", tuple(GATED), BITS)
CHAINED = Cells(original="{}_orig", gold="{}_gs", repaired="{}")


@query("model_then_group", CHAIN_SQL + _chain_counts("chained"))
def _(spark, sf):
    modelled = repaired(spark, sf).select(
        "code", *[F.col(f"{a}_rep").alias(a) for a in GATED], *[F.col(a).alias(f"{a}_orig") for a in GATED],
        *[f"{a}_gs" for a in GATED],
    )
    return with_quality(cell_counts(group_repair(modelled, "code", GATED, domains=BITS), GATED, CHAINED))


@query("group_then_model", CHAIN_SQL + _chain_counts("grouped"))
def _(spark, sf):
    rows = cells(spark, sf).withColumns({f"{a}_orig": F.col(a) for a in GATED})
    out = group_repair(rows, "code", GATED, domains=BITS)
    gates = {a: gated(F.col(a), F.col(f"{a}_pred"), F.col(f"{a}_conf"), GATE[a]) for a in GATED}
    out = out.withColumns(gates)
    return with_quality(cell_counts(out, GATED, CHAINED))


@query(
    "strategy_comparison",
    f"""WITH {LINES_SQL}, firsts AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY code, source
        ORDER BY {ROWS}) AS r FROM lines) WHERE r = 1),
      g AS (SELECT code, max(finished) AS finished_gs, max(bulky) AS bulky_gs FROM lines WHERE returned = 1 GROUP BY code),
      base AS (SELECT * FROM firsts JOIN g USING (code)),
      s AS (
        SELECT 'model' AS strategy, b.*, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS finished_rep, bulky AS bulky_rep FROM base b
        UNION ALL SELECT 'group', b.*, f.v, k.v FROM base b JOIN {_majority('finished', 'firsts')} f ON f.code = b.code
          JOIN {_majority('bulky', 'firsts')} k ON k.code = b.code
        UNION ALL SELECT 'outside', b.*, finished, cheap FROM base b),
      c AS (SELECT strategy, 'finished' AS attr, {counters_sql('finished', 'finished', 'finished_gs', 'finished_rep')} FROM s GROUP BY strategy
        UNION ALL SELECT strategy, 'bulky', {counters_sql('bulky', 'bulky', 'bulky_gs', 'bulky_rep')} FROM s GROUP BY strategy),
      t AS (SELECT * FROM c UNION ALL SELECT strategy, '*', sum(errors)::BIGINT, sum(repairs)::BIGINT, sum(correct)::BIGINT
        FROM c GROUP BY strategy)
    """ + quality_sql("t", "strategy, attr"),
)
def _(spark, sf):
    rows = joins.first_per_key(lines(spark, sf), ["code", "source"], ROW)
    standard = lines(spark, sf).filter("returned = 1").groupBy("code").agg(
        F.max("finished").alias("finished"), F.max("bulky").alias("bulky")
    )
    repairs = {
        "model": rows.withColumn("finished", F.when(F.col("l_quantity") > 20, 1).otherwise(0)),
        "group": group_repair(rows, "code", GATED, domains=BITS),
        "outside": rows.withColumn("bulky", F.col("cheap")),
    }
    return compare_strategies(rows, repairs, standard, "code", "source", GATED)



def _six_sql() -> str:
    """Every strategy's repaired rows as a table of its own, counted beside the first row of each full key."""
    taken = ", ".join(f"{a}_pred, {a}_conf" for a in GATED)
    fixed = {a: f"CASE WHEN {a}_conf >= {GATE[a]}::DOUBLE OR {a} IS NULL THEN {a}_pred ELSE {a} END" for a in GATED}
    gated_ = {a: f"CASE WHEN {a}_conf >= {GATE[a]}::DOUBLE THEN {a}_pred ELSE {a}_won END" for a in GATED}
    counts = " UNION ALL ".join(
        f"""SELECT strategy, '{a}' AS attr, {counters_sql(a, 'b.' + a, 'g.' + a, 's.' + a)} FROM s
        JOIN firsts b USING (code, source) JOIN g USING (code) GROUP BY strategy""" for a in GATED
    )
    return f"""WITH {LINES_SQL}, firsts AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY code, source
        ORDER BY {ROWS}) AS r,
        CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS finished_pred, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS bulky_pred,
        ((l_orderkey * 7 + l_linenumber) % 101) / 100.0::DOUBLE AS finished_conf,
        ((l_orderkey * 3 + l_suppkey) % 101) / 100.0::DOUBLE AS bulky_conf FROM lines) WHERE r = 1),
      g AS (SELECT code, max(finished) AS finished, max(bulky) AS bulky FROM lines WHERE returned = 1 GROUP BY code),
      m AS (SELECT code, source, {', '.join(f'{fixed[a]} AS {a}' for a in GATED)} FROM firsts),
      w AS (SELECT b.code, source, {taken}, f.v AS finished_won, k.v AS bulky_won FROM firsts b
        JOIN {_majority('finished', 'firsts')} f ON f.code = b.code JOIN {_majority('bulky', 'firsts')} k ON k.code = b.code),
      a AS (SELECT code, source, finished, cheap AS bulky FROM firsts WHERE source <> 4),
      z AS (SELECT code, source, returned AS finished, bulky FROM firsts UNION ALL
        SELECT code, source, finished, bulky FROM firsts WHERE source = 2),
      r AS (SELECT 'model' AS strategy, * FROM m
        UNION ALL SELECT 'group', code, source, finished_won, bulky_won FROM w
        UNION ALL SELECT 'model_then_group', m.code, source, f.v, k.v FROM m
          JOIN {_majority('finished', 'm')} f ON f.code = m.code JOIN {_majority('bulky', 'm')} k ON k.code = m.code
        UNION ALL SELECT 'group_then_model', code, source, {gated_['finished']}, {gated_['bulky']} FROM w
        UNION ALL SELECT 'first_cleaner', * FROM a UNION ALL SELECT 'second_cleaner', * FROM z),
      s AS (SELECT strategy, code, source, any_value(finished) AS finished, any_value(bulky) AS bulky FROM r
        GROUP BY strategy, code, source HAVING count(*) = 1),
      c AS ({counts}),
      t AS (SELECT * FROM c UNION ALL SELECT strategy, '*', sum(errors)::BIGINT, sum(repairs)::BIGINT, sum(correct)::BIGINT
        FROM c GROUP BY strategy)
    """ + quality_sql("t", "strategy, attr")


@query("strategy_comparison_in_one_pass", _six_sql())
def _(spark, sf):
    """Two repairs, both chains, and two outside tables: one lacks a source, the other has one twice."""
    order, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    # Six strategies read these rows, each through filters of its own: without files, each would sort and shuffle all lines.
    taken = lines(spark, sf).select("code", "source", *ROW, "l_quantity", "l_tax", *FLAGS)
    rows = joins.first_per_key(taken, ["code", "source"], ROW).select(
        "code", "source", *FLAGS,
        F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("finished_pred"),
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("bulky_pred"),
        ((order * 7 + line) % 101 / F.lit(100.0)).alias("finished_conf"),
        ((order * 3 + supplier) % 101 / F.lit(100.0)).alias("bulky_conf"),
    )
    rows = stored(rows, "firsts")
    standard = lines(spark, sf).filter("returned = 1").groupBy("code").agg(
        F.max("finished").alias("finished"), F.max("bulky").alias("bulky")
    )
    copies = F.when(F.col("source") == 2, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    second = rows.select("code", "source", *FLAGS, F.explode(copies).alias("own"))
    outside = {
        "first_cleaner": rows.filter("source <> 4").withColumn("bulky", F.col("cheap")),
        "second_cleaner": second.withColumn("finished", F.when(F.col("own"), F.col("returned")).otherwise(F.col("finished"))),
    }
    return compare_in_one_pass(rows, standard, LINES, GATE, outside, unique=True)
