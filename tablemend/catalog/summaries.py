"""Aggregates, votes, windows and ordered results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import (
    FLAGS,
    GOLD_SQL,
    LINES_SQL,
    NOTES_SQL,
    ROW,
    ROWS,
    RULE_SQL,
    RULES,
    lines,
    notes,
    query,
    table,
)
from tablemend.operators import aggregates, evaluate, joins, ranking, selection, votes
from tablemend.operators.sets import stack

WITH = f"WITH {LINES_SQL}"


@query(
    "class_statistics",
    f"""{WITH}, c AS (SELECT level, count(*) AS n FROM lines WHERE level IS NOT NULL GROUP BY level)
    SELECT count(*) AS n_class, min(n) AS min_count, max(n) AS max_count,
      round_even((min(n) / max(n))::DECIMAL(18, 12), 3)::DOUBLE AS ir FROM c""",
)
def _(spark, sf):
    return aggregates.class_stats(lines(spark, sf), "level")


@query(
    "class_shares",
    WITH + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS value FROM lines" for a in [*FLAGS, "level"])
    + """), c AS (SELECT attr, value, count(*) AS n_rows FROM long WHERE value IS NOT NULL GROUP BY attr, value)
    SELECT attr, value, n_rows, n_rows / sum(n_rows) OVER (PARTITION BY attr) AS share FROM c""",
)
def _(spark, sf):
    return aggregates.class_shares(lines(spark, sf), [*FLAGS, "level"])


WEIGHT_SQL = f"""{WITH}, c AS (SELECT level, count(*) AS n_rows FROM lines WHERE level IS NOT NULL GROUP BY level),
  w AS (SELECT level, n_rows, (sum(n_rows) OVER ())::DOUBLE / (n_rows * count(*) OVER ()) AS weight FROM c)"""


@query("class_weights", f"{WEIGHT_SQL} SELECT level, n_rows, weight FROM w")
def _(spark, sf):
    return aggregates.class_weights(lines(spark, sf), "level")


@query("sample_weights", f"{WEIGHT_SQL} SELECT {ROWS}, level, weight FROM lines LEFT JOIN w USING (level)")
def _(spark, sf):
    return aggregates.with_sample_weights(lines(spark, sf), "level", domain=(0, 1, 2)).select(*ROW, "level", "weight")


@query(
    "sample_weights_open_domain",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_orderkey, (sum(n) OVER ())::DOUBLE / (n * k) AS weight FROM
      (SELECT o_orderkey, n, k, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 1
        THEN n ELSE 0 END AS n1 FROM orders JOIN c USING (o_orderpriority), (SELECT count(*) AS k FROM c))""".replace(
        "sum(n) OVER ()", "sum(n1) OVER ()"
    ),
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return aggregates.with_sample_weights(orders, "o_orderpriority").select("o_orderkey", "weight")


@query(
    "key_conflicts",
    f"{WITH} SELECT l_orderkey FROM lines GROUP BY l_orderkey HAVING count(DISTINCT flag) > 1",
)
def _(spark, sf):
    return aggregates.conflicts(lines(spark, sf), "l_orderkey", "flag")


@query(
    "key_conflict_counts",
    WITH + " UNION ALL ".join(
        f""" SELECT '{a}' AS attr, count(*) AS n_conflicts FROM
        (SELECT l_orderkey FROM lines GROUP BY l_orderkey HAVING count(DISTINCT {a}) > 1)""" for a in [*FLAGS, "flag"]
    ),
)
def _(spark, sf):
    return aggregates.conflict_counts(lines(spark, sf), "l_orderkey", [*FLAGS, "flag"])


@query(
    "distinct_values_per_key",
    f"{WITH} SELECT l_orderkey, count(DISTINCT flag) AS n_flag, count(DISTINCT level) AS n_level FROM lines GROUP BY l_orderkey",
)
def _(spark, sf):
    return aggregates.distinct_values(lines(spark, sf), "l_orderkey", ["flag", "level"])


@query(
    "rows_without_key_conflicts",
    f"""{WITH} SELECT {ROWS}, flag FROM lines WHERE l_orderkey NOT IN
    (SELECT l_orderkey FROM lines GROUP BY l_orderkey HAVING count(DISTINCT flag) > 1)""",
)
def _(spark, sf):
    return aggregates.without_conflicts(lines(spark, sf), "l_orderkey", "flag").select(*ROW, "flag")


@query(
    "custkey_priority_conflicts",
    "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1",
)
def _(spark, sf):
    return aggregates.conflicts(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query(
    "training_selection",
    f"""{WITH}, fit AS (SELECT * FROM lines WHERE l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL AND finished IS NOT NULL
      AND NOT {RULE_SQL[0]})
    SELECT {ROWS}, finished FROM fit WHERE l_orderkey NOT IN
      (SELECT l_orderkey FROM fit GROUP BY l_orderkey HAVING count(DISTINCT finished) > 1)""",
)
def _(spark, sf):
    return selection.clean_for(lines(spark, sf), "l_orderkey", "l_returnflag", "finished", RULES).select(*ROW, "finished")


@query("value_counts", "SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type ORDER BY n_rows DESC, event_type")
def _(spark, sf):
    return aggregates.value_counts(table(spark, sf, "events"), "event_type").orderBy(F.desc("n_rows"), "event_type")


@query("distinct_rows", f"{WITH} SELECT DISTINCT code, source, flag, level FROM lines")
def _(spark, sf):
    return lines(spark, sf).select("code", "source", "flag", "level").distinct()


@query("distinct_key_count", f"{WITH} SELECT count(*) AS n_distinct FROM (SELECT DISTINCT code, source FROM lines)")
def _(spark, sf):
    return aggregates.distinct_count(lines(spark, sf), ["code", "source"])


@query(
    "sources_per_key",
    f"""{WITH} SELECT code, string_agg(source::VARCHAR, ',' ORDER BY source) AS sources
    FROM (SELECT DISTINCT code, source FROM lines) GROUP BY code""",
)
def _(spark, sf):
    out = aggregates.sources_per_key(lines(spark, sf), "code", "source")
    return out.select("code", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


@query(
    "feature_correlations",
    WITH + " UNION ALL ".join(
        f" SELECT '{a}' AS attr, round(corr(l_extendedprice, {a}::DOUBLE), 6) AS correlation FROM lines" for a in FLAGS
    ),
)
def _(spark, sf):
    out = aggregates.correlations(lines(spark, sf), "l_extendedprice", FLAGS)
    return out.withColumn("correlation", F.round("correlation", 6))


# --- votes ------------------------------------------------------------------------------------

FULL_JOINS = " JOIN ".join(
    f"""(SELECT code, y.c AS {a}_y, n.c AS {a}_n, CASE WHEN y.c > n.c THEN 1 WHEN y.c < n.c THEN 0
      WHEN y.c IS NULL AND n.c IS NOT NULL THEN 0 WHEN y.c IS NOT NULL AND n.c IS NULL THEN 1 END AS {a}
      FROM (SELECT code, count(*) AS c FROM lines WHERE {a} = 1 GROUP BY code) y
      FULL JOIN (SELECT code, count(*) AS c FROM lines WHERE {a} = 0 GROUP BY code) n USING (code)) v_{a}"""
    + ("" if i == 0 else " USING (code)")
    for i, a in enumerate(FLAGS)
)


@query(
    "majority_vote",
    f"{WITH} SELECT code, "
    + ", ".join(f"{a}, coalesce({a}_y, 0) AS {a}_yes, coalesce({a}_n, 0) AS {a}_no" for a in FLAGS)
    + f" FROM {FULL_JOINS}",
)
def _(spark, sf):
    return votes.majority_vote(lines(spark, sf), "code", FLAGS, complete=True)


@query(
    "yes_no_counts_per_source",
    f"""{WITH} SELECT source, y.c AS yes, n.c AS no FROM
      (SELECT source, count(*) AS c FROM lines WHERE finished = 1 GROUP BY source) y
      FULL JOIN (SELECT source, count(*) AS c FROM lines WHERE finished = 0 GROUP BY source) n USING (source)""",
)
def _(spark, sf):
    out = votes.majority_vote(lines(spark, sf), "source", ["finished"])
    return out.select("source", F.col("finished_yes").alias("yes"), F.col("finished_no").alias("no"))


@query(
    "gold_by_consensus",
    f"""WITH {LINES_SQL.replace('lines AS', 'everything AS')}, lines AS (SELECT * FROM everything WHERE source < 3), {GOLD_SQL}
    SELECT DISTINCT g.code, {', '.join('g.' + a for a in FLAGS)} FROM gold g
    JOIN part p ON p.p_partkey = g.code AND p.p_name IS NOT NULL
    JOIN (SELECT * FROM everything WHERE source = 3) b ON b.code = g.code AND {' AND '.join(f'b.{a} = g.{a}' for a in FLAGS)}
    JOIN (SELECT * FROM everything WHERE source = 4) c ON c.code = b.code AND {' AND '.join(f'c.{a} = b.{a}' for a in FLAGS[:3])}
    ORDER BY g.code DESC""",
)
def _(spark, sf):
    rows = lines(spark, sf)
    described = table(spark, sf, "part").filter("p_name IS NOT NULL").select(F.col("p_partkey").alias("code"))
    found = votes.consensus(
        votes.majority_vote(rows.filter("source < 3"), "code", FLAGS, complete=True),
        described, rows.filter("source = 3"), rows.filter("source = 4"), "code", FLAGS, FLAGS[:3],
    )
    return found.orderBy(F.desc("code"))


# --- windows and order ------------------------------------------------------------------------


@query(
    "last_duplicates",
    """SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id DESC)
    AS r FROM documents) WHERE r = 1""",
)
def _(spark, sf):
    rows = selection.last_duplicates(table(spark, sf, "documents"), ["source", "text"], ["doc_id"])
    return rows.select("doc_id", "source", "lang", "n_chars")


@query(
    "first_row_per_key",
    f"""{WITH} SELECT code, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, flag FROM
    (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {ROWS}) AS r FROM lines) WHERE r = 1""",
)
def _(spark, sf):
    return joins.first_per_key(lines(spark, sf).select("code", *ROW, "flag"), ["code"], ROW)


@query(
    "source_ranks",
    """SELECT source, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, source)::INTEGER AS source_rank
    FROM documents GROUP BY source""",
)
def _(spark, sf):
    return evaluate.source_ranks(table(spark, sf, "documents"), "source")


@query(
    "cumulative_time",
    """WITH t AS (SELECT o_orderpriority AS strategy, month(o_orderdate) AS step, sum(o_custkey)::BIGINT AS spent
      FROM orders GROUP BY 1, 2)
    SELECT strategy, step::INTEGER AS step, spent, (sum(spent) OVER (PARTITION BY strategy ORDER BY step))::BIGINT AS total FROM t""",
)
def _(spark, sf):
    spent = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("strategy"), F.month("o_orderdate").alias("step")
    )
    return evaluate.cumulative(spent.agg(F.sum("o_custkey").alias("spent")), ["strategy"], "step", "spent", "total")


@query(
    "exact_rank_in_class",
    f"{WITH} SELECT {ROWS}, row_number() OVER (PARTITION BY level ORDER BY {ROWS}) AS rank FROM lines",
)
def _(spark, sf):
    return ranking.exact_rank(lines(spark, sf), ["level"], ROW).select(*ROW, F.col("rank").cast("bigint"))


@query("ordered_orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def _(spark, sf):
    ordered = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ordered.orderBy(F.desc("o_orderpriority"), "o_orderkey")


# --- selection for learning -------------------------------------------------------------------

SPLIT_SQL = f"""WITH {NOTES_SQL}, o AS (SELECT *, (doc_id * 37 + 11) % 100 AS ord FROM notes),
  e AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY ord, doc_id) AS first_,
    row_number() OVER (PARTITION BY toxic ORDER BY ord DESC, doc_id DESC) AS last_ FROM o)"""


@query(
    "train_valid_split",
    f"""{SPLIT_SQL} SELECT doc_id, toxic, CASE WHEN first_ = 1 AND last_ = 1 THEN 'train' WHEN first_ = 1 THEN 'valid'
      WHEN last_ = 1 THEN 'train' WHEN ord < 10 THEN 'valid' ELSE 'train' END AS part FROM e""",
)
def _(spark, sf):
    order = (F.col("doc_id") * 37 + 11) % 100
    return selection.split_train_valid(notes(spark, sf), "toxic", order, "doc_id").select("doc_id", "toxic", "part")


@query(
    "oversampled_classes",
    f"""WITH {NOTES_SQL}, c AS (SELECT toxic, count(*) AS n FROM notes GROUP BY toxic), m AS (SELECT min(n) AS lo, max(n) AS hi FROM c),
      r AS (SELECT doc_id, toxic, n, CASE WHEN lo / hi < 0.3 THEN hi ELSE n END AS goal,
        row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rank FROM notes JOIN c USING (toxic), m)
    SELECT doc_id, toxic, unnest(range(0, goal // n + CASE WHEN rank <= goal % n THEN 1 ELSE 0 END))::INTEGER AS copy FROM r""",
)
def _(spark, sf):
    out = selection.oversample(notes(spark, sf), "toxic", ["doc_id"], classes=(0, 1))
    return out.select("doc_id", "toxic", F.col("copy").cast("int"))


GOLD_NOTES_SQL = """standard AS (SELECT entity, max(quality) AS quality, max(toxic) AS toxic FROM notes
  GROUP BY entity HAVING min(quality) = max(quality) AND min(toxic) = max(toxic))"""


def _standard(spark, sf):
    seen = notes(spark, sf).groupBy("entity").agg(
        F.min("quality").alias("q"), F.max("quality").alias("quality"),
        F.min("toxic").alias("t"), F.max("toxic").alias("toxic"),
    )
    return seen.filter("q = quality AND t = toxic").select("entity", "quality", "toxic")


def _spec():
    from tablemend.spec import RepairSpec

    return RepairSpec(
        name="notes", partial_key="entity", source="source", text="text", labels=("quality", "toxic"),
        domains={"quality": (0, 1), "toxic": (0, 1)}, order="doc_id",
    )


def _role(spark, sf, role):
    from tablemend.sources.tables import read_role

    return read_role(notes(spark, sf), _standard(spark, sf), _spec(), role)


@query("role_gold", f"WITH {NOTES_SQL}, {GOLD_NOTES_SQL} SELECT entity, quality, toxic FROM standard")
def _(spark, sf):
    return _role(spark, sf, "gs")


@query(
    "role_train",
    f"""WITH {NOTES_SQL}, {GOLD_NOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, source, text
      ORDER BY doc_id DESC) AS r FROM notes WHERE length(text) > 1)
    SELECT doc_id, entity, source, quality, toxic FROM r WHERE r = 1 AND entity NOT IN (SELECT entity FROM standard)""",
)
def _(spark, sf):
    return _role(spark, sf, "train").select("doc_id", "entity", "source", "quality", "toxic")


@query(
    "role_test",
    f"""WITH {NOTES_SQL}, {GOLD_NOTES_SQL} SELECT doc_id, entity, source, quality, toxic FROM notes
    WHERE entity IN (SELECT entity FROM standard)""",
)
def _(spark, sf):
    return _role(spark, sf, "test").select("doc_id", "entity", "source", "quality", "toxic")


@query(
    "train_and_test_stacked",
    f"""WITH {NOTES_SQL}, {GOLD_NOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, source, text
      ORDER BY doc_id DESC) AS r FROM notes WHERE length(text) > 1)
    SELECT doc_id, 'train' AS part FROM r WHERE r = 1 AND entity NOT IN (SELECT entity FROM standard)
    UNION ALL SELECT doc_id, 'test' FROM notes WHERE entity IN (SELECT entity FROM standard)""",
)
def _(spark, sf):
    parts = [_role(spark, sf, p).select("doc_id", F.lit(p).alias("part")) for p in ("train", "test")]
    return stack(parts)
