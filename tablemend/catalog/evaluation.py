"""Evaluation against gold, thresholds, sweeps and source prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import ALL_SQL, GATED, cells, counters_sql, quality_sql, query, repaired
from tablemend.operators import aggregates, evaluate, ranking

COUNTED_SQL = "counted AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attr, {counters_sql(a, a, a + '_gs', a + '_rep')} FROM repaired" for a in GATED
) + ")"


@query("cell_statistics", f"{ALL_SQL}, {COUNTED_SQL} SELECT * FROM counted")
def _(spark, sf):
    return evaluate.cell_counts(repaired(spark, sf), GATED)


@query("quality_measures", f"{ALL_SQL}, {COUNTED_SQL}" + quality_sql("counted", "attr"))
def _(spark, sf):
    return evaluate.with_quality(evaluate.cell_counts(repaired(spark, sf), GATED))


def _rounded(x: str) -> str:
    """SQL of a share in hundredths, by its exact binary value with ties to even."""
    bits = f"(({x}) * 1152921504606846976.0)::BIGINT::HUGEINT * 100"
    rest = f"(({bits}) % 1152921504606846976)"
    whole = f"(({bits}) // 1152921504606846976)"
    return f"""(({whole} + CASE WHEN {rest} > 576460752303423488 OR ({rest} = 576460752303423488 AND {whole} % 2 = 1)
      THEN 1 ELSE 0 END)::BIGINT / 100.0::DOUBLE)"""


@query(
    "quality_measures_rounded",
    f"""{ALL_SQL}, {COUNTED_SQL}, q AS (SELECT *, {_rounded('CASE WHEN repairs = 0 THEN 0 ELSE correct / repairs END')} AS precision,
      {_rounded('CASE WHEN errors = 0 THEN 0 ELSE correct / errors END')} AS recall FROM counted)
    SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE
      {_rounded('2 * (precision * recall) / (precision + recall)')} END AS f1 FROM q""",
)
def _(spark, sf):
    return evaluate.with_quality(evaluate.cell_counts(repaired(spark, sf), GATED), rounded=True)


@query(
    "cell_statistics_with_total",
    f"""{ALL_SQL}, {COUNTED_SQL} SELECT * FROM counted UNION ALL
    SELECT '*', sum(errors)::BIGINT, sum(repairs)::BIGINT, sum(correct)::BIGINT FROM counted""",
)
def _(spark, sf):
    return evaluate.with_total(evaluate.cell_counts(repaired(spark, sf), GATED))


@query(
    "prediction_accuracy",
    f"{ALL_SQL} SELECT count(*) FILTER (WHERE finished_pred = finished_gs) / count(*) AS accuracy FROM cells",
)
def _(spark, sf):
    hits = aggregates.accuracy(F.col("finished_pred"), F.col("finished_gs"))
    return cells(spark, sf).agg(hits.alias("accuracy"))


TAU_SQL = f"""{ALL_SQL}, per AS (SELECT finished_gs,
    coalesce(avg(CASE WHEN finished_gs = finished_pred THEN finished_conf END), 0) AS m FROM cells GROUP BY finished_gs)"""


@query("confidence_threshold", f"{TAU_SQL} SELECT round(avg(m) * 0.9, 6) AS tau FROM per")
def _(spark, sf):
    tau = evaluate.confidence_threshold(cells(spark, sf), "finished_gs", "finished_pred", "finished_conf")
    return tau.select(F.round("tau", 6).alias("tau"))


@query(
    "errors_by_gold_class",
    ALL_SQL + " UNION ALL ".join(
        f" SELECT '{a}' AS attr, {a}_gs AS gold, count(*) FILTER (WHERE {a} IS DISTINCT FROM {a}_gs) AS errors FROM cells GROUP BY {a}_gs"
        for a in GATED
    ),
)
def _(spark, sf):
    return evaluate.errors_by_class(cells(spark, sf), GATED)


RATIO_SQL = ALL_SQL + ", ratios AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS attr, count(*) AS n_rows, count(*) FILTER (WHERE {a} IS DISTINCT FROM {a}_gs) / count(*) AS error_ratio,
    count(*) FILTER (WHERE {a} IS DISTINCT FROM {a}_rep) / count(*) AS repair_ratio FROM repaired""" for a in GATED
) + ")"


@query("error_and_repair_ratios", f"{RATIO_SQL} SELECT * FROM ratios")
def _(spark, sf):
    return evaluate.error_ratios(repaired(spark, sf), GATED)


@query("average_error_rate", f"{RATIO_SQL} SELECT round(avg(error_ratio), 12) AS avg_error_rate FROM ratios")
def _(spark, sf):
    rate = evaluate.average_error_rate(evaluate.error_ratios(repaired(spark, sf), GATED))
    return rate.select(F.round("avg_error_rate", 12).alias("avg_error_rate"))


# --- sweeps -----------------------------------------------------------------------------------

STEPS = {"finished": [0.0, 0.2, 0.4, 0.45, 0.6, 0.8, 1.0], "bulky": [0.0, 0.5, 0.75, 0.95, 1.0]}
SWEEP_SQL = ALL_SQL + ", swept AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS attr, th AS threshold, {counters_sql(a, a, a + '_gs',
      f'(CASE WHEN {a}_conf >= th OR {a} IS NULL THEN {a}_pred ELSE {a} END)')}
    FROM cells, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in STEPS[a])}]) AS th) GROUP BY th""" for a in GATED
) + "), rated AS (" + quality_sql("swept", "attr, threshold") + ")"


def sweep(spark, sf):
    return evaluate.threshold_sweep(cells(spark, sf), GATED, STEPS)


@query("threshold_sweep", f"{SWEEP_SQL} SELECT * FROM rated")
def _(spark, sf):
    return evaluate.with_quality(sweep(spark, sf))


@query(
    "best_thresholds",
    SWEEP_SQL + " SELECT attr, " + ", ".join(
        f"arg_max(threshold, {m} + threshold / 1e12) AS best_{m}" for m in ("precision", "recall", "f1")
    ) + " FROM rated GROUP BY attr",
)
def _(spark, sf):
    return ranking.best_threshold(evaluate.with_quality(sweep(spark, sf)), ["attr"], ["precision", "recall", "f1"], "threshold")


@query("metrics_at_threshold", f"{SWEEP_SQL} SELECT * FROM rated WHERE attr = 'finished' AND threshold = 0.45")
def _(spark, sf):
    rated = evaluate.with_quality(sweep(spark, sf)).filter("attr = 'finished'")
    return ranking.at_threshold(rated, "threshold", F.lit(0.45))


@query(
    "best_setting_per_attribute",
    f"""{SWEEP_SQL} SELECT attr, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY attr
    ORDER BY f1 DESC, threshold) AS r FROM rated) WHERE r = 1""",
)
def _(spark, sf):
    rated = evaluate.with_quality(sweep(spark, sf)).select("attr", "threshold", "f1")
    return ranking.best_by(rated, ["attr"], "f1", ["threshold"])


PREFIX_SQL = f"""{ALL_SQL}, per AS (SELECT source, count(*) AS n_rows,
      count(*) FILTER (WHERE finished IS DISTINCT FROM finished_gs) AS e1, count(*) FILTER (WHERE bulky IS DISTINCT FROM bulky_gs) AS e2,
      count(*) FILTER (WHERE finished IS DISTINCT FROM finished_rep) AS r1, count(*) FILTER (WHERE bulky IS DISTINCT FROM bulky_rep) AS r2,
      count(*) FILTER (WHERE finished IS DISTINCT FROM finished_rep AND finished_rep IS NOT DISTINCT FROM finished_gs) AS c1,
      count(*) FILTER (WHERE bulky IS DISTINCT FROM bulky_rep AND bulky_rep IS NOT DISTINCT FROM bulky_gs) AS c2
      FROM repaired GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, source)::INTEGER AS source_rank FROM per)
    SELECT b.source_rank, 1 AS n_attrs, sum(a.e1)::BIGINT AS errors, sum(a.r1)::BIGINT AS repairs, sum(a.c1)::BIGINT AS correct
      FROM ranked a JOIN ranked b ON a.source_rank <= b.source_rank GROUP BY b.source_rank
    UNION ALL SELECT b.source_rank, 2, sum(a.e1 + a.e2)::BIGINT, sum(a.r1 + a.r2)::BIGINT, sum(a.c1 + a.c2)::BIGINT
      FROM ranked a JOIN ranked b ON a.source_rank <= b.source_rank GROUP BY b.source_rank"""


def prefixes(spark, sf):
    return evaluate.source_prefixes(repaired(spark, sf), "source", GATED)


@query("source_prefixes", PREFIX_SQL)
def _(spark, sf):
    return prefixes(spark, sf)


@query(
    "predicted_class_and_confidence",
    """SELECT vec_id, list_position(e, list_max(e)) - 1 AS pred, list_max(e)::DOUBLE AS conf
    FROM (SELECT vec_id, embedding AS e FROM embeddings)""",
)
def _(spark, sf):
    from tablemend.catalog.base import table

    shares = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", ranking.predicted_class(shares).alias("pred"), ranking.confidence(shares).cast("double").alias("conf")
    )
