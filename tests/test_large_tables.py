"""Plans whose shuffles and memory of a task do not outgrow the table."""

from __future__ import annotations

import __spark_entry__ as registry
from tablemend.operators import features, models
from tablemend.operators.joins import match_three
from tablemend.plans import flows
from tablemend.spec import RepairSpec


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_more_tasks_where_there_is_more_text(spark, monkeypatch):
    rows = [(1, "milk Milk bread"), (1, "milk"), (None, "soy"), (None, "soy soy"), (2, None), (3, "")] + [(i, "wheat flour " * 20) for i in range(4, 44)]
    df = spark.createDataFrame(rows, "id long, text string")
    few = features.term_counts(df, "id", "text")
    monkeypatch.setattr(features, "TASK_BYTES", 200)
    many = features.term_counts(df, "id", "text")
    assert many.rdd.getNumPartitions() >= 40 > few.rdd.getNumPartitions()
    expected = {(1, "milk", 3), (1, "bread", 1), (None, "soy", 3)} | {(i, w, 20) for i in range(4, 44) for w in ("wheat", "flour")}
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == expected
    assert features.term_counts(df.limit(0), "id", "text").count() == 0


def test_three_way_match_sorts_no_rows_to_group_numbers(spark):
    schema = "k int, a int, b int"
    original = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, None, 0), (4, 0, 0), (None, 0, 0)], schema)
    gold = spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 2, 2), (3, 5, 6), (None, 1, 1)], schema)
    repaired = spark.createDataFrame([(1, None, 3), (2, 1, 1), (3, 5, 5), (3, 7, 7)], schema)
    out = match_three(original, gold, repaired, ["k"], ["a", "b"])
    assert out.columns == ["k", "a", "b", "a_gs", "b_gs", "a_rep", "b_rep", "match_status"]
    assert "SortAggregate" not in plan(out)
    found = {r["k"]: r for r in out.collect()}
    assert tuple(found[1]) == (1, 0, 0, 1, None, None, 3, "ok")
    assert {k: r["match_status"] for k, r in found.items()} == {1: "ok", 2: "multiple", 3: "multiple", 4: "none", None: "none"}
    assert found[2]["a_gs"] == found[2]["b_gs"] and found[3]["a_rep"] == found[3]["b_rep"]


def test_six_strategies_read_the_lines_once_beside_the_standard(spark, sf):
    assert plan(registry.queries()["strategy_comparison_in_one_pass"](spark, sf)).count("lineitem.parquet") == 1


def test_entity_repair_after_models_predicts_once(spark):
    rows = [(i, f"s{i % 3}", f"{'milk butter' if i % 2 else 'wheat flour'} {i % 8}" if i % 10 else None, (i % 2 if i % 7 else None)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, source string, text string, label int")
    for key in ("text", "source"):
        spec = RepairSpec("n", key, "source", "text", ("label",), {"label": (0, 1)})
        trained = flows.learn(df, spec, "id", models.Estimator("counts", "naive_bayes"))
        out = flows.model_then_group(df, spec, trained)
        assert "split(" not in plan(out) and out.columns == df.columns
        expected = flows.entity_repair(flows.model_repair(df, spec, trained), spec, ["label"])
        assert sorted(out.collect(), key=lambda r: r["id"]) == sorted(expected.collect(), key=lambda r: r["id"])
