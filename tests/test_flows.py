from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablemend.operators.evaluate import Cells
from tablemend.operators.joins import attach_gold
from tablemend.operators.repair import gated
from tablemend.plans import flows
from tablemend.spec import ALLERGENS, EditRule, Implication

LABELS = list(ALLERGENS.labels)
COLUMNS = "code long, source string, " + ", ".join(f"{a} int" for a in LABELS)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    dirty, gold = [], []
    for code in range(40):
        truth = [rng.choice([0, 1, 2]) for _ in LABELS]
        if code < 30:
            gold.append((code, *truth))
        for s in range(rng.randrange(1, 6)):
            cells = [v if rng.random() < 0.7 else rng.choice([0, 1, 2, None]) for v in truth]
            dirty.append((code, f"s{s}", *cells))
    dirty.append(dirty[0])  # a full key that is not unique
    gold_columns = "code long, " + ", ".join(f"{a} int" for a in LABELS)
    return dirty, gold, spark.createDataFrame(dirty, COLUMNS), spark.createDataFrame(gold, gold_columns)


def counted(original, repaired, gold):
    """Counters per attribute by looking every row up."""
    truth = {g[0]: g[1:] for g in gold}
    by_key = {}
    for r in repaired:
        by_key.setdefault(r[:2], []).append(r[2:])
    out = {a: [0, 0, 0] for a in LABELS}
    for row in original:
        if row[0] not in truth or len(by_key.get(row[:2], [])) != 1:
            continue
        for i, a in enumerate(LABELS):
            old, new, right = row[2 + i], by_key[row[:2]][0][i], truth[row[0]][i]
            out[a][0] += old != right
            out[a][1] += old != new
            out[a][2] += old != new and new == right
    return out


def test_entity_repair_under_the_three_level_costs(spark, world):
    dirty, _, df, _ = world
    repaired = flows.entity_repair(df, ALLERGENS).collect()
    frequency = [Counter(r[2 + i] for r in dirty) for i in range(len(LABELS))]
    for code in {r[0] for r in dirty}:
        for i, a in enumerate(LABELS):
            seen = [r[2 + i] for r in dirty if r[0] == code]
            best = min((0, 1, 2), key=lambda v: (sum(ALLERGENS.cost.cost(o, v) for o in seen), -frequency[i][v], v))
            assert {r[a] for r in repaired if r["code"] == code} == {best}


def test_strategies_are_counted_as_by_hand(spark, world):
    dirty, gold, df, gold_df = world
    grouped = flows.entity_repair(df, ALLERGENS)
    partial = df.filter("source <> 's1'").withColumn("milk", F.lit(2))
    repairs = {"group": grouped, "partial": partial, "nothing": df}
    rows = flows.compare(df, repairs, gold_df, ALLERGENS, LABELS).collect()
    assert len(rows) == 3 * (len(LABELS) + 1)
    for name, repaired in repairs.items():
        wanted = counted(dirty, [tuple(r) for r in repaired.select("code", "source", *LABELS).collect()], gold)
        got = {r["attr"]: [r["errors"], r["repairs"], r["correct"]] for r in rows if r["strategy"] == name}
        assert {a: got[a] for a in LABELS} == wanted
        assert got["*"] == [sum(c[i] for c in wanted.values()) for i in range(3)]
    assert all(r["correct"] <= min(r["errors"], r["repairs"]) for r in rows)


def test_robustness_equals_a_run_per_prefix(spark, world):
    _, gold, df, gold_df = world
    cells = attach_gold(df, gold_df, "code", LABELS).withColumns({f"{a}_rep": F.lit(1) for a in LABELS})
    rows = cells.collect()
    order = [s for s, _ in sorted(Counter(r["source"] for r in rows).items(), key=lambda x: (-x[1], x[0]))]
    got = {(r["source_rank"], r["n_attrs"]): r for r in flows.robustness(cells, ALLERGENS, LABELS, Cells()).collect()}
    assert len(got) == len(order) * len(LABELS)
    for s in range(1, len(order) + 1):
        inside = [r for r in rows if r["source"] in order[:s]]
        for n in range(1, len(LABELS) + 1):
            errors = sum(r[a] != r[f"{a}_gs"] for r in inside for a in LABELS[:n])
            repairs = sum(r[a] != 1 for r in inside for a in LABELS[:n])
            assert (got[s, n]["errors"], got[s, n]["repairs"]) == (errors, repairs)


def test_joins_at_a_hot_key_can_be_split(spark, world):
    """The large side and the per-entity side both come straight from a shuffle made for the join."""
    _, _, df, _ = world
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flows.entity_repair(df, ALLERGENS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.split("- ")[-1].strip(" :+-") for line in plan.splitlines()]
    sorts = [i for i, line in enumerate(lines) if line.startswith("Sort [_joined_key")]
    assert len(sorts) == 2
    assert all(lines[i + 1].startswith("Exchange hashpartitioning(_joined_key") for i in sorts)


def _scored(df):
    """Predictions and confidences by a rule, so that the models of the comparison are known."""
    spot = F.pmod(F.xxhash64("code", "source"), F.lit(1000))
    return df.withColumns(
        {f"{a}_pred": F.pmod(spot + i, F.lit(3)).cast("int") for i, a in enumerate(LABELS)}
        | {f"{a}_conf": F.pmod(spot * (i + 2), F.lit(100)) / 100.0 for i, a in enumerate(LABELS)}
    )


@pytest.mark.parametrize("ruled", [False, True])
def test_strategies_in_one_pass_equal_the_repaired_tables(spark, world, ruled):
    _, _, df, gold_df = world
    rules = (EditRule.of(milk=0, nuts=2), Implication(("gluten", 1), ("soy", 1))) if ruled else ()
    spec = replace(ALLERGENS, rules=rules)
    taus = {a: 0.3 + i / 10 for i, a in enumerate(LABELS)}
    scored = _scored(df)

    def modelled(rows):
        return rows.withColumns({a: gated(F.col(a), F.col(f"{a}_pred"), F.col(f"{a}_conf"), taus[a]) for a in LABELS})

    outside = {
        "partial": df.filter("source <> 's1'").withColumn("milk", F.lit(2)),
        "doubled": df.unionByName(df.filter("source = 's0'")),
    }
    repairs = {
        "model": modelled(scored),
        "group": flows.entity_repair(scored, spec, LABELS),
        "model_then_group": flows.entity_repair(modelled(scored), spec, LABELS),
        "group_then_model": modelled(flows.entity_repair(scored, spec, LABELS)),
    } | outside
    wanted = sorted(map(tuple, flows.compare(df, repairs, gold_df, spec, LABELS).collect()))
    got = flows.compare_in_one_pass(scored, gold_df, spec, taus, outside)
    assert sorted(map(tuple, got.select("strategy", "attr", "errors", "repairs", "correct", "precision", "recall", "f1").collect())) == wanted
    single = df.dropDuplicates(["code", "source"])
    alike = [flows.compare_in_one_pass(_scored(single), gold_df, spec, taus, unique=u).collect() for u in (False, True)]
    assert sorted(map(tuple, alike[0])) == sorted(map(tuple, alike[1])) and len(alike[0]) == 4 * (len(LABELS) + 1)
    nothing = flows.compare_in_one_pass(scored.limit(0), gold_df, spec, taus, outside).collect()
    assert len(nothing) == 6 * (len(LABELS) + 1) and not any(r.errors for r in nothing)


def test_comparison_in_one_pass_reads_the_rows_three_times(spark, world, tmp_path):
    """For the cells, for the counts of the entities, and for the frequencies that break ties; six strategies or four."""
    _, _, df, gold_df = world
    _scored(df.dropDuplicates(["code", "source"])).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    taus = dict.fromkeys(LABELS, 0.5)
    outside = {"one": df.withColumn("milk", F.lit(1)), "two": df.withColumn("milk", F.lit(2))}
    plan = flows.compare_in_one_pass(rows, gold_df, ALLERGENS, taus, outside, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "CartesianProduct" not in plan and "Python" not in plan
