from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablemend.operators import repair
from tablemend.operators.filters import violates
from tablemend.operators.repair import gated_repair, group_repair, row_repair
from tablemend.spec import (
    BINARY_COST,
    CONSTANT_COST,
    DESIGN_RULES,
    THREE_LEVEL_COST,
    TRIAL_DESIGN,
    EditRule,
    components,
    legal_tuples,
    rules_within,
)

ABC = ["a", "b", "c"]
RULES = (EditRule.of(a=1, b=1), EditRule.of(b=0, c=2))
DOMAINS = {"a": (0, 1), "b": (0, 1), "c": (0, 1, 2)}


def table(spark, n=300, entities=25, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        entity = None if i % 50 == 0 else (0 if i % 3 == 0 else rng.randrange(entities))
        cells = [rng.choice([0, 1, None]), rng.choice([0, 1]), rng.choice([0, 1, 2, 7])]
        rows.append((i, entity, *cells))
    return rows, spark.createDataFrame(rows, "id int, e int, a int, b int, c int")


def brute_force(rows, domains, rules, costs):
    """Entity repair by trying every legal tuple, group after group."""
    clean = [r for r in rows if not any(rule.forbids(dict(zip(ABC, r[2:]))) for rule in rules)]
    out = {r[0]: list(r[2:]) for r in rows}
    for group in components(ABC, rules):
        at = [ABC.index(a) for a in group]
        legal = legal_tuples(group, domains, rules_within(rules, group))
        freq = Counter(tuple(r[2 + i] for i in at) for r in clean)
        for entity in {r[1] for r in rows if r[1] is not None}:
            mine = [r for r in rows if r[1] == entity]

            def price(t):
                return sum(costs[a].cost(r[2 + i], v) for r in mine for a, i, v in zip(group, at, t))

            best = min(legal, key=lambda t: (price(t), -freq[t], t))
            for r in mine:
                for i, v in zip(at, best):
                    out[r[0]][i] = v
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cost", ["constant", "mixed"])
def test_group_repair_equals_brute_force(spark, seed, cost):
    rows, df = table(spark, seed=seed)
    costs = {a: CONSTANT_COST for a in ABC}
    if cost == "mixed":
        costs.update(a=BINARY_COST, c=THREE_LEVEL_COST)
    got = group_repair(df, "e", ABC, domains=DOMAINS, rules=RULES, cost=costs).collect()
    expected = brute_force(rows, DOMAINS, RULES, costs)
    assert {r["id"]: [r["a"], r["b"], r["c"]] for r in got} == expected


def test_group_repair_leaves_one_legal_value_per_entity_and_is_idempotent(spark):
    _, df = table(spark)
    options = dict(domains=DOMAINS, rules=RULES)
    once = group_repair(df, "e", ABC, **options)
    inside = once.filter("e is not null")
    assert inside.filter(violates(RULES)).count() == 0
    assert inside.select("e", *ABC).distinct().count() == inside.select("e").distinct().count()
    twice = group_repair(once, "e", ABC, **options)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_rows_without_an_entity_stay_as_they_are(spark):
    rows, df = table(spark)
    got = group_repair(df, "e", ABC, domains=DOMAINS, rules=RULES).filter("e is null").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[1] is None)


@pytest.mark.parametrize("costs", [CONSTANT_COST, THREE_LEVEL_COST])
def test_seen_values_repair_equals_the_repair_over_a_domain(spark, costs):
    rng = random.Random(5)
    rows = [(i, rng.randrange(20), rng.choice([0, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, e int, c int")
    closed = group_repair(df, "e", ["c"], domains={"c": (0, 1, 2)}, cost=costs)
    opened = group_repair(df, "e", ["c"], cost=costs)
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, opened.collect()))


def test_ties_go_to_the_frequent_value_then_to_the_smaller_one(spark):
    rows = [(1, "x"), (1, "y"), (2, "y"), (3, "p"), (3, "q")]
    df = spark.createDataFrame(rows, "e int, v string")
    got = {r["e"]: r["v"] for r in group_repair(df, "e", ["v"]).collect()}
    assert got == {1: "y", 2: "y", 3: "p"}


def test_random_ties_depend_on_the_seed_only(spark):
    df = spark.createDataFrame([(i, v) for i in range(60) for v in (0, 1)], "e int, v int")

    def winners(seed):
        out = group_repair(df, "e", ["v"], domains={"v": (0, 1)}, select="random", seed=seed)
        return {r["e"]: r["v"] for r in out.collect()}

    assert winners(1) == winners(1)
    assert set(winners(1).values()) == {0, 1}
    assert winners(1) != winners(2)


def test_bound_attributes_need_domains(spark):
    _, df = table(spark)
    with pytest.raises(ValueError):
        group_repair(df, "e", ABC, rules=RULES)


def test_design_rules_on_all_ten_attributes(spark):
    attrs = list(TRIAL_DESIGN.domains)
    rng = random.Random(3)
    rows = [(i % 9, *[rng.choice(TRIAL_DESIGN.domains[a]) for a in attrs]) for i in range(90)]
    df = spark.createDataFrame(rows, "e int, " + ", ".join(f"{a} int" for a in attrs))
    out = group_repair(df, "e", attrs, domains=TRIAL_DESIGN.domains, rules=DESIGN_RULES)
    assert out.filter(violates(DESIGN_RULES)).count() == 0
    assert out.distinct().count() == 9


@pytest.mark.parametrize("joint", [True, False])
@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("tabled", [True, False])
def test_row_repair_equals_brute_force(spark, joint, fill, tabled, monkeypatch):
    monkeypatch.setattr(repair, "_TABLED_CHOICES", 10_000 if tabled else 0)
    rows, df = table(spark)
    got = row_repair(df, ABC, domains=DOMAINS, rules=RULES, joint=joint, fill_nulls=fill).collect()
    clean = [r for r in rows if not any(x.forbids(dict(zip(ABC, r[2:]))) for x in RULES)]
    legal = [t for t in product((0, 1), (0, 1), (0, 1, 2)) if not any(x.forbids(dict(zip(ABC, t))) for x in RULES)]
    freq = Counter(r[2:] for r in clean)
    singles = [Counter(r[2 + i] for r in clean) for i in range(3)]

    def tie(t):
        return (-freq[t],) if joint else tuple(-singles[i][v] for i, v in enumerate(t))

    for r in got:
        old = rows[r["id"]][2:]
        broken = any(x.forbids(dict(zip(ABC, old))) for x in RULES)
        new = (r["a"], r["b"], r["c"])
        if broken or (fill and None in old):
            assert new == min(legal, key=lambda t: (sum(CONSTANT_COST.cost(o, v) for o, v in zip(old, t)), tie(t), t))
        else:
            assert new == old


def test_gate(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (1, 0, 0.4), (None, 0, 0.1)], "v int, pred int, conf double")

    def after(tau):
        return [r["v"] for r in gated_repair(df, "v", tau).collect()]

    assert after(0.5) == [0, 1, 0]
    assert after(0.0) == [0, 0, 0]
    assert after(1.1) == [1, 1, 0]
    assert [r["v_orig"] for r in gated_repair(df, "v", 0.5).collect()] == [1, 1, None]


def test_a_hot_entity_is_counted_not_gathered(spark):
    """No window and no list over an entity's rows: one aggregate row per entity after the scan."""
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("e"), (F.col("id") % 2).cast("int").alias("v")
    )
    plan = group_repair(df, "e", ["v"], domains={"v": (0, 1)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "Cross" not in plan
    assert "collect" not in plan


@pytest.mark.parametrize("select", ["frequency", "random"])
@pytest.mark.parametrize("costs", [CONSTANT_COST, THREE_LEVEL_COST, BINARY_COST])
def test_long_domains_are_repaired_as_short_ones(spark, monkeypatch, costs, select):
    """Values in and out of the domain, nulls, an entity with nothing, domain values that nobody has, listed costs."""
    rng = random.Random(6)
    pool = [0, 1, 2, 3, 8, 9, None]
    rows = [(i, rng.randrange(40), rng.choice(pool), rng.choice(pool)) for i in range(200)]
    rows += [(900 + i, 77, None, 9) for i in range(3)] + [(990, None, 3, 3)]
    df = spark.createDataFrame(rows, "id int, e int, c int, d int")
    options = dict(domains={"c": (5, 0, 1, 2, 3), "d": (2, 1, 0)}, cost=costs, select=select)
    short = group_repair(df, "e", ["c", "d"], **options)
    monkeypatch.setattr(repair, "_COUNTED_DOMAIN", 0)
    long = group_repair(df, "e", ["c", "d"], **options)
    assert long.columns == short.columns and long.schema["c"].dataType == short.schema["c"].dataType
    if select == "frequency":
        assert sorted(map(tuple, long.collect()), key=str) == sorted(map(tuple, short.collect()), key=str)
        return
    before = {r["id"]: r for r in df.collect()}
    price = {}
    for name, out in (("short", short), ("long", long)):
        changed = {(r["e"], a): 0 for r in rows_of(out) for a in "cd"}
        for r in rows_of(out):
            for a in "cd":
                assert r[a] in options["domains"][a]
                changed[r["e"], a] += costs.cost(before[r["id"]][a], r[a])
        price[name] = changed
    assert price["long"] == price["short"]


def rows_of(out):
    return out.filter("e is not null").collect()


def test_a_domain_of_many_values_mixes_with_rules_and_open_values(spark):
    rows, df = table(spark)
    df = df.withColumn("v", (F.col("id") * 7 % 23).cast("int")).withColumn("w", F.col("id") % 5)
    domains = {**DOMAINS, "v": range(11, 30_000)}
    got = group_repair(df, "e", [*ABC, "v", "w"], domains=domains, rules=RULES).filter("e is not null")
    expected = brute_force(rows, DOMAINS, RULES, {a: CONSTANT_COST for a in ABC})
    assert {r["id"]: [r["a"], r["b"], r["c"]] for r in got.collect()} == {r[0]: expected[r[0]] for r in rows if r[1] is not None}
    assert got.filter("v < 11 or v > 22").count() == 0
    assert got.select("e", "v", "w").distinct().count() == got.select("e").distinct().count()
