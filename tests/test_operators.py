from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemend.functions import evidence, numbers, text
from tablemend.functions.encoding import label_encoder
from tablemend.operators import evaluate, filters, joins, mining, ranking, selection, votes
from tablemend.operators.aggregates import sources_per_key
from tablemend.operators.filters import violates
from tablemend.operators.repair import group_repair, row_repair
from tablemend.spec import DESIGN_RULES, POPULATION_PHRASES, EditRule, Implication


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells))
    return df.select(column.alias("x")).first()["x"]


def test_strip_accents_follows_the_decomposition(spark):
    import unicodedata

    sample = "Glüten façade ½ ﬁn №7 ™ … ’quote’ 日本 Ⅷ ß İstanbul é 𝐀 plain"
    wanted = unicodedata.normalize("NFKD", sample).encode("ascii", "ignore").decode()
    df = spark.createDataFrame([(sample,), ("plain",), (None,)], "t string")
    got = [r[0] for r in df.select(text.strip_accents(F.col("t"))).collect()]
    assert got == [wanted, "plain", None]


def test_words_with_digits_are_no_words(spark):
    got = one(spark, text.content_words(F.col("t")), t="The Glüten e120 and MILK, (soy) the")
    assert got == ["gluten", "milk", "soy"]


def test_bounded_substring(spark):
    df = spark.createDataFrame([("a [b] E12 rest;",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(text.bounded_substring(F.col("t"), "a [", ";")).collect()]
    assert got == ["b]  rest", None]


def test_round_share_agrees_with_python(spark):
    shares = [(a / b,) for b in range(1, 401) for a in range(b + 1)]
    df = spark.createDataFrame(shares, "x double").select("x", numbers.round_share(F.col("x")).alias("r"))
    assert all(r["r"] == round(r["x"], 2) for r in df.collect())


def test_label_encoders():
    assert label_encoder(["2+", "1", "0"]) == {"2+": 2, "1": 1, "0": 0}
    assert label_encoder(["No", "Yes", "maybe"]) == {"Yes": 1, "No": 0}


def test_rules_and_missing_values(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (0, 1)], "open int, double_blind int")
    rules = [EditRule.of(open=1, double_blind=1)]
    assert filters.violating(df, rules).count() == 1
    assert filters.satisfying(df, rules).count() == 3


def test_violations_of_the_design_rules(spark):
    attrs = sorted({a for r in DESIGN_RULES for a in r.attributes})
    rng = random.Random(4)
    rows = [(i, *[rng.choice([0, 1]) for _ in attrs]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{a} int" for a in attrs))
    got = {r["id"]: r["rule_ids"] for r in filters.violation_list(df, DESIGN_RULES, ["id"]).collect()}
    wanted = {r[0]: [i for i, x in enumerate(DESIGN_RULES) if x.forbids(dict(zip(attrs, r[1:])))] for r in rows}
    assert got == {k: v for k, v in wanted.items() if v}


def test_evidence_for_population_labels(spark):
    df = spark.createDataFrame(
        [("Women aged 18 to 25 years",), ("men only",), ("Elderly patients, 70 years of age",), (None,)], "t string"
    )
    rows = df.select(
        *[evidence.evidence_for(F.col("t"), a).alias(a) for a in ("female", "male", "elderly")],
        evidence.age_phrase(F.col("t"), POPULATION_PHRASES["elderly"]).alias("aged"),
    ).collect()
    assert [r["female"] for r in rows] == [True, False, False, False]
    assert [r["male"] for r in rows] == [False, True, False, False]
    assert [r["elderly"] for r in rows] == [False, False, True, False]
    assert [r["aged"] for r in rows] == [False, False, True, False]


@pytest.mark.parametrize("words,named", [("men", True), ("two men.", True), ("émen", False), ("men_", False), ("menü", False), ("", False)])
def test_words_end_where_letters_of_any_script_end(spark, words, named):
    assert one(spark, evidence.any_phrase(F.col("t"), ("men",)), t=words) is named


def test_sources_of_a_null_key(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), (None, "z")], "k string, s string")
    assert [tuple(r) for r in sources_per_key(df, "k", "s").collect()] == [("a", ["x", "y"])]


def test_row_support(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "women of 70 years", "pregnant women"),
            (1, 0, "anyone", "women"),
            (1, 0, "anyone", "children"),
            (0, 1, "women", "men"),
            (1, 1, None, "women"),
        ],
        "female int, elderly int, incl string, excl string",
    )
    kept = filters.keep_supported(df, ["female", "elderly"], "incl", "excl").collect()
    assert [(r["female"], r["incl"]) for r in kept] == [(1, "women of 70 years"), (1, "anyone"), (1, None)]


def test_age_bands(spark):
    df = spark.createDataFrame([("18 Years", "64 Years"), ("6 Months", "9 Years"), (None, None)], "low string, high string")
    low, high = evidence.years(F.col("low")), evidence.years(F.col("high"))
    bands = [evidence.age_in_band(high, low, *b).alias(str(i)) for i, b in enumerate([(65, 300), (17, 65), (10, 17), (1, 10)])]
    assert [tuple(r) for r in df.select(*bands).collect()] == [
        (False, True, False, False), (False, False, False, True), (True, True, True, True),
    ]


def test_majority_vote_of_one_sided_tied_and_missing_votes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", 0), ("c", 0), ("d", None)], "k string, v int")
    got = {r["k"]: r["v"] for r in votes.majority_vote(df, "k", ["v"]).collect()}
    assert got == {"a": None, "b": 1, "c": 0, "d": None}
    assert votes.majority_vote(df, "k", ["v"], complete=True).count() == 3


def test_strict_match_fails_where_a_row_has_no_partner(spark):
    left = spark.createDataFrame([(1, 0), (2, 1)], "k int, a int")
    right = spark.createDataFrame([(1, 1)], "k int, a int")
    assert joins.match_counts(joins.match_three(left, right, left, ["k"], ["a"])).count() == 2
    with pytest.raises(Exception, match="no match for key"):
        joins.match_three(left, right, left, ["k"], ["a"], strict=True).collect()
    assert joins.match_three(left, left, left, ["k"], ["a"], strict=True).count() == 2


def test_exact_rank_of_a_hot_group(spark):
    rows = [(i, 0 if i % 3 else i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g int")
    order, bucket = ranking.hash_slice("id")
    got = ranking.exact_rank(df.withColumn("h", order), ["g"], ["h", "id"], bucket).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["h"], r["id"], r["rank"]) for r in got if r["g"] == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_positions_are_global(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("o", -F.col("id"))
    got = ranking.numbered(df, ["o"]).collect()
    assert all(r["position"] == 4999 - r["id"] for r in got) and len(got) == 5000


def test_split_keeps_all_classes_on_both_sides(spark):
    rows = [(i, 0 if i < 990 else i % 3) for i in range(1000)] + [(1000, 9)]
    df = spark.createDataFrame(rows, "id int, label int")
    order, _ = ranking.hash_slice("id")
    parts = selection.split_train_valid(df, "label", F.pmod(order, F.lit(100)), "id").collect()
    assert len(parts) == 1001
    train, valid = ({r["label"] for r in parts if r["part"] == p} for p in ("train", "valid"))
    assert train == {0, 1, 2, 9} and valid == {0, 1, 2}
    assert 50 < sum(r["part"] == "valid" for r in parts) < 160


def test_oversampling_fills_every_class(spark):
    rows = [(i, 0 if i % 10 else 1 + i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, label int")
    order, bucket = ranking.hash_slice("id")
    out = selection.oversample(df.withColumn("h", order), "label", ["h", "id"], bucket, 0.3)
    sizes = Counter(r["label"] for r in out.collect())
    assert set(sizes.values()) == {900}
    balanced = df.filter("label > 0")
    assert selection.oversample(balanced.withColumn("h", order), "label", ["h", "id"], bucket, 0.3).count() == 100


def test_sweep_equals_gating_at_every_threshold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, None]), rng.choice([0, 1]), rng.choice([0, 1]), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, a_gs int, a_pred int, a_conf double")
    steps = evaluate.sweep_thresholds(0.876)
    assert steps == [0.0, 0.2, 0.4, 0.6, 0.8, 0.88, 1.0]
    got = {r["threshold"]: r for r in evaluate.threshold_sweep(df, ["a"], steps).collect()}
    for t in steps:
        final = [p if c >= t or o is None else o for o, g, p, c in rows]
        assert got[t]["repairs"] == sum(o != f for (o, _, _, _), f in zip(rows, final))
        assert got[t]["correct"] == sum(o != f and f == g for (o, g, _, _), f in zip(rows, final))
        assert got[t]["errors"] == sum(o != g for o, g, _, _ in rows)
        assert got[t]["correct"] <= min(got[t]["errors"], got[t]["repairs"])


def test_rounded_quality_takes_f1_from_rounded_values(spark):
    df = spark.createDataFrame([("x", 172, 162, 69), ("none", 3, 0, 0)], "attr string, errors long, repairs long, correct long")
    rounded = evaluate.with_quality(df, rounded=True).collect()
    assert [tuple(r)[-3:] for r in rounded] == [(0.43, 0.4, 0.41), (0.0, 0.0, 0.0)]
    exact = evaluate.with_quality(df).first()
    assert math.isclose(exact["f1"], 0.4131736526946108)


def test_mined_pairs_become_rules(spark):
    df = spark.createDataFrame([("a", "x")] * 300 + [("a", "y")] + [("b", "y")] * 300, "p string, q string")
    found = mining.low_lift_pairs(df, ["p", "q"])
    assert mining.as_edit_rules(found, df.schema) == [EditRule((("p", "a"), ("q", "y")))]
    numbers_ = df.select(F.when(F.col("p") == "a", 1).otherwise(2).alias("p"), "q")
    rules = mining.as_edit_rules(mining.low_lift_pairs(numbers_, ["p", "q"]), numbers_.schema)
    assert rules == [EditRule((("p", 1), ("q", "y")))] and filters.violating(numbers_, rules).count() == 1
    forbidden = {tuple(r)[:4] for r in mining.association_rules(df, ["p", "q"]).collect()}
    assert ("p", "a", "q", "y") in forbidden and ("q", "x", "p", "b") in forbidden


def test_isolation_forest_finds_the_far_point(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100), rng.randrange(100)) for i in range(1000)] + [(1000, 5000, 5000), (1001, None, 3)]
    df = spark.createDataFrame(rows, "id int, x int, y int")
    scored = {r["id"]: r["score"] for r in mining.isolation_forest(df, ["x", "y"], threshold=None).collect()}
    assert max((s, i) for i, s in scored.items() if s is not None)[1] == 1000
    assert scored[1000] > 0.7 and scored[1001] is None
    assert all(0 < s < 1 for s in scored.values() if s is not None)


def test_a_null_key_is_no_entity_and_an_empty_table_has_no_accuracy(spark):
    from tablemend.operators.aggregates import accuracy, conflict_counts, conflicts, distinct_values

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert [r.k for r in conflicts(df, "k", "v").collect()] == ["a"]
    assert conflict_counts(df, "k", ["v"]).first().n_conflicts == 1
    assert {r.k for r in distinct_values(df, "k", ["v"]).collect()} == {"a", "b"}
    assert df.where("false").agg(accuracy(F.col("v"), F.col("v"))).first()[0] is None


def test_a_null_text_has_no_words(spark):
    from tablemend.operators.models import words_of

    df = spark.createDataFrame([(None,), ("Milk and soy",)], "t string")
    assert [r[0] for r in df.select(words_of("t")).collect()] == [[], ["milk", "soy"]]


def test_the_forest_does_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 10), rng.gauss(0, 10)) for i in range(3000)] + [(3000, 500.0, 500.0), (3001, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    scores = []
    for shaped in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("x")).repartition(3)):
        out = mining.isolation_forest(shaped, ["x", "y"], trees=10, sample=64, threshold=None, key=["id"]).collect()
        scores.append(sorted((r.id, r.score) for r in out if r.score is not None))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 3001


def test_implications_are_rules_of_their_own(spark):
    rows = [(i, "a", "x", "u") for i in range(300)] + [(300, "a", "y", "u"), (301, "a", None, "u")] + [(i, "b", f"z{i}", "v") for i in range(302, 600)]
    df = spark.createDataFrame(rows, "id int, first string, second string, third string")
    found = mining.implications(df, ["first", "second"])
    rules = mining.as_implications(found, df.schema)
    # One rule, however many values it rules out.
    assert Implication(("first", "a"), ("second", "x")) in rules and len(rules) <= 2
    assert [r.id for r in df.filter(violates(rules)).collect()] == [300]
    assert rules[0].attributes == {"first", "second"}
    one = [Implication(("first", "a"), ("second", "x"))]
    domains = {"first": ("a", "b"), "second": ("x", "y", "z")}
    listed = [EditRule.of(first="a", second="y"), EditRule.of(first="a", second="z")]
    few = spark.createDataFrame([(1, "a", "y"), (1, "a", "z"), (2, "b", "y"), (3, "a", "x"), (3, None, "x")], "k int, first string, second string")
    for repair in (lambda r: group_repair(few, "k", ["first", "second"], domains=domains, rules=r), lambda r: row_repair(few, ["first", "second"], domains=domains, rules=r)):
        assert sorted(map(str, repair(one).collect())) == sorted(map(str, repair(listed).collect()))


def test_ranks_do_not_depend_on_the_spread_of_keys(spark):
    """A group with most of the rows whose keys lie close together, small groups, a null group."""
    rows = [("big", 10**12 + i) for i in range(6000)] + [("small", i * 10**9) for i in range(7)] + [(None, 5), (None, -5)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5, "k")
    ranked = ranking.exact_rank(df, ["g"], ["k"]).collect()
    for group in ("big", "small", None):
        mine = sorted(k for g, k in rows if g == group)
        assert sorted((r["rank"], r["k"]) for r in ranked if r["g"] == group) == list(enumerate(mine, 1))
    assert ranking.exact_rank(df.filter("false"), ["g"], ["k"]).count() == 0
    held = {r["g"]: r["rank"] for r in ranking.exact_rank(df, ["g"], [F.desc("k")]).filter("k = -5 or k = 0").collect()}
    assert held == {None: 2, "small": 7}
