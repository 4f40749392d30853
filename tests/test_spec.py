from tablemend.spec import (
    BINARY_COST,
    DESIGN_RULES,
    THREE_LEVEL_COST,
    TRIAL_DESIGN,
    EditRule,
    components,
    legal_tuples,
    rules_about,
    rules_within,
)

DESIGN_ATTRS = [
    "open", "arms", "double_blind", "single_blind", "controlled", "parallel_group", "crossover", "randomised",
    "placebo", "active_comparator",
]


def test_components_follow_the_rules():
    groups = components(DESIGN_ATTRS, DESIGN_RULES)
    assert [set(g) for g in groups] == [
        {"open", "double_blind", "single_blind"},
        {"arms", "controlled", "placebo", "active_comparator"},
        {"parallel_group", "crossover"},
        {"randomised"},
    ]


def test_numbers_of_legal_tuples():
    sizes = [
        len(legal_tuples(g, TRIAL_DESIGN.domains, rules_within(DESIGN_RULES, g)))
        for g in components(DESIGN_ATTRS, DESIGN_RULES)
    ]
    assert sizes == [3, 8, 3, 2]


def test_legal_tuples_refuse_a_huge_domain():
    import pytest

    with pytest.raises(ValueError):
        legal_tuples(["a", "b"], {"a": range(200), "b": range(200)}, [])


def test_rule_restriction():
    assert len(rules_within(DESIGN_RULES, ["open", "double_blind"])) == 1
    assert len(rules_about(DESIGN_RULES, "arms")) == 5
    assert EditRule.of(a=1, b=2).forbids({"a": 1, "b": 2, "c": 3})
    assert not EditRule.of(a=1, b=2).forbids({"a": 1})


def test_costs():
    assert [THREE_LEVEL_COST.cost(1, 0), THREE_LEVEL_COST.cost(0, 2), THREE_LEVEL_COST.cost(2, 2)] == [3, 1, 0]
    assert [BINARY_COST.cost(0, 1), BINARY_COST.cost(1, 0), BINARY_COST.cost(None, 1)] == [1, 2, 1]
