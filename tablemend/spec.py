"""Descriptions of what is to be repaired: datasets, edit rules and change costs.

Everything here is small driver-side data. Its size follows from the schema (labels, domains,
rules), never from the rows, so it may become literals inside a plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = int | float | str


@dataclass(frozen=True)
class EditRule:
    """A combination ``attribute = value and ...`` that must not occur in a row."""

    terms: tuple[tuple[str, Value], ...]

    @classmethod
    def of(cls, **terms: Value) -> EditRule:
        return cls(tuple(terms.items()))

    @property
    def attributes(self) -> frozenset[str]:
        return frozenset(a for a, _ in self.terms)

    def violated(self) -> Column:
        """True where the row matches the forbidden combination; a null never matches."""
        hit = reduce(lambda x, y: x & y, [F.col(a) == F.lit(v) for a, v in self.terms])
        return F.coalesce(hit, F.lit(False))

    def forbids(self, row: Mapping[str, Value]) -> bool:
        return all(row.get(a) == v for a, v in self.terms)

    def renamed(self, names: Mapping[str, str]) -> EditRule:
        """The same rule about other columns."""
        return EditRule(tuple((names.get(a, a), v) for a, v in self.terms))


@dataclass(frozen=True)
class Implication:
    """If one attribute has a value, another must have its own: ``given = (a, v)``, ``implied = (b, w)``.

    It is a rule like `EditRule`, and says in one what edit rules would say once for every other value of the second attribute.
    """

    given: tuple[str, Value]
    implied: tuple[str, Value]

    @property
    def attributes(self) -> frozenset[str]:
        return frozenset((self.given[0], self.implied[0]))

    def violated(self) -> Column:
        """True where the first value stands beside another one than the implied; a null violates nothing."""
        (a, v), (b, w) = self.given, self.implied
        return F.coalesce((F.col(a) == F.lit(v)) & (F.col(b) != F.lit(w)), F.lit(False))

    def forbids(self, row: Mapping[str, Value]) -> bool:
        (a, v), (b, w) = self.given, self.implied
        return row.get(a) == v and row.get(b) is not None and row[b] != w

    def renamed(self, names: Mapping[str, str]) -> Implication:
        """The same rule about other columns."""
        (a, v), (b, w) = self.given, self.implied
        return Implication((names.get(a, a), v), (names.get(b, b), w))


@dataclass(frozen=True)
class CostModel:
    """Cost of changing ``old`` into ``new``; an unlisted change costs ``default``."""

    changes: Mapping[tuple[Value, Value], int] = field(default_factory=dict)
    default: int = 1
    null_cost: int = 1

    def cost(self, old: Value | None, new: Value) -> int:
        if old is None:
            return self.null_cost
        return 0 if old == new else self.changes.get((old, new), self.default)

    @property
    def is_constant(self) -> bool:
        return not self.changes


@dataclass(frozen=True)
class RepairSpec:
    """One dataset: entity key, source column, evidence text, attributes and their domains."""

    name: str
    partial_key: str
    source: str
    text: str
    labels: tuple[str, ...]
    domains: Mapping[str, tuple[Value, ...]]
    rules: tuple[EditRule, ...] = ()
    cost: CostModel = CostModel()
    encoders: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    order: str | None = None

    @property
    def full_key(self) -> tuple[str, str]:
        return (self.partial_key, self.source)


def rules_within(rules: Iterable[EditRule], attrs: Iterable[str]) -> list[EditRule]:
    """The rules whose attributes all belong to ``attrs``."""
    chosen = set(attrs)
    return [r for r in rules if r.attributes <= chosen]


def rules_about(rules: Iterable[EditRule], attr: str) -> list[EditRule]:
    """The rules that mention ``attr``."""
    return [r for r in rules if attr in r.attributes]


def components(attrs: Sequence[str], rules: Iterable[EditRule]) -> list[list[str]]:
    """Attributes grouped so that no rule spans two groups; costs add up across groups."""
    groups = [{a} for a in attrs]
    for rule in rules_within(rules, attrs):
        linked = [g for g in groups if g & rule.attributes]
        groups = [g for g in groups if not g & rule.attributes] + [set().union(*linked)]
    ranked = [[a for a in attrs if a in g] for g in groups]
    return sorted(ranked, key=lambda g: attrs.index(g[0]))


MAX_LEGAL_TUPLES = 10_000


def legal_tuples(
    attrs: Sequence[str], domains: Mapping[str, Sequence[Value]], rules: Iterable[EditRule]
) -> list[tuple[Value, ...]]:
    """All value combinations of ``attrs`` that break no rule, in ascending value order."""
    sizes = [len(domains[a]) for a in attrs]
    n = reduce(lambda x, y: x * y, sizes, 1)
    if n > MAX_LEGAL_TUPLES:
        raise ValueError(f"{n} combinations of {list(attrs)}: split the rules or shrink the domains")
    rules = list(rules)
    rows = product(*(sorted(domains[a]) for a in attrs))
    return [t for t in rows if not any(r.forbids(dict(zip(attrs, t))) for r in rules)]


# ---------------------------------------------------------------------------------------------
# Dataset descriptions, rules, costs. They decide the results, so they are stated
# as they are.
# ---------------------------------------------------------------------------------------------

YES_NO = {"Yes": 1, "No": 0}

# Combinations that must not occur in a trial design.
DESIGN_RULES = (
    EditRule.of(open=1, double_blind=1),
    EditRule.of(single_blind=1, double_blind=1),
    EditRule.of(open=1, single_blind=1),
    EditRule.of(open=0, single_blind=0, double_blind=0),
    EditRule.of(controlled=0, placebo=1),
    EditRule.of(controlled=0, active_comparator=1),
    EditRule.of(controlled=1, arms=0),
    EditRule.of(placebo=1, arms=0),
    EditRule.of(arms=0, active_comparator=1),
    EditRule.of(placebo=1, arms=1),
    EditRule.of(arms=1, active_comparator=1),
    EditRule.of(parallel_group=1, crossover=1),
)

# The masking rules again, on the undecoded values.
MASKING_RULES = (
    EditRule.of(open="Yes", double_blind="Yes"),
    EditRule.of(single_blind="Yes", double_blind="Yes"),
    EditRule.of(open="Yes", single_blind="Yes"),
    EditRule.of(open="No", single_blind="No", double_blind="No"),
)

CONSTANT_COST = CostModel()
# 0 = absent, 1 = traces, 2 = present: declaring something absent is the risky change.
THREE_LEVEL_COST = CostModel({(0, 1): 1, (0, 2): 1, (1, 0): 3, (1, 2): 1, (2, 0): 3, (2, 1): 3})
BINARY_COST = CostModel({(0, 1): 1, (1, 0): 2})

_DESIGN_LABELS = (
    "open", "arms", "double_blind", "single_blind", "controlled", "parallel_group", "crossover", "randomised",
)
_POPULATION_LABELS = ("elderly", "adults", "adolescents", "children", "female", "male", "healthy_volunteers")
_ALLERGEN_LABELS = ("nuts", "milk", "gluten", "soy", "peanut", "eggs")

TRIAL_DESIGN = RepairSpec(
    name="trials_design",
    partial_key="eudract_number",
    source="protocol_country_code",
    text="title",
    labels=_DESIGN_LABELS,
    domains={a: (0, 1, 2) if a == "arms" else (0, 1) for a in (*_DESIGN_LABELS, "placebo", "active_comparator")},
    rules=DESIGN_RULES,
    encoders={
        a: {"0": 0, "1": 1, "2+": 2} if a == "arms" else YES_NO
        for a in (*_DESIGN_LABELS, "placebo", "active_comparator")
    },
)

TRIAL_POPULATION = RepairSpec(
    name="trials_population",
    partial_key="eudract_number",
    source="protocol_country_code",
    text="inclusion",
    labels=_POPULATION_LABELS,
    domains={a: (0, 1) for a in _POPULATION_LABELS},
    cost=BINARY_COST,
)

ALLERGENS = RepairSpec(
    name="allergens",
    partial_key="code",
    source="source",
    text="ingredients",
    labels=_ALLERGEN_LABELS,
    domains={a: (0, 1, 2) for a in _ALLERGEN_LABELS},
    cost=THREE_LEVEL_COST,
)

# Scale of the learned confidence threshold, imbalance ratio below which classes are over-sampled,
# folds and parallel fits of the grid search, naive Bayes smoothing.
CONFIDENCE_SCALE = 0.9
IMBALANCE_LIMIT = 0.3
FOLDS = 2
PARALLEL_FITS = 5
NAIVE_BAYES_SMOOTHING = 0.8

NULL_SYMBOLS = ("", "?", "[]", "-")
NULL_SENTINEL = "A Null Cell"

AGE_LABELS = ("elderly", "adults", "adolescents", "children")
# Years of age that define each age label: [from, to).
AGE_BANDS = {"elderly": (65, 300), "adults": (17, 65), "adolescents": (10, 17), "children": (1, 10)}

# Phrases (regular expressions) that count as evidence for a population label.
POPULATION_PHRASES = {
    "elderly": (
        ">= 65", ">= 75", "(6[5-9]|[7-9][0-9])", "elderly", "senior citizens", "retirees", "older adults",
        "geriatric population", "aging population",
    ),
    "adults": (
        ">= ?18", "> ?17", "(19|[2-6][0-9])", "40 to 60", "18 to 25", "adults", "grown-ups", "mature individuals",
        "working population", "middle-aged", "responsible individuals", "parents",
    ),
    "adolescents": (
        "< 18", "<= 17", "[^>=]{1,2}\\s?1[0-8]", "adolescents", "teenagers", "youths", "pubescents", "young adults",
        "high school students",
    ),
    "subjects_under_18": (
        "< ?18", "<= 17", "[^>=]{1,2}[1[0-8]|[0-9]]", "subjects_under_18", "minors", "juveniles",
        "underage individuals", "children and teens", "legal minors", "dependents",
    ),
    "children": (
        "< ?18", "<= ?17", "(?:[^>])+([10|[0-9]])", "children", "kid", "kids", "minors", "infants", "toddlers",
        "youngsters", "offspring",
    ),
    "female": ("women", "woman", "girls", "ladies", "females", "female", "womenfolk", "sisters"),
    "male": ("men", "man", "boys", "gentlemen", "male", "males", "brothers", "sons"),
    "others": (
        "non-binary individuals", "gender non-conforming", "diverse individuals", "those outside the binary",
        "genderqueer individuals", "people of all genders",
    ),
}
