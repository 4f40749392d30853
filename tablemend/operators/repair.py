"""Repair of contradicting cells: per entity, per row, and by a confidence gate.

Entity repair never builds (entity, candidate) pairs. Attributes with a known domain need one
aggregate: a counter per domain value, combined on the map side, so that an entity holding a
third of all rows is one row per task after the scan. The cost of every legal combination is then
an expression over that one row. Attributes without a domain, or with a long one that no rule binds,
are counted per seen value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemend.operators.filters import satisfying, violates
from tablemend.operators.joins import join_per_key
from tablemend.spec import CONSTANT_COST, CostModel, EditRule, Value, components, legal_tuples, rules_within

Costs = CostModel | Mapping[str, CostModel]


def _cost_of(cost: Costs, attr: str) -> CostModel:
    return cost if isinstance(cost, CostModel) else cost.get(attr, CONSTANT_COST)


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to an entity: a null key names none."""
    return df.dropna(subset=list(keys))


# --- legal combinations as literals ---------------------------------------------------------


@dataclass(frozen=True)
class _Group:
    """Attributes solved together: their sorted domains and legal tuples, as positions in the domains."""

    attrs: tuple[str, ...]
    values: tuple[tuple[Value, ...], ...]
    legal: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, attrs: Sequence[str], domains: Mapping[str, Sequence[Value]], rules: Sequence[EditRule]) -> _Group:
        values = tuple(tuple(sorted(domains[a])) for a in attrs)
        tuples = legal_tuples(attrs, domains, rules)
        if not tuples:
            raise ValueError(f"the rules about {list(attrs)} forbid every combination")
        spots = tuple(tuple(vals.index(v) for vals, v in zip(values, t)) for t in tuples)
        return cls(tuple(attrs), values, spots)

    def literal(self) -> Column:
        rows = [
            F.struct(F.lit(i).alias("at"), *[F.lit(p).alias(f"p{j}") for j, p in enumerate(t)])
            for i, t in enumerate(self.legal)
        ]
        return F.array(*rows)

    def spots(self, t: Column) -> list[Column]:
        return [t[f"p{j}"] for j in range(len(self.attrs))]

    def winners(self, best: Column, schema: StructType) -> dict[str, Column]:
        """The values a winning tuple stands for, in the attributes' own types."""
        out = {}
        for j, (a, vals) in enumerate(zip(self.attrs, self.values)):
            domain = F.array(*[F.lit(v) for v in vals])
            out[a] = F.get(domain, best[f"p{j}"]).cast(schema[a].dataType)
        return out


def _number(group: _Group, cells: Sequence[Column] | None = None) -> Column:
    """A tuple as one number, from domain positions or (without ``cells``) from the row; null off the domains."""
    out = F.lit(0)
    for i, (a, vals) in enumerate(zip(group.attrs, group.values)):
        if cells is None:
            at = F.coalesce(*[F.when(F.col(a) == F.lit(v), F.lit(p)) for p, v in enumerate(vals)])
        else:
            at = cells[i]
        out = out * len(vals) + at
    return out


_COUNTERS_PER_PASS = 256
_COUNTED_DOMAIN = 64


def _legal_counts(clean: DataFrame, groups: Sequence[_Group]) -> DataFrame:
    """How often each legal tuple of each group occurs in ``clean``: one row, ``counts.g<i>`` for group i.

    A few hundred tuples are counted by counters in one pass without a shuffle; longer lists by a
    grouping per group.
    """
    if sum(len(g.legal) for g in groups) <= _COUNTERS_PER_PASS:
        numbered = clean.select(*[_number(g).alias(f"t{i}") for i, g in enumerate(groups)])
        counters = [
            F.array(*[F.count_if(F.col(f"t{i}") == _static_number(g, t)) for t in g.legal]).alias(f"g{i}")
            for i, g in enumerate(groups)
        ]
        return numbered.agg(F.struct(*counters).alias("counts"))
    arrays = []
    for i, g in enumerate(groups):
        counts = clean.select(_number(g).alias("t")).dropna().groupBy("t").agg(F.count("*").alias("n"))
        table = counts.agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("table"))
        found = F.transform(
            g.literal(), lambda t: F.coalesce(F.try_element_at(F.col("table"), _number(g, g.spots(t))), F.lit(0))
        )
        arrays.append(table.select(found.alias("counts")).scalar().alias(f"g{i}"))
    return clean.sparkSession.range(1).select(F.struct(*arrays).alias("counts"))


def _static_number(group: _Group, spots: Sequence[int]) -> int:
    out = 0
    for vals, p in zip(group.values, spots):
        out = out * len(vals) + p
    return out


def _cheapest(group: _Group, prices: Sequence[Column], ties) -> Column:
    """The legal tuple with the least sum of prices; ``ties(tuple)`` ranks equal sums.

    The prices are bound once, as the only element of an array, and not computed again per tuple.
    """
    names = [f"c{j}" for j in range(len(prices))]
    bound = F.array(F.struct(*[p.alias(n) for p, n in zip(prices, names)]))

    def solve(given: Column) -> Column:
        def ranked(t: Column) -> Column:
            spots = group.spots(t)
            total = _total([F.get(given[n], p) for n, p in zip(names, spots)])
            named = [p.alias(f"p{j}") for j, p in enumerate(spots)]
            return F.struct(total.alias("cost"), *[x.alias(f"t{j}") for j, x in enumerate(ties(t))], *named)

        return F.array_min(F.transform(group.literal(), ranked))

    return F.get(F.transform(bound, solve), F.lit(0))


# --- entity repair --------------------------------------------------------------------------


def _closed_winners(df, keys, groups, domains, rules, cost, select, clean, seed) -> DataFrame:
    groups = [_Group.of(g, domains, rules_within(rules, g)) for g in groups]
    attrs = [a for g in groups for a in g.attrs]
    counted = {
        a: sorted(set(domains[a]) | {old for old, _ in _cost_of(cost, a).changes}) for a in attrs
    }
    counters = [F.count("*").alias("_n")]
    for i, a in enumerate(attrs):
        counters.append(F.count(a).alias(f"_k{i}"))
        counters += [F.count_if(F.col(a) == F.lit(v)).alias(f"_n{i}_{j}") for j, v in enumerate(counted[a])]
    counts = _known(df, keys).groupBy(*keys).agg(*counters)

    def price(attr: str, new: Value) -> Column:
        """Cost of giving every row of the entity the value ``new``."""
        model, i = _cost_of(cost, attr), attrs.index(attr)
        seen = [(F.col(f"_n{i}_{j}"), old) for j, old in enumerate(counted[attr])]
        listed = _total([n * model.cost(old, new) for n, old in seen])
        nulls = F.col("_n") - F.col(f"_k{i}")
        others = F.col(f"_k{i}") - _total([n for n, _ in seen])
        return listed + nulls * model.null_cost + others * model.default

    if select == "frequency":
        counts = counts.withColumn("_seen", _legal_counts(clean, groups).scalar())
    bests = []
    for g, group in enumerate(groups):
        prices = [F.array(*[price(a, v) for v in vals]) for a, vals in zip(group.attrs, group.values)]

        def ties(t: Column) -> list[Column]:
            if select == "frequency":
                return [-F.get(F.col("_seen")[f"g{g}"], t["at"])]
            return [F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), t["at"])]

        bests.append(_cheapest(group, prices, ties).alias(f"_best_{g}"))
    solved = counts.select(*keys, *bests)
    won = {}
    for g, group in enumerate(groups):
        won.update(group.winners(F.col(f"_best_{g}"), df.schema))
    return solved.select(*keys, *[c.alias(f"_win_{a}") for a, c in won.items()])


def _open_winners(df, keys, attrs, domains, cost, select, clean, seed) -> DataFrame:
    """Winners among counted values; ``attrs`` share one data type, and some may be limited to a domain of any length.

    The cost of a candidate is, up to a constant of the entity, minus its own weighted count plus
    a correction for every listed change into it. So one row per seen value (plus the few listed
    targets) is enough, however many values an entity has. Of a domain, all values without such a row
    cost an entity the same: the first of them in tie order stands for all.
    """
    limited = [a for a in attrs if a in domains]

    def long(table: DataFrame, *columns: str, nulls: bool = False) -> DataFrame:
        cells = [F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in attrs]
        wanted = F.col("value").isNotNull()
        if nulls and limited:  # an entity without any value gets one of the domain
            wanted = wanted | F.col("attr").isin(limited)
        return table.select(*columns, F.inline(F.array(*cells))).filter(wanted)

    seen = long(df, *keys, nulls=True).groupBy(*keys, "attr", "value").agg(F.count("*").alias("n"))
    models = {a: _cost_of(cost, a) for a in attrs}
    weight = reduce(
        lambda rest, a: F.when(F.col("attr") == a, F.lit(models[a].default)).otherwise(rest), attrs, F.lit(1)
    )
    scored = _known(seen, keys).select(*keys, "attr", "value", (-weight * F.col("n")).alias("score"), "n")
    listed = {
        a: {(old, new): price for (old, new), price in models[a].changes.items() if old != new and price != models[a].default}
        for a in attrs
    }
    shifts = [
        F.when(
            (F.col("attr") == a) & (F.col("value") == F.lit(old)),
            F.struct(
                F.lit(new).cast(df.schema[a].dataType).alias("value"),
                (F.col("n") * (price - models[a].default)).alias("score"),
            ),
        )
        for a in attrs
        for (old, new), price in listed[a].items()
    ]
    if shifts:
        own = F.struct(F.col("value"), F.col("score"))
        scored = scored.select(*keys, "attr", F.inline(F.array_compact(F.array(own, *shifts))))
        scored = scored.groupBy(*keys, "attr", "value").agg(F.sum("score").alias("score"))

    def tied(value: Column) -> Column:
        return F.xxhash64(*keys, F.lit(seed), value)

    counts = None
    if select == "frequency":
        counts = seen if clean is df else long(clean).groupBy("attr", "value").agg(F.count("*").alias("n"))
        counts = counts.groupBy("attr", "value").agg(F.sum("n").alias("freq"))
    if limited:
        rows = [(a, v) for a in limited for v in dict.fromkeys(domains[a])]
        table = df.sparkSession.createDataFrame(rows, ["attr", "value"])
        table = table.withColumn("value", F.col("value").cast(df.schema[limited[0]].dataType))
        if counts is not None:
            table = table.join(counts, ["attr", "value"], "left").fillna(0, ["freq"])
            counts = table.unionByName(counts.filter(~F.col("attr").isin(limited)))
    if counts is not None:
        scored = join_per_key(scored, counts, ["attr", "value"])
        inside, tie = F.col("freq").isNotNull(), -F.coalesce(F.col("freq"), F.lit(0))
    else:
        if limited:
            scored = join_per_key(scored, table.withColumn("inside", F.lit(True)), ["attr", "value"])
        inside, tie = F.col("inside").isNotNull() if limited else None, tied(F.col("value"))
    rank = F.struct(F.col("score"), tie.alias("tie"), F.col("value"))
    best = {a: F.when((F.col("attr") == a) & (inside if a in limited else F.lit(True)), rank) for a in attrs}
    if not limited:
        return scored.groupBy(*keys).agg(*[F.min_by("value", best[a]).alias(f"_win_{a}") for a in attrs])

    held, spared = [], {}
    for i, a in enumerate(attrs):
        held.append(F.min(best[a]).alias(f"_best_{i}"))
        if a in limited:
            targets = list({new for _, new in listed[a]})
            held.append(F.collect_set(F.when((F.col("attr") == a) & F.col("value").isin(targets), F.col("value"))).alias(f"_told_{i}"))
            mine = table.filter(F.col("attr") == a)
            if counts is not None:  # those told apart by listed changes are few, so the first ones of the order suffice
                mine = mine.orderBy(F.desc("freq"), "value").limit(len(targets) + 1)
                ranked = F.struct((-F.col("freq")).alias("tie"), F.col("value"))
            else:
                ranked = F.struct(F.col("value"))
            spared[a] = mine.agg(F.array_sort(F.collect_list(ranked))).scalar()
    solved = scored.groupBy(*keys).agg(*held).withColumns({f"_rest_{attrs.index(a)}": s for a, s in spared.items()})
    score_type, wins = scored.schema["score"].dataType, []
    for i, a in enumerate(attrs):
        won = F.col(f"_best_{i}")
        if a in limited:
            told = F.col(f"_told_{i}")
            free = F.filter(F.col(f"_rest_{i}"), lambda r: ~F.array_contains(told, r["value"]))
            zero = F.lit(0).cast(score_type).alias("score")
            free = F.transform(
                free,
                lambda r: F.struct(zero, (r["tie"] if counts is not None else tied(r["value"])).alias("tie"), r["value"].alias("value")),
            )
            won = F.array_min(F.array_compact(F.array(won, F.array_min(free))))
        wins.append(won["value"].alias(f"_win_{a}"))
    return solved.select(*keys, *wins)


def group_winners(
    df: DataFrame,
    key: str | Sequence[str],
    attrs: Sequence[str],
    *,
    domains: Mapping[str, Sequence[Value]] | None = None,
    rules: Sequence[EditRule] = (),
    cost: Costs = CONSTANT_COST,
    select: str = "frequency",
    clean: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """One row per entity with the cheapest legal value of each attribute, as ``_win_<attr>``.

    A short domain becomes counters in one aggregate. A long one without rules is counted by seen values instead, with
    the same winners, and may have any length.
    """
    if select not in ("frequency", "random"):
        raise ValueError(f"unknown selection {select!r}")
    keys = [key] if isinstance(key, str) else list(key)
    domains, rules = domains or {}, rules_within(rules, attrs)
    clean = clean if clean is not None else (satisfying(df, rules) if rules else df)
    closed, opened = [], {}
    for group in components(attrs, rules):
        free = len(group) == 1 and not any(r.attributes == set(group) for r in rules)
        if all(a in domains for a in group) and not (free and len(domains[group[0]]) > _COUNTED_DOMAIN):
            closed.append(group)
        elif free:
            opened.setdefault(df.schema[group[0]].dataType.simpleString(), []).append(group[0])
        else:
            raise ValueError(f"rules bind {group}: all of them need a domain")
    parts = [_open_winners(df, keys, a, domains, cost, select, clean, seed) for a in opened.values()]
    if closed:
        parts.insert(0, _closed_winners(df, keys, closed, domains, rules, cost, select, clean, seed))
    return reduce(lambda x, y: x.join(y, keys, "full"), parts)


def group_repair(df: DataFrame, key: str | Sequence[str], attrs: Sequence[str], **options) -> DataFrame:
    """All rows of an entity get the same, cheapest, rule-satisfying values of ``attrs``.

    Ties go to the combination more frequent among rule-satisfying rows, then to the smaller one;
    ``select="random"`` breaks them by a hash of the entity instead. Options: see `group_winners`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    joined = join_per_key(df, group_winners(df, keys, attrs, **options), keys)
    return joined.select(
        *[F.coalesce(F.col(f"_win_{c}"), F.col(c)).alias(c) if c in attrs else F.col(c) for c in df.columns]
    )


# --- row repair -----------------------------------------------------------------------------

_TABLED_CHOICES = 100_000


@dataclass(frozen=True)
class _Cells:
    """The cases one attribute of a row can be in (known old value, null, other) and what changing it costs."""

    attr: str
    olds: tuple[Value, ...]
    table: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, attr: str, domain: Sequence[Value], model: CostModel) -> _Cells:
        olds = tuple(sorted(set(domain) | {old for old, _ in model.changes}))
        news = sorted(domain)
        rows = [tuple(model.cost(old, new) for new in news) for old in olds]
        return cls(attr, olds, (*rows, (model.null_cost,) * len(news), (model.default,) * len(news)))

    @property
    def n_states(self) -> int:
        return len(self.table)

    def state(self) -> Column:
        known = [F.when(F.col(self.attr) == F.lit(old), F.lit(i)) for i, old in enumerate(self.olds)]
        return F.coalesce(*known, F.when(F.col(self.attr).isNull(), len(self.olds)).otherwise(len(self.olds) + 1))

    def prices(self, state: Column) -> Column:
        return F.get(F.array(*[F.array(*[F.lit(c) for c in row]) for row in self.table]), state)


def row_repair(
    df: DataFrame,
    attrs: Sequence[str],
    *,
    domains: Mapping[str, Sequence[Value]],
    rules: Sequence[EditRule],
    cost: Costs = CONSTANT_COST,
    clean: DataFrame | None = None,
    joint: bool = False,
    fill_nulls: bool = True,
) -> DataFrame:
    """Rule-violating rows get the legal combination closest to them; no shuffle of the rows.

    ``joint=False`` breaks ties attribute by attribute, towards values frequent in clean rows;
    ``joint=True`` towards combinations frequent in clean rows. Nulls in attributes that a rule
    binds are repaired too, unless ``fill_nulls`` is off; other attributes are never touched.
    """
    rules = rules_within(rules, attrs)
    clean = clean if clean is not None else satisfying(df, rules)
    bound_by = {g: rules_within(rules, g) for g in map(tuple, components(attrs, rules))}
    groups = [_Group.of(g, domains, bound) for g, bound in bound_by.items() if bound]
    if not groups:
        return df
    if joint:
        counted = groups
    else:
        counted = [_Group.of([a], domains, []) for g in groups for a in g.attrs]
    at = {g.attrs: i for i, g in enumerate(counted)}
    seen = _legal_counts(clean, counted)
    given = {a: _Cells.of(a, domains[a], _cost_of(cost, a)) for g in groups for a in g.attrs}

    def ties(group: _Group, counts: Column, t: Column) -> list[Column]:
        if joint:
            return [-F.get(counts[f"g{at[group.attrs]}"], t["at"])]
        return [-F.get(counts[f"g{at[(a,)]}"], p) for a, p in zip(group.attrs, group.spots(t))]

    bests = []
    out = df.withColumn("_seen", seen.scalar())
    for g, group in enumerate(groups):
        cells = [given[a] for a in group.attrs]
        n_states = reduce(lambda x, y: x * y, [c.n_states for c in cells])
        if n_states * len(group.legal) <= _TABLED_CHOICES:
            # A row's repair depends on its own few values only: solve every case once, look rows up.
            states = F.array(*[
                F.struct(*[F.lit(p).alias(f"s{j}") for j, p in enumerate(t)])
                for t in product(*[range(c.n_states) for c in cells])
            ])
            cases = F.transform(
                states,
                lambda s: _cheapest(
                    group,
                    [c.prices(s[f"s{j}"]) for j, c in enumerate(cells)],
                    lambda t: ties(group, F.col("counts"), t),
                ),
            )
            out = out.withColumn(f"_cases_{g}", seen.select(cases.alias("cases")).scalar())
            case = F.lit(0)
            for c in cells:
                case = case * c.n_states + c.state()
            best = F.get(F.col(f"_cases_{g}"), case)
        else:
            prices = [c.prices(c.state()) for c in cells]
            best = _cheapest(group, prices, lambda t: ties(group, F.col("_seen"), t))
        wanting = violates(bound_by[group.attrs])
        if fill_nulls:
            wanting = wanting | reduce(lambda x, y: x | y, [F.col(a).isNull() for a in group.attrs])
        bests.append(F.when(wanting, best).alias(f"_best_{g}"))
    solved = out.select(*df.columns, *bests)
    changed: dict[str, Column] = {}
    for g, group in enumerate(groups):
        for a, won in group.winners(F.col(f"_best_{g}"), df.schema).items():
            changed[a] = F.coalesce(won, F.col(a))
    return solved.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


# --- confidence gate ------------------------------------------------------------------------


def gated(original: Column, predicted: Column, confidence: Column, threshold: Column | float) -> Column:
    """The prediction where it is confident enough or nothing is there to keep."""
    return F.when((confidence >= threshold) | original.isNull(), predicted).otherwise(original)


def gated_repair(
    df: DataFrame, attr: str, threshold: Column | float, predicted: str = "pred", confidence: str = "conf"
) -> DataFrame:
    """Overwrite ``attr`` by the gate and keep the old value as ``<attr>_orig``."""
    original = F.col(attr)
    return df.withColumns(
        {attr + "_orig": original, attr: gated(original, F.col(predicted), F.col(confidence), threshold)}
    )
