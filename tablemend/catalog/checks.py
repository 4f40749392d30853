"""Projections, null handling, constraint checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import (
    BROKEN_SQL,

    FLAGS,
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
from tablemend.functions import encoding, evidence, numbers, text
from tablemend.operators import filters
from tablemend.operators.votes import decided, majority_vote, population_from_registry
from tablemend.spec import MASKING_RULES, rules_within

WITH = f"WITH {LINES_SQL}"


@query("project_columns", f"{WITH} SELECT code, source, flag FROM lines")
def _(spark, sf):
    return filters.project(lines(spark, sf), ["code", "source", "flag"])


@query("project_away_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    return filters.project_away(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"])


@query("drop_null_rows", f"{WITH} SELECT {ROWS}, flag, level FROM lines WHERE flag IS NOT NULL AND level IS NOT NULL")
def _(spark, sf):
    return filters.drop_null_rows(lines(spark, sf), ["flag", "level"]).select(*ROW, "flag", "level")


@query("keep_texts_with_content", "SELECT doc_id, length(text)::INTEGER AS n_text FROM documents WHERE length(text) > 1")
def _(spark, sf):
    kept = filters.keep_texts(table(spark, sf, "documents"), "text")
    return kept.select("doc_id", F.length("text").alias("n_text"))


@query(
    "domain_check",
    f"{WITH} SELECT {ROWS}, flag, level FROM lines WHERE flag IN ('A', 'R') AND level IN (0, 1) AND finished IN (0, 1)",
)
def _(spark, sf):
    domains = {"flag": ("A", "R"), "level": (0, 1), "finished": (0, 1)}
    return filters.in_domain(lines(spark, sf), domains).select(*ROW, "flag", "level")


@query("rule_check_for_attribute", f"{WITH} SELECT {ROWS} FROM lines WHERE NOT ({RULE_SQL[0]} OR {RULE_SQL[2]})")
def _(spark, sf):
    return filters.satisfying_about(lines(spark, sf), RULES, "returned").select(*ROW)


@query("rule_satisfying_rows", f"{WITH} SELECT {ROWS} FROM lines WHERE NOT {BROKEN_SQL}")
def _(spark, sf):
    return filters.satisfying(lines(spark, sf), RULES).select(*ROW)


@query("rule_violating_rows", f"{WITH} SELECT {ROWS} FROM lines WHERE {BROKEN_SQL}")
def _(spark, sf):
    return filters.violating(lines(spark, sf), RULES).select(*ROW)


@query(
    "rule_split_counts",
    f"""{WITH} SELECT count(*) FILTER (WHERE NOT {BROKEN_SQL}) AS satisfying,
    count(*) FILTER (WHERE {BROKEN_SQL}) AS violating, count(*) AS total FROM lines""",
)
def _(spark, sf):
    return filters.split_counts(lines(spark, sf), RULES)


@query(
    "violation_list",
    f"""{WITH} SELECT {ROWS}, concat_ws(',', CASE WHEN {RULE_SQL[0]} THEN '0' END, CASE WHEN {RULE_SQL[1]} THEN '1' END,
    CASE WHEN {RULE_SQL[2]} THEN '2' END) AS rule_ids FROM lines WHERE {BROKEN_SQL}""",
)
def _(spark, sf):
    listed = filters.violation_list(lines(spark, sf), RULES, ROW)
    ids = F.array_join(F.transform("rule_ids", lambda i: i.cast("string")), ",")
    return listed.select(*ROW, ids.alias("rule_ids"))


@query(
    "violation_counts",
    WITH + " UNION ALL ".join(
        f" SELECT {i} AS rule_id, count(*) FILTER (WHERE {r}) AS violations FROM lines" for i, r in enumerate(RULE_SQL)
    ),
)
def _(spark, sf):
    return filters.violation_counts(lines(spark, sf), RULES)


@query(
    "rules_restricted_to_attributes",
    f"{WITH} SELECT {ROWS}, {RULE_SQL[1]} AS broken FROM lines",
)
def _(spark, sf):
    rules = rules_within(RULES, ["finished", "bulky", "cheap"])
    return lines(spark, sf).select(*ROW, filters.violates(rules).alias("broken"))


@query(
    "masking_rules_on_raw_values",
    f"""{WITH}, raw AS (SELECT {ROWS}, CASE finished WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS open,
      CASE returned WHEN 1 THEN 'Yes' ELSE 'No' END AS single_blind, CASE cheap WHEN 1 THEN 'Yes' ELSE 'No' END AS double_blind
      FROM lines)
    SELECT {ROWS} FROM raw WHERE NOT (coalesce(open = 'Yes' AND double_blind = 'Yes', false)
      OR coalesce(single_blind = 'Yes' AND double_blind = 'Yes', false) OR coalesce(open = 'Yes' AND single_blind = 'Yes', false)
      OR coalesce(open = 'No' AND single_blind = 'No' AND double_blind = 'No', false))""",
)
def _(spark, sf):
    yes_no = {"Yes": 1, "No": 0}
    raw = lines(spark, sf).select(
        *ROW,
        encoding.decode(F.col("finished"), yes_no).alias("open"),
        encoding.decode(F.col("returned"), yes_no).alias("single_blind"),
        encoding.decode(F.col("cheap"), yes_no).alias("double_blind"),
    )
    return filters.satisfying(raw, MASKING_RULES).select(*ROW)


@query(
    "drop_text_contradictions",
    f"WITH {NOTES_SQL} SELECT doc_id, toxic FROM notes WHERE NOT (regexp_matches(text, '(?i)thing') AND toxic = 0)",
)
def _(spark, sf):
    return filters.drop_contradictions(notes(spark, sf), "text", "thing", "toxic").select("doc_id", "toxic")


PHRASES = {"quality": ("thing", "the(re|se)?", "h[ea]r"), "toxic": ("la", "ou(en|an)?", "and the")}


def _found(column: str, label: str) -> str:
    # RE2 knows word boundaries between ASCII characters only, so they are spelled out.
    words = "|".join(f"(?:{p})" for p in PHRASES[label])
    return rf"regexp_matches(lower({column}), '(?i)(?:^|[^\pL\pN_])(?:{words})(?:$|[^\pL\pN_])')"


@query(
    "dictionary_evidence",
    f"SELECT doc_id, {_found('text', 'quality')} AS quality_named, {_found('text', 'toxic')} AS toxic_named FROM documents",
)
def _(spark, sf):
    words = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        evidence.evidence_for(words, "quality", PHRASES).alias("quality_named"),
        evidence.evidence_for(words, "toxic", PHRASES).alias("toxic_named"),
    )


AGES = ("(6[5-9]|[7-9][0-9])", ">= 65", "elderly")
AGE_SQL = r"'(?i)\b(?:(?:(6[5-9]|[7-9][0-9]))|(?:>= 65)|(?:elderly))\s(?:age|years| of years)+\b'"


@query(
    "age_phrase_evidence",
    f"""SELECT p_partkey, coalesce(regexp_matches(lower('Aged ' || p_size + 30 || CASE WHEN p_partkey % 2 = 0
    THEN ' Years and more' ELSE ' months' END), {AGE_SQL}), false) AS named FROM part""",
)
def _(spark, sf):
    unit = F.when(F.col("p_partkey") % 2 == 0, " Years and more").otherwise(" months")
    phrase = F.concat(F.lit("Aged "), (F.col("p_size") + 30).cast("string"), unit)
    return table(spark, sf, "part").select("p_partkey", evidence.age_phrase(phrase, AGES).alias("named"))


def _ages_sql(label: str, phrases: str) -> str:
    named = f"regexp_matches(inclusion, '(?i)\\b(?:{phrases})\\b')"
    excluded = f"regexp_matches(exclusion, '(?i)\\b(?:{phrases})\\b')"
    aged = f"regexp_matches(inclusion, '(?i)\\b(?:{phrases})\\s(?:age|years| of years)+\\b')"
    return f"(NOT (inclusion IS NOT NULL AND {label} = 1) OR ((coalesce({named}, false) OR NOT coalesce({excluded}, false)) AND coalesce({aged}, false)))"


ELDERLY_SQL = (
    "(?:>= 65)|(?:>= 75)|(?:(6[5-9]|[7-9][0-9]))|(?:elderly)|(?:senior citizens)|(?:retirees)|(?:older adults)|"
    "(?:geriatric population)|(?:aging population)"
)
FEMALE_SQL = "(?:women)|(?:woman)|(?:girls)|(?:ladies)|(?:females)|(?:female)|(?:womenfolk)|(?:sisters)"


@query(
    "ages_supported_by_phrases",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 2 AS elderly, p_partkey % 3 AS female, CASE p_size % 4 WHEN 0 THEN NULL
        WHEN 1 THEN 'patients of ' || p_size + 45 || ' years' WHEN 2 THEN 'older adults, >= ' || p_size + 40 || ' years of age, women'
        ELSE 'retirees ' || p_size END AS inclusion,
        CASE WHEN p_size % 3 = 0 THEN 'elderly women' WHEN p_size % 3 = 1 THEN 'over 80' END AS exclusion FROM part)
    SELECT p_partkey, {_ages_sql('elderly', ELDERLY_SQL)} AS elderly_holds,
      NOT (inclusion IS NOT NULL AND female = 1) OR coalesce(regexp_matches(inclusion, '(?i)\\b(?:{FEMALE_SQL})\\b'), false)
        OR NOT coalesce(regexp_matches(exclusion, '(?i)\\b(?:{FEMALE_SQL})\\b'), false) AS female_holds FROM p""",
)
def _(spark, sf):
    """The built-in phrases: an age label needs an age phrase beside its name, other labels their name only."""
    size = F.col("p_size")
    inclusion = (
        F.when(size % 4 == 1, F.concat(F.lit("patients of "), (size + 45).cast("string"), F.lit(" years")))
        .when(size % 4 == 2, F.concat(F.lit("older adults, >= "), (size + 40).cast("string"), F.lit(" years of age, women")))
        .when(size % 4 == 3, F.concat(F.lit("retirees "), size.cast("string")))
    )
    exclusion = F.when(size % 3 == 0, "elderly women").when(size % 3 == 1, "over 80")
    rows = table(spark, sf, "part").withColumns({"elderly": F.col("p_partkey") % 2, "female": F.col("p_partkey") % 3})
    holds = [evidence.label_is_supported(a, inclusion, exclusion).alias(f"{a}_holds") for a in ("elderly", "female")]
    return rows.select("p_partkey", *holds)


TURNS_SQL = """turns AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS inclusion,
  max(CASE WHEN turn = 1 THEN text END) AS exclusion, (conv_id % 2)::INTEGER AS quality, (conv_id % 3)::INTEGER AS toxic
  FROM conversations GROUP BY conv_id)"""


def _supported(label: str) -> str:
    named, excluded = _found("inclusion", label), _found("exclusion", label)
    return f"(NOT (inclusion IS NOT NULL AND {label} = 1) OR coalesce({named}, false) OR NOT coalesce({excluded}, false))"


@query(
    "rows_supported_by_texts",
    f"WITH {TURNS_SQL} SELECT conv_id, quality, toxic FROM turns WHERE {_supported('quality')} AND {_supported('toxic')}",
)
def _(spark, sf):
    def turn(n):
        return F.max(F.when(F.col("turn") == n, F.col("text")))

    turns = (
        table(spark, sf, "conversations").groupBy("conv_id").agg(turn(0).alias("inclusion"), turn(1).alias("exclusion"))
    )
    turns = turns.withColumn("quality", (F.col("conv_id") % 2).cast("int"))
    turns = turns.withColumn("toxic", (F.col("conv_id") % 3).cast("int"))
    kept = filters.keep_supported(turns, ["quality", "toxic"], "inclusion", "exclusion", corpus=PHRASES, age_labels=())
    return kept.select("conv_id", "quality", "toxic")


@query(
    "null_sentinel",
    f"""{WITH} SELECT {ROWS}, flag FROM lines""",
)
def _(spark, sf):
    marked = lines(spark, sf).withColumn("flag", F.coalesce("flag", F.lit("A Null Cell")))
    return filters.null_sentinel(marked, ["flag"]).select(*ROW, "flag")


@query(
    "impute_constant",
    f"{WITH} SELECT {ROWS}, coalesce(finished, 0) AS finished, coalesce(level, 0) AS level FROM lines",
)
def _(spark, sf):
    return filters.impute(lines(spark, sf), ["finished", "level"], 0).select(*ROW, "finished", "level")


@query("snapshot_originals", f"{WITH} SELECT {ROWS}, 9 AS level, level AS level_orig FROM lines")
def _(spark, sf):
    kept = filters.snapshot(lines(spark, sf), ["level"])
    return kept.withColumn("level", F.lit(9)).select(*ROW, "level", "level_orig")


@query(
    "decided_on_all_votes",
    f"""{WITH}, votes AS (SELECT code, {', '.join(
        f"count(*) FILTER (WHERE {a} = 1) AS {a}_yes, count(*) FILTER (WHERE {a} = 0) AS {a}_no" for a in FLAGS)}
      FROM lines GROUP BY code)
    SELECT code, {', '.join(f"CASE WHEN {a}_yes > {a}_no THEN 1 ELSE 0 END AS {a}" for a in FLAGS)}
    FROM votes WHERE {' AND '.join(f"{a}_yes <> {a}_no" for a in FLAGS)}""",
)
def _(spark, sf):
    return decided(majority_vote(lines(spark, sf), "code", FLAGS), "code", FLAGS)


@query(
    "population_from_registry",
    """WITH registry AS (SELECT p_partkey AS code, p_size * 2.0::DOUBLE AS low,
        (p_size * 24 + 60) / 12.0::DOUBLE AS high, p_partkey % 4 AS g,
        (p_partkey % 3 = 0)::INTEGER AS healthy_volunteers FROM part)
    SELECT DISTINCT code, (g IN (0, 1))::INTEGER AS male, (g IN (0, 2))::INTEGER AS female, (g = 0)::INTEGER AS others,
      (low < 300 AND high >= 65)::INTEGER AS elderly, (low < 65 AND high >= 17)::INTEGER AS adults,
      (low < 17 AND high >= 10)::INTEGER AS adolescents, (low < 10 AND high >= 1)::INTEGER AS children, healthy_volunteers
    FROM registry""",
)
def _(spark, sf):
    kind = F.col("p_partkey") % 4
    registry = table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"),
        F.concat((F.col("p_size") * 2).cast("string"), F.lit(" Years")).alias("low"),
        F.concat((F.col("p_size") * 24 + 60).cast("string"), F.lit(" Months")).alias("high"),
        F.when(kind == 0, "All").when(kind == 1, "MALE").when(kind == 2, "Female").alias("gender"),
        F.when(F.col("p_partkey") % 3 == 0, "Accepts Healthy Volunteers").otherwise("No").alias("volunteers"),
    )
    return population_from_registry(registry, "code", "gender", "low", "high", volunteers="volunteers")


# --- scalar functions -------------------------------------------------------------------------


@query("lower_case_text", "SELECT page_id, lower(url) AS url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower("url").alias("url"))


@query(
    "label_codes",
    f"""{WITH} SELECT {ROWS}, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS code_of_flag,
    l_returnflag AS flag_again, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS code_of_status FROM lines""",
)
def _(spark, sf):
    encoder = encoding.label_encoder(["N", "R", "A"])
    status = F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No")
    out = lines(spark, sf).withColumn("code_of_flag", encoding.encode(F.col("l_returnflag"), encoder))
    return out.select(
        *ROW,
        "code_of_flag",
        encoding.decode(F.col("code_of_flag"), encoder).alias("flag_again"),
        encoding.encode(status, encoding.label_encoder(["No", "Yes"])).alias("code_of_status"),
    )


@query(
    "yes_no_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS done FROM orders",
)
def _(spark, sf):
    answer = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").otherwise("?")
    return table(spark, sf, "orders").select("o_orderkey", encoding.yes_no(answer).alias("done"))


@query(
    "case_insensitive_matches",
    """SELECT c_custkey, lower(c_mktsegment) = 'building' AS is_building,
    regexp_matches(c_mktsegment, '(?i)^(auto|house)') AS is_private FROM customer""",
)
def _(spark, sf):
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.equals_ignoring_case(segment, "Building").alias("is_building"),
        text.matches_ignoring_case(segment, "^(auto|house)").alias("is_private"),
    )


@query(
    "bounded_substring",
    r"""SELECT page_id, CASE WHEN regexp_matches(html, '<title>(.*?)</title>')
      THEN regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\bE.\d\b', '', 'g') END AS title,
    CASE WHEN regexp_matches(url, '://(.*?)/') THEN regexp_extract(url, '://(.*?)/', 1) END AS host FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        text.bounded_substring(F.col("html"), "<title>", "</title>").alias("title"),
        text.bounded_substring(F.col("url"), "://", "/").alias("host"),
    )


@query("remove_characters", "SELECT doc_id, length(replace(replace(text, ';', ''), '.', ''))::INTEGER AS n_left FROM documents")
def _(spark, sf):
    bare = text.remove_characters(F.col("text"), ";.")
    return table(spark, sf, "documents").select("doc_id", F.length(bare).alias("n_left"))


@query(
    "rounded_shares",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
        l_linenumber / (l_linenumber + l_quantity) AS share FROM lineitem),
      exact AS (SELECT *, (share * 1152921504606846976.0)::BIGINT::HUGEINT AS bits FROM s)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
      (q + CASE WHEN rest > 576460752303423488 OR (rest = 576460752303423488 AND q % 2 = 1) THEN 1 ELSE 0 END)::BIGINT
        / 100.0::DOUBLE AS rounded
    FROM (SELECT *, (bits * 100) // 1152921504606846976 AS q, (bits * 100) % 1152921504606846976 AS rest FROM exact)""",
)
def _(spark, sf):
    share = F.col("l_linenumber") / (F.col("l_linenumber") + F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(*ROW, numbers.round_share(share).alias("rounded"))


@query("labels_as_integers", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, sf):
    k = numbers.try_integer(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", k.alias("k"))


