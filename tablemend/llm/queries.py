"""The registered queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import ann, bpe, decontam, importance, langid, lexical, lines, pages, secrets, simhash, substrings, toxicity, urls
from tablemend.llm.common import stored, table
from tablemend.session import scratch_path


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(run, sql)
        return run

    return register


def fold(id: str, parts: int) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % parts


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@query("op2_main_text")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_texts(table(spark, sf, "pages"))


@query("op3_language")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by document id; a null id is in no fold: not learnt from and not held out."""
    documents = table(spark, sf, "documents")
    model = langid.train(documents.where(fold("doc_id", 5) != 0), "text", "lang")
    found = langid.predict(documents.select("doc_id", "text"), "text", model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op4_simhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.components(table(spark, sf, "documents"), "doc_id", "text", shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS place, trim(regexp_replace(lower(string_split(text, chr(10))[i]), '\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), lines AS (SELECT doc_id, place, line FROM l WHERE line <> ''),
firsts AS (SELECT line, min((doc_id, place)) AS spot FROM lines GROUP BY line),
split AS (SELECT line, spot, string_split(line, ' ') AS w FROM firsts),
longer AS (SELECT line, spot, w, len(w) AS n FROM split WHERE len(w) >= 8),
holes AS (SELECT line, spot, n, unnest(range(1, n + 1)) AS j, w FROM longer),
variants AS (
  SELECT line, spot, 'open' AS kind, array_to_string(w[:j - 1] || ['*' || j] || w[j + 1:], ' ') AS k FROM holes
  UNION ALL SELECT line, spot, 'short', array_to_string(w[:j - 1] || w[j + 1:], ' ') FROM holes
  UNION ALL SELECT line, spot, 'whole', line FROM longer
), earliest AS (SELECT kind, k, min(spot) AS spot FROM variants GROUP BY kind, k),
near AS (
  SELECT DISTINCT a.line FROM variants a JOIN earliest b ON a.k = b.k AND b.spot < a.spot
    AND ((a.kind = 'open' AND b.kind = 'open') OR (a.kind = 'short' AND b.kind = 'whole') OR (a.kind = 'whole' AND b.kind = 'short'))
), gone AS (
  SELECT l.doc_id, l.place FROM lines l JOIN firsts f ON l.line = f.line
  WHERE (l.doc_id, l.place) > f.spot OR l.line IN (SELECT line FROM near)
), parts AS (
  SELECT doc_id, i - 1 AS place, string_split(text, chr(10))[i] AS part
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
)
SELECT p.doc_id, coalesce(string_agg(p.part, chr(10) ORDER BY p.place) FILTER (WHERE g.place IS NULL), '') AS text,
  count(*)::INTEGER AS n_lines, count(g.place)::INTEGER AS n_removed,
  count(g.place) > 0 AND coalesce(bool_and(trim(regexp_replace(p.part, '\s+', ' ', 'g')) = '') FILTER (WHERE g.place IS NULL), true) AS emptied
FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by document id; a null id is in no fold: not learnt from and not held out."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.train(documents.where(fold("doc_id", 3) != 1), "text", "toxic", labels, "doc_id")
    found = toxicity.score(documents, "text", model)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op7_nearest", OP7_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    coded = stored(ann.index(table(spark, sf, "embeddings"), "vec_id", "embedding"), "codes")
    return ann.search(coded, "vec_id % 50 = 0", k=5)


# Fixed values of the query.
URL_RULES = (
    urls.UrlRule("allow", "org", "/"),
    urls.UrlRule("block", "example.org", "/es/"),
    urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"),
    urls.UrlRule("block", "com", "/de/"),
)

OP8_SQL = r"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest
  FROM pages
), nodes AS (
  SELECT page_id, host, path, html,
    CASE WHEN host <> '' THEN 'x://' || host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node FROM p
), tags AS (
  SELECT node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM nodes
  WHERE regexp_matches(html, '(?i)canonical|refresh')
), targets AS (
  SELECT node, trim(replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    END, '&amp;', '&')) AS t FROM tags
), absolute AS (
  SELECT node, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN 'x:' || t
    WHEN starts_with(t, '/') THEN regexp_extract(node, '^(x://[^/]*)', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(node, '^(x://[^?]*)', 1, 's') || t
    WHEN regexp_matches(t, '^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
    ELSE regexp_extract(node, '^(x://[^?]*/)', 1, 's') || t END AS a
  FROM targets WHERE node IS NOT NULL AND t IS NOT NULL
), parts AS (
  SELECT node, translate(regexp_extract(a, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(a, '^.*?://[^/?#]*([^#]*)', 1, 's') AS r FROM absolute WHERE a IS NOT NULL
), links AS (
  SELECT DISTINCT node AS a, 'x://' || h || CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS b FROM parts WHERE h <> ''
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
members AS (
  SELECT a AS n, translate(regexp_extract(a, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(a, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM (SELECT DISTINCT a FROM both_ways)
), fits AS (
  SELECT x.host, x.path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY x.host, x.path ORDER BY length(rhost || rpath) DESC, verdict) AS k
  FROM (SELECT host, path FROM nodes UNION SELECT host, path FROM members) x
  JOIN rules ON (x.host = rhost OR ends_with(x.host, '.' || rhost)) AND starts_with(x.path, rpath)
), reach AS (
  SELECT m.n FROM members m JOIN fits f ON f.host = m.host AND f.path = m.path AND f.k = 1 AND f.verdict = 'block'
  UNION SELECT e.b FROM reach r JOIN both_ways e ON e.a = r.n
)
SELECT n.page_id, n.host, n.path, f.rule,
  coalesce(f.verdict, CASE WHEN n.node IN (SELECT n FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM nodes n LEFT JOIN fits f ON f.host = n.host AND f.path = n.path AND f.k = 1
"""


@query("op8_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


@query("op9_secrets")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of its own in the shared folder: each run starts with nothing seen."""
    found = secrets.scan_history(table(spark, sf, "documents"), ["doc_id"], "text", scratch_path(spark, "ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf, "documents"), "doc_id", "text", bpe.public_vocabulary())


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i,
    unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END)) AS key
  FROM docs
), counted AS (SELECT r, i, word, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS again FROM words),
covered AS (
  SELECT r, i, word, max(again::INTEGER) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM counted
), summed AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM covered GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (r)
"""


@query("op11_substring_dedup", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.without_passages(table(spark, sf, "documents").select("doc_id", "text"), "text", width=35, shortest=9)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS steps
  FROM range(256) r(i)
), words AS (
  SELECT kind, r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (
    SELECT 's' AS kind, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 't', 0, NULL, coalesce(text, '') FROM benchmark
  )
), hexed AS (SELECT DISTINCT word, hex(encode(word)) AS digits FROM words),
hashed AS (
  SELECT word, xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(0, length(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), features AS (SELECT kind, r, bucket FROM words JOIN hashed USING (word)),
totals AS (SELECT count(*) FILTER (WHERE kind = 's') AS s_all, count(*) FILTER (WHERE kind = 't') AS t_all FROM features),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (WHERE kind = 's') AS s, count(*) FILTER (WHERE kind = 't') AS t FROM features GROUP BY bucket), totals
), weights AS (
  SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 's' GROUP BY r
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, (CASE WHEN n_features >= 20 AND k <= 10 * fit // 100 THEN k END)::BIGINT AS rank FROM ranked
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    documents, benchmark = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return importance.resample(documents, benchmark, "doc_id", "text", "text").drop("n_words")


OP13_SQL = r"""
WITH terms AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL)
), counted AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY r, doc_id, term),
sizes AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, n_docs),
norms AS (SELECT r, 25 + (75 * n * n_docs) // n_terms AS m FROM sizes, whole),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
  ) GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY item_id, r, doc_id
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM ranked WHERE k <= 10
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", k=10)
