"""Text features of whole documents, and sections of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemend.catalog.base import query, table
from tablemend.functions import text
from tablemend.operators import features
from tablemend.sources.pages import extract_sections

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS) + ")"
PLAIN_SQL = r"regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')"
WORDS_SQL = rf"words AS (SELECT doc_id, unnest(regexp_extract_all({PLAIN_SQL}, '\b[a-zA-Z]+\b')) AS term FROM documents)"
COUNTS_SQL = f"counts AS (SELECT doc_id, term, count(*) AS n FROM words WHERE term NOT IN {STOP_SQL} GROUP BY doc_id, term)"


@query("accent_free_text", f"SELECT doc_id, md5({PLAIN_SQL}) AS plain FROM documents")
def _(spark, sf):
    plain = text.strip_accents(F.lower("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(plain).alias("plain"))


@query("word_counts_of_texts", f"WITH {WORDS_SQL} SELECT term, count(*) AS n FROM words GROUP BY term")
def _(spark, sf):
    words = text.tokens(text.strip_accents(F.lower("text")))
    return table(spark, sf, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "content_word_numbers",
    f"""WITH {WORDS_SQL}, c AS (SELECT doc_id, count(*) FILTER (WHERE term NOT IN {STOP_SQL})::INTEGER AS n FROM words GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_words FROM documents LEFT JOIN c USING (doc_id)""",
)
def _(spark, sf):
    words = text.content_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_words"))


@query("bag_of_words", f"WITH {WORDS_SQL}, {COUNTS_SQL} SELECT doc_id, term, n FROM counts")
def _(spark, sf):
    return features.term_counts(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "tf_idf",
    f"""WITH {WORDS_SQL}, {COUNTS_SQL}, d AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
      w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM counts JOIN d USING (term))
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def _(spark, sf):
    weights = features.tf_idf(table(spark, sf, "documents"), "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


# HTML reads these references without their semicolon too, as at the end of a title that was cut off.
ENTITIES = {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#39;?": "''", "&nbsp;?": " ", "&amp;?": "&"}


def _decoded(column: str) -> str:
    for entity, char in ENTITIES.items():
        column = f"regexp_replace({column}, '{entity}', '{char}', 'g')"
    return column


@query(
    "page_titles",
    rf"""SELECT page_id, trim(regexp_replace({_decoded("regexp_extract(html, '<title>((?s:.*?))</title>', 1)")},
    '[\s\x{{00a0}}]+', ' ', 'g')) AS section FROM pages""",
)
def _(spark, sf):
    return extract_sections(table(spark, sf, "pages"), "page_id", "html", tag="title")


@query(
    "page_articles",
    rf"""SELECT page_id, trim(regexp_replace({_decoded("regexp_replace(regexp_replace(regexp_extract(html, '<article>((?s:.*?))(</article>|$)', 1), '<!--(?s:.*?)-->', '', 'g'), '<[^>]*>', ' ', 'g')")},
    '[\s\x{{00a0}}]+', ' ', 'g')) AS section FROM pages""",
)
def _(spark, sf):
    return extract_sections(table(spark, sf, "pages"), "page_id", "html", tag="article")
