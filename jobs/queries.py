"""The jobs as queries over the driver's tables, each run twice into one folder of its own, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.functions.text import MARKDOWN_RULES, TERM
from docmill.functions.vocabulary import STOPWORDS
from docmill.plans.shared import shared_dir
from jobs import page_feed, search_report

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, whose files stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_page_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "page-feed")
    for _ in range(2):
        out = page_feed.feed(spark, f"{sf_dir}/pages.parquet", f"{folder}/sections", f"{folder}/checkpoint")
    return out


def job2_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "search-report")
    for _ in range(2):
        out = search_report.report(spark, f"{sf_dir}/documents.parquet", f"{folder}/report")
    return out


QUERIES: dict[str, Query] = {f.__name__: f for f in (job1_page_feed, job2_search_report)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _markdown_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, replacement in MARKDOWN_RULES:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
    return out


_STOP = ", ".join(_quoted(w) for w in sorted(STOPWORDS))

SQL: dict[str, str] = {
    "job1_page_feed": rf"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html, {_markdown_sql("html")} AS md,
         row_number() OVER () AS r
  FROM pages QUALIFY page_id IS NULL OR row_number() OVER (PARTITION BY page_id ORDER BY sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) DESC) = 1),
l AS (SELECT r, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM p WHERE html IS NOT NULL),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s.') AS head FROM l),
s AS (SELECT *, count(*) FILTER (head AND pos > 1) OVER (PARTITION BY r ORDER BY pos) AS place FROM h),
g AS (SELECT r, place, bool_or(head) AS head, min_by(line, pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS content FROM s GROUP BY r, place),
t AS (SELECT *, CASE WHEN head THEN trim(regexp_replace(first, '^#{{1,6}}\s+', '')) ELSE 'Introduction' END AS title, CASE WHEN head THEN length(regexp_extract(first, '^#+')) ELSE 1 END AS depth FROM g),
a AS (SELECT *, CASE WHEN head THEN regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s-]', '', 'g'), '\s+', '-', 'g') END AS anchor FROM t)
SELECT page_id, url, host, path, place::INTEGER AS place, substr(sha256(host || ':' || path || ':' || coalesce(nullif(anchor, ''), 'root')), 1, 16) AS id, title, anchor, depth::INTEGER AS depth,
       CASE WHEN contains(lower(path), 'agents.md') THEN 'module' WHEN contains(lower(path), 'readme.md') THEN 'readme' WHEN contains(lower(path), 'api') OR contains(lower(path), 'reference') THEN 'api'
         WHEN contains(lower(path), 'example') THEN 'example' WHEN contains(lower(path), 'getting_started') OR contains(lower(path), 'quickstart') THEN 'guide' ELSE 'reference' END AS kind,
       len(regexp_extract_all(lower(content), '{TERM}'))::BIGINT AS n_terms, content, 0::BIGINT AS batch, substr(md5(host), 1, 1) AS bucket
FROM a JOIN p USING (r)""",
    "job2_search_report": rf"""
WITH k AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '{TERM}') AS ts FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*) AS chunks, avg(len(ts)) AS mean FROM k),
w AS (SELECT doc_id AS query_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf / n::DOUBLE * ln(chunks::DOUBLE / df), 9) DESC, term) AS place
      FROM p JOIN df USING (term), c WHERE doc_id % 50 = 0 AND length(term) >= 2 AND term NOT IN ({_STOP}) QUALIFY place <= 5),
i AS (SELECT *, CASE WHEN ln((chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((chunks - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, c),
s AS (SELECT query_id, doc_id, round(sum(idf * tf::DOUBLE * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10),
o AS (SELECT query_id, min(rank) FILTER (doc_id = query_id) AS rank, min(score) FILTER (doc_id = query_id) AS score, arg_min(doc_id, rank) AS first_id, arg_min(score, rank) AS first_score, count(*)::INTEGER AS n_found FROM f GROUP BY 1),
q AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS words, count(*)::INTEGER AS n_words FROM w GROUP BY 1)
SELECT k.doc_id, coalesce(words, '') AS words, coalesce(n_words, 0)::INTEGER AS n_words, rank, 1.0::DOUBLE / rank AS reciprocal_rank, score, first_id, first_score, coalesce(n_found, 0)::INTEGER AS n_found, source
FROM k LEFT JOIN q ON q.query_id = k.doc_id LEFT JOIN o ON o.query_id = k.doc_id WHERE k.doc_id % 50 = 0""",
}
