"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL that gives the same rows.

Documents serve as chunks: their source is the source and, as a component, the component's name; their language its
category; ids choose what a component extends, uses and relates to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text, vocabulary
from docmill.functions.schema import as_chunks
from docmill.operators import coded, expand, fuse, graph, knn, lexical, pruned, segments
from docmill.operators.chunking import apidoc, pycode, sections, webcode
from docmill.operators.chunking.sections import front_matter
from docmill.plans import changes, indexing, search, stored
from docmill.plans.search import search_terms
from docmill.plans.shared import dealt, packed, release, shared_path, spread, written
from docmill.plans.tools import best_files, component_usage, contexts, counts_by_source, source_filter, with_counts
from docmill.sources import files, store
from docmill.sources.config import Adapter, Source, sources_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


ASKED = [(1, "annt eringed inor"), (2, "leau onment ouauxan"), (3, "thnt the heea annt annt"), (4, "config btn heea the error")]
SOURCE_ASKED = [(1, "annt eringed inor", "src1"), (2, "leau onment ouauxan", "src4"), (3, "thnt the heea annt annt", None)]
VECTORS_ASKED = [(1, 0), (2, 7), (3, 11)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, seven = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    path = F.concat(F.lit("docs/"), seven.cast("string"), F.lit(".md"))
    title, src = F.split_part("text", F.lit("\n"), F.lit(1)), lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    none = F.array().cast("array<string>")
    return as_chunks(d.select(
        text.chunk_id(F.col("source"), path, F.lit("root")).alias("id"), F.col("source").alias("source_id"), path.alias("path"), title.alias("title"), F.col("text").alias("content"), (seven % 50 == 0).alias("is_entrypoint"),
        F.lit("component").alias("chunk_class"), F.col("source").alias("component_name"), F.col("lang").alias("component_category"), sections.section_type(title, F.col("text")).alias("chunk_type"), seven.alias("seq"),
        F.when(seven % 25 == 0, src(F.floor(seven / 50))).alias("extends"), F.when(seven % 10 == 0, F.array(src(seven * 7), src(seven * 7 + 1))).otherwise(none).alias("uses"), F.when(seven % 15 == 0, F.array(src(seven * 3))).otherwise(none).alias("related_to"),
    ))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, text string")


def asked_of_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCE_ASKED, "query_id int, text string, source string")


# SQL parts.


def _list(words) -> str:
    return ", ".join("'{}'".format(w.replace("'", "''")) for w in words)


def _case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs)


_TYPE = _case((" OR ".join(f"contains(lower(title), '{k}') OR contains(lower(substr(content, 1, 500)), '{k}')" for k in ks), t) for t, ks in vocabulary.SECTION_KEYWORDS) + " ELSE 'overview' END"
_BASE = f"""base AS (
  SELECT doc_id AS seq, source AS source_id, 'docs/' || doc_id || '.md' AS path, substr(sha256(source || ':docs/' || doc_id || '.md:root'), 1, 16) AS id, split_part(text, chr(10), 1) AS title, text AS content,
         doc_id % 50 = 0 AS is_entrypoint, source AS name, lang AS cat, CASE WHEN doc_id % 25 = 0 THEN 'src' || ((doc_id // 50) % 20) END AS ext,
         CASE WHEN doc_id % 10 = 0 THEN ['src' || (doc_id * 7 % 20), 'src' || ((doc_id * 7 + 1) % 20)] ELSE [] END AS uses, CASE WHEN doc_id % 15 = 0 THEN ['src' || (doc_id * 3 % 20)] ELSE [] END AS rel
  FROM documents),
chunks AS (SELECT *, {_TYPE} AS chunk_type FROM base)"""
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in ASKED)
_SOURCE_VALUES = ", ".join(f"({i}, '{t}', {f"'{s}'" if s else 'NULL'})" for i, t, s in SOURCE_ASKED)
_WORD, _TERM = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}\p{Co}]+"
_TFIDF_STOP, _STOP = _list(sorted(vocabulary.TFIDF_STOPWORDS)), _list(sorted(vocabulary.STOPWORDS))


def _tokens(c: str, pattern: str, stop: str | None) -> str:
    found = f"regexp_extract_all(lower({c}), '{pattern}')"
    return f"list_filter({found}, lambda t: length(t) >= 2 AND NOT list_contains([{stop}], t))" if stop else found


def _tfidf(values: str, source: bool) -> str:
    return rf"""{_BASE},
k AS (SELECT id, source_id, seq, {_tokens("title || ' ' || content", _WORD, _TFIDF_STOP)} AS ts FROM chunks),
p AS (SELECT id, source_id, seq, len(ts) AS n, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, {'source,' if source else ''} term, count(*) AS times FROM (SELECT *, unnest({_tokens("text", _WORD, _TFIDF_STOP)}) AS term FROM (VALUES {values}) v(query_id, text{', source' if source else ''})) GROUP BY ALL),
s AS (SELECT query_id, id, seq, sum(times * tf / n::DOUBLE * ln((SELECT count(*) FROM documents)::DOUBLE / df)) AS score
      FROM p JOIN q USING (term) JOIN df USING (term) {'WHERE source IS NULL OR source = source_id' if source else ''} GROUP BY ALL HAVING score > 0)"""


def _bm25(values: str, source: bool = False, fields: str = "id || ' ' || source_id || ' ' || path || ' ' || title || ' ' || content", terms: str | None = None) -> str:
    terms = terms or f"SELECT *, unnest({_tokens('text', _TERM, _STOP)}) AS term FROM (VALUES {values}) v(query_id, text{', source' if source else ''})"
    return rf"""{_BASE},
k AS (SELECT id, source_id, seq, {_tokens(fields, _TERM, None)} AS ts FROM chunks),
p AS (SELECT id, source_id, seq, len(ts) AS n, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*) AS chunks, avg(len(ts)) AS mean FROM k),
q AS (SELECT query_id, {'source,' if source else ''} term, count(*) AS times FROM ({terms}) GROUP BY ALL),
i AS (SELECT *, CASE WHEN ln((chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((chunks - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, c),
s AS (SELECT query_id, id, seq, sum(times * idf * tf::DOUBLE * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
      FROM p JOIN q USING (term) JOIN i USING (term) {'WHERE source IS NULL OR source = source_id' if source else ''} GROUP BY ALL)"""


def _top(k: int, tie: str = "id", source: str = "s", places: int = 6) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM (SELECT * REPLACE (round(score, {places}) AS score) FROM {source}) QUALIFY rank <= {k})"


# Chunks, text and files.


@query(f"WITH {_BASE} SELECT id, source_id, path, 'docs://' || source_id || '/section/' || path AS uri, title, is_entrypoint FROM chunks")
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("id", "source_id", "path", text.chunk_uri(F.col("source_id"), F.col("path"), F.col("anchor")).alias("uri"), "title", "is_entrypoint")


def _as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markdown: headings and paragraphs on lines of their own."""
    md = F.regexp_replace(F.regexp_replace("html", r"<h1>", "\n# "), r"</h1>|<p>", "\n")
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("source_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.regexp_replace(md, "<[^>]*>", "").alias("content"), F.lit(None).cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_entrypoint"))


@query(r"""
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '</h1>|<p>', chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages),
l AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM m),
h AS (SELECT *, regexp_matches(line, '^#{1,6}\s.') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM h),
g AS (SELECT page_id, sec, bool_or(head) AS head, min_by(line, pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS content FROM s GROUP BY page_id, sec),
t AS (SELECT *, CASE WHEN head THEN trim(regexp_replace(first, '^#{1,6}\s+', '')) ELSE 'Introduction' END AS title FROM g),
a AS (SELECT *, CASE WHEN head THEN regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}\p{Pc}\s-]', '', 'g'), '\s+', '-', 'g') END AS anchor FROM t)
SELECT substr(sha256('web:p/' || page_id || '.md:' || coalesce(nullif(anchor, ''), 'root')), 1, 16) AS id, 'p/' || page_id || '.md' AS path, title, anchor, sha256(content) AS content_sha256, 'reference' AS kind FROM a""")
def sections_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chunk_markdown(_as_markdown(spark, sf_dir)).select("id", "path", "title", "anchor", F.sha2("content", 256).alias("content_sha256"), "kind")


@query("SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g') AS slug FROM part")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", text.slug("p_name").alias("slug"))


@query("""
WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g') AS slug FROM part),
p AS (SELECT p_partkey, list_aggregate(list_transform(string_split(slug, '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', '') AS pascal FROM s)
SELECT p_partkey, pascal, lower(regexp_replace(regexp_replace(pascal, '(.)([A-Z][a-z]+)', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab FROM p""")
def kebab_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pascal = text.kebab_to_pascal(text.slug("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", pascal.alias("pascal"), text.pascal_to_kebab(pascal).alias("kebab"))


_KIND_PATHS = ("AGENTS.md", "README.md", "api/x.md", "quickstart.md", "Examples/y.md", "notes.md", "reference/z.md", "getting_started.md")


@query("""
WITH p AS (SELECT p_partkey, lower([""" + ", ".join(f"'{p}'" for p in _KIND_PATHS) + """][p_partkey % 8 + 1]) AS path FROM part)
SELECT p_partkey, CASE WHEN contains(path, 'agents.md') THEN 'module' WHEN contains(path, 'readme.md') THEN 'readme' WHEN contains(path, 'api') OR contains(path, 'reference') THEN 'api'
  WHEN contains(path, 'example') THEN 'example' WHEN contains(path, 'getting_started') OR contains(path, 'quickstart') THEN 'guide' ELSE 'reference' END AS kind,
  CASE WHEN contains(path, 'readme.md') THEN 'readme' WHEN contains(path, 'api') OR contains(path, 'reference') THEN 'api' WHEN contains(path, 'example') THEN 'example' ELSE 'reference' END AS component_kind FROM p""")
def kind_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*[F.lit(p) for p in _KIND_PATHS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sections.kind_of_path(path).alias("kind"), sections.kind_of_path(path, component=True).alias("component_kind"))


@query(f"WITH {_BASE} SELECT seq, chunk_type FROM chunks")
def chunk_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("seq", "chunk_type")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("plain"))


@query("""
WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<(article|nav|footer|p|h1)', 1), lambda x: CASE WHEN x IN ('p', 'h1') THEN 'Tds' ELSE 'App' END || upper(substr(x, 1, 1)) || substr(x, 2)) AS refs FROM pages)
SELECT page_id, len(refs) AS n_refs, list_aggregate(list_sort(list_distinct(refs)), 'string_agg', ',') AS refs FROM t""")
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose tags are in a template; pages with some of their tags renamed are the templates."""
    named = F.regexp_replace(F.regexp_replace("html", "<(p|h1)", "<tds-$1>"), "<(article|nav|footer)", "<APP-$1>")
    refs = webcode.component_refs(named)
    return table(spark, sf_dir, "pages").select("page_id", F.size(refs).cast("long").alias("n_refs"), F.array_join(F.array_sort(F.array_distinct(refs)), ",").alias("refs"))


@query("""
WITH p AS (SELECT p_partkey, 'src/app/' || ['forms', 'lib', 'data-display', 'x-y', 'app'][p_partkey % 5 + 1] || '/part-' || p_size || ['.component.ts', '.service.ts', '.component.html', '.spec.ts', '.css'][p_partkey % 5 + 1] AS path FROM part),
c AS (SELECT *, list_filter(string_split(path, '/'), lambda x: list_contains([""" + _list(vocabulary.CATEGORY_FOLDERS) + """], x))[1] AS known, string_split(path, '/') AS parts FROM p)
SELECT p_partkey, CASE WHEN path LIKE '%.component.ts' THEN 'component' WHEN path LIKE '%.service.ts' THEN 'service' WHEN path LIKE '%.component.html' THEN 'template' WHEN path LIKE '%.spec.ts' THEN 'test' ELSE 'source' END AS file_type,
  CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.html' THEN 'html' ELSE 'scss' END AS language,
  CASE WHEN known = 'data-display' THEN 'Data Display' WHEN known = 'forms' THEN 'Forms' WHEN path LIKE '%.component.ts' AND NOT list_contains(['lib', 'src', 'app', 'components'], parts[-2]) THEN parts[-2] ELSE 'Other' END AS category,
  'Part' || p_size AS component FROM (SELECT c.*, p_size FROM c JOIN part USING (p_partkey))""")
def source_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/app/"), pick("forms", "lib", "data-display", "x-y", "app"), F.lit("/part-"), F.col("p_size").cast("string"), pick(".component.ts", ".service.ts", ".component.html", ".spec.ts", ".css"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    name = F.regexp_replace(webcode.component_name(F.col("path"), F.array().cast("array<string>")), r"\.spec$", "")
    return rows.select("p_partkey", webcode.file_type_of(F.col("path")).alias("file_type"), webcode.language_of(F.col("path")).alias("language"), apidoc.category_of(F.col("path"), F.lit("Other")).alias("category"), name.alias("component"))


# Term statistics and ranking.


@query(rf"SELECT doc_id, len(regexp_extract_all(lower(text), '{_WORD}')) AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(text.words("text")).cast("long").alias("n_tokens"))


@query(f"WITH {_tfidf(_VALUES, False)} SELECT seq, term, tf, round(tf / n::DOUBLE, 6) AS weight FROM p")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_tfidf(chunks_of(spark, sf_dir), keep).postings.select("seq", "term", "tf", F.round(F.col("tf") / F.col("n"), 6).alias("weight"))


@query(f"WITH {_tfidf(_VALUES, False)} SELECT term, df FROM df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_tfidf(chunks_of(spark, sf_dir), keep).terms


@query(f"WITH {_tfidf(_VALUES, False)} SELECT query_id, id, score, rank FROM {_top(20, 'seq')}")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_tfidf(chunks_of(spark, sf_dir), keep)
    scores = lexical.tfidf_scores(index, lexical.exploded(asked(spark), text.tfidf_tokens("text")))
    return lexical.top_k(scores, 20, tie="seq").select("query_id", "id", "score", "rank")


@query(f"WITH {_tfidf(_SOURCE_VALUES, True)} SELECT query_id, id, score, rank FROM {_top(10, 'seq')}")
def tfidf_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_tfidf(chunks_of(spark, sf_dir), keep)
    scores = lexical.tfidf_scores(index, lexical.exploded(asked_of_sources(spark), text.tfidf_tokens("text")), True)
    return lexical.top_k(scores, 10, tie="seq").select("query_id", "id", "score", "rank")


_BOOSTED = f"""{_tfidf(_VALUES, False)},
a AS (SELECT query_id, list_distinct({_tokens("text", _WORD, _TFIDF_STOP)}) AS asked FROM (VALUES {_VALUES}) v(query_id, text)),
b AS (SELECT query_id, id, s.seq, score * CASE WHEN is_entrypoint THEN 1.5::DOUBLE ELSE 1 END * (1 + 0.3::DOUBLE * len(list_intersect(asked, list_distinct(regexp_extract_all(lower(title), '{_WORD}'))))) AS score
      FROM s JOIN chunks USING (id) JOIN a USING (query_id))"""


@query(f"WITH {_BOOSTED} SELECT query_id, id, score, rank FROM {_top(20, 'seq', 'b')}")
def tfidf_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return lexical.tfidf_search(lexical.build_tfidf(chunks, keep), chunks, asked(spark), 20).select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25(_VALUES)} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_search(lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep), asked(spark), 20).select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25(_SOURCE_VALUES, True)} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_search(lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep), asked_of_sources(spark), 20).select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25('(1, ' + repr('docs src1 md') + ')')} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the path and the source score like words of the text."""
    rows = spark.createDataFrame([(1, "docs src1 md")], "query_id int, text string")
    return lexical.bm25_search(lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep), rows, 20).select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25(_VALUES)} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, without scoring what can't be among the best."""
    index = pruned.tiered(lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep), keep=keep)
    return pruned.pruned_search(index, lexical.exploded(asked(spark), text.query_terms("text")), 20).select("query_id", "id", "score", "rank")


_LIVING = _bm25(_VALUES).replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)", 1)


@query(f"WITH {_LIVING} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in three segments: most documents, some with another text; then the changed and the new ones; then those that are removed."""
    chunks, i = chunks_of(spark, sf_dir), F.col("seq")
    first = chunks.where(i % 10 != 0).withColumn("content", F.when(i % 7 == 0, F.concat(F.lit("annt heea "), F.reverse("content"))).otherwise(F.col("content")))
    second = chunks.where((i % 10 == 0) | (i % 7 == 0))
    parts = [lexical.build_lexical(c, keep=keep) for c in (first, second, chunks.limit(0))]
    lengths = [c.select("id", F.size(lexical.tokens_of(lexical.FIELDS)).cast("long").alias("n")) for c in (first, second, chunks.limit(0))]
    old = keep(segments.died(lengths[:1], None, second), "died")
    removed = keep(segments.died(lengths[:2], old.drop("n"), chunks.where(i % 11 == 0)), "died")
    gone = old.unionByName(removed)
    lost = gone.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = [segments.counts_of(p) for p in parts]
    counts = segments.Counts(sum(c.chunks for c in every) - lost[0], sum(c.tokens for c in every) - lost[1])
    index = segments.merged(parts, gone.select("id", "segment"), counts)
    return lexical.bm25_search(index, asked(spark), 20).select("query_id", "id", "score", "rank")


PHRASES_ASKED = [(1, "of_the annt"), (2, "the_the of_and_the on_the"), (3, "de_la le_la eaux"), (4, "_annt_ in_the in_the md_the")]
_PHRASES = rf"""{_BASE},
q AS (SELECT query_id, term, regexp_extract_all(term, '{_TERM}') AS parts, count(*) AS times FROM (SELECT *, unnest({_tokens("text", _WORD, _STOP)}) AS term FROM (VALUES {", ".join(map(str, PHRASES_ASKED))}) v(query_id, text)) GROUP BY ALL),
f AS (SELECT id, seq, regexp_extract_all(lower(unnest([id, source_id, path, title, content])), '{_TERM}') AS ts FROM chunks),
n AS (SELECT id, seq, sum(len(ts))::BIGINT AS n FROM f GROUP BY ALL),
c AS (SELECT count(*) AS chunks, avg(n) AS mean FROM n),
o AS (SELECT id, parts, i FROM (SELECT id, parts, ts, unnest(range(1, len(ts) - len(parts) + 2)) AS i FROM f, (SELECT DISTINCT parts FROM q) WHERE len(ts) >= len(parts)) WHERE ts[i:i + len(parts) - 1] = parts),
p AS (SELECT id, parts, count(*) AS tf FROM o GROUP BY ALL),
i AS (SELECT parts, CASE WHEN ln((chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((chunks - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT parts, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT query_id, id, sum(times * idf * tf::DOUBLE * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM p JOIN q USING (parts) JOIN i USING (parts) JOIN n USING (id), c GROUP BY ALL)"""


@query(f"WITH {_PHRASES} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of several parts are found where the parts stand side by side."""
    rows = spark.createDataFrame(PHRASES_ASKED, "query_id int, text string")
    return lexical.bm25_search(lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep, positions=True), rows, 20).select("query_id", "id", "score", "rank")


_SNIPPETS = rf"""{_bm25(_VALUES)},
b AS (SELECT query_id, id, rank, trim(regexp_replace(lower(content), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')) AS text FROM {_top(5)} t JOIN chunks USING (id)),
w AS (SELECT *, regexp_extract_all(text, '{_TERM}') AS ts, string_split_regex(text, '{_TERM}') AS gaps FROM b),
y AS (SELECT query_id, id, len(ts) AS n, unnest(range(0, len(ts))) AS i, unnest(ts) AS token, unnest(gaps[:len(ts)]) AS gap FROM w),
h AS (SELECT query_id, id, n, i, token FROM y JOIN (SELECT DISTINCT query_id, term FROM q) USING (query_id) WHERE token = term),
z AS (SELECT query_id, id, i FROM y WHERE i = 0 OR regexp_matches(gap, '[.:][ \t\n\r]+$')),
a AS (SELECT query_id, id, n, i AS io, i AS pos, 0 AS bonus, 2 * i AS place FROM h UNION ALL
  SELECT query_id, id, n, io, pos, CASE WHEN pos = 0 THEN 120 ELSE 100 END, 2 * io + 1 FROM (SELECT h.query_id, h.id, h.n, h.i AS io, max(z.i) AS pos FROM h JOIN z ON z.query_id = h.query_id AND z.id = h.id AND z.i <= h.i GROUP BY ALL) WHERE n > 32 AND pos < io),
e AS (SELECT a.query_id, a.id, a.n, a.io, a.pos, a.bonus, a.place, max(h.i) + 1 AS upto, 999 * count(DISTINCT h.token) + count(*) + a.bonus AS worth
  FROM a JOIN h ON h.query_id = a.query_id AND h.id = a.id AND h.i >= a.pos AND h.i < a.pos + 32 GROUP BY a.query_id, a.id, a.n, a.io, a.pos, a.bonus, a.place),
r AS (SELECT query_id, id, CASE WHEN bonus > 0 THEN pos ELSE greatest(0, least(io - (32 - (upto - io)) // 2, n - 32)) END AS start FROM e QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY worth DESC, place) = 1),
l AS (SELECT y.*, coalesce(start, 0) AS start FROM y LEFT JOIN r ON r.query_id = y.query_id AND r.id = y.id),
m AS (SELECT l.query_id, l.id, start, n, string_agg(CASE WHEN i = start AND i > 0 THEN '' ELSE gap END || CASE WHEN k.term IS NULL THEN token ELSE '**' || token || '**' END, '' ORDER BY i) AS shown
  FROM l LEFT JOIN (SELECT DISTINCT query_id, term FROM q) k ON k.query_id = l.query_id AND k.term = l.token WHERE i >= start AND i < start + 32 GROUP BY l.query_id, l.id, start, n)"""


@query(f"WITH {_SNIPPETS} SELECT query_id, id, rank, CASE WHEN start > 0 THEN '...' ELSE '' END || shown || CASE WHEN start + 32 < n THEN '...' ELSE gaps[-1] END AS marked FROM m JOIN w USING (query_id, id)")
def bm25_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each hit, terms marked."""
    chunks = chunks_of(spark, sf_dir)
    return lexical.bm25_search(lexical.build_lexical(chunks, keep=keep), asked(spark), 5, chunks).select("query_id", "id", "rank", "marked")


@query()
def bm25_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_search(lexical.build_lexical(chunks_of(spark, sf_dir), "porter", keep=keep), asked(spark), 20).select("query_id", "id", "score", "rank")


# Expansion.

_EXPANSION = "x AS (SELECT * FROM (VALUES {}) v(term, alt, n))".format(", ".join(f"('{t}', '{a}', {n})" for t, a, n in expand.expansion_rows()))
_WORDS = rf"w AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '{_WORD}'), 1) AS place FROM (VALUES {_VALUES}) v(query_id, text))"
_EXPANDED = f"{_EXPANSION}, {_WORDS}, e AS (SELECT query_id, place, word AS term, 0 AS step, 0 AS n FROM w UNION ALL SELECT query_id, place, alt, 1, n FROM w JOIN x ON word = term)"


_SHORT = ("btn", "config auth", "err msg", "nav button")
_ITEMS = f"(SELECT item_id AS query_id, ['{"', '".join(_SHORT)}'][item_id % 4 + 1] || ' ' || text AS text FROM benchmark)"
_EXPANDED_ITEMS = _EXPANDED.replace(f"(VALUES {_VALUES}) v(query_id, text)", _ITEMS)


@query(f"WITH {_EXPANDED_ITEMS}, f AS (SELECT query_id, term, min((place, step, n)) AS pos FROM e GROUP BY 1, 2) SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS expanded FROM f GROUP BY 1")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, each with abbreviations before it."""
    short = F.element_at(F.array(*[F.lit(x) for x in _SHORT]), (F.col("item_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(short, F.lit(" "), "text").alias("text"))
    return expand.expanded_query(rows, expand.expansions(spark))


_EXPANDED_TERMS = f"SELECT DISTINCT query_id, regexp_replace(term, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS term FROM e WHERE regexp_replace(term, '[^\\p{{L}}\\p{{N}}_]', '', 'g') NOT IN ('', {_STOP})"


@query(f"WITH {_EXPANDED}, {_bm25('', terms=_EXPANDED_TERMS)} SELECT query_id, id, score, rank FROM {_top(20)}")
def bm25_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep)
    return lexical.top_k(lexical.bm25_scores(index, search_terms(asked(spark), expand.expansions(spark))), 20).select("query_id", "id", "score", "rank")


# Vectors and fusion.


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("source_id"))
    a = spark.createDataFrame(VECTORS_ASKED, "query_id int, id long")
    return v, a.join(v, "id").select("query_id", "embedding", F.col("source_id").alias("source"))


_NEAR = "v AS (SELECT query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM (VALUES {}) q(query_id, vec_id) JOIN embeddings a USING (vec_id) JOIN embeddings b ON {})"
_VECTOR_VALUES = ", ".join(map(str, VECTORS_ASKED))


@query(f"WITH {_NEAR.format(_VECTOR_VALUES, 'true')} SELECT query_id, id, score, rank FROM {_top(10, source='v')}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, a = _vectors(spark, sf_dir)
    return knn.nearest(v.drop("source_id"), a.drop("source"), 10)


@query(f"WITH {_NEAR.format(_VECTOR_VALUES, 'true')} SELECT query_id, id, score, rank FROM {_top(10, source='v')}")
def vector_coded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vector_topk, by codes and exact scores of what they leave."""
    v, a = _vectors(spark, sf_dir)
    v, path = v.drop("source_id"), shared_path(spark, "codes")
    coded.save_codes(v, path)
    return coded.nearest_coded(spark.read.parquet(path), v, a.drop("source"), 10)


@query(f"WITH {_NEAR.format(_VECTOR_VALUES, 'a.label = b.label')} SELECT query_id, id, score, rank FROM {_top(10, source='v')}")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(*_vectors(spark, sf_dir), 10)


@query()
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, a = _vectors(spark, sf_dir)
    return knn.lsh_nearest(v, a.drop("source"), 10)


def _ranked(spark: SparkSession, sf_dir: str, chunks: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits of both retrievers by chunk id; a document's vector is the one of its number."""
    hits = lexical.top_k(lexical.bm25_scores(lexical.build_lexical(chunks, keep=keep), terms), k)
    v, a = _vectors(spark, sf_dir)
    near = knn.nearest(v.drop("source_id"), a.drop("source"), k).join(chunks.select(F.col("seq").alias("id"), F.col("id").alias("chunk")), "id")
    return hits, near.select("query_id", F.col("chunk").alias("id"), "rank")


_FUSED = """l AS (SELECT * FROM {l}), n AS (SELECT query_id, chunks.id, rank FROM {v} v JOIN chunks ON chunks.seq = v.id),
f AS (SELECT query_id, id, l.rank AS lexical_rank, n.rank AS vector_rank, coalesce(0.4::DOUBLE / (60 + l.rank), 0) + coalesce(0.6::DOUBLE / (60 + n.rank), 0) AS score FROM l FULL OUTER JOIN n USING (query_id, id))"""


@query(f"WITH {_bm25(_VALUES)}, {_NEAR.format(_VECTOR_VALUES, 'true')}, {_FUSED.format(l=_top(24), v=_top(24, source='v'))} SELECT query_id, id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(vector_rank, 0) AS vector_rank, round(score, 6) AS score FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    a, b = _ranked(spark, sf_dir, chunks, lexical.exploded(asked(spark), text.query_terms("text")), 24)
    return fuse.fuse(a, b).select("query_id", "id", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.round("score", 6).alias("score"))


_SNIPPET = """regexp_replace((CASE WHEN start > 0 THEN '...' ELSE '' END) || regexp_replace(substr(content, start + 1, 200), '^\\s+|\\s+$', '', 'g') || (CASE WHEN start + 200 < length(content) THEN '...' ELSE '' END), '\\s+', ' ', 'g')"""


ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def letters_provider() -> knn.Provider:
    """How often a text has each of the letters a to z: a provider that SQL can express."""

    def embed(texts: list[str]):
        import numpy as np

        return np.array([[t.count(c) for c in ALPHABET] for t in texts], float).reshape(len(texts), len(ALPHABET))

    embed.name, embed.dim = "letters", len(ALPHABET)
    return embed


_LETTERS = "list_transform(string_split('" + "|".join(ALPHABET) + "', '|'), lambda c: (length({0}) - length(replace({0}, c, '')))::DOUBLE)"
_LETTERS_NEAR = f"""e AS (SELECT id, {_LETTERS.format("(title || chr(10) || chr(10) || content)")} AS e FROM chunks),
a AS (SELECT query_id, {_LETTERS.format("text")} AS a FROM (VALUES {_VALUES}) v(query_id, text)),
v AS (SELECT query_id, id, CASE WHEN list_sum(e) > 0 AND list_sum(a) > 0 THEN list_dot_product(a, e) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(e, e))) ELSE 0 END AS score FROM a, e)"""


def _renamed(sql: str, **names: str) -> str:
    """sql with its table names a and e replaced, where another part has them too."""
    import re

    for old, new in names.items():
        sql = re.sub(rf"\b{old} AS \(", f"{new} AS (", re.sub(rf"FROM {old}, e\b", f"FROM {new}, e", sql))
    return sql


@query(f"""WITH {_EXPANDED.replace("e AS (", "ex AS (")}, {_bm25('', terms=_EXPANDED_TERMS.replace("FROM e ", "FROM ex "))}, {_renamed(_LETTERS_NEAR, a="qa")},
l AS (SELECT * FROM {_top(24)}), n AS (SELECT query_id, id, rank FROM {_top(24, source='v')}),
f AS (SELECT query_id, id, l.rank AS lexical_rank, n.rank AS vector_rank, coalesce(0.4::DOUBLE / (60 + l.rank), 0) + coalesce(0.6::DOUBLE / (60 + n.rank), 0) AS score FROM l FULL OUTER JOIN n USING (query_id, id)),
t AS {_top(8, source='f', places=12)},
a AS (SELECT query_id, list(DISTINCT term) AS asked FROM ex GROUP BY 1),
b AS (SELECT query_id, id, content, asked, t.score * CASE WHEN is_entrypoint THEN 1.3::DOUBLE ELSE 1 END * (1 + 0.2::DOUBLE * len(list_intersect(asked, list_distinct(regexp_extract_all(lower(title), '{_WORD}'))))) AS score FROM t JOIN chunks USING (id) JOIN a USING (query_id)),
best AS {_top(8, source='b', places=12)},
ps AS (SELECT *, coalesce(list_min(list_filter(list_transform(asked, lambda x: instr(lower(content), x)), lambda p: p > 0)), 1) - 1 AS pos FROM best),
st AS (SELECT *, greatest(0, pos - 50) AS start FROM ps)
SELECT query_id, id, rank, round(score, 6) AS score, {_SNIPPET} AS snippet FROM st""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_hybrid(chunks_of(spark, sf_dir), letters_provider(), "plain", expand.expansions(spark))
    return search.hybrid_search(index, asked(spark), 8).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "snippet")


@query(SQL["hybrid_search"])
def hybrid_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_search, by an index that was stored with its graph and opened again for lookups."""
    chunks, path = chunks_of(spark, sf_dir), shared_path(spark, "engine")
    stored.build(chunks, path, letters_provider(), "plain")
    index = stored.load(spark, path, letters_provider(), expand.expansions(spark)).hybrid
    return search.hybrid_search(index, asked(spark), 8).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "snippet")


@query("SELECT item_id AS query_id, 3::BIGINT AS n FROM benchmark WHERE item_id % 3 <> 0")
def hybrid_blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each benchmark item as a query; every third is blank and has none."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, " \t ").otherwise(F.col("text")).alias("text"))
    found = search.hybrid_search(search.build_hybrid(chunks_of(spark, sf_dir), letters_provider(), "plain"), rows, 3)
    return found.groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_BASE} SELECT id, 'letters' AS provider, 26 AS dim, (CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END * list_sum({_LETTERS.format("(title || chr(10) || chr(10) || content)")}))::BIGINT AS total FROM chunks""")
def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks, stored, and merged with new ones of every other chunk."""
    chunks, path = chunks_of(spark, sf_dir), shared_path(spark, "embedding-table")
    made = knn.embed(chunks.select("id", "source_id", "seq", "title", "content"), knn.embedding_text(F.col("title"), F.col("content")), letters_provider())
    store.save_vectors(made, path)
    doubled = made.where("seq % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)).withColumn("point_id", text.uuid5(F.col("id")))
    rows = store.upsert_vectors(doubled.select("id", "point_id", "source_id", "embedding", "provider", "dim"), path)
    return rows.select("id", "provider", "dim", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


def _snippets(tail: bool) -> str:
    none = "length(content)" if tail else "0"
    return f"""WITH {_BASE}, p AS (SELECT seq, content, CASE WHEN instr(lower(content), 'annt') > 0 THEN instr(lower(content), 'annt') - 1 ELSE {none} END AS pos FROM chunks),
st AS (SELECT *, greatest(0, pos - 50) AS start FROM p) SELECT seq, {_SNIPPET} AS snippet FROM st"""


@query(_snippets(False))
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("seq", text.snippet(F.col("content"), F.array(F.lit("annt"))).alias("snippet"))


@query(_snippets(True))
def snippet_tail_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("seq", text.snippet(F.col("content"), F.array(F.lit("annt")), tail=True).alias("snippet"))


# Graph.

_EDGES = f"""{_BASE}, edges AS (
  SELECT 'component:' || name AS src, 'category:' || cat AS dst, 'belongs_to' AS relation_type, seq * 1000000 AS seq FROM chunks
  UNION ALL SELECT 'chunk:' || id, 'component:' || name, 'documents', seq * 1000000 + 10000 FROM chunks
  UNION ALL SELECT 'component:' || ext, 'component:' || name, 'has_variant', seq * 1000000 + 20000 FROM chunks WHERE ext IS NOT NULL
  UNION ALL SELECT 'component:' || name, 'component:' || ext, 'extends', seq * 1000000 + 30000 FROM chunks WHERE ext IS NOT NULL
  UNION ALL SELECT 'component:' || name, 'component:' || unnest(uses), 'uses', seq * 1000000 + 40000 + generate_subscripts(uses, 1) - 1 FROM chunks
  UNION ALL SELECT 'component:' || name, 'component:' || unnest(rel), 'related_to', seq * 1000000 + 60000 + generate_subscripts(rel, 1) - 1 FROM chunks
  UNION ALL SELECT 'component:' || unnest(rel), 'component:' || name, 'related_to', seq * 1000000 + 70000 + generate_subscripts(rel, 1) - 1 FROM chunks)"""


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build_graph(chunks_of(spark, sf_dir))


def _names(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "asked string")


@query(f"WITH {_EDGES} SELECT src, dst, relation_type FROM edges QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC, relation_type DESC) = 1")
def graph_edges_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple(_graph(spark, sf_dir).edges).select("src", "dst", "relation_type")


@query("SELECT r_name AS category, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def components_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("component_name"), F.col("r_name").alias("component_category"), F.col("n_nationkey").alias("seq"), F.lit("component").alias("chunk_class"), F.col("n_name").alias("id"))
    return graph.members(graph.build_graph(as_chunks(rows))).select("category", "name")


_TRADE = """t AS (
  SELECT a.n_name AS me, b.n_name AS other, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2),
u AS (SELECT me, other FROM t QUALIFY row_number() OVER (PARTITION BY me ORDER BY n DESC, other) <= 3)"""


@query(f"WITH {_TRADE} SELECT 'uses' AS relation, me AS asked, other AS name FROM u WHERE me IN ('NATION_3', 'NATION_11') UNION ALL SELECT 'used_by', other, me FROM u WHERE other IN ('NATION_3', 'NATION_11')")
def uses_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation uses the three nations whose suppliers its customers buy from most."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    a, b = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("me")), t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("other"))
    # Keys are counted before names are joined.
    keys = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t["customer"].select("c_custkey", "c_nationkey"), "c_custkey")
    n = keys.join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("score"))
    best = lexical.top_k(n.join(a, "c_nationkey").join(b, "s_nationkey").withColumn("score", F.col("score").cast("double")), 3, tie="other", by="me")
    rows = best.groupBy("me").agg(F.array_sort(F.collect_list("other")).alias("uses")).select(F.col("me").alias("id"), F.col("me").alias("component_name"), "uses", F.lit("component").alias("chunk_class"))
    g, who = graph.kept(graph.build_graph(as_chunks(rows))), _names(spark, "NATION_3", "NATION_11")
    return graph.uses_of(g, who).select(F.lit("uses").alias("relation"), "asked", "name").union(graph.users_of(g, who).select(F.lit("used_by").alias("relation"), "asked", "name"))


_WALK = """b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'component:' || a AS asked, 'component:' || a AS node, 0 AS hops FROM (VALUES ('src1'), ('src7')) v(a) UNION SELECT asked, y, hops + 1 FROM walk JOIN b ON x = node WHERE hops < {})
SELECT substr(asked, 11) AS asked, substr(node, 11) AS name, {}(hops) AS distance FROM walk WHERE node LIKE 'component:%' AND node <> asked GROUP BY 1, 2"""


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(2, 'min')}")
def related_within_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_graph(spark, sf_dir), _names(spark, "src1", "src7"), 2)


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(3, 'max')}")
def related_walk_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_graph(spark, sf_dir), _names(spark, "src1", "src7"), 3, "walk")


_RELATED = "(SELECT string_agg(DISTINCT substr({there}, 11), ',' ORDER BY substr({there}, 11)) FROM edges WHERE relation_type = '{r}' AND {here} = 'component:' || c.name)"


@query(f"""WITH {_EDGES}, c AS (SELECT DISTINCT name FROM chunks WHERE name IN ('src1', 'src5'))
SELECT name AS asked, (SELECT arg_min(cat, seq) FROM chunks WHERE name = c.name) AS category, coalesce({_RELATED.format(there='dst', here='src', r='has_variant')}, '') AS variants, coalesce({_RELATED.format(there='dst', here='src', r='uses')}, '') AS uses,
  coalesce({_RELATED.format(there='src', here='dst', r='uses')}, '') AS used_by, coalesce({_RELATED.format(there='dst', here='src', r='related_to')}, '') AS related_to,
  (SELECT arg_min(substr(dst, 11), seq) FROM edges WHERE relation_type = 'extends' AND src = 'component:' || c.name) AS extends, (SELECT count(*) FROM chunks WHERE name = c.name) AS chunk_count,
  (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM (SELECT chunk_type AS t, count(*) AS n FROM chunks WHERE name = c.name GROUP BY 1)) AS by_type FROM c""")
def component_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return _told(graph.component_info(graph.kept(graph.build_graph(chunks)), chunks, _names(spark, "src1", "src5")))


def _told(rows: DataFrame) -> DataFrame:
    """Component information in plain columns."""
    flat = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("variants", "uses", "used_by", "related_to")]
    types = F.array_join(F.array_sort(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), F.size(e["value"]).cast("string")))), ",")
    return rows.select("asked", "category", *flat, "extends", "chunk_count", types.alias("by_type"))


@query(f"WITH {_EDGES}, m AS (SELECT substr(dst, 10) AS name, substr(src, 11) AS c FROM edges WHERE relation_type = 'belongs_to' GROUP BY 1, 2) SELECT name, '' AS description, count(*) AS component_count, string_agg(c, ',' ORDER BY c) AS components FROM m GROUP BY 1")
def list_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.list_categories(_graph(spark, sf_dir)).drop("seq").withColumn("components", F.array_join(F.array_sort("components"), ","))


@query(f"WITH {_EDGES}, m AS (SELECT substr(src, 11) AS name FROM edges WHERE relation_type = 'belongs_to' AND dst = 'category:de' GROUP BY 1) SELECT 'de' AS category, name, '' AS description, (SELECT string_agg(title, '|' ORDER BY title) FROM chunks c WHERE c.name = m.name) AS chunks FROM m")
def explore_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    return graph.explore_category(graph.kept(graph.build_graph(chunks)), chunks, "de", True).drop("seq").withColumn("chunks", F.array_join(F.array_sort("chunks"), "|"))


@query(f"WITH {_BOOSTED}, t AS {_top(40, 'seq', 'b')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY t.rank) AS rank FROM t JOIN chunks USING (id) WHERE name IN (SELECT name FROM chunks WHERE cat = 'fr') AND chunk_type = 'overview' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t.rank) <= 8")
def graph_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    scores = lexical.tfidf_search(lexical.build_tfidf(chunks, keep), chunks, asked(spark), 40)
    return graph.filtered_search(scores, chunks, graph.kept(graph.build_graph(chunks)), 8, category="fr", chunk_type="overview").select("query_id", "id", "score", "rank")


# Stores and listings.


@query("SELECT source AS source_id, count(*) AS chunk_count FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_source(chunks_of(spark, sf_dir))


@query("""
SELECT n_name AS id, 'Nation ' || n_name AS name, 'markdown' AS adapters, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS chunk_count FROM nation
UNION ALL SELECT 'NOWHERE', 'Nation NOWHERE', 'markdown', 0""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, one without chunks, with the number of theirs; suppliers are chunks of their nation."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    listed = sources_table(spark, [Source(n, "", name=f"Nation {n}") for n in [*(r["n_name"] for r in nation.collect()), "NOWHERE"]])
    chunks = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("seq"), F.col("n_name").alias("source_id"))
    return with_counts(listed, as_chunks(chunks)).select("id", "name", F.array_join("adapters", ",").alias("adapters"), "chunk_count")


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS content_sha256 FROM conversations GROUP BY 1")
def get_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of every file in corpus order, with blank lines between; conversations are the files here."""
    rows = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("source_id"), F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.col("turn").cast("string").alias("id"), F.col("text").alias("content"))
    found = contexts(as_chunks(rows), rows.select("source_id", "path", F.lit(None).cast("string").alias("anchor")))
    return found.select(F.col("path").cast("long").alias("conv_id"), F.sha2("content", 256).alias("content_sha256"))


@query("""
SELECT conv_id, 'a' || turn AS anchor, min(text) AS content FROM conversations WHERE turn = 1 GROUP BY conv_id, turn
UNION ALL SELECT -1, 'a1', 'No content found for chat/-1#a1'""")
def get_context_at_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("source_id"), F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.col("turn").cast("string").alias("id"), F.concat(F.lit("a"), F.col("turn").cast("string")).alias("anchor"), F.col("text").alias("content"))
    wanted = rows.where("turn = 1").select("source_id", "path", "anchor").union(spark.createDataFrame([("chat", "-1", "a1")], "source_id string, path string, anchor string"))
    return contexts(as_chunks(rows), wanted).select(F.col("path").cast("long").alias("conv_id"), "anchor", "content")


# Files, written by the executors for the queries that scan them: two or three for each document.

_MD = "'# Doc ' || doc_id || chr(10) || text || chr(10) || '## Zeta' || chr(10) || '```ts' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '## Alpha' || chr(10) || '| a | b |'"


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content)."""
    d, name = spread(table(spark, sf_dir, "documents")), F.col("doc_id").cast("string")
    md = F.concat(F.lit("# Doc "), name, F.lit("\n"), "text", F.lit("\n## Zeta\n```ts\nx\n```\n## Alpha\n| a | b |"))
    at = lambda *parts: F.concat("source", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rows = d.select(at("/n", name, ".md").alias("path"), md.alias("content"))
    rows = rows.union(d.select(at("/drafts/n", name, ".md"), F.lit("# Draft")))
    return rows.union(d.where("doc_id % 5 = 0").select(at("/n", name, ".TXT"), F.concat(F.lit("note "), name)))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    root = shared_path(spark, "document-files")
    files.write_files(_document_files(spark, sf_dir), root)
    return root


@query(f"""
SELECT source || '/n' || doc_id || '.md' AS path, 'md' AS extension, sha256({_MD}) AS content_sha256, source = 'src3' AND doc_id = 3 AS is_entrypoint, '' AS error FROM documents
UNION ALL SELECT source || '/n' || doc_id || '.TXT', 'txt', sha256('note ' || doc_id), false, '' FROM documents WHERE doc_id % 5 = 0""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.scan(spark, _folder(spark, sf_dir), ["**/*.md", "*/*.TXT"], ["*/drafts/*"], "docs", ["src3/n3.md"])
    return rows.select("path", "extension", F.sha2("content", 256).alias("content_sha256"), "is_entrypoint", F.coalesce("error", F.lit("")).alias("error"))


_SECTIONS = f"""s AS (
  SELECT source || '/n' || doc_id || '.md' AS path, place, a AS adapter, CASE a WHEN 0 THEN 'component' ELSE 'normalized' END AS chunk_class, CASE place WHEN 0 THEN 'Doc ' || doc_id WHEN 1 THEN 'Zeta' ELSE 'Alpha' END AS title,
    CASE place WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 'zeta' ELSE 'alpha' END AS anchor,
    CASE place WHEN 0 THEN '# Doc ' || doc_id || chr(10) || text WHEN 1 THEN '## Zeta' || chr(10) || '```ts' || chr(10) || 'x' || chr(10) || '```' ELSE '## Alpha' || chr(10) || '| a | b |' END AS content,
    CASE place WHEN 0 THEN 1 ELSE 2 END AS depth, CASE place WHEN 1 THEN 'ts' ELSE '' END AS code_blocks, place = 2 AS has_table, CASE a WHEN 0 THEN 'n' || doc_id END AS component_name, CASE a WHEN 0 THEN 'Documents' END AS component_category
  FROM documents, (VALUES (0), (1), (2)) p(place), (VALUES (0), (1)) q(a)),
n AS (SELECT *, substr(sha256('docs:' || path || ':' || anchor), 1, 16) AS id, row_number() OVER (ORDER BY adapter, path, place) - 1 AS seq FROM s)"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a source with two adapters that see the same files, by way of the store."""
    return store.load_chunks(spark, _stored(spark, sf_dir, [Adapter("component", {"default_category": "Documents"}), Adapter("markdown")]))


def _stored(spark: SparkSession, sf_dir: str, adapters: list[Adapter]) -> str:
    """Where the chunks of all documents' files are stored. The files, once chunks are made of them, and these chunks, once they are stored, make room."""
    root, path = _folder(spark, sf_dir), shared_path(spark, "chunk-store")
    chunks = indexing.index_source(spark, Source("docs", root, exclude_globs=["*/drafts/*"], adapters=adapters))
    files.write_files(_document_files(spark, sf_dir).withColumn("content", F.lit(None).cast("string")), root)
    store.save_chunks(chunks, path)
    release(chunks)
    return path


@query(f"WITH {_SECTIONS} SELECT seq, id, path, title, anchor, sha256(content) AS content_sha256, depth, code_blocks, has_table, chunk_class, component_name, component_category FROM n")
def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    return rows.select("seq", "id", "path", "title", "anchor", F.sha2("content", 256).alias("content_sha256"), "depth", F.array_join("code_blocks", ",").alias("code_blocks"), "has_table", "chunk_class", "component_name", "component_category")


@query(f"WITH {_SECTIONS} SELECT id, seq, chunk_class, kind FROM (SELECT *, 'reference' AS kind FROM n) WHERE adapter = 1")
def indexed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the chunks of one id the later adapter's."""
    return lexical.latest(_indexed(spark, sf_dir)).select("id", "seq", "chunk_class", "kind")


@query("SELECT true AS present, 6 * count(*) AS chunk_count, true AS indexed FROM documents")
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.metadata(spark, _stored(spark, sf_dir, [Adapter("component"), Adapter("markdown")])).select("present", "chunk_count", F.col("indexed_at").isNotNull().alias("indexed"))


@query("""
WITH f AS (SELECT source || '/n' || doc_id || '.md' AS path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'kept' END AS change, doc_id FROM documents)
SELECT 'docs' AS source_id, path, change FROM f UNION ALL SELECT 'docs', 'new/n' || doc_id || '.md', 'added' FROM f WHERE doc_id % 13 = 0""")
def reload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reload takes after files were changed, removed and added below a source's folder."""
    root, rows, i = shared_path(spark, "document-files"), _document_files(spark, sf_dir).where("path like '%.md' and path not like '%/drafts/%'"), F.regexp_extract("path", r"n(\d+)\.md$", 1).cast("long")
    files.write_files(rows, root)
    source = [Source("docs", root)]
    before = changes.manifest_of(changes.changes(spark, source, spark.createDataFrame([], changes.FILES)))
    some = rows.where((i % 11 == 0) | (i % 7 == 0)).withColumn("content", F.when(i % 11 != 0, F.concat("content", F.lit("\nmore"))))
    files.write_files(some.unionByName(rows.where(i % 13 == 0).withColumn("path", F.concat(F.lit("new/n"), i.cast("string"), F.lit(".md")))), root)
    return changes.changes(spark, source, before).select("source_id", "path", "change")


@query(f"WITH {_EDGES} SELECT src, dst, relation_type FROM edges")
def graph_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of a graph that was written as JSON, read, saved and loaded."""
    path = shared_path(spark, "graph")
    store.save_graph(graph.graph_from_json(graph.graph_json(_graph(spark, sf_dir))), path)
    return store.load_graph(spark, path).edges.select("src", "dst", "relation_type")


def _brands(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """A graph without chunks, to which brands are added as categories below those of their types."""
    none = graph.Graph(spark.createDataFrame([], graph.NODE_SCHEMA), spark.createDataFrame([], graph.EDGE_SCHEMA))
    return graph.with_nodes(none, table(spark, sf_dir, "part").select(F.lit("category").alias("node_type"), F.col("p_brand").alias("name"), F.col("p_type").alias("parent_category")))


@query("SELECT DISTINCT 'category:' || p_brand AS src, 'category:' || p_type AS dst, 'belongs_to' AS relation_type FROM part")
def graph_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir).edges.select("src", "dst", "relation_type")


@query("SELECT p_partkey, 'category:' || n AS node_id, n IN (SELECT p_brand FROM part) OR n IN (SELECT p_type FROM part) AS present FROM (SELECT p_partkey, [p_brand, p_type, p_name][p_partkey % 3 + 1] AS n FROM part)")
def graph_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array("p_brand", "p_type", "p_name"), (F.col("p_partkey") % 3 + 1).cast("int"))
    return graph.contains(_brands(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("category:"), name).alias("node_id")))


def _stored_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    path = shared_path(spark, "graph")
    store.save_graph(_graph(spark, sf_dir), path)
    return store.load_graph(spark, path)


@query(SQL["component_info"])
def component_info_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As component_info, over a stored graph, of which only the asked components' ranges are read."""
    return _told(graph.component_info(_stored_graph(spark, sf_dir), chunks_of(spark, sf_dir), _names(spark, "src1", "src5")))


@query(SQL["related_within_depth"])
def related_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As related_within_depth, over a stored graph."""
    return graph.walk(_stored_graph(spark, sf_dir), _names(spark, "src1", "src7"), 2)


@query(f"WITH {_bm25('(1, ' + repr('annt eringed inor') + ')')} SELECT query_id, id, score, rank FROM {_top(10)}")
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that was saved and loaded."""
    path = shared_path(spark, "lexical")
    store.save_lexical(lexical.build_lexical(chunks_of(spark, sf_dir), keep=packed, stored=True), path)
    return lexical.bm25_search(store.load_lexical(spark, path), spark.createDataFrame([(1, "annt eringed inor")], "query_id int, text string"), 10).select("query_id", "id", "score", "rank")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query(f"WITH {_BASE} SELECT id, source_id, path, title, sha256(content) AS content_sha256, is_entrypoint, chunk_type, ext AS extends, array_to_string(uses, ',') AS uses FROM chunks")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to JSON and back."""
    rows = store.chunks_from_json(store.chunks_to_json(chunks_of(spark, sf_dir)))
    return rows.select("id", "source_id", "path", "title", F.sha2("content", 256).alias("content_sha256"), "is_entrypoint", "chunk_type", "extends", F.array_join("uses", ",").alias("uses"))


@query("""
WITH h AS (SELECT url AS path, html AS content, page_id, instr(lower(html), '<article') AS pos FROM pages WHERE contains(lower(html), 'article')),
f AS (SELECT path, arg_min(content, page_id) AS content, min(page_id) AS page_id FROM h GROUP BY 1)
SELECT path, CASE WHEN greatest(1, pos - 50) > 1 THEN '...' ELSE '' END || substr(content, greatest(1, pos - 50), least(length(content), pos + 199) - greatest(1, pos - 50) + 1) || CASE WHEN pos + 199 < length(content) THEN '...' ELSE '' END AS snippet
FROM (SELECT *, instr(lower(content), '<article') AS pos FROM f) ORDER BY page_id LIMIT 20""")
def component_usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 templates that use a component."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"), F.lit("template").alias("file_type"), F.lit("Article").alias("component_name"), F.lit(0).alias("query_id"), F.col("page_id").alias("rank"), F.array().cast("array<struct<name:string>>").alias("symbols_extracted"))
    return component_usage(pages, "Article", "article", 20).select("path", "snippet")


@query("SELECT p_partkey, p_name AS component, p_type AS category, p_brand AS uses FROM part")
def front_matter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('---\ncomponent: "'), F.col("p_name"), F.lit('"\ncategory: "'), F.col("p_type"), F.lit('"\nuses:\n  - "'), F.col("p_brand"), F.lit('"\n---\n# Text\n'))
    rows = dealt(table(spark, sf_dir, "part")).select("p_partkey", front_matter(doc).alias("f"))
    return rows.select("p_partkey", F.col("f.component").alias("component"), F.col("f.category").alias("category"), F.array_join("f.uses", ",").alias("uses"))


# Documents and code made from part names.


def _files(spark: SparkSession, sf_dir: str, path, content) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "part")).withColumn("pascal", text.kebab_to_pascal(text.slug("p_name"))).withColumn("key", F.col("p_partkey").cast("string"))
    return rows.select(F.lit("parts").alias("source_id"), path.alias("path"), content.alias("content"), F.lit(None).cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_entrypoint"))


_PASCAL = """q AS (SELECT p_partkey::VARCHAR AS key, p_size, p_name, p_type, p_brand, list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g'), '-'),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', '') AS pascal FROM part)"""


@query(f"""WITH {_PASCAL} SELECT 'c/' || key || '.mdx' AS path, title, pascal AS component_name, 'Base' AS extends, array_to_string(list_sort(list_distinct(['Icon', pascal, 'Box'])), ',') AS uses, chunk_type,
  props, variant AS example_variant FROM q, (VALUES ('Overview', 'overview', '', ''), ('Props', 'props', 'size,tone', ''), ('Large Example', 'example', '', 'Large')) v(title, chunk_type, props, variant)""")
def component_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("---\ncomponent: "), F.col("pascal"), F.lit("\nextends: Base\nuses: [Icon]\n---\nimport { "), F.col("pascal"), F.lit(" as P, helper } from './x'\nimport Box from 'y'\n<"), F.col("pascal"), F.lit("/><Fragment/>\n# Props\nsize?: string\n  tone: x\n  _own: y\n# Large Example\ntext\n"))
    rows = sections.chunk_component(_files(spark, sf_dir, F.concat(F.lit("c/"), F.col("key"), F.lit(".mdx")), doc))
    return rows.select("path", "title", "component_name", "extends", F.array_join("uses", ",").alias("uses"), "chunk_type", F.array_join("props_mentioned", ",").alias("props"), F.coalesce("example_variant", F.lit("")).alias("example_variant"))


@query(f"""WITH {_PASCAL}, c AS (
  SELECT key, pascal AS name, 'overview' AS tag, NULL AS anchor, '# ' || pascal || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '**Selector:** `x-' || key || '`' || chr(10) || chr(10) || '**Category:** Forms' AS content FROM q
  UNION ALL SELECT key, pascal, 'inputs', 'inputs', '# ' || pascal || ' Inputs' || chr(10) || chr(10) || '| Input | Type | Default | Description |' || chr(10) || '|-------|------|---------|-------------|' || chr(10) || '| `size` | `number` | `' || p_size || '` | **DEPRECATED** ' || p_brand || ' |' FROM q
  UNION ALL SELECT key, pascal, 'methods', 'methods', '# ' || pascal || ' Methods' || chr(10) || chr(10) || '## `go(a: any): void`' || chr(10) FROM q)
SELECT substr(sha256('parts:compodoc:' || name || ':' || tag), 1, 16) AS id, 'src/forms/' || key || '.component.ts' AS path, anchor, sha256(content) AS content_sha256, 'Forms' AS component_category FROM c""")
def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.struct(F.lit("size").alias("name"), F.lit("number").alias("type"), F.col("p_size").cast("string").alias("defaultValue"), F.concat(F.lit("<b>"), F.col("p_brand"), F.lit("</b>")).alias("description"), F.lit(True).alias("deprecated"))
    methods = F.array(F.struct(F.lit("ngOnInit").alias("name"), F.array(F.struct(F.lit("a").alias("name"))).alias("args")), F.struct(F.lit("go").alias("name"), F.array(F.struct(F.lit("a").alias("name"))).alias("args")))
    one = F.struct(F.col("pascal").alias("name"), F.concat(F.lit("src/forms/"), F.col("key"), F.lit(".component.ts")).alias("file"), F.concat(F.lit("x-"), F.col("key")).alias("selector"), F.col("p_type").alias("rawdescription"), F.array(field).alias("inputsClass"), methods.alias("methodsClass"))
    rows = apidoc.chunk_apidoc(_files(spark, sf_dir, F.concat(F.lit("d/"), F.col("key"), F.lit("/documentation.json")), F.to_json(F.struct(F.array(one).alias("components")))))
    return rows.select("id", "path", "anchor", F.sha2("content", 256).alias("content_sha256"), "component_category")


@query(f"""WITH {_PASCAL}, k AS (SELECT *, e FROM q, (VALUES ('.component.ts'), ('.component.html'), ('.component.scss')) v(e))
SELECT 's/' || key || e AS path, CASE e WHEN '.component.ts' THEN pascal || 'View' ELSE key END AS component_name, CASE e WHEN '.component.ts' THEN 'x-' || key ELSE '' END AS selector, CASE e WHEN '.component.ts' THEN pascal || 'ViewComponent,Aux,load' ELSE '' END AS exports,
  CASE e WHEN '.component.html' THEN 'App' || upper(substr(key, 1, 1)) || substr(key, 2) || ',TdsBox' ELSE '' END AS component_refs,
  CASE e WHEN '.component.ts' THEN 's/' || key || '.component.html,s/' || key || '.component.scss' WHEN '.component.html' THEN 's/' || key || '.component.ts,s/' || key || '.component.scss' ELSE 's/' || key || '.component.ts,s/' || key || '.component.html' END AS related_files FROM (SELECT * REPLACE ('z' || key AS key) FROM k)""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pascal = F.concat(F.lit("z"), F.col("key")), F.col("pascal")
    ts = F.concat(F.lit("@Component({ selector: 'x-"), key, F.lit("', templateUrl: './t.html' })\nexport class "), pascal, F.lit("ViewComponent {}\nclass Aux {}\nexport async function load() {}\n"))
    html = F.concat(F.lit("<div><app-"), key, F.lit(" a><tds-box></div>"))
    parts = [_files(spark, sf_dir, F.concat(F.lit("s/"), key, F.lit(e)), c) for e, c in ((".component.ts", ts), (".component.html", html), (".component.scss", F.lit("a{}")))]
    rows = webcode.chunk_source(parts[0].union(parts[1]).union(parts[2]))
    flat = [F.array_join(c, ",").alias(c) for c in ("exports", "component_refs", "related_files")]
    return rows.select("path", F.when(F.col("file_type") == "component", F.col("component_name")).otherwise(F.lower("component_name")).alias("component_name"), F.coalesce("selector", F.lit("")).alias("selector"), *flat)


@query(f"WITH {_bm25(_VALUES)} SELECT chunks, round(mean, 6) AS mean, (SELECT count(*) FROM df) AS terms, (SELECT sum(df) FROM df)::BIGINT AS postings FROM c")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_lexical(chunks_of(spark, sf_dir), keep=keep)
    counted = index.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return counted.select(F.lit(index.chunks).cast("long").alias("chunks"), F.round(F.lit(float(index.mean)), 6).alias("mean"), "terms", "postings")


@query("SELECT c_custkey AS id, regexp_replace(regexp_replace('c/' || c_mktsegment || '/' || c_custkey || '.md', '^c/', ''), '[.]md$', '') AS stem FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 10 <> 3")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include and exclude patterns over paths."""
    from docmill.sources.files import fnmatch_regex, glob_regex

    rows = table(spark, sf_dir, "customer").withColumn("path", F.concat(F.lit("c/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".md")))
    kept = rows.where((F.col("path").rlike(glob_regex("**/BUILDING/*.md")) | F.col("path").rlike(glob_regex("c/M*/*.md"))) & ~F.col("path").rlike(fnmatch_regex("*3.md")))
    return kept.select(F.col("c_custkey").alias("id"), F.regexp_replace(F.regexp_replace("path", "^c/", ""), "[.]md$", "").alias("stem"))


_PY_ID = "substr(sha256('parts:python:m/' || key || '.py' || part), 1, 16) AS id, 'm/' || key || '.py' AS path"


@query(f"""WITH {_PASCAL}, c AS (
  SELECT key, ':module' AS part, 'module' AS anchor, key || ' (module)' AS title, p_name AS content, 'api' AS kind, 1 AS depth, 'module' AS file_type, NULL AS class_name FROM q
  UNION ALL SELECT key, ':' || pascal, lower(pascal), 'class ' || pascal, 'class ' || pascal || '(Base):', 'source', 1, 'class', NULL FROM q
  UNION ALL SELECT key, ':' || pascal || '.size', lower(pascal) || '-size', pascal || '.size()', 'def size(self, n: int = ' || p_size || ') -> int', 'source', 2, 'method', pascal FROM q
  UNION ALL SELECT key, ':main', 'main', 'def main()', 'async def main(*args, key = None)', 'source', 1, 'async_function', NULL FROM q)
SELECT {_PY_ID}, anchor, title, content, kind, depth, file_type, class_name FROM c""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of modules made from part names."""
    code = F.concat(F.lit('"""'), F.col("p_name"), F.lit('"""\nimport os\nclass '), F.col("pascal"), F.lit("(Base):\n    def size(self, n: int = "), F.col("p_size").cast("string"), F.lit(") -> int:\n        return n\n\nasync def main(*args, key=None):\n    pass\n\ndef _own(): ...\n"))
    return pycode.chunk_python(_files(spark, sf_dir, F.concat(F.lit("m/"), F.col("key"), F.lit(".py")), code)).select("id", "path", "anchor", "title", "content", "kind", "depth", "file_type", "class_name")


@query(f"""WITH {_PASCAL}, c AS (
  SELECT key, ':overview' AS part, key || ' (module overview)' AS title, p_name || chr(10) || chr(10) || '## Classes' || chr(10) || chr(10) || '- `' || pascal || '`: Doc.' || chr(10) || chr(10) || '## Functions' || chr(10) || chr(10) || '- `run()`: No description' AS content, 'api' AS kind FROM q
  UNION ALL SELECT key, ':' || pascal, 'class ' || pascal, 'class ' || pascal || ':' || chr(10) || chr(10) || 'Doc.', 'api' FROM q
  UNION ALL SELECT key, ':run', 'def run()', 'def run()', 'source' FROM q)
SELECT {_PY_ID}, title, content, kind FROM c""")
def python_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit('"""'), F.col("p_name"), F.lit('"""\nclass '), F.col("pascal"), F.lit(':\n    """Doc."""\ndef run(): ...\n'))
    return pycode.chunk_python(_files(spark, sf_dir, F.concat(F.lit("m/"), F.col("key"), F.lit(".py")), code), "module").select("id", "path", "title", "content", "kind")


@query(f"""WITH {_PASCAL} SELECT substr(sha256('parts:python:m/' || key || '.py'), 1, 16) AS id, key || ' - ' || substr(p_name, 1, 60) AS title, 'os,sys.path' AS imports, pascal AS exports, 'class,method' AS symbols FROM q""")
def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole modules: imports in walk order, exported names, and of special methods the one that is always kept."""
    code = F.concat(F.lit('"""'), F.col("p_name"), F.lit('"""\nimport os\nfrom sys import path\nclass '), F.col("pascal"), F.lit(":\n    def __call__(self): ...\n    def __len__(self): ...\n    def _own(self): ...\n"))
    rows = pycode.chunk_python(_files(spark, sf_dir, F.concat(F.lit("m/"), F.col("key"), F.lit(".py")), code), "file", include_private=True)
    kept = F.filter("symbols_extracted", lambda s: ~s["name"].endswith("_own") & ~s["name"].endswith("__len__"))
    return rows.select("id", "title", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), F.array_join(F.transform(kept, lambda s: s["type"]), ",").alias("symbols"))


@query("SELECT p_partkey, ['numpy', 'sphinx', 'google', 'google'][p_partkey % 4 + 1] AS style FROM part")
def docstring_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(*[F.lit(x) for x in ("\n\nParameters\n----------\nx", "\n\n:returns: y", "\n\nArgs:\n  x: y", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", pycode.docstring_style(F.concat("p_name", marks)).alias("style"))


@query("SELECT p_partkey AS query_id, 'btn button brd brand bnd make label ' || regexp_extract(p_brand, '[0-9]+') AS expanded FROM part")
def custom_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with words of custom abbreviations and synonyms; of two abbreviations a full form leads back to the last."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("btn brd "), "p_brand").alias("text"))
    return expand.expanded_query(rows, expand.expansions(spark, [("Brd", "Brand"), ("Bnd", "Brand")], [("Brand", "Make", "Label")]))


@query(f"""WITH {_PASCAL}, c AS (
  SELECT key, pascal, 'outputs' AS tag, '# ' || pascal || ' Outputs' || chr(10) || chr(10) || '| Output | Type | Description |' || chr(10) || '|--------|------|-------------|' || chr(10) || '| `done` | `EventEmitter` | ' || p_brand || ' |' AS content, 'Buttons' AS component_category FROM q
  UNION ALL SELECT key, pascal, 'directive-overview', '# ' || pascal || ' (Directive)' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '**Selector:** `[d' || key || ']`' || chr(10), 'Directives' FROM q
  UNION ALL SELECT key, pascal, 'service-overview', '# ' || pascal || ' (Service)' || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || '- `load(): Data`' || chr(10) || '- `stop(): void`' || chr(10), 'Services' FROM q)
SELECT substr(sha256('parts:compodoc:' || pascal || ':' || tag), 1, 16) AS id, sha256(content) AS content_sha256, component_category FROM c""")
def api_other_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs, directives and services of API documentation."""
    method = lambda name, back: F.struct(F.lit(name).alias("name"), F.lit(back).cast("string").alias("returnType"))
    output = F.array(F.struct(F.lit("done").alias("name"), F.col("p_brand").alias("rawdescription")))
    one = F.struct(F.col("pascal").alias("name"), F.lit("src/buttons/a.ts").alias("file"), output.alias("outputsClass"))
    directive = F.struct(F.col("pascal").alias("name"), F.concat(F.lit("[d"), F.col("key"), F.lit("]")).alias("selector"), F.col("p_type").alias("rawdescription"))
    service = F.struct(F.col("pascal").alias("name"), F.array(method("load", "Data"), method("stop", None)).alias("methodsClass"))
    doc = F.to_json(F.struct(F.array(one).alias("components"), F.array(directive).alias("directives"), F.array(service).alias("injectables")))
    rows = apidoc.chunk_apidoc(_files(spark, sf_dir, F.concat(F.lit("d/"), F.col("key"), F.lit("/documentation.json")), doc), default_category="")
    return rows.where("coalesce(anchor, '') = 'outputs' or title like '%)'").select("id", F.sha2("content", 256).alias("content_sha256"), "component_category")


def _web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("z"), F.col("key"))
    ts = F.concat(F.lit("export class "), F.col("pascal"), F.lit("Component {\n  x = 1\n}\nclass Aux {}\n"))
    parts = [_files(spark, sf_dir, F.concat(F.lit("s/"), key, F.lit(e)), c) for e, c in ((".component.ts", ts), (".component.html", F.lit("<p>")), (".component.scss", F.lit("a{}")))]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {_PASCAL} SELECT substr(sha256('parts:source:s/z' || key || '.component.ts:' || name), 1, 16) AS id, lower(name) AS anchor, name AS title, content, place AS seq FROM (
  SELECT key, pascal || 'Component' AS name, 'export class ' || pascal || 'Component {{' || chr(10) || '  x = 1' || chr(10) || '}}' || chr(10) || 'class Aux {{}}' || chr(10) AS content, 0 AS place FROM q
  UNION ALL SELECT key, 'Aux', 'class Aux {{}}' || chr(10), 1 FROM q)""")
def source_symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webcode.chunk_source(_web_files(spark, sf_dir), "symbol").where("anchor is not null").select("id", "anchor", "title", "content", "seq")


@query(f"""WITH {_PASCAL} SELECT 'component:' || pascal AS src, 'source:s/z' || key || '.component.ts' AS dst, 'has_source' AS relation_type FROM q
UNION ALL SELECT 'component:Z' || key, 'source:s/z' || key || '.component.html', 'has_template' FROM q UNION ALL SELECT 'component:Z' || key, 'source:s/z' || key || '.component.scss', 'has_stylesheet' FROM q""")
def graph_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(webcode.chunk_source(_web_files(spark, sf_dir)), sources=True).edges.select("src", "dst", "relation_type")


@query(f"WITH {_PASCAL} SELECT 's/z' || key || '.component.ts' AS path, 'typescript' AS language FROM q")
def source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source chunks of a language and a file type."""
    return source_filter(webcode.chunk_source(_web_files(spark, sf_dir)), "typescript", "component").select("path", "language")


@query("SELECT 'template' AS file_type, 's/z7.component.html' AS path UNION ALL SELECT 'stylesheet', 's/z7.component.scss'")
def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each kind of file for a component, whatever the case of its name."""
    rows = webcode.chunk_source(_web_files(spark, sf_dir)).withColumn("rank", F.lit(1))
    return best_files(rows, "z7", ["component", "template", "stylesheet"]).select("file_type", "path")
