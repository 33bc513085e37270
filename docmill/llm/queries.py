"""One query for each operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import chat, clusters, decontam, html, langid, licenses, minhash, mixing, token_store, urls, vectors, warc
from docmill.plans.shared import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


#: Conversation -7: texts that look like another template's marks.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_chats(turns))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.store_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_licenses, op2_html, op3_chat, op4_warc, op5_urls, op6_vectors, op7_mixing, op8_minhash, op9_langid, op10_decontam, op11_clusters, op12_tokens)}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical_sql(text: str) -> str:
    """DuckDB SQL for the canonical forms of lines, with line ends between."""
    t = f"lower(regexp_replace(replace(coalesce({text}, ''), chr(13), ' '), '{licenses.COPYRIGHT_LINE}', '', 'g'))"
    t = f"'  ' || replace(regexp_replace({t}, '{licenses.MARKS}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for word, other in licenses.SPELLINGS:
        t = f"replace({t}, ' {word} ', ' {other} ')"
    return f"regexp_replace({t}, ' +', ' ', 'g')"


def _joined_sql(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


def _values(rows) -> str:
    return ", ".join("({})".format(", ".join("'{}'".format(x.replace("'", "''")) for x in r)) for r in rows)


#: Digests of the entire texts; the notices are put together in SQL as they are in Python.
_TEXTS = _values({(i, hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()) for i, t in licenses.known_texts()})
_NOTICES = (
    f"SELECT id, {_joined_sql(_canonical_sql("subject || ' ' || verb || ' under ' || article || ' ' || form"))} AS form FROM (VALUES {_values((i, n) for i, ns in licenses.NAMES.items() for n in ns)}) n(id, form), "
    f"(VALUES {_values((x,) for x in licenses.SUBJECTS)}) s(subject), (VALUES {_values((x,) for x in licenses.VERBS)}) v(verb), (VALUES {_values((x,) for x in licenses.ARTICLES)}) a(article)"
)
_ESCAPE = rf"regexp_replace({{}}, '([<\[])(\\*)({chat._CONTROL})', '\1\\\2\3', 'g')"
_ROLE = "replace(replace(role, '%', '%25'), chr(10), '%0A')"



def _kmeans_sql(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """Rounds written out one after the other, every vector against every centroid; distances of whole numbers are exact in doubles."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings "
        f"WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        apart = "list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': {apart}, 'c': c.c}}) AS best FROM v, c{i} c GROUP BY v.r)")
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS x "
                f"FROM (SELECT c, place, sum(x::BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(x) AS x, unnest(range({width})) AS place FROM a{i}) GROUP BY c, place) GROUP BY c) n USING (c))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d::BIGINT) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d::BIGINT) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(list_transform(c.x, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"
    )


SQL: dict[str, str] = {
    "op11_clusters": _kmeans_sql(8, 10, 64, 1024, 3),
    "op1_licenses": f"""
WITH k AS (
  SELECT digest, min(id) AS license_id FROM (SELECT id, sha256(form) AS digest FROM ({_NOTICES}) UNION ALL SELECT * FROM (VALUES {_TEXTS}) t(id, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql("text")} AS lines FROM documents),
l AS (SELECT r, k.license_id AS id FROM (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS line FROM d) x JOIN k ON k.digest = sha256(line)),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM l GROUP BY r)
SELECT doc_id, sha256({_joined_sql("lines")}) AS canonical_sha256, license_id, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(ids, '') AS line_license_ids
FROM d LEFT JOIN k ON k.digest = sha256({_joined_sql("lines")}) LEFT JOIN n USING (r)""",
    "op3_chat": rf"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, NULL, 0, 'user', '</s>[INST] ok [/INST]'), (-7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joins, lead(role) OVER w IS DISTINCT FROM role AS ends, row_number() OVER w AS i
  FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPE.format("text")}) + CASE WHEN joins THEN 10 ELSE 13 + length({_ESCAPE.format(_ROLE)}) END + CASE WHEN ends THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id, alone""",
    "op4_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f""",
    "op6_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.vec_id)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) m LEFT JOIN n ON n.u = m.vec_id""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS o
  FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
k AS (  -- the smaller a source is against its weight, the earlier it is full
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / w, source) AS i FROM s),
c AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY i DESC) AS w_rest FROM k),
f AS (SELECT min(i) AS i FROM c WHERE (total - full_before) / w_rest * w <= cap),
t AS (
  SELECT source, source_size, CASE WHEN c.i < f.i THEN cap ELSE (SELECT (total - full_before) / w_rest FROM c c2 WHERE c2.i = f.i) * w END AS target
  FROM c, f),
q AS (SELECT *, round(target)::BIGINT AS words FROM t),
r AS (
  SELECT d.*, q.source_size, q.target, q.words, sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (CASE WHEN source_size = 0 THEN 0 ELSE size * least(3, words // source_size + CASE WHEN 2 * upto - size <= 2 * (words % source_size) AND words % source_size > 0 THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM r""",
    "op8_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)""",
    "op10_decontam": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, x.n FROM x JOIN g ON x.g = g.g AND x.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM m) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
