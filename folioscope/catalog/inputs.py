"""Corpus tables derived from the given tables, for Spark and for the check SQL.

The documents become Markdown pages with frontmatter, links, tags and fields;
the labelled ones become rows of a processing ledger.  Both engines run the
same statement, so each starts from equal input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.session import spread

NOW = 1709251200  # 2024-03-01T00:00:00Z
TODAY = "2024-03-01"
MODEL = "m1"
MAX_BYTES = 8_000
EXCLUDE = ["notes/es", "sources/_archived"]

NL = "chr(10)"
_SHA = {"spark": lambda x: f"sha2({x}, 256)", "duckdb": lambda x: f"sha256({x})"}
_TS = {"spark": lambda s: f"timestamp_seconds({s})", "duckdb": lambda s: f"make_timestamp(({s}) * 1000000)"}
_BYTES = {"spark": lambda x: f"CAST(octet_length({x}) AS BIGINT)", "duckdb": lambda x: f"CAST(strlen({x}) AS BIGINT)"}

PATH = """CASE lang WHEN 'en' THEN 'sources/doc-' || doc_id || '.md' WHEN 'fr' THEN 'concepts/doc-' || doc_id || '.md'
  WHEN 'de' THEN 'entities/Doc-' || doc_id || '.md' ELSE 'notes/es/doc-' || doc_id || '.md' END"""

CONTENT = f"""'---' || {NL}
 || CASE WHEN lang IN ('en', 'fr') THEN 'title: Doc ' || doc_id || {NL} ELSE '' END
 || CASE lang WHEN 'en' THEN 'type: source' || {NL} WHEN 'fr' THEN 'type: concept' || {NL}
      WHEN 'de' THEN 'type: entity' || {NL} ELSE '' END
 || CASE source WHEN 'src1' THEN 'category: Legal' || {NL} WHEN 'src2' THEN 'category: reference' || {NL}
      WHEN 'src3' THEN 'category: memo' || {NL} ELSE '' END
 || CASE WHEN lang = 'es' THEN 'tags: ' || lang || ', ' || source || {NL}
      ELSE 'tags: [' || lang || ', ' || source || ']' || {NL} END
 || CASE WHEN lang = 'en' THEN 'source_path: /in/' || source || '/doc-' || doc_id || '.txt' || {NL} ELSE '' END
 || CASE WHEN lang = 'en' AND n_chars > 500 THEN 'ingested_at: 2024-01-15' || {NL} ELSE '' END
 || CASE WHEN lang = 'de' THEN 'aliases: [Seite ' || doc_id || ', S' || doc_id || ']' || {NL} ELSE '' END
 || '---' || {NL} || {NL}
 || CASE WHEN lang IN ('de', 'es') THEN '# Page ' || doc_id || {NL} || {NL} ELSE '' END
 || text || {NL} || {NL}
 || 'See [[doc-' || CAST(floor(doc_id / 2) AS BIGINT) || ']] and [[Topic ' || lang || '|the topic]] with ![[fig-'
 || source || '.png]]' || CASE WHEN n_chars > 400 THEN ' and [[DOC-' || (doc_id + 1) || '#part]]' ELSE '' END || ' or [home](../doc-' || CAST(floor(doc_id / 3) AS BIGINT)
 || '.md#top) ![pic](img/' || source || '.png) [out](https://example.com/' || doc_id || ')' || {NL}
 || CASE WHEN lang = 'fr' THEN '```' || {NL} || '[[fenced]]' || {NL} || '```' || {NL} || '`[[inline]]` done' || {NL}
      ELSE '' END
 || 'status:: ' || source || {NL} || 'owner:: team ' || lang || {NL} || '#' || lang || '/' || source || {NL}"""

SCHEMA_CONTENT = f"""'# Schema' || {NL} || {NL} || CAST(count(*) AS VARCHAR(20)) || ' pages, first [[doc-'
 || CAST(min(doc_id) AS VARCHAR(20)) || ']] and [[nowhere]]' || {NL}"""


def pages_sql(engine: str) -> str:
    ts, size = _TS[engine], _BYTES[engine]
    return f"""SELECT path, content, {size('content')} AS size, {ts(f'{NOW} - n_chars * 60')} AS mtime,
      {ts(f'{NOW} - (n_chars % 20) * 86400')} AS indexed_at, doc_id, lang, source, n_chars
    FROM (SELECT {PATH} AS path, {CONTENT} AS content, doc_id, lang, source, n_chars FROM {{documents}}
      UNION ALL SELECT '_schema.md', {SCHEMA_CONTENT}, CAST(-1 AS BIGINT), 'en', 'none', CAST(10 AS BIGINT)
      FROM {{documents}})"""


def sources_sql(engine: str) -> str:
    ts, size, sha = _TS[engine], _BYTES[engine], _SHA[engine]
    return f"""SELECT '/in/' || source AS source_dir, '/in/' || source || '/Doc ' || doc_id ||
      CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.pdf' ELSE '.exe' END AS source_path,
      text, {size('text')} AS size, {ts(f'{NOW} - n_chars')} AS mtime, {sha('text')} AS content_hash,
      doc_id, lang, source, n_chars FROM {{documents}}"""


def ledger_sql(engine: str) -> str:
    ts, sha = _TS[engine], _SHA[engine]
    return f"""SELECT source_path, CASE WHEN source = 'src3' THEN {sha("'old' || text")} ELSE content_hash END AS content_hash,
      source_dir, {ts(f'{NOW} - 864000 + doc_id')} AS digested_at,
      CASE WHEN toxic = 0 AND quality = 1 THEN 'sources/doc-' || doc_id || '.md' ELSE '' END AS wiki_page,
      CASE WHEN toxic = 1 THEN 'refused' WHEN quality = 0 THEN 'failed' ELSE 'success' END AS status,
      CAST(CASE WHEN toxic = 0 AND quality = 0 THEN n_chars % 5 ELSE 0 END AS INT) AS attempts,
      CASE WHEN toxic = 1 THEN 'policy' WHEN quality = 0 THEN 'bad page' ELSE '' END AS last_error,
      CASE WHEN quality = 1 THEN 'scheduled' ELSE 'interactive' END AS run_origin,
      CASE WHEN lang = 'de' THEN 'm0' ELSE 'm1' END AS llm_model
    FROM ({{sources}}) s JOIN {{labels}} l USING (doc_id)
    UNION ALL
    SELECT source_path, {sha("'v0' || text")}, source_dir, {ts(f'{NOW} - 8640000 + doc_id')},
      'sources/doc-' || CAST(floor(doc_id / 4) AS BIGINT) || '.md', 'success', CAST(0 AS INT), '', 'scheduled', 'm0'
    FROM ({{sources}}) s JOIN {{labels}} l USING (doc_id) WHERE toxic = 0 AND quality = 1"""


def vectors_sql(engine: str) -> str:
    ts, sha = _TS[engine], _SHA[engine]
    return f"""SELECT p.path, CASE WHEN e.label = 1 THEN 'older' ELSE {sha('p.content')} END AS content_hash,
      CASE WHEN e.label = 0 THEN 'm0' ELSE 'm1' END AS model, e.embedding AS vector, 64 AS dims,
      {ts(str(NOW))} AS updated_at, e.label
    FROM ({{pages}}) p JOIN {{embeddings}} e ON p.doc_id = e.vec_id"""


# --- Spark ---------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(pages_sql("spark"), documents=documents(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sources_sql("spark"), documents=documents(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = ledger_sql("spark").replace("({sources})", "{sources}")
    return spark.sql(statement, sources=sources(spark, sf_dir), labels=table(spark, sf_dir, "labels"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = vectors_sql("spark").replace("({pages})", "{pages}")
    return spark.sql(statement, pages=pages(spark, sf_dir), embeddings=table(spark, sf_dir, "embeddings"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed file types per folder; one folder takes Markdown only."""
    return table(spark, sf_dir, "documents").selectExpr("'/in/' || source AS source_dir", """
        CASE WHEN source = 'src19' THEN array('md') ELSE array('txt', 'md', 'pdf') END AS types""").dropDuplicates(
        ["source_dir"])


# --- check SQL -----------------------------------------------------------

_D = {"documents": "documents", "labels": "labels", "embeddings": "embeddings"}
PAGES = pages_sql("duckdb").format(**_D)
SOURCES = sources_sql("duckdb").format(**_D)
LEDGER = ledger_sql("duckdb").format(**_D, sources=SOURCES)
VECTORS = vectors_sql("duckdb").format(**_D, pages=PAGES)

# pages parsed with SQL expressions: header, body, columns, and a text without code
PARSED = f"""SELECT *, CASE WHEN lower(trim(cat)) IN ('article', 'legal', 'reference') THEN lower(trim(cat))
    WHEN cat = '' THEN '' ELSE 'article' END AS category FROM (
  SELECT *, coalesce(nullif(regexp_extract(header, '(?m)^title: (.*)$', 1), ''),
      nullif(trim(regexp_extract(body, '(?m)^#\\s+(.+)$', 1)), ''),
      regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')) AS title,
    regexp_extract(header, '(?m)^type: (.*)$', 1) AS type,
    regexp_extract(header, '(?m)^category: (.*)$', 1) AS cat,
    list_transform(string_split(regexp_replace(regexp_extract(header, '(?m)^tags: (.*)$', 1), '[\\[\\]]', '', 'g'), ','),
      lambda t: trim(t)) AS fm_tags,
    regexp_replace(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g') AS no_code
  FROM (SELECT *, regexp_extract(content, '(?s)^---\\n(.*?)\\n---\\n', 1) AS header,
      regexp_replace(content, '(?s)^---\\n.*?\\n---\\n', '') AS body FROM ({PAGES})))"""

LINKS = """SELECT DISTINCT path, trim(regexp_extract(raw, '^!?\\[\\[([^|#\\]]*)', 1)) AS link, raw[1] = '!' AS embed
  FROM (SELECT path, unnest(regexp_extract_all(no_code, '!?\\[\\[[^\\]\\n]+\\]\\]')) AS raw FROM parsed)"""

TAGS = """SELECT DISTINCT path, tag FROM (
  SELECT path, unnest(fm_tags) AS tag FROM parsed
  UNION ALL SELECT path, unnest(regexp_extract_all(body, '(?:^|\\s)#([a-zA-Z\\p{L}][\\w\\p{L}/\\-]*)', 1)) FROM parsed)
  WHERE tag <> ''"""

# candidates in order: link.md, sources/link.md, link, then the file name without case
RESOLVED = """SELECT link, arg_min(path, (o, path)) AS target FROM (
    SELECT l.link, p.path, 0 AS o FROM (SELECT DISTINCT link FROM links WHERE NOT embed) l JOIN parsed p ON p.path = l.link || '.md'
    UNION ALL SELECT l.link, p.path, 1 FROM (SELECT DISTINCT link FROM links WHERE NOT embed) l JOIN parsed p ON p.path = 'sources/' || l.link || '.md'
    UNION ALL SELECT l.link, p.path, 2 FROM (SELECT DISTINCT link FROM links WHERE NOT embed) l JOIN parsed p ON p.path = l.link
    UNION ALL SELECT l.link, p.path, 3 FROM (SELECT DISTINCT link FROM links WHERE NOT embed) l JOIN parsed p
      ON lower(regexp_replace(regexp_extract(p.path, '[^/]*$'), '\\.md$', '')) = lower(l.link))
  GROUP BY link"""


def with_(*names: str) -> str:
    """A WITH clause of the named inputs (each after those it needs)."""
    known = {"pages_": PAGES, "sources": SOURCES, "ledger": LEDGER, "vectors": VECTORS, "parsed": PARSED,
             "links": LINKS, "tags": TAGS, "resolved": RESOLVED}
    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in names) + "\n"
