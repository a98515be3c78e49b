"""Sources, listings, lookups and page parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import inputs as I
from folioscope.catalog.inputs import with_
from folioscope.catalog.registry import query
from folioscope.functions import header as hd
from folioscope.functions import paths as pt
from folioscope.functions import text as tx
from folioscope.operators import changes as ch
from folioscope.operators import gates, listing
from folioscope.operators.parse import index_rows, parse_pages, parse_with, tag_rows
from folioscope.operators.rows import unnest
from folioscope.plans import corpus
from folioscope.session import work_dir, written
from folioscope.sources import files, web

def now():
    return F.timestamp_seconds(F.lit(I.NOW))

GATED = """SELECT *, CASE WHEN NOT ok THEN 'skipped' WHEN size > 8000 THEN 'skipped' WHEN n_chars < 120 THEN 'deferred'
    ELSE 'pass' END AS gate, CASE WHEN NOT ok THEN 'type not allowed' WHEN size > 8000 THEN 'exceeds max file size'
    WHEN n_chars < 120 THEN 'within settle window' ELSE '' END AS gate_error
  FROM (SELECT *, CASE WHEN source = 'src19' THEN lang = 'fr' ELSE lang IN ('en', 'fr', 'de') END AS ok FROM sources)"""


def gated(spark, d):
    return gates.gate(I.sources(spark, d), I.types(spark, d), now(), I.MAX_BYTES)


FOLDERS = ["sources", "concepts", "entities", "notes/es"]
# every fiftieth page has a twin with a hidden name
TWINS = "SELECT regexp_replace(path, '([^/]*)$', '.\\1') AS path, content, size FROM {pages} WHERE doc_id % 50 = 0"


@query("A1_scan_sources", with_("pages_") + f"""SELECT regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '[^/]*$') AS name, size
  FROM (SELECT path, size FROM pages_ WHERE contains(path, '/') UNION ALL SELECT path, size FROM ({TWINS.format(pages='pages_')}))""")
def a1(spark, d):
    """Four folders, one of them named twice, each listed by its own task."""
    root = work_dir(spark)
    pages = I.pages(spark, d).where(F.contains("path", F.lit("/")))
    hidden = F.concat(F.regexp_extract("path", "^(.*/)", 1), F.lit("."), pt.base_name(F.col("path")))
    twins = pages.where("doc_id % 50 = 0").withColumn("path", hidden)
    files.write_pages(pages.unionByName(twins), root)
    found = files.scan_sources(spark, [f"{root}/{f}" for f in [*FOLDERS, "sources/"]])
    folder = F.substring(F.col("source_dir"), len(root) + 2, 1000)
    return found.select(folder.alias("folder"), pt.base_name(F.col("source_path")).alias("name"), "size")


@query("A2_type_gate", with_("sources") + """SELECT source_path, CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md'
  WHEN 'de' THEN 'pdf' ELSE 'exe' END AS file_type,
  CASE WHEN source = 'src19' THEN lang = 'fr' ELSE lang IN ('en', 'fr', 'de') END AS allowed FROM sources""")
def a2(spark, d):
    return gated(spark, d).select("source_path", gates.file_type(F.col("source_path")).alias("file_type"),
                                  (F.col("gate_error") != "type not allowed").alias("allowed"))


@query("A3_size_cap", with_("sources") + f"SELECT source_path, gate FROM ({GATED}) WHERE gate_error = 'exceeds max file size'")
def a3(spark, d):
    return gated(spark, d).where(F.col("gate_error") == "exceeds max file size").select("source_path", "gate")


@query("A4_settle_gate", with_("sources") + f"SELECT source_path, gate FROM ({GATED}) WHERE gate = 'deferred'")
def a4(spark, d):
    return gated(spark, d).where(F.col("gate") == "deferred").select("source_path", "gate")


@query("A5_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a5(spark, d):
    return I.documents(spark, d).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("A5_streamed_hash", with_("pages_") + "SELECT path, sha256(content) AS content_hash FROM pages_")
def a5_streamed(spark, d):
    """Hashes of files, read piece by piece."""
    root = work_dir(spark)
    files.write_pages(I.pages(spark, d), root)
    found = files.with_hash(files.scan_pages(spark, root).withColumn("source_path", F.concat(F.lit(root + "/"), "path")))
    return found.select("path", "content_hash")


@query("A6_scan_pages", with_("pages_") + "SELECT path, size FROM pages_ WHERE path NOT LIKE 'notes/es/%'")
def a6(spark, d):
    root = work_dir(spark)
    files.write_pages(I.pages(spark, d), root)
    return files.scan_pages(spark, root, I.EXCLUDE).select("path", "size")


@query("A7_effective_exclude", with_("pages_") + """SELECT path, (path = '.obsidian' OR path LIKE '.obsidian/%' OR path = '.trash'
  OR path LIKE '.trash/%' OR starts_with(path, 'sources/_archived/') OR path = 'sources/_archived' OR path = 'entities'
  OR path LIKE 'entities/%') AS hidden FROM pages_""")
def a7(spark, d):
    hidden = pt.effective_exclude(exclude_read=["entities"])
    return I.pages(spark, d).select("path", pt.excluded(F.col("path"), hidden).alias("hidden"))


CHILD_SQL = with_("pages_", "parsed") + """SELECT DISTINCT CASE WHEN is_dir THEN child || '/' ELSE child END AS path, child AS name, is_dir,
    CASE WHEN is_dir THEN '' ELSE title END AS title, CASE WHEN is_dir THEN '' ELSE type END AS type,
    CASE WHEN is_dir THEN '' ELSE category END AS category
  FROM (SELECT split_part(path, '/', 1) AS child, contains(path, '/') AS is_dir, title, type, category FROM parsed)
  WHERE child <> 'entities'"""


@query("A8_list_children", CHILD_SQL)
def a8(spark, d):
    return listing.list_children(parse_pages(I.pages(spark, d)), ".", ["entities"])


@query("A8_list_children_of_folder", with_("pages_", "parsed") + """SELECT path, regexp_extract(path, '[^/]*$') AS name,
  false AS is_dir, title, type, category FROM parsed WHERE path LIKE 'sources/%'""")
def a8b(spark, d):
    return listing.list_children(parse_pages(I.pages(spark, d)), "sources")


@query("A9_scan_prefix", with_("pages_") + "SELECT path FROM pages_ WHERE path LIKE 'concepts/%'")
def a9(spark, d):
    return listing.scan_prefix(I.pages(spark, d), "concepts", I.EXCLUDE)


REQUESTS = """SELECT DISTINCT 'sources/doc-' || (doc_id + quality) || '.md' AS path FROM labels
  UNION SELECT DISTINCT 'entities/Doc-' || doc_id || '.md' FROM labels"""


def requests(spark, d):
    return spark.sql(REQUESTS.replace("FROM labels", "FROM {labels}"), labels=I.table(spark, d, "labels"))


@query("A10_lookup_pages", with_("pages_") + f"""SELECT r.path, CASE WHEN r.path LIKE 'entities/%' THEN 'denied'
  WHEN p.path IS NULL THEN 'not-found' ELSE 'found' END AS status,
  CASE WHEN r.path NOT LIKE 'entities/%' THEN p.size END AS size FROM ({REQUESTS}) r LEFT JOIN pages_ p ON p.path = r.path""")
def a10(spark, d):
    return listing.lookup_pages(requests(spark, d), I.pages(spark, d), ["entities"]).select("path", "status", "size")


@query("A10_lookup_vectors", with_("pages_", "vectors") + f"""SELECT path, model, content_hash, dims FROM vectors
  WHERE model = 'm1' AND path IN (SELECT path FROM ({REQUESTS}))""")
def a10v(spark, d):
    wanted = requests(spark, d).withColumn("model", F.lit("m1"))
    return listing.lookup_vectors(wanted, I.vectors(spark, d)).select("path", "model", "content_hash", "dims")


@query("A11_capture_web", f"""SELECT 'web-' || CASE WHEN strlen(nm) > 80 THEN left(nm, 80) ELSE nm END ||
    CASE WHEN nm LIKE '%.md' THEN '' ELSE '.md' END AS name, url,
    '---' || chr(10) || 'source_url: ' || url || chr(10) || 'fetched_at: {I.TODAY}' || chr(10) || '---' || chr(10) || chr(10) || html AS content
  FROM (SELECT url, html, replace(replace(CASE WHEN p = '' THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ELSE p END, '/', '-'), ' ', '-') AS nm
    FROM (SELECT url, html, trim(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/') AS p FROM pages))""")
def a11(spark, d):
    return web.capture_web(I.table(spark, d, "pages"), I.TODAY)


ODD_PAGES = """SELECT 'https://site.org/' || repeat('a', CAST(76 + page_id % 6 AS INT)) || 'é/tail' AS url,
  CASE WHEN page_id % 2 = 1 THEN 'x' ELSE '' END || repeat('é', 20) || html AS html, page_id FROM {pages}"""


@query("A11_capture_web_cut", f"""SELECT 'web-' || repeat('a', CAST(least(76 + page_id % 6, 80) AS INT)) || CASE WHEN page_id % 6 <= 2 THEN 'é' ELSE '' END
    || CASE page_id % 6 WHEN 0 THEN '-t' WHEN 1 THEN '-' ELSE '' END || '.md' AS name, url,
    '---' || chr(10) || 'source_url: ' || url || chr(10) || 'fetched_at: {I.TODAY}' || chr(10) || '---' || chr(10) || chr(10) || left(html, CAST(15 + page_id % 2 AS INT)) AS content
  FROM ({ODD_PAGES.format(pages='pages')})""")
def a11_cut(spark, d):
    """Addresses and bodies whose last byte that fits is inside a character."""
    return web.capture_web(spark.sql(ODD_PAGES, pages=I.table(spark, d, "pages")), I.TODAY, max_body=31)


@query("A12_write_page", with_("pages_") + """SELECT path, CASE WHEN path = '_schema.md' THEN 'denied' ELSE 'written' END AS status,
  CASE WHEN path <> '_schema.md' THEN size END AS bytes FROM pages_""")
def a12(spark, d):
    return ch.write_ops(I.pages(spark, d))


@query("A13_delete_page", with_("pages_", "vectors") + f"""SELECT 'page' AS kind, path FROM pages_ WHERE path NOT IN (SELECT path FROM ({REQUESTS}))
  UNION ALL SELECT 'vector', path FROM vectors WHERE path NOT IN (SELECT path FROM ({REQUESTS}))""")
def a13(spark, d):
    doomed = requests(spark, d)
    kept = lambda df, kind: ch.delete_pages(df, doomed).select(F.lit(kind).alias("kind"), "path")
    return kept(I.pages(spark, d), "page").unionByName(kept(I.vectors(spark, d), "vector"))


UNREADABLE = ["sources/doc-1.md", "entities"]
DOOMED = """SELECT path FROM {pages_} WHERE length(path) % 2 = 0 UNION ALL SELECT './gone/' || path FROM {pages_} WHERE length(path) % 3 = 0
  UNION ALL SELECT '_schema.md' UNION ALL SELECT 'entities/x.md'"""


@query("A13_delete_outcomes", with_("pages_") + f"""SELECT d.path, CASE WHEN d.path = '_schema.md' OR d.path = 'sources/doc-1.md' OR d.path = 'entities' OR d.path LIKE 'entities/%' THEN 'denied'
    WHEN p.path IS NULL THEN 'not-found' ELSE 'deleted' END AS status
  FROM (SELECT DISTINCT regexp_replace(path, '^\\./', '') AS path FROM ({DOOMED.format(pages_='pages_')})) d LEFT JOIN pages_ p USING (path)""")
def a13o(spark, d):
    pages = I.pages(spark, d)
    return ch.delete_outcomes(pages, spark.sql(DOOMED, pages_=pages), exclude_read=UNREADABLE)


@query("A12_write_excluded", with_("pages_") + """SELECT path, CASE WHEN path = '_schema.md' OR path = 'sources/doc-1.md' OR path LIKE 'entities/%' THEN 'denied' ELSE 'written' END AS status,
  CASE WHEN NOT (path = '_schema.md' OR path = 'sources/doc-1.md' OR path LIKE 'entities/%') THEN size END AS bytes FROM pages_""")
def a12x(spark, d):
    return ch.write_ops(I.pages(spark, d), exclude_read=UNREADABLE)


MOVES = """SELECT 'sources/doc-' || doc_id || '.md' AS src, CASE WHEN quality = 1 THEN 'moved/doc-' || doc_id || '.md'
  ELSE 'sources/doc-' || (doc_id + 1) || '.md' END AS dst FROM labels"""
OUTCOME = f"""SELECT src, dst, CASE WHEN s.path IS NULL THEN 'not-found' WHEN t.path IS NOT NULL THEN 'exists' ELSE 'moved' END AS status
  FROM ({MOVES}) m LEFT JOIN pages_ s ON s.path = src LEFT JOIN pages_ t ON t.path = dst"""


def moves(spark, d):
    return spark.sql(MOVES.replace("FROM labels", "FROM {labels}"), labels=I.table(spark, d, "labels"))


@query("A14_move_page", with_("pages_") + OUTCOME)
def a14(spark, d):
    return ch.move_pages(I.pages(spark, d), moves(spark, d))[1]


@query("A14_pages_after_move", with_("pages_") + f"""SELECT coalesce(o.dst, p.path) AS path, size FROM pages_ p
  LEFT JOIN (SELECT * FROM ({OUTCOME}) WHERE status = 'moved') o ON o.src = p.path""")
def a14b(spark, d):
    return ch.move_pages(I.pages(spark, d), moves(spark, d))[0].select("path", "size")


@query("A15_graph_sink", with_("pages_", "parsed", "links", "resolved") + """SELECT 'node' AS kind, path AS a, title AS b FROM parsed
  UNION ALL SELECT 'edge', l.path, r.target FROM links l JOIN resolved r USING (link) WHERE NOT l.embed""")
def a15(spark, d):
    out = work_dir(spark)
    parsed = parse_pages(I.pages(spark, d)).select("path", "title", "type", "links")
    files.write_graph(*corpus.link_graph(written(parsed, "parsed")), out)
    nodes = spark.read.schema("path string, title string, type string").json(f"{out}/nodes")
    edges = spark.read.schema("source string, target string").json(f"{out}/edges")
    return nodes.select(F.lit("node").alias("kind"), F.col("path").alias("a"), F.col("title").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("A16_existing", with_("pages_") + f"""SELECT r.path, p.path IS NOT NULL AS present FROM ({REQUESTS}) r
  LEFT JOIN pages_ p ON p.path = r.path""")
def a16(spark, d):
    return listing.existing(requests(spark, d), I.pages(spark, d))


# --- parsing ---------------------------------------------------------------

P = with_("pages_", "parsed")


def parsed(spark, d, dialect="wikilink"):
    return parse_pages(I.pages(spark, d), dialect)


@query("B1_strip_bom", "SELECT doc_id, sha256(text) AS body_hash, sha256(chr(65279) || text) AS raw_hash FROM documents")
def b1(spark, d):
    marked = I.documents(spark, d).withColumn("raw", F.concat(F.lit("\ufeff"), "text"))
    return marked.select("doc_id", tx.content_hash(tx.strip_bom(F.col("raw"))).alias("body_hash"),
                         tx.content_hash(F.col("raw")).alias("raw_hash"))


@query("B2_split_frontmatter", P + """SELECT path, sha256(body) AS body_hash,
  CAST(len(regexp_extract_all(header, '(?m)^\\w+: ')) AS INT) AS n_fields FROM parsed""")
def b2(spark, d):
    rows = hd.with_header(I.pages(spark, d))
    return rows.select("path", tx.content_hash(F.col("body")).alias("body_hash"),
                       hd.field_count(F.col("header")).alias("n_fields"))


@query("B3_title", P + "SELECT path, title FROM parsed")
def b3(spark, d):
    return parsed(spark, d).select("path", "title")


@query("B4_aliases", P + """SELECT path, unnest(string_split(regexp_extract(header, '(?m)^aliases: \\[(.*)\\]$', 1), ', ')) AS alias
  FROM parsed WHERE contains(header, 'aliases: ')""")
def b4(spark, d):
    return unnest(parsed(spark, d), "aliases", "alias", "path")


@query("B5_frontmatter_tags", P + "SELECT path, array_to_string(list_sort(fm_tags), ',') AS tags FROM parsed")
def b5(spark, d):
    tags = F.coalesce(F.col("header.tags"), F.array().cast("array<string>"))
    return hd.with_header(I.pages(spark, d)).select("path", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("B6_all_tags", with_("pages_", "parsed", "tags") + "SELECT path, tag FROM tags")
def b6(spark, d):
    return tag_rows(parsed(spark, d))


@query("B7_wikilinks", with_("pages_", "parsed", "links") + "SELECT path, link, embed FROM links")
def b7(spark, d):
    both = F.concat(F.transform("links", lambda l: F.struct(l.alias("link"), F.lit(False).alias("embed"))),
                    F.transform("attachments", lambda l: F.struct(l.alias("link"), F.lit(True).alias("embed"))))
    return unnest(parsed(spark, d), both, "x", "path").select("path", "x.*")


@query("B8_markdown_links", P + """SELECT DISTINCT path, trim(regexp_replace(href, '#.*$', '')) AS link, embed FROM (
    SELECT path, trim(regexp_extract(raw, '\\]\\(([^)]+)\\)$', 1)) AS href, raw[1] = '!' AS embed
    FROM (SELECT path, unnest(regexp_extract_all(body, '!?\\[[^\\]]*\\]\\([^)]+\\)')) AS raw FROM parsed))
  WHERE NOT regexp_matches(href, '^([a-zA-Z][a-zA-Z0-9+.\\-]*:|/|#)') AND regexp_replace(href, '#.*$', '') <> ''""")
def b8(spark, d):
    both = F.concat(F.transform("links", lambda l: F.struct(l.alias("link"), F.lit(False).alias("embed"))),
                    F.transform("attachments", lambda l: F.struct(l.alias("link"), F.lit(True).alias("embed"))))
    return unnest(parsed(spark, d, "markdown"), both, "x", "path").select("path", "x.*")


@query("B9_code_spans", P + """SELECT path, CAST(len(regexp_extract_all(body, '\\[\\[[^\\]\\n]+\\]\\]')) AS INT) AS written,
  CAST(len(regexp_extract_all(no_code, '\\[\\[[^\\]\\n]+\\]\\]')) AS INT) AS outside_code FROM parsed""")
def b9(spark, d):
    rows = parsed(spark, d)
    return rows.select("path", F.size(F.regexp_extract_all("body", F.lit(r"\[\[[^\]\n]+\]\]"), 0)).alias("written"),
                       (F.size("links") + F.size("attachments")).alias("outside_code"))


@query("B10_fields", P + """SELECT path, trim(regexp_extract(f, '^(\\w+)::', 1)) AS field, trim(regexp_extract(f, '::\\s*(.+)$', 1)) AS value
  FROM (SELECT path, unnest(regexp_extract_all(body, '(?m)^\\w+::\\s*.+$')) AS f FROM parsed)""")
def b10(spark, d):
    entries = F.map_entries("fields")
    return unnest(parsed(spark, d), entries, "x", "path").select(
        "path", F.col("x.key").alias("field"), F.col("x.value").alias("value"))


@query("B11_build_meta", with_("pages_", "parsed", "tags") + """SELECT path, title, type, category, coalesce(t.tags, '') AS tags FROM parsed
  LEFT JOIN (SELECT path, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY path) t USING (path)""")
def b11(spark, d):
    return index_rows(I.pages(spark, d)).select(
        "path", "title", "type", "category", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("B12_normalize_category", """SELECT doc_id, CASE WHEN raw = '' THEN '' WHEN lower(trim(raw)) IN ('article', 'legal', 'reference')
    THEN lower(trim(raw)) ELSE 'article' END AS category FROM (SELECT doc_id, CASE lang WHEN 'en' THEN ' Legal ' WHEN 'fr' THEN 'REFERENCE'
    WHEN 'de' THEN '' ELSE text END AS raw FROM documents)""")
def b12(spark, d):
    raw = F.expr("CASE lang WHEN 'en' THEN ' Legal ' WHEN 'fr' THEN 'REFERENCE' WHEN 'de' THEN '' ELSE text END")
    return I.documents(spark, d).select("doc_id", tx.normalize_category(raw).alias("category"))


@query("B13_join_tags", P + """SELECT path, CASE WHEN lang = 'es' THEN regexp_extract(header, '(?m)^tags: (.*)$', 1)
  ELSE replace(regexp_extract(header, '(?m)^tags: \\[(.*)\\]$', 1), ', ', ',') END AS tag_text FROM parsed""")
def b13(spark, d):
    return hd.with_header(I.pages(spark, d)).select(
        "path", F.coalesce(F.col("header.tag_text"), F.lit("")).alias("tag_text"))


@query("B14_validate_page", P + "SELECT path, header LIKE 'title: %' AS valid FROM parsed")
def b14(spark, d):
    return parsed(spark, d).select("path", "valid")


@query("B15_frontmatter_warnings", P + """SELECT path, CASE WHEN header = '' THEN 'missing YAML frontmatter' ELSE
  concat_ws('; ', CASE WHEN NOT regexp_matches(header, '(?m)^title: ') THEN 'missing frontmatter field: title' END,
    CASE WHEN type = 'source' AND NOT regexp_matches(header, '(?m)^source_path: ') THEN 'source page missing field: source_path' END,
    CASE WHEN type = 'source' AND NOT regexp_matches(header, '(?m)^ingested_at: ') THEN 'source page missing field: ingested_at' END)
  END AS warnings FROM parsed""")
def b15(spark, d):
    return parsed(spark, d).select("path", F.array_join("warnings", "; ").alias("warnings"))


def outline_parser(path, content):
    """A small dialect: ``key:: value`` lines are fields, and pages without a team are refused."""
    fields = dict(line.split(":: ", 1) for line in content.split("\n") if line.startswith(("status:: ", "owner:: ")))
    if fields.get("owner", "team es") == "team es":
        raise ValueError("no such team")
    return {"title": "Outline " + fields["status"], "category": "legal" if fields["status"] == "src1" else None, "tags": [fields["owner"], fields["status"], fields["owner"]], "fields": fields}


@query("B_custom_parser", with_("pages_") + """SELECT path, 'Outline ' || source AS title, CASE WHEN source = 'src1' THEN 'legal' ELSE '' END AS category,
    'team ' || lang || ',' || source AS tags, source AS status, CAST(NULL AS VARCHAR) AS message FROM pages_ WHERE path <> '_schema.md' AND lang <> 'es'
  UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'ValueError: no such team' FROM pages_ WHERE path = '_schema.md' OR lang = 'es'""")
def b_custom(spark, d):
    """Pages by a parser of the user; those it fails on are error rows."""
    good, errors = parse_with(I.pages(spark, d), outline_parser, "outline")
    none = F.lit(None).cast("string")
    rows = good.select("path", "title", "category", F.array_join("tags", ",").alias("tags"), F.col("fields")["status"].alias("status"), none.alias("message"))
    return rows.unionByName(errors.select("path", none.alias("title"), none.alias("category"), none.alias("tags"), none.alias("status"), "message"))


@query("B16_slug", """SELECT doc_id, CASE WHEN slug = '' THEN 'src-' || left(sha256(text), 8) ELSE slug END AS slug FROM (
  SELECT doc_id, text, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_extract(name, '[^/]*$'), '\\.[^.]*$', '')), ' ', '-'),
    '[^\\p{L}\\p{Nd}._-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM (SELECT doc_id, text, text || '.txt' AS name FROM documents))""")
def b16(spark, d):
    docs = I.documents(spark, d)
    return docs.select("doc_id", tx.slug_for(F.concat("text", F.lit(".txt")), F.sha2("text", 256)).alias("slug"))


@query("B17_hash8", "SELECT doc_id, left(sha256(text), 8) AS hash8 FROM documents")
def b17(spark, d):
    return I.documents(spark, d).select("doc_id", tx.hash8(F.col("text")).alias("hash8"))


@query("B18_archived_path", with_("sources", "ledger") + """SELECT source_path, content_hash, 'sources/_archived/' ||
  regexp_replace(regexp_extract(wiki_page, '[^/]*$'), '\\.[^.]*$', '') || '-' || left(content_hash, 8) || '.md' AS archived_page
  FROM ledger WHERE wiki_page <> ''""")
def b18(spark, d):
    return I.ledger(spark, d).where("wiki_page <> ''").select("source_path", "content_hash", tx.archived_path(
        F.col("wiki_page"), F.col("content_hash")).alias("archived_page"))


@query("B19_strip_fence", "SELECT doc_id, sha256(trim(text, ' ' || chr(10))) AS page_hash FROM documents")
def b19(spark, d):
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\n"))
    return I.documents(spark, d).select("doc_id", tx.content_hash(tx.strip_fence(fenced)).alias("page_hash"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("B20_digest_prompt", with_("sources") + f"""SELECT source_path, sha256('Schema text' || chr(10) || chr(10)
  || CASE lang WHEN 'fr' THEN {_text(tx.TYPE_PHRASES['.md'])} WHEN 'de' THEN {_text(tx.TYPE_PHRASES['.pdf'])}
  ELSE {_text(tx.OTHER_TYPE_PHRASE)} END || source_path || {_text(tx.PROMPT_SLUG)} || 'doc-' || doc_id
  || {_text(tx.PROMPT_FIELDS)} || source_path || {_text(tx.PROMPT_RULES)}) AS prompt_hash FROM sources""")
def b20(spark, d):
    path = F.col("source_path")
    return I.sources(spark, d).select("source_path", tx.content_hash(tx.digest_prompt(
        F.lit("Schema text"), path, tx.slug_for(path, F.col("content_hash")))).alias("prompt_hash"))


@query("B21_embed_title", with_("pages_") + """SELECT path, regexp_extract(content, '(?m)^(?:title: |# )(.+)$', 1) AS title FROM pages_""")
def b21(spark, d):
    return I.pages(spark, d).select("path", tx.embed_title(F.col("content")).alias("title"))


@query("B22_embed_text", with_("pages_") + """SELECT path, sha256(coalesce(nullif(regexp_extract(content, '(?m)^(?:title: |# )(.+)$', 1), ''), path)
  || chr(10) || chr(10) || left(content, 2000)) AS text_hash FROM pages_""")
def b22(spark, d):
    return I.pages(spark, d).select(
        "path", tx.content_hash(tx.embed_text(F.col("path"), F.col("content"))).alias("text_hash"))


SNIP = """CASE WHEN pos = 0 THEN '' ELSE CASE WHEN pos > 33 THEN '...' ELSE '' END
    || substr(text, greatest(pos - 32, 1), least(pos + len(q) + 31, len(text)) - greatest(pos - 32, 1) + 1)
    || CASE WHEN pos + len(q) + 31 < len(text) THEN '...' ELSE '' END END"""


@query("B23_like_snippet", f"""SELECT doc_id, {SNIP} AS snippet FROM (SELECT doc_id, text, CASE lang WHEN 'de' THEN 'UND' WHEN 'fr' THEN 'zzz' ELSE 'the' END AS q,
  strpos(lower(text), lower(CASE lang WHEN 'de' THEN 'UND' WHEN 'fr' THEN 'zzz' ELSE 'the' END)) AS pos FROM documents)""")
def b23(spark, d):
    phrase = F.expr("CASE lang WHEN 'de' THEN 'UND' WHEN 'fr' THEN 'zzz' ELSE 'the' END")
    return I.documents(spark, d).select("doc_id", tx.snippet(F.col("text"), phrase).alias("snippet"))


@query("B25_normalize_diagnostic", """SELECT conv_id, turn, CASE WHEN len(line) > 2000 THEN left(line, 1999) || chr(8230) ELSE line END AS line FROM (
  SELECT conv_id, turn, 'red ' || trim(regexp_replace(text || ' ' || text || ' ' || text, '\\s+', ' ', 'g')) || chr(65533) AS line FROM conversations)""")
def b25(spark, d):
    raw = F.concat(F.lit("\x1b[31mred\x1b[0m\n\t "), "text", F.lit(" "), "text", F.lit("  "), "text", F.lit("\x1b]0;t\x07\x00"))
    return I.table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_diagnostic(raw).alias("line"))


@query("B26_diagnostic_shaped", """SELECT conv_id, turn, NOT contains(trim(text, ' ' || chr(10)), chr(10)) AND trim(text, ' ' || chr(10)) <> '' AND role <> 'system'
  AS shaped FROM conversations""")
def b26(spark, d):
    raw = F.expr("CASE WHEN role = 'system' THEN '# ' ELSE '' END || text")
    return I.table(spark, d, "conversations").select("conv_id", "turn", tx.diagnostic_shaped(raw).alias("shaped"))
