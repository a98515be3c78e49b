"""Joins, counts, first-or-last selections and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.catalog import inputs as I
from folioscope.catalog.files_and_pages import FOLDERS as PAGE_FOLDERS
from folioscope.catalog.files_and_pages import GATED, gated, now
from folioscope.catalog.inputs import with_
from folioscope.catalog.registry import query
from folioscope.functions import paths as pt
from folioscope.functions import text as tx
from folioscope.operators import changes as ch
from folioscope.operators import ledger as lg_
from folioscope.operators import linkgraph as lg
from folioscope.operators import linkindex as li
from folioscope.operators.parse import index_rows, link_rows, parse_pages, tag_rows
from folioscope.operators.search import corpus_stats, search_text
from folioscope.operators.vectors import count_by_model, stale_pages
from folioscope.plans import corpus, embed, ingest, responses
from folioscope.session import work_dir, written
from folioscope.sources import files

FULL = with_("pages_", "parsed", "links", "tags", "resolved")


def stored_parse(spark, d) -> DataFrame:
    """Parsed pages, written once: several steps read their small columns."""
    return written(parse_pages(I.pages(spark, d)).select("path", "title", "type", "header", "links", "tags"), "parsed")


def small(parsed) -> DataFrame:
    return parsed.select("path", "title", "type")


# --- joins -----------------------------------------------------------------

PREV = """SELECT s.source_path, s.content_hash, l.status, l.attempts, l.wiki_page FROM sources s
  LEFT JOIN ledger l ON l.source_path = s.source_path AND l.content_hash = s.content_hash"""


@query("C1_ledger_lookup", with_("sources", "ledger") + PREV)
def c1(spark, d):
    rows = lg_.with_previous(I.sources(spark, d).select("source_path", "content_hash"), I.ledger(spark, d))
    return rows.select("source_path", "content_hash", F.col("prev_status").alias("status"),
                       F.col("prev_attempts").alias("attempts"), F.col("prev_wiki_page").alias("wiki_page"))


@query("C2_page_present", with_("pages_", "sources", "ledger") + """SELECT source_path, content_hash, wiki_page, p.path IS NOT NULL AS present
  FROM ledger l LEFT JOIN pages_ p ON p.path = l.wiki_page WHERE status = 'success'""")
def c2(spark, d):
    wins = I.ledger(spark, d).where("status = 'success'").select("source_path", "content_hash", "wiki_page")
    return lg_.with_page_present(wins, I.pages(spark, d), "wiki_page").withColumnRenamed("page_present", "present")


@query("C3_text_with_metadata", with_("pages_", "parsed") + """SELECT path, title, type, sha256(content) AS content_hash FROM parsed
  WHERE contains(lower(content), 'stat')""")
def c3(spark, d):
    pages = I.pages(spark, d).where(F.contains(F.lower("content"), F.lit("stat")))
    return parse_pages(pages).select("path", "title", "type", tx.content_hash(F.col("content")).alias("content_hash"))


@query("C4_stale_embeddings", with_("pages_", "vectors") + """SELECT p.path, sha256(p.content) AS content_hash FROM pages_ p
  LEFT JOIN vectors v ON v.path = p.path AND v.model = 'm1' WHERE v.path IS NULL OR v.content_hash <> sha256(p.content)""")
def c4(spark, d):
    pages = I.pages(spark, d).select("path", tx.content_hash(F.col("content")).alias("content_hash"))
    return stale_pages(pages, I.vectors(spark, d), I.MODEL)


# the index state: some sizes differ, French pages are unknown, some old pages are gone
INDEXED = """SELECT CASE WHEN source = 'src4' THEN 'gone/' || path ELSE path END AS path,
  CASE WHEN source = 'src5' THEN size + 1 ELSE size END AS size, mtime FROM {pages} WHERE lang <> 'fr'"""
CHANGES = f"""SELECT coalesce(s.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed'
  WHEN s.size = i.size AND s.mtime = i.mtime THEN 'unchanged' ELSE 'updated' END AS change
  FROM pages_ s FULL OUTER JOIN ({INDEXED.format(pages='pages_')}) i ON i.path = s.path"""


def indexed(spark, d):
    return spark.sql(INDEXED, pages=I.pages(spark, d))


def change_rows(spark, d):
    return ch.change_class(I.pages(spark, d).select("path", "size", "mtime"), indexed(spark, d))


@query("C5_consistency_diff", with_("pages_") + CHANGES)
def c5(spark, d):
    return change_rows(spark, d)


@query("C6_link_resolution", FULL + "SELECT link, target FROM resolved")
def c6(spark, d):
    parsed = stored_parse(spark, d)
    return lg.resolve_names(link_rows(parsed).select("link").distinct(), small(parsed))


BROKEN = """SELECT l.path, l.link FROM links l LEFT JOIN resolved r USING (link) WHERE NOT l.embed AND r.link IS NULL"""
ORPHANS = """SELECT path FROM parsed WHERE path NOT IN ('_schema.md', '_index.md') AND type <> 'source'
  AND path NOT IN (SELECT target FROM resolved)"""


@query("C7_broken_links", FULL + BROKEN)
def c7(spark, d):
    parsed = stored_parse(spark, d)
    return lg.broken_links(link_rows(parsed), small(parsed))


@query("C8_orphan_pages", FULL + ORPHANS)
def c8(spark, d):
    parsed = stored_parse(spark, d)
    return lg.orphan_pages(link_rows(parsed), small(parsed))


_LINKS: dict[tuple[str, str], li.LinkIndex] = {}


def kept_links(spark, d):
    """Links of an older corpus, brought up to date by a batch of changes: pages are new, gone, or link elsewhere; stored once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key in _LINKS and _LINKS[key].versions():
        return _LINKS[key]
    now_ = written(parse_pages(I.pages(spark, d)).select("path", "type", "links"), "linked")
    kind = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(8))
    other = F.array(F.lit("Topic of old"), F.concat(F.lit("doc-"), F.length("path").cast("string")))
    older = now_.where(kind > 0).withColumn("links", F.when(kind == 1, other).otherwise(F.col("links")))
    gone = now_.where(kind == 2).select(F.concat(F.lit("gone/Copy-"), pt.base_name(F.col("path"))).alias("path"), "type", "links")
    shadow = now_.where(kind == 3).select(F.concat(F.lit("aside/"), pt.base_name(F.col("path"))).alias("path"), "type", "links")
    index = li.LinkIndex(spark, f"{work_dir(spark)}/links", 16)
    upsert, delete = F.lit("upsert").alias("op"), F.lit("delete").alias("op")
    index.apply(older.unionByName(gone).unionByName(shadow).select("*", upsert), 0)
    index.apply(now_.where(kind < 2).select("*", upsert).unionByName(gone.unionByName(shadow).select("*", delete)), 1)
    _LINKS[key] = index
    return index


@query("C6_kept_resolution", FULL + "SELECT link, target FROM resolved WHERE target IS NOT NULL")
def c6_kept(spark, d):
    """Resolution after a batch of changes, of the texts there are."""
    index = kept_links(spark, d)
    return index.resolved().join(index.links().select("link").distinct(), "link", "left_semi")


@query("C7_kept_broken_links", FULL + BROKEN)
def c7_kept(spark, d):
    return kept_links(spark, d).broken()


@query("C8_kept_orphans", FULL + ORPHANS)
def c8_kept(spark, d):
    return kept_links(spark, d).orphans()


SNAPSHOT = """SELECT source_dir, source_path FROM {sources} WHERE lang <> 'es' AND source_path NOT LIKE '%0.txt'"""


def snapshot(spark, d):
    return spark.sql(SNAPSHOT, sources=I.sources(spark, d))


@query("C9_deleted_sources", with_("sources", "ledger") + f"""SELECT source_path, content_hash FROM ledger WHERE status = 'success'
  AND source_path NOT IN (SELECT source_path FROM ({SNAPSHOT.format(sources='sources')}))""")
def c9(spark, d):
    return lg_.missing_sources(I.ledger(spark, d), snapshot(spark, d)).select("source_path", "content_hash")


@query("C10_page_collision", with_("sources", "ledger") + """SELECT source_path, base, EXISTS (SELECT 1 FROM ledger l
    WHERE l.wiki_page = base AND l.source_path <> s.source_path) AS taken
  FROM (SELECT source_path, 'sources/doc-' || doc_id || '.md' AS base FROM sources) s""")
def c10(spark, d):
    slug = tx.slug_for(F.col("source_path"), F.col("content_hash"))
    rows = I.sources(spark, d).select("source_path", F.concat(F.lit("sources/"), slug, F.lit(".md")).alias("base"))
    return lg_.taken_by_other(rows, I.ledger(spark, d), "base")


CONCEPTS = """SELECT slug, kind, name, n_pages FROM (
    SELECT *, row_number() OVER (PARTITION BY slug ORDER BY o, name) AS rn FROM (
      SELECT 'concepts/' || lower(replace(link, ' ', '-')) || '.md' AS slug, 0 AS o, 'link' AS kind, link AS name, count(*) AS n_pages
      FROM links WHERE NOT embed GROUP BY link HAVING count(*) >= 2
      UNION ALL SELECT 'concepts/tag-' || lower(replace(tag, '/', '-')) || '.md', 1, 'tag', tag, count(*) FROM tags GROUP BY tag HAVING count(*) >= 2))
  WHERE rn = 1 AND slug NOT IN (SELECT path FROM parsed)"""


@query("C11_new_concepts", FULL + CONCEPTS)
def c11(spark, d):
    parsed = stored_parse(spark, d)
    return corpus.new_concepts(link_rows(parsed), tag_rows(parsed), parsed.select("path"))


@query("C12_title_enrichment", FULL + "SELECT path, coalesce(nullif(title, ''), path) AS title FROM parsed")
def c12(spark, d):
    return parse_pages(I.pages(spark, d)).select("path", lg.display_title().alias("title"))


@query("C13_vector_candidates", with_("pages_", "vectors") + """SELECT v.path, v.dims FROM vectors v JOIN pages_ p ON p.path = v.path
  WHERE v.model = 'm1'""")
def c13(spark, d):
    from folioscope.operators.vectors import live_vectors

    return live_vectors(I.vectors(spark, d), I.pages(spark, d), I.MODEL).select("path", F.size("vector").alias("dims"))


# --- counts ----------------------------------------------------------------

# the decision chain for every source file, written out in SQL
PLAN = f"""SELECT g.source_path, g.content_hash, g.source_dir, coalesce(l.attempts, 0) AS prev_attempts, CASE WHEN gate <> 'pass' THEN gate
    WHEN l.status = 'success' AND p.path IS NOT NULL THEN 'unchanged' WHEN l.status = 'refused' AND l.llm_model = 'm1' THEN 'already-refused'
    WHEN l.status = 'failed' AND l.attempts >= 3 AND l.llm_model = 'm1' THEN 'exhausted' ELSE 'digest' END AS action,
    CASE WHEN gate <> 'pass' THEN gate_error WHEN l.status = 'success' THEN '' WHEN l.llm_model = 'm1' AND (l.status = 'refused'
      OR l.status = 'failed' AND l.attempts >= 3) THEN l.last_error ELSE '' END AS error
  FROM ({GATED}) g LEFT JOIN ledger l ON l.source_path = g.source_path AND l.content_hash = g.content_hash
  LEFT JOIN pages_ p ON p.path = l.wiki_page"""
PLAN_IN = with_("pages_", "sources", "ledger")
BUCKET = """CASE action WHEN 'digest' THEN 'digested' WHEN 'already-refused' THEN 'skipped' WHEN 'exhausted' THEN 'skipped'
  WHEN 'not-examined' THEN 'not_examined' ELSE action END"""


def plan(spark, d, limit=0):
    return ingest.plan_ingest(I.sources(spark, d).drop("text"), I.types(spark, d), I.ledger(spark, d), I.pages(spark, d),
                              I.MODEL, now(), limit, I.MAX_BYTES)


def planned_actions(spark, d, limit=0):
    """A dry run: what would be digested counts as digested."""
    action = F.when(F.col("action") == "digest", "would-digest").otherwise(F.col("action"))
    return plan(spark, d, limit).select(F.col("source_path").alias("path"), action.alias("action"), "error")


COUNTS = ["digested", "failed", "refused", "skipped", "deferred", "unchanged", "archived", "source_errors", "not_examined"]


@query("D1_run_report_counts", PLAN_IN + f"SELECT count(*) AS scanned, " + ", ".join(
    f"count(*) FILTER (WHERE b = '{c}') AS {c}" for c in COUNTS) + f" FROM (SELECT {BUCKET} AS b FROM ({PLAN}))")
def d1(spark, d):
    return ingest.count_buckets(planned_actions(spark, d))


@query("D2_sum_invariant", PLAN_IN + f"SELECT count(*) AS scanned, count(b) AS total, count(*) = count(b) AS ok FROM (SELECT {BUCKET} AS b FROM ({PLAN}))")
def d2(spark, d):
    return ingest.sum_check(ingest.count_buckets(planned_actions(spark, d)))


def shared_sql(rows: str, name: str) -> str:
    return FULL + f"""SELECT {name}, path, n AS n_pages FROM (SELECT {name}, path, count(*) OVER (PARTITION BY {name}) AS n FROM {rows}) WHERE n >= 2"""


@query("D3_link_index", shared_sql("links WHERE NOT embed", "link"))
def d3(spark, d):
    return lg.shared_names(link_rows(stored_parse(spark, d)), "link")


@query("D4_tag_index", shared_sql("tags", "tag"))
def d4(spark, d):
    return lg.shared_names(tag_rows(stored_parse(spark, d)), "tag")


FOLDERS = f"""SELECT source_dir, count(s.source_path) AS survivors, count(*) - count(s.source_path) AS missing,
    count(s.source_path) >= 1 AND count(*) - count(s.source_path) = 1 AS act
  FROM ledger l LEFT JOIN (SELECT source_path FROM ({SNAPSHOT.format(sources='sources')})) s USING (source_path)
  WHERE status = 'success' GROUP BY source_dir"""


@query("D5_sweep_decision", with_("sources", "ledger") + FOLDERS)
def d5(spark, d):
    return ingest.folder_decision(I.ledger(spark, d), snapshot(spark, d))


LENGTHS = """SELECT path, greatest(len(path) - 2, 0) + greatest(len(title) - 2, 0) + greatest(len(content) - 2, 0)
  + greatest(len(coalesce(t.tags, '')) - 2, 0) AS doc_len FROM parsed LEFT JOIN (SELECT path, string_agg(tag, ',') AS tags FROM tags GROUP BY path) t USING (path)"""


@query("D6_corpus_statistics", FULL + f"SELECT count(*) AS n_docs, round(avg(doc_len), 6) AS avg_len FROM ({LENGTHS})")
def d6(spark, d):
    stats = corpus_stats(search_text(parse_pages(I.pages(spark, d))))
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("D7_embeddings_by_model", with_("pages_", "vectors") + "SELECT model, count(*) AS n FROM vectors GROUP BY model")
def d7(spark, d):
    return count_by_model(I.vectors(spark, d))


@query("D8_embed_outcomes", with_("pages_", "vectors") + """SELECT count(*) AS embedded, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed,
  count(*) AS total FROM pages_ p LEFT JOIN vectors v ON v.path = p.path AND v.model = 'm1' WHERE v.path IS NULL OR v.content_hash <> sha256(p.content)""")
def d8(spark, d):
    pages = I.pages(spark, d).withColumn("content_hash", tx.content_hash(F.col("content")))
    return embed.outcome_counts(embed.embed_stale(pages, I.vectors(spark, d), I.MODEL))


ISSUES = f"""SELECT path, 'broken-link' AS kind, '[[' || link || ']] not found' AS message FROM ({BROKEN})
  UNION ALL SELECT path, 'orphan', 'no incoming links' FROM ({ORPHANS})
  UNION ALL SELECT path, 'frontmatter', 'missing type field' FROM parsed WHERE path <> '_schema.md' AND NOT regexp_matches(header, '(?m)^type: ')
  UNION ALL SELECT path, 'frontmatter', 'source page missing source_path' FROM parsed WHERE type = 'source' AND NOT regexp_matches(header, '(?m)^source_path: ')
  UNION ALL SELECT path, 'frontmatter', 'source page missing ingested_at' FROM parsed WHERE type = 'source' AND NOT regexp_matches(header, '(?m)^ingested_at: ')"""


@query("D9_lint_summary", FULL + f"SELECT coalesce(kind, 'total') AS kind, count(*) AS n, count(*) > 0 AS failed FROM ({ISSUES}) GROUP BY ROLLUP (kind)")
def d9(spark, d):
    return corpus.lint_summary(corpus.lint(stored_parse(spark, d)))


@query("D10_index_counts", FULL + """SELECT count(*) AS n_pages, count(*) FILTER (WHERE path LIKE 'sources/%' AND (1709251200 - epoch(indexed_at)) < 604800) AS n_recent
  FROM parsed WHERE path NOT IN ('_schema.md', '_index.md')""")
def d10(spark, d):
    recent = F.col("path").startswith("sources/") & ((F.unix_micros(now()) - F.unix_micros("indexed_at")) < 7 * 86_400_000_000)
    return I.pages(spark, d).where(~F.col("path").isin("_schema.md", "_index.md")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(recent).alias("n_recent"))


LISTED = """SELECT 'index' AS listing, path, title FROM parsed WHERE path NOT IN ('_schema.md', '_index.md')
  UNION ALL SELECT 'digest', path, title FROM parsed WHERE path LIKE 'sources/%' AND (1709251200 - epoch(indexed_at)) < 604800"""


def listings(spark, d):
    pages = index_rows(I.pages(spark, d)).select("path", "title", "indexed_at")
    return corpus.listings(pages, now())


@query("D10_listing_counts", FULL + f"SELECT listing, count(*) AS n FROM ({LISTED}) GROUP BY listing")
def d10_counts(spark, d):
    return listings(spark, d)[0]


@query("D10_listing_members", FULL + f"SELECT listing, row_number() OVER (PARTITION BY listing ORDER BY path) AS nth, path, title FROM ({LISTED})")
def d10_members(spark, d):
    """Members of the index and of the summary, in order."""
    return listings(spark, d)[1]


@query("D11_consistency_counts", with_("pages_") + f"""SELECT count(*) FILTER (WHERE change = 'added') AS added,
  count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'updated') AS updated FROM ({CHANGES})""")
def d11(spark, d):
    return ch.change_counts(change_rows(spark, d))


@query("D12_ledger_status", with_("sources", "ledger") + """SELECT status, run_origin, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM ledger), 6) AS share FROM ledger GROUP BY status, run_origin""")
def d12(spark, d):
    return lg_.status_report(I.ledger(spark, d)).withColumn("share", F.round("share", 6))


# --- first, last and limits ------------------------------------------------

LIMIT = 25
LIMITED = f"""SELECT source_path, CASE WHEN gate_pass AND before >= {LIMIT} THEN 'not-examined' ELSE action END AS action FROM (
  SELECT *, coalesce(sum(CASE WHEN action = 'digest' THEN 1 ELSE 0 END) OVER (ORDER BY source_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, action NOT IN ('skipped', 'deferred') AS gate_pass FROM ({PLAN})))"""


@query("E1_apply_limit", PLAN_IN + LIMITED)
def e1(spark, d):
    return plan(spark, d, LIMIT).select("source_path", "action")


@query("E2_latest_per_key", """SELECT conv_id, role, turn, sha256(text) AS text_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def e2(spark, d):
    rows = I.table(spark, d, "conversations").select("conv_id", "role", "turn", tx.content_hash(F.col("text")).alias("text_hash"))
    return ch.latest_per_key(rows, ["conv_id", "role"], "turn")


@query("E2_ledger_upsert", with_("sources", "ledger") + """SELECT source_path, content_hash, status, attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path, content_hash ORDER BY seq DESC) AS rn FROM (
    SELECT source_path, content_hash, status, attempts, 0 AS seq FROM ledger
    UNION ALL SELECT source_path, content_hash, 'failed', 9, 1 FROM sources)) WHERE rn = 1""")
def e2b(spark, d):
    old = I.ledger(spark, d).select("source_path", "content_hash", "status", "attempts", F.lit(0).alias("seq"))
    new = I.sources(spark, d).select("source_path", "content_hash", F.lit("failed").alias("status"),
                                     F.lit(9).alias("attempts"), F.lit(1).alias("seq"))
    return lg_.upserted(old.unionByName(new)).drop("seq")


@query("E3_supersede", with_("sources", "ledger") + """SELECT source_path, content_hash, CASE WHEN status = 'success' AND row_number() OVER (
    PARTITION BY source_path, status ORDER BY digested_at DESC, content_hash DESC) > 1 THEN 'superseded' ELSE status END AS status FROM ledger""")
def e3(spark, d):
    return lg_.superseded(I.ledger(spark, d)).select("source_path", "content_hash", "status")


ASSIGNED = """SELECT source_path, content_hash, CASE WHEN source_path = min(CASE WHEN NOT taken THEN source_path END) OVER (PARTITION BY base)
    THEN base ELSE replace(base, '.md', '-' || left(sha256(source_path), 8) || '.md') END AS wiki_page FROM (
  SELECT source_path, content_hash, base, EXISTS (SELECT 1 FROM ledger l WHERE l.wiki_page = base AND l.source_path <> s.source_path) AS taken FROM s)"""


@query("E4_slug_winner", with_("sources", "ledger") + f""", s AS (SELECT source_path, content_hash,
  'sources/' || source || '.md' AS base FROM (SELECT '/x/' || lang || '/' || doc_id || '/' || source || '.txt' AS source_path, content_hash, source FROM sources)) {ASSIGNED}""")
def e4(spark, d):
    """Many sources want one page name: the file name is the source's alone."""
    rows = I.sources(spark, d).select(
        F.concat(F.lit("/x/"), "lang", F.lit("/"), "doc_id", F.lit("/"), "source", F.lit(".txt")).alias("source_path"), "content_hash")
    return lg_.assign_pages(rows, I.ledger(spark, d))


@query("E5_first_concept_slug", FULL + f"SELECT slug, name FROM ({CONCEPTS})")
def e5(spark, d):
    parsed = stored_parse(spark, d)
    return corpus.new_concepts(link_rows(parsed), tag_rows(parsed), parsed.select("path")).select("slug", "name")


@query("E6_last_result_event", """SELECT conv_id, turn, sha256(text || '!') AS result_hash FROM conversations""")
def e6(spark, d):
    event = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("result"))
    text = F.col("text")
    raw = F.to_json(F.array(event("result", text), event("result", F.concat(text, F.lit("!"))), event("system", text)))
    return I.table(spark, d, "conversations").select(
        "conv_id", "turn", tx.content_hash(responses.last_result(raw)["result"]).alias("result_hash"))


# --- set operations --------------------------------------------------------

@query("H1_union_of_folders", with_("pages_") + "SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM pages_ WHERE contains(path, '/') GROUP BY 1")
def h1(spark, d):
    """The union of one scan for each folder."""
    root = work_dir(spark)
    files.write_pages(I.pages(spark, d), root)
    scans = [files.scan_sources(spark, [f"{root}/{f}"]) for f in PAGE_FOLDERS]
    whole = functools.reduce(lambda a, b: a.unionByName(b), scans)
    folder = F.substring(F.col("source_dir"), len(root) + 2, 1000)
    return whole.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("H2_union_of_issues", FULL + f"""SELECT path, kind, message FROM ({ISSUES})
    UNION ALL SELECT path, 'parse', 'read: denied' FROM pages_ WHERE doc_id % 97 = 0""")
def h2(spark, d):
    """Every issue of all four kinds, pages that could not be read among them."""
    errors = I.pages(spark, d).where("doc_id % 97 = 0").select("path", F.lit("read: denied").alias("message"))
    return corpus.lint(stored_parse(spark, d), errors)


@query("H3_removed_pages", with_("pages_") + f"""SELECT path FROM ({INDEXED.format(pages='pages_')}) EXCEPT SELECT path FROM pages_""")
def h3(spark, d):
    return change_rows(spark, d).where(F.col("change") == "removed").select("path")


@query("H4_distinct_folders", "SELECT DISTINCT '/in/' || source AS source_dir FROM documents")
def h4(spark, d):
    return I.sources(spark, d).select("source_dir").dropDuplicates()


@query("H5_distinct_links", FULL + "SELECT path, count(*) AS n FROM links WHERE NOT embed GROUP BY path")
def h5(spark, d):
    return link_rows(stored_parse(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
