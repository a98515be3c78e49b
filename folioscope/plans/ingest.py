"""Planning, digesting and recording of source files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import header as hd
from folioscope.functions import text as tx
from folioscope.operators import gates
from folioscope.operators.ledger import KEY, assign_pages, with_page_present, with_previous
from folioscope.operators.skew import lookup_join
from folioscope.session import written

# fixed values: report counters in display order, and the action behind each
BUCKETS = ["digested", "failed", "refused", "skipped", "deferred", "unchanged"]
BUCKET_OF = {
    "digested": "digested", "would-digest": "digested", "digest": "digested", "failed": "failed",
    "refused": "refused", "already-refused": "skipped", "exhausted": "skipped", "skipped": "skipped",
    "deferred": "deferred", "unchanged": "unchanged", "not-examined": "not_examined",
    "archived": "archived", "would-archive": "archived", "source-error": "source_errors",
}
RESULT = "source_path string, content_hash string, page_content string, error_class string, message string"
RESULT_ROWS = pa.schema([(x.split()[0], pa.string()) for x in RESULT.split(", ")])


def decide(rows: DataFrame, model: str) -> DataFrame:
    """``action`` and ``error`` of gated rows with their ledger row."""
    prev, same = F.col("prev_status"), F.col("prev_llm_model") == model
    tired = (prev == "failed") & (F.col("prev_attempts") >= gates.MAX_ATTEMPTS) & same
    action = (
        F.when(F.col("gate") != "pass", F.col("gate"))
        .when((prev == "success") & F.col("page_present"), "unchanged")
        .when((prev == "refused") & same, "already-refused")
        .when(tired, "exhausted")
        .otherwise("digest")
    )
    error = F.when(F.col("gate") != "pass", F.col("gate_error")).when(
        F.col("action").isin("already-refused", "exhausted"), F.col("prev_last_error")).otherwise("")
    return rows.withColumn("action", action).withColumn("error", error)


def apply_limit(rows: DataFrame, limit: int) -> DataFrame:
    """Digest the first ``limit`` candidates by path; later rows are not examined.

    The cut-off is the path of the last allowed candidate, found by a top-N, so
    no row order is imposed on the whole table.  Gated rows are never cut.
    """
    if limit <= 0:
        return rows
    first = rows.where(F.col("action") == "digest").select("source_path").orderBy("source_path").limit(limit).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max("source_path").alias("cut")).alias("first")).scalar()
    beyond = (F.col("gate") == "pass") & (first["n"] >= limit) & (F.col("source_path") > first["cut"])
    return rows.withColumn("action", F.when(beyond, "not-examined").otherwise(F.col("action"))).withColumn(
        "error", F.when(beyond, "").otherwise(F.col("error")))


def plan_ingest(
    sources: DataFrame, types: DataFrame, ledger: DataFrame, pages: DataFrame, model: str, now: Column,
    limit: int = 0, max_bytes: int = gates.MAX_FILE_BYTES,
) -> DataFrame:
    """One action per source file.

    ``sources`` has ``source_dir, source_path, size, mtime`` and either
    ``content_hash`` or ``content``; content is hashed only past the gates.
    """
    gated = gates.gate(sources, types, now, max_bytes)
    if "content_hash" not in sources.columns:
        gated = gated.withColumn(
            "content_hash", F.when(F.col("gate") == "pass", tx.content_hash(F.col("content"))))
    slim = gated.drop("content")
    known = with_page_present(with_previous(slim, ledger), pages)
    return apply_limit(decide(known, model), limit)


def count_buckets(actions: DataFrame) -> DataFrame:
    """One row of counters for ``(path, action)`` rows, and whether they add up."""
    bucket = F.create_map(*[F.lit(x) for pair in BUCKET_OF.items() for x in pair])[F.col("action")]
    per = actions.select(bucket.alias("bucket"))
    count = lambda name: F.count_if(F.col("bucket") == name).alias(name)
    names = BUCKETS + ["archived", "source_errors", "not_examined"]
    files = F.count_if(~F.col("bucket").isin("archived", "source_errors")).alias("scanned")
    return per.agg(files, *[count(n) for n in names])


def sum_check(report: DataFrame) -> DataFrame:
    total = sum((F.col(n) for n in [*BUCKETS, "not_examined"]), F.lit(0))
    return report.select("scanned", total.alias("total"), (total == F.col("scanned")).alias("ok"))


def run_report(actions: DataFrame) -> DataFrame:
    """The report as ``(section, sort_key, line)``: a summary, then a line per file.

    Unchanged and not examined files are counted but have no line.
    """
    counts = count_buckets(actions)
    shown = ["scanned", *BUCKETS, "archived", "source-errors"]
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n.replace("-", "_"))) for n in shown])
    text = F.concat(text, F.when(F.col("not_examined") > 0, F.concat(F.lit(" not-examined="), F.col("not_examined")))
                    .otherwise(F.lit("")))
    summary = counts.select(F.lit(0).alias("section"), F.lit("").alias("sort_key"), text.alias("line"))
    word = F.when(F.col("action") == "already-refused", "refused").otherwise(F.col("action"))
    listed = actions.where(~F.col("action").isin("unchanged", "not-examined")).withColumn("_word", word)
    width = listed.agg(F.coalesce(F.max(F.char_length("_word")), F.lit(0))).scalar()
    line = F.concat(F.lit("  "), F.rpad("_word", width, F.lit(" ")), F.lit("  "), F.col("path"),
                    F.when(F.col("error") != "", F.concat(F.lit("  "), F.col("error"))).otherwise(F.lit("")))
    return summary.unionByName(listed.select(F.lit(1).alias("section"), F.col("path").alias("sort_key"), line.alias("line")))


def as_text(content: Column, kind: str) -> Column:
    """File content as text; bytes that are none become replacement marks."""
    return F.make_valid_utf8(content.cast("string")) if kind == "binary" else content


def extract(rows: DataFrame) -> DataFrame:
    """The default digest, offline: a page with the opening sentence of every line of the whole text.

    Files without text fail for good.
    """
    text = as_text(F.col("content"), dict(rows.dtypes)["content"])
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    openings = F.array_join(F.transform(lines, lambda x: F.regexp_extract(x, r"\A[^.]*\.?", 0)), "\n")
    page = F.concat(
        F.lit("---\ntitle: "), "slug", F.lit("\ntype: source\nsource_path: "), "source_path",
        F.lit("\ncategory: article\n---\n\n# "), "slug", F.lit("\n\n"), openings, F.lit("\n"))
    blank = F.coalesce(tx.trim_space(text), F.lit("")) == ""
    return rows.select(
        *KEY, F.when(~blank, page).alias("page_content"), F.when(blank, "permanent").alias("error_class"),
        F.when(blank, "empty source").alias("message"))


def digest_sources(
    rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, batch: int = 32, schema_text: str = ""
) -> DataFrame:
    """Batched inference over planned rows ``(source_path, content_hash, content)``.

    ``fn`` takes up to ``batch`` rows with ``slug`` and ``prompt`` and returns
    ``page_content, error_class, message``; without it the pages are extracted by
    column expressions.  ``schema_text`` opens each prompt.  Store the result before using it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                # only the rows of a call are objects of Python
                part = rows.slice(at, batch).to_pandas()
                try:
                    out = fn(part).reset_index(drop=True)
                except Exception as exc:  # a failed call may be tried again later
                    out = pd.DataFrame({"page_content": [None] * len(part), "error_class": "transient",
                                        "message": str(exc)})
                made = pd.concat([part[["source_path", "content_hash"]], out], axis=1)
                yield pa.RecordBatch.from_pandas(made, schema=RESULT_ROWS, preserve_index=False)

    slug = tx.slug_for(F.col("source_path"), F.col("content_hash"))
    ready = rows.select("source_path", "content_hash", "content", slug.alias("slug"), tx.digest_prompt(
        F.lit(schema_text), F.col("source_path"), slug).alias("prompt"))
    return extract(ready) if fn is None else ready.mapInArrow(run, RESULT)


def outcomes(plan: DataFrame, results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned rows with ``ok``, the failure class and message, and the page name."""
    planned = plan.where(F.col("action") == "digest").select(
        *KEY, "source_dir", F.coalesce("prev_attempts", F.lit(0)).alias("prev_attempts"))
    read = hd.with_header(results.withColumn("content", F.coalesce("page_content", F.lit(""))))
    invalid = F.col("error_class").isNull() & ~hd.valid_page(F.col("header"))
    judged = read.select(
        *KEY, "page_content", F.col("header"),
        F.when(invalid, "permanent").otherwise(F.col("error_class")).alias("error_class"),
        F.when(invalid, "validate: page missing frontmatter or title")
        .otherwise(F.concat(F.lit("digest: "), F.col("message"))).alias("message"))
    # judged once, so that later filters meet stored columns
    rows = written(planned.join(judged, KEY), "judged")
    # names are chosen on the keys alone; the page text is moved once
    names = assign_pages(rows.where(F.col("error_class").isNull()).select(*KEY), ledger)
    return rows.join(names, KEY, "left").withColumn("wiki_page", F.coalesce("wiki_page", F.lit("")))


def ledger_rows(done: DataFrame, model: str, origin: str, now: Column) -> DataFrame:
    """New ledger rows of a run."""
    ok = F.col("error_class").isNull()
    attempts = F.when(ok, 0).otherwise(
        F.col("prev_attempts") + F.when(F.col("error_class") == "permanent", 1).otherwise(0))
    status = F.when(ok, "success").when(F.col("error_class") == "refused", "refused").otherwise("failed")
    return done.select(
        "source_path", "content_hash", "source_dir", now.alias("digested_at"), "wiki_page", status.alias("status"),
        attempts.cast("int").alias("attempts"), F.when(ok, "").otherwise(F.col("message")).alias("last_error"),
        F.lit(origin).alias("run_origin"), F.lit(model).alias("llm_model"))


def merge_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after a run: rows replaced by key, older successes superseded."""
    kept = ledger.join(new.select(*KEY), KEY, "left_anti")
    wins = new.where(F.col("status") == "success").select("source_path", F.lit(True).alias("_new"))
    aged = lookup_join(kept, wins, "source_path", "left")
    stale = (F.col("status") == "success") & F.coalesce("_new", F.lit(False))
    aged = aged.withColumn("status", F.when(stale, "superseded").otherwise(F.col("status")))
    return aged.select(*ledger.columns).unionByName(new.select(*ledger.columns))


def new_pages(done: DataFrame, now: Column) -> DataFrame:
    """Rows of the ``pages`` table for the successes of a run."""
    header = F.col("header")
    good = done.where(F.col("error_class").isNull())
    return good.select(
        F.col("wiki_page").alias("path"),
        header["title_text"].alias("title"),
        F.coalesce(header["type"], F.lit("")).alias("type"),
        tx.normalize_category(header["category"]).alias("category"),
        F.when(F.coalesce(header["tag_text"], F.lit("")) == "", F.array().cast("array<string>"))
        .otherwise(F.split(header["tag_text"], ",")).alias("tags"),
        F.col("page_content").alias("content"),
        tx.content_hash(F.col("page_content")).alias("content_hash"),
        F.octet_length("page_content").cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mtime"),
        now.alias("indexed_at"))


def apply_outcomes(
    plan: DataFrame, results: DataFrame, ledger: DataFrame, model: str, origin: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``(ledger, page_rows)`` after the results of a run."""
    done = written(outcomes(plan, results, ledger), "outcomes")
    return merge_ledger(ledger, ledger_rows(done, model, origin, now)), new_pages(done, now)


def result_actions(plan: DataFrame, done: DataFrame) -> DataFrame:
    """``(path, action, error)`` of a finished run."""
    rest = plan.where(F.col("action") != "digest").select(F.col("source_path").alias("path"), "action", "error")
    status = F.when(F.col("error_class").isNull(), "digested").when(
        F.col("error_class") == "refused", "refused").otherwise("failed")
    ran = done.select(F.col("source_path").alias("path"), status.alias("action"),
                      F.coalesce("message", F.lit("")).alias("error"))
    return rest.unionByName(ran)


def sweep_orphans(
    ledger: DataFrame, dirs: DataFrame, snapshot: DataFrame, pages: DataFrame, dry_run: bool = False
) -> DataFrame:
    """Archive the one page of a folder whose single missing file is clear.

    ``dirs`` has ``source_dir, state`` (``ok``, ``missing``, ``error``);
    ``snapshot`` lists the files found.  A folder is acted on when exactly one
    success row is missing and at least one is still there.  Counts are partial
    aggregates, so a folder with very many files is no burden.
    """
    configured = dirs.dropDuplicates(["source_dir"])
    wins = ledger.where(F.col("status") == "success")
    there = snapshot.select("source_path", F.lit(True).alias("_there")).distinct()
    rows = wins.join(there, "source_path", "left")
    gone = F.col("_there").isNull()
    per_dir = rows.groupBy("source_dir").agg(
        F.count_if(~gone).alias("survivors"), F.count_if(gone).alias("missing"),
        F.min(F.when(gone, F.struct("source_path", "content_hash", "wiki_page"))).alias("_row"))
    known = per_dir.join(configured, "source_dir")
    one = known.where((F.col("state") == "ok") & (F.col("survivors") >= 1) & (F.col("missing") == 1)).select(
        "source_dir", "_row.*")
    target = tx.archived_path(F.col("wiki_page"), F.col("content_hash"))
    taken = pages.select(F.col("path").alias("archived_page"))
    # a page that is gone cannot collide: only its ledger row changes
    have = pages.select(F.col("path").alias("wiki_page"), F.lit(True).alias("page_present"))
    moves = one.withColumn("archived_page", target).join(have, "wiki_page", "left").withColumn(
        "page_present", F.coalesce("page_present", F.lit(False)))
    blocked = moves.where("page_present").join(taken, "archived_page", "left_semi").select("archived_page", "source_path")
    done = moves.join(blocked, ["archived_page", "source_path"], "left_anti").select(
        "source_dir", F.col("source_path").alias("path"), "content_hash", "wiki_page", "archived_page",
        F.lit("would-archive" if dry_run else "archived").alias("action"))
    errors = known.where(F.col("state") == "error").select(
        "source_dir", F.col("source_dir").alias("path"), F.lit("").alias("content_hash"), F.lit("").alias("wiki_page"),
        F.lit("").alias("archived_page"), F.lit("source-error").alias("action"))
    return done.unionByName(errors)


def folder_decision(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``(source_dir, survivors, missing, act)`` per folder."""
    there = snapshot.select("source_path", F.lit(True).alias("_there")).distinct()
    gone = F.col("_there").isNull()
    return (
        ledger.where(F.col("status") == "success").join(there, "source_path", "left").groupBy("source_dir")
        .agg(F.count_if(~gone).alias("survivors"), F.count_if(gone).alias("missing"))
        .withColumn("act", (F.col("survivors") >= 1) & (F.col("missing") == 1)))


def after_sweep(ledger: DataFrame, pages: DataFrame, sweep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ledger, pages)`` once the archived pages are moved."""
    acted = sweep.where(F.col("action") == "archived")
    marks = acted.select(F.col("path").alias("source_path"), "content_hash", F.lit(True).alias("_swept"))
    new_ledger = ledger.join(marks, KEY, "left").withColumn(
        "status", F.when(F.col("_swept"), "superseded").otherwise(F.col("status"))).select(*ledger.columns)
    moved = acted.select(F.col("wiki_page").alias("path"), "archived_page").groupBy("path").agg(
        F.min("archived_page").alias("archived_page"))
    new_pages_ = pages.join(moved, "path", "left").withColumn(
        "path", F.coalesce("archived_page", "path")).select(*pages.columns)
    return new_ledger, new_pages_

