"""Joins, skew handling, search, vectors, changes and jobs on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import changes as ch
from folioscope.operators import ledger as lg_
from folioscope.operators import linkgraph as lg
from folioscope.operators import search as se
from folioscope.operators import vectors as ve
from folioscope.operators.assemble import assemble
from folioscope.operators.parse import link_rows, parse_pages
from folioscope.operators.skew import lookup_join
from folioscope.plans import corpus, ingest, responses
from folioscope.plans.embed import embed_pages
from folioscope.sources import files
from folioscope.sources.web import _head_bytes, url_slug
from folioscope.streaming import ingest as si

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(spark):
    return F.lit(NOW).cast("timestamp")


def same(a, b):
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_any_other(spark, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k49", 4)], "key string, v int")
    spread = lookup_join(facts, lookup, "key", how, rows_per_share=100)
    same(spread.select("id", "key", "v"), facts.join(lookup, "key", how).select("id", "key", "v"))
    assert "_share" in spread._jdf.queryExecution().analyzed().toString()


def pages_df(spark, rows):
    return spark.createDataFrame([(*r, "", "") for r in rows], "path string, title string, content string, tags string, type string, category string")


PHRASES = ["aa", "the cat", "cat", "aaa", "abab", "ümlaut", "😀 b", "needle in", "zzz", "AND OR", "(x|y)", "t, t", "tag"]


def corpus_rows():
    rng = np.random.default_rng(3)
    words = ["the", "cat", "aaaa", "ababab", "Ümlaut", "a😀", "b", "needle", "in", "and or", "(x|y)*", "zz"]
    return [(f"p{i}.md", f"title {words[i % 12]}", " ".join(rng.choice(words, 30)), "tag,t, t") for i in range(60)]


def brute(rows, phrases, k):
    """BM25 by definition, position by position."""
    docs = [[c.lower() for c in (r[0], r[1], r[2], r[3])] for r in rows]
    lens = [sum(max(len(c) - 2, 0) for c in d) for d in docs]
    avg, out = sum(lens) / len(lens), []
    for q in phrases:
        p = q.lower()
        if len(q) < 3:
            continue
        tf = [sum(c.startswith(p, i) for c in d for i in range(len(c))) for d in docs]
        n = sum(t > 0 for t in tf)
        idf = max(np.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6) if n else 0
        scored = [(-idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * ln / avg)), rows[i][0]) for i, (t, ln) in enumerate(zip(tf, lens)) if t]
        out += [(q, r + 1, path, round(-s, 6)) for r, (s, path) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("way", ["scan", "sent", "index"])
def test_search_ways_equal_brute_force(spark, monkeypatch, way):
    rows = corpus_rows()
    pages = pages_df(spark, rows)
    queries = spark.createDataFrame([(p, p) for p in PHRASES], "query_id string, query string")
    postings = None
    if way == "sent":
        monkeypatch.setattr(se, "SCAN_PHRASES", 0)
    if way == "index":
        postings = se.build_postings(se.search_text(pages))
    got = se.phrase_search(pages, queries, 5, postings)
    got = sorted((r["query_id"], r["rank"], r["path"], round(r["score"], 6)) for r in got.collect())
    assert got == brute(rows, PHRASES, 5)


def test_search_rules(spark):
    pages = pages_df(spark, [(f"n/{i:02}.md", "", "common searchable content", "") for i in range(15)]
                     + [("kr.md", "", "한국어 테스트입니다", ""), ("im.md", "", "contains Important Information here", "")])

    def run(text, k=10):
        return se.search(pages, spark.createDataFrame([("q", text)], "query_id string, query string"), k).collect()

    assert len(run("searchable", 0)) == 10 and len(run("searchable", 200)) == 15
    assert run("   ") == [] and run("") == [] and run("\t\n") == []
    assert [r["path"] for r in run("한국")] == ["kr.md"]
    hit = run("im")
    assert [r["path"] for r in hit] == ["im.md"] and hit[0]["snippet"] and hit[0]["score"] == 0.0
    assert run("OR NOT") == [] and run('"quoted"') == []
    assert all(r["score"] > 0 for r in run("searchable"))


def test_similar_by_text_shares_equal_titles(spark):
    pages = pages_df(spark, [(f"{i}.md", "Untitled", "body", "") for i in range(8)] + [("x.md", "ab", "one two", "")])
    got = se.similar_by_text(pages, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_path"], []).append(r["path"])
    assert all(len(v) == 3 and q not in v for q, v in by.items() if q != "x.md")
    assert by["0.md"] == ["1.md", "2.md", "3.md"]


def test_nearest_both_ways(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03}", [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [("short", [1.0, 2.0])]
    corpus_ = spark.createDataFrame(rows, "path string, vector array<float>")
    queries = corpus_.select(F.col("path").alias("query_path"), F.col("vector").alias("query_vector"))
    key = lambda df: sorted((r["query_path"], r["rank"], r["path"], round(r["score"], 5)) for r in df.collect())
    assert key(ve.nearest(queries, corpus_, 4)) == key(ve.nearest(queries, corpus_, 4, query_block=10))
    assert all(r["score"] == 0 for r in ve.nearest(queries.where("query_path = 'short'"), corpus_, 3).collect())


def test_nearest_page(spark):
    e = spark.createDataFrame([("A", [.9, .1, 0.]), ("B", [.85, .15, .05]), ("C", [.1, .1, .95])], "path string, vector array<float>")
    e = e.select("path", ve.l2_normalize(F.col("vector")).alias("vector"))
    q = e.where("path = 'A'").select(F.col("path").alias("query_path"), F.col("vector").alias("query_vector"))
    assert ve.nearest(q, e, 1).first()["path"] == "B"


def test_long_lists_keep_their_order(spark):
    lines = spark.range(57).select(F.lit("big.md").alias("path"), F.format_string("%03d", "id").alias("sort_key"),
                                   F.format_string("- %03d\n", "id").alias("line"))
    lines = lines.unionByName(spark.createDataFrame([("small.md", "b", "B"), ("small.md", "a", "A")], "path string, sort_key string, line string"))
    heads = spark.createDataFrame([("big.md", "H\n"), ("small.md", "h:"), ("none.md", "x")], "path string, head string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = [("big.md", n, ("H\n" if n == 0 else "") + "".join(f"- {i:03}\n" for i in range(5 * n, min(5 * n + 5, 57)))) for n in range(12)] + [("small.md", 0, "h:AB")]
    for tasks in ("1", "4", "64"):  # parts depend on the order alone
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        rows = assemble(heads, lines.repartition(4), lines_per_part=5).orderBy("path", "part").collect()
        assert [tuple(r) for r in rows] == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lint_wikis(spark):
    def issues(**pages):
        df = spark.createDataFrame([(f"{k}.md", f"---\ntitle: {k}\ntype: note\n---\n{v}") for k, v in pages.items()], "path string, content string")
        return sorted((r["path"], r["kind"]) for r in corpus.lint(parse_pages(df)).collect())

    assert issues(A="[[nowhere]]") == [("A.md", "broken-link"), ("A.md", "orphan")]
    assert issues(a="[[B]]", b="[[a]]") == []


def test_resolution_order(spark):
    pages = spark.createDataFrame([("x.md",), ("sources/x.md",), ("sources/y.md",), ("deep/Zed.md",), ("a/zed.md",)], "path string")
    names = spark.createDataFrame([("x",), ("y",), ("ZED",), ("x.md",), ("none",)], "link string")
    got = {r["link"]: r["target"] for r in lg.resolve_names(names, pages).collect()}
    assert got == {"x": "x.md", "y": "sources/y.md", "ZED": "a/zed.md", "x.md": "x.md"}


def test_edges_are_not_merged(spark):
    df = spark.createDataFrame([("a.md", "[[b]] [[B]] [[gone]]"), ("b.md", "")], "path string, content string")
    parsed = parse_pages(df)
    assert [tuple(r) for r in lg.graph_edges(link_rows(parsed), parsed.select("path")).collect()] == [("a.md", "b.md")] * 2


def ledger(spark, rows):
    full = [(p, h, "/d", NOW, page, status, n, "", "scheduled", model) for p, h, page, status, n, model in rows]
    return spark.createDataFrame(full, schemas.LEDGER)


def test_plan_states(spark):
    names = ["ok", "gone", "refused", "other", "tired", "retry", "new", "old"]
    src = spark.createDataFrame([("/d", f"/d/{n}.md", n, 10, NOW - dt.timedelta(hours=1)) for n in names]
                                + [("/d", "/d/x.exe", "x", 1, NOW), ("/d", "/d/big.md", "b", 99, NOW), ("/d", "/d/fresh.md", "f", 1, NOW)],
                                "source_dir string, source_path string, content_hash string, size long, mtime timestamp")
    led = ledger(spark, [("/d/ok.md", "ok", "sources/ok.md", "success", 0, "m"), ("/d/gone.md", "gone", "sources/gone.md", "success", 0, "m"),
                         ("/d/refused.md", "refused", "", "refused", 0, "m"), ("/d/other.md", "other", "", "refused", 0, "m0"),
                         ("/d/tired.md", "tired", "", "failed", 3, "m"), ("/d/retry.md", "retry", "", "failed", 2, "m"),
                         ("/d/old.md", "old", "", "superseded", 0, "m")])
    types = spark.createDataFrame([("/d", ["md"])], "source_dir string, types array<string>")
    pages = spark.createDataFrame([("sources/ok.md",)], "path string")
    plan = ingest.plan_ingest(src, types, led, pages, "m", at(spark), 0, 50)
    got = {r["source_path"][3:]: r["action"] for r in plan.collect()}
    assert got == {"ok.md": "unchanged", "gone.md": "digest", "refused.md": "already-refused", "other.md": "digest", "tired.md": "exhausted",
                   "retry.md": "digest", "new.md": "digest", "old.md": "digest", "x.exe": "skipped", "big.md": "skipped", "fresh.md": "deferred"}
    actions = plan.select(F.col("source_path").alias("path"), F.when(F.col("action") == "digest", "would-digest").otherwise(F.col("action")).alias("action"), "error")
    assert ingest.sum_check(ingest.count_buckets(actions)).first()["ok"]
    limited = {r["source_path"][3:]: r["action"] for r in ingest.plan_ingest(src, types, led, pages, "m", at(spark), 2, 50).collect()}
    assert limited["gone.md"] == limited["new.md"] == "digest" and limited["ok.md"] == "not-examined" and limited["x.exe"] == "skipped"


def test_page_names(spark):
    rows = spark.createDataFrame([("/a/Note.pdf", "h1"), ("/b/note.pdf", "h2"), ("/c/free.pdf", "h3"), ("/d/mine.pdf", "h4")],
                                 "source_path string, content_hash string")
    led = ledger(spark, [("/z/x", "h", "sources/free.md", "failed", 0, "m"), ("/d/mine.pdf", "h0", "sources/mine.md", "success", 0, "m")])
    got = {r["source_path"]: r["wiki_page"] for r in lg_.assign_pages(rows, led).collect()}
    assert got["/a/Note.pdf"] == "sources/note.md" and got["/d/mine.pdf"] == "sources/mine.md"
    assert got["/b/note.pdf"].startswith("sources/note-") and got["/c/free.pdf"].startswith("sources/free-")


def test_changes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("_schema.md", 9)], "path string, v int")
    ops = spark.createDataFrame([("a", 5, "upsert", 1), ("a", 6, "delete", 2), ("c", 7, "upsert", 1), ("c", 8, "upsert", 3), ("_schema.md", 0, "delete", 9)],
                                "path string, v int, op string, seq int")
    got = {r["path"]: r["v"] for r in ch.apply_changes(base, ops).collect()}
    assert got == {"b": 2, "c": 8, "_schema.md": 9}


def test_failed_batches_and_unread_pages(spark):
    df = spark.createDataFrame([("a", "h", "text"), ("b", "h", None)], "path string, content_hash string, content string").coalesce(1)

    def broken(texts):
        raise RuntimeError("down")

    assert {r["path"]: r["outcome"] for r in embed_pages(df, broken).collect()} == {"a": "failed", "b": "skipped"}


def test_responses(spark):
    ok = '[{"type":"result","subtype":"success","is_error":false,"result":"```markdown\\npage\\n```"}]'
    log = [("ok", ok, "", 0), ("refused", '[{"type":"result","subtype":"success","is_error":false,"terminal_reason":"api_error","result":"API Error: Fable 5\'s safeguards flagged this"}]', "", 0),
           ("stderr", "", "API Error: refused", 1), ("plain", "API Error: refused\n", "", 1), ("mention", ok.replace("page", "api error safeguards"), "", 0),
           ("garbage", "this is not json {", "", 0), ("empty", ok.replace("```markdown\\npage\\n```", ""), "", 0), ("limit", "", "rate limit", 1),
           ("object", '{"type":"result"}', "", 0), ("badjson", "[{", "", 0)]
    df = spark.createDataFrame([(*r, False, False) for r in log], "name string, stdout string, stderr string, exit_code int, timed_out boolean, cancelled boolean")
    got = {r["name"]: r["error_class"] for r in responses.classify_responses(df).collect()}
    assert got == {"ok": None, "refused": "refused", "stderr": "refused", "plain": "refused", "mention": None, "garbage": "permanent",
                   "empty": "permanent", "limit": "transient", "object": "permanent", "badjson": "permanent"}


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("_hidden.md", ".dot.md", "a.txt"):
        (tmp_path / "in" / name).write_text("x")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "link.md").symlink_to(tmp_path / "in" / "a.txt")
    found = files.scan_sources(spark, [f"{tmp_path}/in", f"{tmp_path}/in/", f"{tmp_path}/none"])
    assert sorted(r["source_path"].split("/")[-1] for r in found.where("error is null").collect()) == [".dot.md", "_hidden.md", "a.txt"]
    assert {r["state"] for r in files.folder_states(found).collect()} == {"ok", "missing"}
    assert {bytes(r["content"]) for r in files.with_content(found.where("error is null")).collect()} == {b"x"}


def test_url_slugs(spark):
    cases = [("https://h.org/a/b%20c/", "web-a-b-c"), ("https://h.org", "web-h.org"), ("https://h.org/x+y?q=1#f", "web-x+y"),
             ("https://h.org/" + "z" * 100, "web-" + "z" * 80)]
    df = spark.createDataFrame(cases, "u string, want string")
    for r in df.select("want", url_slug(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_replayed_batch_spends_no_attempt(spark, tmp_path):
    store = si.open_store(spark, str(tmp_path / "store"))
    types = spark.createDataFrame([("/d", ["md"])], "source_dir string, types array<string>")
    old = NOW - dt.timedelta(hours=1)
    rows = spark.createDataFrame([("/d", "/d/good.md", bytearray(b"Some text."), 10, old), ("/d", "/d/blank.md", bytearray(b"  "), 2, old),
                                  ("/d", "/d/fresh.md", bytearray(b"New."), 4, NOW)], schemas.SOURCES)
    for _ in range(2):
        si.ingest_batch(rows, store, types, "m", NOW, batch_id=0)
    led = {r["source_path"]: (r["status"], r["attempts"]) for r in store.read("ledger").collect()}
    assert led == {"/d/good.md": ("success", 0), "/d/blank.md": ("failed", 1)}
    # what failed is pending too, and is tried again by every run
    assert sorted(r["source_path"] for r in store.read("pending").collect()) == ["/d/blank.md", "/d/fresh.md"]
    edited = rows.where("source_path = '/d/good.md'").withColumn("content", F.encode(F.lit("Changed."), "UTF-8"))
    si.ingest_batch(edited, store, types, "m", NOW + dt.timedelta(hours=1), batch_id=1)
    rows = store.read("ledger").where("source_path = '/d/good.md'").collect()
    assert sorted(r["status"] for r in rows) == ["success", "superseded"]
    assert store.read("pages").where("path = 'sources/fresh.md'").count() == 1
    assert [r["source_path"] for r in store.read("pending").collect()] == ["/d/blank.md"]
    assert store.read("ledger").where("source_path = '/d/blank.md'").first()["attempts"] == 2


def test_second_writer_of_a_run_fails(spark, tmp_path):
    store = si.open_store(spark, str(tmp_path / "store"))
    row = ("/d", "/d/a.md", 1, NOW, "h", 1, False)
    rows = spark.createDataFrame([row], si.PENDING)
    assert store.append({"pending": rows}, {"batch_id": 4}) == 1
    with pytest.raises(RuntimeError, match="run 1 was finished"):
        store.finish(1, {})
    # a run without its marker is not read, and its number is written anew
    rows.withColumn("source_path", F.lit("/d/lost.md")).write.parquet(f"{store.root}/pending/run=2")
    assert [r["source_path"] for r in store.read("pending").collect()] == ["/d/a.md"]
    assert store.append({"pending": rows.withColumn("settled", F.lit(True))}) == 2
    assert store.read("pending").count() == 0 and store.info() == {"batch_id": 4}


def test_waiting_bytes_are_stored_once(spark, tmp_path):
    store = si.open_store(spark, str(tmp_path / "store"))
    types = spark.createDataFrame([("/d", ["md"])], "source_dir string, types array<string>")
    rows = spark.createDataFrame([("/d", "/d/blank.md", bytearray(b"  "), 2, NOW - dt.timedelta(hours=1))], schemas.SOURCES)
    for i in range(5):
        si.ingest_batch(rows if i == 0 else rows.limit(0), store, types, "m", NOW, i)
    assert store.rows("contents").count() == 1 and store.rows("pending").count() == 1
    assert store.read("ledger").first()["attempts"] == 3 and store.rows("ledger").count() == 3


def test_cuts_fall_between_characters(spark):
    texts = ["a" * n + c + "z" * 9 for n in range(5) for c in ("é", "漢", "😀", "e\u0301", "\ufffd")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", _head_bytes(F.col("t"), 5).alias("cut")).collect():
        want = r["t"]
        while len(want.encode()) > 5:
            want = want[:-1]
        assert r["cut"] == want
