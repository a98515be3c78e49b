"""Indexes that are kept up against those built anew."""

import random

from pyspark.sql import functions as F

from folioscope.operators import linkgraph as lg
from folioscope.operators import linkindex as li
from folioscope.operators import postings as po
from folioscope.operators import search as se
from folioscope.operators.parse import parse_with

PAGE = "path string, title string, type string, category string, tags array<string>, content string"


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_postings_after_changes(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "Beta", "gam ma", "ab", "aaaa", "öß", "the"]) for _ in range(rng.randint(0, 12)))
    index, state = po.PostingIndex(spark, str(tmp_path / "index"), 4), {}
    asked = spark.createDataFrame([(q, q) for q in ("alpha", "aaa", "beta alpha", "gam ma", "ÖSS", "the", "nowhere", " ", "ab")], "query_id string, query string")
    for version in range(4):
        batch = {f"p{i}.md": ("delete" if version and rng.random() < 0.3 else "upsert") for i in rng.sample(range(25), 14)}
        rows = []
        for path, op in batch.items():
            row = (path, rng.choice([None, "Alpha", "The title"]), "t", "", ["x", "aaa"], text() if rng.random() < 0.9 else None)
            rows.append((*row, op))
            state[path] = row
            if op == "delete":
                del state[path]
        changes = spark.createDataFrame(rows, PAGE + ", op string")
        index.apply(changes, version)
        index.apply(changes.limit(0), version)  # a replay changes nothing
    pages = spark.createDataFrame(list(state.values()), PAGE)
    assert rows_of(index.search(asked, 5)) == rows_of(se.search(pages, asked, 5))
    assert rows_of(index.similar_by_text(3)) == rows_of(se.similar_by_text(pages, None, 3).select(index.similar_by_text(3).columns))
    texts = se.search_text(pages)
    assert rows_of(index.gram_counts().select("gram", "df")) == rows_of(se.gram_counts(se.build_postings(texts)))
    assert rows_of(index.stats()) == rows_of(se.corpus_stats(texts))
    # a version without finished pages is not read
    index._write(spark.createDataFrame([("aaa", "lost.md", 0)], "gram string, path string, bucket int"), "postings", 9, "bucket", "gram")
    assert index.postings().where("path = 'lost.md'").count() == 0 and index.versions() == [0, 1, 2, 3]


def test_search_reads_the_buckets_of_its_grams(spark, tmp_path):
    index = po.PostingIndex(spark, str(tmp_path / "index"), 64)
    index.build(spark.createDataFrame([(f"p{i}", "t", "", "", [], f"word{i} and more text") for i in range(50)], PAGE))
    phrases = se.prepared(spark.createDataFrame([("q", "word7")], "query_id string, query string"))
    plan = index.candidates(phrases)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters"):]
    assert [r["path"] for r in index.candidates(phrases).collect()] == ["p7"]


def test_links_after_changes(spark, tmp_path):
    rng = random.Random(2)
    names = ["a", "B", "sources/c", "x/D", "y/d", "e e", "f/../g"]
    texts = ["a", "A", "b", "c", "d", "D", "e e", "g", "sources/c", "x/D.md", "none", "y/d"]
    index, state = li.LinkIndex(spark, str(tmp_path / "links"), 4), {}
    for version in range(5):
        rows = []
        for name in rng.sample(names, 4):
            path, op = name + ".md", "delete" if version and rng.random() < 0.4 else "upsert"
            row = (path, rng.choice(["source", "", None]), rng.sample(texts, rng.randint(0, 5)))
            rows.append((*row, op))
            state.pop(path, None)
            if op == "upsert":
                state[path] = row
        index.apply(spark.createDataFrame(rows, "path string, type string, links array<string>, op string"), version)
        parsed = spark.createDataFrame(list(state.values()), "path string, type string, links array<string>")
        links = parsed.select("path", F.explode("links").alias("link"))
        assert rows_of(index.links()) == rows_of(links)
        used = links.select("link").distinct()
        assert rows_of(index.resolved().join(used, "link", "left_semi")) == rows_of(lg.resolve_names(used, parsed))
    assert rows_of(index.broken()) == rows_of(lg.broken_links(links, parsed))
    assert rows_of(index.orphans()) == rows_of(lg.orphan_pages(links, parsed))
    assert rows_of(index.edges()) == rows_of(lg.graph_edges(links, parsed))


def test_parser_of_the_user(spark):
    def parser(path, content):
        if content is None:
            raise ValueError("empty")
        return {"title": content.split(":")[0], "tags": ["t", "t"], "links": None}

    pages = spark.createDataFrame([("d/a.md", "One: x"), ("d/b.md", ":"), ("d/c.md", None)], "path string, content string")
    good, errors = parse_with(pages, parser, "mine")
    assert rows_of(good.select("path", "title", "tags", "links", "category", "source_type")) == [("d/a.md", "One", ["t"], [], "", "mine"), ("d/b.md", "b", ["t"], [], "", "mine")]
    assert rows_of(errors) == [("d/c.md", "ValueError: empty")]
