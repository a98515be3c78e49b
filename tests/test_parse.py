"""Page parsing, links, slugs and text rules."""

import random
import re
import unicodedata
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from folioscope.functions import header as hd
from folioscope.functions import links as ln
from folioscope.functions import paths as pt
from folioscope.functions import text as tx
from folioscope.operators.parse import parse_pages


def parse(spark, content, path="notes/page.md", dialect="wikilink"):
    return parse_pages(spark.createDataFrame([(path, content)], "path string, content string"), dialect).first()


PAGES = [
    ("---\ntitle: Hello World\ntags: [greeting]\n---\n\n# Other\n", "p.md", dict(title="Hello World", tags=["greeting"], links=[])),
    ("---\ntitle: [unclosed\n---\nbody [[x]]", "a/broken-frontmatter.md", dict(title="broken-frontmatter", links=["x"])),
    ("# Just a Heading\n\n[[some-link]]\n", "n.md", dict(title="Just a Heading", links=["some-link"])),
    ("\ufeff---\ntitle: BOM Test\ntags: [bom-tag]\n---\n", "b.md", dict(title="BOM Test", tags=["bom-tag"])),
    ("---\naliases: [alias1, alias2]\ntags:\n  - tag1\n  - tag2\n---\n[[link1]] [[link2|shown]]", "al.md",
     dict(aliases=["alias1", "alias2"], tags=["tag1", "tag2"], links=["link1", "link2"])),
    ("```\n[[fenced]]\n```\n`[[inline]]` [[real-link]]", "c.md", dict(links=["real-link"])),
    ("status:: draft\npriority:: low\npriority:: high\n #inline-tag", "d.md",
     dict(fields={"status": "draft", "priority": "high"}, tags=["inline-tag"])),
    ("![[image.png]] ![[diagram.svg]] [[other-note]]", "e.md", dict(attachments=["image.png", "diagram.svg"], links=["other-note"])),
    ("---\n---\n[[note#part]] [[another#x|y]] [[#only]]", "heading-link.md", dict(title="heading-link", links=["note", "another"])),
    ("---\ntitle: 2024\ntags: a, b,,a\naliases: one\n---\n", "num.md", dict(title="num", tags=["a", "b"], aliases=["one"])),
    ("---\ntitle: yes\n---\n", "yes.md", dict(title="yes", type="")),
    ("---\ntitle: 2024-01-15\ntype: source\n---\n", "date.md", dict(title="2024-01-15", type="source")),
    ("\n\n---\ntitle: Late\n---\nx", "late.md", dict(title="Late")),
    ("---\ntitle: Never closed\n", "open.md", dict(title="open")),
    ("+++\ntitle = \"Toml\"\n+++\nx", "t.md", dict(title="Toml")),
    ("---\ntitle: \"Quoted: yes\"\ncategory: LEGAL\n---\n", "q.md", dict(title="Quoted: yes", category="legal")),
    ("한국어 [[프로젝트-개요]] #태그", "k.md", dict(links=["프로젝트-개요"], tags=["태그"], title="k")),
]


@pytest.mark.parametrize("content,path,want", PAGES, ids=[p[1] for p in PAGES])
def test_page(spark, content, path, want):
    row = parse(spark, content, path)
    assert {k: row[k] for k in want} == want


def test_markdown_links(spark):
    body = "[a](x.md) [b](y.md#part) ![i](img/p.png) [e](https://e.org) [m](mailto:a@b) [r](/abs) [h](#top) [w](C:\\x) [p](//h/x) [d](x.md)"
    row = parse(spark, body, dialect="markdown")
    assert (row["links"], row["attachments"], row["fields"]) == (["x.md", "y.md"], ["img/p.png"], {})


def test_plain_headers_read_alike_in_both_ways(spark):
    """The native reader and the YAML reader agree where both apply."""
    blocks = ["title: Some Page\ntype: source\n", "tags: [a, b c, a]\naliases: [x]\n", "count: 12\ntitle: T\n",
              "ingested_at: 2024-01-15\nsource_path: /in/a.b.txt\n", "category: Legal\ntags: solo\n", "tags: []\n", ""]
    df = spark.createDataFrame([(f"---\n{b}---\n",) for b in blocks], "content string")
    rows = {r["content"]: r["header"] for r in hd.with_header(df).collect()}
    for block in blocks:
        got, want = rows[f"---\n{block}---\n"].asDict(), hd.read_block("---", block)
        assert {k: got[k] for k in got if k != "fields"} == {k: want[k] for k in want if k != "fields"}, block
        assert got["fields"] == want["fields"]


def code_mask(body):
    """For each character whether it is code: fence lines by parity, then pairs of equal runs of ticks."""
    lines = body.split("\n")
    marked = [line.strip(tx.WHITE_SPACE)[:3] in ("```", "~~~") for line in lines]
    seen = list(accumulate(marked))  # marker lines up to each line
    mask = [bool(m or n % 2) for line, m, n in zip(lines, marked, seen) for _ in line + "\n"][:len(body)]
    fenced, free = list(mask), 0
    while ticks := [i for i in range(free, len(body)) if body[i] == "`" and not fenced[i]]:
        rest = body[ticks[0]:]
        run = "`" * (len(rest) - len(rest.lstrip("`")))
        inside, closed, _ = rest[len(run):].partition(run)
        if not closed:
            break
        free = ticks[0] + 2 * len(run) + len(inside)
        mask[ticks[0]:free] = [True] * (free - ticks[0])
    return mask


def slow_links(body):
    mask = code_mask(body)
    return [m.group() for m in re.finditer(r"\[\[[^\]\n]+\]\]", body) if not mask[m.start()]]


def test_code_spans_against_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        body = "".join(rng.choice(["`", "``", "```", "~~~", "\n", "[[a]]", "[[b|c]]", "x ", " "]) for _ in range(rng.randint(1, 25)))
        assert [m.removeprefix("!") for m in ln.links_outside_code(body)] == slow_links(body), repr(body)


def plain_slug(path, digest):
    """The rule, character by character."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rpartition(".")[0] if "." in name else name
    kept = [("-" if c == " " else c) for c in stem.lower() if c in " ._-" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"]
    joined = "".join(c for c, before in zip(kept, [None, *kept]) if not c == before == "-").strip("-")
    return joined or "src-" + digest[:8]


def test_slugs(spark):
    rng = random.Random(11)
    names = ["/in/" + "".join(rng.choice("aZ9 -._(é漢가²!") for _ in range(rng.randint(0, 9))) + rng.choice(["", ".txt", ".MD", "."]) for _ in range(400)]
    names += ["/x/Quarterly Report (final).xlsx", "/x/.profile", "/x/---.md"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for r in df.select("p", tx.slug_for(F.col("p"), F.lit("0f1e2d3c4b5a6978")).alias("got")).collect():
        assert r["got"] == plain_slug(r["p"], "0f1e2d3c4b5a6978"), r["p"]


def test_categories(spark):
    known = ("reference", "legal", "article")
    cases = [(pad + form(k) + pad, k) for k in known for form in (str, str.upper, str.title) for pad in ("", " ", "\t")]
    cases += [("", ""), (" ", "article"), ("legal article", "article"), ("arti", "article"), ("手册", "article")]
    df = spark.createDataFrame(cases, "c string, want string")
    for r in df.select("c", "want", tx.normalize_category(F.col("c")).alias("got")).collect():
        assert r["got"] == r["want"], repr(r["c"])


def test_clean_paths(spark):
    cases = [("a//b", "a/b"), ("./a/./b", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("/..", "/"), ("", "."), ("a/b/", "a/b"),
             ("sources/../x.md", "x.md"), ("plain.md", "plain.md"), ("a..b/c", "a..b/c")]
    df = spark.createDataFrame(cases, "p string, want string")
    for r in df.select("p", "want", pt.clean(F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"], r["p"]


def test_fences_and_diagnostics(spark):
    cases = ["```markdown\n---\na\n```", "plain", "```\n```", "```x\nopen", "  ```\nbody\n```  \n"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(tx.strip_fence(F.col("t"))).collect()]
    assert got == ["---\na", "plain", "", "open", "body"]
    long = "x" * 2500
    rows = spark.createDataFrame([("\x1b[31m a\n\tb\x00 \x1b]0;t\x07c ",), (long,)], "t string").select(
        tx.normalize_diagnostic(F.col("t"))).collect()
    assert rows[0][0] == "a b\ufffd c"
    assert rows[1][0] == "x" * 1999 + "\u2026"


def test_unneeded_columns_are_not_computed(spark):
    """Selecting the title alone runs no link extraction, and links no Python."""
    df = spark.createDataFrame([("a.md", "x")], "path string, content string")
    plan = parse_pages(df).select("path", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert "_links_outside_code" not in plan
