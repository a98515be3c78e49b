"""Column expressions over text: titles, slugs, snippets, prompts, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.paths import base_name, extension, stem

# fixed values: Unicode white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed values: accepted page categories
CATEGORIES = ["article", "legal", "reference"]
# fixed values: embedding text, snippet and diagnostic lengths in characters
EMBED_CHARS = 2000
SNIPPET_MARGIN = 32
DIAGNOSTIC_CHARS = 2000
# fixed values: reading instruction by file extension
TYPE_PHRASES = {
    ".pdf": "Read the PDF file at path: ",
    ".md": "Read the markdown file at path: ",
    ".markdown": "Read the markdown file at path: ",
    ".csv": "Read the CSV file at path: ",
    ".tsv": "Read the TSV file at path: ",
    ".xlsx": "Read the Excel spreadsheet at path: ",
}
OTHER_TYPE_PHRASE = "Read the file at path: "
# fixed values: the output contract of a digest request
PROMPT_SLUG = "\n\nDigest it into the wiki page slug: "
PROMPT_FIELDS = (
    "\n\nOutput ONLY a markdown wiki page (no preamble). Begin with YAML frontmatter "
    "carrying the fields title, type: source, source_path: "
)
PROMPT_RULES = (
    ", ingested_at set to today's date in ISO 8601 (YYYY-MM-DD), and category: <one of "
    "article, legal, reference> based on the document content. "
    "article = news, opinion, analysis, blogs, newsletters, reports. "
    "legal = court rulings, legislation, terms of service, privacy policies, regulations. "
    "reference = technical docs, API docs, framework guides, standards, manuals. "
    "Default to article if uncertain.\n"
)


def trim_space(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def strip_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def content_hash(data: Column) -> Column:
    """Lower-case hex SHA-256 of the raw bytes."""
    return F.sha2(data, 256)


def hash8(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 8)


def normalize_category(raw: Column) -> Column:
    folded = F.lower(trim_space(raw))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(""))
        .when(folded.isin(CATEGORIES), folded)
        .otherwise(F.lit("article"))
    )


def slug_for(path: Column, file_hash: Column) -> Column:
    """Page slug of a source file name; by its hash when no character is left."""
    name = F.replace(F.lower(stem(path)), F.lit(" "), F.lit("-"))
    kept = F.regexp_replace(name, r"[^\p{L}\p{Nd}._-]", "")
    slug = F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))
    return F.when(slug == "", F.concat(F.lit("src-"), F.substring(file_hash, 1, 8))).otherwise(slug)


def archived_path(page: Column, file_hash: Column) -> Column:
    return F.concat(
        F.lit("sources/_archived/"), stem(page), F.lit("-"),
        F.substring(file_hash, 1, 8), extension(page))


def heading_title(body: Column) -> Column:
    """Text of the first level-1 heading, or null where there is none."""
    found = F.regexp_extract(body, r"(?md)^#[\t\n\f\r ]+(.+)$", 1)
    return F.when(found == "", F.lit(None)).otherwise(trim_space(found))


def file_title(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.md\z", "")


def embed_title(content: Column) -> Column:
    """First line that starts with 'title: ' or '# ' and has more text, else ''."""
    return F.regexp_extract(content, r"(?md)^(?:title: |# )(.+)$", 1)


def embed_text(path: Column, content: Column) -> Column:
    title = embed_title(content)
    return F.concat(
        F.when(title == "", path).otherwise(title), F.lit("\n\n"),
        F.substring(content, 1, EMBED_CHARS))


def snippet(content: Column, phrase: Column) -> Column:
    """The first case-folded match with a margin on both sides; '' if none."""
    return snippet_at(content, F.position(F.lower(phrase), F.lower(content)), F.char_length(phrase))


def snippet_at(content: Column, at: Column, length: Column) -> Column:
    """``length`` characters from position ``at`` with a margin; '' for 0."""
    first = F.greatest(at - SNIPPET_MARGIN, F.lit(1))
    last = F.least(at + length - 1 + SNIPPET_MARGIN, F.char_length(content))
    cut = F.concat(
        F.when(first > 1, F.lit("...")).otherwise(F.lit("")),
        F.substring(content, first, last - first + 1),
        F.when(last < F.char_length(content), F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(at > 0, cut).otherwise(F.lit(""))


def strip_fence(text: Column) -> Column:
    """Drop one leading fence line and one matching closing fence line."""
    whole = trim_space(text)
    inner = F.regexp_replace(whole, r"\A```[^\n]*\n", "")
    inner = F.regexp_replace(inner, r"(?:\A|\n)[^\S\n]*```[^\S\n]*\z", "")
    return F.when(whole.rlike(r"\A```[^\n]*\n"), trim_space(inner)).otherwise(whole)


def type_phrase(path: Column) -> Column:
    ext = F.lower(extension(path))
    phrase = F.lit(OTHER_TYPE_PHRASE)
    for suffix, text in TYPE_PHRASES.items():
        phrase = F.when(ext == suffix, F.lit(text)).otherwise(phrase)
    return phrase


def digest_prompt(schema_text: Column, path: Column, slug: Column) -> Column:
    return F.concat(
        schema_text, F.lit("\n\n"), type_phrase(path), path, F.lit(PROMPT_SLUG), slug,
        F.lit(PROMPT_FIELDS), path, F.lit(PROMPT_RULES))


def strip_ansi(text: Column) -> Column:
    no_osc = F.regexp_replace(text, r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)", "")
    return F.regexp_replace(no_osc, r"\x1b\[[0-9;?]*m", "")


def normalize_diagnostic(text: Column) -> Column:
    """One printable line: no colour codes, single blanks, marked controls, capped."""
    space = r"[\t\n\x0B\f\r\u0085\p{Z}]+"
    line = trim_space(F.regexp_replace(strip_ansi(text), space, " "))
    line = F.regexp_replace(line, r"[\p{Cc}\p{Cf}]", "\ufffd")
    return F.when(
        F.char_length(line) > DIAGNOSTIC_CHARS,
        F.concat(F.substring(line, 1, DIAGNOSTIC_CHARS - 1), F.lit("\u2026")),
    ).otherwise(line)


def diagnostic_shaped(text: Column) -> Column:
    """A non-empty single line that does not look like page text."""
    line = trim_space(strip_ansi(text))
    shape = trim_space(F.regexp_replace(line, r"[\p{Cc}\p{Cf}]", ""))
    return (
        (line != "") & ~line.rlike(r"[\r\n]")
        & ~shape.startswith("---") & ~shape.startswith("#") & ~shape.startswith("```")
    )
