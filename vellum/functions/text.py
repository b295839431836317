"""Text columns: normalisation, tokens, hashes, noise and headings. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fff}]"

# fixed values: lines that are noise
PAGE_NUMBERS = [r"^\s*第?\s*\d+\s*页\s*$", r"(?i)^\s*page\s+\d+\s*$", r"(?i)^\s*pages?\s+\d+\s*[-–]\s*\d+\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"^\s*-\s*\d+\s*$", r"^\s*\[\s*\d+\s*\]\s*$", r"^\s*第?\d+/\d+页?\s*$"]
RULES = r"^[-_=*·•]{3,}$"
SEVERE = [r"^[_\-.=*·•]{5,}\s*$", r"^[\x{1F300}-\x{1F9FF}]{2,}\s*$"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TEMPLATES = [
    r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\s*$",
    r"(?i)^https?://\S+\s*$",
    r"(?i)^www\.\S+\s*$",
    r"^\s*[\x{a9}\x{24b6}-\x{24fe}]\s+\d{4}(\s+\S+)?\s*$",
    r"^\s*[\x{2500}-\x{257f}\x{2014}\x{2015}]{3,}\s*$",
    r"(?i)^\s*(doc\.?\s*id\s*[:\-]?\s*)?[A-Z0-9]{6,}\s*$",
]


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def normalize_whitespace(c: Column) -> Column:
    """One line feed style, stripped lines, at most one empty line, single blanks."""
    c = F.regexp_replace(F.replace(blank(c), F.lit("\u00a0"), F.lit(" ")), r"\r\n|\r", "\n")
    c = F.regexp_replace(c, r"[ \t\x0B\f]*\n[ \t\x0B\f]*", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def normalize_ingested(c: Column) -> Column:
    """As it is first read: lines keep one leading blank."""
    c = F.regexp_replace(blank(c), r"\r\n|\r", "\n")
    c = F.regexp_replace(F.translate(c, "\u00a0\u3000", "  "), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t\x0B\f]+\n", "\n"))


def normalize_lexical(c: Column) -> Column:
    """Lower case words of letters, digits and underscores, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(normalize_whitespace(c)), r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(WORD), F.lit(0))


def token_count(c: Column) -> Column:
    """Estimated tokens: CJK characters and 1.3 a Latin word, truncated."""
    return (F.regexp_count(blank(c), F.lit(CJK)) + F.regexp_count(blank(c), F.lit(r"[A-Za-z0-9_./:-]+")) * 1.3).cast("int")


def content_hash(c: Column) -> Column:
    return F.md5(blank(c))


def lines(c: Column) -> Column:
    return F.split(blank(c), "\n", -1)


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def is_noise(line: Column) -> Column:
    s = strip(line)
    return (s == "") | matches_any(s, [*PAGE_NUMBERS, RULES])


def is_severe_noise(line: Column) -> Column:
    s = strip(line)
    return (s == "") | matches_any(s, [*SEVERE, CONTROL])


def is_template_noise(line: Column) -> Column:
    s = strip(line)
    return (s == "") | matches_any(s, TEMPLATES)


def repair_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, r"([\p{L}\p{N}_]+)[-\x{2011}]\n([\p{L}\p{N}_]+)", "$1$2")


def heading_level(line: Column) -> Column:
    s, head = strip(line), F.substring_index(strip(line), " ", 1)
    dots = F.length(head) - F.length(F.replace(head, F.lit("."), F.lit("")))
    return (
        F.when(s == "", 1)
        .when(s.rlike(r"^#{1,6}\s+"), F.least(F.lit(6), F.length(head)))
        .when(s.rlike("^第[一二三四五六七八九十百千万0-9]+章"), 1)
        .when(s.rlike("^第[一二三四五六七八九十百千万0-9]+节"), 2)
        .when(s.rlike("^[一二三四五六七八九十]+[、.．]"), 2)
        .when(s.rlike("^[0-9]+[.、]"), F.least(F.lit(4), F.greatest(F.lit(2), dots + 2)))
        .otherwise(1)
        .cast("int")
    )


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(ext.isin(".txt", ".md", ".markdown"), "text").when(ext == ".docx", "docx").when(ext == ".pdf", "pdf").otherwise("unknown")


def tags(c: Column) -> Column:
    """Comma separated tags, stripped, without empty ones."""
    return F.filter(F.transform(F.split(blank(c), ","), normalize_whitespace), lambda t: t != "")


def parse_timestamp(c: Column) -> Column:
    """The first of four formats that fits, else ISO."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss"]
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats), F.try_to_timestamp(F.trim(c)))


def truncate(c: Column, most: int = 220) -> Column:
    s = normalize_whitespace(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 3), F.lit("...")))


def page_label(start: Column, end: Column) -> Column:
    both = F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), both), start.cast("string"), end.cast("string"), F.lit("-"))


def must_include(c: Column) -> Column:
    """Amounts, percentages and up to three quoted phrases, once each whatever their case (first spelling)."""
    found = lambda p, g: F.regexp_extract_all(blank(c), F.lit(p), F.lit(g))
    every = F.concat(found(r"\$[\d,]+\.?\d*", 0), found(r"\d+\.?\d+\s*%", 0), F.slice(found('"([^"]{3,50})"', 1), 1, 3))
    return F.transform(F.array_distinct(F.transform(every, F.lower)), lambda low: F.element_at(F.filter(every, lambda x: F.lower(x) == low), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def contextual_header(title: Column, page: Column, section_path: Column, section_title: Column, kind: Column | None = None) -> Column:
    """"title | Page n | Section: path > title | Type: kind", without the parts that are blank or null."""
    filled = lambda c: F.when(blank(c) != "", c)
    section = F.concat_ws(" > ", filled(section_path), filled(section_title))
    parts = [filled(title), F.concat(F.lit("Page "), page.cast("string")), F.when(section != "", F.concat(F.lit("Section: "), section))]
    if kind is not None:
        parts.append(F.concat(F.lit("Type: "), filled(kind)))
    return F.concat_ws(" | ", *parts)


def contextual_text(header: Column, search_text: Column, chunk_text: Column) -> Column:
    """A header over the search text, or over the chunk where there is none."""
    return F.concat_ws("\n", header, F.coalesce(F.when(search_text != "", search_text), blank(chunk_text)))


def collapse(c: Column) -> Column:
    """Every run of white space as one blank."""
    return strip(F.regexp_replace(blank(c), r"\s+", " "))


def normalize_block(c: Column) -> Column:
    return strip(F.regexp_replace(normalize_ingested(c), r"\n{2,}", "\n"))


# fixed values: names that parsers give to blocks, and the type each stands for
BLOCK_TYPES = {
    "heading": ["title", "heading", "subtitle", "toc"],
    "paragraph": ["narrativetext", "paragraph", "text", "p"],
    "list_item": ["listitem", "list_item", "listitemex", "bullet", "numbered"],
    "table": ["table", "table_cell", "tabledata", "table_row"],
    "quote": ["quote", "blockquote", "citation"],
    "code": ["code", "codeblock", "sourcecode"],
    "caption": ["caption", "image_caption", "table_caption", "figure"],
    "header": ["header", "page_header", "page_number"],
    "footer": ["footer", "page_footer"],
    "unknown": ["metadata", "unknown", "embedded"],
}


def block_type(c: Column) -> Column:
    name = F.lower(strip(blank(c)))
    return reduce(lambda out, kind: F.when(name.isin(*BLOCK_TYPES[kind]), kind).otherwise(out), BLOCK_TYPES, F.lit("paragraph"))


def section_path(c: Column) -> Column:
    """Parts of a path given as a JSON list, as "A > B" or as "A/B"; blank parts are left out."""
    text = strip(blank(c))
    listed = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
    split = F.when(F.contains(text, F.lit(">")), F.split(text, ">")).when(F.contains(text, F.lit("/")), F.split(text, "/")).otherwise(F.array(text))
    return F.filter(F.transform(F.coalesce(listed, split), normalize_whitespace), lambda p: p != "")


def section_title(path: Column) -> Column:
    """The last part of a path (an array), "" for none."""
    return F.coalesce(F.get(path, F.size(path) - 1), F.lit(""))


def to_int(c: Column, default: int | None = None) -> Column:
    """Whole numbers as they are, others truncated, all else ``default``."""
    return F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def embedding_of(c: Column) -> Column:
    """The numbers of a vector written as a JSON list; what is no number is left out."""
    return F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def guessed_heading(c: Column) -> Column:
    """The level of a line that looks like a heading, else null: items and parts 2, numbered lines 3, lines in capitals 2."""
    s = strip(blank(c))
    letters, capitals = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    level = F.when(s.rlike(r"(?i)^(item|section|part)\s+[A-Z0-9IVX.\-]+"), 2).when(s.rlike(r"^\d+(\.\d+){0,3}\s+\S+"), 3).when((letters > 0) & (capitals > letters * 0.8) & (F.length(s) < 100), 2)
    return F.when((s != "") & (F.length(s) <= 120), level)


# fixed values: what names a company, a filing and a fiscal year
COMPANY = r"(?i)(?:公司|Company|Corporation|Corp|Inc|Ltd)\s*[:：]?\s*([A-Za-z0-9\x{4e00}-\x{9fff}（）()]+?)(?:[,，]|公司|\n?\z)"
FILING = r"(?i)((?:年报|半年报|季报|10-K|10-Q|8-K|Form\s*([A-Za-z0-9-]+)))"
FISCAL = r"(?i)(?:财年|Fiscal\s*Year|FY)\s*[:：]?\s*(20\d{2})"


def finance_metadata(title: Column, content: Column) -> Column:
    """Struct of company, filing_type and fiscal_year as a title and the start of a content name them, null where they do not."""
    start = lambda n: F.concat_ws(" ", blank(title), F.substring(blank(content), 1, n))
    found = lambda text, p: F.nullif(normalize_whitespace(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(found(start(500), COMPANY).alias("company"), found(start(1000), FILING).alias("filing_type"), found(F.substring(blank(content), 1, 2000), FISCAL).alias("fiscal_year"))


def search_text(title: Column, company: Column, filing: Column, path: Column, headings: Column, start: Column, end: Column, kind: Column, body: Column, caption: Column | None = None, units: Column | None = None, years: Column | None = None) -> Column:
    """What is embedded of a chunk: a line for each thing known about it, then its text. ``path``, ``headings`` and ``years`` are arrays;
    the last three count for tables only."""
    line = lambda name, c: F.when(normalize_whitespace(c) != "", F.concat(F.lit(f"[{name}] "), normalize_whitespace(c)))
    own = F.array_distinct(F.filter(F.transform(headings, normalize_whitespace), lambda h: h != ""))
    last = F.slice(own, F.greatest(F.lit(1), F.size(own) - 2), F.lit(3))
    pages = F.when(start.isNotNull(), F.when(F.coalesce(end, start) != start, F.concat(F.lit("[Pages] "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit("[Page] "), start.cast("string"))))
    parts = [line("Document", title), line("Company", company), line("Filing", filing), line("Section", section_title(path)), F.when(F.size(own) > 0, F.concat(F.lit("[SectionPath] "), F.array_join(last, " / "))), pages, F.concat(F.lit("[ChunkType] "), kind)]
    for name, c in (("TableCaption", caption), ("Units", units), ("YearColumns", None if years is None else F.array_join(years, ", "))):
        if c is not None:
            parts.append(F.when(kind.isin("table", "table_linearized"), line(name, c)))
    return strip(F.concat_ws("\n", *parts, F.nullif(normalize_whitespace(body), F.lit(""))))


def query_terms(question: Column, rewritten: Column, more: Column) -> Column:
    """Distinct terms of a question, its rewriting and an array of others, longest first."""
    found = lambda c: F.regexp_extract_all(normalize_whitespace(c), F.lit(r"[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_./:-]{1,}"), F.lit(0))
    every = F.array_distinct(F.concat(found(question), found(rewritten), F.coalesce(more, F.array().cast("array<string>"))))
    return F.transform(F.array_sort(F.transform(every, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def coverage(evidence: Column, text: Column) -> Column:
    """The share of the evidence's words that a text has."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(blank(c)), r"\s+"), lambda t: t != ""))
    own = split(evidence)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, split(text))) / F.when(F.size(own) > 0, F.size(own))).otherwise(0.0)


def key_sentences(c: Column, most: int = 3) -> Column:
    parts = F.transform(F.split(blank(c), r"(?<=[。！？.!?])\s+"), strip)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def cache_key(c: Column) -> Column:
    return F.substring(F.sha2(blank(c), 256), 1, 16)


def difficulty(question: Column, answer: Column) -> Column:
    short = (F.length(blank(answer)) < 50) & blank(answer).rlike("[0-9]")
    return F.when(~short & ((F.length(blank(question)) > 150) | (F.length(blank(answer)) > 300)), "medium").otherwise("easy")


# fixed values: the note over a table of two years
TWO_YEARS = (
    "[NOTE: Financial table with two fiscal year columns. When data appears as:\n  Label\n  $value1\n  $value2\n"
    "value1 = most recent fiscal year, value2 = prior fiscal year. Use the FIRST value (most recent year) for current-year analysis.]\n\n"
)


def clean_table(c: Column) -> Column:
    """Without the names of first columns; a table of four numeric lines or more gets the note on its years."""
    text = normalize_whitespace(c)
    bare = F.regexp_replace(text, "(?m)^col_0=", "")
    numeric = F.size(F.filter(F.split(bare, "\n", -1), lambda r: strip(r).rlike(r"^\$?[\d,]+\.?\d*\z")))
    return F.when(text.rlike("(?m)^col_0=") & (numeric >= 4), F.concat(F.lit(TWO_YEARS), bare)).otherwise(bare)


def html_text(c: Column) -> Column:
    """A page without scripts, styles and tags, every run of white space one blank."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " ")
