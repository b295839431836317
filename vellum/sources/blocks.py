"""Typed blocks of plain and Markdown texts, their cleaning and merging, and chunks assembled from them.

Parsing and merging depend on the lines before, so each document goes through an Arrow function as one array of blocks;
noise is dropped between the two by Spark expressions. Fence lines, Markdown headings and table rows are never joined with
other lines, so code is kept whole and a heading takes no text with it, and chunks lose no table row: windows of rows follow one another and repeat the header instead of overlapping.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.sources.chunking import OVERLAP, SIZE, split_text

# fixed values: what ends a paragraph, what starts one, headings with their levels, list items, lead-in phrases, limits
ENDS = tuple("。！？!?;.．")
STARTS = re.compile(r"[-*#>\d]")
CN = "一二三四五六七八九十"
HEADINGS: list[tuple[re.Pattern, Callable[[re.Match], int]]] = [
    (re.compile(r"(#{1,6})\s+(?P<title>.+)"), lambda m: len(m[1])),
    (re.compile(rf"第[{CN}百千万零0-9]+章\s+(?P<title>.+)"), lambda m: 1),
    (re.compile(rf"第[{CN}百千万零0-9]+节\s+(?P<title>.+)"), lambda m: 2),
    (re.compile(rf"第[{CN}百千万零0-9]+[部分篇]\s+(?P<title>.+)"), lambda m: 1),
    (re.compile(rf"[{CN}]+[、.．]\s*(?P<title>.+)"), lambda m: 2),
    (re.compile(r"(\d+(?:\.\d+){0,3})\s+(?P<title>.+)"), lambda m: min(4, m[1].count(".") + 2)),
    (re.compile(rf"[（(][{CN}0-9]+[)）]\s*(?P<title>.+)"), lambda m: 1),
]
ITEMS = re.compile(r"[-*•·]\s+|\d+[.)、，]\s+|[（(]\d+[)）]\s+|[a-zA-Z][.)]\s+")
RULE = re.compile(r"[=-]{3,}")
LEADS = {"例如：", "比如：", "也就是说：", "也就是：", "原因是：", "可以拆成：", "如下：", "比如", "例如", "具体来说："}
SHORT, TINY, REPEATED, HEADS = 35, 12, 3, 6

BODY = ("paragraph", "list_item", "quote")
BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("section", pa.string()), ("repeats", pa.int32())])
SCHEMA = "doc_id long, blocks array<struct<kind string, text string, level int, section string, repeats int>>"


class Block(NamedTuple):
    kind: str
    text: str
    level: int | None = None
    section: str | None = None
    repeats: int = 1


def paragraphs(text: str) -> Iterator[str]:
    """Lines joined where they look wrapped; code between fences, table rows and headings stay lines of their own."""
    held: list[str] = []
    fenced = False
    for raw in text.split("\n"):
        line = raw.strip()
        fence, alone = line.startswith("```"), line.startswith("|") or bool(HEADINGS[0][0].match(line))
        starts = not line or fence or fenced or alone or (held and (held[-1].endswith(ENDS) or held[-1].startswith(("|", "#")))) or (STARTS.match(line) and len(line) < 80)
        if starts and held:
            yield " ".join(held)
            held = []
        if fence or fenced:
            fenced ^= fence
            yield line if fence else raw
        elif line:
            held.append(line)
    if held:
        yield " ".join(held)


def _shape(part: str) -> Block:
    """What one paragraph is, without its place."""
    if RULE.fullmatch(part):
        return Block("rule", part)
    for pattern, level in HEADINGS:
        if found := pattern.fullmatch(part):
            return Block("heading", found["title"].strip(), level(found))
    if ITEMS.match(part):
        return Block("list_item", part)
    if part.startswith(">"):
        return Block("quote", part.lstrip(">").strip())
    return Block("table" if part.startswith("|") and "|" in part[1:] else "paragraph", part)


def parse(text: str | None) -> list[Block]:
    """Blocks in order, each with the path of headings above it (null above the first) and how often its text occurs.

    Adjacent table rows form one table; an unclosed fence ends with the text; null and empty texts have no blocks."""
    out: list[Block] = []
    path: list[str] = []
    code: list[str] | None = None
    for part in paragraphs((text or "").replace("\r\n", "\n").replace("\r", "\n")):
        section = " > ".join(path) or None
        if part.startswith("```"):
            if code:
                out.append(Block("code", "\n".join(code).strip("\n"), None, section))
            code = [] if code is None else None
            continue
        if code is not None:
            code.append(part)
            continue
        block = _shape(part)
        if block.kind == "heading":
            path = [*path[: block.level - 1], block.text]
            section = " > ".join(path)
        if block.kind == "table" and out and out[-1].kind == "table" and out[-1].section == section:
            out[-1] = out[-1]._replace(text=f"{out[-1].text}\n{block.text}")
        else:
            out.append(block._replace(section=section))
    if code:
        out.append(Block("code", "\n".join(code).strip("\n"), None, " > ".join(path) or None))
    times = Counter(b.text for b in out)
    return [b._replace(repeats=times[b.text]) for b in out]


def merge_small(blocks: list[Block]) -> list[Block]:
    """Tiny blocks and lead-ins go to the front of the next body block, short ones to the end of the last of their kind, in one section."""
    out: list[Block] = []
    carried = ""
    for block, after in zip_longest(blocks, blocks[1:]):
        text = f"{carried}\n{block.text.strip()}".strip()
        carried = ""
        light = len(text) < TINY or (len(text) < SHORT and block.kind in BODY and text in LEADS)
        if light and after and after.kind in BODY and after.section == block.section:
            carried = text
        elif out and len(text) < SHORT and block.kind in BODY[:2] and (block.kind, block.section) == (out[-1].kind, out[-1].section):
            out[-1] = out[-1]._replace(text=f"{out[-1].text}\n{text}")
        else:
            out.append(block._replace(text=text))
    return out


def row_windows(table: str, size: int) -> Iterator[str]:
    """The rows of a table in windows of ``size`` characters (one row at least), each after the first under the first row."""
    head, *rows = table.split("\n")
    held = [head]
    for row in rows:
        if len(held) > 1 and sum(map(len, held)) + len(held) + len(row) > size:
            yield "\n".join(held)
            held = [head]
        held.append(row)
    yield "\n".join(held)


def assemble(blocks: list[Block], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, str, str | None]]:
    """(kind, text, section) of chunks: body blocks of one section up to ``size`` characters under their last headings; tables and
    oversized blocks alone. Headings that nothing follows make a chunk of their own."""
    out: list[tuple[str, str, str | None]] = []
    heads: list[str] = []
    held: list[str] = []
    place: str | None = None

    def flush() -> None:
        if held:
            out.append(("text", "\n".join(held), place))
            held.clear()

    for b in blocks:
        if b.kind == "heading":
            flush()
            heads = [*heads, b.text][-HEADS:]
            place = b.section
            continue
        parts = list(row_windows(b.text, size)) if b.kind == "table" else [b.text] if len(b.text) <= size else split_text(b.text, size, overlap)
        if b.kind == "table" or len(parts) > 1:
            flush()
            out += [("table" if b.kind == "table" else "text", "\n".join([*heads, p]), b.section) for p in parts]
            heads = []
            continue
        if held and (b.section != place or sum(map(len, held)) + len(held) + len(b.text) > size):
            flush()
        held += [*heads, b.text]
        heads, place = [], b.section
    flush()
    if heads:
        out.append(("text", "\n".join(heads), place))
    return out


def _arrays(f: Callable[[object], list[Block]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[b._asdict() for b in f(v)] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(BLOCK))], ["doc_id", "blocks"])

    return run


def typed_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, blocks of every document (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_arrays(parse), SCHEMA)


def clean(parsed: DataFrame) -> DataFrame:
    """doc_id, blocks without rules, noise, texts of less than two characters and texts that occur three times; small ones merged."""
    noise = lambda b: X.is_noise(b["text"]) | X.is_severe_noise(b["text"]) | X.is_template_noise(b["text"])
    kept = lambda b: (b["kind"] == "code") | ~((b["kind"] == "rule") | noise(b) | (F.length(b["text"]) < 2) | ((b["repeats"] >= REPEATED) & (b["kind"] != "heading")))
    return parsed.select("doc_id", F.filter("blocks", kept).alias("blocks")).mapInArrow(_arrays(lambda v: merge_small([Block(**b) for b in v or []])), SCHEMA)


def exploded(parsed: DataFrame) -> DataFrame:
    """doc_id, block_index, kind, text, level, section."""
    return parsed.select("doc_id", F.posexplode("blocks").alias("at", "b")).select(
        "doc_id", F.col("at").cast("long").alias("block_index"), F.col("b.kind").alias("kind"), F.col("b.text").alias("text"), F.col("b.level").alias("level"), F.col("b.section").alias("section")
    )


# fixed values: headings and list items of content that was stored as one text
STORED_HEADING = re.compile(r"第[一二三四五六七八九十百千万0-9]+[章节部分节]|[一二三四五六七八九十]+[、.．]|[0-9]+[.、]")
STORED_ITEM = re.compile(r"[-*•]\s+|[0-9]+[.)、]\s+")
JOINTS = ("：", ":", "；", ";", "，", ",")


def stored_blocks(content: str | None) -> list[Block]:
    """Blocks of a stored content without block records: Markdown and Chinese headings, list items, paragraphs between empty lines."""
    out: list[Block] = []
    path: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = "\n".join(held).strip()
        if text:
            out.append(Block("paragraph", text, None, " > ".join(path) or None))
        held.clear()

    for line in (raw.strip() for raw in (content or "").strip().splitlines()):
        marks = re.match(r"#{1,6}\s+", line)
        if marks or STORED_HEADING.match(line):
            close()
            title = line[marks.end() :].strip() if marks else line
            level = min(6, len(marks[0].strip())) if marks else stored_level(line)
            if title:
                path = [*path[: max(0, level - 1)], title]
                out.append(Block("heading", title, level, " > ".join(path)))
        elif not line or STORED_ITEM.match(line):
            close()
            if line:
                out.append(Block("list_item", line, None, " > ".join(path) or None))
        else:
            held.append(line)
    close()
    return out


def stored_level(line: str) -> int:
    """The level of a heading that is no Markdown, as :func:`vellum.functions.text.heading_level` has it."""
    if line.startswith("第"):
        return 1 if re.match(r"第[一二三四五六七八九十百千万0-9]+章", line) else 2 if re.match(r"第[一二三四五六七八九十百千万0-9]+节", line) else 1
    if re.match(r"[一二三四五六七八九十]+[、.．]", line):
        return 2
    return min(4, max(2, line.split(" ")[0].count(".") + 2))


def merge_short(blocks: list[Block], least: int = 80) -> list[Block]:
    """Adjacent paragraphs and list items of a section joined: two items, a short first, a much shorter second, or a first that ends in a joint."""
    out: list[Block] = []
    for block in blocks:
        last = out[-1] if out else None
        pair = last and last.section == block.section and {last.kind, block.kind} <= {"paragraph", "list_item"}
        short = pair and (last.kind == block.kind == "list_item" or len(last.text) < least or len(block.text) < max(20, least // 2) or last.text.endswith(JOINTS))
        if not block.text:
            continue
        if short:
            out[-1] = last._replace(text=f"{last.text}\n{block.text}")
        else:
            out.append(block)
    return out


def from_stored(docs: DataFrame, merged: bool = False) -> DataFrame:
    """doc_id, blocks of documents (doc_id, text) by :func:`stored_blocks`, short ones joined if ``merged``."""
    f = (lambda v: merge_short(stored_blocks(v))) if merged else stored_blocks
    return docs.select("doc_id", "text").mapInArrow(_arrays(f), SCHEMA)


def with_pages(parsed: DataFrame) -> DataFrame:
    """page_start and page_end of blocks (page_start, page_end, page, metadata: map): a missing start is the page, or that of the metadata; a
    missing end the start, or the metadata's end."""
    at = lambda key: X.to_int(F.col("metadata")[key])
    start = F.coalesce("page_start", "page")
    end = F.coalesce("page_end", start)
    return parsed.withColumns({"page_start": F.coalesce(start, at("page")), "page_end": F.coalesce(end, at("page_end"), start, at("page"))})


def grouped_content(parsed: DataFrame) -> DataFrame:
    """doc_id, content: texts by section, an empty line between two; a heading begins a group of its own."""
    joined = F.aggregate("blocks", F.struct(F.lit("").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(True).alias("first")), lambda acc, b: F.struct(
        F.concat(acc["t"], F.when(acc["first"], "").when((b["kind"] == "heading") | ~b["section"].eqNullSafe(acc["s"]), "\n\n").otherwise("\n"), X.strip(b["text"])).alias("t"),
        b["section"].alias("s"), F.lit(False).alias("first"),
    ), lambda acc: X.strip(acc["t"]))
    return parsed.select("doc_id", joined.alias("content"))


def content(parsed: DataFrame) -> DataFrame:
    """doc_id, content: texts of all blocks but headings, a line each."""
    body = F.filter("blocks", lambda b: b["kind"] != "heading")
    return parsed.select("doc_id", F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("content"))


def block_chunks(parsed: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, kind, chunk_text, section, chunk_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, at, *c) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for at, c in enumerate(assemble([Block(**b) for b in v or []], size, overlap))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "chunk_index", "kind", "chunk_text", "section"])

    made = parsed.mapInArrow(run, "doc_id long, chunk_index long, kind string, chunk_text string, section string")
    return made.withColumn("chunk_hash", F.md5("chunk_text"))
