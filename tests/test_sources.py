"""Files, blocks, tables, spans and indexing on small hand-made inputs."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions import spans, tables
from vellum.operators import indexing
from vellum.plans import catalog
from vellum.sources import blocks, chunking, files

SMALL = "/root/testdata/sf0.001"
MARKDOWN = """# Top

First line
wrapped on.
## Part one
- item a
- item b
> quoted

```python
x = 1
  y = 2
```

| a | b |
| --- | --- |
| 1 | 2 |
第1章 开始
Tail"""


def test_parse_markdown():
    got = [(b.kind, b.text, b.level, b.section) for b in blocks.parse(MARKDOWN)]
    assert got == [
        ("heading", "Top", 1, "Top"), ("paragraph", "First line wrapped on.", None, "Top"), ("heading", "Part one", 2, "Top > Part one"),
        ("list_item", "- item a", None, "Top > Part one"), ("list_item", "- item b", None, "Top > Part one"), ("quote", "quoted", None, "Top > Part one"),
        ("code", "x = 1\n  y = 2", None, "Top > Part one"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |", None, "Top > Part one"),
        ("heading", "开始 Tail", 1, "开始 Tail"),
    ]
    assert blocks.parse(None) == [] and blocks.parse("") == []
    assert blocks.parse("```\nopen")[0].text == "open"


def test_clean_and_chunks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "----\n\nPage 3\n\n" + "same line here.\n\n" * 3 + "Kept sentence of some length, long enough.")], "doc_id long, text string")
    parsed = blocks.clean(blocks.typed_blocks(docs))
    kept = {r.doc_id: r.content for r in blocks.content(parsed).collect()}
    assert kept[2] == "" and kept[3] == "Kept sentence of some length, long enough."
    assert "x = 1\n  y = 2" in kept[1]
    chunks = blocks.block_chunks(parsed).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert [c.kind for c in chunks].count("table") == 1 and any(c.chunk_text.startswith("Top\n") for c in chunks)


def test_row_windows_lose_no_row():
    rows = [f"{i} | {i * i}" for i in range(200)]
    windows = list(blocks.row_windows("\n".join(["n | square", *rows]), 100))
    assert [r for w in windows for r in w.split("\n")[1:]] == rows
    assert all(len(w) <= 100 and w.startswith("n | square") for w in windows)


def test_tables(spark):
    text = "单位：万元\n | 2020 | 2021\nIncome | 1.5 | 20%\nCost | 3 | "
    df = spark.createDataFrame([(text,), ("",)], "t string").withColumn("p", tables.rows(F.col("t")))
    one, none = df.select("p", tables.metadata(F.col("t"), F.col("p")).alias("m"), tables.linear_rows(F.col("p")).alias("l")).collect()
    assert one.p[2] == ["Income", "1.5", "20%"] and one.m.units == "万元" and one.m.years == ["2020", "2021"] and one.m.percent and one.m.n_rows == 4
    assert none.p == [] and none.m.n_rows == 0 and none.l == []


def test_spans_and_numbers():
    assert spans.spans("abcABCd", ["bc", "ca", ""]) == [{"start": 1, "end": 6, "text": "bcABC"}]
    assert spans.spans(None, ["a"]) == [] and spans.spans("a", None) == []
    found = {(n["unit"], n["raw"].strip(), n["value"]) for n in spans.numbers("grew 12.5% to $1,200 million ,")}
    assert ("percent", "12.5%", 12.5) in found and ("dollar", "$1,200 million", None) in found and ("ratio", ",", None) in found


def test_folder(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Said </w:t><w:t>so</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
    below = tmp_path / "below"
    below.mkdir()
    for name, data in {"a.txt": "﻿ hello ".encode(), "b.md": "中文内容".encode("gbk"), "c.docx": made.getvalue(), "d.docx": b"broken", "e.pdf": b"%PDF", "f.xyz": b"?"}.items():
        (below / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hello" and got["b.md"].text == "中文内容" and got["c.docx"].text == "## Head\n\nSaid so\n\n| 1 |  |"
    assert got["d.docx"].text is None and "BadZipFile" in got["d.docx"].error and got["e.pdf"].error == "ValueError: no text in the PDF file"
    assert got["f.xyz"].text is None and got["f.xyz"].error == "no reader for unknown files"


def test_index_embeds_only_new(spark):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, chunk_index int, chunk_text string, chunk_hash string")
    held = rows((1, 0, "a b", "h1"), (2, 0, "c", "h2"), (3, 0, "d", "h3"))
    old = indexing.embed(held)
    chunks, vectors = indexing.index(held, old, rows((1, 0, "e", "h4"), (1, 1, "c", "h2"), (3, 0, None, None)))
    assert sorted((r.doc_id, r.chunk_hash) for r in chunks.collect()) == [(1, "h2"), (1, "h4"), (2, "h2")]
    assert sorted(r.chunk_hash for r in vectors.collect()) == ["h2", "h4"]
    assert abs(sum(x * x for x in old.filter("chunk_hash = 'h1'").first().embedding) - 1) < 1e-6


@pytest.mark.parametrize("name", ["table_linearize", "content_hash", "url_scan", "doc_list", "session_summary_trigger", "index_incremental"])
def test_new_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ["documents", "pages", "conversations", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(catalog.ORACLES[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["text_parser_blocks", "block_clean", "block_content", "block_chunks", "numeric_evidence", "highlight_spans"])
def test_new_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_chunking_reads_the_words_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a " * 81, "en", "c"), (2, " \n", "en", "c"), (3, None, "en", "c"), (4, "", "en", "c")], "doc_id long, text string, lang string, source string")
    made = chunking.word_windows(docs)
    assert made._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert [(r.doc_id, r.chunk_index, len(r.chunk_text)) for r in made.orderBy("chunk_id").collect()] == [(1, 0, 159), (1, 1, 1)]
