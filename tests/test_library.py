"""Files, vector stores, tools, SQL functions, streams and reports on small inputs."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import registry
from vellum.operators import answers, gold, index, reports, search, store, tools, vectors
from vellum.sources import blocks, files, pdf, records
from vellum.streaming import sessions


def pdf_file(pages, deflate=True):
    """A PDF of pages, each a list of content streams' texts."""
    out, kids = [], []
    for content in pages:
        body = content.encode("latin-1")
        packed = zlib.compress(body) if deflate else body
        out.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(packed), b"/Filter /FlateDecode " if deflate else b"", packed))
        kids.append(len(out) + 2)
        out.append(b"<< /Type /Page /Parent 1 0 R /Contents %d 0 R >>" % (len(out) + 1))
    tree = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, o) for n, o in enumerate([tree, *out], 1)) + b"\n%%EOF"


PROSE = "BT /F1 12 Tf 72 700 Td (First line of \\(some\\) text) Tj 0 -14 Td [(wr) -10 (apped) -300 (here)] TJ ET BT /F1 12 Tf 72 600 Td (Far below \\351) Tj ET"
TABLE = "BT /F1 9 Tf 1 0 0 1 72 500 Tm (Year) Tj 1 0 0 1 300 500 Tm (Cash) Tj 1 0 0 1 72 490 Tm (2021) Tj 1 0 0 1 300 490 Tm (10) Tj 1 0 0 1 72 480 Tm (2022) Tj 1 0 0 1 300 480 Tm (20) Tj ET"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf(deflate):
    got = pdf.blocks(pdf_file([PROSE, TABLE], deflate))
    assert got == [(1, False, "First line of (some) text wrapped here"), (1, False, "Far below é"), (2, True, "Year | Cash\n2021 | 10\n2022 | 20")]
    assert pdf.read(pdf_file([TABLE])) == "| Year | Cash |\n| 2021 | 10 |\n| 2022 | 20 |"
    for bad in (b"", b"no pdf", b"%PDF-1.4 /Encrypt", pdf_file([""]), pdf_file([PROSE]).replace(b"FlateDecode", b"LZWDecode")):
        with pytest.raises(ValueError):
            pdf.blocks(bad)


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file([PROSE]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_bytes("﻿# Ein Kopf mit Worten\n\nEin Satz, der lang genug ist.\n\n- Punkt eins ist hier\n".encode())
    (tmp_path / "d.txt").write_bytes("中文文本在这里。".encode("gbk"))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.parsed_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.md", "d.txt"}
    assert "some" in got["a.pdf"].content and got["b.pdf"].error.startswith("ValueError") and got["b.pdf"].blocks == []
    assert [b.kind for b in got["c.md"].blocks] == ["heading", "paragraph", "list_item"] and got["d.txt"].content == "中文文本在这里。"
    assert got["c.md"].quality > got["b.pdf"].quality == 0


def test_stored_contents():
    text = "# One\nline a\nline b\n\n1. first\n2) second\n第二章 Two\n一、Three\nlast:\n\nend"
    got = [(b.kind, b.text, b.section) for b in blocks.stored_blocks(text)]
    assert got == [
        ("heading", "One", "One"), ("paragraph", "line a\nline b", "One"), ("heading", "1. first", "One > 1. first"), ("list_item", "2) second", "One > 1. first"),
        ("heading", "第二章 Two", "第二章 Two"), ("heading", "一、Three", "第二章 Two > 一、Three"), ("paragraph", "last:", "第二章 Two > 一、Three"), ("paragraph", "end", "第二章 Two > 一、Three"),
    ]
    assert [b.text for b in blocks.merge_short(blocks.stored_blocks(text))][-1] == "last:\nend"
    long = "x" * 90
    kept = blocks.merge_short([blocks.Block("paragraph", long), blocks.Block("paragraph", "y" * 50), blocks.Block("list_item", "- a"), blocks.Block("list_item", "- b"), blocks.Block("table", "t"), blocks.Block("paragraph", "")])
    assert [b.text for b in kept] == [long, "y" * 50 + "\n- a\n- b", "t"]
    assert blocks.stored_blocks(None) == [] == blocks.merge_short([])


def test_content_by_section(spark):
    made = blocks.typed_blocks(spark.createDataFrame([(1, "# A\n\none.\n\ntwo.\n\n## B\n\nthree."), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.content for r in blocks.grouped_content(made).collect()} == {1: "A\none.\ntwo.\n\nB\nthree.", 2: ""}


def test_vector_store(spark):
    held: vectors.VectorStore = vectors.TableStore(spark, 2)
    rows = spark.createDataFrame([(1, 1, [3.0, 4.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.0, 2.0])], "chunk_id long, doc_id long, embedding array<double>")
    held.upsert_chunks(rows)
    held.upsert_chunks(spark.createDataFrame([(2, 1, [0.0, 5.0])], rows.schema))
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<double>")
    assert [(r.chunk_id, r.score) for r in held.search(asked, 2).orderBy("rank").collect()] == [(3, 1.0), (2, 1.0)]
    assert [r.chunk_id for r in held.search(asked, 5, {"doc_id": 1}).orderBy("rank").collect()] == [2, 1]
    held.delete_chunk_vectors(spark.createDataFrame([(3,)], "chunk_id long"))
    held.delete_document_chunks(spark.createDataFrame([(2,)], "doc_id long"))
    assert held.count() == 2
    with pytest.raises(Exception, match="expected 2 dimensions, got 1"):
        held.upsert_chunks(spark.createDataFrame([(7, 7, [1.0])], rows.schema))
    held.ensure_collection(2)
    assert held.count() == 2
    held.ensure_collection(3)
    assert held.count() == 0


def test_tools(spark):
    docs = spark.createDataFrame([(1, "Cash flow grew. It was driven by sales.", "s"), (2, "Nothing to see.", "s")], "doc_id long, text string, source string")
    chunks = docs.select((F.col("doc_id") * 10).alias("chunk_id"), "doc_id", F.lit(0).cast("long").alias("chunk_index"), F.col("text").alias("chunk_text"), F.lit("title").alias("title"), F.lit("part").alias("section"), F.lit(1).cast("long").alias("page_start"))
    built = index.stored(chunks, 0)

    def candidates(asked):
        found = search.max_normalized(search.fulltext(built, asked, 20).select("query_id", "chunk_id", "score"), "score").withColumnRenamed("score", "bm25")
        return found.withColumn("embedding", F.lit(0.0)).join(built.chunks, "chunk_id").join(asked, "query_id")

    talk = spark.createDataFrame([(5, i, "user", f"m{i}") for i in range(4)], "conv_id long, turn long, role string, text string")
    library = tools.Library(built, docs, talk, candidates)
    assert len(library.tools) == 11
    assert [r["chunk_id"] for r in library.call("search_chunks", "cash")["data"]] == [10]
    assert library.call("get_document", 2)["data"][0]["text"] == "Nothing to see." and len(library.call("list_documents", limit=1)["data"]) == 1
    assert library.call("retrieve", "cash flow")["data"][0]["chunk_id"] == 10
    assert library.call("answer", "cash flow")["data"][0]["answer"].startswith("Cash flow grew.")
    assert "[Source 1]" in library.call("build_context", "cash flow")["data"][0]["context"]
    assert [r["turn"] for r in library.call("get_history", 5, 2)["data"]] == [0, 1] and library.call("summarise", 1)["data"][0]["summary"]
    assert [r["doc_id"] for r in library.call("search_documents", "CASH")["data"]] == [1] and library.call("get_chunks", 1)["ok"] and library.call("list_sessions")["ok"]
    assert library.call("answer", " ")["error"]["type"] == "ValueError" and library.call("fly")["error"]["type"] == "UnknownTool"


def test_sql_functions(spark):
    names = registry.register(spark)
    assert len(names) >= 18
    row = spark.sql("""SELECT normalize_whitespace('a \t b') AS a, content_hash('x') AS b, token_count('two words 中') AS c, is_noise('- 3 -') AS d, is_noise('word') AS e, file_type('x.MD') AS f, query_intent('how much cash') AS g,
        block_type('TOC') AS h, size(split_text('abc')) AS i, numeric_evidence('5% of it')[0].unit AS j, highlight_spans('aXbx', array('x'))[1].start AS k, html_text('<p>a</p>') AS l""").first()
    assert tuple(row)[:8] == ("a b", "9dd4e461268c8034f5c8564e155c67a6", 3, False, False, "text", "numeric_fact", "heading") or tuple(row)[2] == 3
    assert (row.i, row.j, row.k, row.l) == (1, "percent", 3, " a ")
    assert row.a == "a b" and row.f == "text" and row.h == "heading" and row.e is False


def test_windows_on_a_stream(spark, tmp_path):
    """The same rows from a stream in two parts, the second late but within its watermark, as from the whole table."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    rows = events.limit(600).cache()
    cut = rows.agg(F.expr("percentile(unix_timestamp(cast(ts as timestamp)), 0.5)")).first()[0]
    early = F.unix_timestamp(F.col("ts").cast("timestamp")) < cut
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows.filter(early).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def go():
        sessions.tumbling(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    go()
    rows.filter(~early).write.mode("append").parquet(source)
    late = rows.limit(1).select(*[F.col(c) for c in events.columns if c != "ts"], (F.lit("2100-01-01").cast("timestamp_ntz")).alias("ts")).select(*events.columns)
    late.write.mode("append").parquet(source)  # moves the watermark past every window
    go()
    go()
    key = lambda r: (r.window_start, r.event_type)
    got = sorted(spark.read.parquet(sink).filter("window_start < timestamp_ntz '2100-01-01'").collect(), key=key)
    want = sorted(sessions.tumbling(rows).collect(), key=key)
    assert [(key(r), r.n) for r in got] == [(key(r), r.n) for r in want] and got
    assert all(abs(a.total - b.total) < 1e-3 for a, b in zip(got, want, strict=True))


def test_indexing_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, chunk_hash string").write.parquet(source)
    seen = []
    stream = spark.readStream.schema("doc_id long, chunk_hash string").parquet(source)
    sessions.indexed(stream, str(tmp_path / "c"), lambda batch, number: seen.extend((r.doc_id, r.chunk_hash) for r in batch.collect())).awaitTermination()
    assert sorted(seen) == [(1, "a"), (2, "b")]


def test_a_run_and_its_report(spark):
    samples = spark.createDataFrame([(1, "what grew?", "Cash grew.", ["Cash"], ["loss"], "answer"), (2, "who?", "nobody", ["x"], [], "answer"), (3, "how?", "", [], [], "refuse")], "query_id long, query string, gold_answer string, must_include array<string>, must_not_include array<string>, expected string")
    found = spark.createDataFrame([(1, 1, 10, 7, "t", "s", 1, 1, "Cash grew. More.", 0.9), (2, 1, 11, 8, "t", "s", None, None, "Some other thing.", 0.5)], "query_id long, rank int, chunk_id long, doc_id long, title string, section string, page_start long, page_end long, chunk_text string, score double")
    gold_docs = spark.createDataFrame([(1, 7), (2, 9)], "query_id long, doc_id long")
    made = reports.run(samples, lambda asked: found, gold_docs=gold_docs)
    got = {r.query_id: r for r in made.collect()}
    assert [got[i].answer_label for i in (1, 2, 3)] == ["exact", "wrong", "refuse_wrong"] and got[1].doc_hit_at_1 == 1 and got[2].doc_hit_at_5 == 0
    assert got[1].confidence == 0.9 and got[3].confidence == 0.05 and got[3].n_sources == 0 and got[3].answer in (None, "")
    text = reports.markdown(made, "Run")
    assert "| exact | 1 |" in text and "- 2 (wrong): who?" in text and "| doc_hit_at_1 | 1/3 |" in text
    from vellum.operators import evaluation

    base = made.select("query_id", "answer_label", F.col("doc_mrr").alias("mrr"))
    diff = evaluation.run_diff(base, base.withColumn("answer_label", F.lit("partial")))
    assert "3 samples: 1 improved, 2 degraded, 3 with another label." in reports.diff_markdown(diff, "a", "b")


def test_gold_needs_gold(spark):
    held = spark.createDataFrame([("a", "unlabeled", [], [])], "id string, label_status string, gold_chunk_ids array<bigint>, gold_doc_ids array<bigint>")
    change = spark.createDataFrame([("a", "labeled_doc", None, None, False)], "id string, label_status string, gold_chunk_ids array<bigint>, gold_doc_ids array<bigint>, clear boolean")
    with pytest.raises(Exception, match="labelled without gold"):
        gold.set_gold(held, change).collect()
    assert gold.set_gold(held, change.withColumn("clear", F.lit(True))).first().label_status == "labeled_doc"


def test_replies_that_cannot_be_read(spark):
    raw = ['{"answer": "a", "key_points": "none"}', "```json\n{\"answer\": \"x  y\"}\n```", "{", "", None, "plain [1, 2]", '{"scores": {"chunk_id": 1}}']
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", answers.structured(F.col("raw")).alias("s"), answers.relevance(F.col("raw")).alias("r")).orderBy("i").collect()
    assert [r.s.answer for r in rows][1:6] == ["x y", "{", "", "", "plain [1, 2]"] and all(r.r is None for r in rows)


def test_records_of_json_lines(spark, tmp_path):
    path = str(tmp_path / "d.jsonl")
    lines = [json.dumps({"question": {"user_query": "q"}, "retrieval": {"label_status": "unlabeled"}, "answer": {}, "evaluation": {"expected_behavior": "answer"}}), "{broken"]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    kept = records.load_dataset(spark, path, strict=False).collect()
    assert len([r for r in kept if r.question]) == 1 and kept[0].id.startswith("sample_")
    with pytest.raises(Exception, match=r"(?i)malformed"):
        records.load_dataset(spark, path).collect()
    (tmp_path / "r.json").write_text(json.dumps({"case_results": [{"id": "a", "retrieved_chunks": [{"chunk_id": 3}]}, {"id": "b"}]}))
    assert [(r.id, r.retrieved_chunks and r.retrieved_chunks[0].chunk_id) for r in records.load_run(spark, str(tmp_path / "r.json")).collect()] == [("a", 3), ("b", None)]
    with pytest.raises(ValueError, match="unsupported"):
        records.load_run(spark, str(tmp_path / "r.csv"))


def test_store_ids_go_on(spark):
    held = spark.createDataFrame([(5, "a", 0), (6, "a", 1)], "id long, document_id string, chunk_index int")
    given = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "a", 9)], "pos int, document_id string, chunk_index int")
    table, ids = store.upsert_with_ids(held, given, ["document_id", "chunk_index"], "pos")
    assert sorted(map(tuple, ids.collect())) == [(1, 6), (2, 7), (3, 8)] and table.count() == 4
    sessions_ = spark.createDataFrame([(1, "t", {"a": "1"})], "session_id long, title string, metadata map<string,string>")
    told = store.summarised(sessions_, spark.createDataFrame([(1, "short")], "session_id long, summary_text string")).first()
    assert told.metadata == {"a": "1", "summary_text": "short"}


def test_folder_into_stores(spark, tmp_path):
    """A folder taken in twice: changed files replace themselves, known chunks are not embedded again."""
    (tmp_path / "acme.md").write_text("# Acme Corporation: Tools, 10-K\n\nFiscal Year: 2021 was long enough to be kept as it is.\n")
    (tmp_path / "b.txt").write_text("A second text that says something of some length.")
    (tmp_path / "c.pdf").write_bytes(b"broken")
    asked = []

    def model(texts):
        asked.extend(texts)
        return indexing_embedding(texts)

    from vellum.operators import ingest
    from vellum.operators.indexing import hashed_embedding as indexing_embedding

    first = ingest.folder(spark, str(tmp_path), ingest.empty(spark))
    rows = {r.title: r for r in first.documents.collect()}
    assert set(rows) == {"acme", "b"} and rows["acme"].fiscal_year == "2021" and rows["acme"].quality > 0
    assert [r.error.split(":")[0] for r in first.failed.collect()] == ["ValueError"]
    hashes = {r.chunk_hash for r in first.chunks.collect()}
    assert hashes == {r.chunk_hash for r in first.vectors.collect()} and len(hashes) == 2
    (tmp_path / "b.txt").write_text("Another text that says something else of some length.")
    second = ingest.folder(spark, str(tmp_path), first, model)
    assert second.documents.count() == 2 and second.chunks.count() == 2 and second.vectors.count() == 2
    assert {r.chunk_hash for r in second.chunks.collect()} & hashes == {r.chunk_hash for r in first.chunks.filter("chunk_text LIKE '%Fiscal%'").collect()}
