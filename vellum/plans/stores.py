"""Documents, chunks, vectors and chats kept in tables, and records read and written, each with SQL for the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import search, store
from vellum.plans.catalog import BM25, CHUNKS, chunk_table, index, query, questions, retrieved, stored_vectors, table, tidy_sql
from vellum.sources import records, scratch


@query(f"WITH {CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY doc_id, chunk_index, chunk_id) AS place FROM chunks")
def all_chunks(spark, sf_dir):
    """Every chunk by document and index, with its place in that order."""
    return store.numbered_rows(chunk_table(spark, sf_dir).select("chunk_id"), "chunk_id").select("chunk_id", F.col("_at").cast("long").alias("place"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def doc_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_index, section, coalesce(title, '') AS title FROM chunks WHERE chunk_id = 17 * 16777216")
def chunk_lookup(spark, sf_dir):
    return index(spark, sf_dir).chunks.filter(F.col("chunk_id") == F.lit(17 << 24)).select("chunk_id", "chunk_index", "section", X.blank(F.col("title")).alias("title"))


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_index, page_start, section, md5(chunk_text) AS chunk_hash FROM chunks WHERE doc_id = 17")
def document_chunks(spark, sf_dir):
    """The chunks of one document, in order."""
    own = chunk_table(spark, sf_dir).filter("doc_id = 17")
    return own.select("chunk_id", "chunk_index", "page_start", "section", F.md5("chunk_text").alias("chunk_hash")).orderBy("chunk_index")


@query("""WITH n AS (SELECT doc_id, lang, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY doc_id) AS id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) SELECT doc_id AS id, lang FROM documents UNION ALL SELECT id, lang FROM n""")
def insert_documents(spark, sf_dir):
    """Toxic documents inserted once more: equal contents get new ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    again = docs.join(toxic, "id").withColumnRenamed("id", "was")
    return store.insert(docs, again, "id", "was").select("id", "lang")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'xx' ELSE d.lang END AS lang, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE d.source END AS source, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_documents(spark, sf_dir):
    """Labelled documents take a new source, good ones a new language; a column that may not be set keeps its value."""
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "xx").alias("lang"), F.lit("label").alias("source"), F.lit(-1).cast("long").alias("n_chars"))
    return store.update(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), changes, "doc_id")


@query("""WITH h AS (SELECT doc_id AS id, doc_id AS document_id, 0 AS chunk_index FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id AS pos, doc_id AS document_id, 0 AS chunk_index FROM documents WHERE doc_id % 2 = 0)
    SELECT c.pos, coalesce(h.id, (SELECT max(id) FROM h) + row_number() OVER (PARTITION BY h.id IS NULL ORDER BY pos)) AS id FROM c LEFT JOIN h USING (document_id, chunk_index)""")
def insert_chunks_batch(spark, sf_dir):
    """Ids of a batch of chunks in the order given: a third of them are known."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    held = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    changes = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    return store.upsert_with_ids(held, changes, ["document_id", "chunk_index"], "pos")[1]


@query("SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6)::DOUBLE AS norm FROM embeddings")
def upsert_vectors(spark, sf_dir):
    made = store.vectors_checked(stored_vectors(spark, sf_dir), 64)
    return made.select("chunk_id", F.round(search.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE label <> 3 AND vec_id NOT IN (SELECT item_id FROM benchmark)")
def delete_vectors(spark, sf_dir):
    """Vectors left when those of a label and those of a list of ids go."""
    left = stored_vectors(spark, sf_dir).filter("label <> 3")
    return store.delete(left, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id")), "chunk_id").select("chunk_id")


@query("SELECT 64 AS dim, count(*) AS n FROM embeddings UNION ALL SELECT 768, 0")
def ensure_collection(spark, sf_dir):
    """The collection asked for with its own dimension and with another."""
    vectors = stored_vectors(spark, sf_dir)
    count = lambda dim: store.ensure_dimension(vectors, dim).agg(F.lit(dim).alias("dim"), F.count("*").alias("n"))
    return count(64).unionByName(count(768))


@query("SELECT count(*) * 0 AS n FROM documents")
def reset_tables(spark, sf_dir):
    return store.emptied(table(spark, sf_dir, "documents")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS title, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS content, text AS raw_text, 'a/b.c/doc-' || doc_id || '.md' AS source_path, lang FROM documents)
    SELECT doc_id, coalesce(nullif({tidy_sql("coalesce(nullif(title, ''), 'doc-' || doc_id)")}, ''), 'Untitled') AS title, md5({tidy_sql("coalesce(nullif(content, ''), raw_text)")}) AS content_hash, md5({tidy_sql('raw_text')}) AS raw_hash, source_path AS file_path, nullif({tidy_sql('lang')}, '') AS lang, 'x|y' AS tags, CASE WHEN doc_id % 2 = 0 THEN '2021/03/04' END AS published FROM d""")
def document_payload(spark, sf_dir):
    i = F.col("doc_id")
    parsed = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 3 == 0, F.col("source")).alias("title"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("content"), F.col("text").alias("raw_text"), F.concat(F.lit("a/b.c/doc-"), i.cast("string"), F.lit(".md")).alias("source_path"),
        F.lit("text").alias("file_type"), "lang", F.lit(" ").alias("author"), F.when(i % 2 == 0, "2021/03/04").otherwise("some day").alias("published_at"), F.lit("x, ,y").alias("tags"),
    )
    return store.payload(parsed).select("doc_id", "title", "content_hash", F.md5("raw_text").alias("raw_hash"), "file_path", "lang", F.array_join("tags", "|").alias("tags"), F.date_format("published_at", "yyyy/MM/dd").alias("published"))


# --- chats

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)
SESSIONS = """held AS (SELECT conv_id AS session_id, 't' || conv_id AS title, CASE WHEN conv_id % 2 = 0 THEN 'u' END AS user_id, TIMESTAMP '2024-01-01' + to_minutes(max(turn)) AS last_message_at FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id),
    fresh AS (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 5 > 0 THEN 'new' END AS title, 'v' AS user_id FROM conversations WHERE conv_id % 3 > 0)"""


def held_sessions(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("conv_id % 3 < 2").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("m"))
    last = F.timestamp_micros(F.lit(1704067200000000) + F.col("m") * 60000000).cast("timestamp_ntz")
    return turns.select("session_id", F.concat(F.lit("t"), F.col("session_id").cast("string")).alias("title"), F.when(F.col("session_id") % 2 == 0, "u").alias("user_id"), last.alias("last_message_at"))


def fresh_sessions(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").filter("conv_id % 3 > 0").select(F.col("conv_id").alias("session_id")).distinct()
    return ids.select("session_id", F.when(F.col("session_id") % 5 > 0, "new").alias("title"), F.lit("v").alias("user_id"))


@query(f"WITH {SESSIONS} SELECT coalesce(h.session_id, f.session_id) AS session_id, coalesce(f.title, h.title) AS title, coalesce(f.user_id, h.user_id) AS user_id, strftime(CASE WHEN h.session_id IS NOT NULL AND f.session_id IS NOT NULL THEN TIMESTAMP '2024-05-06 07:08:09' ELSE h.last_message_at END, '%Y-%m-%d %H:%M') AS last FROM held h FULL JOIN fresh f USING (session_id)")
def session_upsert(spark, sf_dir):
    made = store.create_sessions(held_sessions(spark, sf_dir), fresh_sessions(spark, sf_dir), NOW)
    return made.select("session_id", "title", "user_id", F.date_format("last_message_at", "yyyy-MM-dd HH:mm").alias("last"))


@query(f"WITH {SESSIONS} SELECT session_id, row_number() OVER (ORDER BY last_message_at DESC, session_id)::INTEGER AS place FROM held QUALIFY place <= 10")
def session_list(spark, sf_dir):
    """The ten sessions of the latest messages (a top-k report)."""
    from pyspark.sql import Window

    recent = store.recent_sessions(held_sessions(spark, sf_dir), 10)
    return recent.select("session_id", F.row_number().over(Window.orderBy(F.desc("last_message_at"), "session_id")).alias("place"))


@query(f"WITH {SESSIONS}, new AS (SELECT conv_id AS session_id, max(TIMESTAMP '2024-01-01' + to_minutes(turn * 3)) AS c FROM conversations WHERE conv_id % 4 = 0 GROUP BY 1) SELECT session_id, strftime(greatest(last_message_at, coalesce(c, last_message_at)), '%Y-%m-%d %H:%M') AS last FROM held LEFT JOIN new USING (session_id)")
def message_insert(spark, sf_dir):
    """Sessions after new messages: their last message moves up."""
    sessions = held_sessions(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").filter("conv_id % 4 = 0")
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("turn") * 180000000).cast("timestamp_ntz")
    new = turns.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("message"), at.alias("created_at"))
    moved, _ = store.add_messages(sessions, new.limit(0), new)
    return moved.select("session_id", F.date_format("last_message_at", "yyyy-MM-dd HH:mm").alias("last"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def message_history(spark, sf_dir):
    """The oldest four messages of each conversation, as the store reads them."""
    return store.messages_of(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 > 0")
def session_delete(spark, sf_dir):
    """Messages left when every fifth session is deleted."""
    turns = table(spark, sf_dir, "conversations")
    return store.delete(turns, turns.filter("conv_id % 5 = 0"), "conv_id").select("conv_id", "turn")


@query("SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'a=1;summary_text=short' WHEN conv_id % 3 = 0 THEN 'a=1;summary_text=old' ELSE 'a=1' END AS metadata FROM conversations")
def session_summary(spark, sf_dir):
    """A summary put into a session's metadata leaves the rest of it."""
    i = F.col("conv_id")
    had = F.when(i % 3 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("summary_text"), F.lit("old"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    sessions = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(i.alias("session_id"), had.alias("metadata"))
    made = store.summarised(sessions, sessions.filter("session_id % 2 = 0").select("session_id", F.lit("short").alias("summary_text")))
    return made.select("session_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


# --- merges


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE d.lang END AS name FROM documents d FULL JOIN labels l USING (doc_id)")
def union_first_wins(spark, sf_dir):
    parts = [table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("name")), table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"))]
    return store.first_wins(parts, ["doc_id"])


@query(f"""WITH {BM25}, a AS (SELECT query_id, chunk_id, score, 'fulltext' AS src, rank AS n FROM ranked WHERE rank <= 10), b AS (SELECT query_id, chunk_id, score / 2 AS score, 'again' AS src, 2 AS n FROM ranked WHERE rank BETWEEN 6 AND 15)
    SELECT query_id, chunk_id, round(max(score), 8) AS score, min_by(src, CASE src WHEN 'fulltext' THEN 0 ELSE 1 END) AS src, sum(CASE WHEN src = 'fulltext' THEN 1 ELSE n END)::BIGINT AS cash, coalesce(sum(n) FILTER (src = 'fulltext'), 0)::BIGINT AS ranked FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def merge_hits(spark, sf_dir):
    """Two recalls that overlap: best scores, first columns, counts of terms added up."""
    found = search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 15)
    hits = lambda *pairs: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(F.lit(v).cast("long") if isinstance(v, int) else v for _, v in pairs)))
    first = found.filter("rank <= 10").select("query_id", "chunk_id", "score", F.lit("fulltext").alias("src"), hits(("cash", 1), ("ranked", F.col("rank").cast("long"))).alias("term_hits"))
    again = found.filter("rank >= 6").select("query_id", "chunk_id", (F.col("score") / 2).alias("score"), F.lit("again").alias("src"), hits(("cash", 2)).alias("term_hits"))
    made = search.merge_hits([first, again], ["score"], ["src"])
    return made.select("query_id", "chunk_id", F.round("score", 8).alias("score"), "src", F.col("term_hits")["cash"].alias("cash"), F.coalesce(F.col("term_hits")["ranked"], F.lit(0)).alias("ranked"))


@query(f"WITH {BM25}, h AS (SELECT query_id, chunk_id, score FROM ranked WHERE rank <= 10) SELECT query_id, h.chunk_id, score, c.doc_id, c.chunk_index FROM h JOIN chunks c USING (chunk_id)")
def hydrate_hits(spark, sf_dir):
    """Hits that are there twice, with their chunks."""
    found = search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 10)
    twice = found.unionByName(found.withColumn("score", F.col("score") / 2))
    return search.hydrate(twice, index(spark, sf_dir).chunks).select("query_id", "chunk_id", "score", "doc_id", "chunk_index")


# --- records as JSON lines


def written(df: DataFrame, name: str) -> str:
    path = scratch.path_of(df.sparkSession, name)
    records.write_jsonl(df, path)
    return path


def dataset(spark, sf_dir) -> DataFrame:
    """The questions as samples of a dataset; every fifth has a flaw."""
    i = F.col("item_id")
    status = F.when(i % 5 == 1, "labeled_doc").when(i % 5 == 2, "odd").otherwise("unlabeled")
    return table(spark, sf_dir, "benchmark").select(
        F.when(i % 10 == 3, "same").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("id"), F.struct(F.when(i % 5 == 4, " ").otherwise(F.col("text")).alias("user_query")).alias("question"),
        F.struct(status.alias("label_status"), F.when(i % 2 == 0, F.array(i)).otherwise(F.array().cast("array<bigint>")).alias("gold_doc_ids"), F.array().cast("array<bigint>").alias("gold_chunk_ids")).alias("retrieval"),
        F.when(i % 7 > 0, F.struct(F.col("text").alias("gold_answer"))).alias("answer"), F.struct(F.when(i % 3 == 0, "sing").otherwise("answer").alias("expected_behavior")).alias("evaluation"),
    )


@query("""WITH e AS (SELECT item_id AS i, CASE WHEN item_id % 10 = 3 THEN 'same' ELSE 'q' || item_id END AS id FROM benchmark), r AS (SELECT id, (i % 7 = 0)::INT + (i % 5 = 4)::INT + (i % 5 = 1 AND i % 2 = 1)::INT + (i % 5 = 2)::INT + (i % 3 = 0)::INT AS n FROM e)
    SELECT id, (sum(n) + count(*) - 1)::BIGINT AS n_errors FROM r GROUP BY id""")
def dataset_validate(spark, sf_dir):
    """A dataset written as JSON lines, read back and checked."""
    read = records.load_dataset(spark, written(dataset(spark, sf_dir), "dataset"))
    return records.validate(read).groupBy("id").agg(F.sum(F.size("errors")).alias("n_errors"))


@query("SELECT 'd' || doc_id % 20 AS doc_name, 'c' || max(doc_id) AS company FROM documents GROUP BY 1")
def doc_info_scan(spark, sf_dir):
    """Document information with broken lines; the last line of a name counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id")
    line = F.to_json(F.struct(F.concat(F.lit("d"), (F.col("doc_id") % 20).cast("string")).alias("doc_name"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("company")))
    path = scratch.path_of(spark, "doc-info")
    docs.select(F.explode(F.array(line, F.lit("{broken"), F.lit('{"doc_name": ""}'))).alias("value")).write.text(path)
    return records.load_doc_info(spark, path).select("doc_name", "company")


@query(f"""WITH {BM25}, g AS (SELECT query_id, count(*) AS n, arg_min(chunk_id, rank) AS best FROM ranked WHERE rank <= 10 GROUP BY 1) SELECT 'q' || query_id AS id, n, best FROM g""")
def run_scan(spark, sf_dir):
    """A run written as JSON lines and read back."""
    found = retrieved(spark, sf_dir)
    chunks = F.sort_array(F.collect_list(F.struct("rank", F.struct("chunk_id", F.col("doc_id").alias("document_id")).alias("c"))))
    run = found.groupBy("query_id").agg(chunks.alias("l")).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), F.col("l")["c"].alias("retrieved_chunks"))
    path = scratch.path_of(spark, "run") + ".jsonl"
    records.write_jsonl(run, path)
    read = records.load_run(spark, path)
    return read.select("id", F.size("retrieved_chunks").cast("long").alias("n"), F.col("retrieved_chunks")[0]["chunk_id"].alias("best"))


