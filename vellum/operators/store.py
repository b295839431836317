"""Tables of documents, chunks and chats: lookups, upserts, deletes, hash diffs. Plain Parquet has no MERGE, so changes give a new frame to be written to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.sources.scratch import keep


def like_search(docs: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows with the keyword in any column, whatever the case; % and _ keep their meaning."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False))
    return docs.filter(found)


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows in the order of first appearance of their ids (id, pos); missing ids are dropped."""
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return table.join(first, F.col(key) == F.col("id")).drop("id").orderBy("pos")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows in place of those with their keys, new ones added; columns that changes lack become null."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def coalesce_upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """As :func:`upsert`, but null changes leave the old value."""
    old, new = table.alias("old"), changes.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    return joined.select(*(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) if c in changes.columns else F.col(f"old.{c}") for c in table.columns))


#: Columns of documents that an update may set.
UPDATABLE = ["title", "content", "raw_text", "file_path", "file_type", "source_type", "lang", "source", "author", "published_at", "content_hash", "block_count", "blocks_json", "metadata_json", "tags_json", "text", "created_at", "updated_at"]


def update(table: DataFrame, changes: DataFrame, key: str, allowed: list[str] = UPDATABLE) -> DataFrame:
    """Rows of ``table`` with the non-null values of ``changes`` in allowed columns; changes to unknown keys or other columns are left out."""
    named = [c for c in changes.columns if c in allowed and c in table.columns]
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in named))
    met = table.join(new, F.col(key) == F.col("_key"), "left")
    return met.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in named}).select(*table.columns)


def insert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` and ``rows`` after it, whose ids go on from the largest by ``order``. Equal contents may be there twice."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    numbered = numbered_rows(rows, order).join(F.broadcast(last)).withColumn(key, F.col("_last") + F.col("_at")).drop("_last", "_at")  # one row
    return table.unionByName(numbered, allowMissingColumns=True)


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with _at, their place from 1 by ``order``: ranks within ranges of that column, moved up by the rows of the ranges before, so no
    task numbers all."""
    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ranged = keep(ranged, "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return ranged.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order))).drop("_part", "_before")


def upsert_with_ids(table: DataFrame, changes: DataFrame, keys: list[str], order: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The upserted table, and (order, id) of the changes as they were given: known keys keep their ids, new ones go on from the largest."""
    known = changes.join(table.select(*keys, key), keys, "left")
    fresh = insert(table.select(key).limit(0), known.filter(F.col(key).isNull()).drop(key), key, order)
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    fresh = fresh.join(F.broadcast(last)).withColumn(key, F.col(key) + F.col("_last")).drop("_last")
    whole = keep(known.filter(F.col(key).isNotNull()).unionByName(fresh), "upserted")
    return upsert(table, whole.select(*table.columns), keys), whole.select(order, key)


def vectors_checked(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Vectors at unit length; one of another dimension ends the job."""
    from vellum.operators.search import l2_normalized

    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))).cast("array<double>")
    return vectors.withColumn(vector, F.when(F.size(vector) == dim, l2_normalized(F.col(vector))).otherwise(wrong))


def ensure_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The collection if its vectors have ``dim`` dimensions, else an empty one to be filled anew."""
    other = vectors.filter(F.size(vector) != dim).limit(1).count()
    return vectors.limit(0) if other else vectors


def emptied(table: DataFrame) -> DataFrame:
    """A reset table: its schema without rows."""
    return table.limit(0)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, chunk_hash, change: what of (doc_id, chunk_hash) to insert, delete or leave. Null hashes are ignored. One shuffle: both sides meet in one aggregate."""
    marked = old.select("doc_id", "chunk_hash", F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(new.select("doc_id", "chunk_hash", F.lit(0).alias("was"), F.lit(1).alias("is")))
    met = marked.filter("chunk_hash IS NOT NULL").groupBy("doc_id", "chunk_hash").agg(F.max("was").alias("was"), F.max("is").alias("is"))
    change = F.when(F.col("was") + F.col("is") == 2, "unchanged").when(F.col("is") == 1, "insert").otherwise("delete")
    return met.select("doc_id", "chunk_hash", change.alias("change"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, in order."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).filter(F.col("back") <= n)


def sessions(messages: DataFrame) -> DataFrame:
    """One row a conversation: last turn and role, number of messages, whether it is long enough for a summary."""
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("messages")).withColumn("wants_summary", F.col("messages") >= 12)


def history_prompt(messages: DataFrame, n: int) -> DataFrame:
    """conv_id, prompt: the last n turns as lines of role and text."""
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    kept = last_messages(messages, n).groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return kept.select("conv_id", F.array_join(F.col("l")["line"], "\n").alias("prompt"))


def create_sessions(held: DataFrame, new: DataFrame, now) -> DataFrame:
    """Sessions (session_id, title, user_id, last_message_at): new ones are added without a last message; known ones take non-null titles and
    users, and ``now`` as their last message."""
    old, add = held.alias("old"), new.dropDuplicates(["session_id"]).alias("new")
    met = old.join(add, F.col("old.session_id") == F.col("new.session_id"), "full")
    known, named = F.col("old.session_id").isNotNull(), F.col("new.session_id").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    last = F.when(known & named, F.lit(now)).otherwise(F.col("old.last_message_at"))
    return met.select(pick("session_id"), pick("title"), pick("user_id"), last.alias("last_message_at"))


def add_messages(sessions_: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after ``new`` messages (session_id, role, message, created_at): their sessions' last message moves up."""
    latest = new.groupBy("session_id").agg(F.max("created_at").alias("_latest"))
    moved = sessions_.join(latest, "session_id", "left").withColumn("last_message_at", F.greatest("last_message_at", "_latest")).drop("_latest")
    return moved.select(*sessions_.columns), messages.unionByName(new, allowMissingColumns=True)


def recent_sessions(sessions_: DataFrame, limit: int = 50) -> DataFrame:
    """The sessions of the latest messages."""
    return sessions_.orderBy(F.desc_nulls_last("last_message_at"), "session_id").limit(limit)


def messages_of(messages: DataFrame, limit: int = 30, latest: bool = False) -> DataFrame:
    """The oldest ``limit`` messages of each conversation, in order, as the store reads them; ``latest`` for the newest."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn") if latest else F.col("turn")))
    return messages.withColumn("_at", at).filter(F.col("_at") <= limit).drop("_at")


def summarised(sessions_: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions whose metadata (a map) has a summary put in, beside what it held."""
    met = sessions_.join(summaries.select("session_id", "summary_text"), "session_id", "left")
    added = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "summary_text"), F.create_map(F.lit("summary_text"), F.col("summary_text")))
    return met.withColumn("metadata", F.when(F.col("summary_text").isNotNull(), added).otherwise(F.col("metadata"))).drop("summary_text")


def first_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of parts with one row a key: that of the earliest part."""
    whole = None
    for number, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(number))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (*key, "_part")]
    merged = whole.groupBy(*key).agg(F.min_by(F.struct(*rest), "_part").alias("_row"))
    return merged.select(*key, "_row.*")


def payload(parsed: DataFrame) -> DataFrame:
    """Parsed documents (title, content, raw_text, source_path, file_type, lang, author, published_at, tags) as rows of the document table."""
    or_else = lambda a, b: F.coalesce(F.when(X.blank(a) != "", a), b)
    stem = F.regexp_extract("source_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    tidy = lambda c: F.nullif(X.normalize_whitespace(c), F.lit(""))
    content = X.normalize_whitespace(or_else(F.col("content"), F.col("raw_text")))
    return parsed.select(
        "doc_id", F.coalesce(tidy(or_else(F.col("title"), stem)), F.lit("Untitled")).alias("title"), content.alias("content"), X.normalize_whitespace(or_else(F.col("raw_text"), F.col("content"))).alias("raw_text"),
        F.col("source_path").alias("file_path"), X.normalize_whitespace(F.col("file_type")).alias("file_type"), tidy(F.col("lang")).alias("lang"), tidy(F.col("author")).alias("author"),
        X.parse_timestamp(F.col("published_at")).alias("published_at"), F.md5(content).alias("content_hash"), X.tags(F.col("tags")).alias("tags"),
    )


def sharegpt(messages: DataFrame) -> DataFrame:
    """conv_id, conversations: turns as (from, value), roles renamed."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.coalesce("role", F.lit("")))
    one = F.struct("turn", who.alias("from"), F.coalesce("text", F.lit("")).alias("value"))
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))
