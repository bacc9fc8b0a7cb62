"""The corpus tables, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table; a file that lacks one reads it as null.
SCHEMAS = {
    "books": "id bigint, slug string, title string, filename string, corpus string, page_count int, chunk_count int, total_chars bigint, indexed_at timestamp, metadata string, added_at timestamp, removed_at timestamp",
    "chapters": "id bigint, book_id bigint, num int, title string, page_start int, loaded_at timestamp",
    "chunks": "id bigint, chunk_id string, book_id bigint, chapter_id bigint, book_slug string, book_title string, book_file string, corpus string, chapter_title string, chapter_num int, page_start int, page_end int, paragraph int, line_start int, line_end int, section_type string, content string, content_chars int, content_hash string, tags array<string>, metadata string, loaded_at timestamp, removed_at timestamp",
    "article_versions": "id bigint, article_ref string, chunk_id bigint, version_num int, date_debut date, date_fin date, date_publication date, etat string, texte_modificateur string, previous_id bigint, content string, loaded_at timestamp",
    "indexed_files": "filepath string, corpus string, file_hash string, book_slug string, root_path string, file_size bigint, indexed_at timestamp",
    "edges": "src_slug string, dst_slug string, relation_type string, source_detail string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, corpus string, filepath string, book_slug string, exported_at timestamp",
    "chunk_state": "chunk_pk bigint, content_hash string, run_id int, consumed_at timestamp",
    "sync_runs": "run_id int, started_at timestamp, finished_at timestamp, outcome string, watermark_at timestamp",
    "mix_targets": "mix_name string, source string, target_share double, max_repeats int",
    "pack_budgets": "budget_name string, capacity_tokens int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Timestamps without zone in the files are taken as UTC."""
    path = f"{folder}/{name}.parquet"
    if name in SCHEMAS:
        return spark.read.schema(SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def one_record(df: DataFrame, key: str, *columns: str, at: str = "loaded_at") -> DataFrame:
    """(key, columns...), one row for each key, from its row with the earliest `at` (rows with a null key are dropped; a null `at`, or a table without it, counts as last, and ties
    are settled by the columns' own order, so that a repeated run gives the same rows)."""
    time = F.col(at) if at in df.columns else F.lit(None).cast("timestamp")
    row = F.struct(time.isNull().alias("_late"), time.alias("_at"), *[F.col(n) for n in columns])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_r"))
    return best.select(key, *[F.col(f"_r.{n}").alias(n) for n in columns])
