"""Indexing a folder: difference to what is indexed, parsing of what is new, new versions of the tables; and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import book_slug, content_hash
from quire.operators import graph, sync
from quire.session import written
from quire.sources import files, parsers
from quire.sources.versioned import VersionedTable

CHUNK_DDL = "chunk_id string, book_slug string, book_title string, book_file string, corpus string, ordinal int, chapter_title string, chapter_num int, page_start int, page_end int, paragraph int, line_start int, line_end int, content string, metadata map<string, string>, content_chars int, content_hash string"
FILE_DDL = "corpus string, filepath string, file_hash string, file_size bigint, indexed_at timestamp, book_slug string, status string, error string"
EDGE_DDL = "src_slug string, dst_slug string, relation_type string, source_detail string"


def _schema(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


class Library:
    """Tables of versions in one folder: files (corpus, filepath), chunks (chunk_id), edges. One writer at a time; a second one fails at its commit and may run again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.files = VersionedTable(spark, f"{path}/files", _schema(spark, FILE_DDL), ["corpus", "filepath"])
        self.chunks = VersionedTable(spark, f"{path}/chunks", _schema(spark, CHUNK_DDL), ["chunk_id"])
        self.edges = VersionedTable(spark, f"{path}/edges", _schema(spark, EDGE_DDL), ["src_slug", "dst_slug", "relation_type", "source_detail"])

    def plan(self, root: str, corpus: str, **selection) -> DataFrame:
        """What a sync of a folder would do (a dry run): the rows of sync.snapshot_diff."""
        disk = self._disk(root, corpus, **selection)
        return sync.snapshot_diff(self.files.read().filter(F.col("corpus") == corpus), disk.drop("content"), self.files.read().filter("status = 'failed'"))

    def _disk(self, root: str, corpus: str, **selection) -> DataFrame:
        found = files.selected(files.listing(self.spark, root, content=True), **selection)
        return files.with_hash(found).select(F.lit(corpus).alias("corpus"), F.col("path").alias("filepath"), "file_hash", "file_size", "content")

    def sync(self, root: str, corpus: str, now: str, **selection) -> dict[str, int]:
        """Brings the tables up to the folder and returns how many files there were of each change. Moved files are indexed under their new name, so that chunk ids follow the slug. A file that
        yields nothing leaves an empty book; one that fails is remembered by its hash and not tried again until it changes. The commit of `files` is the last: if a run dies before, the next
        one does the same again."""
        disk = self._disk(root, corpus, **selection)
        tracked = self.files.read().filter(F.col("corpus") == corpus)
        diff = written(sync.snapshot_diff(tracked.filter("status <> 'failed'"), disk.drop("content"), tracked.filter("status = 'failed'")))
        counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        fresh = diff.filter("change IN ('added', 'modified', 'moved', 'cross_moved')").select("corpus", "filepath")
        gone = diff.filter("change = 'removed'").select("corpus", "filepath").unionByName(diff.filter("change IN ('moved', 'cross_moved')").select(F.col("from_corpus").alias("corpus"), F.col("from_path").alias("filepath")))
        touched = written(gone.unionByName(fresh).distinct())
        todo = disk.join(fresh, ["corpus", "filepath"], "left_semi")
        slug = book_slug(F.col("corpus"), F.col("path"))
        parsed = written(parsers.parsed(todo.withColumnRenamed("filepath", "path")))
        old_slugs = touched.select(book_slug(F.col("corpus"), F.col("filepath")).alias("book_slug"))
        self.chunks.commit(parsers.passages(parsed, slug), self.chunks.read().join(old_slugs, "book_slug", "left_semi").select("chunk_id").join(parsers.passages(parsed, slug).select("chunk_id"), "chunk_id", "left_anti"))
        info = todo.select("corpus", "filepath", "file_hash", "file_size")
        state = parsed.select("corpus", F.col("path").alias("filepath"), slug.alias("book_slug"), "status", "error").join(info, ["corpus", "filepath"])
        rows = state.select("corpus", "filepath", "file_hash", "file_size", F.lit(now).cast("timestamp").alias("indexed_at"), "book_slug", "status", "error")
        known = rows.select("corpus", F.col("filepath").alias("filename"), F.col("book_slug").alias("slug")).unionByName(
            self.files.read().join(touched, ["corpus", "filepath"], "left_anti").select("corpus", F.col("filepath").alias("filename"), F.col("book_slug").alias("slug"))
        )
        cand = parsed.select(slug.alias("src_slug"), F.col("path").alias("src_path"), "corpus", F.explode("references").alias("r")).select("src_slug", "src_path", "corpus", F.col("r.relation").alias("relation_type"), F.col("r.target").alias("target_ref"))
        self.edges.commit(graph.resolve_links(cand, known), self.edges.read().join(old_slugs.withColumnRenamed("book_slug", "src_slug"), "src_slug", "left_semi"))
        self.files.commit(rows, gone)
        return counts

    def save_snapshot(self, at: str) -> DataFrame:
        """(book_slug, snapshot, content_hash, created_at): the text of each book in reading order."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n")
        one = self.chunks.read().groupBy("book_slug").agg(text.alias("snapshot"))  # a book's text is a cell of the table
        return one.withColumns({"content_hash": content_hash(F.col("snapshot")), "created_at": F.lit(at).cast("timestamp")})


def as_prompt(results: DataFrame) -> DataFrame:
    """(line): results (rank, source, content) as text for a prompt."""
    return results.orderBy("rank").select(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit("\n"), "content").alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def graph_page(edges: DataFrame, books: DataFrame, hubs: int = 10) -> DataFrame:
    """(section, line): a page about the graph: hubs, orphans, and the edges among hubs as a Mermaid chart."""
    top = graph.in_degrees(edges).orderBy(F.desc("in_degree"), "slug").limit(hubs)
    lines = top.select(F.lit("hubs").alias("section"), F.concat(F.lit("- [["), "slug", F.lit("]] ("), F.col("in_degree").cast("string"), F.lit(")")).alias("line"))
    alone = graph.orphans(books, edges).select(F.lit("orphans").alias("section"), F.concat(F.lit("- [["), "slug", F.lit("]]")).alias("line"))
    chart = edges.join(top.select(F.col("slug").alias("dst_slug")), "dst_slug", "left_semi").join(top.select(F.col("slug").alias("src_slug")), "src_slug", "left_semi")
    drawn = chart.select(F.lit("mermaid").alias("section"), F.concat(F.lit("  "), "src_slug", F.lit(" --> "), "dst_slug").alias("line")).distinct()
    return lines.unionByName(alone).unionByName(drawn)
