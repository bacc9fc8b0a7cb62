"""Queries of the operators on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import markup, mixing, near_duplicates, packing, pii, scanned_pages, tokens
from quire.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: The threshold of problem 6 in TESTDATA.md.
CHUNK_PAIRS = near_duplicates.Settings(run=3, similarity=0.6, least_words=20, bands=40, rows=4)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned_pages.repaired(table(spark, d, "chunks")).select("id", F.explode("kinds").alias("kind"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned_pages.repaired(table(spark, d, "chunks")).select("id", "page_start", "page_end", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked(table(spark, d, "chunks")).select("id", F.explode("kinds").alias("kind")).distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "chunks")).select("id", "text")


def _chunk_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.similar_pairs(table(spark, d, "chunks").select("id", F.col("content").alias("text")), CHUNK_PAIRS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.expanded(*_chunk_pairs(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*_chunk_pairs(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.document_tokens(table(spark, d, "documents")).select("doc_id", "tokens")
    return packing.packed(sizes, table(spark, d, "pack_budgets"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packed(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_packed(spark, d))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each budget, counted: containers over their capacity, texts whose tokens are not each in just one container, and texts that were placed."""
    sizes = tokens.document_tokens(table(spark, d, "documents")).select("doc_id", "tokens")
    budgets = table(spark, d, "pack_budgets")
    made = packing.packed(sizes, budgets)
    over = packing.containers(made).groupBy("budget_name").agg(F.count_if(F.col("space_left") < 0).alias("overfull"))
    pieces = made.groupBy("budget_name", "doc_id").agg(F.sum("length").alias("placed"), F.max(F.col("start_token") + F.col("length")).alias("upto"), F.count_distinct("start_token").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    whole = (F.col("placed") == F.col("tokens")) & (F.col("upto") == F.col("tokens")) & (F.col("starts") == F.col("pieces"))
    held = pieces.join(sizes, "doc_id", "left").groupBy("budget_name").agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("incomplete"), F.count(F.lit(1)).alias("texts"))
    return over.join(held, "budget_name").select("budget_name", "overfull", "incomplete", "texts")


def p9_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source of a mix: its share as a part of all, whether it is met (sources that do not exist give nothing), and whether no record is used more often than it may be."""
    r = _mixed(spark, d)[1]
    whole = F.sum("taken_tokens").over(Window.partitionBy("mix_name"))  # a row for each target
    met = F.abs(F.col("taken_tokens") - F.col("present_share") * whole) <= 20  # to the token, but for rounding in each source
    return r.select("mix_name", "source", F.round("target_share", 9).alias("target_share"), met.alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("kept"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.selection(tokens.document_tokens(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_selected(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.without_mentions(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_groups": p6_groups, "p8_packed": p8_packed, "p8_containers": p8_containers, "p8_report": p8_report, "p8_faults": p8_faults, "p9_selected": p9_selected, "p9_report": p9_report, "p9_faults": p9_faults, "p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {
    "p8_faults": "SELECT budget_name, 0 AS overfull, 0 AS incomplete, (SELECT count(*) FROM documents WHERE text <> '') AS texts FROM pack_budgets",
    "p9_faults": """
WITH t AS (SELECT mix_name, lower(trim(source)) AS source, max(target_share) AS w FROM mix_targets WHERE target_share > 0 AND mix_name IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
SELECT mix_name, source, round(w / sum(w) OVER (PARTITION BY mix_name), 9) AS target_share, true AS met, true AS kept FROM t""",
    "p6_found": """
WITH c AS (SELECT id, any_value(content) AS content FROM chunks WHERE content IS NOT NULL GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM c),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
k AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM k JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k)""",
}
