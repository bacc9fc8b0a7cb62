"""Queries of the general data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import changes, history, intervals, references
from quire.sources.tables import one_record, table

Query = Callable[[SparkSession, str], DataFrame]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return one_record(table(spark, d, "article_versions"), "id", "article_ref", "date_debut", "date_fin").drop("id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.periods(_spans(spark, d), "article_ref", "date_debut", "date_fin")
    return intervals.overlaps_and_gaps(found, "article_ref")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    p = intervals.periods(_spans(spark, d), "article_ref", "date_debut", "date_fin")
    end = F.when(F.col("after_last") >= (1 << intervals.BITS), F.lit("open")).otherwise(intervals.day_text(F.col("after_last") - 1))
    return p.select("article_ref", intervals.day_text(F.col("first_day")).alias("start_day"), end.alias("end_day"))


def _failing(spark: SparkSession, d: str) -> DataFrame:
    books, chunks, chapters, versions = (table(spark, d, t) for t in ("books", "chunks", "chapters", "article_versions"))
    return references.failing_references(
        [
            references.children(chunks, "chunks", "books", "book_id"),
            references.children(chapters, "chapters", "books", "book_id"),
            references.children(versions, "article_versions", "chunks", "chunk_id"),
        ],
        [references.parents(books, "books", "id", "added_at", "removed_at"), references.parents(chunks, "chunks", "id", "loaded_at", "removed_at")],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _failing(spark, d).select("table_name", "id", "kind")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.failing_by_period(_failing(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.pending_chunks(*(table(spark, d, t) for t in ("chunks", "chunk_state", "sync_runs"))).select("id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    h = history.article_history(table(spark, d, "article_versions"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return h.select("article_ref", text("valid_from").alias("valid_from"), F.coalesce(text("valid_to"), F.lit("open")).alias("valid_to"), "etat")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_periods": p1_periods, "p2_found": p2_found, "p2_by_month": p2_by_month, "p4_found": p4_found, "p7_found": p7_found}

_ISLANDS = """
WITH one AS (SELECT id, arg_min(struct_pack(a := article_ref, s := date_debut, e := date_fin), loaded_at) AS r FROM article_versions WHERE id IS NOT NULL GROUP BY id),
span AS (SELECT r.a AS article_ref, r.s AS s, CASE WHEN r.e IS NULL OR year(r.e) >= 2900 THEN DATE '9999-12-31' ELSE r.e END AS e
         FROM one WHERE r.a IS NOT NULL AND r.s IS NOT NULL AND (r.e IS NULL OR r.e >= r.s)),
seen AS (SELECT *, max(e) OVER (PARTITION BY article_ref ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM span),
numbered AS (SELECT *, sum(CASE WHEN m IS NULL OR (m < DATE '9999-12-31' AND s > m + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY article_ref ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
period AS (SELECT article_ref, island, min(s) AS a, max(e) AS z, bool_or(coalesce(s <= m, false)) AS meets FROM numbered GROUP BY ALL),
next AS (SELECT *, lead(a) OVER (PARTITION BY article_ref ORDER BY a) AS n FROM period)
"""
_OPEN = "CASE WHEN z = DATE '9999-12-31' THEN 'open' ELSE strftime(z, '%Y-%m-%d') END"

_REFERENCES = """
WITH book AS (SELECT id, min(added_at) AS since, bool_or(removed_at IS NOT NULL) AS gone FROM books GROUP BY id),
chunk AS (SELECT id, min(loaded_at) AS since, bool_or(removed_at IS NOT NULL) AS gone, arg_min(book_id, loaded_at) AS book_id FROM chunks GROUP BY id),
kid AS (SELECT 'chunks' AS table_name, c.id, c.book_id AS ref, c.since AS loaded, b.id AS there, b.gone, b.since FROM chunk c LEFT JOIN book b ON b.id = c.book_id
  UNION ALL SELECT 'chapters', k.id, k.ref, k.loaded, b.id, b.gone, b.since FROM (SELECT id, arg_min(book_id, loaded_at) AS ref, min(loaded_at) AS loaded FROM chapters GROUP BY id) k LEFT JOIN book b ON b.id = k.ref
  UNION ALL SELECT 'article_versions', k.id, k.ref, k.loaded, b.id, b.gone, b.since FROM (SELECT id, arg_min(chunk_id, loaded_at) AS ref, min(loaded_at) AS loaded FROM article_versions GROUP BY id) k LEFT JOIN chunk b ON b.id = k.ref),
failing AS (SELECT *, CASE WHEN there IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > loaded THEN 'late' END AS kind FROM kid WHERE ref IS NOT NULL)
"""

SQL: dict[str, str] = {
    "p1_found": _ISLANDS
    + f"""SELECT article_ref, 'merged' AS kind, strftime(a, '%Y-%m-%d') AS start_day, {_OPEN} AS end_day FROM next WHERE meets
UNION ALL SELECT article_ref, 'gap', strftime(z + 1, '%Y-%m-%d'), strftime(n - 1, '%Y-%m-%d') FROM next WHERE n IS NOT NULL""",
    "p1_periods": _ISLANDS + f"SELECT article_ref, strftime(a, '%Y-%m-%d') AS start_day, {_OPEN} AS end_day FROM next",
    "p2_found": _REFERENCES + "SELECT table_name, id, kind FROM failing WHERE kind IS NOT NULL",
    "p2_by_month": _REFERENCES + "SELECT table_name, coalesce(strftime(loaded, '%Y-%m'), 'unknown') AS month, kind, count(*) AS records FROM failing WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": """
WITH now AS (SELECT id, arg_min(removed_at IS NOT NULL, loaded_at) AS gone, arg_min(coalesce(content_hash, substr(md5(content), 1, 12)), loaded_at) AS h FROM chunks GROUP BY id),
plain AS (SELECT chunk_pk, run_id, consumed_at, substr(regexp_replace(regexp_replace(lower(content_hash), '^\\s*[a-z][a-z0-9-]*\\s*[:=]', ''), '[^0-9a-f]', '', 'g'), 1, 12) AS h
          FROM chunk_state WHERE run_id IN (SELECT run_id FROM sync_runs WHERE outcome = 'done')),
last AS (SELECT chunk_pk, arg_max(h, (run_id, consumed_at, h)) AS h FROM plain GROUP BY chunk_pk)
SELECT id FROM now LEFT JOIN last ON chunk_pk = id WHERE NOT gone AND (chunk_pk IS NULL OR last.h IS DISTINCT FROM lower(now.h))""",
    "p7_found": """
WITH one AS (SELECT id, article_ref, version_num, date_debut, date_fin, etat, texte_modificateur, min(loaded_at) AS loaded_at FROM article_versions GROUP BY ALL),
held AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY article_ref, version_num ORDER BY loaded_at DESC, id DESC) = 1),
good AS (SELECT *, strip_accents(upper(trim(etat))) AS e FROM held WHERE date_debut IS NOT NULL AND (date_fin IS NULL OR date_fin >= date_debut) AND trim(etat) <> ''),
day AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY article_ref, date_debut ORDER BY version_num DESC) = 1),
ended AS (SELECT *, least(CASE WHEN date_fin IS NULL OR year(date_fin) >= 2900 THEN DATE '9999-12-31' ELSE date_fin END,
          coalesce(lead(date_debut) OVER (PARTITION BY article_ref ORDER BY date_debut) - 1, DATE '9999-12-31')) AS z FROM day),
marked AS (SELECT *, CASE WHEN lag(z) OVER w = date_debut - 1 AND lag(e) OVER w = e AND lag(texte_modificateur) OVER w IS NOT DISTINCT FROM texte_modificateur THEN 0 ELSE 1 END AS starts
           FROM ended WINDOW w AS (PARTITION BY article_ref ORDER BY date_debut)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY article_ref ORDER BY date_debut ROWS UNBOUNDED PRECEDING) AS no FROM marked)
SELECT article_ref, strftime(min(date_debut), '%Y-%m-%d') AS valid_from, CASE WHEN max(z) = DATE '9999-12-31' THEN 'open' ELSE strftime(max(z), '%Y-%m-%d') END AS valid_to, e AS etat
FROM numbered GROUP BY article_ref, no, e""",
}
