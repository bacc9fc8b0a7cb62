"""Queries of the operators on a library's state (tracking, queue, checks, vectors, links, streams) over the corpus tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import audit, catalog, embedding, graph, jobs, search, sync, tracking
from quire.plans import reference_queries as ref
from quire.session import shared_dir
from quire.sources.tables import table
from quire.streaming import sync as streams

QUERIES: dict[str, ref.Query] = {}
SQL: dict[str, str] = {}
_LATE = "2024-07-01"


def query(sql: str | None = None):
    def add(f: ref.Query) -> ref.Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row for each corpus and path, with the latest values."""
    t = table(spark, d, "indexed_files")
    last = F.max_by(F.struct("file_hash", "book_slug", "root_path", "file_size"), F.struct("indexed_at", "file_hash"))
    return t.groupBy("corpus", "filepath").agg(last.alias("r"), F.max("indexed_at").alias("indexed_at")).select("corpus", "filepath", "r.*", "indexed_at")


_F = "f AS (SELECT corpus, filepath, unnest(arg_max(struct_pack(file_hash := file_hash, book_slug := book_slug, root_path := root_path, file_size := file_size), (indexed_at, file_hash))), max(indexed_at) AS indexed_at FROM indexed_files GROUP BY corpus, filepath)"
_FAILED = "x AS (SELECT corpus, filepath, file_hash, file_size, 'no text in ' || filepath AS error, indexed_at AS failed_at FROM indexed_files WHERE book_slug IS NULL AND indexed_at IS NOT NULL)"


def _failed(spark: SparkSession, d: str) -> DataFrame:
    """Files without book, as failures."""
    t = table(spark, d, "indexed_files").filter("book_slug IS NULL AND indexed_at IS NOT NULL")
    return t.select("corpus", "filepath", "file_hash", "file_size", F.concat(F.lit("no text in "), "filepath").alias("error"), F.col("indexed_at").alias("failed_at"))


def _failure_state(spark: SparkSession, d: str) -> DataFrame:
    """Those of two periods, one after the other."""
    x = _failed(spark, d)
    none = x.limit(0).select("corpus", "filepath", "file_hash", "file_size", "error", F.lit(0).alias("attempts"), "failed_at")
    late = F.col("failed_at") >= F.lit(_LATE).cast("timestamp")
    return tracking.with_failures(tracking.with_failures(none, x.filter(~late)), x.filter(late))


# ---- tracking


@query(f"WITH {_FAILED} SELECT corpus, filepath, arg_max(file_hash, (failed_at, file_hash)) AS file_hash, arg_max(error, (failed_at, file_hash)) AS error, CAST(count(*) AS INT) AS attempts, max(failed_at) AS failed_at FROM x GROUP BY corpus, filepath")
def record_failures(spark: SparkSession, d: str) -> DataFrame:
    return _failure_state(spark, d).select("corpus", "filepath", "file_hash", "error", "attempts", "failed_at")


@query(f"WITH {_FAILED} SELECT DISTINCT corpus, filepath FROM x WHERE corpus <> 'juris'")
def clear_failures(spark: SparkSession, d: str) -> DataFrame:
    state = _failure_state(spark, d)
    return tracking.forgotten(state, state.filter("corpus = 'juris'")).select("corpus", "filepath")


@query(f"WITH {_F} SELECT corpus, filepath, CASE WHEN corpus = 'juris' AND file_size % 2 = 0 THEN '/srv/juris' ELSE root_path END AS root_path FROM f")
def claim_files(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return tracking.claimed(f, f.filter("corpus = 'juris' AND file_size % 2 = 0").select("filepath"), "juris", "/srv/juris").select("corpus", "filepath", "root_path")


@query("SELECT corpus, root_path, max(indexed_at) AS synced_at FROM indexed_files WHERE root_path IS NOT NULL GROUP BY ALL UNION ALL SELECT 'juris', '/srv/neuf', TIMESTAMP '2026-01-01'")
def record_root(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "indexed_files").filter("root_path IS NOT NULL")
    return tracking.with_root(t.groupBy("corpus", "root_path").agg(F.max("indexed_at").alias("synced_at")), "juris", "/srv/neuf", "2026-01-01 00:00:00")


_MOVED = f"{ref._B}, {_F}, m AS (SELECT corpus AS from_corpus, filepath AS from_path, 'archives' AS corpus, 'vieux/' || filepath AS filepath, book_slug FROM f WHERE corpus = 'memento')"


def _moved(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    f = _files(spark, d)
    moves = f.filter("corpus = 'memento'").select(F.col("corpus").alias("from_corpus"), F.col("filepath").alias("from_path"), F.lit("archives").alias("corpus"), F.concat(F.lit("vieux/"), "filepath").alias("filepath"))
    lost = f.limit(1).select(F.lit("memento").alias("from_corpus"), F.lit("nowhere.md").alias("from_path"), F.lit("x").alias("corpus"), F.lit("y.md").alias("filepath"))
    return tracking.moved(moves.unionByName(lost), ref._books(spark, d), f, ref._edges(spark, d))


@query(f"WITH {_MOVED} SELECT b.id, coalesce(m.corpus, b.corpus) AS corpus, coalesce(m.filepath, b.filename) AS filename, m.book_slug IS NOT NULL AS renamed FROM b LEFT JOIN m ON m.book_slug = b.slug")
def move_books(spark: SparkSession, d: str) -> DataFrame:
    """Keys stay, so that chunks and vectors follow."""
    before = ref._books(spark, d).select("id", F.col("slug").alias("old"))
    return _moved(spark, d)["books"].join(before, "id").select("id", "corpus", "filename", (~F.col("slug").eqNullSafe(F.col("old"))).alias("renamed"))


@query(f"WITH {_MOVED} SELECT corpus, filepath, file_hash FROM f WHERE corpus <> 'memento' UNION ALL SELECT m.corpus, m.filepath, f.file_hash FROM m JOIN f ON f.corpus = m.from_corpus AND f.filepath = m.from_path")
def move_files(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d)["files"].select("corpus", "filepath", "file_hash")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    """The roots of each corpus; one is dark."""
    t = table(spark, d, "indexed_files").filter("root_path IS NOT NULL").select("corpus", "root_path").distinct()
    return t.withColumns({"readable": ~((F.col("corpus") == "notes") & F.contains("root_path", F.lit("archive"))), "place": F.length("root_path")})


_ROOTS = f"""{_F}, r AS (SELECT DISTINCT corpus, root_path, NOT (corpus = 'notes' AND contains(root_path, 'archive')) AS readable, length(root_path) AS place FROM indexed_files WHERE root_path IS NOT NULL),
l AS (SELECT DISTINCT root_path, filepath FROM f WHERE root_path IS NOT NULL AND file_size % 3 <> 0)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter("root_path IS NOT NULL AND file_size % 3 <> 0").select("root_path", "filepath").distinct()


@query(
    f"""WITH {_ROOTS} SELECT corpus AS from_corpus, filepath AS from_path, EXISTS (SELECT 1 FROM r JOIN l USING (root_path) WHERE r.corpus = f.corpus AND l.filepath = f.filepath AND r.root_path <> '/srv/fonds')
OR EXISTS (SELECT 1 FROM r WHERE r.corpus = f.corpus AND NOT readable AND r.root_path <> '/srv/fonds') AS stays FROM f"""
)
def cross_corpus_gate(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select(F.col("corpus").alias("from_corpus"), F.col("filepath").alias("from_path"))
    return tracking.gate(f, _roots(spark, d), _listed(spark, d), "/srv/fonds")


@query(
    f"""WITH {_ROOTS} SELECT corpus, filepath FROM f WHERE regexp_matches(filepath, '\\.tmp$') OR (EXISTS (SELECT 1 FROM r WHERE r.corpus = f.corpus) AND NOT EXISTS (SELECT 1 FROM r WHERE r.corpus = f.corpus AND NOT readable)
AND NOT EXISTS (SELECT 1 FROM r JOIN l USING (root_path) WHERE r.corpus = f.corpus AND l.filepath = f.filepath))"""
)
def removals_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return tracking.confirmed_removals(_files(spark, d).select("corpus", "filepath"), _roots(spark, d), _listed(spark, d), r"\.tmp$")


@query(
    f"""WITH {_ROOTS}, h AS (SELECT corpus, filepath, arg_min(root_path, (place, root_path)) AS root FROM r JOIN l USING (root_path) GROUP BY ALL)
SELECT f.corpus, f.filepath, CASE WHEN root IS NULL OR starts_with(f.filepath, '/') THEN f.filepath ELSE regexp_replace(root, '/+$', '') || '/' || f.filepath END AS disk_path FROM f LEFT JOIN h USING (corpus, filepath)"""
)
def stored_paths_on_disk(spark: SparkSession, d: str) -> DataFrame:
    return tracking.on_disk(_files(spark, d).select("corpus", "filepath"), _roots(spark, d), _listed(spark, d))


@query(
    """WITH s AS (SELECT DISTINCT corpus, root_path, CASE WHEN corpus = 'code-fort' THEN ['.py'] END AS endings FROM indexed_files WHERE root_path IS NOT NULL),
p AS (SELECT DISTINCT coalesce(root_path, '/srv/fonds') || '/' || filepath AS path FROM indexed_files),
m AS (SELECT path, arg_max(s, (length(root_path), corpus)) AS s FROM p JOIN s ON starts_with(path, root_path || '/') AND (endings IS NULL OR list_contains(endings, lower(regexp_extract(path, '(\\.[^./]+)$', 1)))) GROUP BY path)
SELECT path, s.corpus AS corpus, s.root_path AS root_path FROM p LEFT JOIN m USING (path)"""
)
def source_of_edit(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "indexed_files").filter("root_path IS NOT NULL").select("corpus", "root_path", F.when(F.col("corpus") == "code-fort", F.array(F.lit(".py"))).alias("endings")).distinct()
    return tracking.source_of(ref._paths(spark, d)[0], sources)


@query(f"WITH {ref._B} SELECT slug, filename FROM b WHERE contains(slug, 'corpus/x/Memento') OR contains(lower(filename), 'corpus/x/memento') OR contains(lower(filename), 'memento') ORDER BY filename, slug LIMIT 20")
def identifier_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tracking.identified(ref._books(spark, d), "corpus/x/Memento").select("slug", "filename")


@query(f"WITH {ref._B} SELECT slug FROM b WHERE filename IN (SELECT filename FROM (SELECT filename FROM b WHERE filename IS NOT NULL ORDER BY id LIMIT 1))")
def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The path of one book as it lies below a root."""
    b = ref._books(spark, d)
    name = b.filter("filename IS NOT NULL").orderBy("id").first()["filename"]
    return tracking.named(b, f"/srv/fonds/{name}", ref._paths(spark, d)[1].withColumnRenamed("root", "root_path")).select("slug")


@query("""WITH p AS (SELECT DISTINCT coalesce(root_path, '/srv/fonds') || '/' || filepath AS path FROM indexed_files), t AS (SELECT path, string_split(path, '/') AS s FROM p)
SELECT arg_min(path, (length(path), path)) AS path FROM t GROUP BY CASE WHEN len(s) >= 2 THEN s[-2] || '/' || s[-1] ELSE path END""")
def same_tail(spark: SparkSession, d: str) -> DataFrame:
    return tracking.same_tail(ref._paths(spark, d)[0])


@query(
    """WITH k AS (SELECT DISTINCT corpus, filename AS filepath, CASE WHEN corpus = 'notes' THEN 'gossip' ELSE 'law' END AS nature, CASE WHEN page_count % 2 = 0 THEN 1 END AS first_page, page_count - 3 AS last_page FROM books)
SELECT corpus, filepath, 'nature' AS fault FROM k WHERE nature = 'gossip' UNION ALL SELECT corpus, filepath, 'range' FROM k WHERE first_page > last_page OR (first_page IS NULL AND last_page IS NOT NULL)
UNION ALL SELECT corpus, filepath, 'key' FROM k WHERE corpus IS NULL OR filepath IS NULL"""
)
def card_faults(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books")
    cards = b.select("corpus", F.col("filename").alias("filepath"), F.when(F.col("corpus") == "notes", "gossip").otherwise("law").alias("nature"), F.when(F.col("page_count") % 2 == 0, 1).alias("first_page"), (F.col("page_count") - 3).alias("last_page"))
    return tracking.card_faults(cards.distinct())


_VERDICTS = "v AS (SELECT corpus, filepath, CASE WHEN file_size % 5 = 0 THEN 'GONE' WHEN file_size % 5 = 1 THEN 'STALE' WHEN file_size % 5 = 2 THEN 'NEW' ELSE 'ok' END AS verdict FROM f)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("file_size") % 5 == 0, "GONE").when(F.col("file_size") % 5 == 1, "STALE").when(F.col("file_size") % 5 == 2, "NEW").otherwise("ok")
    return _files(spark, d).select("corpus", "filepath", v.alias("verdict"))


@query(f"WITH {_F}, {_VERDICTS} SELECT CASE WHEN verdict = 'GONE' THEN 'remove' ELSE 'ingest' END AS type, corpus, filepath, 0 AS priority FROM v WHERE verdict <> 'ok'")
def read_repair(spark: SparkSession, d: str) -> DataFrame:
    return tracking.repair_queue(_verdicts(spark, d))


@query(f"WITH {ref._C}, {_F}, {_VERDICTS} SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE verdict = 'GONE' AND v.corpus = c.corpus AND v.filepath = c.book_file)")
def withheld_results(spark: SparkSession, d: str) -> DataFrame:
    c = ref._chunks(spark, d, "corpus", "book_file").withColumnRenamed("book_file", "filepath")
    return tracking.withheld(c, _verdicts(spark, d)).select("id")


# ---- checks


@query(f"WITH {_FAILED}, g AS (SELECT corpus, filepath, max(failed_at) AS failed_at FROM x GROUP BY ALL) SELECT count(*) AS files, arg_max(filepath, (failed_at, filepath)) AS example, left('no text in ' || arg_max(filepath, (failed_at, filepath)), 70) AS reason FROM g HAVING count(*) > 0")
def silent_drops(spark: SparkSession, d: str) -> DataFrame:
    return audit.silent_drops(_failure_state(spark, d))


_HELD = f"""{ref._B}, {_F}, n AS (SELECT book_slug AS slug, count(*) AS versions, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents WHERE book_slug IS NOT NULL AND text IS NOT NULL GROUP BY 1),
held AS (SELECT DISTINCT ON (n.slug, b.corpus) n.slug, b.corpus, filepath, root_path, versions, bytes FROM n JOIN (SELECT DISTINCT slug, corpus FROM b) b USING (slug) JOIN f ON f.book_slug = n.slug AND f.corpus = b.corpus)"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").filter("book_slug IS NOT NULL AND text IS NOT NULL").select("book_slug", F.col("text").alias("snapshot"))
    return audit.snapshot_bytes(v, ref._books(spark, d), _files(spark, d))


@query(f"WITH {_HELD} SELECT slug, corpus, versions, bytes FROM held")
def snapshot_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select("slug", "corpus", "versions", "bytes")


@query(
    f"""WITH {_HELD}, r AS (SELECT corpus, min(root_path) AS only_root FROM indexed_files WHERE root_path IS NOT NULL GROUP BY corpus HAVING count(DISTINCT root_path) = 1)
SELECT slug, bytes FROM (SELECT held.*, coalesce(root_path, only_root) AS root FROM held LEFT JOIN r USING (corpus)) WHERE root = '/srv/fonds' AND regexp_matches(filepath, '\\.(md|py)$')"""
)
def unwanted_history(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("/srv/fonds", r"\.md$"), ("/srv/fonds", r"\.py$"), ("/elsewhere", ".*")], "root_path string, pattern string")
    return audit.unwanted_history(_held(spark, d), table(spark, d, "indexed_files").select("corpus", "root_path"), rules)


_DISK = "disk AS (SELECT corpus, filepath, file_size % 7 = 0 AS binary FROM f WHERE file_size % 4 <> 0 UNION ALL SELECT corpus, filepath || '.bak', file_size % 2 = 0 FROM f WHERE file_size % 11 = 0)"


@query(
    f"""WITH {ref._B}, {_F}, {_DISK}, kb AS (SELECT DISTINCT slug, corpus FROM b),
j AS (SELECT coalesce(k.corpus, f.corpus) AS corpus, k.filepath IS NOT NULL AS d, f.filepath IS NOT NULL AS t, f.book_slug, kb.slug IS NOT NULL AS has, coalesce(k.binary, false) AS bin FROM disk k FULL JOIN f ON f.corpus = k.corpus AND f.filepath = k.filepath LEFT JOIN kb ON kb.slug = f.book_slug AND kb.corpus = f.corpus),
s AS (SELECT *, d AND CASE WHEN t THEN book_slug IS NULL ELSE bin END AS skip FROM j),
o AS (SELECT corpus, count(*) FILTER (d AND NOT skip) AS indexable, count(*) FILTER (d AND t AND has) AS readable, count(*) FILTER (d AND t AND book_slug IS NOT NULL) - count(*) FILTER (d AND t AND has) AS tracked_not_readable,
count(*) FILTER (d AND NOT skip) - count(*) FILTER (d AND t AND book_slug IS NOT NULL) AS missing, count(*) FILTER (skip) AS skipped, count(*) FILTER (NOT d) AS unaccounted FROM s GROUP BY corpus)
SELECT * FROM o UNION ALL SELECT '*total*', CAST(sum(indexable) AS BIGINT), CAST(sum(readable) AS BIGINT), CAST(sum(tracked_not_readable) AS BIGINT), CAST(sum(missing) AS BIGINT), CAST(sum(skipped) AS BIGINT), CAST(sum(unaccounted) AS BIGINT) FROM o"""
)
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    disk = f.filter("file_size % 4 <> 0").select("corpus", "filepath", (F.col("file_size") % 7 == 0).alias("binary")).unionByName(f.filter("file_size % 11 = 0").select("corpus", F.concat("filepath", F.lit(".bak")).alias("filepath"), (F.col("file_size") % 2 == 0).alias("binary")))
    return audit.source_coverage(disk, f, ref._books(spark, d))


_QUEUE = "q AS (SELECT 'ingest' AS type, CASE WHEN file_size % 6 = 0 THEN 'failed' WHEN file_size % 6 = 1 THEN 'pending' ELSE 'done' END AS status, 'cannot read ' || file_hash AS error, indexed_at AS finished_at, filepath FROM indexed_files WHERE indexed_at IS NOT NULL)"


@query(
    f"""WITH {ref._C}, {ref._B}, {_QUEUE}, n AS (SELECT book_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT chunk_id) FILTER (id % 2 = 0) AS vectors FROM c GROUP BY 1),
s AS (SELECT filepath, bool_or(status = 'pending') AS pending, bool_or(status = 'failed') AS failed, arg_max(error, (finished_at, error)) FILTER (status = 'failed') AS reason FROM (SELECT DISTINCT * FROM q) GROUP BY 1)
SELECT slug, corpus, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors, coalesce(chunks, 0) > 0 AS searchable, coalesce(chunks > 0 AND vectors >= chunks, false) AS ready, coalesce(pending, false) AS pending, coalesce(failed, false) AS failed, reason
FROM b LEFT JOIN n ON n.book_id = b.id LEFT JOIN s ON s.filepath = b.filename"""
)
def readiness(spark: SparkSession, d: str) -> DataFrame:
    c = ref._chunks(spark, d, "chunk_id", "book_id")
    s = F.when(F.col("file_size") % 6 == 0, "failed").when(F.col("file_size") % 6 == 1, "pending").otherwise("done")
    q = table(spark, d, "indexed_files").filter("indexed_at IS NOT NULL").select(F.lit("ingest").alias("type"), s.alias("status"), F.concat(F.lit("cannot read "), "file_hash").alias("error"), F.col("indexed_at").alias("finished_at"), "filepath").distinct()
    return audit.readiness(ref._books(spark, d), c, c.filter("id % 2 = 0").select("chunk_id"), q)


@query(
    f"""WITH {ref._C}, {ref._B}, {_F}, g AS (SELECT DISTINCT corpus, filepath, CASE WHEN corpus = 'notes' THEN 'shared-' || left(filepath, 3) ELSE book_slug END AS book_slug, file_size % 9 = 0 AS bin FROM f),
n AS (SELECT CASE WHEN book_id % 2 = 0 THEN book_id ELSE id END AS book_id, count(*) AS n FROM c GROUP BY 1)
SELECT 'split' AS repair, corpus, book_slug AS item FROM g WHERE book_slug IS NOT NULL GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'untrack', corpus, filepath FROM g WHERE bin
UNION ALL SELECT CASE WHEN bool_or(filepath IN (SELECT filepath FROM g WHERE corpus NOT IN ('memento', 'juris'))) THEN 'rehome' ELSE 'drop' END, corpus, corpus FROM g WHERE corpus IN ('memento', 'juris') GROUP BY corpus
UNION ALL SELECT 'unsplit', corpus, slug FROM b JOIN n ON n.book_id = b.id WHERE n = 1 AND page_count > 20"""
)
def library_repairs(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    g = f.select("corpus", "filepath", F.when(F.col("corpus") == "notes", F.concat(F.lit("shared-"), F.substring("filepath", 1, 3))).otherwise(F.col("book_slug")).alias("book_slug"), (F.col("file_size") % 9 == 0).alias("binary"))
    c = ref._chunks(spark, d, "book_id").withColumn("book_id", F.when(F.col("book_id") % 2 == 0, F.col("book_id")).otherwise(F.col("id")))
    return audit.repairs(ref._books(spark, d), g, f.filter("corpus NOT IN ('memento', 'juris')").select("corpus").distinct(), c)


@query(
    f"""WITH {ref._C}, {ref._B}, f AS (SELECT DISTINCT filepath, corpus, book_slug FROM indexed_files WHERE corpus <> 'memento')
SELECT 'orphan_vectors' AS part, count(*) AS rows FROM c WHERE id % 10 = 0 AND removed_at IS NOT NULL UNION ALL SELECT 'empty_chunks', count(*) FROM c WHERE removed_at IS NULL AND (content IS NULL OR trim(content) = '')
UNION ALL SELECT 'fossil_chunks', count(*) FROM c WHERE removed_at IS NULL AND NOT starts_with(chunk_id, book_slug) UNION ALL SELECT 'untracked_books', count(*) FROM b WHERE slug IS NOT NULL AND slug NOT IN (SELECT book_slug FROM f WHERE book_slug IS NOT NULL)
UNION ALL SELECT 'unembedded', count(*) FROM c WHERE removed_at IS NULL AND id % 10 <> 0"""
)
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth chunk has a vector, also those that were removed; the files of one corpus are not tracked."""
    c = ref._chunks(spark, d, "chunk_id", "content", "book_slug", "removed_at")
    parts = audit.reconciled(ref._books(spark, d), table(spark, d, "indexed_files").filter("corpus <> 'memento'"), c.filter("removed_at IS NULL"), c.filter("id % 10 = 0").select("chunk_id"))
    return audit.counts(parts)


@query(
    f"""WITH {ref._C}, {ref._B}, n AS (SELECT book_id, count(*) AS n, sum(length(content)) AS l FROM c GROUP BY 1), k AS (SELECT DISTINCT filename, CASE WHEN id % 3 = 0 THEN 'html' ELSE 'pdf' END AS format FROM b WHERE ends_with(filename, '.pdf') AND id % 4 <> 0)
SELECT slug, CASE WHEN format IS NULL THEN 'missing' WHEN format <> 'pdf' THEN 'wrong-format' WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN page_count > 0 AND l / page_count < 20 THEN 'scan' ELSE 'ok' END AS health
FROM b LEFT JOIN n ON n.book_id = b.id LEFT JOIN k USING (filename) WHERE ends_with(filename, '.pdf')"""
)
def pdf_health_on_disk(spark: SparkSession, d: str) -> DataFrame:
    b = ref._books(spark, d)
    disk = b.filter("filename LIKE '%.pdf' AND id % 4 <> 0").select("filename", F.when(F.col("id") % 3 == 0, "html").otherwise("pdf").alias("format"))
    return audit.pdf_health(b, ref._chunks(spark, d, "book_id", "content"), disk=disk)


@query(f"WITH {ref._C}, {ref._B} SELECT 'a' AS project, slug FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book_id = b.id AND corpus <> 'juris') UNION ALL SELECT 'b', slug FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book_id = b.id AND corpus <> 'notes')")
def fleet_mute_books(spark: SparkSession, d: str) -> DataFrame:
    """Two libraries, each without the chunks of a corpus."""
    b, c = ref._books(spark, d), ref._chunks(spark, d, "book_id", "corpus")
    return audit.fleet({p: audit.mute_books(b, c.filter(F.col("corpus") != lost)) for p, lost in (("a", "juris"), ("b", "notes"))})


# ---- queue


@query(f"WITH {ref._JOBS}, n AS (SELECT type, payload FROM j WHERE status <> 'pending') SELECT count(DISTINCT (type, payload)) FILTER ((type, payload) NOT IN (SELECT (type, payload) FROM j WHERE status = 'pending')) AS inserted, count(*) - count(DISTINCT (type, payload)) FILTER ((type, payload) NOT IN (SELECT (type, payload) FROM j WHERE status = 'pending')) AS deduped FROM n")
def enqueue_counts(spark: SparkSession, d: str) -> DataFrame:
    j = ref._jobs(spark, d)
    return jobs.enqueued(j, j.filter("status <> 'pending'").select("type", "payload"))


@query(
    """SELECT DISTINCT event_type AS type, '{"a": "' || event_type || '", "filepath": "x' || (event_id % 50) || '", "n": "' || (event_id % 7) || '"}' AS payload FROM events"""
)
def canonical_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Keys come in one of two orders."""
    e = table(spark, d, "events")
    f, n, a = F.concat(F.lit("x"), (F.col("event_id") % 50).cast("string")).alias("filepath"), (F.col("event_id") % 7).cast("string").alias("n"), F.col("event_type").alias("a")
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(n, f, a))).otherwise(F.to_json(F.struct(f, a, n)))
    return e.select(F.col("event_type").alias("type"), jobs.canonical(body).alias("payload")).distinct()


@query(f"WITH {ref._JOBS}, t AS (SELECT id FROM j WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 50) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'running' ELSE status END AS status, attempts + CASE WHEN id IN (SELECT id FROM t) THEN 1 ELSE 0 END AS attempts FROM j")
def claim_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = ref._jobs(spark, d).withColumn("started_at", F.lit(None).cast("timestamp"))
    return jobs.claimed(j, 50, F.lit(ref.NOW).cast("timestamp")).select("id", "status", "attempts")


@query(
    f"""WITH {ref._JOBS}, e AS (SELECT event_id % 500 AS id, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, ts AS t FROM events), l AS (SELECT id, arg_max(status, (t, status)) AS s, max(t) AS t FROM e GROUP BY 1)
SELECT j.id, CASE WHEN l.s IS NOT NULL AND j.status = 'running' THEN l.s ELSE j.status END AS status, CASE WHEN j.status = 'running' AND l.s IN ('done', 'failed') THEN l.t END AS finished_at, CASE WHEN j.status = 'running' AND l.s = 'failed' THEN 'broke' END AS error FROM j LEFT JOIN l USING (id)"""
)
def settle_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = ref._jobs(spark, d).withColumns({"finished_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("id"), F.when(k == 0, "done").when(k == 1, "failed").otherwise("pending").alias("status"), F.col("ts").alias("at"), F.lit("broke").alias("error"))
    return jobs.settled(j, e).select("id", "status", "finished_at", "error")


@query(
    ref.SQL["snapshot_diff"].replace("SELECT change, corpus, filepath, coalesce(z, a)", ", all_ AS (SELECT change, corpus, filepath, coalesce(z, a)", 1)
    + ") SELECT CASE WHEN change IN ('moved', 'cross_moved') THEN 'move' WHEN change = 'removed' THEN 'remove' ELSE 'ingest' END AS type, corpus, filepath, from_path, CASE WHEN change IN ('added', 'modified') THEN 40 ELSE 10 END AS priority FROM all_ WHERE change <> 'unchanged'"
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return jobs.fanned_out(sync.snapshot_diff(*ref._snapshots(spark, d))).select("type", "corpus", "filepath", "from_path", "priority")


@query(f"WITH {ref._C}, u AS (SELECT DISTINCT corpus, book_file, chunk_id FROM c) SELECT chunk_id, CAST((row_number() OVER (PARTITION BY corpus, book_file ORDER BY chunk_id) - 1) // 64 AS INT) AS part FROM u")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    c = ref._chunks(spark, d, "corpus", "book_file", "chunk_id").select("corpus", F.col("book_file").alias("filepath"), "chunk_id")
    return jobs.embed_batches(c).select("chunk_id", "part")


@query()
def spaced_scans(spark: SparkSession, d: str) -> DataFrame:
    """Each scan depends on the one before: no SQL. Of every burst the time of its scan."""
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("source"), "ts")
    return jobs.spaced(jobs.debounced(e, "source", "ts", "5 minutes"), "source", "2 hours").select("source", "end", "scan_at")


@query(
    f"""WITH {ref._JOBS}, q AS (SELECT * FROM j WHERE status = 'pending'), c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY type ORDER BY priority, created_at, id) <= CASE type WHEN 'signup' THEN 30 ELSE 200 END),
f AS (SELECT *, row_number() OVER (ORDER BY priority <= 0, priority, created_at, id) AS lane FROM (SELECT * FROM c ORDER BY priority, created_at, id LIMIT 200)) SELECT id, type FROM f WHERE priority <= 0 OR lane <= 150"""
)
def dispatch_reserved(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the slots is kept for urgent jobs."""
    j = ref._jobs(spark, d).withColumn("project", F.lit("p"))
    return jobs.dispatch(j, {"signup": 30}, [], 200, reserved=50, urgent=0).select("id", "type")


# ---- vectors


@query(f"WITH {ref._C} SELECT chunk_id FROM c WHERE chunk_id IS NOT NULL AND id % 3 <> 0")
def lacking_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector of another model is none."""
    c = ref._chunks(spark, d, "chunk_id")
    v = c.select("chunk_id", F.when(F.col("id") % 3 == 0, embedding.model("hash")[0]).otherwise("other").alias("model"))
    return embedding.lacking(c, v, "hashed-words").select("chunk_id")


@query(f"WITH {ref._C}, v AS (SELECT CASE WHEN id % 3 = 0 THEN 'm1' ELSE 'm2' END AS model FROM c) SELECT model, count(*) AS vectors, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percent FROM v GROUP BY 1")
def vectors_by_model(spark: SparkSession, d: str) -> DataFrame:
    c = ref._chunks(spark, d, "chunk_id")
    return embedding.stats(c, c.select("chunk_id", F.when(F.col("id") % 3 == 0, "m1").otherwise("m2").alias("model")))


@query(f"WITH {ref._C} SELECT chunk_id, id % 50 = 0 OR id % 3 = 0 AS embedded FROM c WHERE content IS NOT NULL AND chunk_id IS NOT NULL")
def embed_targeted(spark: SparkSession, d: str) -> DataFrame:
    """Every third chunk has a vector; every fiftieth is asked for."""
    c = ref._chunks(spark, d, "chunk_id", "content").filter("content IS NOT NULL")
    v = c.filter("id % 3 = 0").select("chunk_id", F.lit(embedding.model("hash")[0]).alias("model"), F.array(F.lit(0.0).cast("float")).alias("vector"))
    made = embedding.generated(c.select("chunk_id", "content"), v, "hash", only=c.filter("id % 50 = 0").select("chunk_id"))
    return c.select("chunk_id").join(made.select("chunk_id", F.lit(True).alias("e")), "chunk_id", "left").select("chunk_id", F.coalesce("e", F.lit(False)).alias("embedded"))


# ---- search and links


@query(
    f"""WITH {ref._C}, t AS (SELECT id, {ref._tok("content")} AS t FROM c) SELECT id FROM t WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'taxe' AND len(list_filter(range(greatest(1, i - 5), least(len(t), i + 5) + 1), lambda k: k <> i AND t[k] = 'registre')) > 0)) > 0
OR (len(t) > 0 AND t[1] = 'article')"""
)
def near_query(spark: SparkSession, d: str) -> DataFrame:
    """Two words with four or fewer between them, or a text that begins with a third."""
    return search.matching(table(spark, d, "chunks"), "id", ["content"], "NEAR(taxe registre, 4) OR ^article")


@query("""WITH p AS (SELECT DISTINCT coalesce(root_path, '/srv/fonds') || '/' || filepath AS path, CAST(file_size % 10 AS DOUBLE) AS score FROM indexed_files), t AS (SELECT *, string_split(path, '/') AS s FROM p)
SELECT arg_min(path, (length(path), -score, path)) AS path FROM t GROUP BY CASE WHEN len(s) >= 2 THEN s[-2] || '/' || s[-1] ELSE path END""")
def merged_by_path(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "indexed_files").select(F.concat_ws("/", F.coalesce("root_path", F.lit("/srv/fonds")), "filepath").alias("path"), (F.col("file_size") % 10).cast("double").alias("score")).distinct()
    return search.merged_by_path(f, "path").select("path")


_LINKS = "k AS (SELECT DISTINCT slug, corpus, filename, regexp_replace(filename, '^.*/', '') AS name FROM b WHERE filename IS NOT NULL AND slug IS NOT NULL AND contains(filename, '/'))"


@query(
    f"""WITH {ref._B}, {_LINKS}, w AS (SELECT slug, corpus, filename, first_value(name) OVER (PARTITION BY corpus, regexp_replace(filename, '[^/]*$', '') ORDER BY filename, slug) AS name FROM k)
SELECT DISTINCT w.slug AS src_slug, (SELECT min(slug) FROM k WHERE k.corpus = w.corpus AND k.filename = regexp_replace(w.filename, '[^/]*$', '') || w.name) AS dst_slug FROM w
WHERE w.slug <> (SELECT min(slug) FROM k WHERE k.corpus = w.corpus AND k.filename = regexp_replace(w.filename, '[^/]*$', '') || w.name)"""
)
def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every book links to the first of its folder, as `./x/../name`."""
    b = ref._books(spark, d).filter("filename IS NOT NULL AND slug IS NOT NULL AND filename LIKE '%/%'").select("slug", "corpus", "filename").distinct()
    folder, name = F.regexp_replace("filename", "[^/]*$", ""), F.regexp_replace("filename", "^.*/", "")
    first = b.groupBy("corpus", folder.alias("folder")).agg(F.min_by(name, F.struct("filename", "slug")).alias("name"))
    cand = b.withColumn("folder", folder).join(first, ["corpus", "folder"]).select(F.col("slug").alias("src_slug"), F.col("filename").alias("src_path"), "corpus", F.lit("links_to").alias("relation_type"), F.concat(F.lit("./x/../"), "name").alias("target_ref"))
    return graph.resolve_links(cand, b).select("src_slug", "dst_slug")


@query(f"WITH {ref._E} SELECT DISTINCT dst_slug AS slug, relation_type, src_slug AS neighbour FROM e WHERE relation_type = (SELECT min(relation_type) FROM e)")
def neighbours_of_type(spark: SparkSession, d: str) -> DataFrame:
    e = ref._edges(spark, d)
    kind = e.agg(F.min("relation_type").alias("m")).first()["m"]
    return graph.neighbours(e, ref._books(spark, d), direction="in", relation=kind).select("slug", "relation_type", "neighbour").distinct()


@query(f"WITH {ref._E} SELECT tag, n FROM (SELECT unnest(tags) AS tag, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM chunks) GROUP BY 1) ORDER BY n DESC, tag LIMIT 10")
def tags_in_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tag_counts(ref._chunks(spark, d, "tags")).orderBy(F.desc("n"), "tag").limit(10)


# ---- data in which checks find something


@query(f"WITH {ref._C}, {ref._B} SELECT slug FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book_id = b.id AND c.corpus <> 'juris')")
def audit_mute_books_lost(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of one corpus are lost."""
    return audit.mute_books(ref._books(spark, d), ref._chunks(spark, d, "book_id", "corpus").filter("corpus <> 'juris'"))


@query(f"WITH {ref._B} SELECT slug, 1 AS page_count, total_chars * 3 AS total_chars FROM b WHERE page_count % 2 = 0 AND total_chars * 3 > 20000")
def audit_impossible_pages_lost(spark: SparkSession, d: str) -> DataFrame:
    """Half of the books lost their page counts."""
    b = ref._books(spark, d).withColumns({"page_count": F.when(F.col("page_count") % 2 == 0, 1).otherwise(F.col("page_count") + 1), "total_chars": F.col("total_chars") * 3})
    return audit.impossible_pages(b)


@query(f"WITH {ref._C} SELECT id, 'archive_' || book_slug AS book_slug FROM c WHERE corpus = 'juris' AND chunk_id IS NOT NULL AND book_slug IS NOT NULL")
def fossil_chunks_renamed(spark: SparkSession, d: str) -> DataFrame:
    """The books of one corpus were renamed."""
    c = ref._chunks(spark, d, "chunk_id", "book_slug", "corpus")
    return audit.fossils(c.withColumn("book_slug", F.when(F.col("corpus") == "juris", F.concat(F.lit("archive_"), "book_slug")).otherwise(F.col("book_slug"))))


@query(f"WITH {ref._CARDS}, u AS (SELECT corpus, CASE WHEN corpus = 'notes' THEN 'x/' || filepath ELSE filepath END AS filepath FROM k) SELECT corpus, filepath FROM u WHERE NOT EXISTS (SELECT 1 FROM indexed_files f WHERE f.corpus = u.corpus AND f.filepath = u.filepath)")
def cards_unknown_files_moved(spark: SparkSession, d: str) -> DataFrame:
    """The files of one corpus lie elsewhere."""
    c = ref._cards(spark, d).select("corpus", F.when(F.col("corpus") == "notes", F.concat(F.lit("x/"), "filepath")).otherwise(F.col("filepath")).alias("filepath"))
    return c.join(table(spark, d, "indexed_files").select("corpus", "filepath"), ["corpus", "filepath"], "left_anti")


# ---- streams, run until their input is used up


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    at = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events' files as they appear; a table may be one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    return reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")


@query("SELECT DISTINCT event_type AS type, CAST(user_id AS VARCHAR) AS payload FROM events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    e = _event_stream(spark, d).select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("payload"), F.col("ts").alias("created_at"))
    return _drained(spark, streams.deduplicated(e, late="3650 days").select("type", "payload"))


@query("SELECT event_type AS source, count(*) AS polls FROM events GROUP BY 1")
def stream_poll_plan(spark: SparkSession, d: str) -> DataFrame:
    e = _event_stream(spark, d).select(F.col("event_type").alias("source"), F.col("ts").alias("at"), (F.col("value") > 100).alias("changed"))
    return _drained(spark, streams.poll_plan(e)).groupBy("source").agg(F.count(F.lit(1)).alias("polls"))
