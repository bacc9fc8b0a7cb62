"""Queries of retrieval, catalogue, graph, history, sync, queue and audit operators over the corpus tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import audit, catalog, graph, history, index, jobs, search, sync
from quire.plans import data_queries
from quire.plans.stem_sql import stems
from quire.sources.tables import one_record, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A fixed present, so that results can be compared.
NOW = "2026-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _long(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks, each id once, from the row loaded first; only the columns asked for are read and shuffled."""
    return one_record(table(spark, d, "chunks"), "id", *[c for c in columns if c != "id"])


def _books(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "books")
    return one_record(t, "id", *[c for c in t.columns if c != "id"], at="added_at")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(table(spark, d, "edges"))


_C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_B = "b AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY slug) = 1)"
_E = "e AS (SELECT DISTINCT src_slug, dst_slug, relation_type, source_detail FROM edges)"
_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TOKENS_T = _TOKENS.format(c="text")


def _tok(c: str) -> str:
    return _TOKENS.format(c=c)


# ---- search ------------------------------------------------------------------------------------------------------------------------------------------

def _bm25(rows: str, keys: str, words: dict[str, int], rest: str) -> str:
    """Scores `sc` (keys, s) by stemmed words, each counting so many times, over `tk` (keys, t: array of terms)."""
    asked = ", ".join(f"('{w}', {m})" for w, m in words.items())
    return f"""WITH {rows},
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk), x AS (SELECT * FROM (VALUES {asked}) AS v(word, m)),
words AS (SELECT DISTINCT unnest(t) AS w FROM tk UNION SELECT word FROM x), {stems("words")},
q AS (SELECT word, m, list(other.w) AS ws FROM x JOIN stems own ON own.w = word JOIN stems other ON other.s = own.s GROUP BY word, m),
tf AS (SELECT {keys}, len(t) AS dl, word, m, len(list_filter(t, lambda y: list_contains(ws, y))) AS tf FROM tk, q),
df AS (SELECT word, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY word),
sc AS (SELECT {keys}, sum(m * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s
       FROM tf JOIN df USING (word), st GROUP BY ALL HAVING max(tf) > 0)
{rest}"""


def _document_bm25(words: dict[str, int], rest: str) -> str:
    return _bm25(f"tk AS (SELECT doc_id, {_TOKENS_T} AS t FROM documents)", "doc_id", words, rest)


_TOP_DOCUMENTS = "SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM sc ORDER BY s DESC, doc_id LIMIT 20"


def _documents(spark: SparkSession, d: str, words: str) -> DataFrame:
    return index.search(table(spark, d, "documents"), "doc_id", ["text"], words)


@query(_document_bm25({"abattement": 2, "daemon": 1, "fiscale": 1}, _TOP_DOCUMENTS))
def fts_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """A repeated word counts twice; words are stemmed."""
    return search.ranked(_documents(spark, d, "abattement daemon fiscale abattement"), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


@query(_document_bm25({"running": 1, "declarations": 1, "conditionally": 1}, _TOP_DOCUMENTS))
def fts_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Words that stand in the texts in other forms only."""
    return search.ranked(_documents(spark, d, "running declarations conditionally"), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


@query(
    f"""WITH tk AS (SELECT doc_id, {_TOKENS_T} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk), words AS (SELECT DISTINCT unnest(t) AS w FROM tk UNION SELECT unnest(['non', 'resident'])), {stems("words")},
one AS (SELECT list(x.w) AS ws FROM stems x JOIN stems y ON y.s = x.s AND y.w = 'non'), two AS (SELECT list(x.w) AS vs FROM stems x JOIN stems y ON y.s = x.s AND y.w = 'resident'),
tf AS (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: list_contains(ws, t[i]) AND list_contains(vs, t[i + 1]))) AS tf FROM tk, one, two),
df AS (SELECT count(*) AS df FROM tf WHERE tf > 0), sc AS (SELECT doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM tf, df, st WHERE tf > 0)
{_TOP_DOCUMENTS}"""
)
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A word with punctuation inside is a phrase of its parts, by the positions in the index."""
    return search.ranked(_documents(spark, d, "non-résidents"), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


def _chunk_bm25(words: list[str], rest: str) -> str:
    fields = ", ".join(f"{_tok(c)} AS t{i}" for i, c in enumerate(("chunk_id", "content", "book_title", "chapter_title")))
    rows = f"{_C}, tk AS (SELECT id, corpus, book_slug, tags, list_concat(t0, list_concat(t1, list_concat(t2, t3))) AS t FROM (SELECT id, corpus, book_slug, tags, {fields} FROM c))"
    return _bm25(rows, "id, corpus, book_slug, tags", dict.fromkeys(words, 1), rest)


_COLUMNS = ["chunk_id", "content", "book_title", "chapter_title"]
_TOP = "SELECT id, round(s, 6) AS score FROM sc WHERE {where} ORDER BY s DESC, id LIMIT {k}"


def _chunk_hits(spark: SparkSession, d: str, words: str, keep: list[str] | None = None, where: F.Column | None = None, most: int | None = None) -> DataFrame:
    return index.search(table(spark, d, "chunks"), "id", _COLUMNS, words, keep, where, at="loaded_at", most=most)


def _chunk_search(spark: SparkSession, d: str, words: str, where: F.Column | None, k: int, keep: tuple[str, ...] = ("corpus", "book_slug", "tags")) -> DataFrame:
    return _chunk_hits(spark, d, words, list(keep), where, k).orderBy(F.desc("score"), "id").limit(k)


@query(_chunk_bm25(["hypotheque", "rurale"], _TOP.format(where="corpus IN ('juris', 'doctrine')", k=30)))
def fts_corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    """Accents are folded; the corpus limits the results, not the statistics."""
    return _chunk_search(spark, d, "hypothèque Rurale", F.col("corpus").isin("juris", "doctrine"), 30).select("id", F.round("score", 6).alias("score"))


@query(_chunk_bm25(["quittance"], _TOP.format(where="book_slug = 'memento-pratique-consolide-1'", k=50)))
def fts_within_book(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_search(spark, d, "quittance", F.col("book_slug") == "memento-pratique-consolide-1", 50).select("id", F.round("score", 6).alias("score"))


@query(_chunk_bm25(["the", "registre"], _TOP.format(where="list_contains(tags, 'api') AND list_contains(tags, 'v2')", k=20)))
def fts_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """All tags must be there; they filter before the limit."""
    where = F.forall(F.array(F.lit("api"), F.lit("v2")), lambda t: F.array_contains("tags", t))
    return _chunk_search(spark, d, "the registre", where, 20).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_C}, t AS (SELECT id, ' ' || array_to_string({_tok("content")}, '  ') || ' ' AS x FROM c)
SELECT id, len(string_split(x, ' non  resident ')) - 1 AS occurrences FROM t WHERE contains(x, ' non  resident ')"""
)
def phrase_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """A word with punctuation inside is a phrase."""
    found = search.term_counts(table(spark, d, "chunks"), "id", ["content"], text.phrases("non-résident"), [])
    return found.filter("tf_0 > 0").select("id", _long("tf_0").alias("occurrences"))


@query(
    f"""WITH {_C}, t AS (SELECT id, {_tok("content")} AS t, {_tok("book_title")} AS b FROM c)
SELECT id FROM t WHERE (list_contains(t, 'taxe') OR len(list_filter(t, lambda x: starts_with(x, 'hypoth'))) > 0 OR len(list_filter(b, lambda x: starts_with(x, 'hypoth'))) > 0 OR list_contains(b, 'taxe'))
AND list_contains(b, 'memento') AND NOT contains(' ' || array_to_string(t, '  ') || ' ', ' sous  reserve ') AND NOT contains(' ' || array_to_string(b, '  ') || ' ', ' sous  reserve ')"""
)
def boolean_query(spark: SparkSession, d: str) -> DataFrame:
    return search.matching(table(spark, d, "chunks"), "id", ["content", "book_title"], '(taxe OR hypoth*) book_title:mémento NOT "sous réserve"')


_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


@query(
    f"""SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 12) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10"""
)
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search.nearest(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


@query(
    f"""SELECT query_id, id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 12) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label IN (0, 1)) WHERE rank <= 15"""
)
def semantic_label_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the limit."""
    t = table(spark, d, "embeddings")
    v = t.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search.nearest(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v.filter(t["label"].isin(0, 1)), 15)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    _document_bm25(
        {"abattement": 2, "daemon": 1, "fiscale": 1},
        f""", cand AS (SELECT * FROM sc ORDER BY s DESC, doc_id LIMIT 60), asked AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
h AS (SELECT doc_id, 0.3 * s / (SELECT max(s) FROM cand) + 0.7 * coalesce({_DOT.replace("q.", "asked.")}, 0) AS x FROM cand LEFT JOIN embeddings v ON v.vec_id = doc_id, asked)
SELECT doc_id, round(x, 6) AS score FROM h ORDER BY x DESC, doc_id LIMIT 20""",
    )
)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Three times as many text candidates as results; without a vector the cosine is 0."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.filter("doc_id = 0").first()["vector"]
    return search.hybrid(_documents(spark, d, "abattement abattement daemon fiscale"), v, "doc_id", q, 60).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT v.vec_id AS doc_id, round({_DOT}, 6) AS score FROM (SELECT embedding FROM embeddings WHERE vec_id = 0) q, embeddings v ORDER BY {_DOT} DESC, doc_id LIMIT 60")
def hybrid_without_text(spark: SparkSession, d: str) -> DataFrame:
    """No text candidate: the nearest vectors stand in."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.filter("doc_id = 0").first()["vector"]
    return search.hybrid(_documents(spark, d, "xyzzyplugh"), v, "doc_id", q, 60).select("doc_id", F.round("score", 6).alias("score"))


@query(
    _chunk_bm25(
        ["tribunal"],
        f""", {_B}, {_E}, deg AS (SELECT dst_slug, count(*) AS n FROM e GROUP BY 1),
top AS (SELECT id, book_slug, s FROM sc ORDER BY s DESC, id LIMIT 100),
r AS (SELECT id, book_slug, s * (1 + 0.5 * coalesce(pow(0.99, greatest(0, date_diff('day', CAST(indexed_at AS DATE), DATE '2026-01-01'))), 0) + 0.25 * least(coalesce(n / (SELECT max(n) FROM deg), 0), 1)) AS x
      FROM top LEFT JOIN (SELECT slug, any_value(indexed_at) AS indexed_at FROM b GROUP BY slug) ON slug = book_slug LEFT JOIN deg ON dst_slug = book_slug)
SELECT id, book_slug, round(x, 6) AS score FROM r ORDER BY x DESC, id LIMIT 20""",
    )
)
def rerank_freshness_centrality(spark: SparkSession, d: str) -> DataFrame:
    top = _chunk_search(spark, d, "tribunal", None, 100).withColumnRenamed("book_slug", "slug").withColumn("rank", F.lit(0))
    r = search.reranked(top, _books(spark, d).dropDuplicates(["slug"]), graph.in_degrees(_edges(spark, d)), NOW, 0.5, 0.25)
    return r.orderBy(F.desc("score"), "id").limit(20).select("id", F.col("slug").alias("book_slug"), F.round("score", 6).alias("score"))


@query(
    _chunk_bm25(
        ["tribunal"],
        """, r AS (SELECT *, row_number() OVER (PARTITION BY book_slug ORDER BY s DESC, id) AS rn, count(*) OVER (PARTITION BY book_slug) AS sections FROM sc),
o AS (SELECT book_slug, list(id ORDER BY rn) FILTER (rn BETWEEN 2 AND 4) AS o FROM r GROUP BY book_slug)
SELECT r.book_slug, id, round(s, 6) AS score, sections, coalesce(array_to_string(o, ','), '') AS others FROM r JOIN o ON o.book_slug IS NOT DISTINCT FROM r.book_slug WHERE rn = 1""",
    )
)
def dedup_best_per_source(spark: SparkSession, d: str) -> DataFrame:
    found = _chunk_hits(spark, d, "tribunal", ["book_slug"])
    best = search.best_per_source(found, "book_slug", "id")
    return best.select("book_slug", "id", F.round("score", 6).alias("score"), _long("sections").alias("sections"), F.array_join("others", ",").alias("others"))


_ORDERED = f"""WITH {_C}, s AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY book_slug) AS total, lead(chapter_title) OVER w AS next_section FROM c
WINDOW w AS (PARTITION BY book_slug ORDER BY page_start ASC NULLS LAST, paragraph ASC NULLS LAST, chunk_id))"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return search.sections(_chunks(spark, d, "chunk_id", "book_slug", "page_start", "paragraph", "chapter_title", "corpus"))


@query(_ORDERED + " SELECT chunk_id, position, total, next_section FROM s")
def expand_section(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("chunk_id", _long("position").alias("position"), _long("total").alias("total"), "next_section")


@query(_ORDERED + " SELECT book_slug, chunk_id, position FROM s WHERE position BETWEEN 3 AND 5")
def expand_page(spark: SparkSession, d: str) -> DataFrame:
    """Of every book the sections 3 to 5."""
    return _sections(spark, d).filter("position BETWEEN 3 AND 5").select("book_slug", "chunk_id", _long("position").alias("position"))


@query(
    f"""WITH {_C} SELECT book_slug, chunk_id, line_start, line_end FROM c WHERE line_end >= 40
QUALIFY row_number() OVER (PARTITION BY book_slug ORDER BY CASE WHEN line_start <= 40 THEN 0 ELSE 1 END, line_start, chunk_id) = 1"""
)
def expand_line(spark: SparkSession, d: str) -> DataFrame:
    """Of every book the chunk that holds line 40, or the first after it."""
    return search.at_line(_chunks(spark, d, "book_slug", "chunk_id", "line_start", "line_end"), 40).select("book_slug", "chunk_id", "line_start", "line_end")


@query(
    _chunk_bm25(
        ["cadastre", "registre"],
        """, t AS (SELECT sc.id, s, length(content) AS l FROM sc JOIN c USING (id) ORDER BY s DESC, id LIMIT 30), u AS (SELECT id, sum(l) OVER (ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 8000""",
    )
)
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    """The best results whose texts fit into 8,000 characters."""
    few = F.broadcast(_chunk_search(spark, d, "cadastre registre", None, 30, ()))  # 30 rows
    top = few.join(one_record(table(spark, d, "chunks").join(few.select("id"), "id", "left_semi"), "id", "content"), "id").withColumn("chars", F.length("content"))
    return search.within_budget(top.withColumn("neg", -F.col("score")), ["neg", "id"], F.col("chars"), 8000).select("id", _long("used").alias("used"))


@query(
    f"""WITH {_C} SELECT id, concat_ws(' > ', nullif(book_title, ''), nullif(chapter_title, '')) AS source, CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start
ELSE 'p. ' || page_start || '-' || page_end END AS page FROM c"""
)
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("page_start").isNull(), None).when(F.col("page_end").isNull() | (F.col("page_end") == F.col("page_start")), F.concat(F.lit("p. "), "page_start")).otherwise(F.concat(F.lit("p. "), "page_start", F.lit("-"), "page_end"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return _chunks(spark, d, "book_title", "chapter_title", "page_start", "page_end").select("id", F.concat_ws(" > ", blank("book_title"), blank("chapter_title")).alias("source"), page.alias("page"))


@query(
    _chunk_bm25(
        ["bail"],
        """SELECT id, round(s, 6) AS score FROM sc WHERE id IN (SELECT chunk_id FROM article_versions WHERE date_debut <= DATE '2015-06-30' AND (date_fin IS NULL OR date_fin >= DATE '2015-06-30')) ORDER BY s DESC, id LIMIT 20""",
    )
)
def search_at_date(spark: SparkSession, d: str) -> DataFrame:
    """Only chunks with a version valid on a day; the semi-join comes before the limit."""
    day = F.lit("2015-06-30").cast("date")
    valid = table(spark, d, "article_versions").filter((F.col("date_debut") <= day) & (F.col("date_fin").isNull() | (F.col("date_fin") >= day))).select(F.col("chunk_id").alias("id"))
    found = _chunk_hits(spark, d, "bail")
    return found.join(valid, "id", "left_semi").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


# ---- embeddings --------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS documents, count(v.vec_id) AS embedded, round(100.0 * count(v.vec_id) / count(*), 6) AS percent FROM documents LEFT JOIN embeddings v ON v.vec_id = doc_id")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    j = table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("embedded")).withColumn("percent", F.round(100.0 * F.col("embedded") / F.col("documents"), 6))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def documents_without_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 1")
def most_frequent_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS square FROM embeddings")
def embeddings_normalised(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("v", search.normalised(F.col("embedding")))
    return v.select("vec_id", F.round(search.dot(F.col("v"), F.col("v")), 5).alias("square"))


# ---- catalogue ---------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_B} SELECT corpus, count(*) AS books, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(total_chars) AS BIGINT) AS chars FROM b GROUP BY corpus")
def corpora_stats(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("books"), F.sum(_long("chunk_count")).alias("chunks"), F.sum("total_chars").alias("chars"))


@query(f"WITH {_C} SELECT count(*) AS chunks, count(DISTINCT corpus) AS corpora, count(*) FILTER (len(tags) > 0) AS tagged, CAST(sum(length(content)) AS BIGINT) AS chars FROM c")
def library_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "corpus", "tags", "content").withColumn("l", F.length("content"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("corpus").alias("corpora"), F.count_if(F.size("tags") > 0).alias("tagged"), F.sum(_long("l")).alias("chars"))


@query(f"WITH {_B} SELECT corpus, title, slug FROM b ORDER BY corpus, title, slug LIMIT 20 OFFSET 20")
def list_books_page(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).orderBy("corpus", "title", "slug").offset(20).limit(20).select("corpus", "title", "slug")


@query(f"WITH {_C} SELECT unnest(tags) AS tag, count(*) AS n FROM c GROUP BY 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tag_counts(_chunks(spark, d, "tags"))


@query(f"WITH {_C} SELECT id, corpus FROM c WHERE list_contains(tags, 'api') AND list_contains(tags, 'archive')")
def tag_filter_all(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_all_tags(_chunks(spark, d, "tags", "corpus"), ["api", "archive"]).select("id", "corpus")


@query(
    f"""WITH {_C}, u AS (SELECT id, unnest(list_append(coalesce(tags, []), 'vu')) AS t FROM c)
SELECT id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM u WHERE t <> 'archive' GROUP BY id"""
)
def tag_set_ops(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tagged(_chunks(spark, d, "tags"), ["vu"], ["archive"]).select("id", F.array_join("tags", ",").alias("tags"))


@query(
    f"""WITH {_C}, {_B}, t AS (SELECT book_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(max(page_end) AS INT) AS pages FROM c GROUP BY book_id)
SELECT b.id, chunks, chars, pages, coalesce(b.chunk_count = chunks AND b.total_chars = chars, false) AS counters_hold FROM b JOIN t ON t.book_id = b.id"""
)
def book_totals(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "book_id", "page_end", "content").withColumn("l", F.length("content"))
    t = c.groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(_long("l")).alias("chars"), F.max("page_end").alias("pages"))
    hold = F.coalesce((_long("chunk_count") == F.col("chunks")) & (F.col("total_chars") == F.col("chars")), F.lit(False))
    return _books(spark, d).join(t, "id").select("id", "chunks", "chars", "pages", hold.alias("counters_hold"))


@query(f"WITH {_B} SELECT slug, filename FROM b WHERE regexp_matches(filename, '\\.(tex|xml)$') AND contains(lower(title), 'taxe')")
def glob_books(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    hit = catalog.matching_glob(F.col("filename"), ".tex") | catalog.matching_glob(F.col("filename"), "*.xml")
    return b.filter(hit & F.contains(F.lower("title"), F.lit("taxe"))).select("slug", "filename")


@query("SELECT coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.parser') END, 'unknown') AS parser, count(*) AS n FROM (SELECT DISTINCT id, metadata FROM books) GROUP BY 1")
def books_by_parser(spark: SparkSession, d: str) -> DataFrame:
    """Broken JSON counts as unknown."""
    return _books(spark, d).groupBy(F.coalesce(F.get_json_object("metadata", "$.parser"), F.lit("unknown")).alias("parser")).agg(F.count(F.lit(1)).alias("n"))


_ROOTED = "f AS (SELECT DISTINCT coalesce(root_path, '/srv/fonds') || '/' || filepath AS path FROM indexed_files), roots AS (SELECT DISTINCT root_path AS root FROM indexed_files WHERE root_path IS NOT NULL)"


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, d, "indexed_files")
    return f.select(F.concat_ws("/", F.coalesce("root_path", F.lit("/srv/fonds")), "filepath").alias("path")).distinct(), f.filter("root_path IS NOT NULL").select(F.col("root_path").alias("root")).distinct()


@query(f"WITH {_ROOTED} SELECT path, arg_max(root, length(root)) AS root FROM f LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY path")
def owning_root(spark: SparkSession, d: str) -> DataFrame:
    return catalog.owning_root(*_paths(spark, d))


@query(
    f"""WITH {_ROOTED}, {_B}, o AS (SELECT path, substr(path, length(arg_max(root, length(root))) + 2) AS filename FROM f JOIN roots ON starts_with(path, root || '/') GROUP BY path)
SELECT path, slug FROM o JOIN b USING (filename) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(filename), slug) = 1"""
)
def path_to_book(spark: SparkSession, d: str) -> DataFrame:
    f, roots = _paths(spark, d)
    return catalog.resolve_path(f, _books(spark, d), roots)


@query(f"WITH {_C} SELECT content_hash, count(*) AS n, count(DISTINCT book_slug) AS books FROM c WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1")
def content_hash_copies(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "content_hash", "book_slug").filter("content_hash IS NOT NULL")
    return c.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("book_slug").alias("books")).filter("n > 1")


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 20) AS ps,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS whole FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(ps) > 0 THEN len(ps) WHEN whole <> '' THEN 1 ELSE 0 END AS paragraphs, md5(CASE WHEN len(ps) > 0 THEN array_to_string(ps, '|') ELSE whole END) AS digest FROM p"""
)
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", _long(F.size("p")).alias("paragraphs"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


@query(f"WITH {_B} SELECT slug, CAST(unnest(generate_series(1, page_count, 50)) AS INT) AS first_page, page_count FROM b WHERE page_count >= 1")
def page_tranches(spark: SparkSession, d: str) -> DataFrame:
    t = jobs.tranches(_books(spark, d))
    return t.join(_books(spark, d).select("slug", "page_count"), "slug").select("slug", "first_page", "page_count")


@query(
    f"""WITH {_C}, n AS (SELECT book_slug, min(id) AS id, CAST(sum(length(content)) AS BIGINT) AS chars FROM c WHERE corpus = 'archives-scan' AND page_start >= 10 AND coalesce(page_end, page_start) <= 20 GROUP BY 1),
k AS (SELECT book_slug, CAST(length(content) AS BIGINT) AS chars FROM c WHERE NOT coalesce(page_start >= 10 AND coalesce(page_end, page_start) <= 20, false) OR book_slug NOT IN (SELECT book_slug FROM n) UNION ALL SELECT book_slug, chars FROM n)
SELECT book_slug, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars FROM k GROUP BY 1"""
)
def replace_page_range(spark: SparkSession, d: str) -> DataFrame:
    """Pages 10 to 20 of scanned books come anew, as one passage; totals of all books after it."""
    c = _chunks(spark, d, "book_slug", "corpus", "page_start", "page_end", "content").withColumn("chars", _long(F.length("content")))
    pages = c.filter("corpus = 'archives-scan' AND page_start >= 10 AND coalesce(page_end, page_start) <= 20")
    new = pages.groupBy("book_slug").agg(F.sum("chars").alias("chars"))
    after = catalog.replace_pages(c.select("book_slug", "chars", "page_start", "page_end"), new, 10, 20)
    return after.groupBy("book_slug").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


@query("SELECT DISTINCT CASE WHEN starts_with(coalesce(root_path, '/srv/fonds') || '/' || filepath, '/mnt/archive/') THEN '/work/copy' || substr(coalesce(root_path, '/srv/fonds') || '/' || filepath, 13) ELSE coalesce(root_path, '/srv/fonds') || '/' || filepath END AS path FROM indexed_files")
def translated_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d)[0].select(catalog.translated(F.col("path"), "/mnt/archive", "/work/copy").alias("path")).distinct()


# ---- graph -------------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT dst_slug AS slug, count(*) AS in_degree FROM e GROUP BY 1")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degrees(_edges(spark, d))


@query(f"WITH {_E} SELECT relation_type, count(*) AS edges FROM e GROUP BY 1 UNION ALL SELECT '*nodes*', count(*) FROM (SELECT src_slug FROM e UNION SELECT dst_slug FROM e)")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(_edges(spark, d))


@query(f"WITH {_E} SELECT dst_slug AS slug, count(*) AS in_degree FROM e GROUP BY 1 ORDER BY in_degree DESC, slug LIMIT 10")
def hubs_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degrees(_edges(spark, d)).orderBy(F.desc("in_degree"), "slug").limit(10)


@query(f"WITH {_E} SELECT DISTINCT slug FROM books WHERE slug NOT IN (SELECT src_slug FROM e UNION SELECT dst_slug FROM e)")
def orphan_books(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_books(spark, d), _edges(spark, d))


@query(
    f"""WITH {_E}, {_B}, n AS (SELECT src_slug AS slug, 'out' AS direction, relation_type, dst_slug AS neighbour FROM e UNION ALL SELECT dst_slug, 'in', relation_type, src_slug FROM e)
SELECT n.*, title FROM n LEFT JOIN b ON b.slug = neighbour"""
)
def neighbours_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _books(spark, d))


# ---- history -----------------------------------------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT * FROM article_versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "article_versions")
    return one_record(t, "id", *[c for c in t.columns if c not in ("id", "loaded_at")])


@query(f"WITH {_V} SELECT article_ref, count(*) AS versions, min(date_debut) AS first_start, max(date_debut) AS last_start FROM v GROUP BY 1")
def versions_summary(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).groupBy("article_ref").agg(F.count(F.lit(1)).alias("versions"), F.min("date_debut").alias("first_start"), F.max("date_debut").alias("last_start"))


@query(f"WITH {_V} SELECT article_ref, id, version_num FROM v WHERE date_debut <= DATE '2016-01-01' AND (date_fin IS NULL OR date_fin >= DATE '2016-01-01') QUALIFY row_number() OVER (PARTITION BY article_ref ORDER BY version_num DESC, id DESC) = 1")
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2016-01-01").cast("date")
    v = _versions(spark, d).filter((F.col("date_debut") <= day) & (F.col("date_fin").isNull() | (F.col("date_fin") >= day)))
    return v.groupBy("article_ref").agg(F.max_by(F.struct("id", "version_num"), F.struct("version_num", "id")).alias("r")).select("article_ref", "r.id", "r.version_num")


@query(
    f"""WITH {_V}, o AS (SELECT *, lag(content) OVER w AS before, lag(etat) OVER w AS etat_before, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY article_ref ORDER BY version_num, id))
SELECT article_ref, id, length(content) - length(before) AS grown, content IS DISTINCT FROM before AS text_changed, etat IS DISTINCT FROM etat_before AS state_changed FROM o WHERE n > 1"""
)
def compare_versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("article_ref").orderBy("version_num", "id")
    v = _versions(spark, d).withColumns({"before": F.lag("content").over(w), "e": F.lag("etat").over(w), "n": F.row_number().over(w)}).filter("n > 1")
    return v.select("article_ref", "id", _long(F.length("content") - F.length("before")).alias("grown"), (~F.col("content").eqNullSafe(F.col("before"))).alias("text_changed"), (~F.col("etat").eqNullSafe(F.col("e"))).alias("state_changed"))


@query(f"WITH {_V} SELECT article_ref, id FROM v QUALIFY row_number() OVER (PARTITION BY article_ref ORDER BY version_num DESC, id DESC) <= 5")
def keep_last_versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("article_ref").orderBy(F.desc("version_num"), F.desc("id"))
    return _versions(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("article_ref", "id")


@query(data_queries.SQL["p7_found"].replace("SELECT article_ref, strftime(min(date_debut)", ", h AS (SELECT article_ref, strftime(min(date_debut)") + ") SELECT article_ref, etat FROM h WHERE valid_from <= '2016-01-01' AND (valid_to = 'open' OR valid_to >= '2016-01-01')")
def history_as_of(spark: SparkSession, d: str) -> DataFrame:
    h = history.article_history(table(spark, d, "article_versions"))
    return history.as_of(h, "2016-01-01").select("article_ref", "etat")


@query(
    """WITH s AS (SELECT book_slug, exported_at AS created_at, substr(md5(text), 1, 12) AS content_hash FROM documents WHERE book_slug IS NOT NULL AND text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_slug ORDER BY created_at, content_hash) AS version_num, row_number() OVER (PARTITION BY book_slug ORDER BY created_at DESC, content_hash DESC) AS age FROM s)
SELECT book_slug, version_num, content_hash FROM n WHERE age <= 50"""
)
def file_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").filter("book_slug IS NOT NULL AND text IS NOT NULL").select("book_slug", F.col("exported_at").alias("created_at"), text.content_hash(F.col("text")).alias("content_hash"))
    return catalog.file_versions(s).select("book_slug", _long("version_num").alias("version_num"), "content_hash")


# ---- sync --------------------------------------------------------------------------------------------------------------------------------------------

_SNAPSHOTS = """i AS (SELECT corpus, filepath, any_value(file_hash) AS file_hash, any_value(file_size) AS file_size, max(indexed_at) AS indexed_at FROM indexed_files GROUP BY ALL),
d AS (SELECT CASE WHEN corpus = 'wiki-interne' THEN 'notes' ELSE corpus END AS corpus, CASE WHEN corpus = 'juris' AND file_size > 10000 THEN 'anciens/' || filepath ELSE filepath END AS filepath,
CASE WHEN corpus = 'doctrine' AND file_size > 20000 THEN reverse(file_hash) ELSE file_hash END AS file_hash, CASE WHEN corpus = 'doctrine' AND file_size > 20000 THEN file_size + 1 ELSE file_size END AS file_size, indexed_at
FROM i WHERE NOT (corpus = 'memento' OR (corpus = 'docs-produit' AND file_size < 5000)) UNION ALL SELECT 'nouveau', slug || '.md', md5(slug), total_chars, indexed_at FROM (SELECT DISTINCT slug, total_chars, indexed_at FROM books WHERE removed_at IS NOT NULL))"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is indexed, and a listing in which one folder was renamed, one corpus moved into another, some files changed, were deleted or added."""
    i = table(spark, d, "indexed_files").groupBy("corpus", "filepath").agg(F.max("file_hash").alias("file_hash"), F.max("file_size").alias("file_size"), F.max("indexed_at").alias("indexed_at"))
    big = (F.col("corpus") == "doctrine") & (F.col("file_size") > 20000)
    disk = i.filter("NOT (corpus = 'memento' OR (corpus = 'docs-produit' AND file_size < 5000))").select(
        F.when(F.col("corpus") == "wiki-interne", "notes").otherwise(F.col("corpus")).alias("corpus"),
        F.when((F.col("corpus") == "juris") & (F.col("file_size") > 10000), F.concat(F.lit("anciens/"), "filepath")).otherwise(F.col("filepath")).alias("filepath"),
        F.when(big, F.reverse("file_hash")).otherwise(F.col("file_hash")).alias("file_hash"), F.when(big, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "indexed_at",
    )
    new = table(spark, d, "books").filter("removed_at IS NOT NULL").select("slug", "total_chars", "indexed_at").distinct()
    return i, disk.unionByName(new.select(F.lit("nouveau").alias("corpus"), F.concat("slug", F.lit(".md")).alias("filepath"), F.md5("slug").alias("file_hash"), F.col("total_chars").alias("file_size"), "indexed_at"))


@query(
    f"""WITH {_SNAPSHOTS},
j AS (SELECT coalesce(i.corpus, d.corpus) AS corpus, coalesce(i.filepath, d.filepath) AS filepath, i.file_hash AS a, d.file_hash AS z, CASE WHEN i.filepath IS NULL THEN 'added' WHEN d.filepath IS NULL THEN 'removed' WHEN i.file_hash IS NOT DISTINCT FROM d.file_hash THEN 'unchanged' ELSE 'modified' END AS change
      FROM i FULL JOIN d ON i.corpus = d.corpus AND i.filepath = d.filepath),
g AS (SELECT corpus, filepath, a AS h, row_number() OVER (PARTITION BY a, corpus ORDER BY filepath) AS no FROM j WHERE change = 'removed'),
n AS (SELECT corpus, filepath, z AS h, row_number() OVER (PARTITION BY z, corpus ORDER BY filepath) AS no FROM j WHERE change = 'added'),
m AS (SELECT n.corpus, n.filepath, n.h, g.corpus AS fc, g.filepath AS fp FROM n JOIN g ON g.h = n.h AND g.corpus = n.corpus AND g.no = n.no),
g2 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY corpus, filepath) AS k FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE fc = g.corpus AND fp = g.filepath)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY corpus, filepath) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.corpus = n.corpus AND m.filepath = n.filepath)),
x AS (SELECT n2.corpus, n2.filepath, n2.h, g2.corpus AS fc, g2.filepath AS fp FROM n2 JOIN g2 ON g2.h = n2.h AND g2.k = n2.k)
SELECT change, corpus, filepath, coalesce(z, a) AS file_hash, NULL AS from_corpus, NULL AS from_path FROM j WHERE change NOT IN ('added', 'removed')
UNION ALL SELECT 'moved', corpus, filepath, h, fc, fp FROM m UNION ALL SELECT 'cross_moved', corpus, filepath, h, fc, fp FROM x
UNION ALL SELECT 'removed', corpus, filepath, h, NULL, NULL FROM g2 WHERE NOT EXISTS (SELECT 1 FROM x WHERE fc = g2.corpus AND fp = g2.filepath)
UNION ALL SELECT 'added', corpus, filepath, h, NULL, NULL FROM n2 WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.corpus = n2.corpus AND x.filepath = n2.filepath)"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.snapshot_diff(*_snapshots(spark, d))


@query(
    f"""WITH {_SNAPSHOTS} SELECT CASE WHEN i.filepath IS NULL THEN 'added' WHEN d.filepath IS NULL THEN 'removed' WHEN i.file_size IS NOT DISTINCT FROM d.file_size THEN 'unchanged' ELSE 'modified' END AS change,
coalesce(i.corpus, d.corpus) AS corpus, coalesce(i.filepath, d.filepath) AS filepath FROM i FULL JOIN d ON i.corpus = d.corpus AND i.filepath = d.filepath"""
)
def quick_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.quick_diff(*_snapshots(spark, d))


@query(
    f"""WITH {_SNAPSHOTS} SELECT coalesce(i.corpus, d.corpus) AS corpus, coalesce(i.filepath, d.filepath) AS filepath, CASE WHEN d.filepath IS NULL THEN 'GONE' WHEN i.filepath IS NULL THEN 'NEW' WHEN d.file_size <= 2097152 AND i.file_hash IS DISTINCT FROM d.file_hash THEN 'STALE'
WHEN d.file_size > 2097152 AND i.file_size IS DISTINCT FROM d.file_size THEN 'STALE' ELSE 'ok' END AS verdict FROM i FULL JOIN d ON i.corpus = d.corpus AND i.filepath = d.filepath"""
)
def freshness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    i, disk = _snapshots(spark, d)
    return sync.freshness(i, disk.withColumnRenamed("indexed_at", "modified_at"))


@query("SELECT filepath, corpus, arg_max(file_hash, (indexed_at, file_hash)) AS file_hash, max(indexed_at) AS indexed_at FROM indexed_files GROUP BY filepath, corpus")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they came before the middle of 2024 are the state, later ones upserts."""
    f = table(spark, d, "indexed_files")
    best = F.max_by("file_hash", F.struct("indexed_at", "file_hash"))
    one = lambda df: df.groupBy("filepath", "corpus").agg(best.alias("file_hash"), F.max("indexed_at").alias("indexed_at"))
    late = F.coalesce(F.col("indexed_at") >= F.lit("2024-07-01").cast("timestamp"), F.lit(False))
    return catalog.upsert(one(f.filter(~late)), one(f.filter(late)), ["filepath", "corpus"]).select("filepath", "corpus", "file_hash", "indexed_at")


@query(
    f"""WITH {_C}, {_B}, {_E}, gone AS (SELECT id, slug FROM b WHERE removed_at IS NOT NULL)
SELECT 'books' AS table_name, count(*) AS rows_left FROM b WHERE removed_at IS NULL UNION ALL SELECT 'chunks', count(*) FROM c WHERE book_id IS NULL OR book_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*) FROM e WHERE src_slug NOT IN (SELECT slug FROM gone) AND dst_slug NOT IN (SELECT slug FROM gone)"""
)
def remove_cascade(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    left = catalog.remove_books(b.filter("removed_at IS NOT NULL").select("slug"), b, table(spark, d, "chapters"), _chunks(spark, d, "book_id"), _edges(spark, d))
    one = lambda t: left[t].agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left")
    return one("books").unionByName(one("chunks")).unionByName(one("edges"))


# ---- queue -------------------------------------------------------------------------------------------------------------------------------------------

_JOBS = """j AS (SELECT event_id AS id, event_type AS type, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 10 WHEN 'view' THEN 10 WHEN 'purchase' THEN 40 ELSE 60 END AS priority, props AS payload,
CASE WHEN value < 20 THEN 'pending' WHEN value < 50 THEN 'running' WHEN value < 120 THEN 'done' ELSE 'failed' END AS status, ts AS created_at, CAST(floor(value) AS BIGINT) % 5 AS attempts FROM events)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs of a queue."""
    e = table(spark, d, "events")
    p = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type").isin("click", "view"), 10).when(F.col("event_type") == "purchase", 40).otherwise(60)
    s = F.when(F.col("value") < 20, "pending").when(F.col("value") < 50, "running").when(F.col("value") < 120, "done").otherwise("failed")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), p.alias("priority"), F.col("props").alias("payload"), s.alias("status"), F.col("ts").alias("created_at"), (F.floor("value").cast("bigint") % 5).alias("attempts"))


@query(f"WITH {_JOBS} SELECT type, status, count(*) AS n FROM j GROUP BY ALL")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JOBS} SELECT id, type, row_number() OVER (ORDER BY priority, created_at, id) AS turn FROM j WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 64")
def dequeue_order(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim_order(_jobs(spark, d), 64).select("id", "type", _long("turn").alias("turn"))


@query(f"WITH {_JOBS} SELECT DISTINCT type, payload FROM j WHERE status = 'done' AND (type, payload) NOT IN (SELECT (type, payload) FROM j WHERE status = 'pending')")
def enqueue_dedup(spark: SparkSession, d: str) -> DataFrame:
    j = _jobs(spark, d)
    return jobs.enqueue(j, j.filter("status = 'done'").select("type", "payload"))


@query(
    f"""WITH {_JOBS}, f AS (SELECT *, row_number() OVER (PARTITION BY type, payload ORDER BY attempts DESC, id) AS rn FROM j WHERE status = 'failed')
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.status = 'pending' AND j.type = f.type AND j.payload = f.payload) THEN 'twin' WHEN rn > 1 THEN 'duplicate' ELSE 'requeue' END AS verdict FROM f"""
)
def retry_failed(spark: SparkSession, d: str) -> DataFrame:
    return jobs.retry_failed(_jobs(spark, d))


@query(
    f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY type, payload ORDER BY created_at, id) AS rn FROM j WHERE status = 'running')
SELECT id, CASE WHEN created_at >= TIMESTAMP '2024-01-20' - INTERVAL 3 HOUR THEN 'keep' WHEN attempts >= 3 THEN 'failed' WHEN rn > 1 THEN 'drop' ELSE 'pending' END AS verdict FROM r"""
)
def reap_zombies(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reap(_jobs(spark, d), F.lit("2024-01-20").cast("timestamp"))


@query(f"WITH {_JOBS} SELECT id FROM j WHERE status IN ('done', 'failed') AND created_at >= TIMESTAMP '2024-01-28' - INTERVAL 14 DAY ORDER BY id DESC LIMIT 20000")
def job_retention(spark: SparkSession, d: str) -> DataFrame:
    return jobs.retained(_jobs(spark, d), F.lit("2024-01-28").cast("timestamp"), 14).select("id")


@query(
    """WITH o AS (SELECT event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT event_type AS type, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS changes FROM n GROUP BY event_type, no"""
)
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    return jobs.debounced(table(spark, d, "events").withColumnRenamed("event_type", "type"), "type", "ts", "10 minutes")


@query(
    f"""WITH {_JOBS}, q AS (SELECT j.*, user_id AS project FROM j JOIN events ON event_id = j.id WHERE status = 'pending'),
a AS (SELECT * FROM q QUALIFY type NOT IN ('signup') OR row_number() OVER (PARTITION BY project, type ORDER BY priority, created_at, id) = 1),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY type ORDER BY priority, created_at, id) <= CASE type WHEN 'click' THEN 5 WHEN 'signup' THEN 40 ELSE 200 END)
SELECT id, type, project FROM c ORDER BY priority, created_at, id LIMIT 200"""
)
def fair_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Users as projects; one job of an exclusive type for each, caps by type."""
    owner = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project"))
    return jobs.dispatch(_jobs(spark, d).join(owner, "id"), {"click": 5, "signup": 40}, ["signup"], 200).select("id", "type", "project")


# ---- audit -------------------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_JOBS} SELECT type, payload, count(*) FILTER (status = 'done') AS made, count(*) FILTER (status = 'failed') AS lost FROM j GROUP BY ALL HAVING count(*) FILTER (status = 'done') >= 3 AND count(*) FILTER (status = 'failed') >= 1"""
)
def audit_churn(spark: SparkSession, d: str) -> DataFrame:
    return audit.churn(_jobs(spark, d))


@query(f"WITH {_B}, f AS (SELECT DISTINCT book_slug FROM indexed_files WHERE book_slug IS NOT NULL) SELECT slug, corpus FROM b WHERE slug IS NOT NULL AND slug NOT IN (SELECT book_slug FROM f)")
def audit_untracked_books(spark: SparkSession, d: str) -> DataFrame:
    return audit.untracked_books(_books(spark, d), table(spark, d, "indexed_files")).select("slug", "corpus")


@query("WITH f AS (SELECT DISTINCT filepath, corpus, book_slug FROM indexed_files WHERE book_slug IS NOT NULL), g AS (SELECT book_slug, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS identities, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS surplus, coalesce(max(n), 0) AS worst FROM g")
def audit_shared_identities(spark: SparkSession, d: str) -> DataFrame:
    return audit.shared_identities(table(spark, d, "indexed_files"))


@query(f"WITH {_C}, {_B} SELECT slug FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book_id = b.id)")
def audit_mute_books(spark: SparkSession, d: str) -> DataFrame:
    return audit.mute_books(_books(spark, d), _chunks(spark, d, "book_id"))


@query(f"WITH {_B} SELECT slug, page_count, total_chars FROM b WHERE page_count = 1 AND total_chars > 20000")
def audit_impossible_pages(spark: SparkSession, d: str) -> DataFrame:
    return audit.impossible_pages(_books(spark, d))


@query(f"WITH {_C} SELECT corpus, count(*) AS unreadable FROM c WHERE content IS NULL OR trim(content) = '' OR contains(content, chr(65533)) OR content_chars IS DISTINCT FROM length(content) GROUP BY corpus")
def audit_doubtful_passages(spark: SparkSession, d: str) -> DataFrame:
    return audit.doubtful_passages(_chunks(spark, d, "corpus", "content", "content_chars"))


@query(f"WITH {_JOBS} SELECT id, type FROM j WHERE status = 'running' AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR")
def audit_stranded_jobs(spark: SparkSession, d: str) -> DataFrame:
    return audit.stranded(_jobs(spark, d), F.lit("2024-01-20").cast("timestamp"))


@query(
    f"""WITH {_C}, {_B}, n AS (SELECT book_id, count(*) AS n FROM c GROUP BY 1) SELECT corpus, count(*) AS books, count(*) FILTER (n > 0) AS readable, count(*) FILTER (n IS NULL AND removed_at IS NULL) AS missing,
count(*) FILTER (removed_at IS NOT NULL) AS removed FROM b LEFT JOIN n ON n.book_id = b.id GROUP BY corpus"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(_books(spark, d), _chunks(spark, d, "book_id"))


@query(
    f"""WITH {_C}, {_B}, n AS (SELECT book_id, count(*) AS n, sum(length(content)) AS l FROM c GROUP BY 1)
SELECT slug, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN page_count > 0 AND l / page_count < 20 THEN 'scan' ELSE 'ok' END AS health FROM b LEFT JOIN n ON n.book_id = b.id WHERE ends_with(filename, '.pdf')"""
)
def pdf_health(spark: SparkSession, d: str) -> DataFrame:
    return audit.pdf_health(_books(spark, d), _chunks(spark, d, "book_id", "content"))


@query(f"WITH {_C} SELECT id, book_slug FROM c WHERE chunk_id IS NOT NULL AND book_slug IS NOT NULL AND NOT starts_with(chunk_id, book_slug)")
def fossil_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose id doesn't begin with the slug of their book; an underscore is no wildcard."""
    return audit.fossils(_chunks(spark, d, "chunk_id", "book_slug"))


@query(
    """WITH w AS (SELECT source, CASE WHEN text IS NULL THEN 'null text' WHEN text = '' THEN 'empty' WHEN n_chars IS DISTINCT FROM length(text) THEN 'wrong count' WHEN lang IS NULL THEN 'no language' END AS bucket FROM documents)
SELECT bucket, count(*) AS n, count(DISTINCT source) AS sources FROM w WHERE bucket IS NOT NULL GROUP BY bucket"""
)
def failure_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("text").isNull(), "null text").when(F.col("text") == "", "empty").when(~_long("n_chars").eqNullSafe(_long(F.length("text"))), "wrong count").when(F.col("lang").isNull(), "no language")
    return table(spark, d, "documents").select("source", b.alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


_CARDS = "k AS (SELECT corpus, filename AS filepath, any_value(title) AS title, any_value(CASE WHEN corpus IN ('juris', 'doctrine') THEN 'Fonds ' || corpus END) AS author FROM books WHERE filename IS NOT NULL GROUP BY ALL)"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").filter("filename IS NOT NULL").groupBy("corpus", F.col("filename").alias("filepath")).agg(F.max("title").alias("title"))
    author = F.when(F.col("corpus").isin("juris", "doctrine"), F.concat(F.lit("Fonds "), "corpus"))
    return b.select("corpus", "filepath", "title", author.alias("author"), F.lit("report").alias("nature"), F.lit(1).alias("first_page"), F.lit(None).cast("int").alias("last_page"))


@query(f"WITH {_CARDS} SELECT corpus, filepath, coalesce(trim(author) <> '' AND trim(title) <> '', false) AS attributed FROM k")
def cards_attributed(spark: SparkSession, d: str) -> DataFrame:
    return catalog.cards_valid(_cards(spark, d), ["report"]).filter("valid").select("corpus", "filepath", "attributed")


@query(f"WITH {_CARDS} SELECT corpus, filepath FROM k WHERE NOT EXISTS (SELECT 1 FROM indexed_files f WHERE f.corpus = k.corpus AND f.filepath = k.filepath)")
def cards_unknown_files(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("corpus", "filepath").join(table(spark, d, "indexed_files").select("corpus", "filepath"), ["corpus", "filepath"], "left_anti")
