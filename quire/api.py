"""One entry point for ranked search over a library's tables: query, filters, reranking, one result for each source, lines to show."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import graph, index, search

#: Columns that full text covers.
COLUMNS = ["chunk_id", "content", "book_title", "chapter_title"]


def number(value: object, default: float) -> float:
    """As whole_number, for numbers of any kind."""
    if isinstance(value, bool) or value is None:
        return default
    try:
        return float(str(value))
    except ValueError:
        return default


def whole_number(value: object, default: int) -> int:
    """A parameter as callers give it: numbers and numerals; anything else, truth values too, is the default."""
    if isinstance(value, bool) or value is None:
        return default
    try:
        return int(float(str(value)))
    except ValueError:
        return default


@dataclass(frozen=True)
class Search:
    """Search(chunks, books, edges, vectors).text("...").of(corpus="juris").rerank(...).results(10). chunks: the chunk table, rows with one chunk_id being one chunk; vectors: (chunk_id, vector) or None.
    Filters come before limits. A kind that needs vectors falls back to text where there are none."""

    chunks: DataFrame
    books: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    query: str = ""
    kind: str = "text"
    query_vector: tuple[float, ...] | None = None
    where: Column | None = None
    freshness: float = 0.0
    centrality: float = 0.0
    now: str = ""
    most: int = 150
    gone: DataFrame | None = None

    def text(self, query: str) -> Search:
        return replace(self, query=query, kind="text")

    def semantic(self, vector: list[float]) -> Search:
        return replace(self, query_vector=tuple(vector), kind="semantic")

    def hybrid(self, query: str, vector: list[float]) -> Search:
        return replace(self, query=query, query_vector=tuple(vector), kind="hybrid")

    def of(self, corpus: str | list[str] | None = None, book: str | None = None, tags: list[str] | None = None) -> Search:
        c = F.lit(True) if self.where is None else self.where
        if corpus is not None:
            c = c & F.col("corpus").isin([corpus] if isinstance(corpus, str) else corpus)
        if book is not None:
            c = c & (F.col("book_slug") == book)
        if tags:
            c = c & F.forall(F.array(*[F.lit(t) for t in tags]), lambda t: F.array_contains("tags", t))
        return replace(self, where=c)

    def rerank(self, freshness: float, centrality: float, now: str) -> Search:
        return replace(self, freshness=freshness, centrality=centrality, now=now)

    def without(self, gone: DataFrame) -> Search:
        """Leaves out what is known to be gone: (corpus, filepath) of deleted files (see sync.freshness)."""
        return replace(self, gone=gone)

    def context(self, subject: str, vector: list[float] | None = None) -> Search:
        """What a caller wants to read on a subject: by text, or by text and vector where there is one."""
        return self.text(subject) if vector is None or self.vectors is None else self.hybrid(subject, vector)

    def expand(self, book: str, n: int = 5) -> DataFrame:
        """Of one book the best passages for the query, or where none matches its first in reading order: (chunk_id, book_slug, score)."""
        hits = self.of(book=book).scored().orderBy(F.desc("score"), "chunk_id").limit(n)
        if not hits.isEmpty():
            return hits
        own = self.chunks.filter(F.col("book_slug") == book).dropDuplicates(["chunk_id"])
        return own.orderBy(F.col("page_start").asc_nulls_last(), F.col("paragraph").asc_nulls_last(), "chunk_id").limit(n).select("chunk_id", "book_slug", F.lit(0.0).alias("score"))

    def scored(self) -> DataFrame:
        """(chunk_id, book_slug, score) of all hits."""
        keep = ["book_slug", "corpus", "tags"]
        found = None
        if self.kind != "semantic" or self.vectors is None:
            found = index.search(self.chunks, "chunk_id", COLUMNS, self.query, keep, self.where, "loaded_at" if "loaded_at" in self.chunks.columns else None)
        if self.kind == "hybrid" and self.vectors is not None:
            info = self.chunks.select("chunk_id", "book_slug").dropDuplicates(["chunk_id"])
            own = self.vectors if self.where is None else self.vectors.join(self.chunks.filter(self.where).select("chunk_id").distinct(), "chunk_id", "left_semi")
            scored = search.hybrid(found, own, "chunk_id", list(self.query_vector), self.most)
            found = info.join(F.broadcast(scored), "chunk_id")  # `most` rows
        elif found is None:
            own = self.chunks.select("chunk_id", *keep).dropDuplicates(["chunk_id"])
            v = self.vectors.select("chunk_id", search.dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in self.query_vector])).alias("score"))
            found = (own if self.where is None else own.filter(self.where)).join(v, "chunk_id")
        if self.gone is not None:
            files = self.gone.select("corpus", F.col("filepath").alias("book_file")).distinct()
            alive = self.chunks.select("chunk_id", "corpus", "book_file").join(files, ["corpus", "book_file"], "left_anti").select("chunk_id").distinct()
            found = found.join(alive, "chunk_id", "left_semi")
        return found.select("chunk_id", "book_slug", "score")

    def results(self, k: int = 10, per_source: bool = True, fetch: int = 5) -> DataFrame:
        """(rank, book_slug, chunk_id, score, sections, others): the best of `fetch` times k hits, reranked, and one for each source."""
        top = self.scored().orderBy(F.desc("score"), "chunk_id").limit(k * fetch)
        if (self.freshness or self.centrality) and self.books is not None:
            edges = graph.distinct_edges(self.edges) if self.edges is not None else self.books.select(F.col("slug").alias("src_slug"), F.col("slug").alias("dst_slug")).limit(0)
            slugs = self.books.select("slug", "indexed_at").dropDuplicates(["slug"])
            top = search.reranked(top.withColumnRenamed("book_slug", "slug"), slugs, graph.in_degrees(edges), self.now, self.freshness, self.centrality).withColumnRenamed("slug", "book_slug")
        if per_source:
            top = search.best_per_source(top, "book_slug", "chunk_id")
        else:
            top = top.withColumns({"sections": F.lit(1).cast("bigint"), "others": F.array().cast("array<string>")})
        best = top.orderBy(F.desc("score"), "chunk_id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).select("rank", "book_slug", "chunk_id", "score", "sections", "others")

    def lines(self, k: int = 10) -> DataFrame:
        """(rank, line): results as text, with their place in the source."""
        r = self.results(k).join(self.chunks.select("chunk_id", "book_file", "chapter_title", "line_start", "line_end").dropDuplicates(["chunk_id"]), "chunk_id")
        place = F.when(F.col("line_start").isNotNull(), F.concat(F.lit(" L"), F.col("line_start").cast("string"), F.lit("-"), F.coalesce("line_end", "line_start").cast("string"))).otherwise("")
        more = F.when(F.col("sections") > 1, F.concat(F.lit(" (+"), (F.col("sections") - 1).cast("string"), F.lit(" more)"))).otherwise("")
        return r.select("rank", F.concat(F.coalesce("book_file", "book_slug"), place, F.coalesce(F.concat(F.lit(" | "), "chapter_title"), F.lit("")), more).alias("line"))


class Projects:
    """Several libraries, each under the path of its project. A name is the last part of a path; one that two projects share must be said as a path."""

    def __init__(self, by_path: dict[str, Search]) -> None:
        self.by_path = {p.rstrip("/"): s for p, s in by_path.items()}

    def find(self, name: str) -> Search:
        name = (name or "").strip().rstrip("/")
        if not name:
            raise LookupError("no project named")
        if "/" in name:
            if name not in self.by_path:
                raise LookupError(f"no index under {name!r}")
            return self.by_path[name]
        same = sorted(p for p in self.by_path if p.rsplit("/", 1)[-1] == name)
        if not same:
            raise LookupError(f"no project {name!r}; there are {', '.join(sorted(self.by_path)) or 'none'}")
        if len(same) > 1:
            raise LookupError(f"{len(same)} projects are called {name!r}: {', '.join(same)}")
        return self.by_path[same[0]]


def as_dicts(results: DataFrame) -> list[dict]:
    """Results, which are few, as plain values."""
    return [r.asDict(recursive=True) for r in results.collect()]


def as_markdown(results: DataFrame) -> DataFrame:
    """(rank, line): results (rank, book_slug, content) as a section each."""
    return results.select("rank", F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), "book_slug", F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("line"))
