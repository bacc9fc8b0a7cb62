"""Ranked search: BM25 over several columns, exact vector search, hybrid scores, reranking, one result for each source, and reading on in a source."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import phrases, terms
from quire.operators.skew import numbered
from quire.session import spread, written

K1, B = 1.2, 0.75


def _occurrences(columns: list[str], phrase: tuple[str, ...]) -> Column:
    """How often a phrase stands in the columns; it never reaches from one into the next."""
    if len(phrase) == 1:
        one = lambda c: F.size(f"_t_{c}") - F.size(F.array_remove(f"_t_{c}", phrase[0]))
    else:
        # blanks on both sides of every term, so that neighbouring phrases share none
        needle = "  ".join(phrase)
        one = lambda c: (F.size(F.split(F.concat(F.lit(" "), F.array_join(f"_t_{c}", "  "), F.lit(" ")), f" {needle} ")) - 1)
    return reduce(Column.__add__, [one(c) for c in columns])


def term_counts(docs: DataFrame, key: str, columns: list[str], wanted: list[tuple[str, ...]], keep: list[str]) -> DataFrame:
    """(key, keep..., len, tf_0...): one row for each key; texts are reduced to numbers before anything is shuffled. Null columns count as empty."""
    split = spread(docs.select(key, *dict.fromkeys([*keep, *columns]))).select(key, *keep, *[terms(F.col(c)).alias(f"_t_{c}") for c in columns])
    size = reduce(Column.__add__, [F.size(f"_t_{c}") for c in columns])
    counted = split.select(key, *keep, size.alias("len"), *[_occurrences(columns, p).alias(f"tf_{i}") for i, p in enumerate(wanted)])
    return counted.dropDuplicates([key])


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, keep: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(key, keep..., score) of the rows that hold a word of the query. Statistics are those of all rows, also where `where` limits the results. A word that
    is repeated counts twice; one held by more than half of the rows weighs next to nothing. A query without words finds nothing."""
    keep = keep or []
    all_ = phrases(query)
    wanted = sorted(set(all_))
    counts = term_counts(docs, key, columns, wanted, keep)
    if not wanted:
        return counts.select(key, *keep, F.lit(0.0).alias("score")).filter(F.lit(False))
    counts = written(counts)  # a few numbers for each row, so that the texts are read and split once
    held = [F.sum((F.col(f"tf_{i}") > 0).cast("int")).alias(f"df_{i}") for i in range(len(wanted))]
    s = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *held).first()
    score = F.lit(0.0)
    for i, p in enumerate(wanted):
        df = s[f"df_{i}"] or 0
        idf = float(np.log((s["n"] - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf_{i}")
        norm = K1 * (1 - B + B * F.col("len") / (s["avg"] or 1.0))
        score = score + all_.count(p) * (idf if idf > 0 else 1e-6) * tf * (K1 + 1) / (tf + norm)
    hit = reduce(Column.__or__, [F.col(f"tf_{i}") > 0 for i in range(len(wanted))])
    found = counts.filter(hit & where if where is not None else hit)
    return found.select(key, *keep, score.alias("score"))


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The best k with their rank; ties go by key."""
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def _places(column: str, phrase: tuple[str, ...], prefix: bool = False) -> Column:
    """The places (from 1) in a column's terms at which a phrase begins; with prefix, its last word may go on."""
    t = F.col(f"_t_{column}")
    last = len(phrase) - 1

    def here(i: Column) -> Column:
        one = lambda k, w: F.startswith(F.get(t, i + k - 1), F.lit(w)) if prefix and k == last else F.get(t, i + k - 1) == w
        return reduce(Column.__and__, [one(k, w) for k, w in enumerate(phrase)])

    return F.filter(F.when(F.size(t) > last, F.sequence(F.lit(1), F.size(t) - last)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(here(i), F.lit(False)))


class Expression:
    """A boolean query: words, "phrases", pre*, "phrase pre"*, ^first, NEAR(a "b c", 5), AND, OR, NOT, brackets, and column : word. Words side by side mean AND; NOT binds closest, then AND, then OR."""

    def __init__(self, text: str, columns: list[str]) -> None:
        import re

        self.tokens = re.findall(r'"[^"]*"\*?|NEAR\(|\(|\)|:|,|\^|[^\s():",^]+', text)
        self.columns = columns
        self.at = 0

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def condition(self) -> Column:
        """On the columns _t_<name> of term arrays."""
        c = self._or()
        if self._peek() is not None:
            raise ValueError(f"unexpected {self._peek()!r}")
        return c

    def _or(self) -> Column:
        c = self._and()
        while self._peek() == "OR":
            self._next()
            c = c | self._and()
        return c

    def _and(self) -> Column:
        c = self._not()
        while self._peek() not in (None, "OR", ")"):
            if self._peek() == "AND":
                self._next()
            c = c & self._not()
        return c

    def _not(self) -> Column:
        if self._peek() == "NOT":
            self._next()
            return ~self._not()
        return self._word()

    def _word(self) -> Column:
        if self._peek() is None:
            raise ValueError("a word is missing at the end")
        t = self._next()
        if t == "(":
            c = self._or()
            self._close()
            return c
        if t == "NEAR(":
            return self._near(self.columns)
        if self._peek() == ":":
            if t not in self.columns:
                raise ValueError(f"no column {t!r}")
            self._next()
            t, columns = self._next(), [t]
            return self._near(columns) if t == "NEAR(" else self._match(columns, t)
        return self._match(self.columns, t)

    def _close(self) -> None:
        if self._peek() != ")":
            raise ValueError("a bracket is not closed")
        self._next()

    @staticmethod
    def _parts(t: str) -> tuple[str, ...]:
        return tuple(x for p in phrases(t.strip('"*')) for x in p)

    def _near(self, columns: list[str]) -> Column:
        """All phrases within one column, with no more than so many terms (10 if not said) between the first and the last of them."""
        some, within = [], 10
        while self._peek() not in (None, ")", ","):
            t = self._next()
            some.append((self._parts(t), t.endswith("*")))
        if self._peek() == ",":
            self._next()
            within = int(self._next())
        self._close()
        if not some or not all(p for p, _ in some):
            return F.lit(False)

        def inside(c: str) -> Column:
            # from the end of any phrase to the beginning of the last one
            places = [_places(c, p, star) for p, star in some]

            def chosen(k: int, begins: Column, ends: Column) -> Column:
                if k == len(some):
                    return begins - ends <= within
                return F.exists(places[k], lambda i: chosen(k + 1, F.greatest(begins, i), F.least(ends, i + len(some[k][0]))))

            return F.exists(places[0], lambda i: chosen(1, i, i + len(some[0][0])))

        return reduce(Column.__or__, [inside(c) for c in columns])

    def _match(self, columns: list[str], t: str) -> Column:
        first = t == "^"
        t = self._next() if first else t
        prefix = t.endswith("*")
        parts = self._parts(t)
        if not parts:
            return F.lit(False)
        if first:
            return reduce(Column.__or__, [F.array_contains(_places(c, parts, prefix), 1) for c in columns])
        if prefix and len(parts) == 1:
            return reduce(Column.__or__, [F.exists(f"_t_{c}", lambda x: F.startswith(x, F.lit(parts[0]))) for c in columns])
        if prefix:
            return reduce(Column.__or__, [F.size(_places(c, parts, True)) > 0 for c in columns])
        return _occurrences(columns, parts) > 0


def matching(docs: DataFrame, key: str, columns: list[str], expression: str) -> DataFrame:
    """The keys of the rows that a boolean query matches. Texts are split once, in a step that conditions are not folded into."""
    split = F.struct(*[terms(F.col(c)).alias(f"_t_{c}") for c in columns])
    once = docs.select(F.col(key), F.explode(F.array(split)).alias("_s")).select(key, "_s.*")
    return once.filter(Expression(expression, columns).condition()).select(key).distinct()


#: Queries up to this many numbers in all are sent to every worker.
SENT = 4_000_000


def _best(queries: np.ndarray, ids: np.ndarray, has: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors (ids `has`, in order) for each query."""
    scores = queries @ vectors.T
    rounded = -np.round(scores, 12)
    best = np.argsort(rounded, axis=1, kind="stable")[:, :k]
    rows = np.arange(len(ids))[:, None]
    return pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "id": has[best].ravel(), "score": scores[rows, best].ravel()})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, vector) the k vectors (id, vector) with the greatest dot product, ties by id; all vectors are compared, none left out. Rows with a null
    vector are left out; of repeated ids each row counts.

    Queries of SENT numbers at most go to every worker, and the vectors are scanned where they lie, one matrix product for each batch, from which only the best k of each query go on. More queries are
    dealt into blocks of about `block` rows, as are the vectors; each pair of blocks is one product."""
    asks = queries.filter("vector IS NOT NULL").select("query_id", "vector")
    size = asks.agg(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    schema = "query_id bigint, id bigint, score double"
    if size <= SENT:
        rows = asks.collect()  # SENT numbers at most
        held = queries.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["vector"]) if rows else 0)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            best: pd.DataFrame | None = None
            for b in batches:
                if len(b) and len(ids):
                    b = b.sort_values("id")
                    one = _best(q, ids, b["id"].to_numpy(), np.stack(b["vector"].to_numpy()).astype(np.float64), k)
                    both = one if best is None else pd.concat([best, one])
                    both = both.assign(r=-both["score"].round(12)).sort_values(["query_id", "r", "id"], kind="stable")
                    best = both.groupby("query_id", sort=False).head(k).drop(columns="r")
            if best is not None:
                yield best

        parts = spread(vectors.filter("vector IS NOT NULL").select("id", "vector")).mapInPandas(scan, schema)
    else:
        nq, nv = max(1, asks.count() // block), max(1, vectors.count() // block)
        q = asks.select(F.col("query_id").alias("id"), "vector", F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
        v = vectors.filter("vector IS NOT NULL").select("id", "vector", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"))

        def product(both: pd.DataFrame) -> pd.DataFrame:
            asks, has = both[both["asks"]], both[~both["asks"]].sort_values("id")
            if not len(asks) or not len(has):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            return _best(np.stack(asks["vector"].to_numpy()).astype(np.float64), asks["id"].to_numpy(), has["id"].to_numpy(), np.stack(has["vector"].to_numpy()).astype(np.float64), k)

        parts = q.unionByName(v).groupBy("qb", "vb").applyInPandas(product, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def hybrid(text_scored: DataFrame, vectors: DataFrame, key: str, query_vector: list[float], most: int, text_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """(key, score): the best `most` text candidates, their text score over its maximum and the cosine with the query vector in a weighted sum; without a vector its part is 0. Without any candidate,
    the `most` vectors nearest to the query, by the cosine alone. Vectors are reduced to those of the candidates before anything is computed."""
    cosine = dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query_vector]))
    cand = text_scored.select(key, "score").orderBy(F.desc("score"), key).limit(most)
    top = cand.agg(F.max("score").alias("m")).first()["m"]
    if top is None:
        return vectors.filter("vector IS NOT NULL").select(key, cosine.alias("score")).orderBy(F.desc("score"), key).limit(most)
    few = F.broadcast(cand)  # `most` rows
    v = vectors.join(few.select(key), key, "left_semi").select(key, cosine.alias("cosine"))
    both = cand.join(F.broadcast(v), key, "left")
    return both.select(key, (text_weight * F.col("score") / (top or 1.0) + vector_weight * F.coalesce("cosine", F.lit(0.0))).alias("score"))


def reranked(results: DataFrame, books: DataFrame, in_degree: DataFrame, now: str, freshness: float, centrality: float) -> DataFrame:
    """results (slug, score, rank, ...) with the score raised by how fresh and how central their book is: score * (1 + freshness * 0.99^days + centrality * in-degree / greatest in-degree).
    Books without indexed_at, or unknown, get no freshness; the order before settles ties."""
    most = in_degree.agg(F.max("in_degree").alias("m")).first()["m"] or 1
    days = F.greatest(F.lit(0), F.datediff(F.lit(now).cast("timestamp"), "indexed_at"))
    b = books.select("slug", F.coalesce(F.pow(F.lit(0.99), days), F.lit(0.0)).alias("fresh"))
    j = results.join(b, "slug", "left").join(in_degree, "slug", "left")
    boost = 1 + freshness * F.coalesce("fresh", F.lit(0.0)) + centrality * F.least(F.coalesce(F.col("in_degree") / most, F.lit(0.0)), F.lit(1.0))
    return j.withColumn("score", F.col("score") * boost).drop("fresh", "in_degree")


def best_per_source(results: DataFrame, source: str, key: str, others: int = 3) -> DataFrame:
    """(source, key, score, sections, others): of each source the best result, how many there were, and the next best keys. Each task keeps a source's few best before they meet."""
    w = Window.partitionBy(source).orderBy(F.desc("score"), key)
    few = results.select(source, key, "score").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= others + 1)
    top = few.groupBy(source).agg(F.min(F.struct("_rn", key, "score")).alias("_b"), F.array_sort(F.collect_list(F.when(F.col("_rn") > 1, F.struct("_rn", key)))).alias("_o"))
    n = results.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("sections"))
    both = top.join(n, F.col(source).eqNullSafe(F.col("_source")))
    return both.select(source, F.col(f"_b.{key}").alias(key), F.col("_b.score").alias("score"), "sections", F.transform("_o", lambda x: x[key]).alias("others"))


def merged_by_path(results: DataFrame, path: str) -> DataFrame:
    """A second pass over one result for each source: those whose last two path components agree are one; the one with the shorter path, then the better score, stays."""
    parts = F.split(path, "/")
    tail = F.array_join(F.slice(parts, -2, 2), "/")
    w = Window.partitionBy(F.when(F.size(parts) >= 2, tail).otherwise(F.col(path))).orderBy(F.length(path), F.desc("score"), path)
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def sections(chunks: DataFrame, book: str = "book_slug") -> DataFrame:
    """Chunks in reading order: position, total, and the title of the next section (null at the end). Pages and paragraphs are not unique, the chunk id settles ties. A book with very many chunks is
    numbered in parts."""
    order = [F.col("page_start").asc_nulls_last(), F.col("paragraph").asc_nulls_last(), F.col("chunk_id").asc()]
    placed, _ = numbered(chunks, [book], order)
    w = Window.partitionBy(book, "_part").orderBy("_no")
    placed = placed.withColumn("_next", F.lead(F.struct("chapter_title")).over(w))
    # the last row of a part is followed by the first of the book's next one
    first = placed.groupBy(F.col(book).alias("_book"), "_part").agg(F.min(F.struct("_no", "chapter_title")).alias("_f")).select("_book", F.col("_f._no").alias("_at"), F.col("_f.chapter_title").alias("_title"))
    met = placed.join(first, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_no") + 1 == F.col("_at")), "left")
    following = F.when(F.col("_next").isNotNull(), F.col("_next.chapter_title")).otherwise(F.col("_title"))
    return met.select(*chunks.columns, F.col("_no").alias("position"), F.col("_total").alias("total"), following.alias("next_section"))


def at_line(chunks: DataFrame, line: int) -> DataFrame:
    """Of each book the chunk that holds a line, or else the first after it."""
    w = Window.partitionBy("book_slug").orderBy(F.when((F.col("line_start") <= line) & (F.col("line_end") >= line), 0).otherwise(1), "line_start", "chunk_id")
    return chunks.filter(F.col("line_end") >= line).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def within_budget(results: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """The first results whose sizes add up to no more than `most`; it stops at the first one that does not fit. For ranked results, that is, few rows."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= most)


def embedded(texts: DataFrame, size: int = 64) -> DataFrame:
    """(id, vector) for texts (id, text): hashed words, signed, of unit length. Any model can stand in its place: it gets batches of texts and is loaded once for each worker."""
    import re
    import zlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), size), np.float32)
            for i, t in enumerate(b["text"]):
                for w in re.findall(r"[^\W_]+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % size] += 1.0 if h & 0x80000000 else -1.0
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "vector": list(out / np.where(n == 0, 1, n))})

    return texts.select("id", "text").mapInPandas(run, "id bigint, vector array<float>")
