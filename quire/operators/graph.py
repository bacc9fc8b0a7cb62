"""The graph of books: edges from unresolved references, neighbours, degrees, hubs, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src_slug IS NOT NULL AND dst_slug IS NOT NULL").dropDuplicates(["src_slug", "dst_slug", "relation_type", "source_detail"])


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst_slug").alias("slug")).agg(F.count(F.lit(1)).alias("in_degree"))


def neighbours(edges: DataFrame, books: DataFrame, direction: str | None = None, relation: str | None = None) -> DataFrame:
    """(slug, direction, relation_type, neighbour, title): every book's edges in both directions, or in one (`in`, `out`), of all kinds or of one. Of books only two columns join."""
    if relation is not None:
        edges = edges.filter(F.col("relation_type") == relation)
    out = edges.select(F.col("src_slug").alias("slug"), F.lit("out").alias("direction"), "relation_type", F.col("dst_slug").alias("neighbour"))
    into = edges.select(F.col("dst_slug").alias("slug"), F.lit("in").alias("direction"), "relation_type", F.col("src_slug").alias("neighbour"))
    titles = books.select(F.col("slug").alias("neighbour"), "title")
    both = {"out": out, "in": into}.get(direction, out.unionByName(into))
    return both.join(titles, "neighbour", "left").select("slug", "direction", "relation_type", "neighbour", "title")


def connected(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_slug", "dst_slug")).alias("slug")).distinct()


def stats(edges: DataFrame) -> DataFrame:
    """(relation_type, edges), and a row `*nodes*` with how many books have an edge."""
    by = edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))
    return by.unionByName(connected(edges).agg(F.count(F.lit(1)).alias("edges")).select(F.lit("*nodes*").alias("relation_type"), "edges"))


def orphans(books: DataFrame, edges: DataFrame) -> DataFrame:
    return books.select("slug").distinct().join(connected(edges), "slug", "left_anti")


def normal_path(base: Column, link: Column) -> Column:
    """A relative link as seen from a file, without `.` and `..`; null if it leaves the tree."""
    parts = F.split(F.concat_ws("/", F.regexp_extract(base, r"^(.*)/[^/]*$", 1), F.regexp_replace(link, r"[#?].*$", "")), "/")
    step = lambda a, x: F.when(a.isNull() | (x == "") | (x == "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda a: F.array_join(a, "/"))


def resolve_links(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """candidates (src_slug, src_path, corpus, relation_type, target_ref) to edges: a link by its normal path, an import `a.b` by `a/b.py` or `a/b/__init__.py`, a wikilink by file stem, with the
    nearest folder winning (longest common prefix, then the shorter path). Unresolved ones and links to oneself are dropped."""
    b = books.filter("filename IS NOT NULL").select("corpus", "filename", F.col("slug").alias("dst_slug"))
    dotted = F.replace("target_ref", F.lit("."), F.lit("/"))
    paths = F.when(F.col("relation_type") == "imports", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))).otherwise(F.array(normal_path(F.col("src_path"), F.col("target_ref"))))
    tried = candidates.filter("relation_type <> 'wikilink'").select("*", F.posexplode(paths).alias("choice", "filename"))
    direct = tried.join(b, ["corpus", "filename"]).select("src_slug", "relation_type", "target_ref", "dst_slug", F.col("choice").alias("far"), F.length("filename").alias("long"))
    stem = F.lower(F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"\.[^.]*$", ""))
    wiki = candidates.filter("relation_type = 'wikilink'").withColumn("stem", F.lower(F.regexp_replace(F.element_at(F.split("target_ref", "/"), -1), r"\.md$", "")))
    folder = lambda p: F.filter(F.split(F.regexp_extract(p, r"^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    a, z = folder(F.col("src_path")), folder(F.col("filename"))
    common = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: (i < F.size(a)) & F.slice(a, 1, i + 1).eqNullSafe(F.slice(z, 1, i + 1))))
    # `folder/Note` must end so; a bare name may lie anywhere
    without = F.lower(F.regexp_replace("filename", r"\.[^./]*$", ""))
    tail = F.lower(F.regexp_replace("target_ref", r"^(?:\.?/)+|\.md$", ""))
    fits = ~F.contains("target_ref", F.lit("/")) | (without == tail) | F.endswith(without, F.concat(F.lit("/"), tail))
    named = wiki.join(b.withColumn("stem", stem), ["corpus", "stem"]).filter(fits).select("src_slug", "relation_type", "target_ref", "dst_slug", (F.size(a) + F.size(z) - 2 * common).alias("far"), F.length("filename").alias("long"))
    w = Window.partitionBy("src_slug", "relation_type", "target_ref").orderBy("far", "long", "dst_slug")
    best = direct.unionByName(named).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 AND src_slug <> dst_slug")
    return best.select("src_slug", "dst_slug", "relation_type", F.col("target_ref").alias("source_detail")).distinct()


def refreshed(edges: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """edges with those of some sources (src_slug) replaced by new ones, also where there are none."""
    return edges.join(sources.select("src_slug").distinct(), "src_slug", "left_anti").unionByName(new).distinct()
