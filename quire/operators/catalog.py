"""The catalogue: counts, tags, path resolution, state tables kept by union and latest-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(state: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str] | None = None) -> DataFrame:
    """state with rows replaced or added by new (unique keys on both sides); columns in keep_if_null keep their old value where the new one is null."""
    keep = keep_if_null or []
    cols = state.columns
    j = state.withColumn("_old", F.lit(True)).alias("s").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        chosen = F.when(F.col("n._new"), F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")) if c in keep else F.col(f"n.{c}"))
        return chosen.otherwise(F.col(f"s.{c}")).alias(c)

    return j.select(*[pick(c) for c in cols])


def remove(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def remove_books(slugs: DataFrame, books: DataFrame, chapters: DataFrame, chunks: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables without some books (slugs: slug): their chapters, chunks, and edges from and to them go too."""
    ids = books.join(slugs, "slug", "left_semi").select("id").distinct()
    by = lambda df, c, s=slugs: df.join(s.select(F.col(s.columns[0]).alias(c)), c, "left_anti")
    return {"books": by(books, "slug"), "chapters": by(chapters, "book_id", ids), "chunks": by(chunks, "book_id", ids), "edges": by(by(edges, "src_slug"), "dst_slug")}


def tag_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def with_all_tags(chunks: DataFrame, tags: list[str]) -> DataFrame:
    """Chunks that have every tag; the filter comes before any limit."""
    return chunks.filter(F.forall(F.array(*[F.lit(t) for t in tags]), lambda t: F.array_contains("tags", t)))


def tagged(chunks: DataFrame, add: list[str], drop: list[str]) -> DataFrame:
    """tags with some added and others removed, sorted, null when none is left."""
    lits = lambda x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    t = F.array_sort(F.array_except(F.array_union(F.coalesce("tags", lits([])), lits(add)), lits(drop)))
    return chunks.withColumn("tags", F.when(F.size(t) > 0, t))


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole name; `*` and `?` also match slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return f"^{out}$"


def matching_glob(name: Column, pattern: str) -> Column:
    """`.ext` is an ending without regard to case; a pattern with a slash matches the whole path or what follows some folder of it, one without matches the last component."""
    if pattern.startswith(".") and not any(c in pattern for c in "*?["):
        return F.endswith(F.lower(name), F.lit(pattern.lower()))
    if "/" in pattern:
        return name.rlike(glob_pattern(pattern)) | name.rlike(glob_pattern(f"*/{pattern}"))
    return F.element_at(F.split(name, "/"), -1).rlike(glob_pattern(pattern))


def owning_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) with the longest root that is a prefix of the path, null if none. Roots are matched on every ancestor folder of the path, an equality join."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("path", F.explode(ancestors).alias("root"))
    owner = up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("path").distinct().join(owner, "path", "left")


def resolve_path(wanted: DataFrame, books: DataFrame, roots: DataFrame) -> DataFrame:
    """wanted (path) with the slug of its book: an equal file name, or what is left of the path below a root; of several the shortest file name, then the first slug."""
    exact = wanted.select("path", F.col("path").alias("filename"), F.lit(0).alias("how"))
    below = owning_root(wanted, roots).filter("root IS NOT NULL").select("path", F.expr("substring(path, length(root) + 2)").alias("filename"), F.lit(1).alias("how"))
    hit = exact.unionByName(below).join(books.select("filename", "slug"), "filename")
    return latest(hit, ["path"], F.col("how").asc(), F.length("filename").asc(), F.col("slug").asc()).select("path", "slug")


def file_versions(snapshots: DataFrame, keep: int = 50) -> DataFrame:
    """snapshots (book_slug, created_at, content_hash) numbered by time within the book, of which the newest `keep` remain. Each task keeps a book's newest before they meet; its number is counted."""
    down = Window.partitionBy("book_slug").orderBy(F.desc("created_at"), F.desc("content_hash"))
    new = snapshots.withColumn("_age", F.row_number().over(down)).filter(F.col("_age") <= keep)
    n = snapshots.groupBy("book_slug").agg(F.count(F.lit(1)).alias("_n"))
    return new.join(n, "book_slug").withColumn("version_num", F.col("_n") - F.col("_age") + 1).drop("_age", "_n")


def cards_valid(cards: DataFrame, natures: list[str]) -> DataFrame:
    """Citation cards with `valid` (known nature, a range that is in order) and `attributed` (author and title are given)."""
    ok = (F.col("nature").isNull() | F.col("nature").isin(natures)) & (F.col("first_page").isNull() | F.col("last_page").isNull() | (F.col("first_page") <= F.col("last_page")))
    given = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return cards.withColumns({"valid": ok, "attributed": given("author") & given("title")})


def replace_pages(chunks: DataFrame, new: DataFrame, first: int, last: int) -> DataFrame:
    """chunks without those of the books in new (book_slug, ...) that lie wholly between two pages, and with new instead; chunks without pages stay."""
    books = new.select("book_slug").distinct().withColumn("_new", F.lit(True))
    inside = F.coalesce((F.col("page_start") >= first) & (F.coalesce("page_end", "page_start") <= last), F.lit(False))
    kept = chunks.join(books, "book_slug", "left").filter(F.col("_new").isNull() | ~inside).select(*new.columns)
    return kept.unionByName(new)


def translated(path: Column, old_root: str, new_root: str) -> Column:
    """A path below one root as the same path below another; others stay."""
    return F.when(F.startswith(path, F.lit(old_root + "/")), F.concat(F.lit(new_root), F.expr(f"substring({path._jc.toString()}, {len(old_root) + 1})"))).otherwise(path)
