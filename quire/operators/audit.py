"""Checks of a library's integrity. Each returns the rows at fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def churn(jobs: DataFrame, made: int = 3, lost: int = 1) -> DataFrame:
    """(type, payload, made, lost): what is done again and again."""
    n = jobs.groupBy("type", "payload").agg(F.count_if(F.col("status") == "done").alias("made"), F.count_if(F.col("status") == "failed").alias("lost"))
    return n.filter((F.col("made") >= made) & (F.col("lost") >= lost))


def untracked_books(books: DataFrame, files: DataFrame) -> DataFrame:
    """Books that no tracked file stands for; files without book stand for none."""
    return books.filter("slug IS NOT NULL").join(files.select(F.col("book_slug").alias("slug")), "slug", "left_anti")


def shared_identities(files: DataFrame) -> DataFrame:
    """(identities, surplus, worst): slugs that several files claim."""
    f = files.filter("book_slug IS NOT NULL").select("filepath", "corpus", "book_slug").distinct()
    g = f.groupBy("book_slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("identities"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.coalesce(F.max("n"), F.lit(0)).alias("worst"))


def mute_books(books: DataFrame, chunks: DataFrame) -> DataFrame:
    return books.select("id", "slug").join(chunks.select(F.col("book_id").alias("id")), "id", "left_anti").select("slug")


def impossible_pages(books: DataFrame) -> DataFrame:
    return books.filter("page_count = 1 AND total_chars > 20000").select("slug", "page_count", "total_chars")


def doubtful_passages(chunks: DataFrame) -> DataFrame:
    """(corpus, unreadable): passages that are empty, hold replacement characters or have a wrong length."""
    c = F.col("content")
    bad = c.isNull() | (F.trim(c) == "") | F.contains(c, F.lit("�")) | ~F.col("content_chars").eqNullSafe(F.length(c))
    return chunks.filter(bad).groupBy("corpus").agg(F.count(F.lit(1)).alias("unreadable"))


def stranded(jobs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    return jobs.filter((F.col("status") == "running") & (F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS"))).select("id", "type")


def coverage(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """(corpus, books, readable, missing, removed). Chunks are counted by book before they join."""
    n = chunks.groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = books.select("id", "corpus", "removed_at").join(n, "id", "left")
    gone = F.col("removed_at").isNotNull()
    return j.groupBy("corpus").agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("n") > 0).alias("readable"), F.count_if(F.col("n").isNull() & ~gone).alias("missing"), F.count_if(gone).alias("removed"))


def pdf_health(books: DataFrame, chunks: DataFrame, least_chars: int = 20, disk: DataFrame | None = None) -> DataFrame:
    """(slug, health) of PDF books: `missing` (not on disk), `wrong-format` (on disk as something else), `empty`, `scan` (fewer characters a page than text has), or `ok`. The first two need disk (filename,
    format)."""
    n = chunks.select(F.col("book_id").alias("id"), F.length("content").alias("l")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"))
    j = books.filter(F.endswith("filename", F.lit(".pdf"))).select("id", "slug", "page_count", "filename").join(n, "id", "left")
    h = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when((F.col("page_count") > 0) & (F.col("l") / F.col("page_count") < least_chars), "scan").otherwise("ok")
    if disk is not None:
        j = j.join(disk.select("filename", "format").dropDuplicates(["filename"]), "filename", "left")
        h = F.when(F.col("format").isNull(), "missing").when(F.col("format") != "pdf", "wrong-format").otherwise(h)
    return j.select("slug", h.alias("health"))


def fossils(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.startswith("chunk_id", "book_slug")).select("id", "book_slug")


def untracked_roots(configured: DataFrame, roots: DataFrame) -> DataFrame:
    """Configured sources (corpus, root_path) that nothing tracks."""
    return configured.join(roots, ["corpus", "root_path"], "left_anti")


def fleet(by_project: dict[str, DataFrame]) -> DataFrame:
    """One check over several libraries, with their names in `project`."""
    return reduce(DataFrame.unionByName, [df.withColumn("project", F.lit(name)) for name, df in sorted(by_project.items())])


def reconciled(books: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What to mend: vectors without chunk, chunks without text, chunks of a renamed book, untracked books (a file of the same name and corpus: `attach`, else `drop`), chunks without vector."""
    known = files.select(F.col("filepath").alias("filename"), "corpus").distinct().withColumn("there", F.lit(True))
    untracked = untracked_books(books, files).join(known, ["filename", "corpus"], "left")
    return {
        "orphan_vectors": vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"),
        "empty_chunks": chunks.filter("content IS NULL OR trim(content) = ''").select("chunk_id"),
        "fossil_chunks": chunks.filter(~F.startswith("chunk_id", "book_slug")).select("chunk_id"),
        "untracked_books": untracked.select("slug", F.when(F.col("there"), "attach").otherwise("drop").alias("repair")),
        "unembedded": chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"),
    }


def silent_drops(failures: DataFrame) -> DataFrame:
    """(files, example, reason): how many files are held out of the index, the last of them and the first line of its error; no row where there are none."""
    line = F.substring(F.get(F.split(F.coalesce("error", F.lit("")), "\n"), F.lit(0)), 1, 70)
    last = F.max_by(F.struct("filepath", line.alias("reason")), F.struct("failed_at", "filepath"))
    return failures.agg(F.count(F.lit(1)).alias("files"), last.alias("_r")).filter("files > 0").select("files", F.col("_r.filepath").alias("example"), "_r.reason")


def snapshot_bytes(versions: DataFrame, books: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, corpus, filepath, root_path, versions, bytes): what the stored versions (book_slug, snapshot) of each tracked book take."""
    n = versions.groupBy(F.col("book_slug").alias("slug")).agg(F.count(F.lit(1)).alias("versions"), F.sum(F.length("snapshot")).alias("bytes"))
    f = files.select(F.col("book_slug").alias("slug"), "corpus", "filepath", "root_path").dropDuplicates(["slug", "corpus"])
    return n.join(books.select("slug", "corpus").distinct(), "slug").join(f, ["slug", "corpus"])


def unwanted_history(held: DataFrame, roots: DataFrame, unversioned: DataFrame) -> DataFrame:
    """(slug, bytes) of stored histories (see snapshot_bytes) that are declared unversioned: unversioned (root_path, pattern: a regular expression) speaks for its own root alone. A file without root
    belongs to the only root (corpus, root_path) of its corpus, or else to none, and is left alone."""
    only = roots.filter("root_path IS NOT NULL").select("corpus", "root_path").distinct().groupBy("corpus").agg(F.count(F.lit(1)).alias("_n"), F.first("root_path").alias("_only")).filter("_n = 1")
    placed = held.join(only, "corpus", "left").withColumn("root_path", F.coalesce("root_path", "_only"))
    rules = unversioned.groupBy("root_path").agg(F.array_join(F.sort_array(F.collect_set("pattern")), "|").alias("_rule"))  # lines of a file that people write
    return placed.join(rules, "root_path").filter(F.expr("filepath RLIKE _rule")).select("slug", "bytes")


def source_coverage(disk: DataFrame, files: DataFrame, books: DataFrame) -> DataFrame:
    """(corpus, indexable, readable, tracked_not_readable, missing, skipped, unaccounted), and a row `*total*`. disk (corpus, filepath, binary); a tracked file without book, or an untracked binary one, is
    skipped and no gap; unaccounted: tracked files that no source holds."""
    known = books.select(F.col("slug").alias("book_slug"), "corpus").distinct().withColumn("_book", F.lit(True))
    t = files.select("corpus", "filepath", "book_slug").dropDuplicates(["corpus", "filepath"]).join(known, ["book_slug", "corpus"], "left").withColumn("_tracked", F.lit(True))
    j = disk.select("corpus", "filepath", "binary").distinct().withColumn("_disk", F.lit(True)).join(t, ["corpus", "filepath"], "full_outer")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    skipped = has("_disk") & F.when(has("_tracked"), F.col("book_slug").isNull()).otherwise(has("binary"))
    j = j.select("corpus", (has("_disk") & ~skipped).alias("i"), (has("_disk") & has("_tracked") & has("_book")).alias("r"), (has("_disk") & has("_tracked") & F.col("book_slug").isNotNull()).alias("t"), skipped.alias("s"), (~has("_disk")).alias("u"))
    out = j.groupBy("corpus").agg(F.count_if("i").alias("indexable"), F.count_if("r").alias("readable"), (F.count_if("t") - F.count_if("r")).alias("tracked_not_readable"), (F.count_if("i") - F.count_if("t")).alias("missing"), F.count_if("s").alias("skipped"), F.count_if("u").alias("unaccounted"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in out.columns[1:]]
    return out.unionByName(out.agg(*sums).select(F.lit("*total*").alias("corpus"), *out.columns[1:]))


def readiness(books: DataFrame, chunks: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each book (id, slug, filename, corpus): how many chunks and vectors it has, whether it is searchable and whether all its vectors are there, and how its ingest jobs (type, status, error,
    finished_at, filepath) stand, with the first line of the last error."""
    n = chunks.select("chunk_id", F.col("book_id").alias("id")).distinct()
    v = vectors.select("chunk_id").distinct().withColumn("_v", F.lit(1))
    counts = n.join(v, "chunk_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.count("_v").alias("vectors"))
    line = F.substring(F.get(F.split("error", "\n"), F.lit(0)), 1, 200)
    q = jobs.filter("type = 'ingest' AND filepath IS NOT NULL").groupBy(F.col("filepath").alias("filename")).agg(
        F.bool_or(F.col("status").isin("pending", "running")).alias("pending"), F.bool_or(F.col("status") == "failed").alias("failed"), F.max_by(line, F.when(F.col("status") == "failed", F.col("finished_at"))).alias("reason")
    )
    j = books.select("id", "slug", "filename", "corpus").join(counts, "id", "left").join(q, "filename", "left")
    j = j.withColumns({"chunks": F.coalesce("chunks", F.lit(0)), "vectors": F.coalesce("vectors", F.lit(0))})
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return j.select("slug", "corpus", "chunks", "vectors", (F.col("chunks") > 0).alias("searchable"), ((F.col("chunks") > 0) & (F.col("vectors") >= F.col("chunks"))).alias("ready"), no("pending"), no("failed"), F.when(F.coalesce("failed", F.lit(False)), F.col("reason")).alias("reason"))


def repairs(books: DataFrame, files: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repair, corpus, item): `split`, a slug that several files share; `untrack`, a tracked file that is a binary nothing reads (`binary`); `rehome` or `drop`, a corpus that no source declares, whose
    files another source does or does not hold; `unsplit`, a scan whose book is one chunk of more than 20 pages."""
    f = files.select("corpus", "filepath", "book_slug", "binary").distinct()
    shared = f.filter("book_slug IS NOT NULL").groupBy("corpus", "book_slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("split").alias("repair"), "corpus", F.col("book_slug").alias("item"))
    binary = f.filter("binary").select(F.lit("untrack").alias("repair"), "corpus", F.col("filepath").alias("item"))
    lost = f.join(sources.select("corpus").distinct(), "corpus", "left_anti")
    elsewhere = f.join(sources.select("corpus").distinct(), "corpus", "left_semi").select("filepath").distinct().withColumn("_there", F.lit(True))
    orphan = lost.join(elsewhere, "filepath", "left").groupBy("corpus").agg(F.bool_or(F.coalesce("_there", F.lit(False))).alias("_there"))
    orphan = orphan.select(F.when(F.col("_there"), "rehome").otherwise("drop").alias("repair"), "corpus", F.col("corpus").alias("item"))
    one = chunks.groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    unsplit = books.filter("page_count > 20").join(one.filter("n = 1"), "id").select(F.lit("unsplit").alias("repair"), "corpus", F.col("slug").alias("item"))
    return shared.unionByName(binary).unionByName(orphan).unionByName(unsplit)


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rows) of what `reconciled` gives."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows") for name, df in sorted(parts.items())])
