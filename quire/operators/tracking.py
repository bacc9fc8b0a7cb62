"""What a library knows of its files beside their content: failures, roots, claims, moves, identities, citation cards. State tables are small beside the chunks; each operator gives the state after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import book_slug
from quire.operators import catalog

KEY = ["corpus", "filepath"]


def with_failures(state: DataFrame, new: DataFrame) -> DataFrame:
    """state (corpus, filepath, file_hash, file_size, error, attempts, failed_at) after new failures (the same without attempts): content, error (its first 2,000 characters) and time are those of the
    last one, attempts count them all. Several failures of one file in new count each."""
    last = F.max_by(F.struct("file_hash", "file_size", "error"), F.struct("failed_at", "file_hash"))
    one = new.groupBy(*KEY).agg(last.alias("_r"), F.max("failed_at").alias("failed_at"), F.count(F.lit(1)).alias("_more"))
    one = one.select(*KEY, "_r.file_hash", "_r.file_size", F.substring("_r.error", 1, 2000).alias("error"), "failed_at", "_more")
    before = state.select(*KEY, F.col("attempts").alias("_attempts"))
    met = one.join(before, KEY, "left").withColumn("attempts", (F.coalesce("_attempts", F.lit(0)) + F.col("_more")).cast("int"))
    return state.join(one.select(*KEY), KEY, "left_anti").unionByName(met.select(*state.columns))


def forgotten(state: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The failures without those of some files (corpus, filepath), or none."""
    return state.limit(0) if files is None else state.join(files.select(*KEY).distinct(), KEY, "left_anti")


def claimed(files: DataFrame, found: DataFrame, corpus: str, root: str) -> DataFrame:
    """The tracked files, those found (filepath) in a root of the corpus as the root's own."""
    mine = found.select(F.lit(corpus).alias("corpus"), "filepath", F.lit(root).alias("_root")).distinct()
    return files.join(mine, KEY, "left").withColumn("root_path", F.coalesce("_root", "root_path")).select(*files.columns)


def with_root(roots: DataFrame, corpus: str, root: str, at: str) -> DataFrame:
    """The roots (corpus, root_path, synced_at) after a sync of one, newest first."""
    new = roots.sparkSession.createDataFrame([(corpus, root, at)], "corpus string, root_path string, at string").select("corpus", "root_path", F.col("at").cast("timestamp").alias("synced_at"))
    return catalog.upsert(roots, new, ["corpus", "root_path"]).select(*roots.columns).orderBy(F.desc("synced_at"), "corpus", "root_path")


def moved(moves: DataFrame, books: DataFrame, files: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """books, files and edges after moves (from_corpus, from_path, corpus, filepath): content and keys stay, so that chunks and vectors follow; slug, name and corpus change. A move of what is not
    tracked does nothing; a tracked row at the new place gives way."""
    old = files.select(F.col("corpus").alias("from_corpus"), F.col("filepath").alias("from_path"), F.col("book_slug").alias("_old"))
    m = moves.join(old, ["from_corpus", "from_path"]).withColumn("_slug", book_slug(F.col("corpus"), F.col("filepath")))
    names = m.filter("_old IS NOT NULL").select(F.col("_old").alias("slug"), "_slug", F.col("corpus").alias("_corpus"), F.col("filepath").alias("_file"))
    b = books.join(names, "slug", "left")
    b = b.withColumns({"slug": F.coalesce("_slug", "slug"), "corpus": F.coalesce("_corpus", "corpus"), "filename": F.coalesce("_file", "filename")}).select(*books.columns)
    into = m.select("corpus", "filepath")
    stay = files.join(m.select(F.col("from_corpus").alias("corpus"), F.col("from_path").alias("filepath")), KEY, "left_anti").join(into, KEY, "left_anti")
    went = files.withColumnsRenamed({"corpus": "from_corpus", "filepath": "from_path"}).join(m, ["from_corpus", "from_path"]).withColumn("book_slug", F.col("_slug"))
    pairs = names.select(F.col("slug").alias("_from"), "_slug")
    e = edges
    for c in ("src_slug", "dst_slug"):
        e = e.join(pairs, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_slug", c)).select(*edges.columns)
    return {"books": b, "files": stay.unionByName(went.select(*files.columns)), "edges": e.distinct()}


def gate(crossing: DataFrame, roots: DataFrame, listed: DataFrame, here: str) -> DataFrame:
    """crossing (from_corpus, from_path, ...) with `stays`: the file still lies under another root of its corpus than the one scanned (`here`), so that it has not moved but is present in both. roots
    (corpus, root_path, readable); listed (root_path, filepath). A root that cannot be read counts as holding the file."""
    others = roots.filter(F.col("root_path") != here)
    dark = others.filter("NOT readable").select(F.col("corpus").alias("from_corpus"), F.lit(True).alias("_dark")).distinct()
    there = others.join(listed, "root_path").select(F.col("corpus").alias("from_corpus"), F.col("filepath").alias("from_path"), F.lit(True).alias("_there")).distinct()
    met = crossing.join(there, ["from_corpus", "from_path"], "left").join(dark, "from_corpus", "left")
    return met.withColumn("stays", F.coalesce("_there", F.lit(False)) | F.coalesce("_dark", F.lit(False))).select(*crossing.columns, "stays")


def confirmed_removals(removed: DataFrame, roots: DataFrame, listed: DataFrame, excluded: str) -> DataFrame:
    """removed (corpus, filepath) that may go: a rule (a regular expression) excludes the path, or every root of the corpus (corpus, root_path, readable) can be read and holds no such file."""
    state = roots.groupBy("corpus").agg(F.every("readable").alias("_all"))
    there = roots.join(listed, "root_path").select("corpus", "filepath", F.lit(True).alias("_there")).distinct()
    met = removed.join(state, "corpus", "left").join(there, KEY, "left")
    return met.filter(F.col("filepath").rlike(excluded) | (F.coalesce("_all", F.lit(False)) & F.col("_there").isNull())).select(*removed.columns)


def on_disk(stored: DataFrame, roots: DataFrame, listed: DataFrame) -> DataFrame:
    """stored (corpus, filepath) with disk_path: below the first root of the corpus (corpus, root_path, place) that holds the file (root_path, filepath); a path that no root holds, or that is absolute,
    stays as it is."""
    held = roots.join(listed, "root_path").groupBy("corpus", "filepath").agg(F.min_by("root_path", F.struct("place", "root_path")).alias("_root"))
    met = stored.join(held, KEY, "left")
    inside = F.col("_root").isNotNull() & ~F.startswith("filepath", F.lit("/"))
    return met.select(*stored.columns, F.when(inside, F.concat(F.regexp_replace("_root", "/+$", ""), F.lit("/"), "filepath")).otherwise(F.col("filepath")).alias("disk_path"))


def source_of(edited: DataFrame, sources: DataFrame) -> DataFrame:
    """edited (path) with the corpus and root of the most specific source (corpus, root_path, endings) below whose root it lies and whose endings (all where null) it has; null if none."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    met = edited.select("path", F.explode(up).alias("root_path")).join(sources, "root_path").filter(F.col("endings").isNull() | F.array_contains("endings", ending))
    best = met.groupBy("path").agg(F.max_by(F.struct("corpus", "root_path"), F.struct(F.length("root_path"), "corpus")).alias("_s"))
    return edited.select("path").distinct().join(best, "path", "left").select("path", "_s.corpus", "_s.root_path")


def identified(books: DataFrame, ident: str, corpus: str | None = None) -> DataFrame:
    """Books that an identifier means, by name, the first 20: those that contain it in their slug, or it or its last path component in their file name, without regard to case there."""
    base = ident.rstrip("/").rsplit("/", 1)[-1].lower()
    name = F.lower("filename")
    hit = F.contains("slug", F.lit(ident)) | F.contains(name, F.lit(ident.lower())) | F.contains(name, F.lit(base))
    own = books.filter(F.coalesce(hit, F.lit(False)))
    return (own if corpus is None else own.filter(F.col("corpus") == corpus)).orderBy("filename", "slug").limit(20)


def named(books: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Books by a path: as it stands, without its first slash, or as what follows a root it lies below."""
    rest = roots.filter(F.startswith(F.lit(path), F.concat(F.regexp_replace("root_path", "/+$", ""), F.lit("/"))))
    below = rest.select(F.expr("substring(" + "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "', length(regexp_replace(root_path, '/+$', '')) + 2)").alias("filename"))
    asked = books.sparkSession.createDataFrame([(path,), (path.lstrip("/"),)], "filename string").unionByName(below).distinct()
    return books.join(F.broadcast(asked), "filename", "left_semi")  # as many rows as there are roots


def same_tail(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of paths that agree in their last two components the shortest, then the first."""
    parts = F.split(path, "/")
    tail = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(F.col(path))
    best = F.min(F.struct(F.length(path).alias("_l"), *[F.col(c) for c in [path, *[c for c in paths.columns if c != path]]]))
    return paths.groupBy(tail.alias("_tail")).agg(best.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in paths.columns])


#: What a source may be (fixed values).
NATURES = ["book", "article", "thesis", "report", "law", "web", "letter", "other"]


def card_faults(cards: DataFrame, natures: list[str] | None = None) -> DataFrame:
    """(corpus, filepath, fault) of citation cards that do not hold: `nature` unknown, `range` out of order or without its first page, `key` missing."""
    n = natures or NATURES
    bad_range = (F.col("first_page") > F.col("last_page")) | (F.col("first_page").isNull() & F.col("last_page").isNotNull())
    faults = F.array(
        F.when(F.col("nature").isNotNull() & ~F.col("nature").isin(n), "nature"), F.when(F.coalesce(bad_range, F.lit(False)), "range"), F.when(F.col("corpus").isNull() | F.col("filepath").isNull(), "key"),
    )
    return cards.select(*KEY, F.explode(F.array_compact(faults)).alias("fault"))


def with_cards(state: DataFrame, new: DataFrame, natures: list[str] | None = None) -> DataFrame:
    """The cards with new ones; of a batch with a fault nothing is taken. Of repeated keys in a batch the last in order of all columns counts."""
    faults = card_faults(new, natures).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['corpus']}/{r['filepath']}: {r['fault']}" for r in faults))
    rest = [c for c in state.columns if c not in KEY]
    one = new.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*")
    return catalog.upsert(state, one, KEY).select(*state.columns)


def card(state: DataFrame, path: str, corpus: str | None = None) -> dict | None:
    """The card of a file; a path that several corpora have must come with its corpus."""
    own = state.filter(F.col("filepath") == path)
    found = (own if corpus is None else own.filter(F.col("corpus") == corpus)).limit(2).collect()
    if len(found) > 1:
        raise LookupError(f"{path!r} is in several corpora")
    return found[0].asDict() if found else None


def without_card(state: DataFrame, path: str, corpus: str) -> DataFrame:
    return state.filter(~((F.col("filepath") == path) & (F.col("corpus") == corpus)))


def compared_snapshots(versions: DataFrame, book: str, first: int, second: int) -> DataFrame:
    """(first_hash, second_hash, same, grown) of two versions (book_slug, version_num, snapshot, content_hash) of a book."""
    one = lambda n, p: versions.filter((F.col("book_slug") == book) & (F.col("version_num") == n)).select("book_slug", F.col("content_hash").alias(f"{p}_hash"), F.length("snapshot").alias(f"_{p}"))
    return one(first, "first").join(one(second, "second"), "book_slug").select("first_hash", "second_hash", (F.col("first_hash") == F.col("second_hash")).alias("same"), (F.col("_second") - F.col("_first")).alias("grown"))


def newest_first(history: DataFrame, book: str) -> DataFrame:
    return history.filter(F.col("book_slug") == book).orderBy(F.desc("version_num"))


def repair_queue(verdicts: DataFrame) -> DataFrame:
    """(type, corpus, filepath, priority): what freshness verdicts (corpus, filepath, verdict) of a search's results set going, ahead of all else: STALE and NEW files are ingested, GONE ones removed."""
    kind = F.when(F.col("verdict") == "GONE", "remove").when(F.col("verdict").isin("STALE", "NEW"), "ingest")
    return verdicts.select(kind.alias("type"), *KEY, F.lit(0).alias("priority")).filter("type IS NOT NULL").distinct()


def withheld(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Results (corpus, filepath, ...) without those whose file is gone."""
    return results.join(verdicts.filter("verdict = 'GONE'").select(*KEY).distinct(), KEY, "left_anti")

