"""History of changing attributes (type-two dimensions), from notices or snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written
from quire.sources.tables import one_record

FAR = "9999-12-31"
#: Letters with marks and what they become without (fixed values).
MARKED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ", "AAAAAACEEEEIIIINOOOOOUUUUYY"


def plain_upper(c: Column) -> Column:
    """Trimmed, in upper case, without accents (written as one character or as combining marks)."""
    return F.translate(F.regexp_replace(F.upper(F.trim(c)), r"\p{M}", ""), MARKED, PLAIN)


def latest_notice(df: DataFrame, keys: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """Of the rows with equal keys the one with the latest `at`, on ties with the larger tie. The aggregate combines before it shuffles."""
    best = F.max_by(F.struct(*columns), F.struct(F.col(at), F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in columns])


def _hash(attributes: list[str]) -> Column:
    """A hash of the attributes that tells nulls from blanks and fields from one another."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)])))


def _folded(rows: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """(entity, valid_from, _end, attributes..., _hash, _first): a batch's own rows as versions. Each ends at its own end or the day before the next; neighbours with equal hashes are one. An entity has
    at most one row a day, so that its window is bounded by the calendar."""
    by = Window.partitionBy(entity).orderBy("valid_from")
    far = F.lit(FAR).cast("date")
    rows = rows.withColumn("_end", F.least(F.coalesce("valid_to", far), F.coalesce(F.date_sub(F.lead("valid_from").over(by), 1), far))).withColumn("_hash", _hash(attributes))
    same = (F.lag("_hash").over(by) == F.col("_hash")) & (F.lag("_end").over(by) == F.date_sub("valid_from", 1))
    rows = rows.withColumn("_no", F.sum(F.when(same, 0).otherwise(1)).over(by))
    one = rows.groupBy(entity, "_no").agg(F.min("valid_from").alias("valid_from"), F.max("_end").alias("_end"), F.first("_hash").alias("_hash"), *[F.first(a).alias(a) for a in attributes])
    return one.withColumn("_first", F.col("_no") == 1).drop("_no")


def merge_history(current: DataFrame | None, changes: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """Type-two merge. changes: (entity, valid_from, valid_to, attributes...), at most one for each entity and first day; valid_to (inclusive) may be null,
    which means no end. current: a result of this function, or None. Returns (entity, valid_from, valid_to, attributes...), valid_to null where open.

    The first change of each entity is compared by its hash with the current version it meets (the one before it that is still valid then or ended the day before): an equal one is extended and nothing
    inserted, a different one is closed on the day before. All other changes are inserted. Current versions that begin on or after the first change go through the batch with it; on a shared first day
    the change holds. All other current versions, and entities without changes, stay as they are. Rows with a null entity or valid_from, or an end before the start, are left out.
    Batches must come in the order of valid_from to give what one batch would: versions that were extended are one afterwards, and a late change cannot part them again."""
    cols = [entity, "valid_from", "valid_to", *attributes]
    far = F.lit(FAR).cast("date")
    shaped = lambda df: df.select(entity, "valid_from", F.when(F.col("_end") < far, F.col("_end")).alias("valid_to"), *attributes)
    batch = changes.select(*cols).filter(F.col(entity).isNotNull() & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from"))))
    if current is None:
        return shaped(_folded(batch, entity, attributes))
    since = batch.groupBy(entity).agg(F.min("valid_from").alias("_since"))
    held = current.select(*cols).join(since, entity, "left")
    later = held.filter(F.col("valid_from") >= F.col("_since")).select(*cols, F.lit(0).alias("_new"))
    both = later.unionByName(batch.withColumn("_new", F.lit(1)))
    batch = both.groupBy(entity, "valid_from").agg(F.max_by(F.struct("valid_to", *attributes), "_new").alias("_r")).select(entity, "valid_from", "_r.*")
    new = _folded(batch, entity, attributes)
    first = new.filter("_first").select(entity, F.col("valid_from").alias("_from"), F.col("_end").alias("_to"), F.col("_hash").alias("_new_hash"))
    standing = held.filter(F.col("_since").isNull() | (F.col("valid_from") < F.col("_since"))).withColumn("_end", F.coalesce("valid_to", far)).withColumn("_hash", _hash(attributes)).join(first, entity, "left")
    meets = F.col("_end") >= F.date_sub("_from", 1)
    same = F.coalesce(meets & (F.col("_hash") == F.col("_new_hash")), F.lit(False))
    closed = F.when(same, F.col("_to")).when(meets, F.least(F.col("_end"), F.date_sub("_from", 1))).otherwise(F.col("_end"))
    extended = standing.filter(same).select(entity, F.lit(True).alias("_first"))
    kept = standing.withColumn("_end", closed)
    return shaped(kept).unionByName(shaped(new.join(extended, [entity, "_first"], "left_anti")))


def as_of(history: DataFrame, day: str) -> DataFrame:
    """The versions valid on a day."""
    d = F.lit(day).cast("date")
    return history.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d)))


def snapshot_changes(before: DataFrame, now: DataFrame, entity: str, attributes: list[str], day: str) -> DataFrame:
    """Changes for merge_history from a full snapshot: rows that are new or whose attributes differ start on `day`; entities that are gone end the day before.
    before: the open versions."""
    old = before.select(entity, F.col("valid_from").alias("_from"), F.struct(*attributes).alias("_old"))
    both = now.select(entity, F.struct(*attributes).alias("_new")).join(old, entity, "full_outer")
    new = both.filter("_new IS NOT NULL AND NOT (_new <=> _old)").select(entity, F.lit(day).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), "_new.*")
    gone = both.filter("_new IS NULL").select(entity, F.col("_from").alias("valid_from"), F.date_sub(F.lit(day).cast("date"), 1).alias("valid_to"), "_old.*")
    return new.unionByName(gone)


#: Days at which article_history cuts its changes into batches; which days, decides nothing.
CUTS = ("2015-01-01",)


def article_history(notices: DataFrame, open_year: int = 2900, cuts: tuple[str, ...] = CUTS) -> DataFrame:
    """(article_ref, valid_from, valid_to, etat, texte_modificateur) from notices that repeat, correct and close one another.

    Rows with one id are one notice, with its earliest loaded_at (a null one counts as last). Of notices with one article_ref and version_num the one loaded last holds (then the larger id). Ignored: a null
    date_debut, date_fin before date_debut, a null or blank etat. Of notices that share date_debut the larger version_num holds. date_fin null or in open_year or later: no end.
    The notices are then merged into the dimension in batches, one for each span of first days between cuts, each into what the ones before have left."""
    cols = ["article_ref", "version_num", "date_debut", "date_fin", "etat", "texte_modificateur", "loaded_at"]
    one = one_record(notices.filter("article_ref IS NOT NULL"), "id", *cols)
    held = latest_notice(one, ["article_ref", "version_num"], "loaded_at", "id", ["date_debut", "date_fin", "etat", "texte_modificateur"])
    held = held.withColumn("etat", plain_upper(F.col("etat")))
    held = held.filter("date_debut IS NOT NULL AND (date_fin IS NULL OR date_fin >= date_debut) AND etat <> ''")
    day = held.groupBy("article_ref", "date_debut").agg(F.max_by(F.struct("date_fin", "etat", "texte_modificateur"), "version_num").alias("r"))
    end = F.when(F.year("r.date_fin") < open_year, F.col("r.date_fin"))
    changes = written(day.select("article_ref", F.col("date_debut").alias("valid_from"), end.alias("valid_to"), "r.etat", "r.texte_modificateur"))  # read once for each batch
    dimension = None
    for first, last in zip([None, *cuts], [*cuts, None], strict=True):
        batch = changes if first is None else changes.filter(F.col("valid_from") >= F.lit(first).cast("date"))
        batch = batch if last is None else batch.filter(F.col("valid_from") < F.lit(last).cast("date"))
        dimension = merge_history(dimension, batch, "article_ref", ["etat", "texte_modificateur"])
        if last is not None:
            dimension = written(dimension)  # what a run has left for the next
    return dimension
