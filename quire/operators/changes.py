"""Processing only new or changed records: differences between two table versions, found from their manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_dir
from quire.sources.versioned import Manifest, VersionedTable


@dataclass(frozen=True)
class Version:
    """A table version: fragments with the tag of their deletion vectors, and how to read some fragments' rows that hold or that are masked, as (keys..., digest)."""

    fragments: dict[str, tuple[str, ...]]
    rows: Callable[[dict[str, tuple[str, ...]]], DataFrame]
    masked: Callable[[dict[str, tuple[str, ...]]], DataFrame] | None = None


def record_deltas(old: Version, new: Version, keys: list[str]) -> DataFrame:
    """(keys..., op, digest): op is `insert`, `update` or `delete`; digest that of the new row, null for deletes. Keys are unique within a version.

    Fragments that both versions hold with the same deletion vectors are not read. Rows of added fragments count as added, of removed fragments as removed, and of kept
    fragments only those that their new deletion vectors mask. A row that was only moved (compaction, update without change) cancels out."""
    added = {f: v for f, v in new.fragments.items() if f not in old.fragments}
    removed = {f: v for f, v in old.fragments.items() if f not in new.fragments}
    changed = {f: v for f, v in new.fragments.items() if f in old.fragments and set(v) != set(old.fragments[f])}
    if changed and (old.masked is None or any(not set(old.fragments[f]) <= set(v) for f, v in changed.items())):
        # without a record of the masked rows, or where masks were lifted, the fragment is compared whole
        added, removed, changed = added | changed, removed | {f: old.fragments[f] for f in changed}, {}
    side = lambda df, sign: df.select(*keys, F.col("digest"), F.lit(sign).alias("sign"))
    delta = side(new.rows(added), 1).unionByName(side(old.rows(removed), -1))
    if changed:
        delta = delta.unionByName(side(old.masked({f: tuple(x for x in v if x not in old.fragments[f]) for f, v in changed.items()}), -1))
    now, before = F.max(F.when(F.col("sign") > 0, F.col("digest"))), F.max(F.when(F.col("sign") < 0, F.col("digest")))
    has = lambda sign: F.max((F.col("sign") == sign).cast("int"))
    net = delta.groupBy(*keys).agg(now.alias("digest"), before.alias("_before"), has(1).alias("_in"), has(-1).alias("_out"))
    op = F.when(F.col("_out") == 0, "insert").when(F.col("_in") == 0, "delete").when(~F.col("digest").eqNullSafe(F.col("_before")), "update")
    return net.select(*keys, op.alias("op"), "digest").filter("op IS NOT NULL")


def stored_version(table: VersionedTable, manifest: Manifest, digest: Column) -> Version:
    """A version of a stored table, with a digest over its columns (where deletion vectors carry columns, over those and the keys)."""
    read = lambda some: table.rows({k: list(v) for k, v in some.items()}).withColumn("digest", digest)

    def masked(some: dict[str, tuple[str, ...]]) -> DataFrame:
        """Rows that the given deletion vectors mask, as they were before."""
        vectors = {k: list(v) for k, v in some.items()}
        if table.carried:
            return table.masks(vectors).withColumn("digest", digest)
        return table.rows({k: [] for k in some}).join(table.masks(vectors), [*table.keys, "_fragment"], "left_semi").withColumn("digest", digest)

    return Version({k: tuple(v) for k, v in manifest.fragments.items()}, read, masked)


class IncrementalJob:
    """Processes each change of a source table once. The output's commit holds the source version it has processed: if a run dies before the commit, nothing of it
    counts and the next run sees the same changes; after the commit they are never seen again."""

    PROCESSED = "processed_version"

    def __init__(self, source: VersionedTable, output: VersionedTable, digest: Column) -> None:
        self.source, self.output, self.digest = source, output, digest

    def starts_after(self, version: int) -> None:
        """The first commit of an output whose earlier versions of the source were processed elsewhere."""
        self.output.commit(properties={self.PROCESSED: str(version)})

    def pending(self) -> tuple[DataFrame, Manifest, Manifest, Manifest]:
        """The changes since the last successful run, the source versions they lead from and to, and the output version to build on."""
        base, upto = self.output.manifest(), self.source.manifest()
        since = self.source.manifest(int(base.properties.get(self.PROCESSED, "0")))
        return record_deltas(stored_version(self.source, since, self.digest), stored_version(self.source, upto, self.digest), self.source.keys), since, upto, base

    def run(self, process: Callable[[DataFrame], DataFrame]) -> int:
        """Applies process to the new and changed rows of the source (with their `op`) and commits; returns the source version now processed. With nothing new it commits nothing.
        New and changed rows are read from added fragments alone."""
        deltas, since, upto, base = self.pending()
        if int(base.properties.get(self.PROCESSED, "0")) == upto.version:
            return upto.version
        keys = self.source.keys
        fresh = {f: v for f, v in upto.fragments.items() if f not in since.fragments or not set(since.fragments[f]) <= set(v)}
        rows = self.source.rows(fresh).drop("_fragment").join(deltas.filter("op <> 'delete'").select(*keys, "op"), keys)
        gone = deltas.filter("op = 'delete'").select(*keys) if base.fragments else None
        self.output.commit(process(rows), gone, {self.PROCESSED: str(upto.version)}, base)
        return upto.version


def plain_hash(h: Column) -> Column:
    """A content hash without regard to spelling: case, blanks, separators and a prefix such as `md5:`."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(h), r"^\s*[a-z][a-z0-9-]*\s*[:=]", ""), "[^0-9a-f]", ""), 1, 12)


def content_digest(hash_: Column, content: Column) -> Column:
    """The present hash of a chunk: the one given, or else the one derived from its content."""
    return F.coalesce(plain_hash(hash_), F.substring(F.md5(content.cast("binary")), 1, 12))


#: What is known of a chunk in a version: its hash alone.
CHUNK_STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("digest", T.StringType())])
PENDING = T.StructType([T.StructField("id", T.LongType()), T.StructField("op", T.StringType())])


def consumed_versions(table: VersionedTable, chunk_state: DataFrame, sync_runs: DataFrame) -> int:
    """Writes what the done runs have consumed as versions of an empty table (id, digest), one for each run in order, of which the last is kept: a fragment holds what the run took, and a deletion vector on it what a later
    done run took again. What runs that failed or never finished took is in no manifest. Of rows with one key and run the one consumed last counts; rows without key or run are ignored.
    Returns the version of the last run, 0 if there is none."""
    done = sorted(r["run_id"] for r in sync_runs.filter("outcome = 'done' AND run_id IS NOT NULL").select("run_id").distinct().collect())  # one manifest each
    latest = F.max_by("content_hash", F.struct("consumed_at", "content_hash"))
    taken = chunk_state.filter("chunk_pk IS NOT NULL").groupBy(F.col("chunk_pk").alias("id"), "run_id").agg(latest.alias("h"))
    made = table.replay(taken.select("id", plain_hash(F.col("h")).alias("digest"), "run_id"), "run_id", done, "run", keep=1)
    return made[-1].version if made else 0


def present_state(chunks: DataFrame) -> DataFrame:
    """(id, digest, gone) of the chunks as they are now. Rows with one id are one record, the one with the earliest loaded_at (a null one counts as last)."""
    live = chunks.filter("id IS NOT NULL").select("id", "loaded_at", F.col("removed_at").isNotNull().alias("gone"), content_digest(F.col("content_hash"), F.col("content")).alias("digest"))
    return live.groupBy("id").agg(F.min(F.struct(F.col("loaded_at").isNull().alias("x"), "loaded_at", "digest", "gone")).alias("r")).select("id", "r.digest", "r.gone")


def pending_chunks(chunks: DataFrame, chunk_state: DataFrame, sync_runs: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, op): the chunks that are new or changed since they were last consumed with success, once each; op is `insert` or `update`.

    The chunks' state becomes a versioned table in the folder (by default a new one in the shared folder): the versions that done runs left, then the chunks as they are now, as one more commit.
    An incremental job whose output says that the last run's version is processed then takes the difference of the manifests and commits it with the version now processed. Called again with the
    same folder, it adds the present chunks as a further version, and gives only what has changed since."""
    spark = chunks.sparkSession
    at = folder or f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    source, output = VersionedTable(spark, f"{at}/chunks", CHUNK_STATE, ["id"], ["digest"]), VersionedTable(spark, f"{at}/pending", PENDING, ["id"])
    job = IncrementalJob(source, output, F.col("digest"))
    if not output.versions():
        job.starts_after(consumed_versions(source, chunk_state, sync_runs))
    now = present_state(chunks)
    source.commit(now.filter("NOT gone").select("id", "digest"), now.filter("gone").select("id"))
    job.run(lambda rows: rows.select("id", "op"))
    last = output.manifest()
    earlier = output.manifest(last.version - 1).fragments
    return output.rows({f: v for f, v in last.fragments.items() if f not in earlier}).select("id", "op")
