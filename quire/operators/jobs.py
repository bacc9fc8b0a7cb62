"""A durable priority queue as tables: jobs (id, type, priority, payload, status, created_at, attempts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.skew import numbered


#: How soon each type's turn comes, the lowest first (fixed values).
PRIORITIES = {"scan": 0, "remove": 10, "move": 10, "ingest": 40, "ocr": 50, "embed": 60}


def priority(type_: Column) -> Column:
    """Of a type; unknown ones come last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), type_), F.lit(60))


def canonical(payload: Column) -> Column:
    """A JSON object with its keys in order, so that equal payloads are equal texts; values keep their text. Anything else stays as it is."""
    pairs = F.from_json(payload, "map<string, string>")
    entries = F.array_sort(F.map_entries(pairs))
    quoted = lambda s: F.to_json(F.array(s))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.regexp_replace(quoted(e["key"]), r"^\[|\]$", ""), F.lit(": "), F.regexp_replace(quoted(e["value"]), r"^\[|\]$", ""))), ", ")
    return F.when(pairs.isNotNull() & F.startswith(F.ltrim(payload), F.lit("{")), F.concat(F.lit("{"), body, F.lit("}"))).otherwise(payload)


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Of new (type, payload, ...) those that are not pending already, each once."""
    pending = jobs.filter("status = 'pending'").select("type", "payload")
    return new.dropDuplicates(["type", "payload"]).join(pending, ["type", "payload"], "left_anti")


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """(inserted, deduped): what enqueue takes of new, and what it leaves."""
    taken = enqueue(jobs, new).agg(F.count(F.lit(1)).alias("inserted"))
    return new.agg(F.count(F.lit(1)).alias("_all")).join(taken).select("inserted", (F.col("_all") - F.col("inserted")).alias("deduped"))


def claim_order(jobs: DataFrame, n: int) -> DataFrame:
    """The next n pending jobs: by priority, then age, then id."""
    order = ["priority", "created_at", "id"]
    return jobs.filter("status = 'pending'").orderBy(*order).limit(n).withColumn("turn", F.row_number().over(Window.orderBy(*order)))


def claimed(jobs: DataFrame, n: int, now: Column) -> DataFrame:
    """The queue after n jobs were claimed: they run, with one attempt more and started_at."""
    mine = F.broadcast(claim_order(jobs, n).select("id", F.lit(True).alias("_mine")))  # n rows
    j = jobs.join(mine, "id", "left")
    took = F.coalesce("_mine", F.lit(False))
    new = {"status": F.when(took, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + took.cast("int"), "started_at": F.when(took, now).otherwise(F.col("started_at"))}
    return j.withColumns(new).select(*jobs.columns)


def settled(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after events (id, status, at, error): of each running job the latest event counts (on ties the greater status). `done` and `failed` set finished_at and error, `pending` puts the job back
    without them; jobs that do not run stay as they are."""
    last = events.filter(F.col("status").isin("done", "failed", "pending")).groupBy("id").agg(F.max_by(F.struct("status", "at", "error"), F.struct("at", "status")).alias("_e"))
    j = jobs.join(last, "id", "left")
    hit = F.col("_e").isNotNull() & (F.col("status") == "running")
    over = hit & (F.col("_e.status") != "pending")
    new = {"status": F.when(hit, F.col("_e.status")).otherwise(F.col("status")), "finished_at": F.when(over, F.col("_e.at")).otherwise(F.when(~hit, F.col("finished_at"))), "error": F.when(hit & (F.col("_e.status") == "failed"), F.col("_e.error")).otherwise(F.when(~hit, F.col("error")))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def fanned_out(changes: DataFrame, chunks: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(type, corpus, filepath, from_path, part, priority): the jobs that a scan's changes (see sync.snapshot_diff) lead to. Moves, removals and ingests at once; for chunks (corpus, filepath, chunk_id)
    that wait for a vector, an embed job for each `batch` of a file, by chunk id."""
    kind = F.when(F.col("change").isin("moved", "cross_moved"), "move").when(F.col("change") == "removed", "remove").when(F.col("change").isin("added", "modified"), "ingest")
    none = F.lit(None).cast("int")
    out = changes.select(kind.alias("type"), "corpus", "filepath", "from_path", none.alias("part")).filter("type IS NOT NULL")
    if chunks is not None:
        out = out.unionByName(embed_batches(chunks, batch).select(F.lit("embed").alias("type"), "corpus", "filepath", F.lit(None).cast("string").alias("from_path"), "part").distinct())
    return out.withColumn("priority", priority(F.col("type")))


def embed_batches(chunks: DataFrame, size: int = 64) -> DataFrame:
    """chunks (corpus, filepath, chunk_id) with part: batches of `size` of a file's chunks, by chunk id."""
    placed, _ = numbered(chunks.select("corpus", "filepath", "chunk_id").distinct(), ["corpus", "filepath"], [F.col("chunk_id").asc()])
    return placed.select("corpus", "filepath", "chunk_id", F.floor((F.col("_no") - 1) / size).cast("int").alias("part"))


def retry_failed(jobs: DataFrame) -> DataFrame:
    """(id, verdict) of failed jobs: `twin`, an equal one is pending; `duplicate`, an equal failed one with more attempts (or a smaller id) stands for it; else `requeue`."""
    failed = jobs.filter("status = 'failed'")
    pending = jobs.filter("status = 'pending'").select("type", "payload").distinct().withColumn("twin", F.lit(True))
    w = Window.partitionBy("type", "payload").orderBy(F.desc("attempts"), "id")
    verdict = F.when(F.col("twin"), "twin").when(F.col("rn") > 1, "duplicate").otherwise("requeue")
    return failed.withColumn("rn", F.row_number().over(w)).join(pending, ["type", "payload"], "left").select("id", verdict.alias("verdict"))


def reap(jobs: DataFrame, now: Column, most_hours: int = 3, most_attempts: int = 3, alive: list[int] | None = None) -> DataFrame:
    """(id, verdict) of running jobs: `keep` while young or among those known to be alive; else `failed` after too many attempts, `drop` if an older equal one is taken up, or `pending`."""
    w = Window.partitionBy("type", "payload").orderBy("created_at", "id")
    old = F.col("created_at") < now - F.expr(f"INTERVAL {most_hours} HOURS")
    verdict = F.when(~old | F.col("id").isin(alive or []), "keep").when(F.col("attempts") >= most_attempts, "failed").when(F.col("rn") > 1, "drop").otherwise("pending")
    return jobs.filter("status = 'running'").withColumn("rn", F.row_number().over(w)).select("id", verdict.alias("verdict"))


def retained(jobs: DataFrame, now: Column, days: int = 30, rows: int = 20_000) -> DataFrame:
    """Finished jobs that history keeps: not older than `days`, and of those the newest `rows`."""
    done = jobs.filter(F.col("status").isin("done", "failed") & (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    return done.orderBy(F.desc("id")).limit(rows)


def debounced(changes: DataFrame, key: str, at: str, gap: str = "5 seconds") -> DataFrame:
    """(key, start, end, changes): bursts of changes, of which one scan is made, `gap` after the last. Rows without time are left out.

    The changes are ranged by key and time; a burst begins where the change before is `gap` or more away, in the part or at the end of the key's part before, and is counted over the parts, so that a
    key with most of the changes is many tasks' work."""
    pause = F.expr(f"INTERVAL {gap}")
    placed, parts = numbered(changes.filter(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_time")), ["_key"], [F.col("_time")])
    inside = Window.partitionBy("_key", "_part").orderBy("_no")
    bounds = placed.groupBy("_key", "_part").agg(F.max("_time").alias("_last"))
    over = Window.partitionBy("_key").orderBy("_part")
    bounds = bounds.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.lag("_last").over(over).alias("_before"))
    met = placed.join(bounds, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).drop("_k", "_p")
    previous = F.coalesce(F.lag("_time").over(inside), F.col("_before"))
    marked = met.withColumn("_starts", (previous.isNull() | (F.col("_time") >= previous + pause)).cast("int"))
    local = marked.withColumn("_burst", F.sum("_starts").over(inside))
    some = local.groupBy("_key", "_part", "_burst").agg(F.min("_time").alias("start"), F.max("_time").alias("last"), F.count(F.lit(1)).alias("changes"))
    sums = some.groupBy(F.col("_key").alias("_k"), F.col("_part").alias("_p")).agg(F.max("_burst").alias("_n"))
    sums = sums.withColumn("_more", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = some.join(sums, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).withColumn("_no", F.col("_burst") + F.col("_more"))
    out = whole.groupBy("_key", "_no").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("changes").alias("changes"))
    return out.select(F.col("_key").alias(key), "start", (F.col("last") + pause).alias("end"), "changes")


def spaced(bursts: DataFrame, key: str, least: str = "30 seconds") -> DataFrame:
    """bursts (key, end, ...) with `scan_at`: a scan starts at the end of its burst, but `least` or more after the scan before of the same key. As each scan depends on the one before, a key's bursts,
    which are few beside its changes, are one group."""
    import pandas as pd

    wait = pd.Timedelta(least)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("end", kind="stable")
        at, out = None, []
        for end in own["end"]:
            at = end if at is None else max(end, at + wait)
            out.append(at)
        return own.assign(scan_at=out)

    ddl = ", ".join(f"`{n}` {t}" for n, t in bursts.dtypes)
    return bursts.groupBy(key).applyInPandas(run, f"{ddl}, scan_at timestamp")


def tranches(pages: DataFrame, size: int = 50) -> DataFrame:
    """(slug, first_page, last_page): a book's pages in parts of `size`."""
    first = F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(size)))
    return pages.filter("page_count >= 1").select("slug", "page_count", first.alias("first_page")).select("slug", "first_page", F.least(F.col("first_page") + size - 1, F.col("page_count")).alias("last_page"))


def dispatch(jobs: DataFrame, caps: dict[str, int], exclusive: list[str], slots: int, reserved: int = 0, urgent: int = 0) -> DataFrame:
    """The jobs (project, ...) to start next over all projects: oldest first within priority, at most caps[type] of a type, and of exclusive types one at a time for each project. `reserved` of the
    slots are kept for jobs of a priority up to `urgent`. Each task keeps the few first of a type or project before they meet."""
    order = ["priority", "created_at", "id"]
    p = jobs.filter("status = 'pending'")
    if exclusive:
        alone = F.row_number().over(Window.partitionBy("project", "type").orderBy(*order))
        one = p.filter(F.col("type").isin(exclusive)).withColumn("_alone", alone).filter("_alone = 1").drop("_alone")
        p = p.filter(~F.coalesce(F.col("type").isin(exclusive), F.lit(False))).unionByName(one)
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("type")), F.lit(slots)) if caps else F.lit(slots)
    p = p.withColumn("_no", F.row_number().over(Window.partitionBy("type").orderBy(*order))).filter(F.col("_no") <= slots).filter(F.col("_no") <= cap).drop("_no")
    if not reserved:
        return p.orderBy(*order).limit(slots)
    first = p.orderBy(*order).limit(slots)  # what follows are `slots` rows and the urgent ones
    rank = F.row_number().over(Window.orderBy(F.col("priority") <= urgent, *order))
    return first.withColumn("_lane", rank).filter((F.col("priority") <= urgent) | (F.col("_lane") <= slots - reserved)).drop("_lane").orderBy(*order)
