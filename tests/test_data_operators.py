"""Intervals, references, changes and history against brute force, with nulls, ties, repeats and empty tables."""

import datetime as dt
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import changes, history, intervals, references, skew
from quire.sources.versioned import Conflict, VersionedTable

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def brute_periods(rows):
    """Days one by one, up to a horizon."""
    cover = defaultdict(lambda: defaultdict(int))
    for e, a, z in rows:
        if e is None or a is None or (z is not None and z < a):
            continue
        end = day(400) if z is None or z.year >= 2900 else z
        for i in range((end - a).days + 1):
            cover[e][a + dt.timedelta(days=i)] += 1
    out = set()
    for e, c in cover.items():
        days = sorted(c)
        runs = [[days[0]]]
        for d in days[1:]:
            if (d - runs[-1][-1]).days == 1:
                runs[-1].append(d)
            else:
                runs.append([d])
        for r, after in zip(runs, [*runs[1:], None], strict=True):
            end = "open" if r[-1] == day(400) else str(r[-1])
            if max(c[d] for d in r) > 1:
                out.add((e, "merged", str(r[0]), end))
            if after:
                out.add((e, "gap", str(r[-1] + dt.timedelta(days=1)), str(after[0] - dt.timedelta(days=1))))
    return out


SPANS = "entity string, first date, last date, n int"


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SPANS)
    return {tuple(r) for r in intervals.overlaps_and_gaps(intervals.periods(df, "entity", "first", "last"), "entity").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        a = r.randint(0, 300)
        z = r.choice([None, day(a + r.randint(0, 40)), day(a + r.randint(0, 3)), day(a - 1), dt.date(2999, 1, 1), day(a)]) if r.random() < 0.3 else day(min(399, a + r.randint(0, 12)))
        rows.append((r.choice(["a", "b", "c", "d", None, *[f"e{i}" for i in range(60)]]), None if r.random() < 0.03 else day(a), z))
    assert found(spark, rows) == brute_periods(rows)


def test_intervals_edges(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", day(0), day(4)), ("a", day(5), day(9))]) == set()  # neighbours are one period without overlap
    assert found(spark, [("a", day(0), day(9)), ("a", day(0), day(9))]) == {("a", "merged", "2020-01-01", "2020-01-10")}
    assert found(spark, [("a", day(0), None), ("a", day(30), day(31))]) == {("a", "merged", "2020-01-01", "open")}
    assert found(spark, [("a", dt.date(1, 1, 1), dt.date(1, 1, 1)), ("a", dt.date(2899, 12, 31), dt.date(2899, 12, 31))]) == {("a", "gap", "0001-01-02", "2899-12-30")}


def test_dyadic_blocks_are_canonical(spark):
    r = random.Random(3)
    rows = [(f"x{i}", a, a + r.randint(1, 5000)) for i in range(60) for a in [r.randint(0, 100000)]]
    got = defaultdict(list)
    for x in intervals.dyadic_blocks(spark.createDataFrame(rows, "e string, a int, z int"), "e", "a", "z").collect():
        got[x["e"]].append((x["code"] >> 6, x["code"] & 63))
    for e, a, z in rows:
        blocks = sorted(got[e])
        assert all(s % (1 << k) == 0 for s, k in blocks) and blocks[0][0] == a
        assert all(s + (1 << k) == n for (s, k), n in zip(blocks, [*(b[0] for b in blocks[1:]), z], strict=True))


def test_join_on_hot_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"))
    unique = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.join_unique(rows, unique, ["k"], counts, "n", 8)
    assert sorted(map(tuple, got.select("row", "k", "v").collect())) == sorted(map(tuple, rows.join(unique, "k").select("row", "k", "v").collect()))
    assert skew.hot_keys(counts, ["k"], "n").count() <= 200


def test_references(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    books = spark.createDataFrame([(1, t(5), None), (1, t(2), None), (2, t(1), t(9)), (3, t(20), None), (None, t(1), None)], "id bigint, added_at timestamp, removed_at timestamp")
    kids = spark.createDataFrame([(10, 1, t(3)), (11, 2, t(3)), (12, 3, t(3)), (13, 99, t(3)), (14, None, t(3)), (10, 1, t(8)), (15, 3, None), (16, 1, t(1))], "id bigint, ref bigint, loaded_at timestamp")
    got = references.failing_references([references.children(kids, "kids", "books", "ref")], [references.parents(books, "books", "id", "added_at", "removed_at")])
    assert {(r.id, r.kind) for r in got.collect()} == {(11, "deleted"), (12, "late"), (13, "missing"), (16, "late")}
    empty = references.failing_references([references.children(kids.limit(0), "kids", "books", "ref")], [references.parents(books, "books", "id", "added_at", "removed_at")])
    assert empty.count() == 0
    assert {(r.month, r.kind, r.records) for r in references.failing_by_period(got).collect()} == {("2024-01", "deleted", 1), ("2024-01", "late", 2), ("2024-01", "missing", 1)}


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def test_versions_and_deltas(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"])
    digest = F.md5(F.coalesce("v", F.lit("")))
    at = lambda n: changes.stored_version(t, t.manifest(n), digest)
    ops = lambda a, z: {(r.id, r.op) for r in changes.record_deltas(at(a), at(z), ["id"]).collect()}
    assert t.read().count() == 0
    t.commit(rows(spark, (1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "x")))
    t.commit(rows(spark, (2, "B"), (3, "c"), (4, "d")), rows(spark, (1, None)))
    assert {tuple(r) for r in t.read().collect()} == {(2, "B"), (3, "c"), (4, "d")}
    assert {tuple(r) for r in t.read(1).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert ops(1, 2) == {(1, "delete"), (2, "update"), (4, "insert")} and ops(0, 1) == {(1, "insert"), (2, "insert"), (3, "insert")}
    t.rewrite()
    assert ops(2, 3) == set() and ops(1, 3) == ops(1, 2)
    base = t.manifest()
    t.commit(rows(spark, (9, "z")), base=base)
    with pytest.raises(Conflict):
        t.commit(rows(spark, (8, "y")), base=base)
    assert {r.id for r in t.read().collect()} == {2, 3, 4, 9}


def test_incremental_job_survives_failures(spark, tmp_path):
    src, out = (VersionedTable(spark, f"file://{tmp_path}/{n}", SCHEMA, ["id"]) for n in ("src", "out"))
    job = changes.IncrementalJob(src, out, F.md5("v"))
    seen = []

    def work(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.withColumn("v", F.upper("v"))

    def dies(df):
        df.write.parquet(f"file://{tmp_path}/lost{len(seen)}")
        raise RuntimeError("lost")

    src.commit(rows(spark, (1, "a"), (2, "b")))
    with pytest.raises(RuntimeError):
        job.run(dies)
    job.run(work)
    src.commit(rows(spark, (2, "bb"), (3, "c")))
    src.commit(None, rows(spark, (1, None)))
    with pytest.raises(RuntimeError):
        job.run(dies)
    assert job.run(work) == 3 and job.run(work) == 3
    assert seen == [[1, 2], [2, 3]]
    assert {tuple(r) for r in out.read().collect()} == {(2, "BB"), (3, "C")}


def test_replay_is_one_commit_after_another(spark, tmp_path):
    r = random.Random(8)
    data = sorted({(r.randint(1, 40), s): r.choice("abc") for s in (2, 5, 9, 11) for _ in range(25)}.items(), key=lambda x: x[0][1])
    df = spark.createDataFrame([(i, v, s) for (i, s), v in data] + [(None, "x", 2), (1, "x", None), (1, "x", 3)], "id bigint, v string, step int")
    a, b = (VersionedTable(spark, f"file://{tmp_path}/{n}", SCHEMA, ["id"], ["v"]) for n in "ab")
    a.replay(df, "step", [2, 5, 7, 9, 11], "run")
    for s in (2, 5, 7, 9, 11):
        b.commit(df.filter(F.col("step") == s).select("id", "v"), properties={"run": str(s)})
    assert a.versions() == [1, 2, 3, 4, 5] and "step-7" not in a.manifest().fragments
    for n in range(1, 6):
        assert {tuple(x) for x in a.read(n).collect()} == {tuple(x) for x in b.read(n).collect()} and a.manifest(n).properties == b.manifest(n).properties
    with pytest.raises(Conflict):
        a.replay(df, "step", [2], "run")


def test_unchanged_fragments_are_not_read(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], ["v"])
    t.commit(rows(spark, *[(i, "a") for i in range(10)]))
    t.commit(rows(spark, *[(i, "b") for i in range(100, 110)]))
    one, two = t.manifest(2).fragments
    t.commit(rows(spark, (105, "B"), (200, "c")))
    assert t.manifest().fragments[one] == []  # out of the range of what was replaced
    shutil.rmtree(tmp_path / "t" / "data" / one)
    shutil.rmtree(tmp_path / "t" / "data" / two)  # only its deletion vector counts, which carries what is compared
    at = lambda n: changes.stored_version(t, t.manifest(n), F.col("v"))
    assert {(r.id, r.op) for r in changes.record_deltas(at(2), at(3), ["id"]).collect()} == {(105, "update"), (200, "insert")}


def test_compaction_by_rule(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"])
    t.commit(rows(spark, *[(i, "a") for i in range(10)]))
    for i in range(3):
        t.commit(rows(spark, (i, "b")))
    before = {tuple(x) for x in t.read().collect()}
    assert t.compacted(10, 3).version == 4  # nothing to do
    m = t.compacted(10, 2)
    assert len(m.fragments) == 4 and max(map(len, m.fragments.values())) == 0 and {tuple(x) for x in t.read().collect()} == before
    assert len(t.compacted(3).fragments) == 1 and {tuple(x) for x in t.read().collect()} == before


CHUNKS = "id bigint, content_hash string, content string, loaded_at timestamp, removed_at timestamp"


def test_pending_chunks(spark):
    t = dt.datetime(2024, 1, 1)
    chunks = spark.createDataFrame(
        [(1, "aa11", "x", t, None), (2, None, "y", t, None), (3, "cc", "z", t, t), (4, "dd", "w", t, None), (5, "ee", "v", t, None), (5, "ee", "v", t, None), (6, "ff", "u", None, None)],
        CHUNKS,
    )
    y = "415290769594"  # md5 of y
    state = spark.createDataFrame([(1, "MD5:AA11", 1, t), (1, "AA11", 1, t), (2, y.upper(), 1, t), (4, "d0", 1, t), (4, "dd", 2, t), (5, "ee", 1, t), (5, "old", 3, t), (None, "q", 1, t)], "chunk_pk bigint, content_hash string, run_id int, consumed_at timestamp")
    runs = spark.createDataFrame([(1, "done"), (2, "failed"), (3, "done")], "run_id int, outcome string")
    got = {(r.id, r.op) for r in changes.pending_chunks(chunks, state, runs).collect()}
    assert got == {(4, "update"), (5, "update"), (6, "insert")}
    assert changes.pending_chunks(chunks.limit(0), state, runs).count() == 0
    assert changes.pending_chunks(chunks, state.limit(0), runs).count() == 5
    assert changes.pending_chunks(chunks, state, runs.limit(0)).count() == 5


def test_pending_chunks_once_each_over_runs_that_die(spark, tmp_path, monkeypatch):
    t = dt.datetime(2024, 1, 1)
    at = f"file://{tmp_path}/p"
    state = spark.createDataFrame([(1, "aa", 1, t), (2, "bb", 1, t)], "chunk_pk bigint, content_hash string, run_id int, consumed_at timestamp")
    runs = spark.createDataFrame([(1, "done")], "run_id int, outcome string")
    run = lambda *data: {(r.id, r.op) for r in changes.pending_chunks(spark.createDataFrame([(i, h, "x", t, g) for i, h, g in data], CHUNKS), state, runs, at).collect()}
    data = [(1, "aa", None), (2, "b2", None), (3, "cc", None)]
    real = VersionedTable._write_manifest

    def dies(self, m):
        if self.path.endswith("pending") and m.fragments:
            raise RuntimeError("lost")
        real(self, m)

    monkeypatch.setattr(VersionedTable, "_write_manifest", dies)
    with pytest.raises(RuntimeError):
        run(*data)
    monkeypatch.undo()
    assert run(*data) == {(2, "update"), (3, "insert")}
    assert run(*data, (4, "dd", None)) == {(4, "insert")}
    assert run((1, "aa", t), (2, "b2", None), (3, "c3", None), (4, "dd", None)) == {(3, "update")}


def test_history_merge_in_parts_is_the_whole(spark):
    r = random.Random(5)
    events = sorted({(r.choice("abc"), day(r.randint(0, 200))) for _ in range(60)}, key=lambda x: x[1])
    ddl = "e string, valid_from date, valid_to date, s string"
    data = [(e, d, r.choice([None, d + dt.timedelta(days=r.randint(0, 30))]), r.choice(["x", "y", None])) for e, d in events]
    whole = history.merge_history(None, spark.createDataFrame(data, ddl), "e", ["s"])
    part = history.merge_history(None, spark.createDataFrame(data[:30], ddl), "e", ["s"])
    part = history.merge_history(part, spark.createDataFrame(data[30:], ddl), "e", ["s"])
    assert {tuple(x) for x in part.collect()} == {tuple(x) for x in whole.collect()}
    assert history.merge_history(None, spark.createDataFrame([], ddl), "e", ["s"]).count() == 0
    assert {tuple(x) for x in history.merge_history(whole, spark.createDataFrame([], ddl), "e", ["s"]).collect()} == {tuple(x) for x in whole.collect()}


def test_history_merge_closes_extends_and_inserts(spark):
    ddl = "e string, valid_from date, valid_to date, s string"
    current = spark.createDataFrame([("a", day(0), day(9), "x"), ("a", day(10), None, "y"), ("b", day(0), None, "x"), ("c", day(0), day(3), "x"), ("d", day(5), None, None)], ddl)
    change = spark.createDataFrame([("a", day(20), None, "z"), ("b", day(20), day(30), "x"), ("c", day(9), None, "x"), ("d", day(5), day(8), "w"), ("e", day(1), None, "x"), (None, day(1), None, "x"), ("e", None, None, "x"), ("e", day(9), day(8), "q")], ddl)
    got = {tuple(x) for x in history.merge_history(current, change, "e", ["s"]).collect()}
    assert got == {
        ("a", day(0), day(9), "x"), ("a", day(10), day(19), "y"), ("a", day(20), None, "z"), ("b", day(0), day(30), "x"), ("c", day(0), day(3), "x"), ("c", day(9), None, "x"), ("d", day(5), day(8), "w"), ("e", day(1), None, "x"),
    }


def test_article_history_in_any_batches(spark):
    from quire.sources.tables import table

    notices = table(spark, "/root/testdata/sf0.001", "article_versions")
    of = lambda *cuts: {tuple(x) for x in history.article_history(notices, cuts=cuts).collect()}
    assert of() == of("2011-05-03") == of("1990-01-01", "2008-01-01", "2009-01-01", "2020-01-01")


def test_the_earliest_record_counts(spark):
    from quire.sources.tables import one_record

    t = lambda n: dt.datetime(2024, 1, n)
    df = spark.createDataFrame([(1, "late", t(5)), (1, "early", t(2)), (1, "unknown", None), (2, "unknown", None), (None, "x", t(1))], "id bigint, v string, loaded_at timestamp")
    assert {tuple(x) for x in one_record(df, "id", "v").collect()} == {(1, "early"), (2, "unknown")}


def test_history_from_snapshots(spark):
    ddl = "e string, s string"
    far = lambda df: spark.createDataFrame(df.collect(), df.schema)
    h = history.merge_history(None, history.snapshot_changes(spark.createDataFrame([], "e string, valid_from date, s string"), spark.createDataFrame([("a", "1"), ("b", None)], ddl), "e", ["s"], "2020-01-01"), "e", ["s"])
    h = far(h)
    h = far(history.merge_history(h, history.snapshot_changes(h.filter("valid_to IS NULL"), spark.createDataFrame([("a", "2"), ("c", "3")], ddl), "e", ["s"], "2020-02-01"), "e", ["s"]))
    got = {(x.e, str(x.valid_from), str(x.valid_to), x.s) for x in h.collect()}
    assert got == {("a", "2020-01-01", "2020-01-31", "1"), ("a", "2020-02-01", "None", "2"), ("b", "2020-01-01", "2020-01-31", None), ("c", "2020-02-01", "None", "3")}
    assert {x.e for x in history.as_of(h, "2020-01-15").collect()} == {"a", "b"}
