import datetime as dt
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import index, search

WORDS = "red green blue running runs café foo-bar foo bar baz qux night light".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    data = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))), r.choice(["alpha beta", "foo", None])) for i in range(200)]
    return data, spark.createDataFrame([*data, data[3]], "id bigint, body string, title string")


@pytest.mark.parametrize("query", ["red", "red red blue", "foo-bar", "cafe night", "nothing", 'say "red"'])
def test_bm25_as_sqlite(spark, docs, query):
    data, df = docs
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, title, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, body, title) VALUES (?, ?, ?)", data)
    match = " OR ".join(f'"{w}"' for w in query.replace('"', "").split())
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r.id: r.score for r in search.bm25(df, "id", ["body", "title"], query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_empty_query_and_table(spark, docs):
    assert search.bm25(docs[1], "id", ["body"], ' "" ').count() == 0
    assert search.bm25(docs[1].limit(0), "id", ["body"], "red").count() == 0


@pytest.mark.parametrize("query", ["red", "runs red red", "foo-bar", "cafe nights", "nothing", "lighting run-lights"])
def test_index_as_sqlite_with_stems(spark, docs, query):
    data, df = docs
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, title, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, body, title) VALUES (?, ?, ?)", data)
    match = " OR ".join(f'"{w}"' for w in query.split())
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r.id: r.score for r in index.search(df, "id", ["body", "title"], query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_stems_as_sqlite_and_sql():
    import duckdb

    from quire.plans.stem_sql import stems

    words = sorted(set("relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti effective bowdlerize probate rate cease controll roll caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky yyy syzygy eyed flying dying apology geology declarations abattements ab 12 a1s".split()))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    db.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = {words[d]: t for t, d in db.execute("SELECT term, doc FROM v")}
    con = duckdb.connect()
    con.execute("CREATE TABLE ws AS SELECT unnest(?) AS w", [words])
    assert {w: text.porter_stem(w) for w in words} == want == dict(con.execute(f"WITH {stems('ws')} SELECT w, s FROM stems").fetchall())


def test_index_as_scan(spark, docs, tmp_path):
    index.build(docs[1], "id", ["body", "title"], f"file://{tmp_path}/i", stemmed=False, partitions=4)
    for query in ("red red blue", "foo-bar", "beta-foo", ""):
        a = {r.key: round(r.score, 9) for r in index.bm25(spark, f"file://{tmp_path}/i", query, stemmed=False).collect()}
        assert a == {r.id: round(r.score, 9) for r in search.bm25(docs[1], "id", ["body", "title"], query).collect()}
    empty = spark.createDataFrame([(1, None), (None, "red")], "id bigint, body string")
    assert index.search(empty, "id", ["body"], "red").count() == 0 and index.search(empty.limit(0), "id", ["body"], "red").count() == 0


def test_index_of_files_is_built_once(spark, tmp_path):
    def write(*rows):
        spark.createDataFrame(list(rows), "id bigint, body string, kind string, loaded_at timestamp").write.mode("overwrite").parquet(f"file://{tmp_path}/d")
        return spark.read.parquet(f"file://{tmp_path}/d")

    t = lambda n: dt.datetime(2024, 1, n)
    df = write((1, "red", "a", t(2)), (1, "blue", "b", t(1)), (2, "reds", "a", t(1)), (3, "green", "a", t(1)), (4, None, "a", t(1)), (5, "x", "a", None))
    at = index.of(df, "id", ["body"], at="loaded_at")
    assert at == index.of(df, "id", ["body"], at="loaded_at") != index.of(df, "id", ["body"], stemmed=False, at="loaded_at")
    got = index.search(df, "id", ["body"], "red blue", ["kind"], at="loaded_at").collect()
    assert {(r.id, r.kind) for r in got} == {(1, "b"), (2, "a")}  # the row loaded first
    assert {r.id for r in index.search(df, "id", ["body"], "red blue", ["kind"], F.col("kind") == "a", at="loaded_at").collect()} == {2}
    assert {r.id for r in index.search(df, "id", ["body"], "red blue", ["kind"], at="loaded_at", most=1).collect()} <= {1, 2}
    again = write((9, "red", "a", t(2)))
    assert index.of(again, "id", ["body"], at="loaded_at") != at and {r.id for r in index.search(again, "id", ["body"], "red", at="loaded_at").collect()} == {9}


@pytest.mark.parametrize("query", ["NEAR(red blue, 2)", "NEAR(red green night, 6)", 'NEAR("foo bar" qux)', "^red", '"foo b"*', '^"foo bar"', "body : NEAR(red alpha)", "NOT NEAR(red blue) red"])
def test_near_and_first_as_sqlite(spark, docs, query):
    data, df = docs
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, title, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, body, title) VALUES (?, ?, ?)", data)
    said = {"NOT NEAR(red blue) red": "red NOT NEAR(red blue)"}.get(query, query)  # there NOT stands between two
    want = {i for (i,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (said,))}
    assert {r.id for r in search.matching(df, "id", ["body", "title"], query).collect()} == want


def test_boolean(spark, docs):
    data, df = docs
    got = {r.id for r in search.matching(df, "id", ["body", "title"], '(red OR gre*) AND NOT "foo bar" title:alpha').collect()}
    want = {i for i, b, t in data if ("red" in b.split() or "green" in b.split()) and "foo bar" not in b.replace("-", " ") and t == "alpha beta"}
    assert got == want
    with pytest.raises(ValueError):
        search.matching(df, "id", ["body"], "(red")


@pytest.mark.parametrize("sent", [search.SENT, 0])
def test_nearest(spark, monkeypatch, sent):
    monkeypatch.setattr(search, "SENT", sent)  # 0: in blocks
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[5] = v[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id bigint, vector array<float>")
    q = df.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in search.nearest(q, df, 5, block=16).collect()}
    s = v.astype(float) @ v.astype(float).T
    for i in range(0, 90, 10):
        want = sorted(range(90), key=lambda j: (-round(s[i, j], 12), j))[:5]
        assert [got[i, k] for k in range(1, 6)] == want
    assert search.nearest(q.limit(0), df, 5).count() == 0


def test_second_pass_by_path(spark):
    df = spark.createDataFrame([("a/b/x.md", 1.0), ("old/b/x.md", 2.0), ("x.md", 3.0), ("c/y.md", 1.0)], "path string, score double")
    assert {r.path for r in search.merged_by_path(df, "path").collect()} == {"a/b/x.md", "x.md", "c/y.md"}


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(1, "red blue"), (2, "red blue"), (3, ""), (4, None)], "id bigint, text string")
    v = {r.id: np.array(r.vector) for r in search.embedded(df, 16).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-6 and not v[3].any() and not v[4].any()


def test_slugs(spark):
    df = spark.createDataFrame([("notes", "a_b/Été 1/My File.md"), ("", "x.py")], "c string, p string")
    assert [r[0] for r in df.select(text.book_slug(F.col("c"), F.col("p"))).collect()] == ["notes-ab-été-1--my-file-md", "x-py"]


@pytest.fixture
def parts_as_they_are(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts are put together
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbering_a_hot_key_in_parts(spark, parts_as_they_are):
    from quire.operators.skew import numbered

    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"), (F.col("id") * 7919 % 6007).alias("v"))
    placed, parts = numbered(df, ["k"], [F.col("v").asc()])
    want = {}
    for k, v in df.collect():
        want.setdefault(k, []).append(v)
    want = {(k, v): (n, len(vs)) for k, vs in want.items() for n, v in enumerate(sorted(vs), 1)}
    assert {(r.k, r.v): (r._no, r._total) for r in placed.collect()} == want
    assert parts.filter("k = 'hot'").count() > 1


def test_sections_and_bursts_in_parts(spark, parts_as_they_are):
    from quire.operators import jobs

    df = spark.createDataFrame([(b, i % 7 if i % 5 else None, i % 3, f"c{i:03d}", f"t{i}" if i % 4 else None) for b in ("x", "y", None) for i in range(300)], "book_slug string, page_start int, paragraph int, chunk_id string, chapter_title string")
    got = {(r.book_slug, r.chunk_id): (r.position, r.total, r.next_section) for r in search.sections(df).collect()}
    for b in ("x", "y", None):
        own = sorted((r for r in df.filter(F.col("book_slug").eqNullSafe(F.lit(b))).collect()), key=lambda r: (r.page_start is None, r.page_start or 0, r.paragraph, r.chunk_id))
        for n, r in enumerate(own, 1):
            assert got[b, r.chunk_id] == (n, 300, own[n].chapter_title if n < 300 else None)
    r = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    data = [(r.choice(["a", "a", "a", None]), at + dt.timedelta(seconds=r.randint(0, 20_000))) for _ in range(900)] + [("a", None), ("b", at)]
    bursts = jobs.debounced(spark.createDataFrame(data, "k string, at timestamp"), "k", "at", "20 seconds")
    want = set()
    for k in ("a", "b", None):
        times = sorted(t for x, t in data if x == k and t)
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t >= run[-1] + dt.timedelta(seconds=20):
                want.add((k, run[0], run[-1] + dt.timedelta(seconds=20), len(run)))
                run = []
            run.append(t)
    assert {tuple(x) for x in bursts.collect()} == want
    scans = jobs.spaced(bursts, "k", "90 seconds").collect()
    for k in ("a", None):
        own = sorted(x.scan_at for x in scans if x.k == k)
        assert all((b - a).total_seconds() >= 90 for a, b in zip(own, own[1:], strict=False))


def test_projects_and_api(spark, tmp_path):
    from quire.api import Projects, Search, number, whole_number

    assert [number(x, 1.5) for x in (True, None, "2.25", 3, "x")] == [1.5, 1.5, 2.25, 3.0, 1.5] and whole_number("7.9", 1) == 7
    rows = [("c1", "red blue", "T", None, "b1", "x", ["t"], 1, 1, "f1.md", 1, 2), ("c2", "red", "T", "ch", "b1", "x", None, 2, 1, "f1.md", 3, 4), ("c3", "reds green", "U", None, "b2", "y", ["t"], 1, 1, "g.md", None, None)]
    ddl = "chunk_id string, content string, book_title string, chapter_title string, book_slug string, corpus string, tags array<string>, page_start int, paragraph int, book_file string, line_start int, line_end int"
    spark.createDataFrame(rows, ddl).write.parquet(f"file://{tmp_path}/c")
    s = Search(spark.read.parquet(f"file://{tmp_path}/c"))
    assert {r.chunk_id for r in s.text("red").scored().collect()} == {"c1", "c2", "c3"} and {r.chunk_id for r in s.context("red").of(corpus="y").scored().collect()} == {"c3"}
    assert [r.chunk_id for r in s.text("nowhere").expand("b1").collect()] == ["c1", "c2"] and [r.chunk_id for r in s.text("blue").expand("b1").collect()] == ["c1"]
    gone = spark.createDataFrame([("x", "f1.md")], "corpus string, filepath string")
    assert {r.book_slug for r in s.text("red").without(gone).results(5).collect()} == {"b2"}
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c3", [0.0, 1.0])], "chunk_id string, vector array<float>")
    v = Search(s.chunks, vectors=vectors)
    assert {r.chunk_id: round(r.score, 2) for r in v.hybrid("nowhere", [0.0, 1.0]).scored().collect()} == {"c1": 0.0, "c3": 1.0}
    assert [r.chunk_id for r in v.context("reds", [0.0, 1.0]).results(1).collect()] == ["c3"]
    p = Projects({"/a/one": s, "/b/one": v, "/a/two": v})
    assert p.find("two") is v and p.find("/a/one/") is s
    for bad in ("", "one", "three", "/a/three"):
        with pytest.raises(LookupError):
            p.find(bad)


def test_embedding_models(spark):
    from quire.operators import embedding

    assert embedding.model("fast") == embedding.model("paraphrase-multilingual-MiniLM-L12-v2") and embedding.model("x/y") == ("x/y", -1, "")
    assert embedding.as_query("q", "quality").endswith("passages: q") and embedding.as_query("q", "fast") == "q"
    chunks = spark.createDataFrame([("a", "red"), ("b", "blue"), ("b", "blue"), ("c", None)], "chunk_id string, content string")
    none = spark.createDataFrame([], "chunk_id string, model string, vector array<float>")
    made = embedding.generated(chunks, none, "hash")
    assert sorted(r.chunk_id for r in made.collect()) == ["a", "b"]
    other = spark.createDataFrame([("a", "other", [1.0])], none.schema)
    with pytest.raises(ValueError, match="other"):
        embedding.generated(chunks, other, "hash")
    assert {(r.chunk_id, r.model) for r in embedding.generated(chunks, other, "hash", force=True).collect()} == {("a", "quire/hashed-words"), ("b", "quire/hashed-words")}
    only = spark.createDataFrame([("b",), ("gone",)], "chunk_id string")
    assert [r.chunk_id for r in embedding.generated(chunks, none, "hash", only=only).collect()] == ["b"]
