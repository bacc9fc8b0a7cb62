"""Parsers, discovery, differences, a library synced with a folder, and streams against their batch forms."""

import datetime as dt
import io
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, graph, sync
from quire.plans.ingest import Library
from quire.sources import files, parsers
from quire.streaming import sync as streams


def texts(path, content):
    return [p.content for p in parsers.parse(path, content).passages]


def test_text_parsers():
    r = parsers.parse("a/b.md", b"---\ntitle: T\n---\n# One\nSome long paragraph of text.\n\n```\n# not\n```\n## Two\n[x](../y.md#a) [[Z|z]] and more words\n# Empty\n")
    assert r.title == "T" and [p.chapter_title for p in r.passages] == ["One", "Two", "Empty"] and r.passages[0].line_start == 5
    assert {(x.relation, x.target) for x in r.references} == {("links_to", "../y.md"), ("wikilink", "Z")}
    r = parsers.parse("a/b.py", b"import os\nfrom .u import f\nX = 1\n@d\ndef g():\n    return 1\n\nclass C:\n    pass\n")
    assert [p.chapter_title for p in r.passages] == ["module", "g", "C"] and {"os", "a.u", "a.u.f"} == {x.target for x in r.references}
    assert texts("a.py", b"def broken(:\n x") == ["def broken(:\n x"]
    assert texts("x.sh", b"A=1\nfoo() {\n echo ${x}\n}\nbar\n") == ["A=1\nbar", "foo() {\n echo ${x}\n}"]
    assert texts("x.rtf", rb"{\rtf1{\fonttbl{\f0 A;}}\f0 Bonjour \'e9t\'e9 long paragraph.\par Next paragraph of text.}") == ["Bonjour été long paragraph.\n\nNext paragraph of text."]
    r = parsers.parse("x.tex", rb"\title{T}\section{A}Text of A. \cite{k1,k2}\input{b} % \input{c}")
    assert r.title == "T" and {x.target for x in r.references} == {"b.tex", "k1", "k2"}
    long = "word " * 3000
    assert "".join("".join(texts("x.txt", long.encode())).split()) == "".join(long.split())
    assert texts("x.txt", b"") == [] and parsers.parse("x.bin", b"\0\1").skipped == "binary"
    assert "�" in texts("x.txt", b"caf\xe9 and more")[0]


def test_data_parsers(tmp_path):
    assert texts("x.csv", b"a;b\n1;x\n2;y;z\n") == ["table x: 2 rows\n- a (int)\n- b (text)", "columns: a | b\na=1 | b=x\na=2 | b=y | extra_3=z"]
    rows = "\n".join(f"{i},{'v' * 50}" for i in range(500))
    got = texts("x.csv", f"id,v\n{rows}".encode())
    assert sum(x.count("id=") for x in got) == 500 and max(map(len, got)) <= 4000
    assert texts("x.json", b"{bad") == [] and texts("x.toml", b"= 1") == []
    assert texts("x.json", b'{"a": 1, "b": [2]}') == ['"a": 1\n"b": [\n  2\n]']
    from quire.sources.parsers.data import MAPPINGS, Mapping

    MAPPINGS.append(Mapping("m", schema="urn:m", chunks=({"foreach": "items.list", "title": "{{name}}", "content": "{{body.text}} of {{top}}"},), edges=({"relation": "cites", "foreach": "refs", "target": "{{id}}"},)))
    try:
        r = parsers.parse("x.json", b'{"$schema": "urn:m", "top": "T", "items": {"list": [{"name": "n", "body": {"text": "t"}}]}, "refs": [{"id": "r1"}, {}]}')
    finally:
        MAPPINGS.pop()
    assert [(p.content, p.chapter_title) for p in r.passages] == [("t of T", "n")] and [x.target for x in r.references] == ["r1"]
    assert {x.target for x in parsers.parse("p.toml", b'[project]\ndependencies = ["numpy>1", "pyspark"]\n').references} == {"numpy", "pyspark"}
    db = sqlite3.connect(tmp_path / "d.db")
    db.executescript("CREATE TABLE a(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE b(a_id REFERENCES a(id)); INSERT INTO a VALUES (1, 'x'); CREATE VIEW w AS SELECT 1;")
    db.close()
    r = parsers.parse("d.db", (tmp_path / "d.db").read_bytes())
    assert any("id=1 | v=x" in p.content for p in r.passages) and [(x.relation, x.target) for x in r.references] == [("fk", "a")]
    assert [t[:4] for t in texts("n.ipynb", b'{"cells": [{"cell_type": "markdown", "source": ["# H\\n", "t"]}, {"cell_type": "code", "source": "x = 1", "outputs": [1]}]}')] == ["# H\n"]
    assert texts("y.yaml", b"a: 1\nb:\n  - 2\n") == ["a: 1\n\nb:\n  - 2"]


def zipped(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in names.items():
            z.writestr(n.replace("__", "/").replace("_DOT_", "."), c)
    return out.getvalue()


def test_document_parsers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = zipped(word__document_DOT_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text.</w:t></w:r></w:p></w:body></w:document>')
    assert [(p.content, p.chapter_title) for p in parsers.parse("x.docx", doc).passages] == [("Body text.", "Head")] and parsers.real_format(doc) == "docx"
    page = "<html><body><h1>One</h1><p>A paragraph of some length.</p></body></html>"
    epub = zipped(META_INF="", a_DOT_xhtml=page)
    assert texts("x.epub", epub) == ["A paragraph of some length."] and parsers.parse("x.epub", epub).passages[0].metadata == {"source_status": "incomplete"}
    legal = "<CODE><META><TITRE>CGI</TITRE></META><SECTION_TA><TITRE_TA>Livre I</TITRE_TA><ARTICLE><NUM>39 bis</NUM><DATE_DEBUT>2020-01-01</DATE_DEBUT><DATE_FIN/><CONTENU><p>Texte.</p></CONTENU></ARTICLE></SECTION_TA></CODE>"
    p = parsers.parse("x.xml", legal.encode()).passages[0]
    assert (p.content, p.chapter_title) == ("Texte.", "Livre I") and p.metadata == {"etat": "VIGUEUR", "article_ref": "CGI-39-bis", "num": "39 bis", "date_debut": "2020-01-01"}
    h = parsers.parse("x.html", b"<title>BOI-IS-10</title><nav>menu</nav><h1>H</h1><p>Selon l'article L. 12-3 bis du code, une phrase.</p><a href='y.html#z'>l</a>")
    assert h.passages[0].metadata == {"articles": "L. 12-3 bis", "boi": "BOI-IS-10", "boi_series": "IS"} and [x.target for x in h.references] == ["y.html"]
    assert texts("x.fb2", b"<FictionBook><body><section><title><p>T</p></title><p>Some text here.</p><section><p>Inner text here.</p></section></section></body></FictionBook>") == ["Some text here.", "Inner text here."]
    track = b"\x00\xff\x03\x05Piano\x00\xff\x05\x03la \x00\x90\x3c\x40\x60\x80\x3c\x00\x00\xff\x2f\x00"
    got = texts("x.mid", b"MThd\x00\x00\x00\x06\x00\x00\x00\x01\x00\x60MTrk" + len(track).to_bytes(4, "big") + track)
    assert got[1] == "Piano\nla \nnotes 60 to 60, 1 in all"
    with pytest.raises(parsers.Unreadable):
        parsers.parse("x.pdf", b"%PDF-1.4")


def test_ignore_rules():
    rules = [*files.ignore_rules("", "*.log\n/build\n!keep.log\ndocs/\n# note\n"), *files.ignore_rules("sub", "*.md\n!a.md\nx/**/y.txt")]
    hit = lambda p: files.ignored(p, rules)
    assert hit("a.log") and hit("build") and hit("build/x") and not hit("sub/build/z") and not hit("keep.log") and hit("docs/keep.log")
    assert hit("sub/b.md") and not hit("sub/a.md") and not hit("b.md") and hit("sub/x/q/y.txt")
    assert files.sections("*.tmp\n[versions]\nbig/*\n[other]\nz") == {"index": ["*.tmp"], "versions": ["big/*"]}


def test_snapshot_diff(spark):
    ddl = "corpus string, filepath string, file_hash string"
    old = spark.createDataFrame([("a", "same", "1"), ("a", "mod", "2"), ("a", "gone", "3"), ("a", "m1", "4"), ("a", "m2", "4"), ("b", "x", "5"), ("a", "n", None)], ddl)
    new = spark.createDataFrame([("a", "same", "1"), ("a", "mod", "9"), ("a", "p1", "4"), ("a", "p2", "4"), ("a", "p3", "4"), ("c", "x", "5"), ("a", "new", "7"), ("a", "bad", "8"), ("a", "n", None)], ddl)
    bad = spark.createDataFrame([("a", "bad", "8")], ddl)
    got = {(r.change, r.corpus, r.filepath, r.from_path) for r in sync.snapshot_diff(old, new, bad).collect()}
    assert got == {
        ("unchanged", "a", "same", None), ("modified", "a", "mod", None), ("removed", "a", "gone", None), ("moved", "a", "p1", "m1"), ("moved", "a", "p2", "m2"), ("added", "a", "p3", None),
        ("cross_moved", "c", "x", "x"), ("added", "a", "new", None), ("known_failure", "a", "bad", None), ("unchanged", "a", "n", None),
    }
    assert sync.snapshot_diff(old.limit(0), new.limit(0)).count() == 0
    roots = spark.createDataFrame([("a", "/r1", True), ("a", "/r2", False), ("b", "/r3", True)], "corpus string, root_path string, readable boolean")
    gone = spark.createDataFrame([("a", "x"), ("a", "t/node_modules/y"), ("b", "z")], "corpus string, filepath string")
    assert {r.filepath for r in sync.confirmed_removals(gone, roots, "node_modules").collect()} == {"t/node_modules/y", "z"}


def test_links(spark):
    books = spark.createDataFrame([("c", "a/x.md", "ax"), ("c", "b/x.md", "bx"), ("c", "a/sub/y.md", "ay"), ("c", "m/n.py", "mn"), ("c", "m/__init__.py", "m")], "corpus string, filename string, slug string")
    cand = spark.createDataFrame(
        [("ay", "a/sub/y.md", "c", "wikilink", "X"), ("ay", "a/sub/y.md", "c", "links_to", "../../b/x.md#z"), ("ay", "a/sub/y.md", "c", "links_to", "../../../out.md"), ("ax", "a/x.md", "c", "imports", "m.n"), ("ax", "a/x.md", "c", "imports", "m"), ("ax", "a/x.md", "c", "links_to", "x.md")],
        "src_slug string, src_path string, corpus string, relation_type string, target_ref string",
    )
    assert {(r.src_slug, r.dst_slug, r.relation_type) for r in graph.resolve_links(cand, books).collect()} == {("ay", "ax", "wikilink"), ("ay", "bx", "links_to"), ("ax", "mn", "imports"), ("ax", "m", "imports")}


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x", "r"), (2, "y", None)], "k int, v string, root string")
    b = spark.createDataFrame([(1, None, None), (3, "z", "q")], "k int, v string, root string")
    assert {tuple(r) for r in catalog.upsert(a, b, ["k"], ["root"]).collect()} == {(1, None, "r"), (2, "y", None), (3, "z", "q")}


def test_library_follows_a_folder(spark, tmp_path):
    root, lib = tmp_path / "src", Library(spark, f"file://{tmp_path}/lib")
    (root / "d").mkdir(parents=True)
    (root / "a.md").write_text("# A\nA first paragraph that is long.\n[b](d/b.md)\n")
    (root / "d" / "b.md").write_text("# B\nA second paragraph that is long.\n")
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "empty.txt").write_text("\n")
    at = f"file://{root}"
    assert lib.sync(at, "c", "2024-01-01") == {"added": 4}
    assert {r.book_slug for r in lib.chunks.read().collect()} == {"c--a-md", "c-d--b-md"}
    assert [(r.src_slug, r.dst_slug) for r in lib.edges.read().collect()] == [("c--a-md", "c-d--b-md")]
    assert lib.sync(at, "c", "2024-01-02") == {"unchanged": 3, "known_failure": 1}
    (root / "d" / "b.md").rename(root / "moved.md")
    (root / "a.md").write_text("# A\nQuite another paragraph, long too.\n")
    (root / "empty.txt").unlink()
    assert {r["change"] for r in lib.plan(at, "c").collect()} >= {"moved", "modified", "removed"}
    got = lib.sync(at, "c", "2024-01-03")
    assert got["moved"] == 1 and got["modified"] == 1 and got["removed"] == 1
    chunks = {r.chunk_id: r.content for r in lib.chunks.read().collect()}
    assert chunks == {"c--a-md:00001": "Quite another paragraph, long too.", "c--moved-md:00001": "A second paragraph that is long."}
    assert lib.edges.read().count() == 0 and lib.files.read().count() == 3
    assert lib.save_snapshot("2024-01-04").count() == 2


def test_streams_as_batches(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    polls = [("a", t(i * 10), c) for i, c in enumerate([False, False, True, False, False, False])] + [("b", t(i * 7), False) for i in range(9)]
    ddl = "source string, at timestamp, changed boolean"
    want = {tuple(r) for r in streams.poll_plan_batch(spark.createDataFrame(polls, ddl), 60.0, 600.0).collect()}
    for part in range(3):
        spark.createDataFrame(polls[part * 5 : part * 5 + 5], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    got = []
    streams.each_batch(streams.poll_plan(src, 60.0, 600.0), lambda df, n: got.extend(tuple(r) for r in df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert set(got) == want
    events = spark.createDataFrame([("k", t(s)) for s in (0, 2, 4, 20, 21, 400)], "key string, at timestamp")
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    out = []
    ev = spark.readStream.schema("key string, at timestamp").parquet(f"{tmp_path}/ev")
    streams.each_batch(streams.debounced(ev, "key", "at", "5 seconds", "10 seconds"), lambda df, n: out.extend((r.start, r.changes) for r in df.collect()), f"{tmp_path}/cp2").awaitTermination()
    assert sorted(out) == [(t(0), 3), (t(20), 2)]
    later = streams.settled(spark.createDataFrame([("x", t(0)), ("y", t(9))], "path string, modificationTime timestamp"), F.lit(t(10)))
    assert [r.path for r in later.collect()] == ["x"]


def test_many_midi_tracks_and_long_lyrics():
    event = lambda kind, body: b"\0\xff" + bytes([kind, len(body)]) + body
    track = lambda body: b"MTrk" + struct.pack(">I", len(body) + 4) + body + b"\0\xff\x2f\0"
    song = b"MThd" + struct.pack(">IHHH", 6, 1, 5000, 480) + b"".join(track(event(3, b"part %d" % i)) for i in range(5000))
    assert len(parsers.parse("x.mid", song).passages) == 5001
    words = "la mer " * 20_000
    said = [f"LYRICS={words}".encode()]
    comments = struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", len(said[0])) + said[0]
    flac = b"fLaC" + b"\x01" + (2 << 20).to_bytes(3, "big") + b"\0" * (2 << 20) + b"\x84" + len(comments).to_bytes(3, "big") + comments
    assert parsers.parse("x.flac", flac).passages[-1].content == words.strip()
    head = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + b"\0" * 14
    packets = [head, b"\x03vorbis" + comments]
    ogg = b""
    for body in packets:
        sizes = [255] * (len(body) // 255) + [len(body) % 255]
        for k in range(0, len(sizes), 255):
            part = sizes[k : k + 255]
            ogg += b"OggS" + b"\0" * 22 + bytes([len(part)]) + bytes(part) + body[k * 255 : k * 255 + sum(part)]
    got = parsers.parse("x.ogg", ogg).passages
    assert got[-1].content == words.strip() and "44.1 kHz, 2 channels" in got[0].content


def test_damaged_page_files():
    from quire.plans.parser_queries import files as fixed

    for name in ("pdf", "mobi", "djvu"):
        path, content = fixed()[name]
        for cut in (0, 10, 70, len(content) // 2, len(content) - 30):
            try:
                parsers.parse(path, content[:cut])
            except parsers.Unreadable:
                pass
    with pytest.raises(parsers.Unreadable):
        parsers.parse("x.pdf", fixed()["pdf"][1].replace(b"/Root 1 0 R", b"/Encrypt 1 0 R"))


def test_registered_parsers(monkeypatch):
    monkeypatch.setattr(parsers, "REGISTERED", [])
    monkeypatch.setattr(parsers, "BY_ENDING", dict(parsers.BY_ENDING))
    one, two = (lambda path, content, n=n: parsers.Parsed([parsers.Passage(n)]) for n in ("one", "two"))
    parsers.register(one, (".md", ".zz"))
    parsers.register(two, (".zz",))
    assert texts("a.md", b"x") == ["one"] and texts("a.zz", b"x") == ["two"]
    parsers.register(two, matches=lambda path, content: content.startswith(b"!"))
    assert texts("a.md", b"!x") == ["two"] and texts("a.md", b"x") == ["one"]


def test_exclusions_payloads_and_memories(spark):
    df = spark.createDataFrame([(p,) for p in ("a/.claude/worktrees/x.py", ".claude/x.md", "b/.ruff_cache/x", "b/db/x.md", "b/x.db-wal", "b/x.py")], "path string")
    assert {r.path for r in df.filter(~files.excluded(F.col("path"))).collect()} == {".claude/x.md", "b/x.py"}
    assert files.scan_payloads([{"path": "a", "corpus": "x", "recursive": True, "include": []}, {"corpus": "x", "path": "a"}, {"path": "b", "honor_ignore": False, "endings": [".py", ".md"]}]) == [{"corpus": "x", "path": "a"}, {"endings": [".md", ".py"], "honor_ignore": False, "path": "b"}]
    listed = spark.createDataFrame([("p", "/m/p", "/real/p"), ("q", "/m/q", "/real/p"), ("r", "/m/r", "/real/r")], "project string, path string, real_path string")
    assert {tuple(r) for r in files.memory_sources(listed).collect()} == {("memory-p", "/m/p"), ("memory-r", "/m/r")}
    assert not files.history_is_wanted("a/x.mbox", "x\n[versions]\n*.mbox\n") and files.history_is_wanted("x", "x\n[versions]\n*.mbox\n")


def test_deep_folders_decide_wikilinks(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    books = spark.createDataFrame([("c", f"{deep}/note.md", "near"), ("c", "d0/note.md", "far"), ("c", "x/y/other.md", "o")], "corpus string, filename string, slug string")
    cand = spark.createDataFrame([("s", f"{deep}/src.md", "c", "wikilink", "note"), ("t", "z.md", "c", "wikilink", "y/Other"), ("u", "z.md", "c", "wikilink", "z/Other")], "src_slug string, src_path string, corpus string, relation_type string, target_ref string")
    assert {(r.src_slug, r.dst_slug) for r in graph.resolve_links(cand, books).collect()} == {("s", "near"), ("t", "o")}
