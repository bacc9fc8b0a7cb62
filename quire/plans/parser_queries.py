"""Queries of the parsers on fixed files, and what they must give. The files are written out here, or put together from parts; expected passages are plain values."""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import reference_queries as ref
from quire.sources import parsers

#: Every date in an archive, so that its bytes are the same each time.
_DAY = (2020, 1, 1, 0, 0, 0)


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name.replace("__", "/").replace("_DOT_", "."), _DAY), text)
    return out.getvalue()


def _pdf() -> bytes:
    def stream(n: int, extra: str, body: bytes) -> bytes:
        packed = zlib.compress(body)
        return f"{n} 0 obj\n<< {extra} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"

    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0004> <00e9> endbfchar"
    inside = b"7 0 8 70 << /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>".ljust(80) + b"<< /Type /Font /Subtype /Type1 >>"
    first = inside.index(b"<<")
    inside = b"7 0 8 %d " % (inside.rindex(b"<< /Type /Font /Subtype /Type1") - first) + inside[first:]
    return (
        b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>\nendobj\n"
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>\nendobj\n4 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n5 0 obj\n<< /Type /Page /Parent 2 0 R /Contents [11 0 R] >>\nendobj\n"
        + stream(6, f"/Type /ObjStm /N 2 /First {inside.index(b'<<')}", inside)
        + stream(9, "", cmap)
        + stream(10, "", b"BT /F2 12 Tf 72 700 Td (The registry holds) Tj 0 -14 Td [(every d) -20 (eed of) -300 (the town \\(old\\).)] TJ ET")
        + stream(11, "", b"BT /F1 12 Tf <000100020003> Tj 0 -14 Td <0004> Tj /F2 9 Tf 0 -14 Td (A last page with text of its own.) Tj ET")
        + b"trailer << /Root 1 0 R >>\n%%EOF"
    )


def _mobi() -> bytes:
    html = "<html><body><h1>Le bail</h1><p>Le registre du fonds rural est tenu.</p>dehors<ul><li>premier point de la liste</li></ul></body></html>".encode()
    packed = html[:20] + b"".join(bytes([c]) for c in html[20:])
    head = struct.pack(">HHIHHHH", 2, 0, len(html), 1, 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001)
    head = head.ljust(248, b"\0")
    start = 78 + 16 + 2
    return b"book".ljust(60, b"\0") + b"BOOKMOBI" + struct.pack(">II", 0, 0) + struct.pack(">H", 2) + struct.pack(">IIII", start, 0, start + len(head), 0) + b"\0\0" + head + packed


def _djvu() -> bytes:
    chunk = lambda kind, body: kind + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    text = lambda s: chunk(b"FORM", b"DJVU" + chunk(b"TXTa", len(s.encode()).to_bytes(3, "big") + s.encode() + b"\1"))
    return b"AT&T" + chunk(b"FORM", b"DJVM" + text("La première page du registre.") + text("  ") + text("La page après une page vide."))


def _midi() -> bytes:
    event = lambda kind, body: b"\0\xff" + bytes([kind, len(body)]) + body
    track = lambda body: b"MTrk" + struct.pack(">I", len(body) + 4) + body + b"\0\xff\x2f\0"
    first = event(3, b"Suite") + event(0x51, (500_000).to_bytes(3, "big")) + event(0x58, bytes([3, 2, 24, 8])) + event(0x59, bytes([1, 0]))
    second = event(3, b"Voix") + b"\0\xc0\x28" + event(5, b"/La ") + event(5, b"mer") + b"\0\x90\x3c\x40\x83\x60\x80\x3c\x40"
    return b"MThd" + struct.pack(">IHHH", 6, 1, 2, 480) + track(first) + track(second)


def _flac() -> bytes:
    said = [b"TITLE=Chanson", b"ARTIST=Une voix", b"ARTIST=Deux voix", b"LYRICS=" + b"La mer. " * 4]
    comments = struct.pack("<I", 1) + b"x" + struct.pack("<I", len(said)) + b"".join(struct.pack("<I", len(x)) + x for x in said)
    info = b"\0" * 10 + (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(comments).to_bytes(3, "big") + comments


def _sqlite() -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE town (name TEXT, people INT)")
    db.executemany("INSERT INTO town VALUES (?, ?)", [("Lyon", 500), ("Nantes", 300)])
    return db.serialize()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def files() -> dict[str, tuple[str, bytes]]:
    """A file for each parser."""
    return {
        "markdown": ("guide.md", b"---\ntitle: Guide\n---\n# Le bail rural\n\nLe bail rural est tenu au registre du fonds.\n\n## Suite\n\nVoir [la taxe](taxe.md) et [[registre]].\n"),
        "latex": ("note.tex", b"\\title{Note}\\begin{document}\\section{Objet}Le registre du fonds est tenu. \\cite{k1}\\subsection{Suite}La taxe est due.\\end{document}"),
        "rtf": ("lettre.rtf", b"{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}Le bail d\\'e9cid\\'e9 hier est clos.\\par Une autre ligne de la lettre.}"),
        "plain": ("notes.txt", b"premiere ligne\nseconde ligne\n\ntroisieme ligne\n"),
        "lossy": ("casse.txt", b"un texte avec un octet \xff perdu en route\n"),
        "python": ("module.py", b'"""Doc."""\nimport os\n\n\ndef load(path):\n    return os.stat(path)\n\n\nclass Cache:\n    def get(self):\n        return 1\n'),
        "shell": ("run.sh", b"#!/bin/sh\n. ./env.sh\nbuild() {\n  make all\n}\nbuild\n"),
        "notebook": ("a.ipynb", b'{"cells": [{"cell_type": "markdown", "source": ["# Title\\n", "Some words."]}, {"cell_type": "code", "source": "x = 1", "outputs": []}], "metadata": {}, "nbformat": 4}'),
        "yaml": ("conf.yaml", b"name: quire\nparts:\n  - one\n  - two\n"),
        "json": ("data.json", b'{"name": "quire", "parts": [{"id": 1, "text": "one"}, {"id": 2, "text": "two"}]}'),
        "toml": ("conf.toml", b"[tool]\nname = 'quire'\n[tool.sub]\nx = 1\n"),
        "csv": ("towns.csv", b"name,people\nLyon,500\nNantes,300\nParis\n"),
        "xlsx": ("towns.xlsx", _zip(**{"xl__workbook_DOT_xml": f'<workbook {_X} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Towns" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl__worksheets__sheet1_DOT_xml": f'<worksheet {_X}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>people</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Lyon</t></is></c><c r="B2"><v>500</v></c></row></sheetData></worksheet>'})),
        "sqlite": ("towns.sqlite", _sqlite()),
        "legal_xml": ("code.xml", b"<CODE><META><TITRE>code civil</TITRE></META><SECTION_TA><TITRE_TA>Livre I</TITRE_TA><ARTICLE><NUM>39 decies A</NUM><DATE_DEBUT>2020-01-01</DATE_DEBUT><CONTENU><p>Le texte de l'article.</p></CONTENU></ARTICLE></SECTION_TA></CODE>"),
        "html": ("page.html", b"<html><head><title>Taxe</title></head><body><nav>menu</nav><h1>Objet</h1><p>La taxe de l'article 39 decies A est due.</p><h2>Suite</h2><p>Une seconde partie de la page.</p></body></html>"),
        "fb2": ("livre.fb2", b"<FictionBook><description><title-info><book-title>Livre</book-title></title-info></description><body><section><title><p>Un</p></title><p>Le premier texte du livre.</p><section><title><p>Deux</p></title><p>Le second texte du livre.</p></section></section></body></FictionBook>"),
        "epub": ("livre.epub", _zip(mimetype="application/epub+zip", **{"META-INF__container_DOT_xml": '<c xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>', "o__p_DOT_opf": '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="urn:dc"><metadata><dc:title>Livre</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "o__a_DOT_xhtml": "<html><body><h1>Fin</h1><p>La fin du livre est ici.</p></body></html>", "o__b_DOT_xhtml": "<html><body><h1>Debut</h1><p>Le debut du livre est ici.</p></body></html>"})),
        "docx": ("lettre.docx", _zip(word__document_DOT_xml=f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Objet</w:t></w:r></w:p><w:p><w:r><w:t>Le corps de la lettre.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')),
        "odt": ("note.odt", _zip(mimetype="application/vnd.oasis.opendocument.text", content_DOT_xml=f'<office:document-content {_O}><office:body><office:text><text:h text:outline-level="1">Objet</text:h><text:p>Le corps de la note.</text:p><text:list><text:list-item><text:p>un point</text:p></text:list-item></text:list></office:text></office:body></office:document-content>')),
        "pptx": ("expose.pptx", _zip(**{f"ppt__slides__slide{n}_DOT_xml": f"<p:sld xmlns:p='urn:p' {_A}><a:p><a:r><a:t>Titre {n}</a:t></a:r></a:p><a:p><a:r><a:t>point {n}</a:t></a:r></a:p></p:sld>" for n in (1, 2, 10)})),
        "pdf": ("acte.pdf", _pdf()),
        "mobi": ("livre.mobi", _mobi()),
        "djvu": ("scan.djvu", _djvu()),
        "midi": ("air.mid", _midi()),
        "audio": ("chanson.flac", _flac()),
        "empty": ("vide.md", b""),
        "binary": ("image.xyz", b"\0\1\2\3" * 10),
        "damaged": ("casse.docx", b"PK\3\4 not an archive"),
    }


#: What each file must give: how it went, and (ordinal, chapter title, first page, content) of its passages.
EXPECTED: dict[str, tuple[str, list[tuple[int, str | None, int, str]]]] = {
    "markdown": ("ok", [(0, 'Le bail rural', 1, 'Le bail rural est tenu au registre du fonds.'), (1, 'Suite', 1, 'Voir [la taxe](taxe.md) et [[registre]].')]),
    "latex": ("ok", [(0, 'Objet', 1, 'Le registre du fonds est tenu. \\cite{k1}'), (1, 'Suite', 1, 'La taxe est due.\\end{document}')]),
    "rtf": ("ok", [(0, 'lettre', 1, 'Le bail décidé hier est clos.\n\nUne autre ligne de la lettre.')]),
    "plain": ("ok", [(0, None, 1, 'premiere ligne\nseconde ligne\n\ntroisieme ligne\n')]),
    "lossy": ("ok", [(0, None, 1, 'un texte avec un octet � perdu en route\n')]),
    "python": ("ok", [(0, 'module', 1, '"""Doc."""\nimport os'), (1, 'load', 1, 'def load(path):\n    return os.stat(path)'), (2, 'Cache', 1, 'class Cache:\n    def get(self):\n        return 1')]),
    "shell": ("ok", [(0, 'global', 1, '#!/bin/sh\n. ./env.sh\nbuild'), (1, 'build', 1, 'build() {\n  make all\n}')]),
    "notebook": ("ok", [(0, 'Title', 1, '# Title\nSome words.\n\n```\nx = 1\n```')]),
    "yaml": ("ok", [(0, None, 1, 'name: quire\n\nparts:\n  - one\n  - two')]),
    "json": ("ok", [(0, None, 1, '"name": "quire"\n"parts": [\n  {\n    "id": 1,\n    "text": "one"\n  },\n  {\n    "id": 2,\n    "text": "two"\n  }\n]')]),
    "toml": ("ok", [(0, None, 1, '[tool]\nname = "quire"\n[tool.sub]\nx = 1')]),
    "csv": ("ok", [(0, 'towns', 1, 'table towns: 3 rows\n- name (text)\n- people (int)'), (1, 'towns', 1, 'columns: name | people\nname=Lyon | people=500\nname=Nantes | people=300\nname=Paris')]),
    "xlsx": ("ok", [(0, None, 1, 'workbook towns: Towns (1 rows)'), (1, 'Towns', 1, 'sheet Towns: 1 rows\n- name (text)\n- people (int)'), (2, 'Towns', 1, 'columns: name | people\nname=Lyon | people=500')]),
    "sqlite": ("ok", [(0, None, 1, 'database towns: town'), (1, 'town', 1, 'table town: 2 rows\n- name (text)\n- people (int)'), (2, 'town', 1, 'columns: name | people\nname=Lyon | people=500\nname=Nantes | people=300')]),
    "legal_xml": ("ok", [(0, 'Livre I', 1, "Le texte de l'article.")]),
    "html": ("ok", [(0, 'Objet', 1, "La taxe de l'article 39 decies A est due."), (1, 'Suite', 1, 'Une seconde partie de la page.')]),
    "fb2": ("ok", [(0, 'Un', 1, 'Le premier texte du livre.'), (1, 'Deux', 1, 'Le second texte du livre.')]),
    "epub": ("ok", [(0, 'Debut', 1, 'Le debut du livre est ici.'), (1, 'Fin', 2, 'La fin du livre est ici.')]),
    "docx": ("ok", [(0, 'Objet', 1, 'Le corps de la lettre.\n\na | b')]),
    "odt": ("ok", [(0, 'Objet', 1, 'Le corps de la note.\n\n- un point')]),
    "pptx": ("ok", [(0, 'Titre 1', 1, 'Titre 1\npoint 1'), (1, 'Titre 2', 2, 'Titre 2\npoint 2'), (2, 'Titre 10', 3, 'Titre 10\npoint 10')]),
    "pdf": ("ok", [(0, None, 1, 'The registry holds every deed of the town (old).'), (1, None, 3, 'ABC é A last page with text of its own.')]),
    "mobi": ("ok", [(0, None, 1, 'Le registre du fonds rural est tenu.\n\npremier point de la liste')]),
    "djvu": ("ok", [(0, None, 1, 'La première page du registre.'), (1, None, 2, 'La page après une page vide.')]),
    "midi": ("ok", [(0, None, 1, 'MIDI format 1, 2 tracks, 480 ticks a beat, tempo 120 to 120'), (1, 'Suite', 1, 'Suite'), (2, 'Voix', 1, 'Voix\n\nLa mer\nnotes 60 to 60, 1 in all')]),
    "audio": ("ok", [(0, None, 1, 'title: Chanson\nartist: Une voix / Deux voix\nformat: 44.1 kHz, 16-bit, 2 channels, 2 s'), (1, 'lyrics', 1, 'La mer. La mer. La mer. La mer.')]),
    "empty": ("ok", []),
    "binary": ("skipped", []),
    "damaged": ("failed", []),
}


def _query(name: str) -> ref.Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, content = files()[name]
        one = parsers.parsed(spark.createDataFrame([(path, "fixed", bytearray(content))], "path string, corpus string, content binary"))
        p = one.select("status", F.explode_outer("passages").alias("p"))
        return p.select("status", F.col("p.ordinal").alias("ordinal"), F.col("p.chapter_title").alias("title"), F.col("p.page_start").alias("page"), F.col("p.content").alias("content"))

    return run


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _sql(name: str) -> str:
    status, rows = EXPECTED[name]
    values = ", ".join("(" + ", ".join(_literal(v) for v in (status, *r)) + ")" for r in rows or [(None, None, None, None)])
    return f"SELECT CAST(status AS VARCHAR) AS status, CAST(ordinal AS INT) AS ordinal, CAST(title AS VARCHAR) AS title, CAST(page AS INT) AS page, CAST(content AS VARCHAR) AS content FROM (VALUES {values}) AS t(status, ordinal, title, page, content)"


QUERIES: dict[str, ref.Query] = {f"parse_{n}": _query(n) for n in EXPECTED}
SQL: dict[str, str] = {f"parse_{n}": _sql(n) for n in EXPECTED}
