"""YAML, JSON with declared mappings, TOML, CSV, spreadsheets and SQLite files."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sqlite3
import tempfile
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field

from quire.sources.parsers.model import Parsed, Passage, Reference, Unreadable, blocks, decoded, stem

#: Characters of a passage of rows, and rows by which the type of a column is told.
ROWS_CHARS, SAMPLE = 4000, 50


def _passages(parts: list[str], title: str | None = None, **meta: str) -> list[Passage]:
    return [Passage(x, title, None, 1, None, i, metadata=dict(meta)) for i, x in enumerate(parts, 1)]


def yaml(path: str, content: bytes) -> Parsed:
    """Blocks at top-level keys, by their text."""
    parts: list[list[str]] = [[]]
    for line in decoded(content).split("\n"):
        if re.match(r"[^\s#\-][^:]*:", line) and parts[-1]:
            parts.append([])
        parts[-1].append(line)
    own = ["\n".join(x).strip("\n") for x in parts]
    return Parsed(_passages(blocks([x for x in own if x.strip()], 800, 2000, "\n\n", 100)), title=stem(path))


@dataclass(frozen=True)
class Mapping:
    """How JSON of a kind becomes passages and references. schema: what its `$schema` or `$id` says, or discriminator: values at its top. chunks: dicts with title, content (templates with
    {{dotted.path}}), foreach (a path to a list) and metadata; edges: dicts with relation, foreach, target."""

    name: str
    schema: str | None = None
    discriminator: dict[str, str] = field(default_factory=dict)
    chunks: tuple[dict, ...] = ()
    edges: tuple[dict, ...] = ()

    def fits(self, doc: object) -> bool:
        if not isinstance(doc, dict):
            return False
        if self.schema and self.schema in (doc.get("$schema"), doc.get("$id")):
            return True
        return bool(self.discriminator) and all(doc.get(k) == v for k, v in self.discriminator.items())


MAPPINGS: list[Mapping] = []


def at_path(doc: object, path: str) -> object:
    """A value by dotted keys and list positions; None where there is none."""
    for key in path.split(".") if path else []:
        if isinstance(doc, list) and key.lstrip("-").isdigit():
            doc = doc[int(key)] if -len(doc) <= int(key) < len(doc) else None
        elif isinstance(doc, dict):
            doc = doc.get(key)
        else:
            return None
    return doc


def filled(template: str, item: object, doc: object) -> str:
    def value(m: re.Match[str]) -> str:
        v = at_path(item, m[1])
        v = at_path(doc, m[1]) if v is None else v
        return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return re.sub(r"\{\{\s*([\w$.@-]+)\s*\}\}", value, template)


def mapped(mapping: Mapping, doc: object, path: str) -> Parsed:
    p = Parsed(title=stem(path))
    each = lambda spec: (x if isinstance(x := at_path(doc, spec["foreach"]), list) else []) if spec.get("foreach") else [doc]
    for spec in mapping.chunks:
        for item in each(spec):
            meta = {k: filled(v, item, doc) for k, v in spec.get("metadata", {}).items()}
            p.passages.append(Passage(filled(spec["content"], item, doc), filled(spec.get("title", ""), item, doc) or None, None, 1, None, len(p.passages) + 1, metadata={"mapping": mapping.name, **meta}))
    for spec in mapping.edges:
        p.references += [Reference(spec["relation"], t) for item in each(spec) if (t := filled(spec["target"], item, doc))]
    return p


def json_(path: str, content: bytes) -> Parsed:
    """By a mapping that fits; else an object by its keys, a list by its items, a scalar whole. Invalid JSON has no passages."""
    try:
        doc = json.loads(decoded(content))
    except ValueError:
        return Parsed(title=stem(path))
    for m in MAPPINGS:
        if m.fits(doc):
            return mapped(m, doc, path)
    text = lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    parts = [f"{json.dumps(k, ensure_ascii=False)}: {text(v)}" for k, v in doc.items()] if isinstance(doc, dict) else [text(x) for x in doc] if isinstance(doc, list) else [text(doc)]
    return Parsed(_passages(blocks(parts, 800, 2000, "\n", 100 if isinstance(doc, list) else 0)), title=stem(path))


def toml(path: str, content: bytes) -> Parsed:
    """Blocks by top-level tables; dependencies of known manifests are references. Invalid TOML has no passages."""
    try:
        doc = tomllib.loads(decoded(content))
    except tomllib.TOMLDecodeError:
        return Parsed(title=stem(path))

    def written(prefix: str, t: dict) -> str:
        out = [f"[{prefix}]"] if prefix else []
        out += [f"{k} = {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in t.items() if not isinstance(v, dict)]
        return "\n".join(out + [written(f"{prefix}.{k}" if prefix else k, v) for k, v in t.items() if isinstance(v, dict)])

    loose = {k: v for k, v in doc.items() if not isinstance(v, dict)}
    parts = ([written("", loose)] if loose else []) + [written(k, v) for k, v in doc.items() if isinstance(v, dict)]
    p = Parsed(_passages(blocks(parts, 1200, 3000, "\n\n")), title=stem(path))
    listed = [*(at_path(doc, "project.dependencies") or []), *(at_path(doc, "build-system.requires") or []), *(x for v in (at_path(doc, "project.optional-dependencies") or {}).values() for x in v)]
    named = [k for t in ("tool.poetry.dependencies", "tool.poetry.dev-dependencies", "dependencies", "dev-dependencies", "build-dependencies") for k in (at_path(doc, t) or {}) if k != "python"]
    p.references += [Reference("depends_on", m[0]) for x in listed if isinstance(x, str) and (m := re.match(r"[\w.-]+", x))] + [Reference("depends_on", k) for k in named]
    return p


def column_type(values: list[str]) -> str:
    """empty, bool, int, float or text, of the first rows; a mix of bool and int is int."""
    own = [v.strip() for v in values if v is not None and v.strip()]
    if not own:
        return "empty"
    is_bool = lambda v: v.lower() in ("true", "false", "yes", "no")
    is_int = lambda v: re.fullmatch(r"[+-]?\d+", v) is not None
    if all(map(is_bool, own)):
        return "bool"
    if all(is_bool(v) or is_int(v) for v in own):
        return "int"
    if all(re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", v) for v in own):
        return "float"
    return "text"


def table_passages(name: str, header: list[str], rows: list[list[str]], unit: str = "table") -> list[Passage]:
    """An overview with column types, then all rows as `column=value`, none cut in two unless it alone is too long; surplus cells are kept."""
    kinds = [column_type([r[i] for r in rows[:SAMPLE] if i < len(r)]) for i in range(len(header))]
    out = [Passage(f"{unit} {name}: {len(rows)} rows\n" + "\n".join(f"- {h} ({k})" for h, k in zip(header, kinds, strict=True)), name, None, 1, None, 1, metadata={"kind": "schema"})]
    head = "columns: " + " | ".join(header)
    lines = [" | ".join(f"{header[i] if i < len(header) else f'extra_{i + 1}'}={v}" for i, v in enumerate(r)) for r in rows]
    run, first = "", 1
    for n, line in enumerate(lines, 1):
        if run and len(head) + len(run) + len(line) + 2 > ROWS_CHARS:
            out.append(Passage(f"{head}\n{run}", name, None, 1, None, len(out) + 1, metadata={"kind": "rows", "first_row": str(first), "last_row": str(n - 1)}))
            run, first = "", n
        run = f"{run}\n{line}" if run else line
    if run:
        out.append(Passage(f"{head}\n{run}", name, None, 1, None, len(out) + 1, metadata={"kind": "rows", "first_row": str(first), "last_row": str(len(lines))}))
    return out


def csv_(path: str, content: bytes) -> Parsed:
    s = decoded(content)
    if not s.strip():
        return Parsed(title=stem(path))
    head = s[:8192].split("\n")[:20]
    # of the usual separators the one that cuts most lines, then most often
    best = max("\t;|,", key=lambda c: (sum(c in x for x in head), head[0].count(c), c == ("\t" if path.lower().endswith(".tsv") else ",")))
    rows = [r for r in csv.reader(io.StringIO(s), delimiter=best) if r]
    return Parsed(table_passages(stem(path), rows[0], rows[1:]), title=stem(path))


def xlsx(path: str, content: bytes) -> Parsed:
    """Sheets of a workbook: an overview, then each sheet's columns and rows."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise Unreadable("not a workbook") from e
    shared = ["".join(t.text or "" for t in si.iter(main + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    p = Parsed(title=stem(path))
    names = []
    for sheet in book.iter(main + "sheet"):
        target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
        rows = []
        for row in root.iter(main + "row"):
            cells: dict[int, str] = {}
            for c in row.iter(main + "c"):
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                v = c.find(main + "v")
                text = "".join(t.text or "" for t in c.iter(main + "t")) if c.get("t") == "inlineStr" else v.text if v is not None else ""
                cells[(column or len(cells) + 1) - 1] = shared[int(text)] if c.get("t") == "s" and text else text or ""
            if cells:
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        names.append(f"{sheet.get('name')} ({max(0, len(rows) - 1)} rows)")
        if rows:
            p.passages += table_passages(sheet.get("name"), rows[0], rows[1:], "sheet")
    p.passages.insert(0, Passage(f"workbook {stem(path)}: " + ", ".join(names), None, None, 1, None, 1, metadata={"kind": "overview"}))
    return p


def sqlite(path: str, content: bytes) -> Parsed:
    """Tables, their columns and all rows; views and triggers by their SQL; foreign keys are references."""
    with tempfile.NamedTemporaryFile(suffix=".db") as f:  # read at once and gone: no state of the job
        f.write(content)
        f.flush()
        try:
            db = sqlite3.connect(f"file:{os.path.abspath(f.name)}?mode=ro&immutable=1", uri=True)
            known = db.execute("SELECT type, name, sql FROM sqlite_master ORDER BY type, name").fetchall()
        except sqlite3.DatabaseError as e:
            raise Unreadable("not a database") from e
        virtual = {n for _, n, q in known if q and re.match(r"\s*CREATE\s+VIRTUAL", q, re.I)}
        shadow = {f"{v}_{x}" for v in virtual for x in ("data", "idx", "content", "docsize", "config", "node", "rowid", "parent")}
        own = [(t, n, q) for t, n, q in known if not n.startswith("sqlite_") and n not in shadow]
        tables = [n for t, n, _ in own if t == "table"]
        p = Parsed([Passage(f"database {stem(path)}: " + ", ".join(tables), None, None, 1, None, 1, metadata={"kind": "overview"})], title=stem(path))
        for name in tables:
            quoted = '"' + name.replace('"', '""') + '"'
            header = [c[1] for c in db.execute(f"PRAGMA table_info({quoted})")]
            rows = [["" if v is None else f"<{len(v)} bytes>" if isinstance(v, bytes) else str(v) for v in r] for r in db.execute(f"SELECT * FROM {quoted}")] if name not in virtual else []
            p.passages += table_passages(name, header, rows)
            p.references += [Reference("fk", r[2], f"{name}.{r[3]}") for r in db.execute(f"PRAGMA foreign_key_list({quoted})")]
        p.passages += [Passage(q, n, None, 1, None, len(p.passages) + 1, metadata={"kind": t}) for t, n, q in own if t in ("view", "trigger") and q]
        db.close()
    return p
