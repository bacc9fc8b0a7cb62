"""Program code: Python by its syntax tree, shell by its functions, notebooks by their headings."""

from __future__ import annotations

import ast
import json
import re

from quire.sources.parsers import text
from quire.sources.parsers.model import MOST, Parsed, Passage, Reference, Unreadable, blocks, decoded, stem


def python(path: str, content: bytes) -> Parsed:
    """A passage for each class and function at the top, the code between them as `module`; imports are references. What does not parse is plain text."""
    s = decoded(content)
    try:
        tree = ast.parse(s)
    except (SyntaxError, ValueError, RecursionError):
        return text.plain(path, content)
    lines = s.split("\n")
    p = Parsed(title=stem(path))
    at = 1

    def between(a: int, z: int) -> None:
        own = "\n".join(lines[a - 1 : z]).strip("\n")
        if own.strip():
            p.passages.extend(Passage(x, "module", None, 1, None, i, a, z, {"kind": "module"}) for i, x in enumerate(blocks([own], MOST, MOST, "\n"), 1))

    for node in tree.body:
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            between(at, first - 1)
            own = "\n".join(lines[first - 1 : node.end_lineno])
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            p.passages.extend(Passage(x, node.name, None, 1, None, i, first, node.end_lineno, {"kind": kind}) for i, x in enumerate(blocks([own], MOST, MOST, "\n"), 1))
            at = node.end_lineno + 1
    between(at, len(lines))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            p.references += [Reference("imports", a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            folder = path.split("/")[:-1]
            base = ".".join([*folder[: len(folder) - node.level + 1], *([node.module] if node.module else [])]) if node.level else node.module or ""
            p.references += [Reference("imports", base, ",".join(a.name for a in node.names))] if base else []
            p.references += [Reference("imports", f"{base}.{a.name}") for a in node.names if base and a.name != "*"]
    return p


def shell(path: str, content: bytes) -> Parsed:
    """A passage for each function, by counting braces; the rest is `global`."""
    lines = decoded(content).split("\n")
    p = Parsed(title=stem(path))
    rest: list[tuple[int, str]] = []
    i = 0
    while i < len(lines):
        m = re.match(r"\s*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*(\{)?", lines[i])
        opens = m and (m[3] or (i + 1 < len(lines) and lines[i + 1].strip().startswith("{")))
        if not opens:
            rest.append((i + 1, lines[i]))
            i += 1
            continue
        depth, j = 0, i
        while j < len(lines):
            bare = re.sub(r"'[^']*'|\"(?:\\.|[^\"\\])*\"|\$\{[^}]*\}|(?:^|\s)#.*", "", lines[j])
            depth += bare.count("{") - bare.count("}")
            if depth <= 0 and (j > i or "{" in bare):
                break
            j += 1
        own = "\n".join(lines[i : j + 1])
        p.passages += [Passage(x, m[1] or m[2], None, 1, None, k, i + 1, min(j + 1, len(lines)), {"kind": "function"}) for k, x in enumerate(blocks([own], 2000, 2000, "\n"), 1)]
        i = j + 1
    own = "\n".join(x for _, x in rest).strip("\n")
    if own.strip():
        p.passages = [Passage(x, "global", None, 1, None, k, rest[0][0], rest[-1][0], {"kind": "global"}) for k, x in enumerate(blocks([own], 2000, 2000, "\n"), 1)] + p.passages
    return p


def notebook(path: str, content: bytes) -> Parsed:
    """Cells grouped by the headings of Markdown cells; outputs are dropped."""
    try:
        cells = json.loads(decoded(content)).get("cells", [])
    except (ValueError, AttributeError) as e:
        raise Unreadable("not a notebook") from e
    groups: list[tuple[str | None, list[str]]] = [(None, [])]
    for c in cells:
        own = c.get("source", "")
        own = own if isinstance(own, str) else "".join(own)
        if c.get("cell_type") == "markdown" and (m := re.match(r"#{1,6}\s+(.+)", own)):
            groups.append((m[1].strip(), []))
        groups[-1][1].append(f"```\n{own}\n```" if c.get("cell_type") == "code" else own)
    p = Parsed(title=next((t for t, _ in groups if t), stem(path)))
    for n, (title, parts) in enumerate(groups):
        p.passages += [Passage(x, title, n or None, 1, None, i) for i, x in enumerate(blocks([x for x in parts if x.strip()], 4000, 4000, "\n\n"), 1)]
    return p
