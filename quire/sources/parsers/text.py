"""Markdown, LaTeX, RTF and plain text."""

from __future__ import annotations

import re

from quire.sources.parsers.model import MOST, Parsed, Passage, Reference, decoded, merged, packed_lines, page_at, paragraphs, sentences, stem


def _sections(s: str, heading: re.Pattern[str]) -> list[tuple[str | None, int, str]]:
    """(title, position of the body, body) between headings; the pattern's group `title` names them."""
    marks = list(heading.finditer(s))
    out = [(None, 0, s[: marks[0].start()] if marks else s)]
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        out.append((m["title"].strip(), m.end(), s[m.end() : after.start() if after else len(s)]))
    return out


def markdown(path: str, content: bytes) -> Parsed:
    """Sections at `#` headings outside fences, paragraphs merged; links and wikilinks are references. A heading without text keeps its title as text."""
    s = decoded(content)
    p = Parsed(title=stem(path))
    meta = {}
    if m := re.match(r"---\n(.*?)\n---\s*(?:\n|$)", s, re.S):
        meta = dict(x.split(":", 1) for x in m[1].split("\n") if ":" in x and not x.startswith((" ", "-", "#")))
        meta = {k.strip(): v.strip().strip("'\"") for k, v in meta.items()}
        p.title = meta.get("title") or p.title
        s = re.sub(r"[^\n]", " ", s[: m.end()]) + s[m.end() :]
    masked = re.sub(r"^(```|~~~).*?^\1", lambda m: re.sub(r"[^\n]", "x", m[0]), s, flags=re.S | re.M)
    heads = list(re.finditer(r"^#{1,6}[ \t]+(.+?)[ \t#]*$", masked, re.M))
    bounds = [(None, 0), *((s[h.start(1) : h.end(1)].strip(), h.end()) for h in heads)]
    stops = [*(h.start() for h in heads), len(s)]
    for number, ((title, at), stop) in enumerate(zip(bounds, stops, strict=True)):
        body = s[at:stop]
        first = at + len(body) - len(body.lstrip())
        for i, part in enumerate(merged(paragraphs(body)) or ([title] if title else []), 1):
            p.passages.append(Passage(part, title, number or None, page_at(at), None, i, s.count("\n", 0, first) + 1, s.count("\n", 0, at + len(body.rstrip())) + 1, dict(meta)))
    if heads and "title" not in meta:
        p.title = bounds[1][0] or p.title
    bare = re.sub(r"^(```|~~~).*?^\1", "", s, flags=re.S | re.M)
    p.references += [Reference("links_to", m[2].split("#")[0], m[1]) for m in re.finditer(r"(?<!!)\[([^\]\n]*)\]\(([^()\s]+)[^()\n]*\)", bare) if not re.match(r"[a-z]+:|#|//", m[2], re.I)]
    p.references += [Reference("wikilink", m[1].split("|")[0].split("#")[0].strip(), m[1]) for m in re.finditer(r"\[\[([^\[\]\n]+)\]\]", bare)]
    return p


def latex(path: str, content: bytes) -> Parsed:
    """Sections at sectioning commands; the preamble counts from 200 characters on; includes and citations are references."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", decoded(content))
    p = Parsed(title=stem(path))
    if m := re.search(r"\\title\*?\{([^{}]*)\}", s):
        p.title = m[1].strip() or p.title
    author = re.search(r"\\author\{([^{}]*)\}", s)
    heading = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section)\*?(?:\[[^\]]*\])?\{(?P<title>[^{}]*)\}")
    for n, (title, at, body) in enumerate(_sections(s, heading)):
        own = body.strip()
        if title is None and len(own) < 200:
            continue
        for i, part in enumerate(sentences(own, MOST) or ([title] if title else []), 1):
            p.passages.append(Passage(part, title, n or None, page_at(at), None, i, metadata={"author": author[1]} if author else {}))
    p.references += [Reference("includes", m[1] if m[1].endswith(".tex") else m[1] + ".tex") for m in re.finditer(r"\\(?:input|include|subfile)\{([^{}]+)\}", s)]
    p.references += [Reference("cites", k.strip()) for m in re.finditer(r"\\cite\w*\*?(?:\[[^\]]*\]){0,2}\{([^{}]+)\}", s) for k in m[1].split(",")]
    return p


def rtf(path: str, content: bytes) -> Parsed:
    """Text of RTF without its control words; paragraphs at \\par."""
    s = content.decode("latin-1")
    if not s.startswith("{\\rtf"):
        return plain(path, content)
    out, depth, skip = [], 0, None
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", s):
        if m[6] == "{":
            depth += 1
        elif m[6] == "}":
            depth -= 1
            skip = None if skip is not None and depth < skip else skip
        elif skip is not None:
            continue
        elif m[5] == "*" or m[3] in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = depth
        elif m[1]:
            out.append(bytes.fromhex(m[1]).decode("cp1252", "replace"))
        elif m[2]:
            out.append(chr(int(m[2]) % 65536))
        elif m[3] in ("par", "sect", "page"):
            out.append("\n\n")
        elif m[3] in ("line", "tab"):
            out.append(" ")
        elif m[5]:
            out.append(m[5] if m[5] in "\\{}" else " " if m[5] == "~" else "")
        elif m[7]:
            out.append(m[7])
    return Parsed([Passage(x, stem(path), 1, 1, None, i) for i, x in enumerate(merged(paragraphs("".join(out))), 1)], title=stem(path))


def plain(path: str, content: bytes) -> Parsed:
    """Whole lines, packed."""
    parts = packed_lines(decoded(content))
    return Parsed([Passage(x, None, None, 1, None, i, a, z) for i, (x, a, z) in enumerate(parts, 1)], title=stem(path))
