"""French legal XML, HTML with article references, FB2."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from quire.sources.parsers.model import MOST, Parsed, Passage, Reference, Unreadable, decoded, merged, paragraphs, sentences, stem

#: Article references in French legal prose: L. 123-4, R*. 12 bis, 39 quinquies A (fixed form).
ARTICLE = re.compile(r"\barticles?\s+((?:[LRDA]\*?\.?\s?)?\d+(?:[-.]\d+)*(?:\s(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies))?(?:\s[A-Z](?![\w'’]))?)", re.I)


def article_ref(code: str | None, number: str | None) -> str | None:
    """A stable name of an article: its code in capitals and its number as it is written, without signs, blanks as hyphens; null without number."""
    code, number = ("-".join(re.sub(r"[^\w\s]", "", x or "").split()) for x in (code, number))
    if not number:
        return None
    return f"{code.upper()}-{number}" if code else number


def _words(e: ET.Element | None) -> str:
    if e is None:
        return ""
    for x in e.iter():
        if x.tag.lower().rsplit("}", 1)[-1] in ("p", "br", "div", "li", "tr"):
            x.tail = "\n\n" + (x.tail or "")
    return re.sub(r"[ \t]+", " ", "".join(e.itertext())).strip()


def _named(e: ET.Element, *names: str) -> ET.Element | None:
    return next((x for n in names for x in e.iter() if x.tag.upper().rsplit("}", 1)[-1] == n), None)


def legal_xml(path: str, content: bytes) -> Parsed:
    """A passage for each article, with its number, state (VIGUEUR if none is given) and dates (null if blank) as metadata and the sections above it as chapter; other XML by its text."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise Unreadable(f"XML: {e}") from e
    code = _words(_named(root, "TITRE", "TITREFULL", "TITLE"))
    p = Parsed(title=code or stem(path))
    found = 0

    def visit(e: ET.Element, sections: tuple[str, ...]) -> None:
        nonlocal found
        name = e.tag.upper().rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        if name == "ARTICLE":
            found += 1
            value = lambda *n: _words(_named(e, *n)) or None
            number, state = value("NUM"), value("ETAT") or "VIGUEUR"
            meta = {"etat": state, "article_ref": article_ref(code, number), "num": number, "date_debut": value("DATE_DEBUT"), "date_fin": value("DATE_FIN")}
            body = _words(_named(e, "CONTENU", "BLOC_TEXTUEL"))
            for part in sentences(body, MOST):
                p.passages.append(Passage(part, " > ".join(sections) or number, 1, 1, None, len(p.passages) + 1, metadata={k: v for k, v in meta.items() if v}))
            p.references += [Reference("cites", x.get("cidtexte") or x.get("id") or _words(x)) for x in e.iter() if x.tag.upper() == "LIEN"]
            return
        if name in ("SECTION_TA", "SECTION", "CHAPITRE", "LIVRE"):
            t = next((_words(x) for x in e if isinstance(x.tag, str) and x.tag.upper() in ("TITRE_TA", "TITRE", "TITLE")), "")
            sections = (*sections, t) if t else sections
        for x in e:
            visit(x, sections)

    visit(root, ())
    if not found:
        p.passages = [Passage(x, p.title, 1, 1, None, i) for i, x in enumerate(merged(paragraphs(_words(root))), 1)]
    return p


class _Page(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "header", "noscript", "template"}
    BLOCK = {"p", "div", "li", "tr", "section", "article", "ul", "ol", "table", "br", "blockquote", "dd", "dt"}

    def __init__(self) -> None:
        super().__init__()
        self.sections: list[tuple[str | None, list[str]]] = [(None, [])]
        self.title, self.skip, self.heading, self.in_title = "", 0, None, False
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("h1", "h2", "h3", "h4"):
            self.heading = []
        elif tag in self.BLOCK:
            self.sections[-1][1].append("\n\n" + ("- " if tag == "li" else ""))
        if tag == "a" and not self.skip and (href := dict(attrs).get("href")) and not re.match(r"[a-z]+:|#|//", href, re.I):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("h1", "h2", "h3", "h4") and self.heading is not None:
            self.sections.append((" ".join("".join(self.heading).split()), []))
            self.heading = None
        elif tag in self.BLOCK:
            self.sections[-1][1].append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            (self.heading if self.heading is not None else self.sections[-1][1]).append(data)


def html_(path: str, content: bytes) -> Parsed:
    """Sections at h1 to h4, without scripts, menus, heads and feet; the articles a passage cites and the parts of a doctrine number (BOI-A-B-10) are metadata."""
    page = _Page()
    page.feed(decoded(content))
    page.close()
    p = Parsed(title=" ".join(page.title.split()) or next((t for t, _ in page.sections if t), None) or stem(path))
    boi = re.search(r"\bBOI(?:-[A-Z0-9]+)+", p.title + " " + path)
    for n, (title, parts) in enumerate(page.sections):
        for part in merged(paragraphs("".join(parts))) if "".join(parts).strip() else []:
            meta = {"articles": ",".join(dict.fromkeys(" ".join(m[1].split()) for m in ARTICLE.finditer(part)))}
            if boi:
                meta |= {"boi": boi[0], "boi_series": boi[0].split("-")[1]}
            p.passages.append(Passage(part, title, n or None, 1, None, len(p.passages) + 1, metadata={k: v for k, v in meta.items() if v}))
    p.references += [Reference("links_to", x.split("#")[0]) for x in page.links if x.split("#")[0]]
    return p


def fb2(path: str, content: bytes) -> Parsed:
    """Sections of the first body, depth first; nested ones are chapters of their own."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise Unreadable(f"XML: {e}") from e
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    title = next((" ".join("".join(x.itertext()).split()) for x in root.iter() if name(x) == "book-title"), stem(path))
    p = Parsed(title=title)
    body = next((x for x in root if name(x) == "body"), None)
    number = 0

    def visit(section: ET.Element) -> None:
        nonlocal number
        heading = next((" ".join("".join(x.itertext()).split()) for x in section if name(x) == "title"), None)
        own = [" ".join("".join(x.itertext()).split()) for x in section if name(x) not in ("title", "section")]
        if any(own):
            number += 1
            p.passages.extend(Passage(x, heading, number, 1, None, i) for i, x in enumerate(merged([x for x in own if x]), 1))
        for x in section:
            if name(x) == "section":
                visit(x)

    if body is not None:
        visit(body)
    return p
