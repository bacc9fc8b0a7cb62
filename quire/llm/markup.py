"""Markup residue: which kinds of marks a text holds, and its clean text with headings, lists, code and formulas kept.

Both come from one stream of events: html.parser's, and those of line scanners for Markdown, MediaWiki and LaTeX. HTML lines are then chosen by their text-to-tag ratio, smoothed by a
Gaussian and cut between two clusters, so that lines made of tags alone (wrappers) and runs of links (menus) outside of the content fall away. The standard library has no parser of Markdown, wiki
text or LaTeX: line scanners over the text stand for one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.session import spread
from quire.sources.tables import one_record

KINDS = ("html", "markdown", "wiki", "latex")
#: So many lines of links in a row may be a menu.
MENU = 3
#: Names of HTML elements (fixed values).
TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol "
    "optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track tt u ul var video wbr".split()
)
_SKIP = {"style", "script", "head", "title", "noscript", "template"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "header", "footer", "nav", "aside", "main", "form", "dl", "figure", "tr", "li", "dd", "dt"}
_ANY = re.compile(r"[<&\[{*_#`|\\$=~>]|''")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CODE_LINE = re.compile(
    r"^\s*(?:def |class |async def |import |from \w[\w.]* import |return\b|if .*:\s*$|elif .*:\s*$|else:\s*$|for .* in .*:\s*$|while .*:\s*$|try:\s*$|except\b.*:\s*$|with .*:\s*$|assert |raise |yield |pass\s*$|@\w"
    r"|[\w.\[\]'\"]+(?:\s*,\s*[\w.]+)*\s*[-+*/|&]?=\s*\S|[\w.]+\(.*\)\s*;?\s*$|\"\"\"|'''|(?:public|private|static|const|let|var|function|func|fn|#include|package)\b.*[({;=]|[{}\])]+[;,]?\s*$)"
)

_MD = {
    "fence": re.compile(r"^\s{0,3}(?:```|~~~)", re.M),
    "heading": re.compile(r"^\s{0,3}#{1,6}[ \t]+\S", re.M),
    "code": re.compile(r"(?<![`\\])`(?!`)[^`\n]+`(?!`)"),
    "bold": re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^\n]*?(?<=[^\s*])\*\*(?!\w)|(?<![\w_])__(?=[^\s_])(?![A-Z]{3,}__)[^\n]*?(?<=[^\s_])__(?![\w_])"),
    "italic": re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])"),
    "link": re.compile(r"!?\[[^\[\]\n]*\]\([^()\s\n]*(?:\s+\"[^\"\n]*\")?\)"),
    "reference": re.compile(r"^\s{0,3}\[[^\]\n]+\]:\s+\S+\s*$", re.M),
    "table": re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$|^\s*\|(?![-}|+])(?:[^|\n]+\|){2,}\s*$", re.M),
    "quote": re.compile(r"^\s{0,3}>[ \t]+\S", re.M),
    "strike": re.compile(r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    "underline": re.compile(r"^[^\s|=-][^\n]*\n(?:={3,}|-{3,})[ \t]*$", re.M),
}
_WIKI = {
    "link": re.compile(r"\[\[(?=[^\W_]|:)[^\[\]\n]+\]\]"),
    "template": re.compile(r"\{\{(?=[\w#:])[^{}]*\}\}"),
    "heading": re.compile(r"^(={2,6})[ \t]*[^=\s][^\n]*?\1[ \t]*$", re.M),
    "quotes": re.compile(r"(?<!')('{2,3}|'{5})(?=[^\s'])[^\n]*?(?<=[^\s'])\1(?!')"),
    "table": re.compile(r"^\{\||^\|\}[ \t]*$|^\|-(?!-)[^|\n]*$|^[|!][^\n]*(?:\|\||!!)", re.M),
    "magic": re.compile(r"(?<!\w)__[A-ZÀ-Ý]{3,}__(?!\w)"),
    "list": re.compile(r"^(?:\*{2,}|#{2,}[*:]|[*#]+:|:{1,4}[*#]*)[ \t]+\S", re.M),
    "external": re.compile(r"(?<!\])\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\](?!\()"),
    "reference": re.compile(r"</?(?:ref|nowiki|gallery|references)\b[^>\n]*>", re.I),
    "redirect": re.compile(r"^#(?:REDIRECT|REDIRECTION)\b", re.M),
}
_TEX = {
    "environment": re.compile(r"\\(?:begin|end)\s*\{[a-zA-Z*]+\}"),
    "command": re.compile(r"(?<![\w:\\])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|(?<=[\w.,;)~}])\\[a-zA-Z]+\*?\{"),
    "item": re.compile(r"^\s*\\(?:item|maketitle|tableofcontents|newpage|clearpage|noindent|centering|par|bigskip|medskip|smallskip|hline|appendix)\b", re.M),
    "display": re.compile(r"\\\[[^\n]*|\\\][ \t]*$|\\\((?=[^\n]*\\\))|\$\$[^$]+\$\$", re.M),
    "math": re.compile(r"(?<![\\\w$])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\])\$(?![\w$])"),
}


@dataclass
class Events:
    """kinds found, and the clean text."""

    kinds: set[str] = field(default_factory=set)
    text: str = ""


def _is_formula(x: str) -> bool:
    """Between dollar signs: signs of a formula, and not a sentence; or a name of one or two letters."""
    words = re.findall(r"(?<![\\\w])[^\W\d_]{4,}(?![\w{])", re.sub(r"\\[a-zA-Z]+\{[^{}]*\}", "", x))
    return len(words) <= 4 and bool(re.search(r"[\\^_={}]", x)) or bool(re.fullmatch(r"[A-Za-z]{1,2}'?", x))


def is_code(content: str) -> bool:
    """Program code as such: most lines look like it, and no fence or tag around says that it is set in a text."""
    lines = [x for x in content.split("\n") if x.strip()]
    if not lines:
        return False
    hits, inside = 0, False
    for x in lines:
        quotes = x.count('"""') + x.count("'''")
        if inside or quotes or _CODE_LINE.match(x) or x.lstrip().startswith(("#", "//")) or (x.startswith("    ") and re.search(r"[(){}=\[\]:]", x)):
            hits += 1
        if quotes % 2:
            inside = not inside
    starts = sum(1 for x in lines if re.match(r"\s*(?:def |class |async def |import |from \w[\w.]* import |return |@\w|function |public |private |#include)", x))
    return starts > 0 and hits >= 0.6 * len(lines)


class _Html(HTMLParser):
    """Text of HTML with its structure as plain signs; counts tags and text for every line of the source. never_closed: tags, with their places, that an earlier reading found open at the end; their text is kept."""

    def __init__(self, lines: int, never_closed: frozenset[tuple[str, tuple[int, int]]] = frozenset()) -> None:
        super().__init__(convert_charrefs=False)
        self.marks = 0
        self.closed = 0
        self.out: list[tuple[int, str]] = []  # (source line, piece)
        self.tags, self.letters = np.zeros(lines + 1), np.zeros(lines + 1)
        self.skip: list[tuple[str, tuple[int, int]]] = []  # open tags whose text is left out
        self.never_closed = never_closed
        self.code = 0
        self.anchor = 0
        self.linked = np.zeros(lines + 1)
        self.lists: list[list] = []
        self.kept: set[int] = set()

    def _put(self, s: str) -> None:
        if not self.skip and s:
            line = self.getpos()[0]
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.out.append((line + k, "\n"))
                self.out.append((line + k, part))
                self.letters[min(line + k, len(self.letters) - 1)] += len(part.strip())
                if self.anchor:
                    self.linked[min(line + k, len(self.letters) - 1)] += len(part.strip())

    def _never_closed(self, tag: str) -> bool:
        here = self.getpos()
        # of scripts and styles nothing ends a later one either
        return any(t == tag and (at == here or (tag in self.CDATA_CONTENT_ELEMENTS and at < here)) for t, at in self.never_closed)

    def set_cdata_mode(self, elem: str, **k: bool) -> None:
        if not self._never_closed(elem):
            super().set_cdata_mode(elem, **k)

    def _keep(self) -> None:
        self.kept.add(self.getpos()[0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in TAGS:
            return self._put(self.get_starttag_text() or "")
        self.marks += 1
        self.tags[self.getpos()[0]] += 1
        if tag in _SKIP:
            if tag != "title" and not self._never_closed(tag):
                self.skip.append((tag, self.getpos()))
        elif tag == "a":
            self.anchor = 1
        elif tag in ("pre", "code"):
            if not self.code and (tag == "pre"):
                self._keep()
                self._put("\n```\n")
            self.code += tag == "pre"
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n")
        elif tag == "li":
            self._keep()
            if not self.lists:
                self.lists.append(["ul", 0])
            self.lists[-1][1] += 1
            self._put("\n" + "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "))
        elif re.fullmatch("h[1-6]", tag):
            self._keep()
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("td", "th"):
            self._keep()
            self._put(" | ")
        elif tag in ("br", "hr"):
            self._put("\n")
        elif tag == "img":
            self._put(dict(attrs).get("alt") or "")
        elif tag in _BLOCKS:
            self._put("\n")
        return None

    def handle_endtag(self, tag: str) -> None:
        if tag not in TAGS:
            return self._put(f"</{tag}>")
        self.marks += 1
        self.closed += 1
        self.tags[min(self.getpos()[0], len(self.tags) - 1)] += 1
        if tag in _SKIP:
            opened = [k for k, (t, _) in enumerate(self.skip) if t == tag]
            if opened:
                del self.skip[opened[-1] :]
        elif tag == "a":
            self.anchor = 0
        elif tag == "pre":
            if self.code:
                self.code -= 1
                self._put("\n```\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._put("\n")
        elif (tag in _BLOCKS and tag != "li") or re.fullmatch("h[1-6]", tag):
            self._put("\n")
        return None

    def handle_data(self, data: str) -> None:
        self._put(data)

    def handle_comment(self, data: str) -> None:
        self.marks += 1
        self.closed += 1
        self.tags[self.getpos()[0]] += 1

    def handle_entityref(self, name: str) -> None:
        # without its semicolon, a sign of the sentence
        self._put(html.unescape(f"&{name};") if f"{name};" in html.entities.html5 else f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._put(html.unescape(f"&#{name};"))

    def result(self) -> str:
        """The pieces on lines in content regions, and on those with structure.

        The text-to-tag ratio of the lines, smoothed, falls into two clusters, around centres that settle in turns; a region is content above their middle. Of the lines below it go those with tags and
        hardly any text, unless they have structure, and runs of MENU lines or more that are links and little else, list items too, most of which lie below."""
        ratio = self.letters / np.maximum(1, self.tags)
        k = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
        padded = np.pad(ratio, 2, mode="edge")
        smooth = np.convolve(padded, k / k.sum(), mode="valid")
        used = (self.letters > 0) | (self.tags > 0)
        low, high = (smooth[used].min(), smooth[used].max()) if used.any() else (0.0, 0.0)
        for _ in range(20):
            middle = (low + high) / 2
            below, above = smooth[used & (smooth < middle)], smooth[used & (smooth >= middle)]
            if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
                break
            low, high = below.mean(), above.mean()
        outside = smooth < (low + high) / 2 if high > 2 * low else np.zeros(len(smooth), bool)
        drop = {i for i in range(len(ratio)) if self.tags[i] and smooth[i] < 0.2 * ratio.std() and self.letters[i] < 12 and i not in self.kept}
        run: list[int] = []
        for i in range(len(ratio) + 1):
            if i < len(ratio) and self.letters[i] and self.linked[i] >= self.letters[i] - 4:
                run.append(i)
            elif i == len(ratio) or self.letters[i]:
                if len(run) >= MENU and outside[run].mean() > 0.5:
                    drop.update(range(run[0], run[-1] + 1))
                run = []
        return "".join(s for i, s in self.out if i not in drop or s == "\n")


def _tags(content: str, kinds: set[str], code: bool) -> str:
    if "<" not in content and "&" not in content:
        return content
    never_closed: frozenset[tuple[str, tuple[int, int]]] = frozenset()
    while True:  # a few times at most: an open script or style hides the tags after it
        p = _Html(content.count("\n") + 1, never_closed)
        p.feed(content)
        p.close()
        if not p.skip:
            break
        never_closed |= frozenset(p.skip)
    entities = bool(_ENTITY.search(content)) and any(html.unescape(m) != m for m in _ENTITY.findall(content))
    if p.marks and (not code or p.closed) or entities:
        kinds.add("html")
        return p.result()
    return content


def _clean_line(s: str) -> str:
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]", r"\1", s)
    s = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s\n]*(?:\s+\"[^\"\n]*\")?\)", r"\1", s)
    s = re.sub(r"(?<!\])\[https?://\S+\s+([^\]\n]*)\]", r"\1", s)
    s = re.sub(r"\{\{([^{}\n]*)\}\}", lambda m: " ".join(x for x in m[1].split("|")[1:] if "=" not in x), s)
    s = re.sub(r"(?<!')('{2,3}|'{5})(?=[^\s'])([^\n]*?)(?<=[^\s'])\1(?!')", r"\2", s)
    s = re.sub(r"(?<![\w*\\])\*\*(?=[^\s*])([^\n]*?)(?<=[^\s*])\*\*(?!\w)", r"\1", s)
    s = re.sub(r"(?<!\w)__[A-ZÀ-Ý]{3,}__(?!\w)", "", s)
    s = re.sub(r"(?<![\w_])__(?=[^\s_])([^\n]*?)(?<=[^\s_])__(?![\w_])", r"\1", s)
    s = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])", r"\1", s)
    s = re.sub(r"~~(?=\S)([^~\n]+)(?<=\S)~~", r"\1", s)
    s = re.sub(r"(?<![`\\])`(?!`)([^`\n]+)`(?!`)", r"\1", s)
    s = re.sub(r"[~ ]?\\(?:cite|ref|label|eqref|pageref|index)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", s)
    s = re.sub(r"\\footnote\{([^{}\n]*)\}", r" (\1)", s)
    for _ in range(3):
        s = re.sub(r"\\(?:emph|text\w{2,6}|underline|mbox|href\{[^{}]*\}|url|caption)\*?\{([^{}\n]*)\}", r"\1", s)
    s = re.sub(r"\\\(\s*(.*?)\s*\\\)", r"$\1$", s)
    s = re.sub(r"(?<=\})\s+%.*$", "", s)
    return s


_TEX_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _structured(content: str) -> str:
    """Markdown, wiki and LaTeX lines as plain text with `#` headings, `- ` lists, fenced code, ` | ` between cells and `$` around formulas."""
    out, fence, maths = [], False, False
    for line in content.split("\n"):
        if re.match(r"\s{0,3}(?:```|~~~)", line):
            fence = not fence
            out.append("```")
        elif fence:
            out.append(line)
        elif m := re.match(r"\s*\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)\*?\}", line):
            maths = True
            out.append("$$")
        elif re.match(r"\s*\\end\{(equation|align|gather|multline|displaymath|math|eqnarray)\*?\}", line):
            maths = False
            out.append("$$")
        elif maths:
            out.append(line)
        elif re.match(r"\s*\\begin\{(verbatim|lstlisting|minted)\*?\}", line) or re.match(r"\s*\\end\{(verbatim|lstlisting|minted)\*?\}", line):
            out.append("```")
        elif re.match(r"\s*\\(?:begin|end)\{|^\{\||^\|\}|^\|-|^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", line):
            continue
        elif m := re.match(r"\s*\\(part|chapter|(?:sub){0,2}section|paragraph)\*?\{(.*?)\}\s*(?:%.*)?$", line):
            out += ["", "#" * _TEX_LEVELS[m[1]] + " " + _clean_line(m[2])]
        elif m := re.match(r"(={2,6})\s*(.+?)\s*\1\s*$", line):
            out += ["", "#" * (len(m[1]) - 1) + " " + _clean_line(m[2])]
        elif m := re.match(r"\s*\\\[\s*(.*?)\s*\\\]\s*$", line):
            out.append(f"$$ {m[1]} $$")
        elif m := re.match(r"\s*\\item\b\s*(.*)", line):
            out.append("- " + _clean_line(m[1]))
        elif m := re.match(r"([*#]+)\s+(.*)", line) if re.match(r"\*", line) else None:
            out.append("  " * (len(m[1]) - 1) + "- " + _clean_line(m[2]))
        elif re.match(r"\s*[|!]", line) and line.count("|") >= 2:
            out.append(" | ".join(_clean_line(c.strip()) for c in re.split(r"\|\||!!|\|", line.strip().strip("|!")) if c.strip()))
        elif m := re.match(r"\s{0,3}>\s?(.*)", line):
            out.append(_clean_line(m[1]))
        else:
            out.append(_clean_line(line))
    return "\n".join(out)


def read(content: str, known_code: bool = False) -> Events:
    """The kinds of marks in a text and its clean form. Program code by itself keeps its form and counts as no markup."""
    e = Events(text=content)
    if not _ANY.search(content):
        return e
    code = known_code or is_code(content)
    if code and not re.search(r"^\s{0,3}(?:```|~~~)|<pre|<code", content, re.M):
        e.text = _tags(content, e.kinds, True)
        return e
    text = _tags(content, e.kinds, False)
    prose = re.sub(r"<pre\b.*?</pre>", "", content, flags=re.S) if "<pre" in content else content
    bare = re.sub(r"^\s{0,3}(```|~~~).*?^\s{0,3}\1", r"\1", prose, flags=re.S | re.M) if "```" in prose or "~~~" in prose else prose
    for kind, scanners in (("markdown", _MD), ("wiki", _WIKI), ("latex", _TEX)):
        for name, scan in scanners.items():
            m = scan.search(prose if name == "fence" else bare)
            if m and name == "math":
                m = next((x for x in scan.finditer(bare) if _is_formula(x[1])), None)
            if m:
                e.kinds.add(kind)
                break
    if e.kinds:
        e.text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", _structured(text))).strip()
    return e


def cleaned(chunks: DataFrame) -> DataFrame:
    """(id, kinds, text) of chunks (id, content, section_type, loaded_at), one row for each id, from the row loaded first: repeated rows go before anything is parsed. A null content is left out; an
    empty one stays empty; texts without marks stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read(c, s == "function") for c, s in zip(b["content"], b["section_type"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "kinds": [sorted(e.kinds) for e in got], "text": [e.text for e in got]})

    one = one_record(spread(chunks), "id", "content", "section_type").filter("content IS NOT NULL")
    return one.mapInPandas(run, "id bigint, kinds array<string>, text string")


def marked(chunks: DataFrame) -> DataFrame:
    """(id, kinds): the kinds alone, for which rows need not be moved; a repeated row gives a repeated one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "kinds": [sorted(read(c, s == "function").kinds) for c, s in zip(b["content"], b["section_type"], strict=True)]})

    known = spread(chunks.filter("id IS NOT NULL AND content IS NOT NULL").select("id", "content", "section_type"))
    return known.mapInPandas(run, "id bigint, kinds array<string>")
