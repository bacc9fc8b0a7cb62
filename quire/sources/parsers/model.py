"""What parsers give, and how they cut text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Sizes of passages in characters: aimed at, least, most; and of a page where there are none (fixed values).
TARGET, LEAST, MOST, PAGE = 1500, 200, 3000, 2500


class Unreadable(Exception):
    """The file cannot be read as what it claims to be, or its reader isn't there."""


@dataclass
class Passage:
    content: str
    chapter_title: str | None = None
    chapter_num: int | None = None
    page_start: int | None = 1
    page_end: int | None = None
    paragraph: int | None = 1
    line_start: int | None = None
    line_end: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def row(self, ordinal: int) -> tuple:
        end = self.page_end if self.page_end is not None else self.page_start
        return (ordinal, self.chapter_title, self.chapter_num, self.page_start, end, self.paragraph, self.line_start, self.line_end, self.content, {k: str(v) for k, v in self.metadata.items()})


@dataclass
class Reference:
    relation: str
    target: str
    detail: str = ""


@dataclass
class Parsed:
    passages: list[Passage] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    title: str | None = None
    skipped: str | None = None


def decoded(content: bytes) -> str:
    """UTF-8 with what is invalid replaced."""
    return content.decode("utf-8-sig", errors="replace").replace("\r\n", "\n")


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    base = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return " ".join(re.sub(r"\([^)]*\)", "", base).replace("-", " ").replace("_", " ").split())


def page_at(position: int) -> int:
    return max(1, position // PAGE + 1)


def paragraphs(s: str) -> list[str]:
    """Blocks between blank lines with collapsed blanks, longer than 20 characters; else all there is."""
    found = [" ".join(b.split()) for b in re.split(r"\n\s*\n", s)]
    return [b for b in found if len(b) > 20] or [x for x in (" ".join(s.split()),) if x]


def sentences(s: str, most: int) -> list[str]:
    """Parts of at most `most` characters, cut after a sentence if one ends in the second half, else after a blank, else anywhere."""
    out = []
    while len(s) > most:
        ends = [m.end() for m in re.finditer(r"[.!?…]\s", s[:most])]
        cut = ends[-1] if ends and ends[-1] > most // 2 else s.rfind(" ", 1, most)
        cut = cut if cut > 0 else most
        out.append(s[:cut].strip())
        s = s[cut:].strip()
    return [x for x in [*out, s] if x]


def merged(parts: list[str], target: int = TARGET, least: int = LEAST, most: int = MOST, joint: str = "\n\n") -> list[str]:
    """Neighbouring parts put together up to `target`; a short last one joins the one before; what is still longer than `most` is cut at sentences."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= target:
            out[-1] += joint + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(joint) + len(out[-1]) <= most:
        last = out.pop()
        out[-1] += joint + last
    return [x for p in out for x in sentences(p, most)]


def blocks(parts: list[str], size: int, most: int, joint: str, tail: int = 0) -> list[str]:
    """Blocks put together up to `size`, a last one below `tail` joined to the one before, and cut at line ends beyond `most`."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= size:
            out[-1] += joint + p
        else:
            out.append(p)
    if tail and len(out) > 1 and len(out[-1]) < tail:
        last = out.pop()
        out[-1] += joint + last
    cut = []
    for p in out:
        while len(p) > most:
            at = p.rfind("\n", 1, most)
            at = at if at > 0 else most
            cut.append(p[:at])
            p = p[at:].lstrip("\n")
        cut.append(p)
    return cut


def packed_lines(s: str, target: int = 500, least: int = 100, most: int = 1200) -> list[tuple[str, int, int]]:
    """(text, first line, last line): whole lines up to `target`; a single longer line is cut at `most`; a short rest joins the part before."""
    out: list[tuple[str, int, int]] = []
    run: list[str] = []
    start, size = 1, 0

    def close(last: int) -> None:
        body = "\n".join(run)
        out.extend((body[i : i + most], start, last) for i in range(0, len(body), most))

    for no, line in enumerate(s.split("\n"), 1):
        if run and size + len(line) + 1 > target:
            close(no - 1)
            run, start, size = [], no, 0
        run.append(line)
        size += len(line) + 1
    last = s.count("\n") + 1
    if run:
        rest = "\n".join(run)
        if out and len(rest) < least:
            body, a, _ = out.pop()
            out.append((body + "\n" + rest, a, last))
        else:
            close(last)
    return [x for x in out if x[0].strip()]
