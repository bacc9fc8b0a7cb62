"""Documents in archives (EPUB, DOCX, ODT, PPTX), MIDI, audio tags, and formats whose readers are not part of Python."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from urllib.parse import unquote

from quire.sources.parsers import markup, pages
from quire.sources.parsers.model import Parsed, Passage, Unreadable, merged, paragraphs, stem

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _zip(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("damaged archive") from e


def zip_format(content: bytes) -> str:
    try:
        names = _zip(content).namelist()
        kind = _zip(content).read("mimetype").decode("ascii", "replace") if "mimetype" in names else ""
    except Unreadable:
        return "zip"
    if "epub" in kind or "META-INF/container.xml" in names:
        return "epub"
    if "opendocument.text" in kind:
        return "odt"
    return next((k for prefix, k in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(prefix) for n in names)), "zip")


def epub(path: str, content: bytes) -> Parsed:
    """Chapters in the order of the spine; where the package is damaged, all pages by name, marked `incomplete`."""
    z = _zip(content)
    title, meta = stem(path), {}
    try:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        at = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
        package = ET.fromstring(z.read(at))
        title = next((x.text for x in package.iter() if x.tag.endswith("}title") and x.text), title)
        files = {x.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(at), unquote(x.get("href")))) for x in package.iter() if x.tag.endswith("}item")}
        pages = [files[x.get("idref")] for x in package.iter() if x.tag.endswith("}itemref") and x.get("idref") in files]
        if not pages or any(n not in z.namelist() for n in pages):
            raise KeyError("spine")
    except (KeyError, StopIteration, ET.ParseError):
        pages, meta = sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n)), {"source_status": "incomplete"}
    p = Parsed(title=title)
    for n, name in enumerate(pages, 1):
        page = markup._Page()
        page.feed(z.read(name).decode("utf-8", "replace").replace("\xad", ""))
        page.close()
        chapter = next((t for t, _ in page.sections if t), None) or " ".join(page.title.split()) or None
        body = "\n\n".join((f"{t}\n\n" if t and t != chapter else "") + "".join(x) for t, x in page.sections)
        if body.strip():
            p.passages += [Passage(x, chapter, n, n, None, i, metadata=dict(meta)) for i, x in enumerate(merged(paragraphs(body)), 1)]
    return p


def _by_heading(title: str, parts: list[tuple[int | None, str]]) -> Parsed:
    """Passages from (heading level or None, text) in order; a heading without text below it is dropped."""
    p = Parsed(title=title)
    chapter, number, run = None, 0, []

    def close() -> None:
        nonlocal run
        if any(run):
            p.passages.extend(Passage(x, chapter, number or None, 1, None, i) for i, x in enumerate(merged([x for x in run if x.strip()]), 1))
        run = []

    for level, text in parts:
        if level is None:
            run.append(text)
        elif text.strip():
            close()
            chapter, number = text.strip(), number + 1
    close()
    return p


def docx(path: str, content: bytes) -> Parsed:
    try:
        body = ET.fromstring(_zip(content).read("word/document.xml")).find(W + "body")
    except (KeyError, ET.ParseError) as e:
        raise Unreadable("not a document") from e
    text = lambda e: "".join("\t" if x.tag == W + "tab" else x.text or "" for x in e.iter() if x.tag in (W + "t", W + "tab"))
    parts: list[tuple[int | None, str]] = []
    for e in body if body is not None else []:
        if e.tag == W + "p":
            style = e.find(f"{W}pPr/{W}pStyle")
            m = re.match(r"(?:heading|titre)\s*(\d)|title$|titre$", style.get(W + "val", ""), re.I) if style is not None else None
            parts.append((int(m[1] or 1) if m else None, text(e)))
        elif e.tag == W + "tbl":
            parts.append((None, "\n".join(" | ".join(text(c).strip() for c in r.iter(W + "tc")) for r in e.iter(W + "tr"))))
    return _by_heading(stem(path), parts)


def odt(path: str, content: bytes) -> Parsed:
    try:
        root = ET.fromstring(_zip(content).read("content.xml"))
    except (KeyError, ET.ParseError) as e:
        raise Unreadable("not a document") from e
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    flat = lambda e: " ".join("".join(e.itertext()).split())
    parts: list[tuple[int | None, str]] = []

    def visit(e: ET.Element) -> None:
        n = name(e)
        if n == "h":
            parts.append((int(next((v for k, v in e.attrib.items() if k.endswith("outline-level")), 1)), flat(e)))
        elif n == "p":
            parts.append((None, flat(e)))
        elif n == "list":
            parts.append((None, "\n".join("- " + flat(x) for x in e if name(x) == "list-item")))
        elif n == "table":
            parts.append((None, "\n".join(" | ".join(flat(c) for c in r if name(c) == "table-cell") for r in e.iter() if name(r) == "table-row")))
        else:
            for x in e:
                visit(x)

    visit(root)
    return _by_heading(stem(path), parts)


def pptx(path: str, content: bytes) -> Parsed:
    """A page for each slide."""
    z = _zip(content)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    p = Parsed(title=stem(path))
    for n, name in enumerate(slides, 1):
        own = [x for x in ("".join(t.text or "" for t in e.iter(A + "t")) for e in ET.fromstring(z.read(name)).iter(A + "p")) if x.strip()]
        if own:
            p.passages.append(Passage("\n".join(own), own[0], n, n, None, 1))
    return p


def midi(path: str, content: bytes) -> Parsed:
    """What a MIDI file says in words: names, markers, lyrics, tempo and notes of its tracks. A damaged track is read up to the damage."""
    at = content.find(b"MThd")
    if at < 0 or len(content) < at + 14:
        raise Unreadable("not a MIDI file")
    form, tracks, division = struct.unpack(">HHH", content[at + 8 : at + 14])
    at += 14
    p = Parsed(title=stem(path))
    facts, tempos = [], []
    while at + 8 <= len(content):
        size = struct.unpack(">I", content[at + 4 : at + 8])[0]
        if content[at : at + 4] == b"MTrk":
            words, lyrics, notes, own_tempos = _track(content[at + 8 : at + 8 + size])
            tempos += own_tempos
            text = "; ".join(words) + ("\n" + lyrics if lyrics.strip() else "") + (f"\nnotes {min(notes)} to {max(notes)}, {len(notes)} in all" if notes else "")
            if text.strip():
                p.passages.append(Passage(text.strip(), words[0] if words else None, len(p.passages) + 1, 1, None, 1, metadata={"kind": "track"}))
                if form == 1 and len(p.passages) == 1 and words:
                    p.title = words[0]
        at += 8 + size
    facts = [f"MIDI format {form}, {tracks} tracks, {division} ticks a beat"] + ([f"tempo {min(tempos):.0f} to {max(tempos):.0f}"] if tempos else [])
    p.passages.insert(0, Passage(", ".join(facts), None, None, 1, None, 1, metadata={"kind": "overview"}))
    return p


def _track(data: bytes) -> tuple[list[str], str, list[int], list[float]]:
    words, lyrics, notes, tempos, i, status = [], "", [], [], 0, 0

    def number() -> int:
        nonlocal i
        n = 0
        while True:
            b = data[i]
            i += 1
            n = n << 7 | b & 127
            if b < 128:
                return n

    try:
        while i < len(data):
            number()
            if data[i] >= 128:
                status = data[i]
                i += 1
            if status == 0xFF:
                kind = data[i]
                i += 1
                size = number()
                body, i = data[i : i + size], i + size
                text = body.decode("utf-8", "replace").strip()
                if kind == 5:
                    lyrics += re.sub(r"[/\\]", "\n", body.decode("utf-8", "replace"))
                elif 1 <= kind <= 7 and text:
                    words.append(text)
                elif kind == 0x51 and size == 3 and any(body):
                    tempos.append(60e6 / int.from_bytes(body, "big"))
            elif status in (0xF0, 0xF7):
                i += number()
            else:
                if status >> 4 == 9 and data[i + 1]:
                    notes.append(data[i])
                i += 1 if status >> 4 in (12, 13) else 2
    except IndexError:
        pass
    return words, lyrics, notes, tempos


#: Frames of ID3 and the fields they hold, in the order of the text (fixed values); Vorbis comments have the fields' names.
ID3 = {
    "TIT2": "title", "TPE1": "artist", "TPE2": "albumartist", "TALB": "album", "TCOM": "composer", "TPE3": "conductor", "TEXT": "lyricist", "TPE4": "arranger", "TCON": "genre", "TDRC": "date", "TYER": "date",
    "TDOR": "originaldate", "TRCK": "tracknumber", "TPOS": "discnumber", "TPUB": "organization", "TCOP": "copyright", "TLAN": "language", "TBPM": "bpm", "TSRC": "isrc", "USLT": "lyrics", "COMM": "comment",
}


def _comments(block: bytes) -> dict[str, str]:
    """Of a block of Vorbis comments; values of a field that is repeated stand side by side."""
    out: dict[str, list[str]] = {}
    try:
        at = 4 + struct.unpack("<I", block[:4])[0]
        n = struct.unpack("<I", block[at : at + 4])[0]
        at += 4
        for _ in range(n):
            size = struct.unpack("<I", block[at : at + 4])[0]
            key, eq, value = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            if eq and value.strip():
                out.setdefault(key.lower(), []).append(value.strip())
            at += 4 + size
    except struct.error:
        pass  # cut short
    return {k: " / ".join(dict.fromkeys(v)) for k, v in out.items()}


def _vorbis(content: bytes) -> tuple[dict[str, str], list[str]]:
    """Fields of FLAC and Ogg files, and what their headers say of the sound."""
    if content[:4] == b"fLaC":
        tags, facts, at, last = {}, [], 4, False
        while not last and at + 4 <= len(content):
            last, kind, size = bool(content[at] & 128), content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
            body = content[at + 4 : at + 4 + size]
            if kind == 0 and len(body) >= 18:
                bits = int.from_bytes(body[10:18], "big")
                rate, channels, depth, samples = bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1
                facts = [f"format: {rate / 1000:g} kHz, {depth}-bit, {channels} channels" + (f", {samples / rate:.0f} s" if rate and samples else "")]
            elif kind == 4:
                tags = _comments(body)
            at += 4 + size
        return tags, facts
    # Ogg: packets run over pages; the comment packet is the second one
    packets, part, at = [], b"", content.find(b"OggS")
    while 0 <= at and at + 27 <= len(content) and len(packets) < 2:
        sizes = content[at + 27 : at + 27 + content[at + 26]]
        body = at + 27 + len(sizes)
        for n in sizes:
            part += content[body : body + n]
            body += n
            if n < 255:
                packets.append(part)
                part = b""
        at = content.find(b"OggS", body)
    head = packets[0] if packets else b""
    facts = []
    if head[1:7] == b"vorbis" and len(head) >= 16:
        facts = [f"format: {struct.unpack('<I', head[12:16])[0] / 1000:g} kHz, {head[11]} channels"]
    for p in packets[1:2]:
        mark = 7 if p[1:7] == b"vorbis" else 8 if p[:8] == b"OpusTags" else None
        if mark:
            return _comments(p[mark:]), facts
    return {}, facts


def audio(path: str, content: bytes) -> Parsed:
    """Tags of ID3v2 or Vorbis comments; lyrics are a passage of their own."""
    tags: dict[str, str] = {}
    facts: list[str] = []
    if content[:3] == b"ID3" and len(content) > 10:
        size = sum((b & 127) << s for b, s in zip(content[6:10], (21, 14, 7, 0), strict=True))
        at = 10
        names = ID3
        while at + 10 <= min(len(content), 10 + size) and content[at : at + 4].strip(b"\0"):
            n = int.from_bytes(content[at + 4 : at + 8], "big") if content[3] < 4 else sum((b & 127) << s for b, s in zip(content[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
            body = content[at + 10 : at + 10 + n]
            frame = content[at : at + 4].decode("latin-1")
            if frame in names and body:
                coding = ["latin-1", "utf-16", "utf-16-be", "utf-8"][min(body[0], 3)]
                text = body[4 if frame in ("USLT", "COMM") else 1 :].decode(coding, "replace")
                tags.setdefault(names[frame], text.split("\0")[-1 if frame in ("USLT", "COMM") else 0].strip("\0\ufeff "))
            at += 10 + n
    else:
        tags, facts = _vorbis(content)
    p = Parsed(title=tags.get("title") or stem(path))
    lyrics = tags.pop("lyrics", "")
    lines = [f"{k}: {tags[k]}" for k in dict.fromkeys([*ID3.values(), *tags]) if k in tags] + facts
    if lines:
        p.passages.append(Passage("\n".join(lines), None, None, 1, None, 1, metadata={"kind": "tags"}))
    if lyrics.strip():
        p.passages.append(Passage(lyrics, "lyrics", None, 1, None, 2, metadata={"kind": "lyrics"}))
    return p


#: Readers by ending: (content) -> texts of the pages. Better ones, such as for scanned pages, may be registered in their place.
READERS: dict[str, Callable[[bytes], list[str]]] = {
    ".pdf": pages.pdf, ".mobi": pages.mobi, ".azw": pages.mobi, ".azw3": pages.mobi, ".djvu": pages.djvu, ".djv": pages.djvu,
}


def outside(path: str, content: bytes) -> Parsed:
    """By the reader of its ending; blank pages keep their number (those of DJVU have none)."""
    ending = "." + path.rsplit(".", 1)[-1].lower()
    if ending not in READERS:
        raise Unreadable(f"no reader for {ending}")
    p = Parsed(title=stem(path))
    for n, page in enumerate(READERS[ending](content), 1):
        if page.strip():
            p.passages += [Passage(x, None, None, n, n, i) for i, x in enumerate(merged(paragraphs(page)), 1)]
    return p
