"""Parsers: the bytes of a file to passages and to references that are not resolved yet. Each is a plain function; files are parsed in parallel by mapInPandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.parsers import data, documents, markup, source, text
from quire.sources.parsers.model import Parsed, Passage, Reference, Unreadable

#: Endings and what parses them; what no entry claims is text, unless it is binary.
BY_ENDING = {
    **dict.fromkeys((".md", ".markdown"), text.markdown), **dict.fromkeys((".tex", ".latex"), text.latex), **dict.fromkeys((".rtf",), text.rtf), **dict.fromkeys((".py",), source.python), **dict.fromkeys((".sh", ".bash", ".zsh"), source.shell),
    **dict.fromkeys((".ipynb",), source.notebook), **dict.fromkeys((".yaml", ".yml"), data.yaml), **dict.fromkeys((".json",), data.json_), **dict.fromkeys((".toml",), data.toml), **dict.fromkeys((".csv", ".tsv"), data.csv_), **dict.fromkeys((".xlsx",), data.xlsx),
    **dict.fromkeys((".sqlite", ".sqlite3", ".db"), data.sqlite), **dict.fromkeys((".xml",), markup.legal_xml), **dict.fromkeys((".html", ".htm"), markup.html_), **dict.fromkeys((".fb2",), markup.fb2), **dict.fromkeys((".epub",), documents.epub),
    **dict.fromkeys((".docx",), documents.docx), **dict.fromkeys((".odt",), documents.odt), **dict.fromkeys((".pptx",), documents.pptx), **dict.fromkeys((".mid", ".midi", ".kar", ".rmi"), documents.midi), **dict.fromkeys((".mp3", ".flac", ".ogg"), documents.audio),
    **dict.fromkeys((".pdf", ".djvu", ".djv", ".mobi", ".azw", ".azw3"), documents.outside),
}

SCHEMA = (
    "path string, corpus string, status string, error string, passages array<struct<ordinal: int, chapter_title: string, chapter_num: int, page_start: int, page_end: int, paragraph: int, line_start: int, line_end: int, "
    "content: string, metadata: map<string, string>>>, references array<struct<relation: string, target: string, detail: string>>, title string"
)


def real_format(content: bytes) -> str:
    """A format by its first bytes: pdf, epub, docx, xlsx, pptx, odt, zip, html, rtf, gzip, sqlite, empty, binary or text."""
    head = content[:8192]
    if not head:
        return "empty"
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"SQLite format 3\x00"):
        return "sqlite"
    if head.startswith(b"\x1f\x8b"):
        return "gzip"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if head.startswith(b"PK"):
        return documents.zip_format(content)
    start = head.lstrip()[:64].lower()
    if start.startswith((b"<!doctype html", b"<html")):
        return "html"
    return "binary" if b"\0" in head else "text"


#: Parsers that a program has registered: (what tells by path and content whether it is for a file, parser). The last one registered is asked first; none is ever loaded from a project's own files.
REGISTERED: list[tuple[Callable[[str, bytes], bool], Callable[[str, bytes], Parsed]]] = []


def register(parser: Callable[[str, bytes], Parsed], endings: tuple[str, ...] = (), matches: Callable[[str, bytes], bool] | None = None) -> None:
    """A parser for endings, or for whatever `matches`, which goes before the endings. The last registration of an ending wins. To be called on the workers too, such as at the import of a module."""
    if matches is not None:
        REGISTERED.insert(0, (matches, parser))
    BY_ENDING.update(dict.fromkeys(endings, parser))


def parse(path: str, content: bytes) -> Parsed:
    """One file. Empty ones have no passages; a binary file that no parser claims is skipped; what cannot be read raises Unreadable."""
    ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    parser = next((p for m, p in REGISTERED if m(path, content)), None) or BY_ENDING.get(ending)
    if parser is None:
        if real_format(content) == "binary":
            return Parsed(skipped="binary")
        parser = text.plain
    parsed = parser(path, content)
    parsed.passages = [p for p in parsed.passages if p.content.strip()]
    return parsed


def parsed(files: DataFrame, ending: dict | None = None) -> DataFrame:
    """files (path, corpus, content) to one row for each file (see SCHEMA): status `ok`, `skipped` or `failed` with its error. A file that fails fails alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, corpus, content in zip(b["path"], b["corpus"], b["content"], strict=True):
                try:
                    p = parse(path, bytes(content) if content is not None else b"")
                    status, error = ("skipped", p.skipped) if p.skipped else ("ok", None)
                except Exception as e:  # noqa: BLE001: whatever a damaged file provokes
                    p, status, error = Parsed(), "failed", f"{type(e).__name__}: {e}"[:2000]
                rows.append((path, corpus, status, error, [x.row(i) for i, x in enumerate(p.passages)], [(r.relation, r.target, r.detail) for r in p.references], p.title))
            yield pd.DataFrame(rows, columns=["path", "corpus", "status", "error", "passages", "references", "title"])

    return files.select("path", "corpus", "content").mapInPandas(run, SCHEMA)


def passages(parsed_: DataFrame, slug) -> DataFrame:
    """Chunk rows: chunk_id is slug:number, unique in its book; content_hash and content_chars are derived; empty passages never arise."""
    from quire.functions.text import content_hash

    p = parsed_.filter("status = 'ok'").select(slug.alias("book_slug"), F.col("title").alias("book_title"), F.col("path").alias("book_file"), "corpus", F.explode("passages").alias("p"))
    one = p.select("*", "p.*").drop("p")
    return one.select(
        F.concat("book_slug", F.lit(":"), F.format_string("%05d", F.col("ordinal") + 1)).alias("chunk_id"), "*", F.length("content").alias("content_chars"), content_hash(F.col("content")).alias("content_hash")
    )


__all__ = ["BY_ENDING", "Parsed", "Passage", "Reference", "Unreadable", "parse", "parsed", "passages", "real_format"]
