"""Finding files: listings, selection by ending, pattern and ignore rules, and a map of a project."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.catalog import glob_pattern, matching_glob

#: Folders and endings that are never wanted (fixed values).
EXCLUDED_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", ".tox", "dist", "build", ".egg-info", ".eggs", ".mypy_cache", ".pytest_cache", ".ruff_cache", "db", ".cache", ".codegraph", ".idea", ".quire")
EXCLUDED_PATHS = (".claude/worktrees",)
EXCLUDED_ENDINGS = ("-wal", "-shm", "-journal")
#: What a file is by its ending; others are `other`.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".cpp": "c++", ".rb": "ruby", ".sh": "shell", ".sql": "sql", ".kt": "kotlin", ".scala": "scala", ".php": "php"}
CATEGORIES = {".md": "docs", ".tex": "docs", ".pdf": "docs", ".docx": "docs", ".html": "docs", ".txt": "docs", ".json": "data", ".csv": "data", ".xlsx": "data", ".db": "data", ".yaml": "config", ".yml": "config", ".toml": "config", ".cfg": "config"}


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path relative to root, modified_at, file_size[, content]) of all files below a folder; without content no file is read. Files of no bytes are not listed: one that becomes empty counts as removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base), "")
    cols = [path.alias("path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("file_size")]
    return files.select(*cols, *(["content"] if content else []))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.md5("content"))


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file in a folder (`` for the root)."""

    folder: str
    pattern: str


def ignore_rules(folder: str, text: str) -> list[Rule]:
    """Rules of an ignore file; blank lines and comments are none."""
    return [Rule(folder, x.rstrip()) for x in text.splitlines() if x.strip() and not x.startswith("#")]


def sections(text: str) -> dict[str, list[str]]:
    """Patterns of an ignore file with [index] and [versions] sections; lines before any section are [index], unknown sections are left out."""
    out: dict[str, list[str]] = {"index": [], "versions": []}
    at = "index"
    for line in text.splitlines():
        line = line.strip()
        if m := re.fullmatch(r"\[(\w+)\]", line):
            at = m[1]
        elif line and not line.startswith("#") and at in out:
            out[at].append(line)
    return out


def history_is_wanted(path: str, text: str) -> bool:
    """Whether versions of a file are kept: its root's ignore file does not name it in [versions]."""
    return not ignored(path, [Rule("", p) for p in sections(text)["versions"]])


#: What a source's scan does if it says nothing.
DEFAULTS = {"recursive": True, "honor_ignore": True}


def scan_payloads(sources: Sequence[dict]) -> list[dict]:
    """Configured sources as payloads of scan jobs: what is as it is by default is left out, lists are sorted, and equal payloads are one, so that jobs deduplicate."""
    out: dict[str, dict] = {}
    for s in sources:
        p = {k: sorted(v) if isinstance(v, list | tuple) else v for k, v in sorted(s.items()) if v not in (None, "", [], ()) and DEFAULTS.get(k) != v}
        out.setdefault(repr(p), p)
    return list(out.values())


def memory_sources(listed: DataFrame) -> DataFrame:
    """listed (project, path, real_path) of folders of notes to (corpus, root_path): one corpus for each project; of links to one folder the first by path counts."""
    one = listed.groupBy("real_path").agg(F.min(F.struct("path", "project")).alias("r"))
    return one.select(F.concat(F.lit("memory-"), "r.project").alias("corpus"), F.col("r.path").alias("root_path"))


def _component(p: str) -> str:
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", p):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return out


def ignored(path: str, rules: Sequence[Rule]) -> bool:
    """Whether a file is ignored. Rules of deeper folders, then later ones, win; `!` takes back; a rule with a slash before its end is bound to its folder; a folder that is ignored stays so."""
    parts = path.split("/")
    ordered = sorted(enumerate(rules), key=lambda r: (r[1].folder.count("/") + bool(r[1].folder), r[0]))
    for n in range(1, len(parts) + 1):
        here, is_dir, verdict = "/".join(parts[:n]), n < len(parts), False
        for _, r in ordered:
            if r.folder and not here.startswith(r.folder + "/"):
                continue
            rel = here[len(r.folder) + 1 :] if r.folder else here
            p, negated = (r.pattern[1:], True) if r.pattern.startswith("!") else (r.pattern, False)
            if p.endswith("/"):
                if not is_dir:
                    continue
                p = p[:-1]
            bound = "/" in p.strip("/") or p.startswith("/")
            if re.fullmatch(_component(p.lstrip("/")), rel if bound else rel.rsplit("/", 1)[-1]):
                verdict = not negated
        if verdict:
            return True
    return False


def excluded(path: Column) -> Column:
    folders = "|".join(map(re.escape, EXCLUDED_DIRS + EXCLUDED_PATHS))
    return path.rlike(rf"(?:^|/)(?:{folders})/") | path.rlike("(?:" + "|".join(map(re.escape, EXCLUDED_ENDINGS)) + ")$")


def selected(files: DataFrame, endings: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), rules: Sequence[Rule] = ()) -> DataFrame:
    """Files by built-in exclusions, allowed endings (all if none), patterns, and ignore rules (few lines, sent along with the code)."""
    path = F.col("path")
    df = files.filter(~excluded(path))
    if endings:
        df = df.filter(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin([e.lower() for e in endings]))
    for patterns, wanted in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | matching_glob(path, p)
            df = df.filter(hit if wanted else ~hit)
    if rules:
        held = tuple(rules)

        @F.pandas_udf("boolean")
        def drop(s: pd.Series) -> pd.Series:
            return s.map(lambda p: ignored(p, held))

        df = df.filter(~drop("path"))
    return df


def project_map(files: DataFrame) -> DataFrame:
    """(top, files, bytes, categories, languages, entry_points): what lies below each top folder (`.` for files at the root)."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    name = F.element_at(F.split("path", "/"), -1)
    entry = F.when(name.rlike(r"^(?:main|__main__|app|index|manage|setup|cli)\.\w+$|^(?:Makefile|Dockerfile)$"), F.col("path"))
    top = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), 1)).otherwise(".")
    tagged = files.select(top.alias("top"), "file_size", F.coalesce(F.try_element_at(lookup(CATEGORIES), ending), F.when(F.try_element_at(lookup(LANGUAGES), ending).isNotNull(), "code"), F.lit("other")).alias("category"), F.try_element_at(lookup(LANGUAGES), ending).alias("language"), entry.alias("entry"))
    sets = lambda c: F.array_sort(F.collect_set(c))
    return tagged.groupBy("top").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), sets("category").alias("categories"), sets("language").alias("languages"), sets("entry").alias("entry_points"))


def proposed_corpora(files: DataFrame, least: int = 5) -> DataFrame:
    """Top folders with `least` Markdown files or more."""
    md = files.filter(F.lower("path").rlike(r"/.*\.md$")).select(F.element_at(F.split("path", "/"), 1).alias("corpus"))
    return md.groupBy("corpus").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= least)




__all__ = ["Rule", "excluded", "glob_pattern", "ignore_rules", "ignored", "listing", "project_map", "proposed_corpora", "sections", "selected", "with_hash"]
