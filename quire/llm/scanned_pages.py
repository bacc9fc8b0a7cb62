"""Repair of text from scanned pages: running headers, page numbers, words broken over lines, misread characters.

The pages, each once, are written and read three times: to count the words of the collection; to find, for each book, the lines at the edges of its pages that come back, however distorted, and the numbers
there that run on from page to page; and to repair every page with what was found. The vocabulary sent to the workers is bounded: a word must make up 1 / VOCABULARY of all running words. What a page needs to know of other words
is looked up for it by a join with all counts, and the page repaired again, so that the bound decides nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import join_unique
from quire.session import spread, written
from quire.sources.tables import one_record

#: At most so many words are sent to the workers.
VOCABULARY = 500_000
#: A word is a misreading of another one only if that one is so many times as frequent.
RATIO = 8
#: A line runs through a book if it is on so many pages.
REPEATED = 3
#: So many lines at the head and the foot of a page are its edges.
EDGE = 2
#: Longer runs of letters and signs are no words of a text.
LONGEST_WORD = 64
#: The halves of a line are cut up to so many characters before and after its middle.
SHIFT = 2
#: Marks at the end of a line that may break a word; the last two are never part of one.
MARKS = "-‐­¬"
#: What scanners make of letters (fixed values): read, meant.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "é"), ("6", "b"), ("8", "b"), ("9", "g"), ("€", "e"), ("¢", "c"), ("ſ", "s"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("@", "a"),
    ("$", "s"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("f", "t"), ("e´", "é"), ("e`", "è"), ("e^", "ê"), ("a`", "à"), ("a^", "â"), ("u`", "ù"), ("u^", "û"), ("i^", "î"),
    ("o^", "ô"), ("c¸", "ç"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]
#: Signs and digits that stand for letters; the signs do so wherever letters are around them.
SIGN = re.compile(r"[€¢ſ!|@$´`^¸](?=\w)|(?<=\w)[€¢ſ|´`^¸]|[ﬀ-ﬄ]")
_CELL = re.compile(r"^\s*\d[\d\s]*$")
_LABEL = re.compile(r"^\s*[A-ZÀ-Ý][a-zà-ÿ]{2,14}\s*$")
DIGIT_INSIDE = re.compile(r"[a-zà-ÿœ][015689][a-zà-ÿœ]")
_EDGE = re.compile(r"^[^\w€¢ſ|!@$]+|[^\w€¢ſ|´`^¸]+$")
_NUMBER = re.compile(r"^[^\w]*(?:page\s+|p\.?\s*)?(\d{1,6}|[ivxlcdm]{1,8})(?:\s*(?:/|sur|of|de)\s*\d{1,6})?[^\w]*$", re.IGNORECASE)
_DECORATED = re.compile(r"^\s*(?:[^\w\s]\s*\d+\s*[^\w\s]|page\s+\d+|p\.?\s*\d+.*|\d+\s*/\s*\d+)\s*$", re.IGNORECASE)
_BESIDE = re.compile(r"^\s*(\d{1,6})\s{2,}(?=\D)|(?<=\D)\s{2,}(\d{1,6})\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(s: str) -> int:
    v = [_ROMAN[c] for c in s.lower()]
    return sum(-a if any(b > a for b in v[i + 1 : i + 2]) else a for i, a in enumerate(v))


def plain(s: str) -> str:
    """Letters and digits only, upper case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.upper()) if c.isalnum())


def title_like(line: str) -> bool:
    """Set in capitals, with a capital at every word, or spaced out: not as running text is."""
    letters = [c for c in line if c.isalpha()]
    if len(letters) < 6 or len(line) > 160:
        return False
    if sum(c.isupper() for c in letters) >= 0.65 * len(letters):
        return True
    words = [w for w in re.split(r"[\s'’-]+", line) if w and w[0].isalpha()]
    return len(words) >= 3 and sum(w[0].isupper() for w in words) >= 0.75 * len(words)


def alike(a: str, b: str) -> bool:
    """Whether a plain line is a plain title, a few characters apart or cut short."""
    if not a or not b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= max(2, len(b) // 5) or SequenceMatcher(None, a, b, False).ratio() >= 0.82
    if abs(len(a) - len(b)) > max(4, len(b) // 3):
        return False
    return SequenceMatcher(None, a, b, False).ratio() >= 0.8


def tokens(line: str) -> list[str]:
    out = []
    for w in line.split():
        for x in re.split(r"['’]", w):
            x = _EDGE.sub("", x).lower()
            if x:
                out.append(x)
    return out


def count_words(pages: DataFrame) -> DataFrame:
    """(word, n) over all texts: words as read, in lower case, not those at the end or start of a line, which may be broken. Counted in batches before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter()
            for text in b["content"]:
                for line in text.split("\n"):
                    if not title_like(line):
                        n.update(w for w in tokens(line.strip())[1:-1] if any(c.isalpha() for c in w))
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    return pages.select("content").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def confused(word: str) -> Iterator[list[str]]:
    """The words one confusion away, then those two away."""
    if len(word) > LONGEST_WORD:
        return
    seen = {word}
    rim = [word]
    for _ in range(2):
        after = []
        for w in rim:
            for a, z in CONFUSED:
                i = w.find(a)
                while i >= 0:
                    x = w[:i] + z + w[i + len(a) :]
                    if x not in seen:
                        seen.add(x)
                        after.append(x)
                    i = w.find(a, i + 1)
        yield after
        rim = after


def meant(word: str, counts: dict[str, int]) -> str | None:
    """What a word was before it was misread, or None: the most frequent known word that one or two confusions away is RATIO times as frequent."""
    own = counts.get(word, 1)
    for some in confused(word):
        best = max(some, key=lambda x: counts.get(x, 0), default=None)
        if best is not None and counts.get(best, 0) >= RATIO * own:
            return best
    return None


class Known:
    """The vocabulary as a worker knows it. counts: the words seen `least` times or more; bad: what those of them were that are misread; told: count (0 for one seen once at most) and true form of
    further words. What none of them settles is noted in asks; until it is told, its count is 0 and it is no misreading."""

    def __init__(self, counts: dict[str, int], bad: dict[str, str], least: float) -> None:
        self.counts, self.bad, self.least = counts, bad, least
        self.told: dict[str, tuple[int, str | None]] = {}
        self.asks: set[str] = set()

    def n(self, word: str) -> int:
        if word in self.counts or self.least <= 2:
            return self.counts.get(word, 0)
        if word not in self.told:
            self.asks.add(word)
            return 0
        return self.told[word][0]

    def meant(self, word: str) -> str | None:
        if word in self.counts:
            return self.bad.get(word)  # whatever is RATIO times as frequent is in counts too
        if self.least <= 2:
            return meant(word, self.counts)
        if word in self.told:
            return self.told[word][1]
        near = next(confused(word), [])
        best = max(near, key=lambda x: self.counts.get(x, 0), default=None)
        if best is None or self.counts.get(best, 0) >= RATIO * self.least:
            return best
        self.asks.add(word)
        return None


def looked_up(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n, right) for each of asked (word), which are distinct: its count in words (word, n) and what meant() makes of it there, by a join of the words one and two confusions away with the counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["asked", "word", "level", "place"]
        for b in batches:
            rows: list[tuple[str, str, int, int]] = []
            for w in b["word"]:
                rows.append((w, w, 0, 0))
                for level, some in enumerate(confused(w), 1):
                    rows += [(w, x, level, k) for k, x in enumerate(some)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols)

    tried = asked.mapInPandas(run, "asked string, word string, level int, place int").join(words, "word", "left")
    near = F.collect_list(F.when((F.col("level") > 0) & F.col("n").isNotNull(), F.struct("level", (-F.col("n")).alias("less"), "place", "word"))).alias("near")
    one = tried.groupBy("asked").agg(F.max(F.when(F.col("level") == 0, F.col("n"))).alias("n"), near)
    return one.select(F.col("asked").alias("word"), F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"array_min(filter(near, x -> x.less <= -{RATIO} * coalesce(n, 1))).word").alias("right"))


@dataclass
class Repair:
    """kinds: what was found; text: the repaired paragraphs."""

    kinds: set[str] = field(default_factory=set)
    text: str = ""


def _line_parts(lines: list[str], titles: list[str], repeated: set[int], numbered: set[int], pages: range | None, found: Repair) -> list[str | None]:
    """The lines of running text; None for lines that were headers, footers or page numbers. repeated: lines that come back in the book; numbered: lines whose number runs on over its pages."""
    out: list[str | None] = []
    middle = len(lines) / 2
    for i, line in enumerate(lines):
        bare, number = line, False
        if m := _BESIDE.search(line):
            n = int(m[1] or m[2])
            if pages is None or n in pages or i in numbered:
                bare, number = line[: m.start()] + line[m.end() :], True
        titled = title_like(bare)
        if i in repeated or (titled and any(alike(plain(bare), t) for t in titles)):
            if titled or i < middle:  # what comes back at the foot goes too, but is no header
                found.kinds.add("header")
            if number:
                found.kinds.add("page_number")
            out.append(None)
            continue
        if m := _NUMBER.match(line):
            if m[1].isdigit():
                ok = int(m[1]) in pages if pages is not None else bool(_DECORATED.match(line))
            else:
                ok = pages is not None and m[1].lower() == m[1] and roman(m[1]) in pages
            if ok or i in numbered:
                found.kinds.add("page_number")
                out.append(None)
                continue
        out.append(line)
    return out


def _letters_at_end(s: str) -> str:
    m = re.search(r"[\w€¢ſ|!´`^-]*$", s)
    return re.split(r"['’]", m[0] if m else "")[-1]


def _letters_at_start(s: str) -> str:
    m = re.match(r"\s*([^\W\d_][\w€¢ſ|!´`^-]*)", s)
    return m[1] if m else ""


def _broken(left: str, right: str, mark: str, known: Known) -> bool:
    """Whether the mark between two pieces breaks a word, and is no part of it."""
    if mark in "­¬":
        return True
    joined, compound = (left + right).lower(), f"{left}-{right}".lower()
    a, b = known.counts.get(joined, 0), known.counts.get(compound, 0)
    if not a and not b:
        a, b = known.n(joined), known.n(compound)
    if a or b:
        return a > b
    for w, yes in ((joined, True), (compound, False)):
        if known.meant(w):
            return yes
    if any([known.n(w) for w in (compound.rstrip("s"), compound + "s", compound + "e")]):  # a list: all that is not known is asked at once
        return False
    # neither is known: two words of their own are a compound
    own = [known.n(w.lower()) for w in (left, right)]
    return not (min(own) > 1 and len(left) > 2 and len(right) > 2)


def repair(content: str, titles: list[str], repeated: set[int], numbered: set[int], pages: range | None, known: Known, cache: dict[str, str | None]) -> Repair:
    found = Repair()
    lines = content.split("\n")
    body = [x for x in _line_parts(lines, titles, repeated, numbered, pages, found) if x is not None]
    paragraphs: list[str] = []
    run = ""
    width = max((len(x) for x in body), default=0)
    open_mark = False
    aside: list[str] = []
    for k, line in enumerate(body):
        bare = line.strip()
        if _CELL.match(line) or (_LABEL.match(line) and k + 1 < len(body) and _CELL.match(body[k + 1])):
            aside.append(bare)  # a small table set into the text, which goes on after it
            continue
        if not bare:
            if run and not open_mark:
                paragraphs.append(run)
                run = ""
            continue
        if open_mark:
            mark, left, right = run[-1], _letters_at_end(run[:-1]), _letters_at_start(bare)
            if left and right and any(c.isalpha() for c in left[-1:]):
                if _broken(left, right, mark, known):
                    found.kinds.add("hyphen")
                    run = run[:-1] + bare
                else:
                    run = run[:-1] + "-" + bare
            else:
                run = f"{run}{bare}" if left[-1:].isdigit() else f"{run} {bare}"
        else:
            run = f"{run} {bare}" if run else bare
        open_mark = bare[-1] in MARKS and len(bare) > 1 and bare[-2].isalnum()
        if not open_mark and bare[-1] in ".!?" and len(line) < 0.6 * width:
            paragraphs.append(run)
            run = ""
    if run:
        paragraphs.append(run)
    paragraphs += [" ".join(aside)] if aside else []
    out = []
    for k, p in enumerate(paragraphs):
        parts = re.split(r"([\s'’]+)", p)
        for i in range(0, len(parts), 2):
            word = _EDGE.sub("", parts[i])
            low = word.lower()
            if len(low) < 3 or (k == 0 and i == 0 and low == word and not known.n(low)) or (open_mark and k == len(paragraphs) - 1 and i >= len(parts) - 1):
                continue
            if low in cache:
                right = cache[low]
            else:
                right = _misread(low, word, known)
                if low not in known.asks:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[low] = right
            if right is not None:
                if word != low and not word[1:].islower() and word.upper() == word and not SIGN.search(word):
                    continue  # codes and names in capitals
                found.kinds.add("characters")
                new = right.capitalize() if word[0].isupper() else right
                parts[i] = parts[i].replace(word, new)
        out.append("".join(parts))
    found.text = "\n\n".join(out)
    return found


def _misread(low: str, word: str, known: Known) -> str | None:
    if not any(c.isalpha() for c in low):
        return None
    right = known.meant(low)
    if right is not None:
        return right
    if sum(c.isalpha() for c in low) >= 3 and (SIGN.search(low) or (DIGIT_INSIDE.search(word) and len(word) >= 5)):
        guess = low
        for a, z in CONFUSED:
            if not a.isalpha() or a in "ſﬁﬂﬀﬃﬄ":
                guess = guess.replace(a, z)
        return guess
    return None


def _edge_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page the lines that could be headers, footers or page numbers, by what they share with those of other pages.

    Title-like lines, wherever they stand (a text may go over several pages), by their halves, cut within SHIFT characters of the middle: a distorted character leaves one half as it is, also where it makes
    the line longer or shorter. Other lines at the edges by their halves and as a whole, with the line next to them inside the page. Short lines as a whole. Numbers at the edges by how far they are from
    the page's own, or where that is unknown, by themselves."""
    for b in batches:
        rows: list[tuple] = []
        for id_, book, start, end, content in zip(b["id"], b["book_id"], b["page_start"], b["page_end"], b["content"], strict=True):
            lines = content.split("\n")
            some = [i for i, x in enumerate(lines) if x.strip()]
            first = start if pd.notna(start) else end
            for k, i in enumerate(some):
                line, edge = lines[i], k < EDGE or k >= len(some) - EDGE
                if title_like(line):
                    p = re.sub(r"^\d+|\d+$", "", plain(line))
                    if len(p) >= 12:
                        for h in range(max(6, len(p) // 2 - SHIFT), len(p) // 2 + SHIFT + 1):
                            rows += [(id_, book, i, "<" + p[:h], "", id_, 0), (id_, book, i, ">" + p[-h:], "", id_, 0)]
                    else:
                        rows.append((id_, book, i, "=" + plain(_BESIDE.sub("", line)), "", id_, 0))  # with its digits: ARTICLE 1 and ARTICLE 2 are two lines
                elif edge and len(line) <= 100 and len(some) > 2 * EDGE and sum(c.isalpha() for c in line) >= 8:
                    p = plain(_BESIDE.sub("", line))
                    inside = plain(lines[some[k + 1] if k < EDGE else some[k - 1]])
                    h = len(p) // 2
                    where = "h" if k < EDGE else "f"
                    rows += [(id_, book, i, where + x, p, zlib.crc32(inside.encode()), 0) for x in ("<" + p[:h], ">" + p[-h:])]
                if edge and (m := _NUMBER.match(line) or _BESIDE.search(line)):
                    n = next((x for x in m.groups() if x), "")
                    value = int(n) if n.isdigit() else roman(n) if n == n.lower() else 0
                    if value and pd.isna(first):
                        rows.append((id_, book, i, "v", "", 0, value))
                    elif value:
                        rows.append((id_, book, i, "o", "", 0, value - int(first)))
        yield pd.DataFrame(rows, columns=["id", "book_id", "line", "half", "whole", "near", "number"]).astype({"id": "int64", "book_id": "int64", "line": "int32", "near": "int64", "number": "int64"})


def edge_marks(pages: DataFrame) -> DataFrame:
    """(id, lines, numbered): the lines of each page that come back on REPEATED pages of their book or more (those not title-like only where most of what shares a half with them is the same line, beside as many
    different texts), and those with a number that runs on: as far from the page's own as half of the book's numbers are, or among its neighbours. Pages without book are left out; each page is one row."""
    cols = "id bigint, book_id bigint, line int, half string, whole string, near bigint, number bigint"
    marks = written(pages.filter("book_id IS NOT NULL").select("id", "book_id", "page_start", "page_end", "content").mapInPandas(_edge_lines, cols))
    lines = marks.filter("half NOT IN ('o', 'v')")
    same = lines.groupBy("book_id", "half", "whole").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("near").alias("near"))
    counts = written(same.groupBy("book_id", "half").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("near").alias("near")))
    often = counts.filter((F.col("near") >= REPEATED) & (2 * F.col("most") >= F.col("n"))).select("book_id", "half")
    back = join_unique(lines.select("id", "book_id", "half", "line"), often, ["book_id", "half"], counts, "n").select("id", "line", F.lit(False).alias("number"))
    numbers = marks.filter("half IN ('o', 'v')").select("id", "book_id", "half", "number", "line")
    at = written(numbers.groupBy("book_id", "half", "number").agg(F.count(F.lit(1)).alias("n")))
    votes = at.filter("half = 'v'").select("book_id", "half", F.explode(F.array(*[F.col("number") + d for d in (-2, -1, 1, 2)])).alias("number"))
    runs = votes.groupBy("book_id", "half", "number").agg(F.count(F.lit(1)).alias("beside"))
    known = at.join(runs, ["book_id", "half", "number"], "left")
    holds = F.when(F.col("half") == "o", F.col("n") >= REPEATED).otherwise(F.coalesce("beside", F.lit(0)) >= 2)
    share = at.filter("half = 'v' OR number <> 0").groupBy("book_id", "half").agg(F.sum("n").alias("all"))
    one = known.filter(holds & ((F.col("half") == "v") | (F.col("number") != 0))).join(share, ["book_id", "half"])
    by_book = one.filter("half = 'v'").groupBy("book_id", "half").agg(F.sum("n").alias("held"))
    runs_on = one.join(by_book, ["book_id", "half"], "left").filter(2 * F.when(F.col("half") == "o", F.col("n")).otherwise(F.col("held")) >= F.col("all")).select("book_id", "half", "number")
    numbered = join_unique(numbers, runs_on, ["book_id", "half", "number"], at, "n").select("id", "line", F.lit(True).alias("number"))
    each = back.unionByName(numbered).groupBy("id")
    return each.agg(F.collect_set(F.when(~F.col("number"), F.col("line"))).alias("lines"), F.collect_set(F.when(F.col("number"), F.col("line"))).alias("numbered"))


def repaired(chunks: DataFrame) -> DataFrame:
    """(id, book_id, page_start, page_end, kinds, text) of the chunks that are scanned pages (section_type `page`, whatever its case), one row for each id, from the row loaded first. Null contents are left out; an empty one
    gives an empty text. Without page columns, a printed number is known by its run over the book's pages or by the signs around it; without titles, headers only by their repetition."""
    spark = chunks.sparkSession
    cols = ["id", "book_id", "book_title", "chapter_title", "page_start", "page_end", "content"]
    pages = chunks.filter("lower(trim(section_type)) = 'page' AND content IS NOT NULL AND id IS NOT NULL")
    pages = written(spread(one_record(pages, "id", *cols[1:])))
    words = written(count_words(pages))  # read twice or more
    total = words.agg(F.sum("n").alias("t")).first()["t"] or 0
    least = max(2, total / VOCABULARY)
    words = words.filter("n >= 2")
    frequent = words.filter(F.col("n") >= least).toPandas()  # at most VOCABULARY words
    counts = dict(zip(frequent["word"].tolist(), frequent["n"].tolist(), strict=True))
    vocabulary = spark.sparkContext.broadcast(counts)

    def misread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, x) for w in b["word"] if (x := meant(w, vocabulary.value)) is not None], columns=["word", "right"])

    wrong = words.filter(F.col("n") >= least).select("word").repartition(spark.sparkContext.defaultParallelism).mapInPandas(misread, "word string, right string").toPandas()
    shared = spark.sparkContext.broadcast((counts, dict(zip(wrong["word"].tolist(), wrong["right"].tolist(), strict=True))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(*shared.value, least)
        cache: dict[str, str | None] = {}
        for b in batches:
            kinds, texts, asks = [], [], []
            for r in b.itertuples():
                first = r.page_start if pd.notna(r.page_start) else r.page_end
                last = r.page_end if pd.notna(r.page_end) else first
                pages = None if pd.isna(first) else range(int(first), int(max(first, last)) + 1)
                titles = [plain(t) for t in (r.book_title, r.chapter_title) if t]
                known.asks = set()
                known.told = {w: (int(n), x or None) for n, w, x in (t.split(" ") for t in r.told)} if r.told is not None else {}
                held = [set(x) if x is not None else set() for x in (r.lines, r.numbered)]
                done = repair(r.content, titles, *held, pages, known, cache)
                asks.append(sorted(known.asks))
                kinds.append(sorted(done.kinds))
                texts.append("" if known.asks else done.text)
            yield pd.DataFrame({"id": b["id"], "book_id": b["book_id"], "page_start": b["page_start"], "page_end": b["page_end"], "kinds": kinds, "text": texts, "asks": asks})

    schema = "id bigint, book_id bigint, page_start int, page_end int, kinds array<string>, text string, asks array<string>"
    marked = pages.join(edge_marks(pages), "id", "left")
    if least <= 2:  # the workers know all words
        return marked.withColumn("told", F.lit(None).cast("array<string>")).mapInPandas(run, schema).drop("asks")
    marked = written(marked)
    todo, told, done = marked.withColumn("told", F.lit(None).cast("array<string>")), None, []
    while True:  # twice; once more only where the pieces of a word over three lines or more, none with a blank, were not known
        out = written(todo.mapInPandas(run, schema))
        done.append(out.filter("size(asks) = 0").drop("asks"))
        asks = out.select("id", F.explode("asks").alias("word"))
        if asks.isEmpty():
            return reduce(DataFrame.unionByName, done)
        asked = written(asks.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        answers = join_unique(asks, looked_up(asked.select("word"), words), ["word"], asked, "n")
        # no word has a blank
        now = written(answers.select("id", F.concat_ws(" ", F.col("n").cast("string"), "word", F.coalesce("right", F.lit(""))).alias("told")))
        told = now if told is None else told.unionByName(now)
        ids = out.filter("size(asks) > 0").select("id")
        todo = marked.join(ids, "id", "left_semi").join(told.groupBy("id").agg(F.collect_list("told").alias("told")), "id")
