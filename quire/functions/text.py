"""Text functions: terms, folding, stems, slugs, phrases. Columns where built-ins suffice; Python only for the stemmer, which runs on distinct terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case letters with marks and what they become without (fixed values).
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, BARE)


def terms(c: Column) -> Column:
    """The terms of a text: folded runs of letters and digits; an empty array for null."""
    return F.array_remove(F.split(folded(c), r"[^\p{L}\p{N}]+"), "")


def folded_word(s: str) -> str:
    return s.lower().translate(str.maketrans(MARKED, BARE))


def phrases(query: str) -> list[tuple[str, ...]]:
    """A query's words; one with punctuation inside is a phrase of its parts, which must stand side by side. Quotes count as blanks. Repeated words stay repeated."""
    out = []
    for word in query.replace('"', " ").split():
        parts = tuple(re.findall(r"[^\W_]+", folded_word(word)))
        if parts:
            out.append(parts)
    return out


def slug_part(c: Column) -> Column:
    """A path component: lower case, without underscores, other signs as single hyphens."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "_", ""), r"[^\p{L}\p{N}-]", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def book_slug(corpus: Column, path: Column) -> Column:
    """corpus-directories--file name; the extension is kept, and without directories and corpus only the name remains."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    folders = F.concat(F.array(corpus), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    prefix = F.array_join(F.filter(F.transform(folders, slug_part), lambda x: x != ""), "-")
    name = slug_part(F.element_at(parts, -1))
    return F.when(prefix == "", name).otherwise(F.concat_ws("--", prefix, name))


def slugify(c: Column) -> Column:
    """A title as a slug of at most 80 characters, without what stands in brackets."""
    x = F.trim(F.lower(F.regexp_replace(c, r"\([^)]*\)", "")))
    x = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s-]", ""), r"[-\s]+", "-")
    return F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, 80)


def content_hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 12)


def page_estimate(position: Column, per_page: int = 2500) -> Column:
    return F.greatest(F.lit(1), F.floor(position / per_page).cast("int") + 1)


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, blanks collapsed, of more than 20 characters; if there is none, the whole text."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    blocks = F.filter(F.transform(F.split(c, r"\n\s*\n"), squeeze), lambda x: F.length(x) > 20)
    whole = F.filter(F.array(squeeze(c)), lambda x: x != "")
    return F.when(F.size(blocks) > 0, blocks).otherwise(whole)


_VOWEL = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and _is_consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _is_consonant(w, len(w) - 1) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Endings of steps 2 to 4 of Porter's algorithm (fixed values).
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(w: str) -> str:
    """Porter's stemmer, for lower-case words; other signs than a to z count as consonants. Words of fewer than 3 bytes or more than 64 stay as they are."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
