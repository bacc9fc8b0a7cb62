"""Porter's stemmer as SQL, to compare the stemmed queries with: written from the algorithm, as conditions on patterns, apart from the library's own."""

from __future__ import annotations

from quire.functions.text import STEP2, STEP3, STEP4

_C, _V = "[^aeiouy]", "[aeiouy]"


def _more(stem: str, n: int) -> str:
    """The stem has more than n - 1 turns from vowels to consonants."""
    return f"regexp_matches({stem}, '^{_C}*" + f"{_V}+{_C}+" * (n - 1) + f"{_V}+{_C}')"


def _cut(n: int, s: str = "s") -> str:
    return f"left({s}, length({s}) - {n})"


_SHORT = f"regexp_matches({{}}, '{_C}{_V}[^aeiouywxY]$')"


def _table(endings: dict[str, str]) -> str:
    rules = " ".join(f"WHEN ends_with(s, '{e}') THEN CASE WHEN {_more(_cut(len(e)), 1)} THEN {_cut(len(e))} || '{to}' ELSE s END" for e, to in sorted(endings.items(), key=lambda x: -len(x[0])))
    return f"CASE {rules} ELSE s END"


def stems(words: str) -> str:
    """Common table expressions that end in `stems` (w, s), for a relation of distinct words (w). A y that is a consonant is a capital on the way."""
    vowel = lambda s: f"regexp_matches({s}, '{_V}')"
    step4 = " ".join(
        f"WHEN ends_with(s, '{e}') THEN CASE WHEN {_more(_cut(len(e)), 2)}" + (f" AND (ends_with({_cut(3)}, 's') OR ends_with({_cut(3)}, 't'))" if e == "ion" else "") + f" THEN {_cut(len(e))} ELSE s END" for e in sorted(STEP4, key=len, reverse=True)
    )
    e = _cut(1)
    return f"""
s0 AS (SELECT w, regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g') AS s FROM {words} WHERE strlen(w) BETWEEN 3 AND 64),
s1 AS (SELECT w, CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN {_cut(2)} WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN {_cut(1)} ELSE s END AS s FROM s0),
s2 AS (SELECT w, CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_more(_cut(3), 1)} THEN {_cut(1)} ELSE s END WHEN ends_with(s, 'ed') AND {vowel(_cut(2))} THEN {_cut(2)} || '|' WHEN ends_with(s, 'ing') AND {vowel(_cut(3))} THEN {_cut(3)} || '|' ELSE s END AS s FROM s1),
s3 AS (SELECT w, CASE WHEN NOT ends_with(s, '|') THEN s WHEN regexp_matches(s, '(at|bl|iz)\\|$') THEN {e} || 'e' WHEN regexp_matches(s, '{_C}\\|$') AND substr(s, length(s) - 1, 1) = substr(s, length(s) - 2, 1) AND NOT regexp_matches(s, '[lsz]\\|$') THEN {_cut(2)}
       WHEN {_more(e, 1)} AND NOT {_more(e, 2)} AND {_SHORT.format(e)} THEN {e} || 'e' ELSE {e} END AS s FROM s2),
s4 AS (SELECT w, CASE WHEN regexp_matches(s, '[yY]$') AND {vowel(e)} THEN {e} || 'i' ELSE s END AS s FROM s3),
s5 AS (SELECT w, {_table(STEP2)} AS s FROM s4),
s6 AS (SELECT w, {_table(STEP3)} AS s FROM s5),
s7 AS (SELECT w, CASE {step4} ELSE s END AS s FROM s6),
s8 AS (SELECT w, CASE WHEN ends_with(s, 'e') AND ({_more(e, 2)} OR ({_more(e, 1)} AND NOT {_SHORT.format(e)})) THEN {e} ELSE s END AS s FROM s7),
s9 AS (SELECT w, CASE WHEN ends_with(s, 'll') AND {_more(_cut(0), 2)} THEN {e} ELSE s END AS s FROM s8),
stems AS (SELECT w, lower(s) AS s FROM s9 UNION ALL SELECT w, w FROM {words} WHERE NOT strlen(w) BETWEEN 3 AND 64)"""
