"""Personal information in free text: found by a linear-chain conditional random field over the shapes of words, and replaced by typed placeholders.

Every token of every text is scored and decoded; nothing chooses beforehand where a mention could be. The tokens of a batch of texts are numbers in one array: what a token says by its word and shape
is a row of a table, added up over its neighbours, and Viterbi runs over many stretches of the texts at once. Stretches overlap by more tokens than a mention has; each half of an overlap
counts as the stretch says in which it lies further inside.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.llm.crf import Crf
from quire.llm.pii_examples import KINDS, STREET_EN, STREET_FR, examples
from quire.session import spread

#: Rows of the labelled table, its seed, and rounds of training.
EXAMPLES, SEED, ROUNDS = 3200, 5, 60
TAGS = ["O", "name+", "name", "address+", "address", "email", "phone", "id_number"]
#: How the at sign and the dots of an address are written, also to evade robots.
AT = re.compile(r"[ ]?@[ ]?|\s?[\[({](?:at|arobase)[\])}]\s?|\s(?:arobase|AT)\s")
_DOT = r"(?:\.|\s?\[(?:dot|point)\]\s?|\s?\((?:dot|point)\)\s?|\s(?:DOT|POINT)\s)"
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-zA-Z]{{2,}}")
_LOCAL_DOT = re.compile(r"(?:^|(?<=[^\w.+%-]))\w[\w+%-]*\s?(?:\[(?:dot|point)\]|\((?:dot|point)\)|DOT|POINT)\s?$")
_LETTERS = r"[^\W\d_]"
NUMBER = r"(?<![\w])\+?\(?\d+(?:\)?(?:[ ./-]|[ ]?\(0\)[ ]?)\(?\d+\)?|\)\d+)*(?![^\W_])"
CODE = r"(?<!\w)(?:\d{2}[A-Z]{2}\d{5}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D])(?!\w)"
ELISION = rf"(?<!\w)(?:[lLdDnNsScCjJmM]|[Qq]u)['’](?={_LETTERS})"
INITIAL = r"(?<!\w)[A-ZÀ-Ý]\.(?:-[A-ZÀ-Ý]\.)?(?=\s)"
WORD = rf"(?:{_LETTERS}|\d)+(?:['’-]{_LETTERS}+)*(?:(?<=\bSt|\bRd|\bMr|\bDr|\bMe|\bPr|rs|\bMs)\.)?"
#: Together these cover a text without a gap; the first two are most of it.
TOKEN = re.compile(rf"[a-zß-öø-ÿœ]{{2,}}(?![\w'’-])|[^\S\n]+|{CODE}|{NUMBER}|{ELISION}|{INITIAL}|{WORD}|\n+|[\s\S]")
_GROUPS = [(re.compile(x), g) for x, g in ((r"\n+", "line"), (r"\s+", "space"), (CODE, "code"), (NUMBER, "number"), (r"(?:[lLdDnNsScCjJmM]|[Qq]u)['’]", "elision"), (r"[A-ZÀ-Ý]\.(?:-[A-ZÀ-Ý]\.)?", "initial"), (WORD, "word"))]
#: Tokens of a stretch that is decoded at once, how many it shares with the next, and characters that are worked on together.
LONGEST, OVERLAP, TOGETHER = 192, 40, 1_000_000


#: What every way to write the at sign holds.
_SIGNS = ("@", "arobase", "(at)", "[at]", "{at}", "AT")


def _ats(text: str) -> list[re.Match[str]]:
    """Where AT matches: signs are looked for as such, which is faster than the pattern."""
    out: list[re.Match[str]] = []
    places = []
    for sign in _SIGNS:
        i = text.find(sign)
        while i >= 0:
            places.append(i)
            i = text.find(sign, i + 1)
    for i in sorted(places):
        m = next((m for a in range(max(0, i - 2), i + 1) if (m := AT.match(text, a)) and m.end() > i), None)
        if m and (not out or m.start() >= out[-1].end()):
            out.append(m)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Where addresses stand, however their signs are written."""
    out: list[tuple[int, int]] = []
    for m in _ats(text):
        a = m.start()
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        while a < m.start() and not (text[a].isalnum() or text[a] == "_"):
            a += 1
        d = _DOMAIN.match(text, m.end())
        if a == m.start() or not d:
            continue
        while before := _LOCAL_DOT.search(text, max(0, a - 80), a):  # a part of a local name has 64 characters at most
            a = before.start()
        if not out or a >= out[-1][1]:
            out.append((a, d.end()))
    return out


def cut(text: str) -> tuple[list[str], list[int]]:
    """The tokens of a text, blanks included, and which of them are addresses."""
    spans = emails(text)
    if not spans:
        return TOKEN.findall(text), []
    out, own, at = [], [], 0
    for a, z in spans:
        out += TOKEN.findall(text, at, a)
        own.append(len(out))
        out.append(text[a:z])
        at = z
    return out + TOKEN.findall(text, at), own


def group_of(token: str) -> str:
    return next((g for p, g in _GROUPS if p.fullmatch(token)), "sign")


def _shape(token: str, group: str) -> tuple[str, str]:
    """A coarse and a fine shape."""
    if group == "email":
        return "@", "@" + ("" if "@" in token and " " not in token else "~")
    if group == "code":
        return "C", "C" + ("s" if " " in token else "")
    if group == "number":
        d = re.findall(r"\d+", token)
        n = sum(map(len, d))
        lead = "+" if token[0] == "+" else "(" if token[0] == "(" else "0" if token[0] == "0" else ""
        seps = "".join(sorted(set(re.sub(r"[\d()+]", "", token))))
        return f"N{min(n, 16)}{lead}", "N" + lead + "/".join(str(len(x)) for x in d[:9]) + seps
    if group == "line":
        return "nl", "nl"
    if group == "elision":
        return "l'", "l'"
    if group == "initial":
        return "A.", "A."
    if group == "sign":
        return token, token
    parts = re.split(r"['’-]", token.rstrip("."))

    def one(p: str) -> str:
        if p.isdigit():
            return "9"
        if any(c.isdigit() for c in p):
            return "9A" if p[0].isdigit() else "A9"
        return "AA" if p.isupper() and len(p) > 1 else "A" if p.isupper() else "Aa" if p[0].isupper() and p[1:].islower() else "aa" if p.islower() else "aA"

    coarse = "-".join(one(p) for p in parts[:3] if p)
    return coarse, coarse + str(min(len(token), 9))


class _Rows(dict):
    """The row of each token's word and shape in the tagger's tables; a marked address has a key of its own. Forgotten when there are many, so that a worker's memory stays bounded."""

    def __init__(self, tagger: Tagger) -> None:
        super().__init__()
        self.tagger = tagger
        self.ids: list[tuple[int, int, int]] = []
        self.groups: list[str] = []
        self.scores = np.zeros((len(Tagger.OFFSETS), 0, len(TAGS)), np.float32)
        self[None] = self._add(tagger.beyond, "beyond")

    def _add(self, ids: tuple[int, int, int], group: str) -> int:
        self.ids.append(ids)
        self.groups.append(group)
        return len(self.ids) - 1

    def __missing__(self, key: str | tuple[str] | None) -> int:
        token, group = (key[0], "email") if isinstance(key, tuple) else (key, group_of(key))
        t = self.tagger
        c, f = _shape(token, group) if group != "space" else ("", "")
        row = self[key] = self._add((t.words.get(token.lower(), 0), t.coarse.get(c, 0), t.fine.get(f, 0)), group)
        return row

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, 3) ids, and (offsets, rows, tags) what a token at each offset adds to a tag's score."""
        ids = np.array(self.ids, np.int64)
        have = self.scores.shape[1]
        if have < len(ids):
            self.scores = np.concatenate([self.scores, self.tagger.single(ids[have:])], axis=1)
        return ids, self.scores


class Tagger:
    """Tables of words and shapes known from the examples; 0 stands for all others."""

    OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
    OFFSETS_SHAPE = (-2, -1, 0, 1, 2)
    OFFSETS_FINE = (-1, 0, 1)
    PAIRS = 8192

    def __init__(self, rows: int = EXAMPLES, seed: int = SEED, rounds: int = ROUNDS) -> None:
        data = [(t, s, self.tokens(t)) for t, s in examples(rows, seed)]
        data = [x for x in data if len(x[2]) <= 72]
        count: dict[str, int] = {}
        coarse, fine = {"": 0}, {"": 0}
        for t, _, toks in data:
            for a, z, g in toks:
                w = t[a:z]
                c, f = _shape(w, g)
                coarse.setdefault(c, len(coarse))
                fine.setdefault(f, len(fine))
                if g in ("word", "sign", "initial"):
                    count[w.lower()] = count.get(w.lower(), 0) + 1
        spans = {t[a:z].lower() for t, s, toks in data for b, e, k in s if k == "name" for a, z, g in toks if a >= b and z <= e} - {"de", "la", "du", "van", "von", "le"}
        self.coarse, self.fine = coarse, fine
        self.words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in count.items() if n >= 3 and w not in spans))}
        self.beyond = (len(self.words) + 1, len(coarse), len(fine))
        self.sizes = [len(self.words) + 2] * len(self.OFFSETS) + [len(coarse) + 1] * len(self.OFFSETS_SHAPE) + [len(fine) + 1] * len(self.OFFSETS_FINE) + [self.PAIRS] * 4
        self.model = Crf(self.sizes, len(TAGS))
        self._rows: _Rows | None = None
        longest = max(len(toks) for _, _, toks in data)
        codes = np.zeros((len(data), longest, len(self.sizes)), np.int32)
        gold = np.zeros((len(data), longest), np.int64)
        lengths = np.zeros(len(data), np.int64)
        for i, (t, s, toks) in enumerate(data):
            lengths[i] = len(toks)
            own = [(self.words.get(t[a:z].lower(), 0), coarse[_shape(t[a:z], g)[0]], fine[_shape(t[a:z], g)[1]]) for a, z, g in toks]
            codes[i, : len(toks)] = self.codes(np.array([self.beyond] * 3 + own + [self.beyond] * 3, np.int64))[3:-3]
            for b, e, kind in s:
                own = [j for j, (a, z, _) in enumerate(toks) if a < e and z > b]
                for n, j in enumerate(own):
                    gold[i, j] = TAGS.index(kind + "+" if n == 0 else kind) if kind in ("name", "address") else TAGS.index(kind)
        self.model.fit(codes, gold, lengths, rounds)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_rows": None}

    @staticmethod
    def tokens(text: str) -> list[tuple[int, int, str]]:
        """(start, end, group) of the tokens of one text, without blanks."""
        toks, own = cut(text)
        marked, out, at = set(own), [], 0
        for i, t in enumerate(toks):
            group = "email" if i in marked else group_of(t)
            if group != "space":
                out.append((at, at + len(t), group))
            at += len(t)
        return out

    def pairs(self, coarse: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        """Numbers of the features over neighbouring shapes, for all tokens but the first and last."""
        mix = lambda *v: functools.reduce(lambda a, b: a * 1_000_003 + b, v) * 2654435761 % 4294967291 % self.PAIRS
        c0, c1, c2, w0 = coarse[:-2], coarse[1:-1], coarse[2:], word[:-2]
        before = mix(c0, c1)
        return [before, mix(c1, c2) ^ 1, mix(c0, c1, c2) ^ 2, mix(w0, c1, c2) ^ 3]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """(tokens, features) of a row of tokens; those at the first and last three are not meant to be used."""
        at = lambda column, o: np.roll(ids[:, column], -o)
        single = [at(0, o) for o in self.OFFSETS] + [at(1, o) for o in self.OFFSETS_SHAPE] + [at(2, o) for o in self.OFFSETS_FINE]
        wide = [np.pad(p, 1) for p in self.pairs(ids[:, 1], ids[:, 0])]
        return np.stack([*single, *wide], axis=1)

    def single(self, ids: np.ndarray) -> np.ndarray:
        """(offsets, tokens, tags): what a token adds to the score of the token that it stands at an offset from."""
        out = np.zeros((len(self.OFFSETS), len(ids), len(TAGS)), np.float32)
        features = [(0, o) for o in self.OFFSETS] + [(1, o) for o in self.OFFSETS_SHAPE] + [(2, o) for o in self.OFFSETS_FINE]
        for k, (column, o) in enumerate(features):
            out[self.OFFSETS.index(o)] += self.model.table[self.model.starts[k] + ids[:, column]]
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Mentions (start, end, kind) of each text, in order and apart."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        some: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t:
                some.append(i)
                size += len(t)
            if some and (size >= TOGETHER or i + 1 == len(texts)):
                self._find(texts, some, found)
                some, size = [], 0
        return found

    def _find(self, texts: list[str | None], some: list[int], found: list[list[tuple[int, int, str]]]) -> None:
        if self._rows is None or len(self._rows) > 300_000:
            self._rows = _Rows(self)
        rows = self._rows
        parts, sizes, counts = [], [], []
        beyond = np.full(3, rows[None], np.int64)
        for i in some:
            toks, own = cut(texts[i])
            row = np.fromiter(map(rows.__getitem__, toks), np.int64, len(toks))
            for j in own:
                row[j] = rows[(toks[j],)]
            parts += [beyond, row]
            sizes += [np.zeros(3, np.int64), np.fromiter(map(len, toks), np.int64, len(toks))]
            counts.append(len(toks) + 3)
        parts.append(beyond)
        sizes.append(np.zeros(3, np.int64))
        ids, single = rows.settled()
        row, size, text = np.concatenate(parts), np.concatenate(sizes), np.repeat(np.arange(len(some) + 1), [*counts, 3])
        end = np.cumsum(size)
        first = np.concatenate([[0], np.cumsum(counts)])  # where the tokens of each text begin, with what lies beyond it
        base = np.concatenate([[0], end])[first][text]
        groups = np.array(rows.groups, object)
        blank = np.array([g == "space" for g in rows.groups])[row]
        row, start, end, text = row[~blank], (end - size - base)[~blank], (end - base)[~blank], text[~blank]
        inner = slice(3, -3)
        n = len(row)
        scores = np.zeros((n, len(TAGS)), np.float32)
        for k, o in enumerate(self.OFFSETS):
            scores[inner] += single[k][row[3 + o : n - 3 + o]]
        for k, p in enumerate(self.pairs(ids[row, 1], ids[row, 0])):
            scores[1:-1] += self.model.table[self.model.starts[len(self.sizes) - 4 + k] + p]
        tags = self._decoded(scores, row != rows[None], text)
        hit = np.flatnonzero(tags)
        if not len(hit):
            return
        for run in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(text[hit]) > 0)) + 1):
            own = some[text[run[0]]]
            toks = list(zip(start[run].tolist(), end[run].tolist(), groups[row[run]].tolist(), strict=True))
            found[own] += _spans(texts[own], toks, tags[run])

    def _decoded(self, scores: np.ndarray, real: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The tag of each token, 0 for what lies beyond texts. Texts are cut into stretches that overlap."""
        at = np.flatnonzero(real)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(text[at])) + 1, [len(at)]])
        begins, ends = [], []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            b = np.arange(a, max(a + 1, z - OVERLAP), LONGEST - OVERLAP)
            begins.append(b)
            ends.append(np.minimum(b + LONGEST, z))
        begin, finish = np.concatenate(begins), np.concatenate(ends)
        lengths = finish - begin
        tags = np.zeros(len(scores), np.int8)
        order = np.argsort(lengths, kind="stable")
        same_text = np.append(text[at[begin[1:]]] == text[at[begin[:-1]]], False) if len(begin) else np.zeros(0, bool)
        follows = np.concatenate([[False], same_text[:-1]])
        for block in np.array_split(order, max(1, len(order) // 500)):  # stretches of about one length
            if not len(block):
                continue
            t = int(lengths[block].max())
            if not t:
                continue
            where = begin[block][:, None] + np.arange(t)
            inside = np.arange(t) < lengths[block][:, None]
            where = np.where(inside, where, 0)
            got = self.model.viterbi(scores[at[where]] * inside[..., None], lengths[block])
            half = OVERLAP // 2
            low = np.where(follows[block], half, 0)[:, None]
            high = np.where(same_text[block], lengths[block] - half, lengths[block])[:, None]
            use = (np.arange(t) >= low) & (np.arange(t) < high)
            tags[at[where[use]]] = got[use]
        return tags


def _spans(text: str, toks: list[tuple[int, int, str]], tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Mentions of a run of tagged tokens. A name has two parts or more, an address starts with its number, and what stands alone must have the form of its kind."""
    out = []
    j = 0
    while j < len(toks):
        kind = TAGS[tags[j]]
        if kind == "O":
            j += 1
            continue
        a, z, group = toks[j]
        base = kind.rstrip("+")
        k = j + 1
        if base in ("name", "address"):
            while k < len(toks) and TAGS[tags[k]] == base:
                k += 1
            own = toks[j:k]
            while own and own[-1][2] in ("sign", "line"):
                own = own[:-1]
            if base == "name":
                parts = [t for t in own if t[2] in ("word", "initial") and text[t[0]].isupper()]
                if len(parts) > 2 and text[own[0][0] : own[0][1]] == "M.":  # no initial but a title
                    own, parts = own[1:], parts[1:]
                    a = own[0][0]
                ok = len(parts) >= 2 and any(t[2] == "word" for t in parts)
            else:
                ok = len(own) >= 3 and text[a].isdigit()
            if ok:
                out.append((a, own[-1][1], base))
        elif base == "email":
            if group == "email":
                out.append((a, z, base))
        elif base == "phone":
            digits = sum(c.isdigit() for c in text[a:z])
            if group == "number" and 7 <= digits <= 15:
                out.append((a + (text[a] == "("), z, base))
        elif (group == "number" and sum(c.isdigit() for c in text[a:z]) >= 8) or group == "code" or (group == "word" and re.fullmatch(r"(?=.*\d.*\d.*\d)[A-Z0-9]{6,}", text[a:z])):
            out.append((a + (text[a] == "("), z, base))
        j = k
    return out


@functools.lru_cache(maxsize=2)
def tagger(rows: int = EXAMPLES, seed: int = SEED, rounds: int = ROUNDS) -> Tagger:
    return Tagger(rows, seed, rounds)


def redacted(text: str, mentions: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, z, kind in mentions:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of documents (doc_id, text); positions count characters from 0. Null and empty texts have none."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger())  # a few MB, of the size of the examples

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            rows = [(d, k, a, z) for d, found in zip(b["doc_id"], t.find(b["text"].tolist()), strict=True) for a, z, k in found]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"])

    return spread(documents.filter("doc_id IS NOT NULL").select("doc_id", "text")).mapInPandas(run, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def without_mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, text, mentions): the text with typed placeholders, and how many there are; null and empty texts stay as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            found = t.find(b["text"].tolist())
            texts = [redacted(x, f) if x else x for x, f in zip(b["text"], found, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "mentions": [len(f) for f in found]})

    return spread(documents.filter("doc_id IS NOT NULL").select("doc_id", "text")).mapInPandas(run, "doc_id bigint, text string, mentions int")


assert {t.rstrip("+") for t in TAGS[1:]} == set(KINDS) and STREET_EN  # tags and kinds agree
