"""Problem 5: template slots, filler, error pages and notices about scripts in place of content, or slots within it.

Labelled exemplars of residue (``residue_exemplars.tsv``, written from public notices and everyday wording) stand in an inverted index from
tokens to exemplars. A field is read as overlapping windows of tokens. For each window the exemplars that share the most TF-IDF weight with
it are retrieved; it is residue if they contain nearly all of its weight. A field is excluded if windows of residue cover nearly all
of its weight. Filler of invented words has no exemplar; its words, which hardly any field holds, are looked up by their endings instead. Unfilled slots are exemplars too: a marked run is reduced to its shape, looked up in the same index, and counts wherever it stands;
one in single brackets is a slot only if the exemplars of field names contain its words.

Document frequencies are those of the whole table, so a word such as "page" weighs little in a corpus about pages. They are counted by
hashed token, so words that no exemplar holds have their own weight as well.

Defined results: null, empty and blank fields, and the store's mark for an empty summary, are no residue; repeated rows are judged alike;
the source's own name in a title is left aside; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from importlib.resources import files

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import HAN, KANA, PLACEHOLDER, THAI, clean, map_rows, per_partition

#: Tokens of a window and from one window to the next; exemplars that together may contain a window; the share they must
#: contain, with weights and without; the share of a field that windows of residue must cover; the share of fields below which a rare token weighs no more.
WINDOW, STEP, TOGETHER, COVER, PLAIN, WHOLE, CAP = 12, 4, 3, 0.55, 0.65, 0.8, 0.003
#: Hashed document frequencies; tokens whose weight a task keeps at hand.
BUCKETS, KNOWN = 1 << 18, 300_000

_TOKEN = re.compile(rf"\d+|[{THAI}]+|[{HAN}{KANA}ー]+|[^\W\d_]+")
_DENSE = re.compile(f"[{THAI}{HAN}{KANA}]")
_RUNS_THAI, _RUNS_WIDE = re.compile(f"[{THAI}]+"), re.compile(f"[{HAN}{KANA}ー]+")
_SPACED = re.compile(rf"[^\W\d_{THAI}{HAN}{KANA}ー]+")
#: Runs between brackets, and between equal marks.
_BRACKETS = re.compile(r"([{][{%]*|[$#][{]|<%=?|<[?]=?|<<?|\[\[?|\(\(+)([^{}<>\[\]()%\n]{0,60}?)(\}\}+|[%]?\}|[%?]>|>>?|\]\]?|\)\)+)")
_LONG = re.compile(r"(.)\1{3,}")
_MARKED = re.compile(r"(?<![A-Za-z0-9_%#@~*])(%%?|__|@@|##?|~~|\*\*\*)([^\W\d_][\w.-]{0,40}?)\1(?![A-Za-z0-9_%#@~*])")
_WORDED = re.compile(r"\[object Object\]|(?<!\w)(?:undefined|UNDEFINED)(?!\w)")
_ANY_MARK = re.compile(r"[{<\[%@#~]|__|\(\(|\*\*\*|undefined|UNDEFINED")


@lru_cache(maxsize=1)
def exemplars() -> list[tuple[str, str, str]]:
    """``(kind, language, text)`` of each labelled exemplar."""
    rows = files(__package__).joinpath("residue_exemplars.tsv").read_text(encoding="utf-8").splitlines()
    return [(kind, lang, text) for kind, lang, _, text in (r.split("\t") for r in rows if r and not r.startswith("#"))]


def tokens(text: str) -> list[str]:
    """Words, figures as one token; of Thai each three characters, of Chinese and Japanese each character and each pair; ``text`` must be clean."""
    found = _TOKEN.findall(text)
    if not _DENSE.search(text):
        return [w if w > ":" else "#" for w in found]  # figures are 0-9 in a clean text
    out = []
    for w in found:
        c = w[0]
        if c < ":":
            out.append("#")
        elif c < "฀" or c > "\u9fff":
            out.append(w)
        elif c <= "๿":
            out += map("".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [w]
        else:
            out += w
            out += map("".join, zip(w, w[1:]))
    return out


def _inner(text: str) -> str:
    """The sort of text within marks: a capital name, a name, words, a figure or nothing."""
    if not text:
        return ""
    if text.isdigit():
        return "0"
    if not any(map(str.isalpha, text)):
        return "?"
    return "w" if re.search(r"\s", text) else "A" if text.upper() == text and text.lower() != text else "a"


def shapes(text: str) -> list[tuple[str, str, int]]:
    """``(shape, words within, start)`` of each marked run of a text; the words of a shape are reduced to their sort."""
    if not _ANY_MARK.search(text):
        return []
    out = []
    for m in _BRACKETS.finditer(text):
        if _WORDED.fullmatch(m.group()):
            continue
        a, words, b = _LONG.sub(r"\1\1\1", m.group(1)), m.group(2).strip(), _LONG.sub(r"\1\1\1", m.group(3))
        out.append((a + _inner(words) + b, words, m.start()))
    out += [(m.group(1) + _inner(m.group(2)) + m.group(1), m.group(2), m.start()) for m in _MARKED.finditer(text)]
    return out + [(m.group().lower(), "", m.start()) for m in _WORDED.finditer(text)]


@lru_cache(maxsize=4096)
def _clean_name(source: str) -> str:
    return clean(source).strip()


def _without(low: str, source: str | None) -> str:
    """A clean text without its source's own name."""
    name = _clean_name(source) if source else ""
    return re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", low) if name and name in low else low


def _bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % BUCKETS


class _Weights(dict):
    """Weights of tokens, each worked out when it is first asked for; emptied when full."""

    def __init__(self, df: np.ndarray, n: int) -> None:
        self.df, self.n = df, n

    def __missing__(self, token: str) -> float:
        if len(self) >= KNOWN:
            self.clear()
        got = self[token] = math.log(1 + self.n / max(1 + int(self.df[_bucket(token)]), self.n * CAP))
        return got


class ExemplarIndex:
    """Token -> exemplars, with weights from the hashed document frequencies ``df`` among ``n`` fields; without these all tokens weigh alike."""

    def __init__(self, df: np.ndarray | None = None, n: int = 0, cover: float | None = None) -> None:
        self.cover, self.df, self.n = cover or (PLAIN if df is None else COVER), df, max(n, 1)
        self.index: dict[str, list[int]] = {}
        self.kinds: list[str] = []
        self.slot_shapes: set[str] = set()
        self.field_words: set[str] = set()
        self.endings: set[str] = set()
        for kind, _, text in exemplars():
            if kind == "slot":
                self.slot_shapes |= {s for s, _, _ in shapes(text)}
                continue
            own = set(tokens(clean(text)))
            if kind == "field":
                self.field_words |= own
                continue
            if kind == "filler":
                self.endings |= {w[-2:] for w in own if len(w) > 3}
            for w in own:
                self.index.setdefault(w, []).append(len(self.kinds))
            self.kinds.append(kind)
        self.weights = None if df is None else _Weights(df, self.n)
        self.known = {w: 1.0 if self.weights is None else self.weights[w] for w in self.index}
        #: What a token weighs that hardly any field holds; unknown without frequencies.
        self.most = math.inf if df is None else math.log(1 + 1 / max(CAP, 1 / self.n))

    def _hopeless(self, low: str) -> bool:
        """Whether tokens that no exemplar holds surely make up too much of a text, all weighing alike: what is counted is at least the number of tokens, and at most
        that of known ones. Known ones of dense scripts are found by an automaton, so the others needn't be cut out."""
        words = _SPACED.findall(low)
        # each figure counts as a known token of its own
        n, known = len(words), sum(map(self.index.__contains__, words)) + sum(map(low.count, "0123456789"))
        if _DENSE.search(low):
            if self._machine is None:
                self._machine = ahocorasick.Automaton()
                for w in self.index:
                    if _DENSE.match(w):
                        self._machine.add_word(w, 1)
                self._machine.make_automaton()
            thai, wide = _RUNS_THAI.findall(low), _RUNS_WIDE.findall(low)
            n += sum(map(len, thai)) - 2 * len(thai) + 2 * sum(map(len, wide)) - len(wide)
            # runs too short for a token of the usual length count as known
            known += sum(len(w) < 3 for w in thai) * 2 + len(list(self._machine.iter(low)))
        return known < self.cover * n

    _machine: ahocorasick.Automaton | None = None

    def contained(self, words: list[str], weights: list[float]) -> tuple[float, str]:
        """The share of a window's weight that the exemplars retrieved for it contain together, and the kind of the best one."""
        total = sum(weights)
        hits: dict[int, float] = {}
        for w, x in zip(words, weights):
            for e in self.index.get(w, ()):
                hits[e] = hits.get(e, 0.0) + x
        if not hits or not total:
            return 0.0, ""
        best = sorted(hits, key=lambda e: (-hits[e], e))[:TOGETHER]
        held = sum(x for w, x in zip(words, weights) if any(e in best for e in self.index.get(w, ())))
        return held / total, self.kinds[best[0]]

    def _invented(self, words: list[str], weights: list[float], total: float) -> bool:
        """Whether a field is filler of invented words: all but all of them hardly ever met, and ending as the words of the filler exemplars do."""
        if weights[0] < self.most * 0.99 and weights[1] < self.most * 0.99 or len(set(words)) < 4:
            return False
        return sum(x for w, x in zip(words, weights) if x >= self.most * 0.99 and len(w) > 2 and w[-2:] in self.endings) >= WHOLE * total

    def slots(self, text: str) -> list[str]:
        """The unfilled slots of a text, by shape."""
        out = []
        for shape, words, _ in shapes(text):
            if shape in self.slot_shapes:
                out.append(shape)
            elif shape.strip("[](){}<>%?=$#") in ("a", "A", "w"):
                own = tokens(clean(words.replace("_", " ")))
                if own and sum(w in self.field_words for w in own) >= WHOLE * len(own):
                    out.append(shape)
        return out

    def judge(self, text: str | None, source: str | None = None) -> str | None:
        """``'slot'`` or ``'residue'`` for a field to be excluded, else ``None``."""
        if not text or text == PLACEHOLDER or text.isspace():
            return None
        return "slot" if self.slots(text) else self.judge_clean(clean(text), source)

    def is_residue(self, text: str, folded: str, source: str | None = None) -> bool:
        """Whether :meth:`judge` says ``'residue'``, for a text whose lower case with figures as ``0`` is at hand; most fields are told by that alone."""
        if self.weights is None and not any(c in text for c in "&\u200b\xad") and self._hopeless(_without(folded, source)):
            return False
        return self.judge(text, source) == "residue"

    def judge_clean(self, low: str, source: str | None = None) -> str | None:
        """The same for a clean text without slots."""
        low = _without(low, source)
        if self.weights is None and self._hopeless(low):
            return None
        words = tokens(low)
        if not words:
            return None
        if self.weights is None:
            weights = [1.0] * len(words)
        else:
            weights = list(map(self.weights.__getitem__, words))
        total = sum(weights)
        if len(words) >= 4 and self._invented(words, weights, total):
            return "residue"
        # what no exemplar holds can't be covered, so most fields need no window
        if sum(map(self.known.__getitem__, filter(self.known.__contains__, words))) < self.cover * total:
            return None
        n = len(words)
        covered = [False] * n
        for a in [*range(0, max(1, n - WINDOW), STEP), max(0, n - WINDOW)]:
            b = min(n, a + WINDOW)
            if self.contained(words[a:b], weights[a:b])[0] >= self.cover:
                covered[a:b] = [True] * (b - a)
        return "residue" if sum(x for x, c in zip(weights, covered) if c) >= WHOLE * total else None


@lru_cache(maxsize=1)
def _plain() -> ExemplarIndex:
    return ExemplarIndex()


def slots(text: str) -> list[str]:
    """The unfilled slots of a text."""
    return _plain().slots(text)


def without_slots(text: str) -> str:
    """A text with its unfilled slots blanked out."""
    for pattern in (_BRACKETS, _MARKED, _WORDED):
        text = pattern.sub(lambda m: " " if slots(m.group()) else m.group(), text)
    return text


@per_partition
def _count():
    held: Counter = Counter()
    counts = np.zeros(BUCKETS, np.int64)
    n = 0

    def flush() -> None:
        for w, k in held.items():
            counts[_bucket(w)] += k
        held.clear()

    def batch(*columns):
        nonlocal n
        for column in columns:
            for t in column:
                if t:
                    n += 1
                    held.update(set(tokens(clean(t))))
            if len(held) > KNOWN:
                flush()
        return {"bucket": [], "n": []}

    def close():
        flush()
        at = np.flatnonzero(counts)
        return {"bucket": [-1, *at.tolist()], "n": [n, *counts[at].tolist()]}

    batch.close = close
    return batch


def frequencies(df: DataFrame, fields: list[str]) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of all tokens over all fields of the table (``BUCKETS`` numbers, whatever its size), and the number of fields."""
    rows = map_rows(df.select(*fields), _count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, n = np.zeros(BUCKETS, np.int64), 0
    own = rows[rows["bucket"] >= 0]
    out[own["bucket"].to_numpy()] = own["n"].to_numpy()
    return out, int(rows.loc[rows["bucket"] < 0, "n"].sum())


def _judge(shared, n: int, fields: list[str]):
    @per_partition
    def make():
        index = ExemplarIndex(shared.value, n)

        def batch(ids, sources, *columns):
            out: dict[str, list] = {"rec": [], "field": [], "kind": []}
            for name, column in zip(fields, columns):
                for i, s, t in zip(ids, sources, column):
                    kind = index.judge(t, s)
                    if kind:
                        out["rec"].append(i)
                        out["field"].append(name)
                        out["kind"].append(kind)
            return out

        return batch

    return make


def residue(df: DataFrame, row_id: str = "ingest_seq", fields: tuple[str, ...] = ("title", "summary"), source: str = "source") -> DataFrame:
    """``(<row_id>, field, kind)`` for every field to be excluded; ``kind`` is ``slot`` or ``residue``."""
    names = list(fields)
    counts, n = frequencies(df, names)
    shared = df.sparkSession.sparkContext.broadcast(counts)
    out = map_rows(df.select(row_id, source, *names), _judge(shared, n, names), f"rec {dict(df.dtypes)[row_id]}, field string, kind string")
    return out.select(F.col("rec").alias(row_id), "field", "kind")
