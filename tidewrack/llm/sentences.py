"""Problem 7: sentence boundaries in eight languages by a hidden-event n-gram model.

Between the chunks of a line stands a hidden event: a boundary or none. An n-gram model over chunks and events gives the probability of a
boundary after what stands to the left (and after the event before it), and of what stands to the right given the event. Forward-backward over the
gaps of a line yields each gap's posterior. The model is trained by expectation-maximisation: line starts and ends are certain
boundaries, gaps that can't end a sentence are certain non-boundaries, the rest is hidden. So abbreviations, ordinals and the gaps of
scripts without stops are told apart by what is seen at the ends and starts of lines.

In a line with closing marks a gap is open to a boundary after such a mark and a space, after a full-width one, and at any space next to Thai. Nothing within
quotation marks or brackets is open; a line break always ends a sentence. In a line without any mark but at its end every place between words, and between
characters of scripts without spaces, is open: a second n-gram model (:class:`EventModel`) with boundary tokens between words, learned from the sentences that the first one
finds with their marks taken away, gives their posteriors.

Defined results: null, empty and blank texts have no sentences; positions are code points of the stored text, and a sentence starts at its first
character that is not white space; a text of one long line of any length is one chain; repeated rows give repeated results; empty tables
give an empty result. The model is fitted to all texts, equal ones once: what a round needs are sums over lines, made by the tasks, so the driver holds the counts of forms and n-grams only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import HAN, KANA, THAI, latin_digits, map_rows, per_partition
from tidewrack.runtime import remove, scratch

#: Rounds of expectation-maximisation; times that a context of lines without marks must have been met to be kept.
ROUNDS, MET = 5, 2
#: What separates the parts of a key, and the unit in which tasks hand on sums, so that these don't depend on their order.
_SEP, _UNIT_SUM = "\0", 1 << 20

#: Sums by kind and key of a pass over lines.
Sums = dict[str, dict[str, float]]

_WIDE = rf"{HAN}{KANA}"
_CLOSERS = "\"'”’»›」』）)\\]】"
_OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "[": "]", "‹": "›", "‚": "‘", "《": "》"}
_QUOTES = re.compile(r"[“”«»„「」『』（）()【】\[\]‹›《》\"]")
#: A gap open to a boundary: the start of the text after it is where a sentence may begin.
_GAP_MARK = rf"(?<=[.!?…])[{_CLOSERS}“]*(\s+)(?=\S)|[。！？!?．…][{_CLOSERS}]*(\s*)(?=[^\s{_CLOSERS}。！？!?．….,、，])"
_GAP = re.compile(
    _GAP_MARK + rf"|(?<=[{THAI}])[\"”»)\]]?(\s+)(?=\S)"
    rf"|(?<=\S)(\s+)(?=[\"“«(]?[{THAI}])"
)
#: The same where a line has no Thai, and what tells that.
_GAP_PLAIN, _THAI = re.compile(_GAP_MARK), re.compile(rf"[{THAI}]")
_ENDED = re.compile(r"(?<![.…])[.!?。！？．]\s*$")
#: What tells a line with marks: any closing mark before its last word; in Thai a space does.
_MARKED = re.compile(rf"[.!?…。！？．](?=.*[^\W_])|[{THAI}]\s|\s[{THAI}]")
#: Words, and single characters of scripts without spaces.
_UNIT = re.compile(rf"[{THAI}{_WIDE}]|\d+(?:[.,\u00a0\u202f]\d+)*|[^\W\d_{THAI}{_WIDE}]+(?:['’\-][^\W\d_{THAI}{_WIDE}]+)*")
_LETTER = re.compile(r"[^\W_]")
_CHUNK = re.compile(r"\S+")
_ABBREVIATION = re.compile(r"^(?:\w{1,3}\.|(?:\w\.)+)$")


def closed_spans(line: str) -> list[tuple[int, int]]:
    """Spans of a line within quotation marks or brackets, outermost only.

    One that isn't closed reaches to the end if the line breaks off within it, without a closing mark; where the line is complete the mark is a stray one.
    """
    if not _QUOTES.search(line):
        return []
    out, stack, start = [], [], 0
    for m in _QUOTES.finditer(line):
        c, at = m.group(), m.start()
        if stack and c == stack[-1]:
            stack.pop()
            if not stack:
                out.append((start, at))
        elif c == '"' or c in _OPEN:
            if not stack:
                start = at
            stack.append('"' if c == '"' else _OPEN[c])
    if stack and not _ENDED.search(line):
        out.append((start, len(line)))
    return out


def gaps(line: str) -> list[tuple[int, int]]:
    """``(end of what stands to the left, start of what stands to the right)`` of each open gap."""
    spans = closed_spans(line)
    out, k = [], 0
    for m in (_GAP if _THAI.search(line) else _GAP_PLAIN).finditer(line):
        b = left = m.end()
        if b >= len(line):
            continue
        while left and line[left - 1].isspace():
            left -= 1
        if not _LETTER.search(line, out[-1][1] if out else 0, left):
            continue
        while k < len(spans) and spans[k][1] < b - 1 and spans[k][1] < left - 1:
            k += 1
        if any(s < left - 1 and b - 1 < e for s, e in spans[max(0, k - 1) : k + 2] if not e == left - 1):
            continue
        out.append((left, b))
    return out


_DIGIT, _FIGURE, _STOP = re.compile(r"\d"), re.compile(r"\d+(?:[.,\u00a0\u202f]\d+)*"), re.compile(r"[.!?…]+\W*$")


def _masked(s: str) -> str:
    return _FIGURE.sub("0", latin_digits(s)) if _DIGIT.search(s) else s


def _spaced(c: str) -> bool:
    """Whether a character is a letter or figure of a script with spaces; of those that sort after Thai only some are told."""
    return c.isalnum() and (c < "\u0e00" or "\u1e00" <= c < "\u2000")


def _shape(w: str) -> str:
    c = w.strip("\"'“”«»„‘’「『（([-")
    if not c:
        return "punct"
    if c[0].isdigit():
        return "digit"
    if c[0].isupper():
        return "Upper" + str(min(3, len(c))) if len(c) < 4 else "Upper"
    return "lower" + str(min(4, len(c)))


_DENSE_END = re.compile(rf"[{THAI}{_WIDE}。！？、，」』”]\W*$")
_WIDE_END = re.compile(rf"[。！？．][{_CLOSERS}]*$")
_DENSE_START = re.compile(rf"^\W*[{THAI}{_WIDE}]")


@lru_cache(maxsize=50_000)
def _left_word(last: str) -> tuple[str, str, bool]:
    """Forms of a word before a gap, and whether the word before it matters too."""
    m = _STOP.search(last)
    ends = m.group() if m else "-"
    core = last[: len(last) - len(ends)] if m else last
    kind = "abbr" if _ABBREVIATION.match(last) else _shape(core)
    return "w" + _masked(last.lower()), f"s{kind}|{ends}", core[:1].isdigit()


@lru_cache(maxsize=50_000)
def _right_word(first: str) -> tuple[str, str]:
    lead = first[0] if first and not first[0].isalnum() else ""
    return "w" + _masked(first), f"s{lead}{_shape(first)}"


def left_features(line: str, end: int) -> tuple[str, str]:
    """Specific and general form of what stands before a gap."""
    tail = line[max(0, end - 40) : end]
    # neither pattern ends in a letter of a script with spaces, nor in one and a full stop
    if tail and not (_spaced(tail[-1]) or tail[-1] in ".!?" and _spaced(tail[-2:-1])):
        if m := _WIDE_END.search(tail):
            # an open full-width mark needs no further context, one before a closing quotation mark does
            return "d" + (_masked(tail)[-4:] if len(m.group()) > 1 else m.group()), "d" + m.group()
        if _DENSE_END.search(tail):
            t = _masked(tail)
            return "d" + t[-6:], "d" + t[-3:]
    w = tail.split()
    specific, general, figure = _left_word(w[-1] if w else "")
    if figure and len(w) > 1:
        specific = "w" + _masked(f"{w[-2]} {w[-1]}".lower())
    return specific, general


def right_features(line: str, start: int) -> tuple[str, str]:
    """Specific and general form of what stands after a gap."""
    head = line[start : start + 40]
    if not _spaced(head[:1]) and _DENSE_START.match(head):
        t = _masked(head)
        return "d" + t[:6], "d" + t[:3]
    w = head.split(None, 1)
    return _right_word(w[0] if w else "")


def _dense(unit: str) -> bool:
    return len(unit) == 1 and bool(_DENSE_START.match(unit))


def _within(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys if len(ordered) else np.zeros(len(keys), bool)


#: Odd numbers that make the hash of an n-gram of those of its units, by the distance from the gap; the last one tells lengths apart.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LENGTH = np.arange(10, dtype=np.uint64) * _MIX[4:]
#: Kinds of counts of the event model: contexts of a side are of kind ``2 * side``, single units of ``2 * side + 1``; gaps in all, and after a boundary, by script.
_TOTAL, _PAIRS = 4, 6


class _Codes(dict):
    """Numbers of units as they are met, with figures masked, and the hash, the script and the shape's hash of each number."""

    MOST = 500_000

    def __init__(self) -> None:
        self.hashes: list[int] = []
        self.dense: list[bool] = []
        self.shapes: list[int] = []

    def __missing__(self, unit: str) -> int:
        if unit[0].isdigit() and unit != "0":
            self[unit] = k = self["0"]
            return k
        self[unit] = k = len(self.hashes)
        for out, x in ((self.hashes, unit), (self.shapes, _shape(unit))):
            out.append(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        self.dense.append(_dense(unit))
        return k

    def arrays(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, scripts and shapes of units given by number; where there are too many they are numbered anew afterwards."""
        k = np.array(ids, np.int64)
        out = np.array(self.hashes, np.uint64)[k], np.array(self.dense, bool)[k], np.array(self.shapes, np.uint64)[k]
        if len(self) > self.MOST:
            self.clear()
            self.__init__()
        return out


def _grams(side: int, hashes: np.ndarray, dense: np.ndarray, shapes: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """``(hash, whether it is there)`` of the contexts of each unit's gap, from general to specific: its shape, then more and more units (of characters up to
    four); and the length of each unit's core. The gap is after the unit at side 0 and before it at side 1; ``before`` and ``after`` are the numbers of units there are in its line.
    """
    n = len(hashes)
    there, most = (before, after)[side], np.where(dense, 4, 2)
    out = [(shapes * _MIX[0] + _LENGTH[9], np.ones(n, bool))]
    key = np.zeros(n, np.uint64)
    for k in range(4):
        moved = np.zeros(n, np.uint64)
        if k < n:
            moved[slice(n - k) if side else slice(k, n)] = hashes[slice(k, n) if side else slice(n - k)]
        key = key + moved * _MIX[k]
        out.append((key + _LENGTH[k + 1], (there >= k) & (most > k)))
    return out, np.where(dense, 3, 1)


class Contexts:
    """Boundaries and gaps of contexts, looked up by their hashes."""

    def __init__(self, side: int, keys=(), b=(), n=()) -> None:
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys)
        self.side, self.hashes = side, keys[order]
        self.b, self.n = (np.array(x, np.float64)[order] for x in (b, n))

    def __len__(self) -> int:
        return len(self.hashes)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self) - 1)
        same = self.hashes[at] == keys
        return np.where(same, self.b[at], 0.0), np.where(same, self.n[at], 0.0)

    def keys(self) -> set[int]:
        return set(self.hashes.tolist())

    def __getitem__(self, units: tuple[str, ...]) -> tuple[float, float]:
        codes, k = _Codes(), 0 if self.side else len(units) - 1
        place = np.arange(len(units))
        grams, _ = _grams(self.side, *codes.arrays([codes[u] for u in units]), place, place[::-1])
        (b,), (n,) = self.found(grams[len(units)][0][k : k + 1])
        if not n:
            raise KeyError(units)
        return float(b), float(n)


class EventModel:
    """Boundaries between the units of a text without marks: counts of boundary tokens after and before n-grams of units.

    A context's core is its word, or three characters, next to the gap. Without a core that was met at a boundary on its left a gap is none, and on its right the
    longer contexts aren't asked, so only contexts whose core, or which as a part of one, stood at a boundary are counted, and of words to the right whether they are known.
    """

    #: Weight of shorter contexts against longer ones.
    K = 1.0

    def __init__(self) -> None:
        self.met = [Contexts(0), Contexts(1)]
        self.prior = {True: 0.02, False: 0.05}
        self.after = {True: 0.0, False: 0.0}  # what a boundary before a gap does to its log odds

    @staticmethod
    def units(line: str) -> list[tuple[str, int]]:
        """Units with figures masked, and where they start."""
        return [("0" if m.group()[0].isdigit() else m.group(), m.start()) for m in _UNIT.finditer(line)]

    @staticmethod
    def counted(lines: list[tuple[list[str], bool]], codes: _Codes, live: list[np.ndarray] | None) -> tuple[np.ndarray, ...]:
        """``(kind, key, n, b)``: gaps and boundaries at contexts. ``lines`` are sentences and whether the line ends with a mark; one that doesn't may be cut off, so its
        end says nothing. Without ``live``, sorted hashes by side, what the cores that stand at boundaries are made of; with it, all contexts that matter.
        """
        ids: list[int] = []
        begins: list[int] = []
        own_sizes: list[int] = []
        for sentences, _ in lines:
            first = len(ids)
            for x in sentences:
                begins.append(len(ids))
                ids.extend(map(codes.__getitem__, _UNIT.findall(x)))
            own_sizes.append(len(ids) - first)
        hashes, dense, shapes = codes.arrays(ids)
        total = len(ids)
        start, sizes = np.zeros(total + 1, bool), np.array(own_sizes, np.int64)
        start[np.array(begins, np.int64)] = True
        before = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        after, start = np.repeat(sizes, sizes) - 1 - before, start[:total] | (before == 0)
        ending = np.append(start[1:], True) | (after == 0) if total else np.zeros(0, bool)
        kinds, keys, ns, bs = [], [], [], []

        def add(kind: int, key: np.ndarray, hit: np.ndarray) -> None:
            coded = pa.array(key).dictionary_encode()
            own, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            kinds.append(np.full(len(own), kind))
            keys.append(own)
            ns.append(np.bincount(at, minlength=len(own)))
            bs.append(np.bincount(at, hit, len(own)).astype(np.int64))

        open_end = (after == 0) & ~np.repeat(np.array([x for _, x in lines], bool), sizes)
        for side, hit in enumerate((ending, start)):
            here = ~open_end if side == 0 else np.ones(total, bool)
            grams, core = _grams(side, hashes, dense, shapes, before, after)
            if live is not None:
                known = [_within(live[side], key) & there for key, there in grams[1:4]]
                of_core = np.where(dense, known[2], known[0])
            for k, (key, there) in enumerate(grams):
                there = there & here
                if live is None:
                    if not 0 < k <= 3:
                        continue
                    there &= hit & (core >= k)
                elif k:
                    there &= np.where(core >= k, known[k - 1] | (~dense if side else False), of_core) if k < 4 else of_core
                add(2 * side + (k == 1), key[there], hit[there])
        if live is not None and total:
            inner = before > 0
            follows = inner & (np.append([False], start[:-1]) | (before == 1))
            for kind, own in ((_TOTAL, inner), (_PAIRS, follows)):
                for d in (0, 1):
                    at = own & (dense == bool(d))
                    add(kind + d, np.zeros(at.sum(), np.uint64), start[at])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kinds, keys, ns, bs))

    def told(self, kinds: np.ndarray, keys: np.ndarray, n: np.ndarray, b: np.ndarray) -> EventModel:
        for dense in (True, False):
            (gaps_, hits), (of_pairs, of_hits) = ((n[kinds == kind + dense].sum(), b[kinds == kind + dense].sum()) for kind in (_TOTAL, _PAIRS))
            self.prior[dense] = (hits + 1) / (gaps_ + 2)
            self.after[dense] = _logit((of_hits + 0.5) / (of_pairs + 1)) - _logit(self.prior[dense])
        keep = (kinds % 2 == 1) | (n >= MET)
        self.met = [Contexts(side, keys[own], b[own], n[own]) for side in (0, 1) for own in [keep & (kinds // 2 == side)]]
        return self

    def _share(self, side: int, parts: tuple, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The share of boundaries at each unit's gap, a context's shorter forms standing in for what is rare; whether its core is known, and was met at a boundary."""
        p, last = prior, [np.zeros(len(prior)), np.zeros(len(prior))]
        grams, core = _grams(side, *parts)
        for k, (key, there) in enumerate(grams):
            b, n = (np.where(there, x, 0.0) for x in self.met[side].found(key))
            p = (b + self.K * p) / (n + self.K)
            last = [np.where(core == k, x, y) for x, y in zip((b, n), last)]
        return p, last[1] > 0, last[0] > 0

    def _odds(self, codes: _Codes, ids: list[int], sizes: np.ndarray) -> np.ndarray:
        """Log odds of a boundary before each unit of lines put end to end; none before a line's first one, nor without a left side that ended a sentence and a right side
        that began one, or is unknown after a sure end.
        """
        before = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts = (*codes.arrays(ids), before, np.repeat(sizes, sizes) - 1 - before)
        dense = parts[1][1:]
        prior = np.where(parts[1], self.prior[True], self.prior[False])
        p, _, ended = (x[:-1] for x in self._share(0, parts, np.append(prior[1:], 0.5)))
        q, known, began = (x[1:] for x in self._share(1, parts, prior))

        def logit(x):
            x = np.clip(x, 1e-4, 1 - 1e-4)
            return np.log(x / (1 - x))

        odds = logit(p) + np.where(began, logit(q) - logit(prior[1:]), 0.0)
        return np.append(-30.0, np.where((before[1:] > 0) & ended & (began | ~known & (p >= 0.5) & ~dense), odds, -30.0))

    def all_starts(self, lines: list[str], codes: _Codes) -> list[list[int]]:
        """:meth:`starts` of many lines."""
        out: list[list[int]] = [[] for _ in lines]
        if not len(self.met[0]):
            return out
        units = [_UNIT.findall(x) for x in lines]
        sizes = np.array([len(x) for x in units], np.int64)
        ids = [codes[u] for own in units for u in own]
        if len(ids) > 1:
            dense = [codes.dense[k] for k in ids]
            odds, at = self._odds(codes, ids, sizes).tolist(), np.cumsum(sizes) - sizes
            for k in dict.fromkeys(np.repeat(np.arange(len(lines)), sizes)[np.array(odds) > -30.0].tolist()):
                a, n = int(at[k]), int(sizes[k])
                if n > 1:
                    out[k] = self._chain(self.units(lines[k]), [(o, self.after[d]) for o, d in zip(odds[a + 1 : a + n], dense[a + 1 : a + n])])
        return out

    def starts(self, line: str) -> list[int]:
        """Where sentences start within a line, by forward-backward over all gaps between its units."""
        return self.all_starts([line], _Codes())[0]

    @staticmethod
    def _chain(own: list[tuple[str, int]], odds: list[tuple[float, float]]) -> list[int]:
        """Forward-backward over a line's units and where they start, by the log odds before each but the first and what a boundary takes from those after it."""
        n = len(odds)
        weight = [[math.exp(max(-30.0, min(30.0, o + (after if prev else 0.0)))) for prev in (0, 1)] for o, after in odds]
        steps = [[(1 / (1 + w), w / (1 + w)) for w in row] for row in weight]
        forward = [(0.0, 1.0)]
        for row in steps:
            a, b = forward[-1]
            forward.append((a * row[0][0] + b * row[1][0], a * row[0][1] + b * row[1][1]))
        back, out = (1.0, 1.0), []
        for i in range(n - 1, -1, -1):
            a, b = forward[i + 1][0] * back[0], forward[i + 1][1] * back[1]
            if b > a:
                out.append(own[i + 1][1])
            row = steps[i]
            back = (row[0][0] * back[0] + row[0][1] * back[1], row[1][0] * back[0] + row[1][1] * back[1])
        return out[::-1]


def _span(n: int) -> int:
    return 0 if n < 12 else 1 if n < 30 else 2


class BoundaryModel:
    """Counts of the hidden-event model and the posteriors they give."""

    #: Weight of general forms to the right against specific ones; weight of gaps that can't end a sentence among non-boundaries.
    U, CLOSED = 0.05, 0.1

    def __init__(self) -> None:
        self.left: dict[str, float] = {}  # log odds of a boundary after the specific form
        self.left_short: dict[str, float] = {}
        self.right: list[dict[str, float]] = [{}, {}]
        self.right_short: list[dict[str, float]] = [{}, {}]
        self.total = {(s, d): 1.0 for s in (0, 1) for d in "dw"}  # by event and kind of what stands to the right
        #: What a boundary before a gap takes from its odds, by the length since; learned from the lengths of sentences.
        self.chain = [0.0, 0.0, 0.0]
        self.events = EventModel()
        self.prior = 0.0

    def _odds(self, lf: str, ls: str) -> float:
        x = self.left.get(lf)
        if x is None:
            x = self.left_short.get(ls)
        # a full-width mark that the sample lacks ends a sentence until seen otherwise
        return x if x is not None else 2.0 if ls[1:2] in "。！？．" and len(ls) > 1 else self.prior

    def _right(self, rf: str, rs: str) -> float:
        out = []
        for s in (1, 0):
            n = self.total[s, rf[0]]
            out.append(0.6 * self.right[s].get(rf, 0.0) / n + 0.4 * self.U * (self.right_short[s].get(rs, 0.0) + 0.02) / n + 1e-9)
        return math.log(out[0]) - math.log(out[1])

    def posteriors(self, feats: list[tuple[str, str, str, str, int]]) -> list[float]:
        """Boundary posteriors of a line's gaps by forward-backward; a feature row has left, right and the length since the gap before."""
        n = len(feats)
        if not n:
            return []
        w = []  # w[i][previous event] = odds of a boundary
        for k, (lf, ls, rf, rs, span) in enumerate(feats):
            o = self._odds(lf, ls)
            e = self._right(rf, rs)
            row = []
            for prev in (0, 1):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, o + (self.chain[span] if prev else 0.0)))))
                row.append((1 - p, p * math.exp(max(-30.0, min(30.0, e)))))
            w.append(row)
        f = [(0.0, 1.0)]  # the line's start is a boundary
        for row in w:
            a, b = f[-1]
            x, y = a * row[0][0] + b * row[1][0], a * row[0][1] + b * row[1][1]
            z = x + y or 1.0
            f.append((x / z, y / z))
        back = (1.0, 1.0)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            a, b = f[i + 1][0] * back[0], f[i + 1][1] * back[1]
            out[i] = b / (a + b or 1.0)
            row = w[i]
            x, y = row[0][0] * back[0] + row[0][1] * back[1], row[1][0] * back[0] + row[1][1] * back[1]
            z = x + y or 1.0
            back = (x / z, y / z)
        return out

    def fit(self, texts: list[str], rounds: int = ROUNDS) -> BoundaryModel:
        """Fitted to texts at hand."""
        rows = _featured_lines(sorted(set(texts)))
        batch = pa.RecordBatch.from_arrays([pa.array(rows[k], type=t) for k, t in _ROW.items()], names=list(_ROW))

        def total(fn: Callable) -> Sums:
            return _told(fn(batch))

        def events() -> tuple[np.ndarray, ...]:
            codes, lines = _Codes(), list(self.found(batch))
            kinds, keys, *_ = EventModel.counted(lines, codes, None)
            return EventModel.counted(lines, codes, [np.unique(keys[kinds // 2 == side]) for side in (0, 1)])

        return self.fit_sums(total, events, rounds)

    @staticmethod
    def _counted(batch: pa.RecordBatch) -> list[tuple]:
        """What stands at the starts, the ends and the gaps of lines."""
        out: dict[str, Counter] = defaultdict(Counter)
        g, lines = _Gaps(batch), batch.column("line").to_pylist()
        words: Counter = Counter()
        for line, size in zip(lines, g.sizes.tolist()):
            for kind, f in zip(("sure1", "sure_short1", "ends", "ends_short"), (*right_features(line, 0), *left_features(line, len(line)))):
                out[kind][f] += 1
            # every space between words; where a word can't begin a form of a script without spaces it is the form
            first, *chunks = line.split()
            if all(x[0].isalnum() and x[0] < "\u0e00" for x in chunks):
                words.update(chunks)
            else:
                words.update(x.group() if (c := x.group()[0]).isalnum() and c < "\u0e00" else line[x.start() : x.start() + 40] for x in _CHUNK.finditer(line, len(first)))
            if not size:
                out["whole"][str(_span(len(line)))] += 1
        for w, n in words.items():
            for kind, f in zip(("sure0", "sure_short0"), right_features(w, 0)):
                out[kind][f] += n
        # those that are open are none of these
        at = batch.column("spaced").flatten().to_numpy(zero_copy_only=False)
        for kind, name in (("sure0", "rf"), ("sure_short0", "rs")):
            for f, n in zip(g.forms[name], np.bincount(g.codes[name], at, len(g.forms[name])).tolist()):
                out[kind][f] -= int(n)
        out["sure0"], out["sure_short0"] = +out["sure0"], +out["sure_short0"]
        for kind, name in (("seen", "lf"), ("seen_short", "ls"), ("seen_right", "rf"), ("seen_right_short", "rs")):
            out[kind].update(dict(zip(g.forms[name], np.bincount(g.codes[name], minlength=len(g.forms[name])).tolist())))
        for kind, x, y in (("of_left", "lf", "ls"), ("of_right", "rf", "rs")):
            pairs, n = np.unique(g.codes[x].astype(np.int64) * max(1, len(g.forms[y])) + g.codes[y], return_counts=True)
            for pair, times in zip(pairs.tolist(), n.tolist()):
                i, j = divmod(pair, max(1, len(g.forms[y])))
                out[kind][g.forms[x][i] + _SEP + g.forms[y][j]] += times
        out["between"].update({str(k): n for k, n in enumerate(np.bincount(g.span, minlength=3).tolist())})
        return [(kind, list(own), np.array(list(own.values()), np.float64)) for kind, own in out.items()]

    def _all_posteriors(self, g: _Gaps) -> np.ndarray:
        """:meth:`posteriors` of all lines of a batch at once."""
        if not len(g.span):
            return np.zeros(0)

        def each(table: dict[str, float], name: str, default: float = 0.0) -> np.ndarray:
            return np.array([table.get(f, default) for f in g.forms[name]])[g.codes[name]]

        o = each(self.left, "lf", math.nan)
        short = np.array([self._odds("", f) for f in g.forms["ls"]])[g.codes["ls"]]
        o = np.where(np.isnan(o), short, o)
        dense = np.array([f[0] == "d" for f in g.forms["rf"]])[g.codes["rf"]]
        e = []
        for s in (1, 0):
            n = np.where(dense, self.total[s, "d"], self.total[s, "w"])
            e.append(np.log(0.6 * each(self.right[s], "rf") / n + 0.4 * self.U * (each(self.right_short[s], "rs") + 0.02) / n + 1e-9))
        right = np.exp(np.clip(e[0] - e[1], -30, 30))
        w = []
        for chain in (0.0, np.array(self.chain)[g.span]):
            p = 1 / (1 + np.exp(-np.clip(o + chain, -30, 30)))
            w.append((1 - p, p * right))
        # lines with the most gaps first, so those that have an i-th one come first
        order = np.argsort(-g.sizes, kind="stable")
        first, sizes = (np.cumsum(g.sizes) - g.sizes)[order], g.sizes[order]
        counts = [int(np.searchsorted(-sizes, -i, "left")) for i in range(int(sizes[0]))]
        f0, f1, out = np.zeros(len(o)), np.zeros(len(o)), np.zeros(len(o))
        a, b = np.zeros(len(sizes)), np.ones(len(sizes))  # the line's start is a boundary
        for i, c in enumerate(counts):
            at = first[:c] + i
            x, y = a[:c] * w[0][0][at] + b[:c] * w[1][0][at], a[:c] * w[0][1][at] + b[:c] * w[1][1][at]
            z = np.where(x + y > 0, x + y, 1.0)
            f0[at], f1[at] = a[:c], b[:c] = x / z, y / z
        a, b = np.ones(len(sizes)), np.ones(len(sizes))
        for i in range(len(counts) - 1, -1, -1):
            c = counts[i]
            at = first[:c] + i
            x, y = f0[at] * a[:c], f1[at] * b[:c]
            out[at] = y / np.where(x + y > 0, x + y, 1.0)
            x, y = w[0][0][at] * a[:c] + w[0][1][at] * b[:c], w[1][0][at] * a[:c] + w[1][1][at] * b[:c]
            z = np.where(x + y > 0, x + y, 1.0)
            a[:c], b[:c] = x / z, y / z
        return out

    def _expected(self, batch: pa.RecordBatch, first: Callable | None = None) -> list[tuple]:
        """Expected boundaries of each form; in the first round by ``first``, then by the model."""
        g = _Gaps(batch)
        if first:
            known = {x: first(*x) for x in set(g.rows())}
            p = np.array([known[x] for x in g.rows()], np.float64)
        else:
            p = self._all_posteriors(g)
        return [(kind, g.forms[name], np.bincount(g.codes[name], x, len(g.forms[name]))) for kind, name, x in (("b", "lf", p), ("b_short", "ls", p), ("r1", "rf", p), ("r0", "rf", 1 - p), ("r_short1", "rs", p), ("r_short0", "rs", 1 - p))]

    def found(self, batch: pa.RecordBatch) -> list[tuple[list[str], bool]]:
        """The sentences of each line with marks, and whether it ends with one; a line without marks is one sentence."""
        g, out, k = _Gaps(batch), [], 0
        hits, at = (self._all_posteriors(g) > 0.5).tolist(), batch.column("at").flatten().to_pylist()
        for line, size in zip(batch.column("line").to_pylist(), g.sizes.tolist()):
            own = [0, *(b for b, hit in zip(at[k : k + size], hits[k : k + size]) if hit)] if size and _MARKED.search(line) else [0]
            k += size
            out.append(([line[a:b] for a, b in zip(own, [*own[1:], len(line)])], bool(_ENDED.search(line))))
        return out

    def fit_sums(self, total: Callable[[Callable], Sums], events: Callable[[], tuple[np.ndarray, ...]], rounds: int = ROUNDS) -> BoundaryModel:
        """Fitted by passes over all lines: ``total`` gives the sums of what a function makes of batches of them, ``events`` the counts of :meth:`EventModel.counted` by this model."""
        told = total(self._counted)

        def of(sums: Sums, kind: str, times: float = 1.0) -> dict[str, float]:
            return defaultdict(float, {f: x * times for f, x in sums[kind].items()})

        def general_of(kind: str) -> dict[str, str]:
            """The general form that a specific one has most often."""
            best: dict[str, tuple] = {}
            for f, x in told[kind].items():
                own, short = f.split(_SEP)
                best[own] = max(best.get(own, (0, "")), (x, short))
            return {own: short for own, (_, short) in best.items()}

        ends, ends_short, seen, seen_short, seen_right, seen_right_short = (of(told, k) for k in ("ends", "ends_short", "seen", "seen_short", "seen_right", "seen_right_short"))
        sure, sure_short = ([of(told, f"{k}0", self.CLOSED), of(told, f"{k}1")] for k in ("sure", "sure_short"))

        general: dict[str, float] = {}  # what the general forms say, on which the specific ones rest

        def at_end(e: float, n: float, rate: float, base: float = 0.33) -> float:
            """The share of boundaries among a form's gaps that its number of line ends speaks for; there are ``rate`` line ends to a boundary within lines."""
            return min(0.97, (e + 3 * base) / (rate * n + 3))

        general |= {f: at_end(ends_short.get(f, 0), n, 0.3) for f, n in seen_short.items()}
        of_left, of_right = general_of("of_left"), general_of("of_right")

        def at_first(lf: str, ls: str, rf: str, rs: str, span: int) -> float:
            """Forms that end lines are boundaries at first sight; abbreviations, forms that never end a line, and forms that never start one are not."""
            p = at_end(ends.get(lf, 0), seen.get(lf, 0), 0.3, general[ls]) if seen.get(lf, 0) > 3 else 0.1 if ls.startswith("sabbr") else 0.3
            if rf not in sure[1] and seen_right.get(rf, 0) >= 5 or rs not in sure_short[1] and seen_right_short.get(rs, 0) >= 5:
                p *= 0.05
            return p

        # lengths of lines without an open gap, which are sentences, against those of stretches between gaps
        whole, between = ([1.0 + told[kind].get(str(k), 0.0) for k in range(3)] for kind in ("whole", "between"))
        ratio = [math.log(w / sum(whole)) - math.log(b / sum(between)) for w, b in zip(whole, between)]
        self.chain = [min(0.0, r - ratio[2]) for r in ratio]

        for k in range(rounds):
            sums = total(lambda batch: self._expected(batch, at_first)) if k == 0 else total(self._expected)
            b, b_short = of(sums, "b"), of(sums, "b_short")
            r, rshort = ([of(sums, f"{kind}{s}") for s in (0, 1)] for kind in ("r", "r_short"))
            for table, more in ((r, sure), (rshort, sure_short)):
                for s in (0, 1):
                    for f, x in more[s].items():
                        table[s][f] += x
            all_b = sum(b.values())
            n_all = sum(seen.values()) or 1.0
            rate = [1.0, 1.0]
            for d in (0, 1):  # scripts with and without spaces
                own = [f for f in seen if (f[0] == "d") == bool(d)]
                rate[d] = min(2.0, max(0.05, sum(ends.get(f, 0) for f in own) / (sum(b[f] for f in own) + 1.0)))
            self.prior = _logit((all_b + 1) / (n_all + 2))
            self.left_short, self.left = {}, {}
            for table, n_of, e_of, b_of, least in ((self.left_short, seen_short, ends_short, b_short, 1), (self.left, seen, ends, b, 4)):
                for f, n in n_of.items():
                    # specific forms seen once or twice say little: general ones stand in for them
                    if n >= least:
                        k = n + 1.0
                        m = at_end(e_of.get(f, 0), n, rate[f[0] == "d"], general[of_left[f]] if table is self.left else 0.33)
                        if table is self.left_short:
                            general[f] = m
                        table[f] = _logit((b_of[f] + k * m) / (n + k))
            general_right: dict[str, float] = {}
            for table, n_of, sure_of in ((rshort, seen_right_short, sure_short), (r, seen_right, sure)):
                for f, n in n_of.items():
                    start = sure_of[1].get(f, 0.0)
                    # a frequent form that all but never starts a line is no start; one that seldom does may be
                    k = 4.0 * n + 1.0 if start < 0.03 * rate[f[0] == "d"] * n else 0.5 * n + 1.0
                    m = at_end(start, n, rate[f[0] == "d"], general_right.get(of_right[f], 0.33) if table is r else 0.33)
                    if table is rshort:
                        general_right[f] = m
                    own = n * (table[1][f] - start + k * m) / (n + k)
                    table[1][f], table[0][f] = start + own, sure_of[0].get(f, 0.0) + n - own
            self.right = [dict(r[s]) for s in (0, 1)]
            self.right_short = [dict(rshort[s]) for s in (0, 1)]
            self.total = {(s, d): max(1.0, sum(x for f, x in r[s].items() if f[0] == d)) for s in (0, 1) for d in "dw"}
        self.events = EventModel().told(*events())
        return self

    def starts(self, text: str) -> list[int]:
        """Where the sentences of a text start."""
        return self.all_starts([text], _Codes())[0]

    def all_starts(self, texts: list[str], codes: _Codes) -> list[list[int]]:
        """:meth:`starts` of many texts; equal lines are looked at once."""
        places: list[list[tuple[int, int]]] = []
        number: dict[str, int] = {}
        for text in texts:
            at, own = 0, []
            for line in text.split("\n"):
                body = line.strip()
                if body:
                    own.append((at + line.index(body[0]), number.setdefault(body, len(number))))
                at += len(line) + 1
            places.append(own)
        within: list[list[int]] = [[] for _ in number]
        marked, bare = [], []
        for body, k in number.items():
            if not _MARKED.search(body):
                bare.append((body, k))
            elif g := gaps(body):
                marked.append((k, [b for _, b in g], featured(body, g)))
        if marked:
            columns = list(zip(*(zip(*feats) for _, _, feats in marked)))
            batch = pa.RecordBatch.from_arrays([pa.array(x, type=_ROW[k]) for k, x in zip(_FORMS, columns)], names=_FORMS)
            hits, i = (self._all_posteriors(_Gaps(batch)) > 0.5).tolist(), 0
            for k, at, _ in marked:
                within[k] = [b for b, hit in zip(at, hits[i : i + len(at)]) if hit]
                i += len(at)
        if bare:
            for (_, k), at in zip(bare, self.events.all_starts([body for body, _ in bare], codes)):
                within[k] = at
        return [[x for lead, k in own for x in (lead, *(lead + b for b in within[k]))] for own in places]


def featured(line: str, open_gaps: list[tuple[int, int]]) -> list[tuple[str, str, str, str, int]]:
    out, last = [], 0
    for left, start in open_gaps:
        forms = left_features(line, left)
        wide = len(forms[1]) > 1 and forms[1][1] in "。！？．"
        out.append((*forms, *right_features(line, start), 2 if wide else _span(left - last)))
        last = start
    return out


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if x.strip()]


#: Columns of lines and the forms at their gaps; ``at`` is where what stands to the right starts, ``spaced`` whether a space is before it.
_ROW = {"line": pa.string()} | {k: pa.list_(t) for k, t in (("lf", pa.string()), ("ls", pa.string()), ("rf", pa.string()), ("rs", pa.string()), ("span", pa.int32()), ("at", pa.int32()), ("spaced", pa.int32()))}

_FORMS = ["lf", "ls", "rf", "rs", "span"]


class _Gaps:
    """The gaps of a batch of lines, end to end, each form held once."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.sizes = pc.list_value_length(batch.column("lf")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.span = batch.column("span").flatten().to_numpy(zero_copy_only=False)
        self.forms, self.codes = {}, {}
        for name in ("lf", "ls", "rf", "rs"):
            x = batch.column(name).flatten().dictionary_encode()
            self.forms[name], self.codes[name] = x.dictionary.to_pylist(), x.indices.to_numpy(zero_copy_only=False)

    def rows(self) -> list[tuple]:
        return list(zip(*([self.forms[k][c] for c in self.codes[k].tolist()] for k in ("lf", "ls", "rf", "rs")), self.span.tolist()))


def _told(parts: list[tuple]) -> Sums:
    out: Sums = defaultdict(dict)
    for kind, forms, x in parts:
        out[kind].update(zip(forms, x.tolist()))
    return out


def _featured_lines(texts):
    out: dict[str, list] = {k: [] for k in _ROW}
    for x in texts:
        for line in lines_of(x):
            g = gaps(line)
            feats = featured(line, g)
            at = [b for _, b in g]
            for k, v in zip(out, (line, *(list(zip(*feats)) or [()] * 5), at, [int(line[b - 1].isspace()) for b in at])):
                out[k].append(v)
    return out


def fit(texts: list[DataFrame]) -> BoundaryModel:
    """A model fitted to all texts of frames of one column; the lines and the forms at their gaps are written once and read in every round."""
    every = texts[0].toDF("text")
    for df in texts[1:]:
        every = every.unionAll(df.toDF("text"))
    spark, path = every.sparkSession, scratch(every.sparkSession, "lines")
    forms = "lf array<string>, ls array<string>, rf array<string>, rs array<string>, span array<int>"
    rows = map_rows(every.where(F.length(F.trim("text")) > 0).distinct(), _featured_lines, f"line string, {forms}, at array<int>, spaced array<int>")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    with_gaps = rows.where(F.size("lf") > 0).select("lf", "ls", "rf", "rs", "span")
    model = BoundaryModel()

    def total(fn: Callable) -> Sums:
        def run(batches):
            for batch in batches:
                for kind, own, x in fn(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), type=pa.string()), pa.array(own, type=pa.string()), pa.array(np.rint(x * _UNIT_SUM).astype(np.int64))], names=["kind", "key", "n"])

        lines = rows if fn is model._counted else with_gaps
        told = lines.mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
        out: Sums = defaultdict(dict)
        for batch in told.to_batches(10_000):
            for kind, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                out[kind][key] = n / _UNIT_SUM
        return out

    def events() -> tuple[np.ndarray, ...]:
        sc = spark.sparkContext
        shared = sc.broadcast(model)

        def counts(live) -> DataFrame:
            def run(batches):
                codes = _Codes()
                for batch in batches:
                    kinds, keys, n, b = EventModel.counted(shared.value.found(batch), codes, live.value if live else None)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((kinds, np.int32), (keys.view(np.int64), np.int64), (n, np.int64), (b, np.int64))], names=["kind", "key", "n", "b"])

            return rows.mapInArrow(run, "kind int, key bigint, n bigint, b bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

        def arrays(df: DataFrame) -> list[np.ndarray]:
            return [c.to_numpy() for c in df.toArrow().columns]

        kinds, keys, *_ = arrays(counts(None))
        live = sc.broadcast([np.unique(keys[kinds // 2 == side].view(np.uint64)) for side in (0, 1)])
        # contexts that no model keeps stay where they are
        kinds, keys, n, b = arrays(counts(live).where((F.col("kind") % 2 == 1) | (F.col("kind") >= _TOTAL) | (F.col("n") >= MET)))
        return kinds, keys.view(np.uint64), n, b

    model.fit_sums(total, events)
    remove(spark, path)
    return model


def _split(shared):
    @per_partition
    def make():
        model: BoundaryModel = shared.value
        codes = _Codes()

        def batch(ids, texts):
            out: dict[str, list] = {"rec": [], "start_pos": [], "end_pos": []}
            for i, t, s in zip(ids, texts, model.all_starts([t or "" for t in texts], codes)):
                if t:
                    for a, b in zip(s, [*s[1:], len(t)]):
                        out["rec"].append(i)
                        out["start_pos"].append(a)
                        out["end_pos"].append(a + len(t[a:b].rstrip()))
            return out

        return batch

    return make


def sentences(df: DataFrame, model: BoundaryModel, row_id: str, text: str) -> DataFrame:
    """``(<row_id>, start_pos, end_pos)``: one row for each sentence."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = map_rows(df.select(row_id, text), _split(shared), f"rec {dict(df.dtypes)[row_id]}, start_pos int, end_pos int")
    return out.select(F.col("rec").alias(row_id), "start_pos", "end_pos")
