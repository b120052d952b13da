"""Problem 3: texts cut off by a field limit or a broken transfer.

Intact sentences are cut at random places, with and without a mark of omission, to make positives; complete sentences, with and without
their final stop, are the negatives. A hashed logistic regression on the closing characters, the punctuation around them and the
length next to the source's limit scores every row.

A source's limits are the lengths, in characters or bytes, at which a share of its rows pile up; they are counted over all rows.

Defined results: null, empty and blank texts, the store's mark for an empty summary and residue (problem 5) are not cut; rows without a source have no
limit; repeated rows are scored alike; an empty table gives an empty result. The model is fitted to at most ``SAMPLE`` texts, chosen by a
hash of the row's number.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import residue
from tidewrack.llm.common import PLACEHOLDER, chosen, latin_digits, map_rows, per_partition
from tidewrack.llm.sentences import BoundaryModel, closed_spans
from tidewrack.runtime import bounded, cut

SAMPLE, BITS, EPOCHS = 8_000, 18, 6
#: A length is a limit of its source if at least so many rows and such a share of its rows have it; how far below a limit in bytes a text may end.
LIMIT_ROWS, LIMIT_SHARE, SLACK = 8, 0.015, 3
#: Share of a source's rows from which a limit is beyond chance.
PILE = 0.05

_MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…+|�+)\s*$")
_DIGITS = re.compile(r"\d+(?:[.,  ]\d+)*")


def _mask(s: str) -> str:
    return _DIGITS.sub("0", latin_digits(s)).lower()


def features(text: str, at_limit: int) -> list[int]:
    """Hashed binary features of how a text ends; ``at_limit``: 0 none, 1 a limit in characters, 2 in bytes, 3 one in characters that many rows reach."""
    tail = text.rstrip()[-160:]
    m = _MARK.search(tail)
    # an ellipsis within quotation marks is the speaker's
    mark = m.group().strip() if m else ""
    core = tail[: m.start()] if m else tail
    line = core[core.rfind("\n") + 1 :]
    masked = _mask(line[-60:])
    # quotation marks are paired over the whole last line, which may begin before the tail
    whole = text.rstrip()
    whole = whole[: len(whole) - len(tail) + len(core)]
    whole = whole[whole.rfind("\n") + 1 :]
    spans = closed_spans(whole)
    open_end = bool(spans) and spans[-1][1] == len(whole)
    closing = re.search(r"[^\w\s฀-๿]*$", masked).group()
    base = masked[: len(masked) - len(closing)]
    words = base.split()
    last, before = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    kind = "t" if base and "฀" <= base[-1] <= "๿" else "c" if base and base[-1] >= "぀" and base[-1] < "가" else "w"
    out = [f"b{kind}", f"m{mark[:5]}|{kind}", f"l{at_limit}", f"p{closing[:3]}", f"p{closing[:3]}|{kind}|{bool(mark)}", f"o{open_end}", f"o{open_end}|{closing[:2]}", f"n{min(len(line) // 8, 6)}|{kind}"]
    for n in (1, 2, 3, 4, 6, 8, 12):
        if len(base) >= n:
            out.append(f"s{n}{base[-n:]}")
    out += [f"w{last}", f"x{before} {last}", f"k{closing[:2]}|{last}", f"g{closing[:2]}|{base[-3:]}", f"d{closing[:2]}|{len(last) if kind == 'w' else 0}"]
    mask = (1 << BITS) - 1
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & mask for f in out]


def examples(texts: list[str], model: BoundaryModel, seed: int = 11) -> tuple[list[list[int]], list[int]]:
    """Features and labels of complete and of artificially cut texts."""
    rnd = random.Random(seed)
    xs: list[list[int]] = []
    ys: list[int] = []

    def add(text: str, y: int) -> None:
        # a cut text has its source's limit as often as not, a whole one by chance
        at = rnd.choice((1, 2, 3)) if y and rnd.random() < 0.5 else 0 if y else rnd.choices((0, 1, 2, 3), (0.978, 0.01, 0.01, 0.002))[0]
        xs.append(features(text, at))
        ys.append(y)

    # a last line that stands at the end of other texts too is whole
    closing = Counter(_mask(t[t.rfind("\n") + 1 :]).strip() for t in set(texts))
    for t in texts:
        if t == PLACEHOLDER or "�" in t:
            continue
        if closing[_mask(t[t.rfind("\n") + 1 :]).strip()] > 3:
            add(t, 0)
        starts = model.starts(t)
        ends = [*starts[1:], len(t)]
        for k, (a, b) in enumerate(zip(starts, ends)):
            own = t[a:b].rstrip()
            body = own.rstrip(".!?。！？…\"'”’»›」』“ ")
            last = k == len(starts) - 1
            stopped = bool(re.search(r"(?:[.!?]|[。！？])[\"'”’»›」』“)]*$", own)) and not _MARK.search(own)
            if not last or stopped:
                if len(starts) < 4 or rnd.random() < 3 / len(starts):
                    done = t[:a] + own
                    add(done, 0)
                    if body and len(body) < len(own) and own[-1] in ".。!！":
                        add(t[:a] + own[:-1], 0)
                    elif not stopped and rnd.random() < 0.1:
                        add(done + rnd.choice(".!"), 0)
            if not last and len(body) > 12 and (len(starts) < 4 or rnd.random() < 3 / len(starts)):
                for _ in range(2):
                    c = rnd.randint(2, len(body) - 2)
                    piece = t[a : a + c]
                    if rnd.random() < 0.25 and " " in piece.strip():
                        piece = piece[: piece.rstrip().rfind(" ")]
                    mark = rnd.choices(["", "...", "…", " [...]", "�"], [55, 25, 8, 7, 5])[0]
                    add(t[:a] + piece.rstrip() + mark, 1)
    return xs, ys


class HashedLogistic:
    """Logistic regression on hashed binary features, fitted by AdaGrad on mini-batches."""

    def __init__(self, bits: int = BITS) -> None:
        self.w = np.zeros(1 << bits, np.float32)

    def fit(self, xs: list[list[int]], ys: list[int], epochs: int = EPOCHS, rate: float = 0.15, l2: float = 1e-6, seed: int = 3) -> HashedLogistic:
        if not xs:
            return self
        lengths = np.array([len(x) for x in xs])
        flat = np.fromiter((i for x in xs for i in x), np.int64, int(lengths.sum()))
        offset = np.concatenate([[0], np.cumsum(lengths)])
        y = np.array(ys, np.float32)
        gain = np.full(len(self.w), 1e-2, np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), 256):
                own = order[i : i + 256]
                idx = np.concatenate([flat[offset[k] : offset[k + 1]] for k in own])
                row = np.repeat(np.arange(len(own)), lengths[own])
                z = np.bincount(row, self.w[idx], len(own))
                g = (1 / (1 + np.exp(-z)) - y[own]).astype(np.float32)
                u, inv = np.unique(idx, return_inverse=True)
                grad = np.bincount(inv, g[row], len(u)).astype(np.float32) + l2 * self.w[u]
                gain[u] += grad * grad
                self.w[u] -= rate * grad / np.sqrt(gain[u])
        return self

    def probability(self, x: list[int]) -> float:
        return float(1 / (1 + np.exp(-self.w[x].sum())))


def limits(df: DataFrame, text: str, source: str) -> DataFrame:
    """``(source, unit, len)``: lengths at which many rows of a source end; ``unit`` is 1 for characters (3 if over ``PILE`` of the rows do) and 2 for bytes.

    There are at most ``2 / LIMIT_SHARE`` of them for a source.
    """
    rows = df.select(F.col(source).alias("source"), F.col(text).alias("t")).where((F.col("source") != "") & (F.length("t") > 40))
    own = rows.select("source", F.explode(F.array(F.struct(F.lit(1).alias("unit"), F.length("t").alias("len")), F.struct(F.lit(2).alias("unit"), (F.octet_length("t") / (SLACK + 1)).cast("int").alias("len")))).alias("x"))
    counts = own.groupBy("source", "x.unit", "x.len").agg(F.count("*").alias("n")).where(F.col("n") >= LIMIT_ROWS)
    totals = rows.groupBy("source").agg(F.count("*").alias("of"))
    share = F.when(F.col("unit") == 1, LIMIT_SHARE).otherwise(2 * LIMIT_SHARE)
    return counts.join(totals, "source").where(F.col("n") >= F.col("of") * share).select("source", F.when((F.col("unit") == 1) & (F.col("n") >= F.col("of") * PILE), 3).otherwise(F.col("unit")).alias("unit"), "len")


def _score(shared):
    @per_partition
    def make():
        model, piles = shared.value
        judge = residue.ExemplarIndex()

        def batch(ids, sources, texts, flags):
            out: dict[str, list] = {"rec": [], "source": [], "p": []}
            for i, s, t, flag in zip(ids, sources, texts, flags):
                if not t or t == PLACEHOLDER or t.isspace():
                    continue
                if piles is not None:
                    n = len(t)
                    flag = 3 if (s, 3, n) in piles else 1 if (s, 1, n) in piles else 2 if (s, 2, len(t.encode("utf-8", "surrogatepass")) // (SLACK + 1)) in piles else 0
                p = model.probability(features(t, flag or 0))
                if p > 0.5 and (judge.judge(t, s) == "residue" or not residue.without_slots(t).strip(" .!")):
                    p = 0.0
                out["rec"].append(i)
                out["source"].append(s)
                out["p"].append(p)
            return out

        return batch

    return make


def sample_of(df: DataFrame, row_id: str, text: str, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` texts to fit the model to, the same at each call."""
    return [r[0] for r in chosen(df.where(F.length(F.trim(text)) > 0), row_id, sample).select(text).collect()]


def scores(df: DataFrame, row_id: str = "ingest_seq", text: str = "summary", source: str = "source", sample: int = SAMPLE) -> DataFrame:
    """``(<row_id>, source, p)``: the probability that a text is cut, for every row with one."""
    texts = sample_of(df, row_id, text, sample)
    model = HashedLogistic().fit(*examples(texts, BoundaryModel().fit(texts)))
    piles = cut(limits(df, text, source))
    rows = df.select(row_id, F.col(source).alias("source"), F.col(text).alias("t"))
    known = None
    if bounded(piles):
        known = {(r["source"], r["unit"], r["len"]) for r in piles.collect()}
        rows = rows.withColumn("flag", F.lit(0))
    else:
        chars = piles.where(F.col("unit") != 2).select("source", F.col("len").alias("len1"), F.col("unit").alias("u1"))
        octets = piles.where(F.col("unit") == 2).select("source", F.col("len").alias("len2"), F.col("unit").alias("u2"))
        rows = rows.withColumn("len1", F.length("t")).withColumn("len2", (F.octet_length("t") / (SLACK + 1)).cast("int"))
        rows = rows.join(chars, ["source", "len1"], "left").join(octets, ["source", "len2"], "left").withColumn("flag", F.coalesce("u1", "u2", F.lit(0)))
    shared = df.sparkSession.sparkContext.broadcast((model, known))
    out = map_rows(rows.select(row_id, "source", "t", "flag"), _score(shared), f"rec {dict(df.dtypes)[row_id]}, source string, p double")
    return out.select(F.col("rec").alias(row_id), "source", "p")


def truncated(df: DataFrame, row_id: str = "ingest_seq", text: str = "summary", source: str = "source", least: float = 0.5, **options) -> DataFrame:
    """``(<row_id>)`` of the rows whose text is cut."""
    return scores(df, row_id, text, source, **options).where(F.col("p") >= least).select(row_id)


def rates(df: DataFrame, row_id: str = "ingest_seq", text: str = "summary", source: str = "source", least: float = 0.5, **options) -> DataFrame:
    """``(source, n_rows, n_cut, share)`` for each source, null and empty ones included: how many of its rows are cut."""
    found = scores(df, row_id, text, source, **options).where(F.col("p") >= least).groupBy("source").agg(F.count("*").alias("n_cut"))
    totals = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_rows"))
    joined = totals.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "n_rows", F.coalesce("n_cut", F.lit(0).cast("bigint")).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_rows")).alias("share"))
