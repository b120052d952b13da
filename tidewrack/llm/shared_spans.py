"""Problem 10: spans of at least a given length that stand, character for character, in more than one document.

The index is log-structured. Every batch of documents becomes an immutable run of window hashes, written sorted by hash and split by
hash into buckets. A new batch is merge-joined with the older runs on the hash, candidates are verified on the texts, and runs of like size
are compacted, so the history is never fingerprinted again, and its hashes are read in order without an exchange. A manifest names the runs that
are whole; an index that was left is opened again at its path. Texts that were met before, in the history or the batch, are found by their own hash first
and stand under the first document that had them.

Windows are chosen by winnowing: of each ``span - window + 1`` consecutive windows the one with the least hash is kept, so two
documents with a common run of ``span`` characters have a kept window of that run in common. Nothing is dropped: a hash that many documents
share yields all its pairs, since each of them may be a row of the result.

Defined results: null, empty and short texts have no spans; equal texts of at least ``span`` characters form pairs; rows with the same id
and other texts count as one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import map_rows
from tidewrack.llm.runs import RunStore
from tidewrack.runtime import cut, scratch, small

SPAN, WINDOW = 200, 120
#: Documents that share a window from which its surroundings are compared before documents are paired.
HOT = 48

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _BASE, np.uint64))])
                cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _INV, np.uint64))])
        return cls.up[:n], cls.down[:n]


def window_hashes(text: str, window: int) -> np.ndarray:
    """A 64-bit hash of each window of ``window`` code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = _Powers.of(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + np.uint64(1)) * up)])
        return _mix((sums[window:] - sums[:-window]) * down[: n - window + 1])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of each ``width`` consecutive ones; of fewer, the least of all."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= width:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    # least value to each side of block borders: a sliding minimum in a few passes
    pad = -n % width
    h = np.concatenate([hashes, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(h, axis=1).ravel()
    right = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
    runs = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return np.flatnonzero(np.isin(hashes, runs)) if len(runs) else np.empty(0, np.int64)


def _prints(span: int, window: int):
    def batch(ids, texts):
        who, what = [], []
        for i, t in zip(ids, texts):
            if i is not None and t is not None and len(t) >= span:
                h = window_hashes(t, window)
                got = np.unique(h[winnow(h, span - window + 1)])
                who.append(np.full(len(got), i, np.int64))
                what.append(got.view(np.int64))
        none = np.empty(0, np.int64)
        return {"fp": pa.array(np.concatenate([none, *what])), "doc": pa.array(np.concatenate([none, *who]))}

    return batch


def _around(span: int, window: int):
    """Hashes of the windows of ``span`` characters around a document's hot windows."""

    def batch(ids, texts, hot):
        who, what = [], []
        for i, t, fps in zip(ids, texts, hot):
            if t is not None and len(t) >= span:
                full = window_hashes(t, span)
                at = np.flatnonzero(np.isin(window_hashes(t, window).view(np.int64), np.array(fps, np.int64)))
                starts = np.unique((at[:, None] - np.arange(span - window + 1)[None]).ravel())
                got = np.unique(full[starts[(starts >= 0) & (starts < len(full))]])
                who.append(np.full(len(got), i, np.int64))
                what.append(got.view(np.int64))
        none = np.empty(0, np.int64)
        return {"fp": pa.array(np.concatenate([none, *what])), "doc": pa.array(np.concatenate([none, *who]))}

    return batch


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """``(fp, doc)``: the kept window hashes of each document."""
    return map_rows(df.select(F.col(doc_id).cast("bigint"), text).where(F.length(text) >= span), _prints(span, window), "fp bigint, doc bigint")


def covered(own: np.ndarray, other: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Merged intervals of a text that stand in the other one too, from the hashes of all windows of ``span`` characters of both."""
    at = np.flatnonzero(np.isin(own, other))
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.concatenate([[0], gaps + 1])].tolist(), (at[np.concatenate([gaps, [len(at) - 1]])] + span).tolist()))


def shares(a: str, b: str, span: int) -> bool:
    """Whether two texts have a run of ``span`` characters in common."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < span:
        return False
    step = span // 2
    # any run of ``span`` characters of b holds a whole block of ``step`` characters that starts at a multiple of ``step``
    for j in range(0, len(b) - step + 1, step):
        block = b[j : j + step]
        i = a.find(block)
        while i >= 0:
            x = 0
            while x < step and i - x > 0 and j - x > 0 and a[i - x - 1] == b[j - x - 1]:
                x += 1
            e = step
            top = min(len(a) - i, len(b) - j)
            while e < top and x + e < span and a[i + e] == b[j + e]:
                e += 1
            if x + e >= span:
                return True
            i = a.find(block, i + 1)
    return False


def _verify(span: int):
    def batch(a, b, ta, tb):
        keep = [k for k, (x, y) in enumerate(zip(ta, tb)) if shares(x, y, span)]
        return {"doc_a": [a[k] for k in keep], "doc_b": [b[k] for k in keep]}

    return batch


class SpanIndex:
    """Runs of ``(fp, doc)`` and of ``(name, rep)``, the texts' own hashes. ``path`` must be shared by all executors; by default it lies below the checkpoint folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, window: int = WINDOW) -> None:
        self.spark, self.span, self.window = spark, span, window
        self.store = RunStore(spark, path or scratch(spark, "spans"), {"spans": "fp BIGINT, doc BIGINT", "names": "name BINARY, rep BIGINT"}, span=span, window=window)
        self.compact, self.close = self.store.compact, self.store.close
        self._fresh: DataFrame | None = None  # names of the batch whose members were asked for last

    def members(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``(doc, rep)`` of a batch's documents whose text, of at least ``span`` characters, was met before, in the history or under a smaller id of the batch.

        The texts that are new join the names, when the batch is appended.
        """
        named = docs.where(F.length(text) >= self.span).select(F.col(doc_id).cast("bigint").alias("doc"), F.unhex(F.sha2(text, 256)).alias("name")).distinct()
        groups = named.groupBy("name").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
        old = self.store.all("names")
        groups = groups.join(old, "name", "left") if old is not None else groups.withColumn("rep", F.lit(None).cast("bigint"))
        groups = cut(groups)
        self._fresh = groups.where("rep is null").select("name", F.col("least").alias("rep"))
        again = groups.where("n > 1 or rep is not null").select("name", F.coalesce("rep", "least").alias("rep"))
        return cut(named.join(small(cut(again)), "name").where("doc <> rep").select("doc", "rep"))

    def append(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", without: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
        """Adds a batch and returns candidates ``(doc_a, doc_b)`` of the batch against itself and against all older runs, kept in the checkpoint folder.

        ``without(doc)`` names documents that another one stands for (:meth:`members`); their windows are left out of the run. ``history`` are the older
        documents; it is read only for those with a window that over ``HOT`` documents share.
        """
        old = self.store.all("spans")
        prints = fingerprints(docs, doc_id, text, self.span, self.window)
        if without is not None:
            prints = prints.join(small(without), "doc", "left_anti")
        run = self.store.write("spans", prints)
        new = self.store.read("spans", run)
        counts = new.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        many = cut(counts.where("lo < hi"))
        pairs = many.where("n = 2").select(F.col("lo").alias("doc_a"), F.col("hi").alias("doc_b"))
        some = new.join(small(cut(many.where(F.col("n").between(3, HOT)).select("fp"))), "fp", "left_semi")
        pairs = pairs.unionByName(some.alias("a").join(some.alias("b"), (F.col("a.fp") == F.col("b.fp")) & (F.col("a.doc") < F.col("b.doc"))).select(F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b")))
        own = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t"))
        hot = cut(many.where(F.col("n") > HOT).select("fp"))
        if not hot.isEmpty():
            pairs = pairs.unionByName(self._wide(own, new, hot))
        if old is not None:
            met = old.withColumnRenamed("doc", "other").join(new.select("fp").distinct(), "fp", "left_semi")
            busy = None
            if history is not None:
                busy = cut(met.groupBy("fp").agg(F.count("*").alias("m")).join(counts.select("fp", "n"), "fp").where(F.col("m") + F.col("n") > HOT).select("fp"))
                busy = None if busy.isEmpty() else busy
            plain = met if busy is None else met.join(small(busy), "fp", "left_anti")
            pairs = pairs.unionByName(new.join(plain, "fp").select(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).where("doc_a < doc_b"))
            if busy is not None:
                both = own.unionByName(history.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")))
                pairs = pairs.unionByName(self._wide(both, new.unionByName(met.withColumnRenamed("other", "doc")), busy))
        found = cut(pairs.distinct())
        named = self.store.write("names", self._fresh) if without is not None and self._fresh is not None else None
        self._fresh = None
        self.store.commit(spans=run, names=named)
        return found

    def _wide(self, docs: DataFrame, prints: DataFrame, hot: DataFrame) -> DataFrame:
        """Pairs that hot windows lead to, without pairing all their documents.

        A common run of ``span`` characters around a window is one of the windows of ``span`` characters that hold it. The hashes of these stand for
        the document instead, so documents that share no more than the short window part, and what still meets is a row of the result.
        """
        mine = cut(prints.join(small(hot), "fp", "left_semi").groupBy("doc").agg(F.collect_set("fp").alias("fps")))
        wide = map_rows(docs.join(small(mine), "doc").select("doc", "t", "fps"), _around(self.span, self.window), "fp bigint, doc bigint").distinct()
        wide = cut(wide)
        met = wide.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        left = wide.join(met, "fp", "left_semi")
        return left.alias("a").join(left.alias("b"), (F.col("a.fp") == F.col("b.fp")) & (F.col("a.doc") < F.col("b.doc"))).select(F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b"))


def verified(pairs: DataFrame, left: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Those of the candidate pairs whose texts have a run of ``span`` characters in common. Only texts of candidates are moved."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("doc_a").alias("doc")).unionAll(pairs.select("doc_b")).distinct())
    texts = left.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")).where(F.length("t") >= span).join(small(ids), "doc", "left_semi")
    a = pairs.join(texts.withColumnsRenamed({"doc": "doc_a", "t": "ta"}), "doc_a")
    b = a.join(texts.withColumnsRenamed({"doc": "doc_b", "t": "tb"}), "doc_b")
    return map_rows(b.select("doc_a", "doc_b", "ta", "tb"), _verify(span), "doc_a bigint, doc_b bigint").distinct()


#: Batches in which the queries hand a whole table to the index, in the order of its ids.
BATCHES = 5


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """``(doc_a, doc_b)``, verified links between representatives, and ``(doc, rep)``, the documents that others stand for.

    The table is handed to an index in batches by ranges of its ids, each probed against the runs of those before it; the candidates of all are verified
    together, so texts are read for that once.
    """
    index = SpanIndex(docs.sparkSession, None, span, window)
    at = F.col(doc_id).cast("bigint")
    lo, hi = docs.agg(F.min(at), F.max(at)).first()
    found, members = [], []
    for k in range(batches if lo is not None else 0):
        a, b = (lo + (hi + 1 - lo) * x // batches for x in (k, k + 1))
        own, before = docs.where((at >= a) & (at < b)), docs.where(at < a)
        members.append(index.members(own, doc_id, text))
        found.append(index.append(own, doc_id, text, members[-1].select("doc"), before))
        index.compact()
    index.close(delete=True)
    if not found:
        spark = docs.sparkSession
        return spark.createDataFrame([], "doc_a bigint, doc_b bigint"), spark.createDataFrame([], "doc bigint, rep bigint")
    return cut(verified(reduce(DataFrame.unionByName, found).distinct(), docs, doc_id, text, span)), cut(reduce(DataFrame.unionByName, members))


def shared_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: documents that have a run of at least ``span`` characters in common.

    Of equal texts one stands for all in the index; the pairs are then expanded to the copies, which cost no fingerprint and no check.
    """
    found, repeats = links(docs, doc_id, text, span, window, batches)
    # pairs of representatives, each with itself too where it has copies, and the documents each stands for
    groups = repeats.select("rep").distinct()
    within = groups.select(F.col("rep").alias("doc_a"), F.col("rep").alias("doc_b"))
    stands = repeats.unionByName(groups.select(F.col("rep").alias("doc"), "rep"))
    wide = found.unionByName(within)
    for side, x in (("doc_a", "a"), ("doc_b", "b")):
        wide = wide.join(stands.select(F.col("rep").alias(side), F.col("doc").alias(x)), side, "left").withColumn(x, F.coalesce(x, side))
    return wide.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).where("doc_a < doc_b").distinct()


#: Window hashes that a task keeps for further pairs of the same documents.
KEPT = 4_000_000


def _cover(span: int):
    def batch(a, b, ta, tb):
        out: dict[str, list] = {"doc": [], "start": [], "stop": []}
        known: dict[str, np.ndarray] = {}
        size = 0
        for i, j, x, y in zip(a, b, ta, tb):
            for t in {x, y} - known.keys():
                if size > KEPT:
                    known, size = {u: known[u] for u in (x, y) if u in known}, 0
                known[t] = window_hashes(t, span)
                size += len(t)
            for doc, own, other in ((i, x, y), (j, y, x)):
                for start, stop in covered(known[own], known[other], span):
                    out["doc"].append(doc)
                    out["start"].append(start)
                    out["stop"].append(stop)
        return out

    return batch


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """``(doc, n_others, shared_chars, share)`` for each document with shared passages: with how many others, and how much of it stands in them.

    A character is covered if any window of ``span`` characters around it is one of the other document's, wherever and however often it stands
    in either; windows are told apart by 64-bit hashes. A text with copies is covered whole; only texts of representatives are compared, and copies are
    counted by the size of their group, so no pair of them is ever formed. Overlapping spans count once: of spans with one start the longest is kept
    (so a document has no more than it has characters), and a running maximum merges these.
    """
    from pyspark.sql import Window as W

    found, repeats = links(docs, doc_id, text, span, window, batches)
    groups = repeats.groupBy(F.col("rep").alias("doc")).agg((F.count("*") + 1).alias("k"))
    both = found.unionByName(found.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b")))
    sized = both.join(groups.withColumnRenamed("doc", "doc_b"), "doc_b", "left").groupBy(F.col("doc_a").alias("doc")).agg(F.sum(F.coalesce("k", F.lit(1))).alias("linked"))
    reps = sized.join(groups, "doc", "full").select("doc", (F.coalesce("linked", F.lit(0)) + F.coalesce("k", F.lit(1)) - 1).alias("n_others"), F.col("k").isNotNull().alias("whole"))
    reps = cut(reps)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")).where(F.length("t") >= span)
    parts = reps.where("not whole").select("doc")
    wanted = found.join(small(cut(parts.withColumnRenamed("doc", "doc_a"))), "doc_a", "left_semi").unionByName(found.join(small(cut(parts.withColumnRenamed("doc", "doc_b"))), "doc_b", "left_semi").select("doc_a", "doc_b")).distinct()
    own = wanted.join(texts.withColumnsRenamed({"doc": "doc_a", "t": "ta"}), "doc_a").join(texts.withColumnsRenamed({"doc": "doc_b", "t": "tb"}), "doc_b")
    cover = map_rows(own.select("doc_a", "doc_b", "ta", "tb"), _cover(span), "doc bigint, start int, stop int").groupBy("doc", "start").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = cover.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    chars = new.groupBy("doc").agg(F.sum("new").cast("bigint").alias("chars"))
    stands = repeats.unionByName(groups.select("doc", F.col("doc").alias("rep")))
    every = reps.join(chars, "doc", "left").withColumnRenamed("doc", "rep").join(stands, "rep", "left").withColumn("doc", F.coalesce("doc", "rep"))
    sized_texts = texts.select("doc", F.length("t").cast("bigint").alias("n"))
    return every.join(sized_texts, "doc").withColumn("shared_chars", F.when(F.col("whole"), F.col("n")).otherwise(F.col("chars"))).select("doc", F.col("n_others").cast("bigint").alias("n_others"), "shared_chars", (F.col("shared_chars") / F.col("n")).alias("share"))
