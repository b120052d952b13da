"""Problem 4: the subjects of each document, by propagating labels over a graph of documents that share subject phrases.

Phrases: the lexicon's keywords stand in frames, the characters around them; frames that surround several keywords surround unknown
phrases of the same sort too. Frames and phrases are counted over all documents, each task's counts first. All documents are then scanned
for all phrases: at once, or, beyond ``BLOCK`` phrases, block by block, with the hits of a text brought together by a shuffle.

Graph: documents are linked by the phrases they share, written as edges ``(doc, phrase, n)``, so two documents are similar as far as
the weights of their common phrases go, and no pair is ever listed. Verified links are those through phrases whose documents agree on
a subject; names and places, whose documents don't, carry nothing. Labels spread from documents to phrases and back by joins, until they stop changing.
Lexicon phrases and hand labels that the text bears out, or says nothing about, are clamped and stand in the result.

A document keeps every subject with a share of its mentions that is no passing mention; mentions in the title weigh more.

Defined results: documents whose title and summary are null, empty, blank or residue (problem 5) have no subject; without any known phrase or hand label a
document has no row; repeated rows are judged alike; empty lexicon or labels leave what the other gives; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import residue
from tidewrack.llm.common import HAN, KANA, PLACEHOLDER, THAI, map_rows, nfkc, per_partition
from tidewrack.runtime import cut, remove, scratch, small

#: Most keywords of a lexicon; rounds of propagation; weight of a mention in the title.
KEYWORDS, ROUNDS, TITLE = 6_000, 25, 2.0
#: Change of a label's share up to which it counts as settled; share of the labels that may still move when propagation ends.
STILL, MOVING = 0.02, 0.001
#: Frames or phrases, about, that a task looks for at once; counts that it holds before it hands them on.
BLOCK, FLUSH = 50_000, 200_000

# The project's categories.
SUBJECTS = "politics economy technology health environment society sports entertainment world".split()

_DENSE = re.compile(rf"[{THAI}{HAN}{KANA}]")
_DIGITS = re.compile(r"\d+(?:[.,  ]\d+)*")


def fold(text: str) -> str:
    """Lower case, compatibility forms unified, figures as one character."""
    return _DIGITS.sub("0", nfkc(text).lower())


def _frame(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands around ``text[a:b]``: up to two words or six characters on each side, within the line."""
    if _DENSE.match(text[a]):
        return text[max(0, a - 6) : a].split("\n")[-1], text[b : b + 6].split("\n")[0]
    left = re.search(r"(?:\S+\s+){1,2}$", text[max(0, a - 40) : a].split("\n")[-1])
    right = re.match(r"(?:[^\w\s]*\s+\S+){1,2}|[^\w\s]+", text[b : b + 40].split("\n")[0])
    return (left.group() if left else ""), (right.group() if right else "")


def _joined(x: str, y: str) -> bool:
    """Whether two characters belong to one word of a script with spaces."""
    return x.isalnum() and y.isalnum() and (x < "\u0e00" or not _DENSE.match(x)) and (y < "\u0e00" or not _DENSE.match(y))


def matches(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int, int]]:
    """All matches, in scripts with spaces at word boundaries only: sorted ``(start, -length, end, value)``."""
    hits = []
    if not len(machine):
        return hits
    for end, (size, value) in machine.iter(text):
        a, b = end - size + 1, end + 1
        if a and text[a - 1].isalnum() and _joined(text[a - 1], text[a]) or b < len(text) and text[b].isalnum() and _joined(text[b - 1], text[b]):
            continue
        hits.append((a, -size, b, value))
    hits.sort()
    return hits


def leftmost(hits: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of sorted matches the leftmost longest that don't overlap."""
    last = 0
    for hit in hits:
        if hit[0] >= last:
            yield hit
            last = hit[2]


def find(machine: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, int]]:
    """Leftmost longest matches that don't overlap: ``(start, end, value)``."""
    for a, _, b, value in leftmost(matches(machine, text)):
        yield a, b, value


def machine_of(phrases: dict[str, int]) -> ahocorasick.Automaton:
    m = ahocorasick.Automaton()
    for p, k in phrases.items():
        m.add_word(p, (len(p), k))
    m.make_automaton()
    return m


def _cut_back(left: str, right: str) -> tuple[str, str]:
    """A frame's inner words are fixed, those farther off may be names, so frames are also counted cut back to what recurs."""
    if _DENSE.search(left + right):
        return left[-3:], right[:3]
    return " ".join(left.split()[-1:]) + " ", re.match(r"[^\w\s]*\s*\S*", right).group()


def _folded(ids, titles, summaries, sources):
    return {"doc": ids, "title": titles, "summary": summaries, "source": sources, "ft": [fold(t or "") for t in titles], "fs": [fold(s or "") for s in summaries]}


def folded(df: DataFrame, row_id: str, title: str, text: str, source: str) -> DataFrame:
    """``(doc, title, summary, source, ft, fs)``: the documents with title and text as :func:`fold` gives them."""
    rows = df.select(F.col(row_id).cast("bigint").alias("doc"), F.col(title).alias("title"), F.col(text).alias("summary"), F.col(source).alias("source"))
    return map_rows(rows, _folded, "doc bigint, title string, summary string, source string, ft string, fs string")


def _joint(titles, texts) -> Iterator[str]:
    return map("\n".join, zip(titles, texts))


def _keyword_frames(shared):
    """``(whole, lft, rgt, k)``: keyword ``k`` stands in the frame, which is whole or cut back."""

    @per_partition
    def make():
        machine = machine_of(shared.value)
        held: set[tuple[bool, str, str, int]] = set()

        def drain() -> dict[str, list]:
            out: dict[str, list] = {x: [h[j] for h in held] for j, x in enumerate(("whole", "lft", "rgt", "k"))}
            held.clear()
            return out

        def batch(titles, texts):
            for t in _joint(titles, texts):
                for a, b, k in find(machine, t):
                    left, right = _frame(t, a, b)
                    if left.strip() and right and (True, left, right, k) not in held:
                        held.add((True, left, right, k))
                        left, right = _cut_back(left, right)
                        if len(left.strip()) > 1 and right:
                            held.add((False, left, right, k))
            return drain() if len(held) > FLUSH else {"whole": [], "lft": [], "rgt": [], "k": []}

        batch.close = drain
        return batch

    return make


class _Frames:
    """Finds what stands in frames: left sides by one automaton, the right sides of a left side by another where they are many."""

    FEW = 6

    def __init__(self, frames: list[tuple[str, str]], first: int) -> None:
        by_left: dict[str, dict[str, int]] = {}
        for k, (left, right) in enumerate(frames):
            by_left.setdefault(left, {})[right] = first + k
        self.lefts = ahocorasick.Automaton()
        for left, rights in by_left.items():
            self.lefts.add_word(left, (list(rights.items()), machine_of(rights) if len(rights) > self.FEW else None))
        self.lefts.make_automaton()
        self.judged: dict[str, bool] = {}

    def fillers(self, t: str) -> Iterator[tuple[str, int]]:
        """``(filler, frame)`` for each left side and the first place of each of its right sides after it."""
        if not len(self.lefts):
            return
        judged = self.judged
        for end, (rights, machine) in self.lefts.iter(t):
            window = t[end + 1 : end + 49]
            if machine is None:
                at = [(k, c) for right, k in rights if (c := window.find(right)) > 1]
            else:
                first: dict[int, int] = {}
                for e, (size, k) in machine.iter(window):
                    first.setdefault(k, e - size + 1)
                at = [(k, c) for k, c in first.items() if c > 1]
            if at:
                bad = _BAD.search(window)
                stop = bad.start() if bad else len(window)
                for k, c in at:
                    if c <= stop:
                        filler = window[:c].strip()
                        good = judged.get(filler)
                        if good is None:
                            if len(judged) >= FLUSH:
                                judged.clear()
                            good = judged[filler] = _good(filler)
                        if good:
                            yield filler, k


def _fillers(shared, known, first: int):
    @per_partition
    def make():
        frames, skip = _Frames(shared.value, first), known.value
        held: Counter = Counter()

        def drain() -> dict[str, list]:
            out = {"phrase": [p for p, _ in held], "frame": [f for _, f in held], "n": list(held.values())}
            held.clear()
            return out

        def batch(titles, texts):
            for t in _joint(titles, texts):
                held.update(x for x in frames.fillers(t) if x[0] not in skip)
            return drain() if len(held) > FLUSH else {"phrase": [], "frame": [], "n": []}

        batch.close = drain
        return batch

    return make


def _blocks(df: DataFrame) -> Iterator[list[tuple]]:
    """The rows of a checkpointed table in blocks of about ``BLOCK``, one on the driver at a time."""
    parts = -(-df.count() // BLOCK)
    for k in range(parts):
        yield sorted(tuple(r) for r in df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == k).collect())


def induced(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """``(phrase)``: what stands where keywords stand, at least 4 times and in 2 frames, counted over all of :func:`folded`; the keywords themselves are left out."""
    sc = docs.sparkSession.sparkContext
    words, rows = sc.broadcast(known), docs.select("ft", "fs")
    seen = map_rows(rows, _keyword_frames(words), "whole boolean, lft string, rgt string, k int").distinct()
    counts = seen.groupBy("whole", "lft", "rgt").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("whole"), 3).otherwise(4))
    found, first = [], 0
    for block in _blocks(cut(counts.select("lft", "rgt").distinct())):
        found.append(map_rows(rows, _fillers(sc.broadcast(block), words, first), "phrase string, frame bigint, n bigint"))
        first += len(block)
    if not found:
        return docs.sparkSession.createDataFrame([], "phrase string")
    by_frame = reduce(DataFrame.unionByName, found).groupBy("phrase", "frame").agg(F.sum("n").alias("n"))
    return cut(by_frame.groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("frames")).where("n >= 4 and frames >= 2").select("phrase"))


_BAD = re.compile(r"[\n0.!?,;:。！？、，\"“”«»「」()（）\[\]{}]")


def _good(p: str) -> bool:
    """Whether a stretch without any of ``_BAD`` may be a phrase."""
    return 2 <= len(p) <= 24 if _DENSE.search(p) else len(p) >= 4 and len(p.split()) <= 5


def _edges(shared):
    @per_partition
    def make():
        machine = machine_of(shared.value)
        judge = residue.ExemplarIndex()

        def batch(ids, titles, summaries, sources, ft, fs):
            out: dict[str, list] = {"doc": [], "phrase": [], "title": [], "n": []}
            for i, t, s, src, low_t, low_s in zip(ids, titles, summaries, sources, ft, fs):
                got: dict[int, list[int]] = {}
                for text, low, at in ((t, low_t, 0), (s, low_s, 1)):
                    hits = list(find(machine, low))
                    if hits and not judge.is_residue(text, low, src):
                        for _, _, k in hits:
                            got.setdefault(k, [0, 0])[at] += 1
                for k, (a, b) in got.items():
                    out["doc"].append(i)
                    out["phrase"].append(k)
                    out["title"].append(a)
                    out["n"].append(b)
            return out

        return batch

    return make


def _block_hits(shared):
    """All matches of a block's phrases, those that overlap too; ``name`` tells rows of one id apart."""

    @per_partition
    def make():
        machine = machine_of(shared.value)
        judge = residue.ExemplarIndex()

        def batch(ids, names, titles, summaries, sources, ft, fs):
            out: dict[str, list] = {x: [] for x in ("doc", "name", "at", "a", "size", "phrase")}
            for i, name, t, s, src, low_t, low_s in zip(ids, names, titles, summaries, sources, ft, fs):
                for text, low, at in ((t, low_t, 0), (s, low_s, 1)):
                    hits = matches(machine, low)
                    if hits and not judge.is_residue(text, low, src):
                        for a, size, _, k in hits:
                            for x, v in zip(out, (i, name, at, a, size, k)):
                                out[x].append(v)
            return out

        return batch

    return make


def _settle(docs, ats, hits):
    """The leftmost longest of a text's matches; rows stored several times have each match as often, and count as often."""
    out: dict[str, list] = {"doc": [], "phrase": [], "title": [], "n": []}
    for i, at, own in zip(docs, ats, hits):
        times = Counter((h["a"], h["size"], h["a"] - h["size"], h["phrase"]) for h in own)
        for hit in leftmost(sorted(times)):
            out["doc"].append(i)
            out["phrase"].append(hit[3])
            out["title"].append(0 if at else times[hit])
            out["n"].append(times[hit] if at else 0)
    return out


def _marks(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(len(SUBJECTS))]


def document_phrases(df: DataFrame, blocks: list, row_id: str, title: str, text: str, source: str) -> DataFrame:
    """:func:`folded_phrases` of documents as they are stored."""
    return folded_phrases(folded(df, row_id, title, text, source), blocks)


def folded_phrases(docs: DataFrame, blocks: list) -> DataFrame:
    """The graph's edges ``(doc, phrase, title, n)``: how often a document's title and text hold a phrase.

    ``blocks`` are broadcasts of phrases with their numbers. The documents are scanned once for each block.
    """
    own = ["title", "summary", "source"]
    if len(blocks) == 1:
        return map_rows(docs.select("doc", *own, "ft", "fs"), _edges(blocks[0]), "doc bigint, phrase int, title int, n int")
    named = docs.select("doc", F.xxhash64(*own).alias("name"), *own, "ft", "fs")
    hits = reduce(DataFrame.unionByName, [map_rows(named, _block_hits(b), "doc bigint, name bigint, at int, a int, size int, phrase int") for b in blocks])
    texts = hits.groupBy("doc", "name", "at").agg(F.collect_list(F.struct("a", "size", "phrase")).alias("hits"))
    return map_rows(texts.select("doc", "at", "hits"), _settle, "doc bigint, phrase int, title int, n int")


def propagate(edges: DataFrame, fixed: DataFrame, hand: DataFrame, rounds: int = ROUNDS, least: float = 0.45, bear: float = 0.2) -> DataFrame:
    """``(phrase, w0..w8)``: what each phrase says about a document's subjects.

    ``fixed(phrase, subject)`` and ``hand(doc, subject)`` are the seeds, subjects by number. Labels go from phrases to documents, which are
    normalised, and back; a phrase whose documents agree less than ``least`` carries none. A hand label is trusted, and clamped, where the
    document's phrases give its subject at least ``bear``, or nothing at all. Rounds go on until no more than ``MOVING`` of the labels change by over
    ``STILL``; after ``rounds`` that is an error.
    """
    w, p, h = _marks("w"), _marks("p"), _marks("h")
    clamp = fixed.groupBy("phrase").agg(*[F.max((F.col("subject") == k).cast("double")).alias(f"c{k}") for k in range(len(SUBJECTS))])
    labels = clamp.select("phrase", *[F.col(f"c{k}").alias(w[k]) for k in range(len(SUBJECTS))])
    # documents without a phrase don't matter here
    flags = small(cut(hand.groupBy("doc").agg(*[F.max((F.col("subject") == k).cast("double")).alias(x) for k, x in enumerate(h)])))
    # clamped phrases take no label back from their documents
    open_edges = edges.join(small(cut(clamp.select("phrase"))), "phrase", "left_anti")
    for _ in range(rounds):
        mention = F.col("title") * TITLE + F.col("n")
        docs = edges.join(small(labels), "phrase").groupBy("doc").agg(*[F.sum(mention * F.col(x)).alias(p[k]) for k, x in enumerate(w)])
        total = sum((F.col(x) for x in p[1:]), F.col(p[0]))
        docs = docs.select("doc", *[F.when(total > 0, F.col(x) / total).otherwise(0.0).alias(x) for x in p])
        docs = docs.join(flags, "doc", "left")
        borne = [F.coalesce(F.col(h[k]), F.lit(0.0)) * (F.coalesce(F.col(p[k]), F.lit(1.0)) >= bear).cast("double") for k in range(len(SUBJECTS))]
        trusted = sum(borne[1:], borne[0])
        docs = docs.select("doc", *[F.when(trusted > 0, borne[k] / trusted).otherwise(F.coalesce(F.col(p[k]), F.lit(0.0))).alias(p[k]) for k in range(len(SUBJECTS))])
        sums = open_edges.join(docs, "doc").groupBy("phrase").agg(*[F.sum((F.col("title") + F.col("n")) * F.col(x)).alias(x) for x in p])
        n = sum((F.col(x) for x in p[1:]), F.col(p[0]))
        shares = sums.withColumn("_n", n).where("_n > 0").select("phrase", *[(F.col(x) / F.col("_n")).alias(x) for x in p])
        cubes = sum((F.pow(F.col(x), 3) for x in p[1:]), F.pow(F.col(p[0]), 3))
        free = shares.where(F.greatest(*p) > least).select("phrase", *[(F.pow(F.col(p[k]), 3) / cubes).alias(w[k]) for k in range(len(SUBJECTS))])
        new = cut(clamp.select("phrase", *[F.col(f"c{k}").alias(w[k]) for k in range(len(SUBJECTS))]).unionByName(free))
        before = labels.select("phrase", *[F.col(x).alias(f"_{x}") for x in w])
        change = F.greatest(*[F.abs(F.coalesce(F.col(x), F.lit(0.0)) - F.coalesce(F.col(f"_{x}"), F.lit(0.0))) for x in w])
        moved, n = new.join(before, "phrase", "full").agg(F.count_if(change > STILL), F.count("*")).first()
        labels = new
        if moved <= MOVING * n:
            return labels
    raise RuntimeError(f"{moved} of {n} labels still change after {rounds} rounds")


def decide(edges: DataFrame, labels: DataFrame, alone: float = 0.28, beside: float = 0.45) -> DataFrame:
    """``(doc, subject, share)``: the subjects a document reports on, and their share of its mentions.

    A subject of the title counts. One of the text alone must have ``alone`` of its mentions, or ``beside`` where the title names others.
    """
    w = _marks("w")
    both = edges.join(small(labels), "phrase")
    sums = both.groupBy("doc").agg(*[F.sum(F.col("title") * F.col(x)).alias(f"t{k}") for k, x in enumerate(w)], *[F.sum(F.col("n") * F.col(x)).alias(f"n{k}") for k, x in enumerate(w)])
    titled = sum((F.col(f"t{k}") for k in range(1, len(SUBJECTS))), F.col("t0"))
    texted = sum((F.col(f"n{k}") for k in range(1, len(SUBJECTS))), F.col("n0"))
    rows = F.array(*[F.struct(F.lit(s).alias("subject"), F.col(f"t{k}").alias("t"), F.col(f"n{k}").alias("n")) for k, s in enumerate(SUBJECTS)])
    own = sums.select("doc", titled.alias("_t"), texted.alias("_n"), F.explode(rows).alias("x")).select("doc", "_t", "_n", "x.*")
    share = F.when(F.col("_n") > 0, F.col("n") / F.col("_n")).otherwise(0.0)
    keep = (F.col("t") > 0.5) | (share >= F.when(F.col("_t") > 0.5, beside).otherwise(alone))
    return own.where(keep & (F.col("t") + F.col("n") > 0.5)).select("doc", "subject", ((F.col("t") * TITLE + F.col("n")) / (F.col("_t") * TITLE + F.col("_n"))).alias("share"))


@per_partition
def _usable():
    """Documents with a title or a text that is not residue, nor a slot and nothing else."""
    judge = residue.ExemplarIndex()

    def usable(text: str | None, source: str | None) -> bool:
        if not text or text == PLACEHOLDER:
            return False
        rest = residue.without_slots(text)
        return any(map(str.isalnum, rest)) and judge.judge(rest, source) != "residue"

    def batch(ids, titles, summaries, sources):
        return {"doc": [i for i, t, s, src in zip(ids, titles, summaries, sources) if usable(t, src) or usable(s, src)]}

    return batch


def seeds(rows: DataFrame, edges: DataFrame, labels: DataFrame, hand: DataFrame, bear: float = 0.2) -> DataFrame:
    """``(doc, subject, share)`` of the hand labels that are trusted, as in :func:`propagate`, in documents with a usable title or text.

    ``rows`` are ``(doc, title, text, source)``.
    """
    w, p = _marks("w"), _marks("p")
    hand = cut(hand.distinct())
    docs = small(cut(hand.select("doc").distinct()))
    good = map_rows(rows.join(docs, "doc", "left_semi"), _usable, "doc bigint").distinct()
    mention = F.col("title") * TITLE + F.col("n")
    sums = edges.join(docs, "doc", "left_semi").join(small(labels), "phrase").groupBy("doc").agg(*[F.sum(mention * F.col(x)).alias(p[k]) for k, x in enumerate(w)])
    total = sum((F.col(x) for x in p[1:]), F.col(p[0]))
    shares = sums.select("doc", F.array(*[F.when(total > 0, F.col(x) / total).otherwise(0.0) for x in p]).alias("p"))
    named = hand.join(good, "doc").join(shares, "doc", "left")
    own = F.element_at(F.col("p"), F.col("subject").cast("int") + 1)
    per = named.groupBy("doc").agg(F.count("*").alias("of"))
    borne = named.where(F.col("p").isNull() | (own >= bear)).join(per, "doc")
    name = F.element_at(F.array(*map(F.lit, SUBJECTS)), F.col("subject").cast("int") + 1)
    return borne.select("doc", name.alias("subject"), F.coalesce(own, 1 / F.col("of")).alias("share"))


def subjects(df: DataFrame, lexicon: DataFrame, hand: DataFrame, row_id: str = "ingest_seq", title: str = "title", text: str = "summary", source: str = "source") -> DataFrame:
    """``(<row_id>, subject, share)`` of every document with a usable title or text.

    ``lexicon(category, keyword)`` may have ``KEYWORDS`` rows, more are an error; ``hand(<row_id>, subject)`` may have wrong labels and several rows a document.
    """
    spark = df.sparkSession
    number = {s: k for k, s in enumerate(SUBJECTS)}
    words = [(r["keyword"], number[r["category"]]) for r in lexicon.where(F.col("category").isin(SUBJECTS) & (F.length("keyword") > 1)).select("category", "keyword").distinct().orderBy("keyword", "category").limit(KEYWORDS + 1).collect()]
    if len(words) > KEYWORDS:
        raise ValueError(f"the lexicon has over {KEYWORDS} keywords; raise KEYWORDS if the driver and the workers can hold them")
    at: dict[str, int] = {}
    for k, _ in words:
        at.setdefault(fold(k), len(at))
    blocks, n = [at], len(at)
    # written once for all scans
    texts, docs = scratch(spark, "subject-texts"), folded(df, row_id, title, text, source)
    docs.write.parquet(texts)
    docs = spark.read.schema(docs.schema).parquet(texts)
    for block in _blocks(induced(docs, at)) if at else ():
        own = {p: n + k for k, (p,) in enumerate(block)}
        n += len(own)
        blocks.append(own)
    # the keywords go with the first block
    blocks = [{**blocks[0], **blocks[1]}, *blocks[2:]] if len(blocks) > 1 else blocks
    fixed = spark.createDataFrame([(at[fold(k)], s) for k, s in words], "phrase int, subject int")
    marks = hand.select(F.col(row_id).cast("bigint").alias("doc"), *[F.col("subject")]).join(F.broadcast(spark.createDataFrame(list(number.items()), "subject string, k int")), "subject").select("doc", F.col("k").alias("subject"))
    # a document's edges lie together once and for all, so no round moves them: only the phrases' sums are shuffled
    parts, path, name = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), scratch(spark, "subject-edges"), f"tidewrack_{os.urandom(8).hex()}"
    raw = folded_phrases(docs, [spark.sparkContext.broadcast(b) for b in blocks])
    raw.repartition(parts, "doc").write.bucketBy(parts, "doc").sortBy("doc").option("path", path).saveAsTable(name)
    remove(spark, texts)
    edges = spark.table(name)
    labels = propagate(edges, fixed, marks)
    rows = df.select(F.col(row_id).cast("bigint").alias("doc"), title, text, source)
    every = decide(edges, labels).withColumn("_seed", F.lit(0)).unionByName(seeds(rows, edges, labels, marks).withColumn("_seed", F.lit(1)))
    # a subject that was decided keeps its own share
    found = cut(every.groupBy("doc", "subject").agg(F.min_by("share", "_seed").alias("share")).select(F.col("doc").alias(row_id), "subject", "share"))
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)
    return found
