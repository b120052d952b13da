"""Problem 6: lines that a source puts on many of its documents.

Each task parses the lines of a source into a token tree of fixed depth: by the number of tokens, then by the first ``DEPTH`` tokens, to a group of
templates. A line joins the template of its group that agrees with it in most places, if these are at least ``similar`` of all; the places
where they differ become wildcard slots. Figures are slots from the start. The trees of all tasks are merged by distributed sums under the
templates' 128-bit names; the templates that cover many rows of their source are the repeated ones.

Two results. ``repeated_lines`` keeps the project's sameness: lines are the same if they differ in case, spacing, punctuation and figures only, so a
template's line is repeated only with the fillings of its slots that many rows hold. Rows are summed by filling, which is exact however the tasks have learned their
templates; the templates of repeated fillings, from all tasks, are merged into one tree a source, and every line is parsed against that: it is a case if a
template that it fits has its filling. ``learned_templates`` counts templates whatever their fillings: as tasks learn them apart, the sums only name candidates, all
lines are then parsed against these (a line belongs to the most general one that it fits), and counted again.

Only names, counts and the templates that cover many rows leave a task, so one hot source costs as much as any other.

Defined results: null and empty texts have no lines; a null or empty source has no templates; rows with equal ids count as rows of
their own; columns beyond the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import PLACEHOLDER, map_rows, nfkc, per_partition
from tidewrack.runtime import bounded, cut, remove, scratch, small

_WORD = re.compile(r"(?:[^\W_]|[ัิ-ฺ็-๎])+")
_DIGITS = re.compile(r"\d+")

#: What stands for figures, and for any token, in a template: letters that no text has once compatibility forms are unified.
FIGURE, SLOT = "²", "³"
_FIGURES = re.compile(FIGURE + "{2,}")
#: Levels of the tree that branch on tokens; share of a template's places that must agree for a line to join it, where slots are learned.
DEPTH, SIMILAR = 2, 0.5
#: Templates that a task, and a group of its tree, hold before the task hands its counts on.
FLUSH_LEAVES, FLUSH_GROUP = 200_000, 512


def tokens(line: str) -> tuple[str, ...]:
    """The words of a line in lower case, each run of figures a slot."""
    return tuple(_WORD.findall(_DIGITS.sub(FIGURE, nfkc(line).lower())))


def strict(words: tuple[str, ...]) -> str:
    """What lines have in common that differ in case, spacing, punctuation and figures only; '' without a letter or figure."""
    key = "".join(words)
    return _FIGURES.sub(FIGURE, key) if FIGURE * 2 in key else key


def template(line: str) -> str:
    """The strict template of a line."""
    return strict(tokens(line))


def shown(key: tuple[str, ...]) -> str:
    """A template as text: ``<#>`` for figures and ``<*>`` for other slots."""
    return " ".join(key).replace(FIGURE, "<#>").replace(SLOT, "<*>")


def fits(key: tuple[str, ...], words: tuple[str, ...]) -> bool:
    """Whether a line's tokens have those of a template wherever it has no slot."""
    return len(key) == len(words) and all(k == w or k == SLOT for k, w in zip(key, words))


class TokenTree:
    """Templates of one source. A group is a list of ``[key, count]``; ``exact`` finds the template that a line with known tokens belongs to."""

    def __init__(self, similar: float = SIMILAR) -> None:
        self.similar = similar
        self.root: dict = {}
        self.exact: dict[tuple[str, ...], list] = {}
        self.size = self.widest = 0

    def group(self, words: tuple[str, ...], grow: bool = True) -> list | None:
        """The group that the path of a line leads to: its length, then its first tokens."""
        node = self.root
        for step in (len(words), *words[: DEPTH - 1]):
            node = node.setdefault(step, {}) if grow else node.get(step, {})
        last = words[DEPTH - 1] if len(words) >= DEPTH else ""
        return node.setdefault(last, []) if grow else node.get(last)

    def add(self, words: tuple[str, ...], n: int = 1) -> list:
        """Counts a line under its template and returns that."""
        known = self.exact.get(words)
        if known is None:
            own, best, most = self.group(words), None, 0
            # without slots only equal lines agree, and those are known
            for x in own if self.similar < 1 else ():
                agree = sum(a == b for a, b in zip(x[0], words))
                if agree > most:
                    best, most = x, agree
            if best is not None and most >= max(self.similar * len(words), min(2, len(words))):
                best[0] = tuple(a if a == b else SLOT for a, b in zip(best[0], words))
                known = best
            else:
                known = [words, 0]
                own.append(known)
                self.size += 1
                self.widest = max(self.widest, len(own))
            self.exact[words] = known
        known[1] += n
        return known

    def leaves(self):
        yield from {id(x): x for x in self.exact.values()}.values()


def _name(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _grow(similar: float = SIMILAR, fillings: bool = True):
    """``(source, leaf, n, key)`` of a task's trees: rows that hold a line, by the name of its strict form, and the template ``key`` that it is a filling of; without
    ``fillings`` rows that hold a template, by the template's name.

    A row counts once for each. Lines of other spacing have tokens and a template of their own, but the same name, so a row's are told apart by that.
    """

    @per_partition
    def make():
        trees: dict[str, TokenTree] = {}
        rows: dict[str, dict[tuple[str, ...], int]] = {}  # of each source's lines
        none: dict[str, list] = {"source": [], "leaf": [], "n": [], "key": []}

        def drain() -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in none}
            for source, tree in trees.items():
                met = ((_name(strict(w)), n, tree.exact[w][0]) for w, n in rows[source].items()) if fillings else ((_name("\n".join(key)), n, key) for key, n in tree.leaves())
                for leaf, n, key in met:
                    out["source"].append(source)
                    out["leaf"].append(leaf)
                    out["n"].append(n)
                    out["key"].append(list(key))
            trees.clear()
            rows.clear()
            return out

        def batch(sources, texts):
            full = False
            for s, t in zip(sources, texts):
                if not s or not t:
                    continue
                tree = trees.get(s)
                if tree is None:
                    tree, rows[s] = trees.setdefault(s, TokenTree(similar)), {}
                lines = [w for x in t.split("\n") if x != PLACEHOLDER and (w := tokens(x))]
                met = {id(x): x for x in (tree.add(w, 0) for w in dict.fromkeys(lines))}
                for x in met.values():
                    x[1] += 1
                if fillings:
                    own, named = rows[s], set()
                    for words in dict.fromkeys(lines):
                        name = strict(words) if len(lines) > 1 else ""
                        own[words] = own.get(words, 0) + (name not in named)
                        named.add(name)
                full = full or tree.widest > FLUSH_GROUP
            return drain() if full or sum(len(t.exact) for t in trees.values()) > FLUSH_LEAVES else none

        batch.close = drain
        return batch

    return make


def _totals(src: DataFrame) -> DataFrame:
    return src.where(F.trim("source") != "").groupBy("source").agg(F.count("*").alias("of"))


def _grown(src: DataFrame, similar: float, fillings: bool) -> DataFrame:
    rows = src.where((F.col("source") != "") & F.col("text").isNotNull())
    return map_rows(rows, _grow(similar, fillings), "source string, leaf binary, n bigint, key array<string>")


def _merged(similar: float):
    def merge(table: pa.Table) -> pa.Table:
        """The templates of one source from all tasks, put into one tree, where similar ones become one; a line that fits a template fits what that became."""
        tree, keys = TokenTree(similar), [tuple(x) for x in table["key"].to_pylist()]
        for key in sorted(set(keys), key=lambda x: (-x.count(SLOT), x)):
            tree.add(key, 0)
        out = pa.array([list(tree.exact[key][0]) for key in keys], pa.list_(pa.string()))
        return pa.table({"source": table["source"], "leaf": table["leaf"], "key": out})

    return merge


def repeated_fillings(df: DataFrame, source: str = "source", text: str = "summary", min_rows: int = 5, min_share: float = 0.03, similar: float = SIMILAR) -> DataFrame:
    """``(source, leaf, key)``: the merged templates, and by the names of their lines the fillings that stand in at least ``min_rows`` rows and ``min_share`` of all rows of their source."""
    src, spark = df.select(F.col(source).alias("source"), F.col(text).alias("text")), df.sparkSession
    # the trees of all tasks are read twice, so they are written once
    path, own = scratch(spark, "lines"), _grown(src, similar, True)
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    counts = own.groupBy("source", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    kept = small(cut(counts.join(_totals(src), "source").where(F.col("n") >= F.col("of") * min_share).select("source", "leaf")))
    own = own.join(kept, ["source", "leaf"], "left_semi").select("source", "leaf", "key").distinct()
    merged = cut(own.groupBy("source").applyInArrow(_merged(similar), "source string, leaf binary, key array<string>").distinct())
    remove(spark, path)
    return merged


def _fitted(shared):
    """``(source, key, n)``: rows with a line that belongs to a candidate template."""

    @per_partition
    def make():
        trees: dict[str, TokenTree] = {}
        # the most general template of a group comes first, so it is the one a line is given to
        for source, key in sorted(shared.value, key=lambda x: (-x[1].count(SLOT), x)):
            trees.setdefault(source, TokenTree()).group(key).append(key)
        counts: dict[tuple[str, tuple[str, ...]], int] = {}

        def batch(sources, texts):
            for s, t in zip(sources, texts):
                tree = trees.get(s)
                if tree is not None and t:
                    lines = {tokens(x) for x in t.split("\n") if x != PLACEHOLDER} - {()}
                    for key in {k for w in lines if (k := next((k for k in tree.group(w, False) or () if fits(k, w)), None))}:
                        counts[s, key] = counts.get((s, key), 0) + 1
            return {"source": [], "key": [], "n": []}

        def close():
            return {"source": [s for s, _ in counts], "key": [list(k) for _, k in counts], "n": list(counts.values())}

        batch.close = close
        return batch

    return make


def learned_templates(df: DataFrame, source: str = "source", text: str = "summary", similar: float = SIMILAR, min_rows: int = 5, min_share: float = 0.03, most: int = 100_000) -> DataFrame:
    """``(source, template, n, of)``: templates with learned slots that stand in at least ``min_rows`` rows and ``min_share`` of their source's rows.

    A path's first tokens are never slots. Candidates are the templates that the trees together saw in half of that; a source has at most
    ``lines per row / min_share`` of them, and over ``most`` in all are an error. Their rows are then counted by parsing all lines against them.
    """
    src = df.select(F.col(source).alias("source"), F.col(text).alias("text"))
    totals = cut(_totals(src))
    seen = _grown(src, similar, False).groupBy("source", "leaf").agg(F.sum("n").alias("n"), F.first("key").alias("key")).where(F.col("n") >= min_rows / 2)
    found = seen.join(totals, "source").where(F.col("n") >= F.col("of") * min_share / 2).select("source", "key").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} candidate templates; raise min_share")
    # a template that a more general one covers is merged into it
    general: dict[tuple[str, int], list[tuple[str, ...]]] = {}
    for s, key in sorted(((r["source"], tuple(r["key"])) for r in found), key=lambda x: (-x[1].count(SLOT), x)):
        own = general.setdefault((s, len(key)), [])
        if not any(fits(g, key) for g in own):
            own.append(key)
    shared = df.sparkSession.sparkContext.broadcast([(s, k) for (s, _), keys in general.items() for k in keys])
    counts = map_rows(src.where(F.col("text").isNotNull()), _fitted(shared), "source string, key array<string>, n bigint").groupBy("source", "key").agg(F.sum("n").alias("n"))
    text_of = F.replace(F.replace(F.array_join("key", " "), F.lit(FIGURE), F.lit("<#>")), F.lit(SLOT), F.lit("<*>"))
    kept = counts.join(totals, "source").where((F.col("n") >= min_rows) & (F.col("n") >= F.col("of") * min_share))
    return kept.select("source", text_of.alias("template"), "n", "of")


def _lines(ids, sources, texts):
    out: dict[str, list] = {"rec": [], "source": [], "line_no": [], "leaf": []}
    for i, s, t in zip(ids, sources, texts):
        if s and t and t != PLACEHOLDER:
            for k, line in enumerate(t.split("\n")):
                key = template(line) if line != PLACEHOLDER else ""
                if key:
                    out["rec"].append(i)
                    out["source"].append(s)
                    out["line_no"].append(k)
                    out["leaf"].append(_name(key))
    return out


def _parsed(shared):
    """``(rec, line_no)`` of the lines that fit a merged template with a repeated filling."""

    @per_partition
    def make():
        trees: dict[str, TokenTree] = {}
        for source, key, names in shared.value:
            trees.setdefault(source, TokenTree()).group(key).append((key, names))

        def batch(ids, sources, texts):
            out: dict[str, list] = {"rec": [], "line_no": []}
            for i, s, t in zip(ids, sources, texts):
                tree = trees.get(s)
                if tree is None or not t:
                    continue
                for k, line in enumerate(t.split("\n")):
                    words = tokens(line) if line != PLACEHOLDER else ()
                    met = [names for key, names in tree.group(words, False) or () if fits(key, words)] if words else None
                    if met and (name := _name(strict(words))) and any(name in names for names in met):
                        out["rec"].append(i)
                        out["line_no"].append(k)
            return out

        return batch

    return make


def repeated_lines(df: DataFrame, row_id: str = "ingest_seq", source: str = "source", text: str = "summary", min_rows: int = 5, min_share: float = 0.03) -> DataFrame:
    """``(<row_id>, line_no)`` of every repeated line.

    A source has at most ``lines per row / min_share`` repeated fillings, so the merged trees are few; they are counted and handed to all tasks up to
    a bound. Beyond it the lines are joined with the fillings by name in a shuffle, with the same result.
    """
    kept, of = repeated_fillings(df, source, text, min_rows, min_share), dict(df.dtypes)[row_id]
    if bounded(kept):
        fillings: dict[tuple[str, tuple[str, ...]], set[bytes]] = {}
        for r in kept.collect():
            fillings.setdefault((r["source"], tuple(r["key"])), set()).add(bytes(r["leaf"]))
        shared = df.sparkSession.sparkContext.broadcast([(s, key, names) for (s, key), names in fillings.items()])
        lines = map_rows(df.select(row_id, source, text), _parsed(shared), f"rec {of}, line_no int")
    else:
        lines = map_rows(df.select(row_id, source, text), _lines, f"rec {of}, source string, line_no int, leaf binary").join(kept, ["source", "leaf"], "left_semi")
    return lines.select(F.col("rec").alias(row_id), "line_no")


def strip_lines(df: DataFrame, row_id: str = "ingest_seq", source: str = "source", text: str = "summary", **limits) -> DataFrame:
    """``df`` with ``text`` freed of its repeated lines; other texts, null included, stay as they are. ``row_id`` must be unique."""
    found = repeated_lines(df, row_id, source, text, **limits).groupBy(row_id).agg(F.collect_set("line_no").alias("_gone"))
    parts = F.split(F.col(text), "\n")
    kept = F.array_join(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"])), lambda s: s["x"]), "\n")
    return df.join(found, row_id, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_gone").select(*df.columns)
