"""Tokens and what is counted on them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*"


def once(c: Column, of) -> Column:
    """``of(c)`` with ``c`` bound to a variable, so the optimizer can't copy an expensive ``c`` into each of its uses."""
    return F.transform(F.array(c), of)[0]


def words(c: Column) -> Column:
    """Lower-case words of scripts with spaces; a run of another script is one token. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({WORDS})"), F.lit(1)), F.array().cast("array<string>"))


def grams(tokens: Column, n: int) -> Column:
    """The contiguous n-grams as strings; overlaps count, fewer than ``n`` tokens have none."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def grams_from(tokens: Column, n: int, starts: list[str]) -> Column:
    """Those of the n-grams whose first token is among ``starts``; the rest are never built."""
    at = F.filter(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.element_at(tokens, i).isin(starts))
    some = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def count_token(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def count_phrase(tokens: Column, parts: list[str]) -> Column:
    return once(tokens, lambda t: F.size(F.filter(grams(t, len(parts)), lambda g: g == " ".join(parts))))


def has_all(tokens: Column, parts: Column) -> Column:
    return F.size(F.array_except(parts, tokens)) == 0


def keyword_weight(keyword: Column) -> Column:
    """2.0 for keywords of over four characters, else 1.0."""
    return F.when(F.length(keyword) > 4, 2.0).otherwise(1.0)


def dictionary_words(dictionary: list[str]):
    """A tokeniser for scripts without spaces: longest match in a bounded word list, what is left in between as one token."""
    dense = "฀-๿぀-ヿ㐀-䶿一-鿿"
    known = sorted({w.lower() for w in dictionary if w and re.search(f"[{dense}]", w)}, key=len, reverse=True)
    longest = re.compile("|".join(map(re.escape, known))) if known else None
    token = re.compile(rf"[{dense}]+|[^\W_]+(?:[-'’][^\W_]+)*")

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        def of(text):
            if not isinstance(text, str):
                return []
            out = []
            for m in token.finditer(text.lower()):
                run, at = m.group(), 0
                if longest is None or not re.match(f"[{dense}]", run):
                    out.append(run)
                    continue
                for k in longest.finditer(run):
                    if k.start() > at:
                        out.append(run[at : k.start()])
                    out.append(k.group())
                    at = k.end()
                if at < len(run):
                    out.append(run[at:])
            return out

        return s.map(of)

    return cut


def softmax(values: Column) -> Column:
    """Normalised exponentials of an array, from the largest value down; the largest value and the total are bound once, not for each element."""

    def scaled(top: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top), lambda total: F.transform(values, lambda x: F.exp(x - top) / total))

    return once(F.array_max(values), scaled)
