"""Helpers of the text operators: Arrow batches in and out, normal forms, scripts."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Mark the store puts in place of an empty summary.
PLACEHOLDER = "(ไม่มีเนื้อหา)"

LANGS = ("en", "th", "de", "fr", "es", "zh", "ja", "vi")


def map_rows(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Maps Arrow batches: ``fn`` gets each column of ``df`` as a list and returns the output columns as lists.

    ``fn`` may also be a factory with the attribute ``per_partition``: it is then called once in each task and gives the
    function for the batches, so that dictionaries and models are built once per task.
    """
    struct: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        f = fn() if getattr(fn, "per_partition", False) else fn
        for b in batches:
            out = f(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for t in target for x in [out[t.name]]], schema=target)
        last = getattr(f, "close", None)
        if last:
            out = last()
            if out and len(out[target.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[t.name], type=t.type) for t in target], schema=target)

    return df.mapInArrow(run, struct)


def per_partition(fn):
    """Marks a factory for :func:`map_rows`."""
    fn.per_partition = True
    return fn


#: Character classes for regular expressions.
THAI, KANA, HAN = "฀-๿", "぀-ヿㇰ-ㇿｦ-ﾟ", "㐀-䶿一-鿿豈-﫿"

_THOUSANDS = re.compile(r"(?<=\d)[.,   '’](?=\d{3}(?!\d))")


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


_ODD_DIGIT = re.compile(r"[^\D0-9]")


def latin_digits(text: str) -> str:
    """All decimal digits written as 0-9."""
    return _ODD_DIGIT.sub(lambda m: str(unicodedata.decimal(m.group())), text)


def clean(text: str) -> str:
    """Entities resolved, compatibility forms and digits unified, thousands marks removed, lower case."""
    if "&" in text:
        text = html.unescape(text)
    text = latin_digits(nfkc(text)).replace("​", "").replace("­", "")
    return _THOUSANDS.sub("", text).lower()


def chosen(df: DataFrame, row_id: str, rows: int) -> DataFrame:
    """At most ``rows`` rows by a hash of their id, the same at each call. All but about as many are left out where they are read, so no task sends more."""
    n = df.count()
    h = F.xxhash64(F.lit(7), F.col(row_id))
    if n > rows:
        df = df.where(F.pmod(h, F.lit(1_000_000)) < F.lit(int(1_000_000 * (1.1 * rows / n)) + 1))
    return df.orderBy(h).limit(rows)
