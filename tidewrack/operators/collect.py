"""Fetch, gate, save, summarise, and the image proxy. Whatever goes over a network is an injected callable, called in batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import for_model, safe_name, without_fences
from tidewrack.functions.tokens import once
from tidewrack.functions.urls import accepted_request, proxyable
from tidewrack.schema import CATEGORIES, SENTIMENTS, SUMMARY

#: Least length of a page's text in the first two tiers (it must be longer); texts that mark a block page in the second (fixed values).
LEAST, BLOCKED = 100, ("Just a moment", "Enable JavaScript")


def passes(tier: Column, status: Column, md: Column) -> Column:
    """Whether an attempt's text is accepted, tier by tier."""
    long_enough = F.coalesce((status == 200) & (F.length(md) > LEAST), F.lit(False))
    blocked = F.contains(md, F.lit(BLOCKED[0])) | F.contains(md, F.lit(BLOCKED[1]))
    return F.when(tier == 1, long_enough).when(tier == 2, long_enough & ~F.coalesce(blocked, F.lit(False))).otherwise(F.coalesce(md, F.lit("")) != "")


def first_accepted(attempts: DataFrame) -> DataFrame:
    """``(url, tier, md)`` of ``attempts(url, tier, status, md)``: the lowest tier that passes, nulls where none does."""
    best = F.min(F.when(passes(F.col("tier"), F.col("status"), F.col("md")), F.struct("tier", "md"))).alias("b")
    return attempts.groupBy("url").agg(best).select("url", "b.tier", "b.md")


def fetched(requests: DataFrame, strategies: list[tuple[str, Callable[[str], str | None]]]) -> DataFrame:
    """``(url, md, method)``: the first strategy that gives text, in order; one that raises counts as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                md = method = None
                for name, fetch in strategies:
                    try:
                        md = fetch(url)
                    except Exception:  # noqa: BLE001 a failing tier hands over to the next
                        md = None
                    if md:
                        method = name
                        break
                rows.append((url, md or None, method))
            yield pd.DataFrame(rows, columns=["url", "md", "method"])

    valid = requests.select(accepted_request(F.col("url")).alias("url")).where("url is not null")
    return valid.mapInPandas(run, "url string, md string, method string")


class Tier:
    """One way to fetch a page: ``fetch`` gives a status and a text, which must pass the gate of its ``number``; may be used as a strategy of :func:`fetched`."""

    def __init__(self, number: int, fetch: Callable[[str], tuple[int, str | None]]) -> None:
        self.number, self.fetch = number, fetch

    def __call__(self, url: str) -> str | None:
        status, md = self.fetch(url)
        if not md or self.number < 3 and (status != 200 or len(md) <= LEAST):
            return None
        return None if self.number == 2 and any(mark in md for mark in BLOCKED) else md


def tiers(*fetchers: tuple[str, Callable[[str], tuple[int, str | None]]]) -> list[tuple[str, Tier]]:
    """Strategies for :func:`fetched` in the order of their tiers, from ``(name, fetch)`` each."""
    return [(name, Tier(k, fetch)) for k, (name, fetch) in enumerate(fetchers, 1)]


def reader(fetch: Callable[[str], tuple[int, str | None]], prefix: str, retry: bool = True, **limits) -> Callable[[str], tuple[int, str | None]]:
    """A fetcher by way of a reading service, whose address is put before the page's; as a fallback without ``retry`` the page's scheme is repeated."""

    def once_(url: str) -> tuple[int, str | None]:
        return fetch(f"{prefix}{url}" if retry else f"{prefix}http://{url}")

    return retrying(once_, **limits) if retry else once_


def capture_path(url: Column, clock: Column) -> Column:
    """``<stamp>_<safe name>.md``."""
    return F.concat(F.date_format(clock, "yyyyMMdd_HHmmss"), F.lit("_"), safe_name(url), F.lit(".md"))


def capture_text(url: Column, md: Column) -> Column:
    return F.concat(F.lit("# Source URL: "), url, F.lit("\n\n"), md)


def answer_text(answer: Column) -> Column:
    """An answer's struct as JSON, with its nulls; what :func:`parsed_answer` reads."""
    return F.to_json(answer, {"ignoreNullFields": "false"})


def parsed_answer(raw: Column) -> Column:
    """A model's answer as a struct; null if it is no JSON object, has a category or sentiment outside the enumerations, or a list that is null.

    Missing lists are empty; missing fields are null.
    """
    own = once(without_fences(raw), lambda t: F.struct(t.alias("text"), F.from_json(t, SUMMARY).alias("s"), F.json_object_keys(t).alias("keys")))
    return once(own, lambda x: _validated(x["text"], x["s"], x["keys"]))


def _validated(text: Column, s: Column, keys: Column) -> Column:
    listed = lambda name: F.get_json_object(text, f"$.{name}")
    null_list = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False)) & listed(name).isNull()
    bad = keys.isNull() | null_list("bullets") | null_list("keywords") | F.coalesce(~s["category"].isin(*CATEGORIES), F.lit(False)) | F.coalesce(~s["sentiment"].isin(*SENTIMENTS), F.lit(False))
    bad = bad | (listed("bullets").isNotNull() & s["bullets"].isNull()) | (listed("keywords").isNotNull() & s["keywords"].isNull())
    empty = F.array().cast("array<string>")
    fields = [F.coalesce(s[f.name], empty).alias(f.name) if f.name in ("bullets", "keywords") else s[f.name].alias(f.name) for f in SUMMARY.fields]
    return F.when(~F.coalesce(bad, F.lit(True)), F.struct(*fields))


def summarised(captures: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """``captures(url, md)`` with ``summary`` (a struct, null on failure) and ``status``: 200, 422 without text, 500 where the model or its answer fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for prompt in b["_prompt"]:
                try:
                    answers.append(client(prompt) if isinstance(prompt, str) and prompt else None)
                except Exception:  # noqa: BLE001 reported as a status
                    answers.append(None)
            b["_raw"] = answers
            yield b.drop(columns="_prompt")

    own = captures.select("url", "md", "method", for_model(F.col("md")).alias("_prompt"))
    asked = own.mapInPandas(run, "url string, md string, method string, _raw string")
    out = asked.withColumn("summary", parsed_answer(F.col("_raw")))
    status = F.when(F.coalesce("md", F.lit("")) == "", 422).when(F.col("summary").isNull(), 500).otherwise(200)
    return out.select("url", "md", "method", "summary", status.alias("status"))


class Unavailable(Exception):
    """What a fetcher raises for an answer that may be there later (status 503)."""


def retrying(fetch: Callable[[str], str | None], retries: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """``fetch`` tried again after ``Unavailable``, each time a ``delay`` longer; any other error, and the last, is raised."""

    def tried(url: str) -> str | None:
        for n in range(retries):
            try:
                return fetch(url)
            except Unavailable:
                if n + 1 == retries:
                    raise
                sleep(delay * (n + 1))
        return None

    return tried


def collected(requests: DataFrame, strategies: list[tuple[str, Callable[[str], str | None]]], client: Callable[[str], str], clock: Column, save: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The whole way of a request: address check, tiers, file, model, validation; ``(url, path, method, summary, status)``.

    Files of ``captures(path, text)`` are handed to ``save`` before the model is asked, so they stand even where it fails. What was fetched is kept in
    the shared checkpoint folder, so saving and summarising don't fetch twice.
    """
    from tidewrack.runtime import cut

    got = cut(fetched(requests, strategies)).withColumn("path", capture_path(F.col("url"), clock))
    if save is not None:
        save(got.where(F.coalesce("md", F.lit("")) != "").select("path", capture_text(F.col("url"), F.col("md")).alias("text")))
    # one path for each address: a request made twice is answered twice from the same row
    paths = got.groupBy("url").agg(F.first("path").alias("path"))
    return summarised(got, client).join(paths, "url").select("url", F.when(F.col("status") != 422, F.col("path")).alias("path"), "method", "summary", "status")


def proxied_images(requests: DataFrame, hosts: list[str], fetch: Callable[[str], tuple[int, bytes | None]]) -> DataFrame:
    """``(url, status, body)`` of image requests: 400 for an address the proxy doesn't serve, 502 where the other side fails, else 200 and the bytes.

    ``fetch`` gives a status and a body; it is called only for addresses that are served.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, served in zip(b["url"], b["_served"]):
                status, body = 400, None
                if served:
                    try:
                        status, body = fetch(url)
                    except Exception:  # noqa: BLE001 reported as a status
                        status, body = 502, None
                    if status >= 400:
                        status, body = 502, None
                rows.append((url, status, body))
            yield pd.DataFrame(rows, columns=["url", "status", "body"])

    return requests.select("url", proxyable(F.col("url"), hosts).alias("_served")).mapInPandas(run, "url string, status int, body binary")
