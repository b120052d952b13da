"""Items of a feed. Works on one document; operators and sources apply it to many."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

# --- Fixed values: names of the feed's extensions, and its last tag.
MEDIA, ENCODED = "{http://search.yahoo.com/mrss/}content", "{http://purl.org/rss/1.0/modules/content/}encoded"
END = "</rss>"


class Item(NamedTuple):
    pos: int
    title: str
    link: str
    description: str
    media_url: str
    enclosure_url: str
    encoded: str


def repaired(text: str) -> str:
    """A feed without what follows its last closing tag."""
    end = text.lower().rfind(END)
    return text if end < 0 else text[: end + len(END)]


def items(text: str, limit: int) -> Iterator[Item]:
    """The first items of a feed; raises ``ParseError`` where it can't be read even after repair."""
    for pos, item in enumerate(ET.fromstring(repaired(text)).iterfind(".//item")):
        if pos >= limit:
            return
        url = [x.get("url", "") if (x := item.find(tag)) is not None else "" for tag in (MEDIA, "enclosure")]
        said = [item.findtext(tag) or "" for tag in ("title", "link", "description", ENCODED)]
        yield Item(pos, unescape(said[0].strip()), said[1].strip(), said[2], *url, said[3])
