"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

The encoder is a streaming transducer with bounded lookahead, made from the merge list alone. Text comes in chunks; what can no longer
change is emitted at once and forgotten. Every text takes this way, whatever its length.

* Between pieces: the split pattern looks at most two characters past the end of a piece, so a piece is stable once two more characters
  are there.
* Between characters of a piece: a seam is closed if no token of the vocabulary can lie across it. Merges never cross a closed seam, so
  what stands before it is stable; the vocabulary's tokens say which seams are open.
* Between closed seams: the encoding of every prefix ends with the longest token that is compatible with the encoding before it. A later
  token starts among the last ``longest token`` bytes, so the tokens that all of these prefixes have in common are stable. That length,
  read off the merge list, is the sufficient lookahead.

Memory is constant: the buffer holds a chunk and an unfinished piece of at most ``HOLD`` characters, beyond which a piece is streamed as
bytes; the tables of known pieces, seams and token pairs are emptied when full.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import map_rows, per_partition

#: The split pattern of the rank files, a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Characters fed to the transducer at once, and those of an unfinished piece that are held before its bytes are streamed.
CHUNK, HOLD = 1 << 10, 1 << 9
#: Entries that a table of known pieces, seams or token pairs holds before it is emptied, and characters of a piece that is worth keeping.
KNOWN, KEEP = 200_000, 24


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _starts(byte: int) -> bool:
    """Whether a byte starts a character in UTF-8."""
    return byte & 0xC0 != 0x80


class MergeList:
    """What can be read off a merge list: token bytes, the lookahead, open seams between characters, compatible tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = {t: w for w, t in ranks.items()}
        self.lookahead = max(map(len, ranks))
        self.across = {(w[i:j], w[j:k]) for w in ranks for i, j, k in self._seams(w)}
        self.seams: dict[str, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _seams(word: bytes):
        """Each place within a token where a character starts, with the characters, or parts of them, on both sides."""
        at = [0, *(i for i in range(1, len(word)) if _starts(word[i])), len(word)]
        return zip(at, at[1:], at[2:])

    def open(self, pair: str) -> bool:
        """Whether a token can lie across the seam between two characters."""
        known = self.seams.get(pair)
        if known is None:
            if len(self.seams) >= KNOWN:
                self.seams.clear()
            a, b = pair[0].encode("utf-8", "surrogatepass"), pair[1].encode("utf-8", "surrogatepass")
            known = self.seams[pair] = any((a[i:], b[:k]) in self.across for i in range(len(a)) for k in range(1, len(b) + 1))
        return known

    def merged(self, word: bytes) -> list[int]:
        """The encoding of a few bytes by the merge rule itself: the lowest rank first, the leftmost of equal ones."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= KNOWN:
                self.fits.clear()
            known = self.fits[key] = self.merged(self.words[a] + self.words[b]) == [a, b]
        return known


@lru_cache(maxsize=4)
def load(path: str) -> MergeList:
    return MergeList(load_ranks(path))


class PieceStream:
    """Byte-level BPE of one piece of unbounded length, byte by byte, in constant memory."""

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.buf = bytearray()
        self.last: list[int] = []  # last token of the encoding of each prefix of buf
        self.left: int | None = None  # the token emitted last in this piece

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        ranks, reach, compatible = self.merges.ranks, self.merges.lookahead, self.merges.compatible
        for byte in data:
            self.buf.append(byte)
            n = len(self.buf)
            for size in range(min(n, reach), 0, -1):
                t = ranks.get(bytes(self.buf[n - size :]))
                if t is None:
                    continue
                before = self.last[n - size - 1] if n > size else self.left
                if before is None or compatible(before, t):
                    self.last.append(t)
                    break
            if n >= 2 * reach:
                out += self._settle()
        return out

    def _path(self, end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(end)
            end -= len(self.merges.words[self.last[end - 1]])
        return path[::-1]

    def _settle(self) -> list[int]:
        """Emits what the encodings of all prefixes within the lookahead have in common."""
        n = len(self.buf)
        common = self._path(n)
        for end in range(max(1, n - self.merges.lookahead + 1), n):
            path = self._path(end)
            k = 0
            while k < len(common) and k < len(path) and common[k] == path[k]:
                k += 1
            common = common[:k]
            if not common:
                return []
        out = [self.last[e - 1] for e in common]
        self.left = out[-1]
        del self.last[: common[-1]]
        del self.buf[: common[-1]]
        return out

    def finish(self) -> list[int]:
        out = [self.last[e - 1] for e in self._path(len(self.buf))]
        self.reset()
        return out


class Transducer:
    """Text chunks in, stable token ids out."""

    _piece = regex.compile(PATTERN)
    #: What a piece consists of once it is longer than any contraction, by its last character.
    _runs = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")))

    def __init__(self, path: str) -> None:
        self.merges = load(path)
        self.stream = PieceStream(self.merges)
        self.known = self.merges.known
        self.rest, self.run = "", None

    def feed(self, chunk: str) -> list[int]:
        self.rest += chunk
        out = self._go_on(False) if self.run else []
        if self.run is None:
            pieces = self._piece.findall(self.rest)
            end = len(self.rest)
            while pieces and end + 2 > len(self.rest):
                end -= len(pieces.pop())
            self._emit(pieces, out)
            self.rest = self.rest[end:]
            if len(self.rest) > HOLD:
                self.run = next(r for r in self._runs if r.fullmatch(self.rest[-1]))
                out += self._go_on(False, 1)
        return out

    def _emit(self, pieces: list[str], out: list[int]) -> None:
        known = self.known
        for p in pieces:
            ids = known.get(p)
            out += ids if ids is not None else self._encoded(p)

    def _encoded(self, piece: str) -> list[int]:
        """The ids of a piece not met lately, from closed seam to closed seam."""
        out: list[int] = []
        at, is_open = 0, self.merges.open
        for k in range(1, len(piece) + 1):
            if k == len(piece) or not is_open(piece[k - 1 : k + 1]):
                part = piece[at:k]
                ids = self.known.get(part)
                if ids is None:
                    ids = self._keep(part, self.stream.feed(part.encode("utf-8", "surrogatepass")) + self.stream.finish())
                out += ids
                at = k
        return self._keep(piece, out)

    def _keep(self, piece: str, ids: list[int]) -> list[int]:
        if len(piece) <= KEEP:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _go_on(self, final: bool, skip: int = 0) -> list[int]:
        """Streams the long piece at the start of the buffer; ``skip`` is 1 where a space may lead it."""
        m = self.run.match(self.rest, skip if self.rest[:1].isspace() and self.run is not self._runs[2] else 0)
        end = m.end() if m else 0
        if end == len(self.rest) and not final:
            cut = max(0, end - 2)
            ids = self.stream.feed(self.rest[:cut].encode("utf-8", "surrogatepass"))
            self.rest = self.rest[cut:]
            return ids
        if self.run is self._runs[2] and end < len(self.rest):
            end -= 1  # the last space leads the next piece
        ids = self.stream.feed(self.rest[:end].encode("utf-8", "surrogatepass")) + self.stream.finish()
        self.rest, self.run = self.rest[end:], None
        return ids

    def finish(self) -> list[int]:
        out = self._go_on(True) if self.run else []
        self._emit(self._piece.findall(self.rest), out)
        self.rest = ""
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = [np.array(self.feed(text[i : i + CHUNK]), np.int32) for i in range(0, len(text), CHUNK)]
        return np.concatenate([*parts, np.array(self.finish(), np.int32)])


class Decoder:
    """Ids in, text out as soon as its bytes are complete; broken sequences become U+FFFD."""

    def __init__(self, path: str) -> None:
        self.words = load(path).words
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.words.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def _encode(path: str):
    @per_partition
    def make():
        t = Transducer(path)

        def batch(ids, texts):
            parts = [t.encode(x) for x in texts]
            ends = np.cumsum([0] + [len(p) for p in parts], dtype=np.int64)
            if ends[-1] > np.iinfo(np.int32).max:
                raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch: a batch has over 2^31 tokens")
            values = np.concatenate(parts) if parts else np.empty(0, np.int32)
            return {"doc": ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)).cast(pa.list_(pa.field("element", pa.int32(), True)))}

        return batch

    return make


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``(<doc_id>, ids)``: one row for every row of ``docs``; an empty list for null and empty texts. ``folder`` must exist on the executors."""
    kind = dict(docs.dtypes)[doc_id]
    out = map_rows(docs.select(doc_id, text), _encode(os.path.join(folder, vocabulary)), f"doc {kind}, ids array<int>")
    return out.select(F.col("doc").alias(doc_id), "ids")


def _decode(path: str):
    @per_partition
    def make():
        d = Decoder(path)
        return lambda ids, lists: {"doc": ids, "text": [None if x is None else d.feed(x) + d.finish() for x in lists]}

    return make


def decoded(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``(<doc_id>, text)`` from token ids, the inverse of :func:`token_ids`."""
    kind = dict(encoded.dtypes)[doc_id]
    out = map_rows(encoded.select(doc_id, ids), _decode(os.path.join(folder, vocabulary)), f"doc {kind}, text string")
    return out.select(F.col("doc").alias(doc_id), "text")
