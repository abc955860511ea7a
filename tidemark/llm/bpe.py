"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate decoded halves.

An element is a span of text with the tokens of exactly that span; every text of more than ``LEAF`` characters is halved.
Joining two neighbours re-encodes a window around their border and keeps the tokens outside. On each side the window
reaches to the second safe cut, a place between a character that is no white space and one that is; it grows by a cut
while the new tokens differ from the old ones between its two outermost cuts. No match of the pattern spans a safe
cut and none that begins behind it looks before it, so the tokens outside are those of the joined span whatever
stands further out: that they agree up to the outermost cut proves it for the window, and is checked each time. Where
there are too few cuts the window reaches the span's end, which is re-encoded wholly; so the join is exact for every text and
every way of halving.

Cases: a null or empty text has no tokens; a text without white space is one window; special tokens
are ordinary text; repeated rows and further columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import fresh, small_batches, table

#: Characters that are encoded together; longer spans are halved. Also the ids that are decoded together.
LEAF = 512
#: Characters on each side of a border that are looked at first.
REACH = 32
#: White space as the pattern has it: Python's, without the four separators of ASCII.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
_CUT = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


class Codec:
    """Encoder and decoder for a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.raw = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.digits = {i: str(i).encode() for i in ranks.values()}

    def encode(self, text: str, leaf: int = LEAF, reach: int = REACH) -> list[int]:
        """The ids of a text, by halving and joining."""
        return self._span(text, 0, len(text), leaf, reach)

    def _span(self, text: str, a: int, b: int, leaf: int, reach: int) -> list[int]:
        if b - a <= max(leaf, 2):
            return self.raw.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self._span(text, a, mid, leaf, reach), self._span(text, mid, b, leaf, reach), reach)

    def join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int], reach: int = REACH) -> list[int]:
        """The ids of text[a:b] from those of text[a:mid] and text[mid:b]."""
        before, after = self._cuts_before(text, a, mid, reach), self._cuts_after(text, mid, b)
        inner, outer = next(before, a), next(before, a)
        near, far = next(after, b), next(after, b)
        while True:
            ids = self.raw.encode_ordinary(text[outer:far])
            drop, skip = self._count(reversed(left), text[outer:mid]), self._count(right, text[mid:far])
            stay, last = drop - self._count(reversed(left), text[inner:mid]), skip - self._count(right, text[mid:near])
            known = left[len(left) - drop : len(left) - drop + stay]
            if ids[:stay] != known and outer > a:
                inner, outer = outer, next(before, a)
            elif ids[len(ids) - last :] != right[skip - last : skip] and far < b:
                near, far = far, next(after, b)
            else:
                return left[: len(left) - drop] + ids + right[skip:]

    @staticmethod
    def _cuts_before(text: str, a: int, mid: int, reach: int) -> Iterator[int]:
        """Safe cuts from the border to the left."""
        end = mid
        while end > a + 1:
            low = max(a + 1, end - reach)
            yield from [m.start() for m in _CUT.finditer(text, low, end)][::-1]
            end, reach = low, reach * 2

    @staticmethod
    def _cuts_after(text: str, mid: int, b: int) -> Iterator[int]:
        """Safe cuts from the border to the right."""
        return (m.start() for m in _CUT.finditer(text, mid + 1, b))

    def _count(self, ids, text: str) -> int:
        """How many ids, from one end, make up these characters."""
        need, n = len(text.encode()), 0
        for i in ids:
            if need <= 0:
                break
            need -= len(self.bytes_of[i])
            n += 1
        if need:
            raise AssertionError("a token spans a safe cut")
        return n

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """The bytes of some ids: halves decode by themselves and concatenate."""
        if len(ids) <= max(leaf, 1):
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def ranks_and_pattern(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Place and pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        n, told, back = [], [], []
        for value in batch.column(text):
            ids = c.encode(value.as_py() or "")
            n.append(len(ids))
            told.append(hashlib.sha256(b" ".join(map(c.digits.__getitem__, ids))).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def fields(frame: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in names)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to; ``keep`` names columns to carry, of which those named like one that this adds are left out."""
    small_batches(docs.sparkSession)
    keep = [k for k in (["doc_id"] if keep is None else keep) if k not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    (whole,) = fresh(docs, "text")
    narrow = docs.select(*keep, F.col(text).alias(whole))
    return narrow.mapInArrow(lambda b: _digests(b, path, pattern, whole, keep), f"{fields(docs, keep) + ', ' if keep else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array of int; a column named ``into`` is replaced."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != into]
    if text == into:
        raise ValueError("the text cannot be replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [c.encode(x.as_py() or "") for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, into])

    return docs.mapInArrow(run, f"{fields(docs, names)}, `{into}` array<int>")


def decode_ids(coded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the bytes that each array of ids stands for; a null array decodes to nothing; a column named ``into`` is replaced."""
    small_batches(coded.sparkSession)
    names = [c for c in coded.columns if c != into]
    if ids == into:
        raise ValueError("the ids cannot be replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            back = [c.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(back, pa.binary())], names=[*names, into])

    return coded.mapInArrow(run, f"{fields(coded, names)}, `{into}` binary")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of ids and digest of decoded bytes of every document."""
    return encode_digests(table(spark, sf_dir, "documents"), *ranks_and_pattern())
