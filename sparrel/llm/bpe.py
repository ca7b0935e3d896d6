"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A text is cut into pieces by a pattern. The pieces of a text that were seen before come from a bounded memo; every
other one is merged on a segment tree whose leaves are byte positions and whose leaf value is the rank of the pair of
tokens that starts there. A node holds the least value below it, rank first and position second, so the root names
the leftmost pair of the lowest rank. A merge changes three leaves (the pair, its right half, its left neighbour), each
in logarithmic time, so a piece of n bytes takes O(n log n) even where it is a megabyte without a blank.

Null texts count as empty and give no ids. Rows are independent: ties, repeated rows and columns beside the key and
text change nothing, and an empty table gives an empty result. No shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import chunks

#: Pieces that a worker remembers, and bytes of the longest one that it does.
MEMO_PIECES, MEMO_BYTES = 200_000, 64
#: The value of a leaf whose pair has no rank: above any rank and position.
NO_PAIR = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the pair of lowest rank, the leftmost of equals, is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    shift = width.bit_length()
    none = NO_PAIR
    tree = [none] * (2 * width)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << shift | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    low = (1 << shift) - 1
    while tree[1] < none:
        at = tree[1] & low
        right = after[at]
        end = after[right]
        put(right, none)
        after[at] = end
        r = None
        if end < n:
            before[end] = at
            r = rank(piece[at : after[end]])
        put(at, none if r is None else r << shift | at)
        left = before[at]
        if left >= 0:
            r = rank(piece[left:end])
            put(left, none if r is None else r << shift | left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Memo(dict):
    """Pieces to their packed ids, from their second occurrence on, while there is room.

    Most pieces of a corpus occur once; marks by hash tell which have occurred, so those never take a place. After many
    misses the pieces are no longer those that matter, and it starts anew.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.marks, self.misses = bytearray(1 << 22), 0

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        packed = np.array(merge(raw, self.ranks), dtype="<u4").tobytes()
        if len(self) >= MEMO_PIECES:
            self.misses += 1
            if self.misses > 10 * MEMO_PIECES:
                self.renew()
        elif len(raw) <= MEMO_BYTES:
            mark = hash(piece) & 0x3FFFFF
            if self.marks[mark]:
                self[piece] = packed
            else:
                self.marks[mark] = 1
        return packed


class Codec:
    """An encoder and decoder for one vocabulary; workers keep one for each vocabulary and pattern."""

    _kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.memo = _Memo(self.ranks)
        self.tokens = {i: token for token, i in self.ranks.items()}

    @classmethod
    def get(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _mapped(df: DataFrame, key: str, column: str, out: str, work: Callable[[], Callable]) -> DataFrame:
    """One binary column made of another, beside the key."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in chunks(batches):
            made = pa.array([None if x is None else f(x) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[key, out])

    return df.select(key, column).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField(out, T.BinaryType())]))


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers; null texts: no ids."""
    return _mapped(df.fillna("", [text]), key, text, "ids", lambda: Codec.get(path, pattern).encode)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the bytes that packed ids stand for; null stays null."""
    return _mapped(df, key, ids, "decoded", lambda: Codec.get(path, pattern).decode)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encoded, then decoded from those ids, in one pass over the rows."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path, pattern)
        for batch in chunks(batches):
            ids = [codec.encode(x) for x in batch.column(1).to_pylist()]
            back = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[key, "ids", "decoded"])

    fields = [T.StructField(key, kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return df.fillna("", [text]).select(key, text).mapInArrow(run, T.StructType(fields))
