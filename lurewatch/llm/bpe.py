"""Byte-level BPE: encoding by merge ranks, and decoding.

A text is cut into pieces by the public pattern; each piece starts as single bytes
and the adjacent pair of least rank, the leftmost of equals, is merged until no
pair has a rank. The pairs of a piece are the leaves of a segment tree that holds
the leftmost minimum; a merge updates the leaves of the two live neighbours and of
the pair itself, each in logarithmic time. Many pieces are merged in step, as rows
of one array; long pieces have a tree of their own.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import add_from_text, once
from lurewatch.llm.pieces import PieceTable, grouped

NONE = np.int64(1) << 40
#: Pieces up to this many bytes are merged together, longer ones one at a time.
SHORT = 64
AT_ONCE = 1 << 11

# --- ranks -------------------------------------------------------------------------


class Ranks:
    """Tokens, and for pairs of tokens the token they merge into.

    A token's id is its rank. Pairs are sorted keys `left * size + right`.
    """

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.size = max(tokens.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in tokens.items():
            self.bytes[rank] = token
        self.single = np.full(256, -1, np.int64)
        for byte in range(256):
            self.single[byte] = tokens.get(bytes([byte]), -1)
        if (self.single < 0).any():
            raise ValueError("the ranks lack a single byte")
        pairs = {}
        for token, rank in tokens.items():
            for at in range(1, len(token)):
                left, right = tokens.get(token[:at]), tokens.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @staticmethod
    def load(path: str) -> Ranks:
        with open(path, "rb") as lines:
            return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], NONE)


# --- merging -------------------------------------------------------------------------


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece by a segment tree over its byte positions."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    none = int(NONE)
    pairs, width = ranks.pairs, ranks.size
    ids = [int(ranks.single[b]) for b in piece]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    # a node holds rank * 2**32 + position: its minimum is the leftmost of the least rank
    tree = [none << 32] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = (pairs.get(ids[i] * width + ids[i + 1], none) << 32) | i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, rank: int) -> None:
        node = size + at
        tree[node] = (rank << 32) | at
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    while tree[1] >> 32 < none:
        rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = following[at]
        ids[at] = rank
        after = following[gone]
        following[at] = after
        if after < n:
            previous[after] = at
        update(gone, none)
        update(at, pairs.get(rank * width + ids[after], none) if after < n else none)
        before = previous[at]
        if before >= 0:
            update(before, pairs.get(ids[before] * width + rank, none))
    found, at = [], 0
    while at < n:
        found.append(ids[at])
        at = following[at]
    return found


def merge_short(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Pieces of similar length, each a row: in a round every row with a pair left merges one."""
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    size = 1 << max(1, int(lengths.max() - 1).bit_length())
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    place = np.arange(size)
    ids = np.where(place < lengths[:, None], ranks.single[raw], -1)
    following = np.tile(place + 1, (rows, 1))
    previous = np.tile(place - 1, (rows, 1))
    none = NONE << 8
    tree = np.full((rows, 2 * size), none, np.int64)
    leaves = ranks.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, size - 1)
    tree[:, size : 2 * size - 1] = (leaves << 8) | place[:-1]
    level = size // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2

    def update(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        node = size + at
        tree[row, node] = (rank << 8) | at
        node = node >> 1
        while node[0]:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    while True:
        row = np.flatnonzero(tree[:, 1] < none)
        if not len(row):
            break
        rank, at = tree[row, 1] >> 8, tree[row, 1] & 255
        gone = following[row, at]
        after = following[row, gone]
        ids[row, at] = rank
        ids[row, gone] = -1
        following[row, at] = after
        inside = after < size
        previous[row[inside], after[inside]] = at[inside]
        update(row, gone, np.full(len(row), NONE))
        update(row, at, ranks.rank(rank, np.where(inside, ids[row, np.minimum(after, size - 1)], -1)))
        before = previous[row, at]
        have = before >= 0
        if have.any():
            update(row[have], before[have], ranks.rank(ids[row[have], before[have]], rank[have]))
    alive = ids >= 0
    flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def merge(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of each piece."""
    found: list[list[int]] = [[]] * len(pieces)
    order = sorted((i for i, p in enumerate(pieces) if p), key=lambda i: len(pieces[i]))
    short = [i for i in order if len(pieces[i]) <= SHORT]
    at = 0
    while at < len(short):
        # rows of one array are of lengths with one tree size
        top = 1 << max(1, (len(pieces[short[at]]) - 1).bit_length())
        end = at
        while end < len(short) and end - at < AT_ONCE and len(pieces[short[end]]) <= top:
            end += 1
        for i, ids in zip(short[at:end], merge_short([pieces[i] for i in short[at:end]], ranks)):
            found[i] = ids
        at = end
    for i in order[len(short) :]:
        found[i] = merge_long(pieces[i], ranks)
    return found


def add_tokens(
    docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded"
) -> DataFrame:
    """Adds the token ids of a text, and the bytes these ids decode to.

    `path` is a rank file on every machine. Null text counts as empty and has no
    ids; texts of any length are encoded whole. Special tokens are ordinary text.
    Columns of the same names are replaced; rows come back as often as they are there.
    """

    def compute():
        ranks = once("ranks", path, lambda: Ranks.load(path))
        known = once("pieces", path, lambda: PieceTable(lambda new: merge(new, ranks)))

        def work(texts: list[str | None]) -> list[pa.Array]:
            return _arrays([x for some in grouped(texts) for x in known.ids_of(some)], ranks, decoded is not None)

        return work

    fields = f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else "")
    return add_from_text(docs, text, fields, compute)


def decode(ids: np.ndarray, ranks: Ranks) -> bytes:
    return b"".join(map(ranks.bytes.__getitem__, ids.tolist()))


def _arrays(lists: list[np.ndarray], ranks: Ranks, decoded: bool) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    values = np.concatenate(lists) if lists else np.zeros(0, "<u4")
    arrays = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int32)))]
    if decoded:
        arrays.append(pa.array([decode(x, ranks) for x in lists], pa.binary()))
    return arrays


def public_path(name: str) -> str:
    return public_tokenizers.path(name)
