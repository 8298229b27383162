"""Byte-level BPE encoding and decoding.

A text is cut by a pattern and every piece is merged on its own. A segment tree over the piece's
byte positions keeps, at each node, the smallest (rank, position) of the adjacent pairs below it, so
its root names the leftmost pair of least rank. A merge rewrites at most three leaves (the merged
pair, its left neighbour and the absorbed position) and the path above each of them.

Short pieces, nearly all, run in lock-step: the trees of many pieces are the rows of one array and
each step merges once in every piece that still has a pair. Long pieces use the same tree one by one.
Pieces recur, so each task keeps a bounded table of finished ones.

Defined cases: null or empty text has no ids; texts of any length are handled in blocks of pieces;
rows repeat as they come; an empty table gives an empty table; a column that already has the output's
name is replaced; all other columns pass through.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import give_back, rows_of, small_batches

NONE = np.iinfo(np.int64).max
#: Longest piece in bytes that runs in lock-step.
LOCKSTEP = 64
#: Finished pieces that a task keeps.
KEEP = 100_000
#: Pieces that are in memory at once for one text.
BLOCK = 50_000


@lru_cache(2)
def ranks_of(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class Merger:
    """Encodes pieces by the ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right = np.divmod(np.arange(65536), 256)
        self.byte_rank = self._rank(self.byte_id[left], self.byte_id[right])
        self.done: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where the two do not join."""
        key = left * self.base + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def _lockstep(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most width bytes (a power of two)."""
        count = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, count)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        ids = self.byte_id[data]
        place = np.arange(width)
        inside = place[None, :] < size[:, None]
        after = np.broadcast_to(place + 1, (count, width)).copy()
        before = np.broadcast_to(place - 1, (count, width)).copy()
        alive = inside.copy()
        tree = np.full((count, 2 * width), NONE, np.int64)
        pair = self.byte_rank[data[:, :-1].astype(np.int32) * 256 + data[:, 1:]]
        leaf = np.where(inside[:, 1:] & (pair != NONE), pair * width + place[:-1], NONE)
        tree[:, width : 2 * width - 1] = leaf
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            rank, left = np.divmod(tree[row, 1], width)
            right = after[row, left]
            ids[row, left] = rank
            alive[row, right] = False
            beyond = after[row, right]
            after[row, left] = beyond
            has = beyond < size[row]
            inner = np.minimum(beyond, width - 1)
            before[row[has], beyond[has]] = left[has]
            joined = np.where(has, self._rank(rank, ids[row, inner]), NONE)
            self._put(tree, row, left, np.where(joined != NONE, joined * width + left, NONE), width)
            self._put(tree, row, right, np.full(len(row), NONE), width)
            first = before[row, left]
            some = first >= 0
            if some.any():
                rows, at = row[some], first[some]
                joined = self._rank(ids[rows, at], rank[some])
                self._put(tree, rows, at, np.where(joined != NONE, joined * width + at, NONE), width)
            row = row[tree[row, 1] != NONE]
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point update in each row and of the path above it."""
        node = at + width
        tree[row, node] = value
        while width > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            width >>= 1

    def _alone(self, piece: bytes) -> bytes:
        """One long piece, with the same tree in Python lists."""
        get, size = self.ranks.get, len(piece)
        width = 1 << (size - 1).bit_length()
        token = [piece[i : i + 1] for i in range(size)]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        none = (NONE, 0)
        tree = [none] * (2 * width)

        def joined(a: int) -> tuple[int, int]:
            b = after[a]
            rank = get(token[a] + token[b]) if b < size else None
            return none if rank is None else (rank, a)

        def put(a: int, value: tuple[int, int]) -> None:
            node = a + width
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        for a in range(size):
            tree[width + a] = joined(a)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            left = tree[1][1]
            right = after[left]
            token[left] += token[right]
            token[right] = b""
            after[left] = after[right]
            if after[right] < size:
                before[after[right]] = left
            put(right, none)
            put(left, joined(left))
            if before[left] >= 0:
                put(before[left], joined(before[left]))
        return np.array([self.ranks[t] for t in token if t], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not kept yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        whole = self.ranks.get
        for piece in pieces:
            raw = piece.encode()
            rank = whole(raw)
            if rank is not None:
                self.done[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LOCKSTEP:
                self.done[piece] = self._alone(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, group in by_width.items():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                self.done.update(zip((p for p, _ in part), self._lockstep([r for _, r in part], width), strict=True))

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text's pieces one after the other, as little-endian unsigned 32-bit integers."""
        pieces = set().union(*texts)
        if len(self.done) > KEEP:  # what came early is what comes often
            self.done = dict(itertools.islice(self.done.items(), KEEP // 2))
        self.learn(pieces.difference(self.done))
        return [b"".join(map(self.done.__getitem__, t)) for t in texts]

    def encode(self, texts: list[str], cut: regex.Pattern) -> list[bytes]:
        """Ids of each text; long texts go block by block."""
        out = self.ids([cut.findall(t) if len(t) <= 4 * BLOCK else [] for t in texts])
        for i, t in enumerate(texts):
            if len(t) > 4 * BLOCK:
                found = (m[0] for m in cut.finditer(t))
                out[i] = b"".join(self.ids([block])[0] for block in iter(lambda: list(itertools.islice(found, BLOCK)), []))
        return out


@lru_cache(1)
def merger(raw: bytes) -> Merger:
    """The worker's merger for this vocabulary."""
    return Merger(ranks_of(raw))


def _vocabulary(df: DataFrame, path: str):  # noqa: ANN202
    """The vocabulary file (under 1 MB, of fixed size), read once and broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with_binary(df: DataFrame, name: str) -> tuple[list[str], T.StructType]:
    keep = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return [f.name for f in keep], T.StructType([*keep, T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, vocab_path: str, pattern: str, text: str = "text", into: str = "token_ids", drop_text: bool = False) -> DataFrame:
    """df with the packed ids (little-endian unsigned 32-bit) of its texts as binary column `into`.

    vocab_path: lines of base64 token and rank, on the driver. pattern: what cuts a text into pieces.
    """
    held = _vocabulary(df, vocab_path)
    names, schema = _with_binary(df.drop(text) if drop_text and text != into else df, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, cut = merger(held.value), regex.compile(pattern)
        for part, texts in rows_of(batches, text):
            packed = merge.encode(texts, cut)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(packed, pa.binary())], [*names, into])

    return df.transform(small_batches).mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """df with the bytes that the packed ids stand for as binary column `into`; null ids decode to nothing."""
    held = _vocabulary(df, vocab_path)
    names, schema = _with_binary(df, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in ranks_of(held.value).items()}.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.binary())], [*names, into])
        give_back()

    return df.transform(small_batches).mapInArrow(run, schema)
