"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of neighbouring byte strings form a monoid under ``join``: a pre-token is halved down to a few bytes, and the two
halves' encodings are joined upwards. A join re-encodes a window around the boundary, grown until the tokens on both of its
edges are compatible with their outer neighbours. Two tokens are compatible if encoding their joined bytes gives these two
again. That is enough: the first merge that crossed a token border in an encoding of the whole would also have been made
when only the two tokens at that border were encoded, so a sequence whose neighbours are all compatible is the encoding.
Across pre-tokens a join is a plain concatenation. Decoding is a monoid too, of bytes under concatenation: leaves of a few tokens
are joined pairwise up a tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import map_texts, slices
from segspark.llm.pretokens import pretokens

#: Entries that each cache of a worker may hold (pre-tokens: in each of two generations). A full cache is emptied. They bound memory
#: and never change a result.
PIECES, HALVES, PAIRS, WINDOWS = 120_000, 60_000, 100_000, 60_000


class TreeEncoder:
    """Encodes bytes by ranks. ``ids_of`` is a mapping from pre-tokens to their packed 32-bit ids that fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.ids_of = _Pieces(self)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token; one that is itself in the vocabulary is its own token."""
        if not piece:
            return ()
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self._tree(piece)

    def _tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= 4:
            return self._window(piece)
        known = self.halves.get(piece)
        if known is not None:
            return known
        at = len(piece) // 2
        ids = self.join(self._tree(piece[:at]), self._tree(piece[at:]))
        if len(piece) <= 8:
            if len(self.halves) >= HALVES:
                self.halves.clear()
            self.halves[piece] = ids
        return ids

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes, from the encodings of each."""
        if not left or not right:
            return left + right
        window = self._pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            left_holds = i == len(left) or self._compatible(left[-i - 1], window[0])
            right_holds = j == len(right) or self._compatible(window[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_holds else min(2 * i, len(left))
            j = j if right_holds else min(2 * j, len(right))
            window = self._window(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' joined bytes."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._window(self.tokens[a] + self.tokens[b])
        return known

    def _compatible(self, a: int, b: int) -> bool:
        return self._pair(a, b) == (a, b)

    def _window(self, window: bytes) -> tuple[int, ...]:
        known = self.windows.get(window)
        if known is None:
            known = tuple(self._merge(window))
            if len(window) <= 24:
                if len(self.windows) >= WINDOWS:
                    self.windows.clear()
                self.windows[window] = known
        return known

    def _merge(self, window: bytes) -> list[int]:
        """Plain merging of a window: always the lowest rank, the leftmost first."""
        ranks = self.ranks
        if len(window) > 200:
            return self._merge_wide(window)
        parts = [window[k : k + 1] for k in range(len(window))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_wide(self, window: bytes) -> list[int]:
        """The same with a heap over linked parts, for windows that had to grow far (runs of one character)."""
        n, ranks = len(window), self.ranks
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def push(k: int) -> None:
            after = end[k]
            if after < n:
                rank = ranks.get(window[k : end[after]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, after, end[after]))

        heap: list[tuple[int, int, int, int]] = []
        for k in range(n):
            push(k)
        while heap:
            _, k, after, stop = heapq.heappop(heap)
            if not alive[k] or end[k] != after or not alive[after] or end[after] != stop:
                continue
            alive[after], end[k] = False, stop
            if stop < n:
                back[stop] = k
            push(k)
            if back[k] >= 0:
                push(back[k])
        return [ranks[window[k : end[k]]] for k in range(n) if alive[k]]


class _Pieces(dict):
    """Packed ids of pre-tokens, in two generations: a full one becomes the old one, and what is still used moves back."""

    def __init__(self, encoder: TreeEncoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = array("i", self.encoder.encode(piece.encode())).tobytes()
            if len(piece) > 64:
                return packed
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> TreeEncoder:
    """One encoder a worker and file of ranks (lines of a base64 token and its rank)."""
    with open(ranks_path, "rb") as lines:
        return TreeEncoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def concatenated(parts: list[bytes], leaf: int = 64) -> bytes:
    """The parts joined in order: leaves of ``leaf`` parts, then neighbours pairwise up the tree."""
    parts = [b"".join(parts[k : k + leaf]) for k in range(0, len(parts), leaf)]
    while len(parts) > 1:
        parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to (id, ids)."""
    ids_of = encoder(ranks_path).ids_of.__getitem__
    for batch in slices(batches):
        packed = [b"".join(map(ids_of, pretokens(text, pattern))) if text else b"" for text in batch.column(1).to_pylist()]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (id, ids) to (id, ids, decoded)."""
    token = encoder(ranks_path).tokens.__getitem__
    for batch in slices(batches):
        ids = batch.column(1).fill_null(pa.scalar([], batch.column(1).type)) if batch.column(1).null_count else batch.column(1)
        flat, ends = ids.flatten().to_numpy().tolist(), np.cumsum(ids.value_lengths().to_numpy()).tolist()
        decoded = [concatenated(list(map(token, flat[a:b]))) for a, b in zip([0, *ends], ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, ids array<int>), a row for each row of ``docs``, in no order.

    Null and empty texts give an empty array; ids may be null or repeated and are carried through; other columns, whatever
    their names, are left out. No shuffle: each text is encoded where it was read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, lambda batches: _encoded(batches, ranks_path, pattern), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return (``id_col``, ids array<int>, decoded binary): the bytes of the tokens of each row, joined.

    A null array decodes as an empty one. An id outside the vocabulary is an error. ``decoded`` need not be whole UTF-8.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, lambda batches: _decoded(batches, ranks_path), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` of ``encode`` gives, in one worker a task instead of two: half the memory, and ids cross over once.

    Return (``id_col``, ids, decoded), a row for each row of ``docs``. Null and empty texts give empty ids and bytes; ids may be null
    or repeated; other columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    both = map_texts(rows, lambda batches: _decoded(_encoded(batches, ranks_path, pattern), ranks_path), f"id {kind}, ids array<int>, decoded binary")
    return both.withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Return (``id_col``, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` returns, and its columns ``keep``."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(keep or []),
    )
