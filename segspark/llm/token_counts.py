"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast table with the token counts of frequent pre-tokens. Second tier: each worker's own cache, filled by
the tokenizer library. No words or pre-tokens are shuffled. The frequent ones are those of a bounded sample of ``sample`` rows,
counted in one task. The table only saves time; what it lacks is encoded, so counts don't depend on it. It is broadcast as one
string with places and counts as arrays, and turned into a hash table once a worker.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import map_texts, slices
from segspark.llm.pretokens import pretokens

#: Entries that a worker's own cache may hold; a full cache is emptied.
CACHED = 400_000


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> dict[str, int]:
    return {}


class _Counts(dict):
    """The frequent pre-tokens' counts; a miss goes to the worker's cache and then to the library, and isn't stored here."""

    def __init__(self, frequent: "Frequent", path: str):
        super().__init__(frequent.items())
        self.cache, self.encode = _cache(path), library(path).encode

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            n = len(self.encode(piece, add_special_tokens=False))
            if len(piece) <= 64:
                self.cache[piece] = n
        return n


@dataclass(frozen=True)
class Frequent:
    """A table from pre-tokens to token counts, packed: all pre-tokens in one string, with the end of each and its count."""

    pieces: str
    ends: np.ndarray
    counts: np.ndarray

    def items(self) -> Iterator[tuple[str, int]]:
        ends = self.ends.tolist()
        return zip((self.pieces[a:b] for a, b in zip([0, *ends], ends)), self.counts.tolist())


_tables: dict[tuple[int, str], _Counts] = {}


def _table(shared, path: str) -> _Counts:
    """The hash table of a broadcast, made once a worker."""
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast else id(shared.value), path
    if key not in _tables:
        _tables.clear()
        _tables[key] = _Counts(shared.value, path)
    return _tables[key]


def frequent_pieces(docs: DataFrame, pattern: str, text_col: str = "text", sample: int = 8192, share: float = 1e-5, entries: int = 32_768) -> list[str]:
    """At most ``entries`` pre-tokens that make up at least ``share`` of those in ``sample`` rows, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(pretokens(text or "", pattern))
            if len(seen) > 1_000_000:  # lossy counting: what is rarer than the share by now can go
                least = share * seen.total() / 8
                seen = Counter({w: n for w, n in seen.items() if n > least})
        least = max(2, share * seen.total())
        kept = [w for w, n in sorted(seen.items(), key=lambda i: (-i[1], i[0])) if n >= least and len(w) <= 32][:entries]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["piece"])

    # Sampled by rate first: a limit alone would send up to ``sample`` texts of every partition to the one task.
    rate = min(1.0, 1.2 * sample / max(1, docs.count()))
    found = map_texts(docs.select(text_col).sample(fraction=rate, seed=7).limit(sample).coalesce(1), run, "piece string")
    return [r.piece for r in found.collect()]  # at most `entries` short strings


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", sample: int = 8192, entries: int = 32_768) -> DataFrame:
    """Return (``id_col``, n_bytes, n_tokens, over_limit), a row for each row of ``docs``, in no order.

    A null text counts as an empty one: 0 bytes, 0 tokens. The tokenizer's own special strings inside a text are single
    tokens, as its library has them by default. ids may be null or repeated and are carried through; other columns are left
    out. ``pattern`` is the pre-tokenizer's pattern; the tokenizer must be a byte-level BPE without normalizer.
    """
    spark = docs.sparkSession
    encode = library(tokenizer_path).encode
    pieces = frequent_pieces(docs, pattern, text_col, sample, entries=entries)
    counts = np.array([len(encode(p, add_special_tokens=False)) for p in pieces], np.int32)
    frequent = Frequent("".join(pieces), np.cumsum([len(p) for p in pieces], dtype=np.int32), counts)
    special = {t.content for t in library(tokenizer_path).get_added_tokens_decoder().values()}
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, encode = _table(shared, tokenizer_path).__getitem__, library(tokenizer_path).encode
        for batch in slices(batches):
            texts, found = batch.column(1).to_pylist(), []
            sizes = [len(t.encode()) if t else 0 for t in texts]
            for text in texts:
                if not text:
                    found.append(0)
                elif any(s in text for s in special):
                    found.append(len(encode(text, add_special_tokens=False)))
                else:
                    found.append(sum(map(count, pretokens(text, pattern))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
