"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after . ! ? and white space, after the full-width marks with or without it, and at line ends. Runs are
consecutive sentences, at least ``sentences`` of them with at least ``words`` words in all. Words are parted by white space; in scripts that
put none between words (Han, kana, Thai, Lao, Burmese, Khmer) each two letters count as a word. From every sentence the shortest run is hashed, and the shortest that ends with it:
if a longer run repeats, so do the shortest from each of its sentences that end within it, and the shortest that ends where it
ends, and these cover it. So the result is that of hashing every run of any length, from at most two hashes a sentence. A single
sentence of at least ``alone`` words is a run too. Runs are joined globally by their 128-bit hash; every run but the first, by id
and then place, marks the sentences it covers, and marked sentences are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import saved, map_texts, slices

_END = re.compile("[.!?]\\s+|[\u3002\uff01\uff0e\uff1f\uff61]+[\u300d\u300f\u201d\u2019\uff09]*\\s*|\n\\s*")
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]+")


def sentences_of(text: str) -> list[str]:
    """Consecutive parts of ``text``, white space after each included; joined they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]


def words_in(sentence: str) -> int:
    """Words parted by white space, and one for each two letters of scripts that part none."""
    return len(_UNPARTED.sub(" ", sentence).split()) + sum(len(run) + 1 >> 1 for run in _UNPARTED.findall(sentence))


def runs_of(parts: list[str], sentences: int, words: int, alone: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of the runs of one text. White space doesn't count in the hash."""
    import xxhash

    held = [p.split() for p in parts]
    many = [max(len(h), words_in(p)) for h, p in zip(held, parts)] if any(map(_UNPARTED.search, parts)) else [len(h) for h in held]
    upto = [0, *accumulate(many)]
    plain = [" ".join(h) for h in held]
    found, n = {(k, k + 1) for k in range(len(parts)) if many[k] >= alone}, len(parts)
    end = start = 0
    for k in range(n):
        end = max(end, k)
        while end < n and (end - k < sentences or upto[end] - upto[k] < words):
            end += 1
        if end - k >= sentences and upto[end] - upto[k] >= words:
            found.add((k, end))
        while start < k and k - start >= sentences and upto[k + 1] - upto[start + 1] >= words:
            start += 1
        if k + 1 - start >= sentences and upto[k + 1] - upto[start] >= words:
            found.add((start, k + 1))
    return [(a, b - a, xxhash.xxh3_128_digest("\n".join(plain[a:b]))) for a, b in sorted(found)]


def repeated_runs(docs: DataFrame, sentences: int = 2, words: int = 20, alone: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, tag, place, many): runs of ``docs`` that repeat an earlier run. tag tells rows of one id apart by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, where, many, hashes = [], [], [], []
            for i, (tag, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for start, n, digest in runs_of(sentences_of(text or ""), sentences, words, alone):
                    rows.append(i)
                    where.append(start << 32 | tag)
                    many.append(n)
                    hashes.append(digest)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(where, pa.int64()), pa.array(many, pa.int32()), pa.array([int.from_bytes(h[:8], "big", signed=True) for h in hashes], pa.int64()), pa.array([int.from_bytes(h[8:], "big", signed=True) for h in hashes], pa.int64())], ["id", "at", "many", "h1", "h2"])

    rows = _tagged(docs, id_col, text_col)
    runs = map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, at long, many int, h1 long, h2 long")
    firsts = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1").select("h1", "h2", "first")
    # Written out, so that both sides of the join are plain exchanges by hash and a hot run's rows can be split among tasks.
    firsts = saved(firsts)
    again = runs.join(firsts, ["h1", "h2"]).where(~F.struct("id", "at").eqNullSafe(F.col("first")))
    return again.select("id", F.col("at").bitwiseAND(F.lit(2**32 - 1)).alias("tag"), F.shiftright("at", 32).cast("int").alias("place"), "many")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1)).alias("tag"), F.col(text_col).alias("text"))


def without_repeats(docs: DataFrame, sentences: int = 2, words: int = 20, alone: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, n_sentences, n_removed, ``text_col``), a row for each row of ``docs``, in no order.

    The text lacks the removed sentences; a null text stays null with 0 sentences. First is the run with the least id, then
    the least place; null ids come first. Identical rows (same id and text) are one document: both keep what one would keep.
    Texts shorter than a run lose nothing. Other columns, whatever their names, are left out.
    """
    again = repeated_runs(docs, sentences, words, alone, id_col, text_col)
    marks = again.groupBy("id", "tag").agg(F.collect_set(F.struct("place", "many")).alias("marks"))  # at most a text's own sentences
    rows = _tagged(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    b = marks.select(F.col("id").alias("id2"), F.col("tag").alias("tag2"), "marks")
    joined = rows.join(b, rows["id"].eqNullSafe(b["id2"]) & (rows["tag"] == b["tag2"]), "left").select("id", "text", "marks.place", "marks.many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, removed, texts = [], [], []
            for text, places, many in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                parts = sentences_of(text or "")
                gone = {s for p, n in zip(places or (), many or ()) for s in range(p, p + n)}
                totals.append(len(parts))
                removed.append(len(gone))
                texts.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_sentences", "n_removed", "text"])

    cleaned = map_texts(joined, run, f"id {kind}, n_sentences long, n_removed long, text string")
    return cleaned.select(F.col("id").alias(id_col), "n_sentences", "n_removed", F.col("text").alias(text_col))
