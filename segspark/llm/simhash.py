"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks; fingerprints that differ in at most ``threshold`` bits differ in at most
``threshold // blocks`` = t bits of at least one block. In each block the anchors are the words of a covering code of radius 1:
a Hamming code on the first 2^r - 1 bits times all words on the rest. Each fingerprint has one home anchor, within the
radius, and is replicated to every anchor within radius plus t; of two block values within t of each other, each is
replicated to the other's home. So comparing, per anchor, what is at home there with all that was replicated there misses
no link. Which anchors are near a value depends on its syndrome only; a table of error patterns by syndrome, a few hundred
rows whatever the input, gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import saved, components, map_texts, slices

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The signed 64-bit fingerprint of one text, over all its shingles with repeats."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = xxhash.xxh64_digest(joined, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    n, columns = len(hashes) // 8, np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, tag, fp), a row for each row of ``docs``: a hash of the text, and the fingerprint, as longs. Null and
    wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["id", "tag", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), _tag(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, fp long").withColumnRenamed("id", id_col)


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _patterns(bits: int, within: int) -> list[tuple[int, int, bool]]:
    """(syndrome, error pattern, whether it leads home) for every pattern of at most ``within`` of ``bits`` bits."""
    hamming = 2 ** (bits + 1).bit_length() // 2 - 1 if (bits + 1).bit_count() > 1 else bits
    found = []
    for weight in range(within + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for p in places:
                if p < hamming:
                    syndrome ^= p + 1
            home = weight == 0 or weight == 1 and places[0] < hamming
            found.append((syndrome, sum(1 << p for p in places), home))
    return found


def _syndrome(value: Column, bits: int) -> Column:
    """The Hamming syndrome of the low bits of ``value``: bit r is the parity of the places p with bit r of p + 1 set."""
    hamming = 2 ** (bits + 1).bit_length() // 2 - 1 if (bits + 1).bit_count() > 1 else bits
    out = F.lit(0)
    for r in range(hamming.bit_length()):
        mask = sum(1 << p for p in range(hamming) if (p + 1) >> r & 1)
        out = out + F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(mask))) % 2, r)
    return out


def _work(n: int, threshold: int, blocks: int) -> float:
    """Rows made for, and fingerprints compared with, each of ``n`` fingerprints, by expectation."""
    total, cut = 0.0, [64 * k // blocks for k in range(blocks + 1)]
    for bits in (high - low for low, high in zip(cut, cut[1:])):
        syndromes = 2 ** ((bits + 1).bit_length() - 1)
        near = sum(comb(bits, k) for k in range(2 + threshold // blocks)) / syndromes
        total += near + n * near * syndromes / 2**bits
    return total


def blocks_for(n: int, threshold: int = 4) -> int:
    """2 or 3 blocks, whichever is less work for ``n`` distinct fingerprints. Both find the same links."""
    return min((3, 2), key=lambda blocks: _work(n, threshold, blocks))


def links(fps: DataFrame, threshold: int = 4, blocks: int = 3) -> DataFrame:
    """Return (a, b): distinct fingerprints a < b that differ in at most ``threshold`` bits, each pair once.

    ``fps`` has one column of distinct, non-null longs. With n of them, 3 blocks make about 46 rows for each and compare it
    with about n / 3,000 others; 2 blocks make about 344 and compare it with n / 380,000. ``blocks_for`` chooses.
    """
    cut = [64 * k // blocks for k in range(blocks + 1)]
    per_block = threshold // blocks
    spark, name = fps.sparkSession, fps.columns[0]
    parts = []
    for k, (low, high) in enumerate(zip(cut, cut[1:])):
        bits = high - low
        table = spark.createDataFrame(_patterns(bits, 1 + per_block), "syndrome int, error long, home boolean")
        value = F.shiftrightunsigned(F.col(name), low).bitwiseAND(F.lit((1 << bits) - 1))
        rows = fps.select(F.col(name).alias("fp"), value.alias("value")).withColumn("syndrome", _syndrome(F.col("value"), bits).cast("int"))
        near = rows.join(F.broadcast(table), "syndrome")  # 2^r syndromes, patterns of a few bits: fixed by the code, not the data
        parts.append(near.select(F.lit(k).alias("block"), F.col("value").bitwiseXOR(F.col("error")).alias("anchor"), "fp", "home"))
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.lit(None)
    for k in reversed(range(blocks)):
        mask = ((1 << cut[k + 1]) - (1 << cut[k]) + (1 << 63)) % (1 << 64) - (1 << 63)
        first = F.when(F.bit_count(differ.bitwiseAND(F.lit(mask))) <= per_block, F.lit(k)).otherwise(first)
    at_home = placed.where("home").select("block", "anchor", F.col("fp").alias("x"))
    replicated = placed.select("block", "anchor", F.col("fp").alias("y"))
    met = at_home.join(replicated, ["block", "anchor"]).where((F.col("x") < F.col("y")) & (F.bit_count(differ) <= threshold) & (F.col("block") == first))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _grouped(docs: DataFrame, shingle: int, threshold: int, blocks: int | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, tag, fp) of all rows, and (fp, component, least id) of all fingerprints; components are named by fingerprints."""
    found = saved(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"))
    distinct = saved(found.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(distinct.select("fp"), threshold, blocks or blocks_for(distinct.count(), threshold)))
    return found, distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, fp long, component_id), a row for each row of ``docs``, in no order.

    component_id is the least id in the component; rows whose id is null take part and get the least id that isn't null
    (null if there is none). Texts without words link with each other, and with fingerprints of few bits, like any other.
    Repeated rows and ids each keep their row; other columns, whatever their names, are left out. An empty table gives no rows.
    Copies meet in a grouping by fingerprint before any pair is looked for; without ``blocks``, the number of distinct
    fingerprints decides how many there are, which changes the work but no result.
    """
    found, named = _grouped(docs, shingle, threshold, blocks, id_col, text_col)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, threshold: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that with the least id (a null id only if there is no
    other), then the least hash of its text; of rows with this id and text any one."""
    found, named = _grouped(docs, shingle, threshold, blocks, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    kept = found.join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min(rank).alias("r"))
    kept = kept.select(F.col("r.id").alias("__id"), F.col("r.tag").alias("__tag"))
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (_tag(docs[text_col]) == kept["__tag"]), "left_semi")
    twice = found.groupBy("id", "tag").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return out.dropDuplicates([id_col, text_col]) if twice else out
