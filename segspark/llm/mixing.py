"""Mixing sources to target weights: fixed-length blocks, multinomial draws a shard, index permutations, and a join by index.

Each source is a line of words, its documents one after the other in a pseudo-random order; every ``block`` words are one block, and
a document's *pieces* are its parts in blocks. The output has slots, ``shard_slots`` to a shard. How many slots of a shard belong to
which source is drawn multinomially, given what each source shall have in all: a binary tree over shards halves the sources' counts
down to one shard (multivariate hypergeometric draws, seeded by the node), so that every shard finds its own counts, and how many
slots each source has in the shards before, in log2(shards) draws and without the others. A source's i-th slot holds block
P(i mod blocks), P being a pseudo-random permutation of the block numbers for each pass over the source (a Feistel network whose values
outside the range are permuted on). Slots and pieces meet in an equi-join by (source, block).

A source's last slot takes only the words that are left of its target, so what is taken misses a target by its rounding only; a
pass takes no block twice, so a document is taken at most as often as there are passes begun.

Only the sources go through the driver (name and size; at most ``most_sources``, else an error) and to tasks. Places in a source come
from range partitions and the sums before them, so a hot source is many tasks. Draws depend on the seed, ids, sizes and texts only.
Null texts have no words, null sources are one source, the last; null and repeated ids are rows like any other; of equal rows it is
open which is which. An empty table, or one without words, gives no slots. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.common import saved

WORDS = r"[^\x20\x09-\x0D]+"
_EXACT = 10**9  # numpy's hypergeometric draws go up to here


def targets(sizes: list[int], weights: list[float], most: float = 3) -> list[float]:
    """Shares by weight of the sum of sizes; none over ``most`` times its size, what is over shared among the others by weight."""
    found, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        for k in full or open_:
            found[k] = float(most * sizes[k]) if full else unit * weights[k]
        if not full:
            break
        left -= sum(found[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return found


class Permutation:
    """A pseudo-random permutation of the numbers below ``n``, both ways, for arrays."""

    def __init__(self, n: int, *key: int, rounds: int = 6):
        self.n, self.half = n, np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.SeedSequence(key).generate_state(rounds, np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(32))) & self.low

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.low
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mixed(a, key), a) if back else (b, a ^ self._mixed(b, key))
        return (a << self.half) | b

    def __call__(self, x, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's words in all, the words to take, and the slots that hold them: ``slots``, of which the last takes ``rest`` words."""

    size: int
    wanted: int
    blocks: int
    slots: int
    rest: int


def planned(number: int, size: int, wanted: int, block: int, seed: int) -> Source:
    blocks = -(-size // block)
    if not wanted:
        return Source(size, 0, blocks, 0, 0)
    passes, more = divmod(wanted - 1, size)  # the last pass takes 1 to `size` words
    more += 1
    at = int(Permutation(blocks, seed, number, passes)(np.array([blocks - 1]), back=True)[0])  # when it takes the short block
    short = size - (blocks - 1) * block

    def words(slots: int) -> int:
        return slots * block if slots <= at else (slots - 1) * block + short

    slots = -(-more // block)
    if words(slots) < more:
        slots += 1
    return Source(size, wanted, blocks, passes * blocks + slots, more - words(slots - 1))


def _part(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without replacement go to each source. Totals too large for numpy are drawn source by source from
    binomials, held to what is possible."""
    total = int(counts.sum())
    if total < _EXACT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    found = np.zeros_like(counts)
    for k, c in enumerate(counts.tolist()):
        if n and total:
            found[k] = min(max(int(rng.binomial(n, c / total)), n - (total - c)), c, n)
            n, total = n - int(found[k]), total - c
    return found


class Draws:
    """The sources' counts in each shard, and in all shards before it."""

    def __init__(self, slots: list[int], shard_slots: int, seed: int):
        self.all, self.each, self.seed = np.array(slots, np.int64), shard_slots, seed
        self.n = int(self.all.sum())
        self.shards = -(-self.n // shard_slots)
        self._left = lru_cache(256)(self._left)  # shards of one task share most of their way

    def _left(self, low: int, high: int, counts: bytes) -> np.ndarray:
        middle = (low + high) // 2
        return _part(np.random.default_rng([self.seed, low, high]), np.frombuffer(counts, np.int64), min(middle * self.each, self.n) - low * self.each)

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, counts, before = 0, self.shards, self.all, np.zeros_like(self.all)
        while high - low > 1:
            left, middle = self._left(low, high, counts.tobytes()), (low + high) // 2
            if shard < middle:
                high, counts = middle, left
            else:
                low, counts, before = middle, counts - left, before + left
        return before, counts


def _slots(spark, sources: list[Source], shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, src, pass, block, words): words is null where a slot takes all of its block."""
    plan = [s.slots for s in sources]
    shards = -(-sum(plan) // shard_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(plan, shard_slots, seed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, counts = draws.of(shard)
                places = np.random.default_rng([seed, shards, shard]).permutation(int(counts.sum()))
                found, used = [], 0
                for k in np.flatnonzero(counts):
                    index = before[k] + np.arange(counts[k])
                    turn, place = np.divmod(index, sources[k].blocks)
                    block = np.concatenate([Permutation(sources[k].blocks, seed, int(k), int(t))(place[turn == t]) for t in np.unique(turn)])
                    rest = pa.array(np.where(index == plan[k] - 1, sources[k].rest, 0), pa.int64(), mask=index != plan[k] - 1)
                    slot = places[used : used + len(index)]
                    used += len(index)
                    found.append(pa.record_batch([pa.array(np.full(len(index), shard)), pa.array(slot), pa.array(np.full(len(index), k, np.int32)), pa.array(turn), pa.array(block), rest], ["shard", "slot", "src", "pass", "block", "words"]))
                yield from found

    parts = max(1, min(shards, max(spark.sparkContext.defaultParallelism, sum(plan) // 500_000)))
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard long, slot long, src int, pass long, block long, words long")


@dataclass(frozen=True)
class Mixture:
    """``docs``: (src, start, id, source, size, source_size, target), a row for each input row. ``pieces``: what the slots hold, (shard, slot,
    src, pass, block, at, start, first, last[, text]): words first to last - 1 of the document that begins at ``start`` of its source, in place
    ``at`` of the block."""

    docs: DataFrame
    pieces: DataFrame
    sources: list[Source]


def mix(docs: DataFrame, weights: list[float], most: float = 3, block: int = 512, shard_slots: int = 1024, seed: int = 11, texts: bool = False, most_sources: int = 100_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Mixture:
    """Mix the sources of ``docs``; those in code-point order weigh ``weights``, repeating. ``texts``: pieces carry their words."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    text = F.col(text_col).alias("text")
    order = F.xxhash64(F.lit(seed), F.col(id_col), size, text)
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("salt"), *[text] * texts))
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"over {most_sources} sources can't be given weights one by one")
    want = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], most)
    sources = [planned(k, r["size"], min(round(w), int(most * r["size"])), block, seed) for k, (r, w) in enumerate(zip(found, want))]
    table = pa.table({"src": pa.array(range(len(found)), pa.int32()), "from": pa.array([r.source for r in found], pa.string()), "source_size": pa.array([r["size"] for r in found], pa.int64()), "target": pa.array(want, pa.float64())})
    rows = rows.join(F.broadcast(spark.createDataFrame(table)), F.col("source").eqNullSafe(F.col("from"))).drop("from")  # a row a source, bounded above
    placed = saved(_placed(rows))
    met = _slots(spark, sources, shard_slots, seed).hint("merge").join(_pieces(placed, block, texts), ["src", "block"])
    last = F.least(F.col("last"), F.col("first") + F.col("words") - F.col("at"))
    if texts:
        kept = F.slice(F.split("text", " "), 1, F.greatest(last - F.col("first"), F.lit(0)).cast("int"))
        met = met.withColumn("text", F.when(last < F.col("last"), F.concat_ws(" ", kept)).otherwise(F.col("text")))
    pieces = met.withColumn("last", F.coalesce(last, "last")).where("last > first").drop("words")
    return Mixture(placed.drop("text"), pieces, sources)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with start, the words of their source before them."""
    order = ["order", "id", "size", "salt"]  # the salt orders equal rows only
    placed = saved(rows.repartitionByRange("src", *order).withColumn("part", F.spark_partition_id()))
    held = placed.groupBy("src", "part").agg(F.sum("size").alias("held"))
    ahead = held.select("src", "part", (F.sum("held").over(Window.partitionBy("src").orderBy("part")) - F.col("held")).alias("ahead"))
    own = F.sum("size").over(Window.partitionBy("src", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("own", own).join(ahead, ["src", "part"]).withColumn("start", F.col("own") + F.col("ahead")).drop("own", "ahead", "part", "order", "salt")


def _pieces(placed: DataFrame, block: int, texts: bool) -> DataFrame:
    """(src, block, at, start, first, last[, text]) of all documents that have words."""
    start, size = F.col("start"), F.col("size")
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)) if texts else F.lit(None)

    def piece(b: Column) -> Column:
        first, last = F.greatest(b * block - start, F.lit(0)), F.least((b + 1) * block - start, size)
        text = [F.concat_ws(" ", F.slice("all", first.cast("int") + 1, (last - first).cast("int"))).alias("text")] * texts
        return F.struct(b.alias("block"), (start + first - b * block).alias("at"), first.alias("first"), last.alias("last"), *text)

    blocks = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    rows = placed.where("size > 0").withColumn("all", words)
    return rows.select("src", "start", F.explode(F.transform(blocks, piece)).alias("p")).select("src", "start", "p.*")


def taken(m: Mixture) -> DataFrame:
    """The mixture's documents with taken, the words of each that the mixture holds, repeats counted."""
    sums = m.pieces.groupBy("src", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    some = m.docs.where("size > 0").join(sums, ["src", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return some.unionByName(m.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def block_texts(m: Mixture) -> DataFrame:
    """(shard, slot, source, text), a row a slot; for a mixture with ``texts``. A group holds one block's pieces."""
    pieces = F.sort_array(F.collect_list(F.struct("at", "text")))
    rows = m.pieces.groupBy("shard", "slot", "src").agg(F.concat_ws(" ", F.transform(pieces, lambda p: p["text"])).alias("text"))
    names = m.docs.groupBy("src").agg(F.first("source").alias("source"))
    return rows.join(F.broadcast(names), "src").select("shard", "slot", "source", "text")  # at most ``most_sources`` rows
