"""Sharding by a k-d tree over metadata.

The root holds all rows and the wanted number of leaves (total bytes over target bytes). A node with more than one leaf is
split along its widest dimension, at the weighted quantile that gives each side bytes in proportion to its leaves. Cuts are
found for all nodes of a level at once by distributed histograms over the key's bits, each pass narrowing every node's range
to one bin; only the bin that holds the cut comes to the driver, one row a node. A level is a few narrow aggregates over
(id, size, dimensions); texts never move. Once a node holds at most ``at_once`` rows, the tree below it is built by one task, so
levels with jobs of their own end where the rows of a node fit one group.

Rows are ordered within a dimension by its value and then by a hash of the text, so that a cut rarely parts equal texts; it
goes through a group of equal texts only where leaving the group whole would miss the wanted bytes by more than
``tolerance`` of a leaf. Then the group is cut by a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.common import saved

_STEP, _SCALE, _HASH = 16, 20, 43  # bits a histogram resolves in a pass; bits of a dimension and of the hash in a key


def text_dimensions(text_col: str = "text") -> dict[str, Column]:
    """Metadata that equal texts share: length, bytes a character (script), lines; the first and last on a log scale."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "bytes": F.log2(F.octet_length(text) + F.lit(1.0)),
        "bytes_per_char": F.octet_length(text) / F.greatest(F.length(text), F.lit(1)).cast("double"),
        "lines": F.log2(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1.0)),
    }


_TYPES = {"node": pa.int32(), "dim": pa.int32(), "shift": pa.int32(), "right": pa.int32()}


def _nodes(like: DataFrame, names: str, rows: list[tuple]) -> DataFrame:
    """A table of one row a node, to be joined: under 100 bytes for each shard that is asked for; broadcast up to 10 MB."""
    fields = {n: pa.array([r[k] for r in rows], _TYPES.get(n, pa.int64())) for k, n in enumerate(names.split())}
    table = like.sparkSession.createDataFrame(pa.table(fields))
    return F.broadcast(table) if len(rows) <= 100_000 else table.hint("merge")


class _Cut:
    """The search for one node's cut: ``lo`` and ``shift`` give the bins of the range still open, ``before`` what lies below."""

    def __init__(self, dim: int, low: int, high: int, want: float):
        self.dim, self.want, self.before, self.key, self.salt = dim, want, 0, None, None
        self.open(low, high)

    def open(self, low: int, high: int) -> None:
        self.lo, self.shift = low, max(0, (high - low).bit_length() - _STEP)

    def narrow(self, found, slack: float) -> bool:
        """Take in the bin that holds the cut; True once the cut is fixed."""
        start, stop = self.lo + (found.bin << self.shift), self.lo + (found.bin + 1 << self.shift)
        below, above = self.want - self.before - found.under, self.before + found.under + found.weight - self.want
        finest = self.shift == 0 and self.key is not None
        if min(below, above) <= slack or finest:
            at = start if below <= above else stop
            if self.key is None:
                self.key, self.salt = at, 0
            else:
                self.salt = at
            return True
        self.before += found.under
        if self.shift:
            self.open(start, stop)
        else:  # one key holds too much: go on among its rows, by their salts
            self.key = start
            self.open(0, (1 << 62) - 1)
        return False


def _ranges(rows: DataFrame, dims: list[str], wide: dict[int, int]) -> list:
    """For each node in ``wide`` its rows, bytes, and lowest and highest value in every dimension."""
    inside = rows.join(_nodes(rows, "node", [(n,) for n in wide]), "node")
    return inside.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *[f(d).alias(f"{s}{k}") for k, d in enumerate(dims) for s, f in (("lo", F.min), ("hi", F.max))]).collect()


def _cuts(rows: DataFrame, dims: list[str], about: list, wide: dict[int, int], target: float, tolerance: float) -> dict[int, tuple[int, int, int]]:
    """node -> (dimension, key, salt) for the nodes in ``about``, each of ``wide[node]`` leaves."""
    open_, done = {}, {}
    for r in about:  # one row a node
        k = max(range(len(dims)), key=lambda k: r[f"hi{k}"] - r[f"lo{k}"])
        part = wide[r.node]
        open_[r.node] = _Cut(k, r[f"lo{k}"] << _HASH, (r[f"hi{k}"] + 1 << _HASH) - 1, r.size * (part // 2) / part)
    while open_:
        state = [(n, c.dim, c.lo, c.shift, int(c.want - c.before), c.key) for n, c in open_.items()]
        found = rows.join(_nodes(rows, "node dim lo shift wanted within", state), "node").withColumn("key", _key(dims))
        offset = F.when(F.col("within").isNull(), F.col("key")).otherwise(F.col("salt")) - F.col("lo")
        bins = found.where("within is null or key = within").select("node", "wanted", "size", F.call_function("shiftright", offset, F.col("shift")).cast("long").alias("bin"))
        bins = bins.where((F.col("bin") >= 0) & (F.col("bin") < 1 << _STEP)).groupBy("node", "wanted", "bin").agg(F.sum("size").alias("weight"))
        order = Window.partitionBy("node").orderBy("bin")  # at most 65,536 bins a node
        bins = bins.withColumn("under", F.sum("weight").over(order) - F.col("weight"))
        best = bins.where("under <= wanted").groupBy("node").agg(F.max_by(F.struct("bin", "weight", "under"), "bin").alias("b")).select("node", "b.*").collect()
        for r in best:
            if open_[r.node].narrow(r, tolerance * target):
                c = open_.pop(r.node)
                done[r.node] = (c.dim, c.key, c.salt)
    return done


def _key(dims: list[str]) -> Column:
    """A row's place along dimension ``dim`` of its node."""
    return F.shiftleft(F.element_at(F.array(*dims), F.col("dim") + 1), _HASH).bitwiseOR(F.col("tie"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, tolerance: float = 0.002, overhead: int = 16, at_once: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, size, text_crc32, shard, slot), a row for each row of ``docs``, in no order.

    Give either ``shards`` or ``target_bytes`` (then as many shards as the bytes need). size: UTF-8 bytes of the text plus
    ``overhead``; a null text has no bytes and the checksum of the empty one. Shards have near equal bytes: a cut misses the wanted
    bytes by at most ``tolerance`` of a shard or half a row. slot numbers a shard's rows from 0 without gaps. Null, repeated and equal
    ids are rows like any other. ``dimensions``: named numeric columns over ``docs``; nulls in them count as the least value.
    An empty table gives no rows. Other columns, whatever their names, are left out.
    """
    dimensions = dimensions or text_dimensions(text_col)
    names = [f"dim{k}" for k in range(len(dimensions))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _HASH).alias("tie"),
        *[c.cast("double").alias(n) for n, c in zip(names, dimensions.values())],
    )
    # Salts differ for all rows; those of distinct ids don't depend on where the rows are read.
    salt = F.shiftleft(F.shiftrightunsigned(F.xxhash64("id"), 24), 22).bitwiseOR(F.monotonically_increasing_id() % (1 << 22))
    rows = saved(rows.withColumn("salt", salt))
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"), *[f(n).alias(f"{s}{n}") for n in names for s, f in (("lo", F.min), ("hi", F.max))]).first()
    total = whole.size or 0
    shards = shards or max(1, -(-total // (target_bytes or max(1, total))))

    def scaled(n: str) -> Column:
        lo, hi = whole[f"lo{n}"], whole[f"hi{n}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(n) - lo) / (hi - lo) * ((1 << _SCALE) - 1)), F.lit(0)).cast("long")

    rows = rows.select("id", "size", "crc", "tie", "salt", *[scaled(n).alias(n) for n in names], F.lit(0).alias("node"))
    leaves, target = {0: shards}, total / shards
    while whole.n > at_once and (wide := {n: k for n, k in leaves.items() if k > 1}):
        about = [r for r in _ranges(rows, names, wide) if r.n > at_once]
        if not about:
            break
        cuts = _cuts(rows, names, about, wide, target, tolerance)
        # A node's number is the number of its first shard.
        table = _nodes(rows, "node dim cut cut_salt right", [(n, *cut, n + leaves[n] // 2) for n, cut in cuts.items()])
        key, node = _key(names), F.col("node")
        left = (key < F.col("cut")) | ((key == F.col("cut")) & (F.col("salt") < F.col("cut_salt")))
        node = F.when(F.col("right").isNotNull() & ~F.coalesce(left, F.lit(False)), F.col("right")).otherwise(node)
        rows = saved(rows.join(table, "node", "left").select("id", "size", "crc", "tie", "salt", *names, node.alias("node")))
        leaves = {m: j for n, k in leaves.items() if n in cuts for m, j in ((n, k // 2), (n + k // 2, k - k // 2))} | {n: k for n, k in leaves.items() if n not in cuts}
    if any(k > 1 for k in leaves.values()):
        rows = saved(_finished(rows, names, leaves, target, tolerance))
    return _slots(rows.select("id", "size", "crc", "salt", F.col("node").alias("shard")), whole.n, shards).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot"
    )


def _finished(rows: DataFrame, dims: list[str], leaves: dict[int, int], target: float, tolerance: float) -> DataFrame:
    """Rows with the leaf that they end in; every node's rows are one group of at most ``at_once``."""

    def run(group: pa.Table) -> pa.Table:
        size, tie, salt, *values = (group.column(c).to_numpy().astype(np.int64) for c in ("size", "tie", "salt", *dims))
        leaf, waiting = np.empty(len(size), np.int32), [(np.arange(len(size)), group.column("node")[0].as_py(), group.column("leaves")[0].as_py())]
        while waiting:
            at, node, k = waiting.pop()
            if k == 1 or not len(at):
                leaf[at] = node
                continue
            widest = max(values, key=lambda v: int(v[at].max() - v[at].min()))
            key = (widest[at] << _HASH) | tie[at]
            order = np.lexsort((salt[at], key))
            held = np.concatenate([[0], np.cumsum(size[at][order])])
            miss = np.abs(held - held[-1] * (k // 2) / k)
            whole = np.concatenate([[True], np.diff(key[order]) != 0, [True]])  # cuts that leave equal keys together
            best = int(np.argmin(np.where(whole, miss, np.inf)))
            cut = best if miss[best] <= tolerance * target else int(np.argmin(miss))
            waiting += [(at[order[:cut]], node, k // 2), (at[order[cut:]], node + k // 2, k - k // 2)]
        return group.drop_columns(["node", "leaves"]).append_column("node", pa.array(leaf))

    wide = rows.join(_nodes(rows, "node leaves", [(n, k) for n, k in leaves.items() if k > 1]), "node", "left")
    kept = [c for c in rows.columns if c != "node"]
    schema = rows.select(*kept, "node").schema
    done = wide.where("leaves is not null").select(*kept, "node", "leaves").groupBy("node").applyInArrow(run, schema)
    return done.unionByName(wide.where("leaves is null").select(*kept, "node"))


def _slots(rows: DataFrame, n: int, shards: int, at_once: int = 4096) -> DataFrame:
    """Add slot: numbered within buckets of about ``at_once`` rows, after the counts of the shard's earlier buckets."""
    buckets = max(1, -(-n // (shards * at_once)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("salt", "id")) - 1
    return rows.withColumn("within", within).join(ahead, ["shard", "bucket"]).withColumn("slot", (F.col("within") + F.col("ahead")).cast("long"))
