"""A Merkle manifest of a dataset: one hash tree a source, one over the sources' roots, and a proof for every row.

Rows are leaves. In every level, runs of ``arity`` consecutive nodes become one parent. A level is a sibling-shift self-join:
each node in slot zero of a run computes the indices of its siblings (its own XOR 1 in binary trees, slot offsets otherwise), an
equi-join fetches them, and the slot-zero row emits the parent with its children in order. So a level shuffles its nodes twice and
holds at most ``arity`` digests in a group; levels shrink by ``arity``. Texts are hashed where they are read and never move.

Going down again, every node takes its siblings from its parent's row and what the parent itself needs from above, so proofs cost
one join a level and a leaf fetches its whole path in the last one.

Leaves are numbered by range partitions of (source, id, leaf) and the counts of those before, so neither a hot source nor a run of
equal ids has to pass one task. Null sources are one source, the first; null ids come first; rows with equal ids are ordered by
their leaves, and equal rows have equal places in all that they yield. An empty table has no nodes and a null root.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.common import saved


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value so that neighbours can't run into one another: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(*map(framed, values))


def folded(text: Column) -> Column:
    """A text with A-Z in lower case, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Manifest:
    """``levels[k]``: (tree, idx, n, digest) of the k-th level, n: the level's nodes in that tree, leaves first, with ``source``, the id
    and extra columns in level 0 and ``children`` above it. ``sources``: (source, tree, n, subroot). ``top``: levels over the subroots."""

    levels: list[DataFrame]
    sources: DataFrame
    top: list[DataFrame]
    root: str | None
    arity: int


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    idx = F.col("idx")
    last = F.least(idx + arity - 1, F.col("n") - 1)
    others = F.array(idx.bitwiseXOR(F.lit(1).cast("long"))) if arity == 2 else F.sequence(idx + 1, F.greatest(last, idx + 1))
    run = F.filter(F.concat(F.array(idx), others), lambda k: k <= last)
    first = nodes.where((idx % arity == 0) & (F.col("n") > 1)).select("tree", "n", idx.alias("zero"), F.explode(run).alias("idx"))
    met = first.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    runs = met.groupBy("tree", "zero", "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # at most `arity`
    runs = runs.withColumn("children", F.col("run.digest"))
    above = F.ceil(F.col("n") / arity).cast("long")
    return runs.select("tree", F.floor(F.col("zero") / arity).cast("long").alias("idx"), above.alias("n"), digest(F.concat_ws("", "children")).alias("digest"), "children")


def _levels(leaves: DataFrame, most: int, arity: int) -> list[DataFrame]:
    levels, n = [leaves], most
    while n > 1:
        levels.append(saved(_parents(levels[-1], arity)))
        n = -(-n // arity)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "digest") for x in levels])


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, idx and n; sources with tree and n), both numbered from 0 over range partitions."""
    salt = F.monotonically_increasing_id()  # parts equal rows only
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest"]
    placed = saved(rows.withColumn("salt", salt).repartitionByRange(*order, "salt").withColumn("part", F.spark_partition_id()).drop("salt"))
    counts = saved(placed.groupBy("part", "source").agg(F.count("*").alias("held")))  # a row a partition and source that meet
    sources = counts.groupBy("source").agg(F.min("part").alias("part"), F.sum("held").alias("n"))
    starts = sources.groupBy("part").agg(F.count("*").alias("k"))
    starts = starts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())) - 1
    sources = saved(sources.join(starts, "part").select("source", "n", (within + F.col("before")).cast("long").alias("tree")))
    ahead = F.sum("held").over(Window.partitionBy("source").orderBy("part")) - F.col("held")
    ahead = counts.select("part", F.col("source").alias("from"), ahead.alias("ahead"))
    ahead = ahead.join(sources, F.col("from").eqNullSafe(F.col("source"))).drop("source")
    within = F.row_number().over(Window.partitionBy("part", "source").orderBy(F.col("id").asc_nulls_first(), "digest")) - 1
    met = placed.withColumn("within", within).withColumnRenamed("part", "at").join(ahead, (F.col("at") == F.col("part")) & F.col("source").eqNullSafe(F.col("from")))
    return met.select("tree", (F.col("within") + F.col("ahead")).cast("long").alias("idx"), "n", *rows.columns), sources


def manifest(docs: DataFrame, values: list[str], by: str = "source", id_col: str = "doc_id", arity: int = 16, extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf a row over the columns ``values``, a tree for each value of ``by``, leaves in the order of
    ``id_col``. ``extra``: columns over ``docs`` that are kept with the leaves. Other columns, whatever their names, are left out."""
    if arity < 2:
        raise ValueError("a run needs two nodes or more")
    rows = saved(docs.select(F.col(by).alias("source"), F.col(id_col).alias("id"), leaf([F.col(c) for c in values]).alias("digest"), *[c.alias(n) for n, c in (extra or {}).items()]))
    leaves, sources = _numbered(rows)
    leaves = saved(leaves)
    sizes = sources.agg(F.max("n").alias("most"), F.count("*").alias("sources")).first()
    levels = _levels(leaves, sizes.most or 0, arity)
    sources = saved(sources.join(_roots(levels).withColumnRenamed("digest", "subroot"), "tree"))
    subroots = sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(sizes.sources).cast("long").alias("n"), F.col("subroot").alias("digest"))
    top = _levels(subroots, sizes.sources, arity)
    root = _roots(top).first()
    return Manifest(levels, sources, top, root and root.digest, arity)


def _descend(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """Leaves with path: for each level an array entry (before, after), the digests beside the node that leads to the root; ``roots``:
    (tree, ..., path), what is to be appended above a tree's root."""
    carried = [c for c in roots.columns if c != "tree"]
    above, idx = None, F.col("idx")
    for nodes in reversed(levels):
        rows = nodes.where("n = 1").join(roots, "tree")
        if above is not None:
            slot = (idx % arity).cast("int")
            beside = F.struct(F.concat_ws("", F.slice("run", 1, slot)).alias("before"), F.concat_ws("", F.slice("run", slot + 2, arity)).alias("after"))
            met = nodes.where("n > 1").withColumn("up", F.floor(idx / arity).cast("long")).join(above, ["tree", "up"])
            rows = rows.unionByName(met.withColumn("path", F.concat(F.array(beside), "path")).drop("up", "run"))
        if "children" in rows.columns:
            above = rows.select("tree", idx.alias("up"), F.col("children").alias("run"), *carried)
    return rows


def proofs(m: Manifest) -> DataFrame:
    """Leaves (source, id, digest, extra columns) with subroot and path, the array of (before, after) from the leaf's level to the root."""
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    if m.root is None:
        return m.levels[0].withColumn("subroot", F.lit(None).cast("string")).withColumn("path", nothing).drop("tree", "idx", "n")
    top = m.top[-1].where("n = 1").select("tree", nothing.alias("path"))
    roots = _descend(m.top, top, m.arity).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "path")
    return _descend(m.levels, roots, m.arity).drop("tree", "idx", "n")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda d, at: digest(at["before"], d, at["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda at: F.concat(at["before"], at["after"]))))
