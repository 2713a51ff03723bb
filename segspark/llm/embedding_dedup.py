"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

For each of ``codes`` codes, vectors are turned by a fixed random rotation and cut into ``blocks``; each block has ``words`` random
directions, and every choice of one direction a block makes a filter, so there are words ** blocks filters a code that are never
written out. A vector passes the filters whose inner product with it reaches a cap; list decoding finds them from the blocks'
inner products, sorted by halves. Near vectors pass common filters. Rows are joined on filters, and the vectors of a filter are
verified against each other with exact cosines in double precision.

The number of directions follows the number of vectors, so that a filter's expected rows are the same at every size; the cap follows from
the wanted recall at the threshold, by simulated pairs. A vector then passes some 20 filters at a thousand vectors, 30 at 10^5, 50
at 10^7 (64 dimensions, cosine 0.9): work grows little faster than the rows.

A filter's vectors are compared in blocks of ``chunk`` rows. A filter with more rows than two blocks is passed on as numbered
blocks, and pairs of blocks are dealt out anew, so no task gathers a hot filter. What tasks return is a count and a local
component for each vector, never pairs; a pair is counted in the least filter that both vectors pass. Equal vectors are one
vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import saved, components, slices


@lru_cache(maxsize=8)
def _code(dims: int, codes: int, blocks: int, words: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each code its rotation and the directions of each block (unit vectors over sqrt(blocks))."""
    out = []
    for c in range(codes):
        rng = np.random.default_rng([seed + c, dims])
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        directions = rng.standard_normal((blocks, words, -(-dims // blocks)))
        out.append((rotation, directions / np.linalg.norm(directions, axis=2, keepdims=True) / np.sqrt(blocks)))
    return out


def words_for(n: int, dims: int, blocks: int = 2) -> int:
    """Directions of a block for ``n`` vectors: the filters of a code number about n / 4 to n, so a filter's expected rows don't grow
    with n. A power of two. Under 64 dimensions at most 4 a dimension, as more directions only repeat each other there."""
    words = 1 << max(4, math.ceil(math.log2(max(1, n) / 4) / blocks))
    return words if dims >= 64 else max(8, min(words, 4 * dims))


def cap_for(dims: int, codes: int, blocks: int, words: int, least: float, recall: float, seed: int, pairs: int = 512, best: int = 128) -> float:
    """The inner product that a filter asks for, such that a share ``recall`` of random pairs with a cosine of exactly ``least`` pass
    a common filter. Of each pair only the ``best`` directions of either half are tried, which can only raise the recall."""
    rng = np.random.default_rng([seed, dims, words])
    x, z = rng.standard_normal((2, pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    ends = np.concatenate([x, least * x + np.sqrt(1 - least**2) * z])
    shared, half = np.full(pairs, -2.0), blocks // 2
    for code in _code(dims, codes, blocks, words, seed):
        products = _products(ends, *code)
        for i in range(pairs):
            a, b = ([_sums(products[j][:half]), _sums(products[j][half:])] for j in (i, i + pairs))
            top = [np.argsort(-(u + v))[:best] for u, v in zip(a, b)]
            reached = [side[0][top[0]][:, None] + side[1][top[1]] for side in (a, b)]
            shared[i] = max(shared[i], np.minimum(*reached).max())
    return float(np.quantile(shared, 1 - recall))


FITTED = 4096  # vectors, about, of one length on which the centre is fitted; fewer than 1,000 vectors have none


def centred(units: np.ndarray, mean: np.ndarray | None) -> np.ndarray:
    """Unit vectors less the mean as units again; one that is the mean stays itself."""
    if mean is None:
        return units
    moved = units - mean
    norms = np.linalg.norm(moved, axis=1, keepdims=True)
    return np.where(norms > 1e-6, moved / np.maximum(norms, 1e-6), units)


def pairs_met(lists: list[np.ndarray], n: int) -> float:
    """How many others each of ``n`` vectors is compared with, filter by filter, by the filters of a sample of them."""
    many = np.unique(np.concatenate(lists), return_counts=True)[1].astype(float)
    return float((many * (many - 1)).sum()) / len(lists) / max(1, len(lists) - 1) * n


def fit(sample: np.ndarray, n: int, codes: int, blocks: int, words: int, least: float, recall: float, seed: int, tried: int = 1024) -> tuple[float, np.ndarray | None]:
    """The cap for ``n`` vectors like the unit vectors of ``sample``, and the mean to take from them first, or None. Pairs at cosine ``least`` lie
    at a fixed distance, so their cosine about the mean follows from how far from it they are; of the sample's distances the least but for
    one in fifty counts."""
    dims = sample.shape[1]
    cap, mean = cap_for(dims, codes, blocks, words, least, recall, seed), sample.mean(axis=0).round(6)
    if mean @ mean < 0.02:
        return cap, None
    moved = 1 - (1 - least) / max(float(np.quantile(((sample - mean) ** 2).sum(axis=1), 0.02)), 1e-9)
    if moved < 0.1:
        return cap, None
    own = cap_for(dims, codes, blocks, words, moved, recall, seed)
    plain, about = (pairs_met(decode(centred(sample[:tried], m), codes, blocks, words, c, seed), n) for m, c in ((None, cap), (mean, own)))
    return (own, mean) if about < 0.8 * plain else (cap, None)


def _products(units: np.ndarray, rotation: np.ndarray, directions: np.ndarray) -> np.ndarray:
    blocks, _, length = directions.shape
    turned = np.zeros((len(units), blocks * length))
    turned[:, : units.shape[1]] = units @ rotation
    return np.einsum("nbd,bwd->nbw", turned.reshape(len(units), blocks, length), directions, optimize=True)


def decode(units: np.ndarray, codes: int, blocks: int, words: int, cap: float, seed: int) -> list[np.ndarray]:
    """For each unit vector the filters, ascending, whose inner product with it reaches the cap; of a code without any, the best
    filter instead."""
    found = [_decode(units, code, cap) for code in _code(units.shape[1], codes, blocks, words, seed)]
    return [np.concatenate([own + c * words**blocks for c, own in enumerate(lists)]) for lists in zip(*found)]


def _decode(units: np.ndarray, code: tuple[np.ndarray, np.ndarray], cap: float) -> list[np.ndarray]:
    half, out = len(code[1]) // 2, []
    for p in _products(units, *code):
        left, right = _sums(p[:half]), _sums(p[half:])
        order = np.argsort(-right)
        reach = np.searchsorted(-right[order], left - cap, side="right")  # how many on the right suffice for each on the left
        rows = np.flatnonzero(reach)
        many = reach[rows]
        if len(rows):
            first = np.repeat(np.cumsum(many) - many, many)
            found = np.repeat(rows, many) * len(right) + order[np.arange(many.sum()) - first]
        else:
            found = np.array([left.argmax() * len(right) + order[0]])
        out.append(np.sort(found))
    return out


def _sums(parts: np.ndarray) -> np.ndarray:
    total = parts[0]
    for p in parts[1:]:
        total = (total[:, None] + p).ravel()
    return total


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _compare(a: list[tuple], b: list[tuple] | None, dims: int, filter_: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(id, links, local component) within ``a``, or between ``a`` and ``b``. A row: id, weight, vector, filters."""
    rows = a if b is None else a + b
    packed = b"".join(r[2] for r in rows)
    vectors = np.frombuffer(packed, np.float32 if len(packed) == 4 * dims * len(rows) else np.float64).reshape(-1, dims)
    vectors = _units(vectors.astype(np.float64))
    n = len(a)
    near = (vectors[:n] @ vectors.T if b is None else vectors[:n] @ vectors[n:].T) >= least
    if b is None:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    linked = near.any(axis=1) if b is None else np.concatenate([near.any(axis=1), near.any(axis=0)])
    # Pairs that share a lesser filter are counted there. Only filters that two linked rows pass can say so.
    at = np.flatnonzero(linked)
    lesser = [f[: np.searchsorted(f, filter_)] for f in (np.frombuffer(rows[k][3], np.int64) for k in at)]
    values, place, many = np.unique(np.concatenate(lesser), return_inverse=True, return_counts=True)
    counted, common = near, np.cumsum(many > 1) - 1
    if (many > 1).any():
        has = np.zeros((len(rows), common[-1] + 1), np.float32)
        shared = many[place] > 1
        has[np.repeat(at, [len(f) for f in lesser])[shared], common[place[shared]]] = 1
        counted = near & ~((has[:n] @ (has if b is None else has[n:]).T) > 0.5)
    weights = np.array([r[1] for r in rows], np.int64)
    other = weights if b is None else weights[n:]
    links = counted.astype(np.int64) @ other
    root = _local(near, len(rows), 0 if b is None else n)
    ids = [r[0] for r in rows]
    if b is not None:
        links = np.concatenate([links, counted.T.astype(np.int64) @ weights[:n]])
    for k in at:
        yield ids[k], int(links[k]), ids[root[k]]


def _local(near: np.ndarray, n: int, shift: int) -> np.ndarray:
    """A representative of each row's component under ``near``: rows, against all rows or those from ``shift`` on."""
    root = np.full(n, -1)
    for k in range(n):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            if shift:
                left, right = front[front < shift], front[front >= shift] - shift
                reached = np.zeros(n, bool)
                if len(left):
                    reached[shift:] |= near[left].any(axis=0)
                if len(right):
                    reached[:shift] |= near[:, right].any(axis=1)
            else:
                reached = near[front].any(axis=0)
            front = np.flatnonzero(reached & (root < 0))
            root[front] = k
    return root


_ROW = "filter long, id long, weight long, dims int, vector binary, filters binary"
_OUT = "id long, links long, root long, filter long, chunk int, weight long, dims int, vector binary, filters binary"
_NAMES = ["id", "links", "root", "filter", "chunk", "weight", "dims", "vector", "filters"]


def _results(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[]] * 3
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(cols[k] if k < 3 else [None] * len(found), kind) for k, kind in enumerate(kinds)], _NAMES)


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.98, codes: int = 3, blocks: int = 2, words: int | None = None, seed: int = 20, chunk: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return (``id_col``, n_links, component_id, kept), a row for each row of ``vectors``, in no order.

    n_links: the other vectors linked directly, equal ones included; component_id: the least id that can be reached; kept:
    whether that is the own id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link. Rows with a null id link with nothing and have a null component and kept.
    Repeated ids are rows of their own that share links. Every vector is indexed; the code is random: of pairs with a cosine of
    exactly ``least`` a share ``recall`` is found, of higher ones more (tests measure it against brute force). ``words``: directions
    a block; by default they follow the number of vectors, so that a filter's expected rows stay the same.
    """
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    usable = F.col("id").isNotNull() & F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    distinct = saved(rows.where(usable).groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    made = {}
    for r in distinct.groupBy(F.size("vector").alias("dims")).count().collect():  # one row a vector length
        own = words or words_for(r["count"], r.dims, blocks)
        if r["count"] >= 1000:
            drawn = distinct.where((F.size("vector") == r.dims) & (F.pmod(F.xxhash64("vector"), F.lit(r["count"])) < FITTED)).select("vector")
            sample = _units(np.array([x.vector for x in drawn.collect()], np.float64))  # about FITTED rows whatever the table
            made[r.dims] = own, *fit(sample, r["count"], codes, blocks, own, least, recall, seed)
        else:
            made[r.dims] = own, cap_for(r.dims, codes, blocks, own, least, recall, seed), None
    most = max((w for w, _, _ in made.values()), default=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(8, min(256, (1 << 20) // most))):
            raw, lengths = batch.column(0), batch.column(0).value_lengths().to_numpy()
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                own = raw.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dims)
                own_words, cap, mean = made[int(dims)]
                found = decode(centred(_units(own.astype(np.float64)), mean), codes, blocks, own_words, cap, seed)
                many = [len(f) for f in found]
                k = np.repeat(np.arange(len(at)), many)
                packed, lists = [u.tobytes() for u in own], [f.tobytes() for f in found]
                columns = [pa.array(np.concatenate(found).astype(np.int64)), batch.column(1).take(pa.array(at[k])), batch.column(2).take(pa.array(at[k])), pa.array(np.full(len(k), dims, np.int32)), pa.array([packed[i] for i in k], pa.binary()), pa.array([lists[i] for i in k], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["filter", "id", "weight", "dims", "vector", "filters"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, passed, out = None, -1, []

        def close() -> None:
            if passed < 0 and len(held) > 1:
                half = held[:chunk], held[chunk:]
                for part in half:
                    if len(part) > 1:
                        out.extend(_compare(part, None, key[0], key[1], least))
                if half[1]:
                    out.extend(_compare(*half, key[0], key[1], least))

        for batch in batches:
            hot = []
            for f, i, w, d, v, fs in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, f) != key:
                    close()
                    key, held, passed = (d, f), [], -1
                if passed >= 0:
                    hot.append((i, f, passed // chunk, w, d, v, fs))
                    passed += 1
                    continue
                held.append((i, w, v, fs))
                if len(held) > 2 * chunk:  # a hot filter: its rows go on, in numbered blocks
                    hot += [(r[0], f, n // chunk, r[1], d, r[2], r[3]) for n, r in enumerate(held)]
                    passed, held = len(held), []
            if len(out) > 5000:
                yield _results(out)
                out.clear()
            if hot:
                ids, fs, cs, ws, ds, vs, ls = zip(*hot)
                none = [None] * len(hot)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(fs, pa.int64()), pa.array(cs, pa.int32()), pa.array(ws, pa.int64()), pa.array(ds, pa.int32()), pa.array(vs, pa.binary()), pa.array(ls, pa.binary())], _NAMES)
        close()
        yield _results(out)

    def verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []

        def close() -> None:
            if key and sides[0]:
                if key[2] == key[3]:
                    out.extend(_compare(sides[0], None, key[0], key[1], least))
                elif sides[1]:
                    out.extend(_compare(sides[0], sides[1], key[0], key[1], least))

        for batch in batches:
            for f, a, b, c, i, w, d, v, fs in zip(*(x.to_pylist() for x in batch.columns)):
                if (d, f, a, b) != key:
                    close()
                    key, sides = (d, f, a, b), ([], [])
                sides[c != a].append((i, w, v, fs))
            yield _results(out)
            out.clear()
        close()
        yield _results(out)

    placed = distinct.select("vector", "id", "weight").mapInArrow(place, _ROW)
    dealt = placed.repartition("dims", "filter").sortWithinPartitions("dims", "filter")
    first = saved(dealt.mapInArrow(verify, _OUT))
    hot = first.where("filter is not null").select("filter", "chunk", "id", "weight", "dims", "vector", "filters")
    chunks = hot.groupBy("dims", "filter").agg(F.max("chunk").alias("last"))
    pairs = hot.join(chunks, ["dims", "filter"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = pairs.select("filter", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "id", "weight", "dims", "vector", "filters")
    second = pairs.repartition("dims", "filter", "a", "b").sortWithinPartitions("dims", "filter", "a", "b").mapInArrow(verify_blocks, _OUT)
    found = saved(first.where("filter is null").select("id", "links", "root").unionByName(second.select("id", "links", "root")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id != root").select("id", "root"))
    known = distinct.join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("vector", F.col("weight"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    own = rows.where(usable).join(known, "vector").select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
