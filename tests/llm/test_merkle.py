import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from segspark.llm import queries
from segspark.llm.merkle import fold, manifest, proofs

DATA = "/root/testdata/sf0.01"
VALUES = ["doc_id", "source", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climbed(nodes, arity):
    """(root, proof of each node as a list of (before, after))"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity :][:arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], paths


def by_hand(rows, arity):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, h(*map(framed, r)), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: climbed([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], arity) for s in order}
    root, above = climbed([subs[s][0] for s in order], arity)
    out = []
    for s, up in zip(order, above):
        for x, path in zip(sorted(trees[s], key=lambda x: x[:3]), subs[s][1]):
            out.append((str(x[1] if x[0] else None), x[2], subs[s][0], path + up))
    return root, sorted(out)


def got(m):
    rows = proofs(m).withColumn("folded", fold(F.col("digest"), F.col("path"))).collect()
    assert all(r.folded == m.root for r in rows)
    return sorted((str(r.id), r.digest, r.subroot, [(x.before, x.after) for x in r.path]) for r in rows)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_trees_equal_brute_force(spark, arity):
    sizes = {"a": 1, "b": 2, "é": 16, "z": 17, None: 300, "": 33}
    rows = [(i, s, f"text {i} of {s}") for s, n in sizes.items() for i in range(n)]
    m = manifest(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7), VALUES, arity=arity)
    root, want = by_hand(rows, arity)
    assert m.root == root and got(m) == want


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, ""), (1, "s", "x"), (1, "s", "x"), (1, "s", "y"), (-5, "s", "é" * 100_000), (2, "-", "-")] + [(9, "t", "same")] * 500
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, source string, text string, idx int, tree string, n int")
    m = manifest(docs, VALUES)
    root, want = by_hand(rows, 16)
    assert m.root == root and got(m) == want
    empty = manifest(docs.limit(0), VALUES)
    assert empty.root is None and proofs(empty).count() == 0
    one = manifest(docs.limit(1), VALUES)
    assert one.root == one.levels[0].first().digest and got(one)[0][3] == []
    with pytest.raises(ValueError):
        manifest(docs, VALUES, arity=1)


def test_query_equals_sql_and_finds_what_was_tampered_with(spark):
    assert differences(spark, connect(DATA), queries.op13_merkle_manifest, queries.ORACLE_SQL["op13_merkle_manifest"], DATA) is None
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    bad = {i for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in t or "")}
    rows = queries.op13_merkle_manifest(spark, DATA).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows if not r.verified} == bad
