import random

import numpy as np
import pytest
import xxhash

from segspark.llm import queries
from segspark.llm.common import components
from segspark.llm.simhash import blocks_for, fingerprint, links, near_duplicates, one_of_each

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in items}


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \t\n", "a", "A b", "a b c d", "Ä É x Y z\x0bq\x1cw", "a b c d " * 50]:
        assert fingerprint(text, 4) % 2**64 == brute_fingerprint(text), text


@pytest.mark.parametrize("blocks", [2, 3])
def test_links_equal_brute_force(spark, blocks):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)] + [0]
    for b in list(base):
        for _ in range(8):
            x = b
            for p in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << p
            base.append(x)
    fps = sorted({x - 2**64 if x >> 63 else x for x in base})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 4}
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_follow_the_number_of_fingerprints(spark):
    assert [blocks_for(n) for n in (0, 1000, 500_000, 2_000_000, 10**11)] == [3, 3, 3, 2, 2]
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3 * 7 + j) % 50}" for j in range(40)) + f" end{i % 3}") for i in range(60)], "doc_id long, text string")
    got = [sorted(map(tuple, near_duplicates(docs, blocks=b).collect())) for b in (None, 2, 3)]
    assert got[0] == got[1] == got[2] and len({c for _, _, c in got[0]}) < 60


def test_components_on_a_long_chain_and_a_hub(spark):
    rng = random.Random(1)
    linked = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randrange(90), 5000 + rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    items = {x for e in linked for x in e if e[0] != e[1]}
    got = dict(tuple(r) for r in components(spark.createDataFrame(linked, "a long, b long")).collect())
    assert got == brute_components(items, [e for e in linked if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (2, None), (3, "  "), (None, "A  b c D e"), (1, "a b c d e"), (9, "")]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 2), (9, 2)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert one_of_each(docs.limit(0)).count() == 0 and one_of_each(docs.where("doc_id is null")).count() == 1


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    fps = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    ids, bits = sorted(fps), np.array([fps[i] for i in sorted(fps)], np.uint64)
    linked = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4) if i < j]
    want = brute_components(ids, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, DATA).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
