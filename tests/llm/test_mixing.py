import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from segspark.llm import queries
from segspark.llm.mixing import Draws, Permutation, block_texts, mix, planned, taken, targets

DATA = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 0], [5, 2, 1]) == [30.0, 980.0, 0.0]
    # 5 and 5 are over three times their sizes, then 2 is over as well
    assert targets([10, 20, 30, 1000], [5, 5, 5, 1]) == [30.0, 60.0, 90.0, 880.0]
    assert targets([0, 0], [1, 1]) == [0.0, 0.0] and targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 12_345])
def test_permutations(n):
    p = Permutation(n, 3, 4)
    there = p(np.arange(n))
    assert sorted(there.tolist()) == list(range(n)) and p(there, back=True).tolist() == list(range(n))
    if n > 60:
        assert Permutation(n, 3, 5)(np.arange(n)).tolist() != there.tolist() and abs(np.corrcoef(there, np.arange(n))[0, 1]) < 0.3


def test_plans_take_what_is_wanted():
    for size in (1, 7, 8, 9, 100):
        for wanted in range(3 * size + 1):
            s = planned(0, size, wanted, 8, 5)
            short = size - (s.blocks - 1) * 8
            held = [short if b == s.blocks - 1 else 8 for t in range(4) for b in Permutation(s.blocks, 5, 0, t)(np.arange(s.blocks))]
            assert sum(held[: s.slots - 1]) + s.rest == wanted if wanted else s.slots == 0
            assert not wanted or 0 < s.rest <= held[s.slots - 1]


def test_draws_add_up_and_are_multinomial():
    draws = Draws([70_000, 20_000, 9_000, 0, 997], 100, 1)
    before, sums = np.zeros(5, int), []
    for shard in range(draws.shards):
        ahead, counts = draws.of(shard)
        assert (ahead == before).all() and counts.sum() == (100 if shard < draws.shards - 1 else 97)
        before = before + counts
        sums.append(counts)
    assert before.tolist() == [70_000, 20_000, 9_000, 0, 997]
    variance = np.var(np.array(sums[:-1])[:, 1])
    assert 0.8 < variance / (100 * 0.2 * 0.8) < 1.25
    big = Draws([3 * 10**12, 10**12], 2 * 10**12, 1)
    assert sum(big.of(k)[1] for k in range(2)).tolist() == [3 * 10**12, 10**12]


def by_hand(docs, weights):
    """source -> (size, target)"""
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return dict(zip(order, zip([sizes[s] for s in order], targets([sizes[s] for s in order], [weights[k % len(weights)] for k in range(len(order))]))))


def test_query_keeps_its_law_and_reruns_agree(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_mixing(spark, DATA).collect()}
    assert set(got) == set(docs)
    want, sums = by_hand([(r.doc_id, r.source, r.text) for r in docs.values()], [5, 2, 1]), Counter()
    for i, r in got.items():
        n, t = want[docs[i].source]
        assert (r["size"], r.source_size) == (len(words(docs[i].text)), n) and r.target == pytest.approx(t)
        # whole passes take all of a document, the last one some blocks
        assert t // n * r["size"] <= r.taken <= min(3, t // n + 1) * r["size"]
        sums[docs[i].source] += r.taken
    assert all(sums[s] == min(round(t), 3 * n) for s, (n, t) in want.items())
    # other partitions, the same draws
    again = taken(mix(spark.read.parquet(f"{DATA}/documents.parquet").repartition(13), weights=[5, 2, 1])).collect()
    assert {r.id: r.taken for r in again} == {i: r.taken for i, r in got.items()}


def test_blocks_are_the_sources_words(spark):
    rows = [(i, "ab"[i % 2], " ".join(f"w{i}x{k}" for k in range(i % 23))) for i in range(200)] + [(1000, None, "ä b\tc\x0bd e"), (1001, None, None)]
    m = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), [3, 1], block=16, shard_slots=8, texts=True)
    shards, lengths, held = defaultdict(list), Counter(), Counter()
    for r in block_texts(m).collect():
        shards[r.shard].append(r.slot)
        lengths[r.source, len(words(r.text))] += 1
        held.update((r.source, w) for w in words(r.text))
    assert all(sorted(x) == list(range(len(x))) and len(x) == 8 for s, x in shards.items() if s < max(shards)) and sorted(shards) == list(range(max(shards) + 1))
    assert lengths["a", 16] + lengths["b", 16] > 0.9 * sum(lengths.values())
    want = by_hand(rows, [3, 1])
    for s, (n, t) in want.items():
        assert sum(n for (x, _), n in held.items() if x == s) == min(round(t), 3 * n)
    counts = [held["ab"[i % 2], f"w{i}x{k}"] for i in range(200) for k in range(i % 23)]
    assert max(counts) - min(counts) <= 2 and max(counts) <= 3
    assert sum(held[None, w] for w in words(rows[200][2])) == 9 and len(words(rows[200][2])) == 3


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, ""), (1, "s", "x y"), (1, "s", "x y"), (1, "s", "z"), (2, "", "w " * 30_000), (3, "only empty", "")] + [(9, "t", "same again")] * 600
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, size int, src int, start int")
    got, want = taken(mix(docs, [1], block=100, shard_slots=10)).collect(), by_hand(rows, [1])
    assert sorted((str(r.id), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, _, t in rows)
    assert all(r.taken <= 3 * r["size"] and r.target == pytest.approx(want[r.source][1]) for r in got)
    sums = Counter()
    for r in got:
        sums[r.source] += r.taken
    assert all(sums[s] == min(round(t), 3 * n) for s, (n, t) in want.items())
    assert taken(mix(docs.limit(0), [1])).count() == 0
    assert [r.taken for r in taken(mix(docs.where("text = '' or text is null"), [1])).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        mix(docs, [1], most_sources=2)
