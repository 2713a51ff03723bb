import numpy as np
import pyarrow.parquet as pq
import pytest

from segspark.llm import queries
from segspark.llm.embedding_dedup import cap_for, centred, decode, fit, near_duplicates, pairs_met, words_for


def brute(ids, vectors, least=0.9):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= least
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        low, high = sorted((find(ids[a]), find(ids[b])))
        root[high] = low
    return near.sum(axis=1), [find(i) for i in ids]


def planted(rng, n=150, dims=64):
    base = rng.standard_normal((n, dims))
    near = [b + rng.standard_normal(dims) * s * np.linalg.norm(b) / 8 for b in base[:60] for s in (0.1, 0.3, 0.44)]
    hot = [base[0] + rng.standard_normal(dims) * 0.05 for _ in range(300)]
    return np.concatenate([base, near, hot, base[:40], base[:1].repeat(90, axis=0)])


@pytest.mark.parametrize("rows", [100, 50_000, 1_000_000])
@pytest.mark.parametrize("dims", [2, 3, 8, 20, 64, 100])
def test_recall_at_the_threshold(dims, rows):
    words = words_for(rows, dims)
    cap = cap_for(dims, 3, 2, words, 0.9, 0.98, 20)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((600, dims))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    lists = [decode(v, 3, 2, words, cap, 20) for v in (x, 0.9 * x + np.sqrt(1 - 0.81) * z)]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*lists)]) > 0.95


def test_links_counts_and_components(spark):
    vectors = planted(np.random.default_rng(2)).astype(np.float32)
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(vectors)) + 10]
    many, comp = brute(ids, vectors.astype(float))
    docs = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, n_links string")
    for chunk in (16, 512):  # with small blocks most filters are hot
        got = {r.vec_id: r for r in near_duplicates(docs, chunk=chunk).collect()}
        assert len(got) == len(ids)
        assert all(got[i].n_links <= n for i, n in zip(ids, many))
        assert sum(r.n_links for r in got.values()) >= 0.97 * many.sum()
        assert np.mean([got[i].component_id == c for i, c in zip(ids, comp)]) > 0.98
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-300, 2e-300]), (11, [-1.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), (None, 0, None, None), *alone], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.1"
    t = pq.read_table(f"{data}/embeddings.parquet")
    ids, vectors = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist())
    many, comp = brute(ids, vectors)
    got = {r.vec_id: r for r in queries.op8_embedding_dedup(spark, data).collect()}
    assert len(got) == len(ids) and all(got[i].n_links <= n for i, n in zip(ids, many))
    assert sum(r.n_links for r in got.values()) >= 0.98 * many.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, comp)]) > 0.98


def test_filters_hold_as_many_rows_at_every_size():
    rng, held = np.random.default_rng(4), []
    for rows in (4_000, 64_000, 1_000_000):
        words = words_for(rows, 64)
        x = rng.standard_normal((200, 64))
        lists = decode(x / np.linalg.norm(x, axis=1, keepdims=True), 3, 2, words, cap_for(64, 3, 2, words, 0.9, 0.98, 20), 20)
        held.append(np.mean([len(f) for f in lists]) * rows / (3 * words**2))
    assert max(held) < 100 and held[-1] < 3 * held[0]


def _leaning(rng, n, dims=64, shared=0.5):
    """Unit vectors with a common direction, whose cosines have the mean ``shared``."""
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - shared) * x
    x[:, 0] += np.sqrt(shared)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [4_000, 16_000])
def test_a_common_direction_is_taken_out(rows):
    rng = np.random.default_rng(6)
    units, words = _leaning(rng, 3000), words_for(rows, 64)
    cap, mean = fit(units, rows, 3, 2, words, 0.9, 0.98, 20)
    assert mean is not None and abs(mean @ mean - 0.5) < 0.02
    about = pairs_met(decode(centred(units, mean), 3, 2, words, cap, 20), rows)
    plain = pairs_met(decode(units, 3, 2, words, cap_for(64, 3, 2, words, 0.9, 0.98, 20), 20), rows)
    assert about < 0.5 * plain
    z = rng.standard_normal(units.shape)
    z -= (z * units).sum(1, keepdims=True) * units
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    ends = [decode(centred(v, mean), 3, 2, words, cap, 20) for v in (units[:600], (0.9 * units + np.sqrt(0.19) * z)[:600])]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*ends)]) > 0.95
    spread = rng.standard_normal((3000, 64))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    assert fit(spread, rows, 3, 2, words, 0.9, 0.98, 20)[1] is None


def test_links_about_a_common_direction(spark):
    rng = np.random.default_rng(9)
    base = _leaning(rng, 900)
    vectors = np.concatenate([base, *[base[:150] + rng.standard_normal((150, 64)) * s for s in (0.02, 0.045, 0.055)]])
    many, comp = brute(list(range(len(vectors))), vectors)
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(vectors) and all(got[i].n_links <= n for i, n in enumerate(many))
    assert sum(r.n_links for r in got.values()) >= 0.96 * many.sum() > 500
    assert np.mean([got[i].component_id == c for i, c in enumerate(comp)]) > 0.97
