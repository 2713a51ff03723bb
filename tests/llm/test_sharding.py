import zlib
from collections import Counter, defaultdict

from segspark.llm import queries
from segspark.llm.sharding import kd_shards

DATA = "/root/testdata/sf0.01"


def test_query_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op10_kd_shards(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 40, max(r["size"] for r in got)
    assert max(abs(s - mean) for s in size.values()) <= 1.5 * largest


def test_hot_group_is_cut_and_small_groups_stay(spark):
    rows = [(i, "same text " * 9) for i in range(3000)] + [(10_000 + i, f"text {i // 3} " * (1 + i // 3 % 40)) for i in range(3000)]
    for at_once in (65_536, 1000):  # below one task, and level by level first
        whole_groups(kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10, at_once=at_once).collect())


def whole_groups(got):
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values())
    where = defaultdict(set)
    for r in got:
        if r.doc_id >= 10_000:
            where[(r.doc_id - 10_000) // 3].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 10


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (1, ""), (2, "é" * 50_000), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, shard int")
    for shards, at_once in ((1, 9), (3, 9), (40, 9), (3, 2)):
        got = kd_shards(docs, shards=shards, at_once=at_once).collect()
        assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16) for i, t in rows)
        assert all(0 <= r.shard < shards for r in got)
    assert {r.shard for r in kd_shards(docs, target_bytes=20_000).collect()} <= set(range(6))
    assert kd_shards(docs.limit(0), shards=4).count() == 0
