import numpy as np
from pyspark.sql import functions as F

from segspark.llm import queries
from segspark.llm.toxicity import fit, score, without_toxic

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    train = F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 8
    chain = fit(docs, labels.where(train))
    assert chain.categories == ("kind_1", "kind_2", "toxic")
    got = score(docs, chain).join(labels.where(~train).select("doc_id", F.col("toxic").alias("truth")), "doc_id").toPandas()
    right, truth = got["toxic"].to_numpy(bool), got["truth"].to_numpy(bool)
    rows = len(got)
    assert rows > 300 and np.mean(right == truth) > 0.98
    assert not (right & ~truth).sum() > 0.002 * rows
    # The chain against the last model alone, by their log loss on rows that neither saw.
    alone = score(docs, fit(docs, labels.where(train), kinds=0)).join(labels.where(~train).select("doc_id", F.col("toxic").alias("truth")), "doc_id").toPandas()

    def loss(p, y):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return -np.mean(np.where(y, np.log(p), np.log(1 - p)))

    chained, single = loss(got["p_toxic"].to_numpy(), truth), loss(alone["p_toxic"].to_numpy(), alone["truth"].to_numpy(bool))
    print("log loss of the chain and alone", chained, single)
    assert chained < single


def test_chain_feeds_earlier_categories(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chain = fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert chain.earlier[1, 0] and chain.earlier[2, :2].all() and not np.triu(chain.earlier).any()


def test_odd_rows(spark):
    text = "you idiot moron loser"
    docs = spark.createDataFrame([(i, text if i % 2 else "a calm day", 1, "q") for i in range(40)] + [(None, text, 1, "q"), (50, None, 1, "q"), (51, "", 1, "q"), (1, text, 1, "q")], "doc_id long, text string, toxic int, p_toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (50, 1), (39, None), (0, 0)], "doc_id long, toxic int")
    chain = fit(docs, labels)
    got = score(docs, chain).collect()
    assert len(got) == 44 and {r.doc_id for r in got if r.toxic} == {*range(1, 40, 2), None}
    kept = without_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 22
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert score(docs, fit(docs, few)).where("toxic").count() == 0
    assert score(docs.limit(0), chain).count() == 0 and score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_query(spark):
    """Against the same chain applied row by row: every document is scored, by its whole text."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    chain = fit(docs, labels)
    want = {r.doc_id: chain.predict([r.text])[0] for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, data).collect()}
    assert set(got) == set(want) and len(want) == 200
    for i, r in got.items():
        assert np.allclose([r.p_kind_1, r.p_kind_2, r.p_toxic], want[i]) and r.toxic == (want[i][-1] >= chain.threshold)
