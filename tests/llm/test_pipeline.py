import base64
import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers as P
    import tiktoken
    from test_decontaminate import brute as brute_leaks
    from test_simhash import brute_components, brute_fingerprint

    from segspark.llm.secret_scan import spans
    from segspark.llm.toxicity import fit

    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    chain = fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = {i: t for i, t in texts.items() if chain.predict([t])[0, -1] < chain.threshold}
    fps = {i: brute_fingerprint(t) for i, t in clean.items()}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    root = brute_components(sorted(fps), linked)
    items = [(r.item_id, r.text) for r in bench.collect()]
    single = [(i, t) for i, t in clean.items() if root[i] == i]
    likely = [(i, t) for i, t in single if any(x[20:50] in t for _, x in items)]
    leaked = {i for i, _ in brute_leaks(likely, items)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    want = {}
    for i, t in single:
        if i not in leaked:
            joined = []
            for a, b, _ in spans(t)[1]:
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in reversed(joined):
                t = t[:a] + "[secret]" + t[b:]
            ids = lib.encode_ordinary(t)
            want[i] = (len(ids), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(want) < len(single) <= len(clean) < len(texts)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, None, "en", "s", 0), (None, "password=abcdef1 x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == 3
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 3
