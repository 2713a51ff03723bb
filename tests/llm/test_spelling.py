import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from compare import connect, differences

from segspark.llm import queries
from segspark.llm.spelling import cheapest_disjoint, near_words, pivots_and_prefix, variants, word_counts

DATA = "/root/testdata/sf0.01"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def by_hand(counts, factor=10):
    found = {}
    for w, n in counts.items():
        close = sorted((-counts[x], x) for x in counts if near(w, x))
        form = close[0] if close and -close[0][0] >= factor * n else None
        found[w] = [form and form[1], n, len(close), form and -form[0]]
    out = set()
    for w, (form, n, k, fn) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, k, fn))
    return out


def words_of(rng, n):
    kinds = ["ab", "abcdé", "aaaab", "theringo𝕏"]
    words = set()
    while len(words) < n:
        w = "".join(rng.choices(rng.choice(kinds), k=rng.randint(4, 12)))
        words.add(w)
        for _ in range(rng.randint(0, 3)):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcdéx")
            w = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            if len(w) >= 4:
                words.add(w)
    return sorted(words)


def test_random_words_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words_of(rng, 900)}
    docs = spark.createDataFrame(list(counts.items()), "word string, n long")
    for table in (65_536, 3):
        assert {tuple(r) for r in variants(docs, table=table).collect()} == by_hand(counts)


def test_long_and_repeated_letters(spark):
    words = ["a" * k for k in range(4, 40)] + ["ab" * 6000, "ab" * 5999 + "a", "ab" * 3000 + "x" + "ab" * 3000, "a" * 20_000, "a" * 20_001, "a" * 10_000 + "b" + "a" * 10_000]
    got = Counter()
    for r in near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect():
        got[r.word, r.near] += 1
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)} and set(got.values()) == {1}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(500):
        grams = [(p, rng.randint(0, 9)) for p in rng.sample(range(8), rng.randint(3, 6))]
        cost = dict(grams)
        a, b = cheapest_disjoint(grams)
        assert b - a >= 2 and cost[a] + cost[b] == min(cost[p] + cost[q] for p in cost for q in cost if q - p >= 2)
    assert pivots_and_prefix("zebra", {"ze": 9, "eb": 1, "br": 2, "ra": 3}) == ((1, 3), [1, 2, 3])


def test_word_counts(spark):
    rows = [(1, "Ähnliche ÄHNLICHE ähnliche Ãbcdefg×÷ can't abcdefg"), (2, None), (None, ""), (3, "abcdefg ABCDEFG-abcdefghij_x"), (3, "q" * 100_000 + " " + "Q" * 100_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = {r.word: r.n for r in word_counts(docs).collect()}
    assert got == {"abcdefg": 3, "Ähnliche": 2, "q" * 100_000: 2}  # the umlaut keeps its case
    assert {r.word: r.n for r in word_counts(docs, least=1, held=1).collect()}["Ãbcdefg×÷"] == 1
    assert word_counts(docs.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(None, 5), ("", 2), ("abc", 9), ("abcd", 2), ("abce", 900), ("abcde", 20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "word string, n long, near string, key int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(docs).collect()}
    assert got == {"": (None, "", 2, 0, None), "abc": (None, "abc", 9, 0, None), "abcd": ("abce", "abce", 2, 2, 900), "abce": (None, "abce", 900, 2, None), "abcde": ("abce", "abce", 20, 2, 900)}
    assert variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants(docs, factor=1)
    chain = {"abcd" + "e" * k: 10**k for k in range(12)}
    roots = {r.root for r in variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert roots == {"abcd" + "e" * 11}


def test_query_equals_sql_and_brute_force(spark):
    assert differences(spark, connect(DATA), queries.op11_spelling_variants, queries.ORACLE_SQL["op11_spelling_variants"], DATA) is None
    small, counts = "/root/testdata/sf0.001", Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = crc32(f"{r.doc_id}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    groups = defaultdict(list)
    for w in counts:
        groups[len(w)].append(w)
    assert {tuple(r) for r in queries.op11_spelling_variants(spark, small).collect()} == by_hand(counts)
