import random
import time

from segspark.llm import queries
from segspark.llm.substring_dedup import runs_of, sentences_of, without_repeats

DATA = "/root/testdata/sf0.001"


def brute(rows, sentences=2, words=20, alone=50):
    """rows: (id, text), ids distinct. The texts without sentences covered by a non-first run."""
    seen, covered = {}, {i: set() for i, _ in rows}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        parts = sentences_of(text or "")
        held = [" ".join(p.split()) for p in parts]
        for a in range(len(parts)):
            own = []
            if len(held[a].split()) >= alone:
                own.append((a, a + 1, ("alone", held[a])))
            for b in range(a + sentences, len(parts) + 1):  # every run of any length
                if sum(len(h.split()) for h in held[a:b]) >= words:
                    own.append((a, b, tuple(held[a:b])))
            for a_, b, key in own:
                if key in seen:
                    covered[i] |= set(range(a_, b))
                else:
                    seen[key] = i
    return {i: (None if t is None else "".join(p for k, p in enumerate(sentences_of(t)) if k not in covered[i]), len(covered[i])) for i, t in rows}


def test_sentences_join_to_the_text():
    for text in ["", "a", "A. B! C?\n\nd e", "x...  y\n", " \n . ", "1.5 is 2.\t\nNo", "\n\na.\n"]:
        assert "".join(sentences_of(text)) == text


def test_runs_are_the_shortest(spark):
    rng = random.Random(4)
    for _ in range(300):
        parts = [" ".join(["w"] * rng.choice([1, 2, 5, 12, 30, 60])) + ". " for _ in range(rng.randint(0, 9))]
        sizes = [len(p.split()) for p in parts]
        got = [(a, n) for a, n, _ in runs_of(parts, 2, 20, 50)]
        want = []
        for a in range(len(parts)):
            want += [(a, 1)] * (sizes[a] >= 50)
            want += next(([(a, b - a)] for b in range(a + 2, len(parts) + 1) if sum(sizes[a:b]) >= 20), [])
            want += next(([(b, a + 1 - b)] for b in range(a - 1, -1, -1) if sum(sizes[b : a + 1]) >= 20), [])
        assert got == sorted(set(want)), sizes


def test_sentences_take_linear_time():
    for text in ("." * 400_000, "a." * 200_000, ". " * 200_000, "\n" * 400_000, " " * 400_000):
        start = time.perf_counter()
        assert "".join(sentences_of(text)) == text and time.perf_counter() - start < 2


def passage(rng, n=60):
    return " ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(99)) + ("." if k % 9 == 8 else "") for k in range(n)) + "."


def test_repeats_go_and_the_first_stays(spark):
    rng = random.Random(6)
    shared = passage(rng)
    rows = [(i, f"{passage(rng)} {shared} {passage(rng)}" if i % 3 == 0 else passage(rng, 90)) for i in range(1, 30)] + [(0, None), (None, ""), (40, "Short. Short. Short.")]
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "doc_id long, text string, n_removed int, id string")
    got = {r.doc_id: (r.text, r.n_removed) for r in without_repeats(docs).collect()}
    assert got == brute(rows)
    assert sum(shared[10:-10] in (t or "") for t, _ in got.values()) == 1
    same = spark.createDataFrame([(5, shared)] * 3 + [(6, shared)], "doc_id long, text string")
    assert sorted(r.n_removed > 0 for r in without_repeats(same).collect()) == [False, False, False, True]
    assert without_repeats(docs.limit(0)).count() == 0


def test_scripts_without_spaces(spark):
    rng = random.Random(8)

    def text(first, last, end, n=12):
        return "".join("".join(chr(rng.randrange(first, last)) for _ in range(rng.randrange(9, 16))) + end for _ in range(n))

    shared = [text(0x4E00, 0x9000, "\u3002"), text(0x3042, 0x3090, "\uff01\u300d"), text(0x0E01, 0x0E2E, "\n")]
    docs, short = [], "\u4e2d\u6587\u3002" * 2  # two sentences of one word each: no run
    for k, s in enumerate(shared):
        own = [text(0x5000, 0x5FFF, "\u3002", 3) for _ in range(3)]
        docs += [(10 * k, own[0] + s + short), (10 * k + 1, own[1] + s + own[2] + short)]
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, s in enumerate(shared):
        assert got[10 * k][0] == docs[2 * k][1] and got[10 * k][2] == 0
        assert got[10 * k + 1][0] == docs[2 * k + 1][1].replace(s, "") and got[10 * k + 1][2] == 12
    assert "".join(sentences_of(shared[1] + shared[0])) == shared[1] + shared[0] and len(sentences_of(shared[1])) == 12


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {r.doc_id: (r.text, r.n_removed) for r in queries.op7_substring_dedup(spark, DATA).collect()} == brute(docs)
