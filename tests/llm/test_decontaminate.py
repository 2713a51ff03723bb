import random
import re
import time

import regex

from segspark.llm import queries
from segspark.llm.decontaminate import NAME, NUMBER, UNIT, UNITS, contaminated, without_contaminated

_TOKEN = regex.compile(r"(?<=[\p{L}\p{N},;:)]) (?!(?<=\p{Lu} )\p{Lu}+(?!\p{L}))\p{Lu}[\p{L}'’-]*|\d(?:[\d.,]*\d)?|[\p{L}]+|[%$€£°]")


def canonical(t):
    return NAME if t[0] == " " else NUMBER if "0" <= t[0] <= "9" else UNIT if t.lower() in UNITS else t.lower()


def first(t):
    return t >= "A" and t[0] != t[0].lower()


def brute(docs, items, width=6, least=0.6, slack=16):
    """{(doc, item): (place, windows, coverage, changed)}, comparing every window of every item with every place of every document."""
    out = {}
    slot = (NAME, NUMBER, UNIT)
    named = lambda t: NAME if first(t) else canonical(t)
    for i, text in docs:
        d = _TOKEN.findall(text or "")
        own_d, named_d = [canonical(t) for t in d], [named(t) for t in d]
        for j, item in items:
            x = _TOKEN.findall(item or "")
            if len(x) < 2:
                continue
            w = min(width, len(x) - 1)
            own_x, named_x = [canonical(t) for t in x], [named(t) for t in x] if w == width else [canonical(t) for t in x]
            plain_x = [canonical(t.strip()) for t in x]
            starts = range(1, len(x) - w + 1)
            raw = {s: all(c in slot for c in own_x[s : s + w]) for s in starts}
            form = {s: ("raw", *x[s : s + w]) if raw[s] else tuple(named_x[s : s + w]) for s in starts}
            kind = {s: min(r for r in starts if form[r] == form[s]) for s in starts}
            hashes = {}
            for s in starts:
                for h in [form[s]] if raw[s] else [tuple(own_x[s : s + w]), form[s], tuple(plain_x[s : s + w])]:
                    hashes.setdefault(h, s)
            runs = {}
            for p in range(len(d) - w + 1):
                views = [tuple(own_d[p : p + w]), ("raw", *d[p : p + w])] + ([tuple(named_d[p : p + w])] if w == width else [])
                for s in {hashes[h] for h in views if h in hashes}:
                    runs.setdefault(p - s, []).append(s)
            best = None
            bands = {}
            for shift, at in runs.items():
                for key in (("alone", shift), shift // slack, shift // slack + 1):
                    bands.setdefault(key, []).append((-len(at), shift, sorted(at)))
            for band in bands.values():
                held = []
                for _, shift, at in sorted(band):
                    held += [n for n in [(s, shift) for s in at] if all(c[0] != n[0] and (c[0] < n[0]) == (sum(c) < sum(n)) and sum(c) != sum(n) for c in held)]
                many = len({kind[s] for s, _ in held})
                if many / len(set(kind.values())) < least:
                    continue
                pairs = {(x[s + k], d[s + shift + k]) for s, shift in held for k in range(w)}
                pairs = {(a, c) for a, c in pairs if named(a) in slot and named(a) == named(c)}
                pairs = {(a.lstrip(" "), c.lstrip(" ")) for a, c in pairs if not any(first(t) and (t.lower() in x or t.lower() in d) for t in (a, c))}
                if len({a for a, _ in pairs}) < len(pairs):
                    continue
                found = (many, -max(sorted(band)[0][1], 0), sum(a != c for a, c in pairs))
                best = max(best or found, found, key=lambda f: f[:2])
            if best:
                out[i, j] = (-best[1], best[0], best[0] / len(set(kind.values())), best[2])
    return out


ITEMS = [(1, "A train leaves Boston at 40 km per hour and Anna rides it for 3 hours before she meets Tom who has 40 apples."), (2, "Short one 5 km"), (3, None), (4, "Word"), (5, "")]


def rows(found):
    return {(r.doc_id, r.item_id): (r.place, r.windows, r.coverage, r.changed) for r in found.collect()}


def test_reparameterised_questions(spark):
    same = ITEMS[0][1]
    moved = same.replace("40", "65").replace("Anna", "Berta").replace("km", "miles")
    broken = same.replace("40 km", "65 km")  # 40 would be both 65 and 40
    docs = [(1, f"some words first {same} and more words"), (2, moved), (3, f"in fact {broken}"), (4, None), (5, ""), (6, "the calm day went by without any question " * 30), (7, "x " * 40 + "short one 7 miles"), (None, same)]
    frame = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in docs], "doc_id long, text string, item_id int, row string, windows int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = rows(contaminated(frame, bench))
    assert got == brute(docs, ITEMS)
    assert set(got) == {(1, 1), (2, 1), (None, 1), (7, 2)} and got[2, 1][3] == 3 and got[1, 1][3] == 0
    assert rows(contaminated(frame, bench, broadcast_windows=0)) == got
    kept = without_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    twice = contaminated(frame.unionByName(frame), bench.unionByName(bench))
    assert rows(twice) == got and twice.count() == len(got)
    for a, b in ((frame.limit(0), bench), (frame, bench.limit(0))):
        assert contaminated(a, b).count() == 0


def test_words_put_in_or_left_out(spark):
    item = "A baker sells twelve clips to each of her friends in April and then she sells half as many clips in May so that all of them have some more"
    words = item.split()
    docs = [(k, " ".join([*words[:k], "exactly", *words[k:]])) for k in range(1, len(words))]
    docs += [(100 + k, " ".join(words[:k] + words[k + 1 :])) for k in range(1, len(words))]
    docs += [(200, item.replace("half", "about page seven of ten half")), (201, "before it " + item.replace("she", "the very old baker") + " and after")]
    far = " ".join([*words[:15], *["other"] * 60, *words[15:]])
    back = " ".join(words[15:] + words[:15])
    frame = spark.createDataFrame([*docs, (300, far), (301, back)], "doc_id long, text string")
    got = rows(contaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert {d for d, _ in got} == {d for d, _ in docs}
    # Parameters must be consistent over both sides of the inserted word.
    item = "A shop has 40 red apples and it sells some of them today because it is open so that 40 minus these are left"
    docs = [(1, item.replace("today", "early today")), (2, item.replace("today", "early today").replace("40", "50")), (3, item.replace("today", "early today").replace("40 red", "50 red"))]
    got = rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert {d: r[3] for (d, _), r in got.items()} == {1: 0, 2: 1}


def test_names_that_begin_sentences(spark):
    items = [(1, "Tom has 5 apples. Tom buys 3 more. Tom eats 2 of them. How many apples are left?"), (2, "Alice walks 3 miles each day. Bob runs 5 miles each day. Carol cycles 9. How far do they go in a week?")]
    docs = [(1, items[0][1].replace("Tom", "Anna").replace("5", "8")), (2, items[1][1].replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Fay"))]
    docs += [(3, items[0][1]), (4, items[0][1].replace("Tom buys", "Anna buys")), (5, "First, " + docs[0][1]), (6, items[1][1].replace("How far", "Say how far").replace("Bob", "Gus"))]
    got = rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {k: (r[2], r[3]) for k, r in got.items() if k[0] in (1, 2, 3)} == {(1, 1): (1.0, 2), (2, 2): (1.0, 2), (3, 1): (1.0, 0)}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (5, 1), (6, 2)}  # in 4 Tom would be both Tom and Anna


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["Anna", "Tom", "has", "3", "4.5", "km", "apples", "and", "more.", "The", "days", "5%"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)) + (rng.choice(items)[1].split() if i % 2 else []))) for i in range(60)]
    got = rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()} and len(want) > 20


def test_short_sentences_and_slots_where_windows_met(spark):
    items = [(1, "Tom has 9 marbles. Tom gives 2 to Ann. How many are left?"), (2, "A farmer keeps 12 hens and each of them lays 3 eggs in every week of the year so that he can sell them and he then has 500 coins")]
    cut = items[1][1].rsplit(" ", 2)[0] + " 900 other things were said by people who were there"
    docs = [(1, items[0][1].replace("Tom", "Bob").replace("Ann", "Sue")), (2, cut), (3, cut.replace("12", "13"))]
    got = rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert set(got) == {(1, 1), (2, 2), (3, 2)} and got == brute(docs, items)


def test_long_numeric_and_repeated_texts(spark):
    items = [(1, " ".join(str(k * 7 % 1000) for k in range(200))), (2, "and 7 " * 200), (3, "a question about 5 km " * 3)]
    docs = [(1, " ".join(str(k * 7 % 1000) for k in range(4000))), (2, "and 5 " * 4000), (3, " ".join(str(k) for k in range(3000))), (4, "of a question about 6 km " * 2000)]
    start = time.perf_counter()
    got = rows(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert time.perf_counter() - start < 60 and {(1, 1), (2, 2)} <= set(got) and not {d for d, _ in got} & {3}


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    likely = [(i, t) for i, t in docs if any(x[20:50] in t for _, x in items)]
    found = queries.op6_decontamination(spark, data)
    assert rows(found) == brute(likely, items) and not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())


def test_capitals_and_an_item_thousands_of_times_in_one_text(spark):
    item = "What is the capital city of the country where the river Loire and the old town of Nantes lie?"
    docs = [(1, f"Read this. {item.upper()} Then answer."), (2, "WHAT IS THE BEST WAY TO COOK RICE FOR TWELVE PEOPLE?"), (5, item.lower()), (3, f"{item} So they ask. " * 4000), (4, "Nothing of The Kind Is Here " * 4000)]
    began = time.time()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 5] and time.time() - began < 60
    assert {r.doc_id: r.place for r in got}[3] <= 16
