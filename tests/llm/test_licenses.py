import random
import time

from segspark.llm import queries
from segspark.llm.licenses import _WORD, TEMPLATES, Index, aligned, matches, scan, winnowed

DATA = "/root/testdata/sf0.001"


def test_winnowing_guarantee():
    rng = random.Random(5)
    for _ in range(200):
        shared = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(4)]  # gram + window - 1
        texts = [[str(rng.random()) for _ in range(rng.randint(0, 9))] + shared + [str(rng.random()) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        (_, a), (_, b) = (winnowed(t, 3, 2) for t in texts)
        assert set(a.tolist()) & set(b.tolist())


def brute_score(template, words):
    """Smith-Waterman over the whole table."""
    best, above = 0, [0] * (len(words) + 1)
    for t in template:
        row = [0]
        for j, w in enumerate(words):
            row.append(max(0, above[j] + (2 if w == t else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(2)
    for _ in range(150):
        template = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(3, 25))]
        copy = [w for w in template if rng.random() > 0.1 for w in ([w, "new"] if rng.random() < 0.1 else [w])]
        words = ["q"] * rng.randint(0, 6) + copy + ["r"] * 3
        n, a, b = aligned(template, words, -40, 60)
        want = brute_score(template, words)
        assert 2 * len(n) >= want and (not n) == (want == 0) and 0 <= a <= b <= len(words)
        assert n == sorted(set(n)) and all(0 <= k < len(template) for k in n)


def plain(name):
    return TEMPLATES[name].replace("{", "").replace("}", "")


def test_whole_changed_and_missing_licenses(spark):
    rng = random.Random(9)
    mit = plain("MIT")
    words = mit.split()
    changed = " ".join("thing" if rng.random() < 0.08 else w for w in words)
    half = " ".join(words[: len(words) // 2])
    parted = " ".join([*words[:80], *(f"page{k} header" for k in range(12)), *words[80:]])
    rows = [(1, f"Code. {mit} End."), (2, f"x\n{changed}\ny"), (3, half), (4, None), (5, ""), (6, "a calm day " * 50), (None, "İ Released under the MIT License."), (7, "Licensed under CC BY-NC 4.0. Then. Licensed under CC BY-NC 4.0."), (8, parted), (9, plain("BSD-2-Clause")), (10, plain("BSD-3-Clause"))]
    docs = spark.createDataFrame([(i, t, "z", 1.0) for i, t in rows], "doc_id long, text string, license string, coverage double")
    got = scan(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "MIT"), (None, "MIT"), (7, "CC-BY-NC-4.0"), (8, "MIT"), (9, "BSD-2-Clause"), (10, "BSD-3-Clause")}
    whole = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][whole.start : whole.end] == mit[:-1] and whole.coverage == 1
    assert len([r for r in got if r.license == "CC-BY-NC-4.0"]) == 2 and len([r for r in got if r.doc_id == 8]) == 1
    assert scan(docs.limit(0)).count() == 0 and scan(docs, templates={}).count() == 0
    assert {r.doc_id for r in scan(docs.unionByName(docs)).collect()} == {r.doc_id for r in got}


def test_words_that_decide():
    index = Index(TEMPLATES, 3, 2)

    def found(text):
        return {m[0] for m in matches(text, index, 0.8, 8)}

    for name in TEMPLATES:
        assert found("Before. " + plain(name) + " After.") == {name.split(" [")[0]}, name
    right = {
        "This project is licensed under the BSD License.": "BSD", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY 4.1.": "unknown",
        "This work is licensed under the GNU General Public License, version 1.": "GPL-1.0", "This project is not licensed under the MIT License.": "unknown", "It was never released under the MIT License.": "unknown",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 5.0 International License.": "unknown", "This project is licensed under the MIT License.": "MIT",
        plain("GPL-3.0-or-later").replace("version 3", "version 4"): "unknown", plain("BSD-3-Clause").replace("endorse", "praise"): "BSD-2-Clause",
    }
    assert {t: found(t) for t in right} == {t: {k} for t, k in right.items()}


def test_names_versions_and_negations():
    index = Index(TEMPLATES, 3, 2)
    right = {  # texts and (license, what is marked); each beside its near miss
        "dual licensed under the MIT License or the Apache License, Version 2.0.": [("MIT", "licensed under the MIT License"), ("Apache-2.0", "Apache License, Version 2.0")],
        "SPDX-License-Identifier: MIT OR Apache-2.0": [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0")], "SPDX-License-Identifier: MIT": [("MIT", "MIT")], "MIT License": [("MIT", "MIT License")],
        "BSD 4-Clause License": [("BSD-4-Clause", "BSD 4-Clause License")], "the 2-clause BSD license": [("BSD-2-Clause", "2-clause BSD license")], "BSD 5-Clause License": [("unknown", "BSD 5-Clause License")],
        "GNU General Public License v3.0": [("GPL-3.0", "GNU General Public License v3.0")], "the GPL, version 2. 0 errors": [("GPL-2.0", "GPL, version 2")], "Released under the GPL-3.0 license.": [("GPL-3.0", "GPL-3.0 license")],
        "licensed under the GNU General Public License, version 3 or later": [("GPL-3.0-or-later", "licensed under the GNU General Public License, version 3 or later")], "GPLv2+": [("GPL-2.0-or-later", "GPLv2")], "GPLv2": [("GPL-2.0", "GPLv2")],
        "lgplv2.1 only": [("LGPL-2.1-only", "lgplv2.1 only")], "GPL-2.0 with Classpath exception": [("unknown", "GPL-2.0 with Classpath exception")], "Apache License, Version 1.1": [("Apache-1.1", "Apache License, Version 1.1")], "Apache License, Version 7.1": [("unknown", "Apache License, Version 7.1")],
        "We do not use any code that is licensed under the MIT License": [("unknown", "licensed under the MIT License")], "We do not know. It is licensed under the MIT License": [("MIT", "licensed under the MIT License")], "not only licensed under the MIT License": [("MIT", "licensed under the MIT License")],
        "This comes with no warranty of a kind and is released under the MIT License": [("MIT", "released under the MIT License")], "They went to MIT, used Apache Spark and a zlib stream.": [], "": [],
    }
    for text, want in right.items():
        assert [(m[0], text[m[3] : m[4]]) for m in matches(text, index, 0.8, 8)] == want, text
    four = plain("BSD-4-Clause")
    assert [m[0] for m in matches(four, index, 0.8, 8)] == ["BSD-4-Clause"] and [m[0] for m in matches(plain("BSD-3-Clause"), index, 0.8, 8)] == ["BSD-3-Clause"]
    both = f"{plain('MIT')}\n\n{plain('ISC')}\n{plain('Zlib')}"
    assert [m[0] for m in matches(both, index, 0.8, 8)] == ["MIT", "ISC", "Zlib"]


def test_long_texts_of_licenses_and_names():
    index = Index(TEMPLATES, 3, 2)
    start = time.perf_counter()
    assert len(matches((plain("MIT") + "\n") * 300, index, 0.8, 8)) == 300
    assert len(matches("not MIT License or GPL version " * 20_000, index, 0.8, 8)) == 40_000 and time.perf_counter() - start < 20


def test_repeated_lines_take_linear_time():
    index = Index(TEMPLATES, 3, 2)
    start = time.perf_counter()
    assert len(matches("Released under the MIT License. " * 16_000, index, 0.8, 8)) == 16_000 and time.perf_counter() - start < 20


def test_query_equals_brute_force(spark):
    """Both ways: templates that stand word for word in a text, and the score of the others by the whole table."""
    docs = {d.doc_id: _WORD.findall(d.text.lower()) for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op5_license_scan(spark, DATA).collect()
    words = {k: _WORD.findall(plain(k).lower()) for k in TEMPLATES}
    want = {(i, k.split(" [")[0]) for i, d in docs.items() for k, t in words.items() if f" {' '.join(t)} " in f" {' '.join(d)} "}
    assert want and {(r.doc_id, r.license) for r in rows if r.coverage == 1 and r.license != "unknown"} == want
    for r in rows:
        assert max(brute_score(words[k], docs[r.doc_id]) / 2 / len(words[k]) for k in words if k.split(" [")[0] == r.nearest) >= 0.6
    index, loose = Index(TEMPLATES, 3, 2), {(r.doc_id, r.nearest) for r in rows}
    for i, d in docs.items():  # a score of 95 % of a template can't be missed
        for k, t in words.items():
            if len(set(t) & set(d)) >= 0.95 * len(set(t)) and brute_score(t, d) >= 1.9 * len(t):
                assert any(n == k.split(" [")[0] for j, n in loose if j == i) or matches(" ".join(d), index, 0.8, 8), (i, k)
