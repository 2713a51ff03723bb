import random

from segspark.functions import genetics as g
from segspark.operators.coding import coding_changes
from segspark.operators.maps import sweep_map, thinned_grid

CODE = {a + b + c: g.AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
PAIR = dict(zip("ACGTN-", "TGCAN-"))


def by_hand(exons, bases):
    found, seen = {}, set()
    for gene, tr in sorted({(x[0], x[1]) for x in exons}):
        own = [x for x in exons if x[:2] == (gene, tr)]
        back = own[0][2] == "-"
        places = sorted({p for x in own for p in range(x[4], x[5])}, reverse=back)
        letters = [tuple(PAIR.get(c, "N") if back else c for c in bases.get((own[0][3], p), "NN")) for p in places]
        for k in range(0, len(places) - 2, 3):
            q, t = ("".join(x[j] for x in letters[k : k + 3]).upper() for j in (0, 1))
            if q not in CODE or t not in CODE:
                continue
            for j in range(3):
                if (gene, places[k + j]) in seen:
                    continue
                seen.add((gene, places[k + j]))
                x = found.setdefault(gene, [0, 0, 0, 0])
                x[0] += 1
                x[1] += sum(CODE[q[:j] + b + q[j + 1 :]] == CODE[q] for b in "ACGT" if b != q[j])
                if q[j] != t[j]:
                    x[2 + (CODE[q[:j] + t[j] + q[j + 1 :]] != CODE[q])] += 1
    return found


def test_coding_changes_equal_brute_force(spark):
    rng = random.Random(4)
    bases = {(c, p): (rng.choice("ACGTacgt"), rng.choice("ACGT")) for c in (1, 2) for p in range(400) if rng.random() < 0.97}
    bases |= {(1, p): ("-", "A") for p in range(60, 63)} | {(2, 7): ("A", "N")}
    bases = {k: (q.upper(), t if rng.random() < 0.4 else q.upper()) for k, (q, t) in bases.items()}
    exons = []
    for gene in range(12):
        chrom, strand = 1 + gene % 2, "+-"[gene // 2 % 2]
        for tr in range(3):
            exons += [(gene, tr, strand, chrom, s, s + rng.randint(0, 25)) for s in rng.sample(range(370), 4)]
    exons.append((99, 0, "+", 3, 5, 50))
    a = spark.createDataFrame(exons, "gene int, transcript int, strand string, chrom int, start long, end long")
    b = spark.createDataFrame([(*k, *x) for k, x in bases.items()] + [(1, 8, None, "A")] * (not (1, 8) in bases), "chrom int, pos long, q string, t string")
    got = {r.gene: [r.sites, r.degeneracy, r.syn, r.nonsyn] for r in coding_changes(a, b).collect()}
    assert got == by_hand(exons, bases) and sum(x[2] for x in got.values()) > 10 and sum(x[3] for x in got.values()) > 10
    one = coding_changes(a, b).where("syn > 0").first()
    assert one.ds == one.syn / one.degeneracy and one.dn == one.nonsyn / (3 * one.sites - one.degeneracy) and abs(one.dnds - one.dn / one.ds) < 1e-12
    assert coding_changes(a.limit(0), b).count() == 0 and coding_changes(a, b.limit(0)).count() == 0


def test_thinned_grid_and_sweeps(spark):
    rng = random.Random(8)
    sites = [("a", k, rng.random() ** 3) for k in range(500)] + [("a", 900 + k, 0.25) for k in range(3)] + [("b", 1, 0.5)]
    df = spark.createDataFrame([*sites, ("a", 1, None)], "chrom string, pos long, gpos double")
    got = sorted(r.gpos for r in thinned_grid(df, 0.01, width=0.05).where("chrom = 'a'").collect())
    all_ = sorted({x[2] for x in sites if x[0] == "a"})
    cell = [int((x - all_[0]) // 0.01) for x in all_]
    keep = [x for k, x in enumerate(all_) if k in (0, len(all_) - 1) or cell[k - 1] != cell[k] or cell[k + 1] != cell[k]]
    assert got == keep and len(keep) < len(all_) / 2
    rates = sweep_map(df, df.where("pos % 50 = 0"), 0.05, 1e4, by=["chrom"]).collect()
    assert {r.chrom for r in rates} == {"a", "b"} and all(r.rate >= 0 for r in rates)


def test_rates_are_rounded_as_in_sql(spark, monkeypatch):
    """Ratios a hair below a half of the last digit print as that half."""
    import duckdb

    from segspark.plans import sampled

    ratios = [(54, 34, 10, 19), (55, 37, 5, 9), (39, 37, 8, 9), (54, 32, 4, 7)]
    rows = [(k, n, d, s, x, s / d, x / (3 * n - d), (x / (3 * n - d)) / (s / d)) for k, (n, d, s, x) in enumerate(ratios)]
    found = spark.createDataFrame(rows, "gene long, sites long, degeneracy long, syn long, nonsyn long, ds double, dn double, dnds double")
    monkeypatch.setattr(sampled.coding, "coding_changes", lambda *_: found)
    got = {r.gene: (r.ds, r.dn, r.dnds) for r in sampled.coding_changes(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r[0]: duckdb.execute("select round(?::double, 6), round(?::double, 6), round(?::double, 6)", r[5:]).fetchone() for r in rows}
    assert got[0][2] == 0.504687
