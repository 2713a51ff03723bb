from segspark.sources import alignments, formats

SPECIES = ["hs", "pt", "mm"]


def places(spark):
    records = [
        "a score=1\ns hs.chr1 10 5 + 99 ac-gTA\ns pt.chr7 3 6 - 99 acCg-N",  # no mm; a gap in the reference
        "a score=1\ns pt.chr7 3 2 + 99 AC\ns mm.chr2 3 2 + 99 AC",  # without the reference
        "a score=2\ns hs.chr1 40 2 + 99 GG\ns mm.chr2 8 2 + 99 GT\ns mm.chr3 1 2 + 99 TT\ns xx.chr1 1 2 + 9 CC",  # a species twice, another one
    ]
    rows = spark.createDataFrame([(r,) for r in records] + [("",), (None,)], "value string")
    return alignments.reference_places(formats.maf(rows), SPECIES)


def test_places_of_the_reference(spark):
    got = sorted((r.chrom, r.pos, "".join(r.letters)) for r in places(spark).collect())
    assert got == [("chr1", 10, "AAN"), ("chr1", 11, "CCN"), ("chr1", 12, "GGN"), ("chr1", 13, "T-N"), ("chr1", 14, "ANN"), ("chr1", 40, "GNG"), ("chr1", 41, "GNT")]
    assert alignments.reference_places(formats.maf(spark.createDataFrame([], "value string")), SPECIES).count() == 0


def test_classes_substitutions_and_pieces(spark):
    classes = spark.createDataFrame([("chr1", 11, 14, "x"), ("chr1", 40, 42, "x"), ("chr1", 60, 70, "y"), ("chr2", 0, 99, "z")], "chrom string, start long, end long, label string")
    inside = alignments.in_class(places(spark), classes)
    got = {(r.label, r.species): (r.same, r.different, r.missing) for r in alignments.substitutions(inside, SPECIES).collect()}
    assert got == {("x", "pt"): (2, 0, 3), ("x", "mm"): (1, 1, 3)}
    pieces = {(r.label, r.species, r.piece): (r.columns, r.sequence) for r in alignments.sub_alignments(inside, SPECIES, piece=20).collect()}
    assert pieces == {("x", "hs", 0): (3, "CGT"), ("x", "pt", 0): (3, "CG-"), ("x", "mm", 0): (3, "NNN"), ("x", "hs", 2): (2, "GG"), ("x", "pt", 2): (2, "NN"), ("x", "mm", 2): (2, "GT")}


def test_quality_counts_what_no_block_covers(spark):
    features = spark.createDataFrame([("chr1", 10, 12), ("chr1", 41, 43)], "chrom string, start long, end long")
    got = {r.species: (r.bases, r.missing, r.ok) for r in alignments.quality(places(spark), SPECIES, features, 0.5).collect()}
    assert got == {"hs": (4, 1, True), "pt": (4, 2, False), "mm": (4, 3, False)}
    assert {(r.bases, r.ok) for r in alignments.quality(places(spark), SPECIES, features.limit(0), 0.5).collect()} == {(0, False)}


def test_score_slice(spark):
    scores = spark.createDataFrame([("c", p, float(s)) for p, s in enumerate([1, 2, 2, 9, 3, 3, 4, 8])], "chrom string, pos long, score double")
    assert sorted((r.start, r.end) for r in alignments.score_slice(scores, 0.2, 0.7).collect()) == [(1, 3), (4, 7)]
    assert alignments.score_slice(scores.limit(0), 0.2, 0.7).count() == 0
