from pyspark.sql import functions as F

from segspark.sources import formats as f
from segspark.sources import trees
from segspark.streaming import windows


def lines(spark, text, delimiter="\n"):
    return spark.createDataFrame([(x,) for x in text.split(delimiter)], "value string")


def test_lines(spark):
    got = f.allele_counts(lines(spark, "CHROM\tPOS\n1\t10642\t2\t216\tG:214\tA:2\n1\t5\t3\t9\tA:1\tC:8\n1\t7\t2\t9\tN:1\tC:8")).collect()
    assert [tuple(r) for r in got] == [("1", 10641, 216, "G", 214, "A", 2)]
    assert [tuple(r) for r in f.bed(lines(spark, "# x\nchr22 16050000 16050012\nchr1\t1\t2\tpELS,CTCF-bound")).collect()] == [("chr22", 16050000, 16050012, None), ("chr1", 1, 2, "pELS")]
    header, rows = f.b_map(lines(spark, "#CHROM=chr22\n#X = a=b\n1 5008261\n0 3"))
    assert {tuple(r) for r in header.collect()} == {("CHROM", "chr22"), ("X", "a=b")} and [(r.b, r.len) for r in rows.orderBy("seg_idx").collect()] == [(1, 5008261), (0, 3)]
    score = f.greatest_score(lines(spark, "#c\n1\t10\tA\tC\t0.1\t3.5\n1\t10\tA\tG\t0.1\t9.5\n1\t11\tA\tG\t0.1\t1"))
    assert sorted(tuple(r) for r in score.collect()) == [("1", 9, 9.5), ("1", 10, 1.0)]
    gmap = f.genetic_map(lines(spark, "chrom pos rate gpos\nchr1 100 2.0 5.0"))
    assert [tuple(r) for r in gmap.collect()] == [("chr1", 100, 2.0, 0.05)]


def test_records_spanning_lines(spark, tmp_path):
    (tmp_path / "x.wig").write_text("fixedStep chrom=chr1 start=3 step=1\n0.5\n0.25\nfixedStep chrom=chr2 start=10 step=5\n1\n2\n")
    rows = f.fixed_step(f.read_records(spark, str(tmp_path / "x.wig"), "fixedStep "))
    assert sorted(tuple(r) for r in rows.collect()) == [("chr1", 2, 0.5), ("chr1", 3, 0.25), ("chr2", 9, 1.0), ("chr2", 14, 2.0)]
    (tmp_path / "x.fa").write_text(">a desc\nacgtN\nPPNP\n>b\n\n>c\nG\n")
    seq = f.fasta(f.read_records(spark, str(tmp_path / "x.fa"), ">"), chunk=4)
    assert sorted(tuple(r) for r in seq.collect()) == [("a", 0, "ACGT"), ("a", 4, "NPPN"), ("a", 8, "P"), ("c", 0, "G")]
    assert sorted((r.start, r.end) for r in f.callable_mask(seq, "P", 4).collect()) == [(5, 7), (8, 9)]
    (tmp_path / "x.axt").write_text("0 chr19 11 14 chr11 70 73 - 3500\nAC-GT\nACGTT\n\n1 chr19 21 22 chr1 7 8 + 1\nAA\nA-\n")
    blocks = f.axt(f.read_records(spark, str(tmp_path / "x.axt"), "\n\n"))
    assert sorted((r.start, r.seq1, r.seq2) for r in blocks.collect()) == [(10, "ACGT", "ACTT"), (20, "AA", "A-")]
    assert sorted((r.pos, r.code) for r in f.aligned_codes(blocks).collect()) == [(10, 1), (11, 1), (12, 2), (13, 1), (20, 1), (21, 0)]
    (tmp_path / "x.maf").write_text("a score=1\ns hg19.chr1 5 3 + 100 ACG\ns panTro.chr1 6 3 + 99 AC-\n\na score=2\ns hg19.chr1 9 1 + 100 T\n")
    maf = f.maf(f.read_records(spark, str(tmp_path / "x.maf"), "\n\n"))
    assert sorted((r.src, r.start, r.text) for r in maf.collect()) == [("hg19.chr1", 5, "ACG"), ("hg19.chr1", 9, "T"), ("panTro.chr1", 6, "AC-")]
    assert f.whole_columns(maf).count() == 3 and f.maf(f.read_records(spark, str(tmp_path / "x.maf"), "\n\n"), ["panTro"]).count() == 1


def test_variants(spark):
    text = "##x\n#CHROM\nchr1\t5\trs1\tA\tC\t.\tPASS\tDP=12;DB\tGT:DP\t0|1:3\t1|1:4\t.|.:0\nchr1\t5\trs2\tA\tG\t.\tPASS\tDP=6\tGT\t0/0\t0/1\t0/0\nchr1\t8\t.\tA\tT\t.\t.\tDP=6\tGT\t0/0\t0/0\t0/0"
    v = f.vcf(lines(spark, text))
    r = v.where("id = 'rs1'").first()
    assert r.info == {"DP": "12", "DB": ""} and r.samples[1] == {"GT": "1|1", "DP": "4"} and r.pos == 4
    counts = f.genotype_counts(v)
    assert sorted((r.alt, r.n, r.alt_count) for r in counts.collect()) == [("C", 4, 3), ("G", 6, 1), ("T", 6, 0)]
    assert [(r.pos, r.alt) for r in f.polymorphic_once(counts).collect()] == [(4, "C")]
    assert f.mean_depth(v, spark.createDataFrame([("chr1", 4)], "chrom string, pos long")).first().depth == 3.0
    people = spark.createDataFrame([(f"s{k}", "YRI" if k % 2 else "CEU") for k in range(20)], "sample_id string, pop string")
    assert f.members(people, "YRI").count() == 10 and f.members(people, "YRI", 4).count() == 4


def test_genes(spark):
    line = "g1\tchr1\t-\t100\t400\t150\t320\t3\t100,200,300,\t160,250,400,"
    genes = f.known_genes(lines(spark, line))
    part = lambda p: [(r.start, r.end) for r in f.parts_of(genes, p).collect()]
    assert part("cds") == [(150, 160), (200, 250), (300, 320)] and part("introns") == [(160, 200), (250, 300)]
    assert part("utr3") == [(100, 150)] and part("utr5") == [(320, 400)] and part("splice")[0] == (160, 162)
    assert f.longest_transcripts(genes, "chrom").first()["size"] == 80


def test_all_parts_equal_those_of_each_kind_and_read_lines_once(spark):
    odd = ["g2\tchr1\t+\t0\t90\t30\t30\t3\t0,30,60,\t20,50,90,", "g3\tchr2\t-\t5\t9\t0\t99\t1\t5,\t9,", "g4\tchr2\t+\t5\t9\t6\t8\t2\t5,7\t7,7", "g5\tc\t+\t1\t2\t1\t2\t0\t\t"]
    text = lines(spark, "g1\tchr1\t-\t100\t400\t150\t320\t3\t100,200,300,\t160,250,400,\n" + "\n".join(odd))
    genes, got = f.known_genes(text), f.all_parts(lines(spark, "# a comment\n \n").union(text))
    kinds = ("exons", "cds", "introns", "utr5", "utr3", "splice")
    want = [(*r[:3], p, *r[3:]) for p in kinds for r in map(tuple, f.parts_of(genes, p).collect())]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
    assert "Union" not in f.all_parts(text)._jdf.queryExecution().optimizedPlan().toString()


def test_maps(spark):
    rows = spark.createDataFrame([("c", 1.0, 0, 10), ("c", 2.0, 10, 30), ("c", 3.0, 20, 25), ("c", 4.0, 30, 40)], "chrom string, gpos double, start long, end long")
    assert [r.end for r in f.without_nested(rows).orderBy("gpos").collect()] == [10, 30, 40]
    knots = spark.createDataFrame([("c", p, float(p)) for p in (0, 4, 9, 10, 19, 25)], "chrom string, pos long, gpos double")
    assert sorted(r.pos for r in f.thinned(knots, 10).collect()) == [0, 10, 25]


def test_trees_and_config(spark, tmp_path):
    got = trees.branches("((a:1,b:2)ab:0.5,(c:3,d:4):0.25);")
    assert got == {"a": 1, "b": 2, "ab": 0.5, "c": 3, "d": 4, "c-d": 0.25, "a-b-c-d": 0.0}
    assert trees.group_length(trees.tree(spark, "(a:1,b:2);"), "b").first().length == 2
    found = trees.matrices("Branch 'hg'\n A C\nA 5 1\nC 2 6\nBranch 'pt'\n A C\nA 1 0\nC 0 1\n")
    assert ("hg", "C", "A", 2.0) in found and len(found) == 8
    config = trees.RunConfig(b_annotations=("x", "y", "z"), c_annotations=("u",), coefficients=(1.0, 2.0))
    config.save(tmp_path / "c.json")
    assert trees.RunConfig.load(tmp_path / "c.json") == config and config.parameters() == 9


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for k, make in enumerate((lambda d: windows.tumbling(d, "6 hours", ["event_type"], "value"), lambda d: windows.sessions(d, "6 hours", ["user_id"]))):
        query = make(stream).writeStream.format("memory").queryName(f"out{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"ck{k}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        whole = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
        assert whole(spark.table(f"out{k}")) == whole(make(rows))
    query = windows.changed_enough(stream, "user_id", 0.5).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = 0
    for _, own in rows.toPandas().sort_values(["user_id", "ts"]).groupby("user_id"):
        last = None
        for x in own["value"]:
            if last is None or abs(x - last) > 0.5 * abs(last):
                want, last = want + 1, x
    assert spark.table("kept").count() == want
