import gzip

import pytest
from pyspark.sql import functions as F

from seqtally.functions import names
from seqtally.operators import rollups
from seqtally.operators.annotation import select_tissues
from seqtally.sources import annotation, fasta, features, hits, sinks
from seqtally.streaming import ingest


def put(path, text):
    path.write_text(text)
    return str(path)


ROW = "q1\ts1\t90.5\t40\t1\t0\t1\t40\t{a}\t{b}\t1e-5\t50.2\t100\t200\tACGT\tACGA"


def test_hits_of_every_width(spark, tmp_path):
    full = put(tmp_path / "h17.tsv", ROW.format(a=1, b=40) + "\tminus\n")
    r = hits.read_hits(spark, full).collect()[0]
    assert r["strand"] == "minus" and r["slen"] == 200  # given strand is kept
    no = put(tmp_path / "h16.tsv", ROW.format(a=40, b=40) + "\n" + ROW.format(a=1, b=40) + "\n")
    assert [x["strand"] for x in hits.read_hits(spark, no).collect()] == ["minus", "plus"]
    assert hits.read_hits(spark, no, min_length=41).count() == 0
    short = put(tmp_path / "h12.tsv", "\t".join(ROW.format(a=1, b=2).split("\t")[:12]) + "\n")
    assert hits.read_hits(spark, short).collect()[0]["qlen"] is None
    missing = hits.read_hits(spark, str(tmp_path / "none.tsv"))
    assert missing.count() == 0 and len(missing.columns) == 17
    assert hits.read_hits(spark, put(tmp_path / "empty.tsv", "")).count() == 0


def test_fasta_headers(spark, tmp_path):
    p = put(tmp_path / "x.fa", ">FBtr1 type=a>b; length=7; parent=FBgn9,FBtr1;\nACGT\nACG\n>pp-PA parent=FBgn8,FBtr2; length=3;\nAAA\n>plain\nTT")
    rows = {r["seq_id"]: r for r in fasta.read_fasta_attrs(spark, p).collect()}
    assert rows["FBtr1"]["seq"] == "ACGTACG" and rows["FBtr1"]["length"] == 7 and rows["FBtr1"]["fbgn"] == "FBgn9"
    assert rows["pp-PA"]["fbtr"] == "FBtr2" and rows["plain"]["parent"] is None and rows["plain"]["seq"] == "TT"


def test_fasta_round_trip_wraps_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 50), ("b", "A" * 80)], "seq_id string, seq string")
    sinks.write_fasta(df, str(tmp_path / "fa"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "fa")).collect()]
    assert max(map(len, lines)) == 80
    assert {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "fa")).select("seq_id", "seq").collect()} == {tuple(r) for r in df.collect()}


def test_gff_with_several_parents(spark, tmp_path):
    p = put(tmp_path / "x.gff", "##gff\n2L\ts\tCDS\t1\t9\t.\t+\t.\tID=a;Parent=t1,t2\n2L\ts\tgene\t1\t9\t.\t+\t.\tID=g\n")
    assert [r["parent"] for r in features.read_gff(spark, p, "CDS").orderBy("parent").collect()] == ["t1", "t2"]
    assert features.read_gff(spark, p, "CDS", explode_parent=False, chr_prefix=True).collect()[0]["chrom"] == "chr2L"


def test_alignment_blocks(spark, tmp_path):
    maf = "##maf\na score=1\ns dm6.chr2L 10 5 + 99 ACGTA\ns droSim1.c 1 5 + 9 ACGTA\ns droSim1.d 3 5 + 9 ACGTA\ns other.c 1 5 + 9 A\n\na score=2\ns droYak3.c 1 5 + 9 A\n\na score=3\ns dm6.chrX 0 2 + 99 AC\ns droYak2.q 4 2 + 9 AC\n"
    got = sorted(tuple(r) for r in features.read_maf_blocks(spark, put(tmp_path / "x.maf", maf)).collect())
    assert got == [("chr2L", 10, 15, "droSim1"), ("chrX", 0, 2, "droYak2")]


def test_last_line_wins_in_maps(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "#c\nFBgn1\told\nFBgn2\tb\nFBgn1\tnew\n")
    assert {tuple(r) for r in annotation.read_symbol_map(spark, p).collect()} == {("FBgn1", "new"), ("FBgn2", "b")}
    a = put(tmp_path / "a.tsv", "## x\nAbc\tDmel\tFBgn1\t-\tCG1\tCG7,CG8\nabc\tDmel\tFBgn2\t-\tCG2\nzzz\tDsim\tFBgn3\t-\tCG3\n")
    m = {r["alias"]: r["fbgn"] for r in annotation.read_alias_map(spark, a).collect()}
    assert m["Abc"] == "FBgn1" and m["abc"] == "FBgn2" and m["ABC"] == "FBgn2" and m["CG8"] == "FBgn1" and "zzz" not in m


def test_expression_files(spark, tmp_path):
    p = put(tmp_path / "e.tsv", "# c\nRelease_ID\tFBgn#\tRNASource_name\tRPKM_value\nr\tFBgn1\tBCM_1_E2-4hr_(FBlc0000061)\t3\nr\tFBgn1\tBCM_1_E2-4hr_(FBlc0000061)\tx\n")
    assert [tuple(r) for r in annotation.read_expression_long(spark, p).collect()] == [("FBgn1", "embryo_2_4hr", 0.0)]
    m = put(tmp_path / "m.tsv", "## c\n#gene_primary_id\tgene_symbol\tgene_fullname\tgene_type\tmE_mRNA_A_MateF_4d_ovary_(FBlc1)\nFBgn1\ts\tf\tt\t2.5\n")
    assert annotation.read_expression_matrix(spark, m).collect()[0]["rpkm"] == 2.5


def test_groups_in_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write("FB_group_id\ta\tb\tc\td\te\tf\nFBgg1\tSYM\tName\t\t\tFBgn1\tx\n")
    got = {tuple(r) for r in annotation.read_gene_groups(spark, str(tmp_path / "g.tsv.gz"), by_name=True).collect()}
    assert got == {("SYM", "FBgn1"), ("Name", "FBgn1")}


def test_set_folder_names(spark, tmp_path):
    put(tmp_path / "go_x_fbgn_ids.txt", "FBgn1\n# c\n\nsym\tFBgn2\n")
    put(tmp_path / "notes.txt", "FBgn9\n")
    got = {tuple(r) for r in annotation.read_gene_sets(spark, str(tmp_path)).collect()}
    assert got == {("go_x", "FBgn1"), ("go_x", "FBgn2")}


def test_name_rules(spark):
    words = ["gypsy1", "Doc3", "hobo", "INE-1", "1360", "mdg1 jockey", "SINE2", "xLTRx"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    got = [r[0] for r in df.select(names.family_class(F.col("n"))).collect()]
    assert got == ["LTR", "LINE", "DNA", "SINE", "Unknown", "LTR", "SINE", "LTR"]
    labels = spark.createDataFrame([("expr_cns_high",), ("go_dna_repair",), ("flyfish_any",)], "n string")
    assert [r[0] for r in labels.select(names.set_label(F.col("n"))).collect()] == ["Cns (High Expr)", "Go: Dna Repair", "Flyfish: Any"]
    raw = "mE_mRNA_A_MateF_4d_ovary_(FBlc0000208)"
    assert spark.createDataFrame([(raw,)], "n string").select(names.clean_tissue(F.col("n"))).collect()[0][0] == "a_mated_female_4d_ovary"


def test_tissue_choice_fills_up():
    pairs = dict(select_tissues(["adult_head", "ovary_1", "ovary_2", "zzz"]))
    assert pairs == {"ovary_1": "ovary_rpkm", "adult_head": "head_rpkm", "ovary_2": "ovary_2_rpkm", "zzz": "zzz_rpkm"}


def test_streamed_tallies_equal_batch(spark, tmp_path):
    rows = [("q", f"s{i % 3}", 90.0, 10, 0, 0, 1, 10, 1 + i % 2 * 50, 20, 1e-3, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double")
    df.repartition(5).write.csv(str(tmp_path / "in"), sep="\t")
    for _ in range(2):  # a second run finds nothing new and keeps the result
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = ingest.tally_report(ingest.latest(spark, str(tmp_path / "out")))
    want = rollups.strand_bias_by_subject(df)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_tables_write_flags_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(True, ["a", "b"], 1.23456)], "f boolean, l array<string>, d double")
    sinks.write_tsv(df, str(tmp_path / "t"), digits=2)
    assert tuple(spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()[0]) == ("yes", "a,b", "1.23")


def test_bias_labels_reach_strong_antisense(spark):
    from seqtally.operators.enrichment import rank_gene_sets

    sets = spark.createDataFrame([("s", "g1")], "set_name string, fbgn string")
    dens = spark.createDataFrame([("g1", 3.0), ("g2", 9.0)], "fbgn string, density_bp_kb double")
    bias = spark.createDataFrame([("g1", 20.0)], "fbgn string, sense_pct double")
    r = rank_gene_sets(sets, dens, bias).collect()[0]
    assert (r["bias"], r["mean_rank"], r["mean_percentile"]) == ("strong_antisense", 2.0, 50.0)


@pytest.mark.parametrize("compat,want", [(True, (10, 29)), (False, (72, 91))])
def test_repeat_positions_follow_the_strand(spark, compat, want):
    from seqtally.operators.loci import repeats_on_transcripts

    rep = spark.createDataFrame([(1, "c", 110, 129, "n", "k", 0.1)], "repeat_id int, chrom string, r_start int, r_end int, repeat_name string, repeat_class string, divergence double")
    tx = spark.createDataFrame([("t", "c", 100, 200, "-")], "fbtr string, chrom string, g_start int, g_end int, t_strand string")
    r = repeats_on_transcripts(rep, tx, compat=compat).collect()[0]
    assert (r["rep_start"], r["rep_end"]) == want
