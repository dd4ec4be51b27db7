"""Readers and writers: tables are saved in each text format by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import rollups
from ..session import scratch_path
from ..sources import annotation as ann
from ..sources import fasta, features, sinks
from ..sources import hits as src
from ..streaming import ingest as streaming
from .hit_queries import BYS, DENSITY, K, KEYS, by_query
from .registry import query
from .shape import shown
from .views import Tables

TAB = "\t"


def save_lines(df: DataFrame, line: Column, label: str, header: str | None = None) -> str:
    """Write one text line per row to a fresh folder, and a header line as a file beside it."""
    path = scratch_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    if header is not None:
        head = df.sparkSession.range(1).select(F.lit(header).alias("value"))
        head.write.mode("append").text(path)
    return path


HIT12 = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
HIT14 = [*HIT12, "qlen", "slen"]
STRAND = "case when sstart < send then 'plus' else 'minus' end"
ROUNDED = "round(evalue, 9) as evalue, round(bitscore, 6) as bitscore"
HIT12_SQL = ", ".join(c for c in HIT12[:10])


def _hit_file(t: Tables, cols: list[str]) -> str:
    path = scratch_path(t.spark, "hits")
    t.hits.select(*cols).write.csv(path, sep=TAB)
    return path


# hits ----------------------------------------------------------------------------------


@query(
    "read_hits_12_columns",
    f"select {HIT12_SQL}, {ROUNDED}, {STRAND} as strand, cast(null as int) as qlen from hits where length >= 40 and pident >= 70 and evalue <= 0.05",
)
def _(t: Tables):
    out = src.read_hits(t.spark, _hit_file(t, HIT12), min_length=40, min_pident=70, max_evalue=0.05)
    return out.select(*HIT12[:10], F.round("evalue", 9).alias("evalue"), F.round("bitscore", 6).alias("bitscore"), "strand", "qlen")


@query("read_hits_14_columns", f"select {HIT12_SQL}, {ROUNDED}, qlen, slen, {STRAND} as strand from hits")
def _(t: Tables):
    out = src.read_hits(t.spark, _hit_file(t, HIT14))
    return out.select(*HIT12[:10], F.round("evalue", 9).alias("evalue"), F.round("bitscore", 6).alias("bitscore"), "qlen", "slen", "strand")


@query(
    "parsed_hit_lines",
    f"select {K}, pident, case when l_linenumber = 3 then 0 else length end as length, qstart, send, {STRAND} as strand from hits",
)
def _(t: Tables):
    blank = F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.col("length").cast("string"))
    cols = [F.col(c).cast("string") for c in HIT14]
    cols[3] = blank
    lines = t.hits.select(*KEYS, F.concat_ws(TAB, *cols).alias("line"))
    parsed = src.parse_hit_line(F.col("line"))
    return lines.select(*KEYS, *[parsed[c].alias(c) for c in ("pident", "length", "qstart", "send", "strand")])


@query(
    "read_bed_hits",
    "select chrom, bed_start as start, bed_end as \"end\", category, qseqid as transcript, sseqid as subject, pident, length, t_strand as strand from genomic_hits",
)
def _(t: Tables):
    from ..functions.coords import pack_hit_name

    named = t.genomic_hits.withColumn(
        "name",
        pack_hit_name(F.col("category"), F.col("l_orderkey"), F.col("qseqid"), F.col("sseqid"), F.col("pident"), F.col("length")),
    )
    path = scratch_path(t.spark, "bed")
    sinks.write_bed(named, path)
    out = src.read_bed_hits(t.spark, path)
    return out.select("chrom", "start", "end", "category", "transcript", "subject", "pident", "length", "strand")


@query(
    "read_bed_hits_sampled",
    """select chrom, bed_start as start, qseqid as transcript, sseqid as subject from (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as r from genomic_hits) x
    where (r - 1) % 7 = 0""",
)
def _(t: Tables):
    from ..functions.coords import pack_hit_name

    named = t.genomic_hits.withColumn(
        "name",
        pack_hit_name(F.col("category"), F.col("l_orderkey"), F.col("qseqid"), F.col("sseqid"), F.col("pident"), F.col("length")),
    )
    path = scratch_path(t.spark, "bed")
    # part files are written in key order, so their names and lines follow it
    sinks.write_bed(named.orderBy(*KEYS), path)
    return src.read_bed_hits(t.spark, path, every=7).select("chrom", "start", "transcript", "subject")


@query(
    "read_conservation",
    "select qseqid as transcript, sseqid as subject, pident, length, score as mean0, score * 2 as score from hits",
)
def _(t: Tables):
    name = F.concat_ws("|", F.concat_ws("_", "category", "l_orderkey"), "qseqid", "sseqid", "pident", "length")
    path = save_lines(
        t.hits, F.concat_ws(TAB, name, "length", "length", F.lit("1.5"), F.col("score").cast("string"), (F.col("score") * 2).cast("string")), "cons"
    )
    return src.read_conservation(t.spark, path).select("transcript", "subject", "pident", "length", "mean0", "score")


COVS = ["sim_coverage", "yak_coverage", "ere_coverage", "sec_coverage"]


@query(
    "read_synteny",
    f"select transcript, te_id as subject, chrom, start_pos as start, end_pos as \"end\", pident, length, {', '.join(COVS)}, syntenic_species from synteny",
)
def _(t: Tables):
    name = F.concat_ws("|", F.concat_ws("_", "category", "l_orderkey"), "transcript", "te_id", "pident", "length")
    path = scratch_path(t.spark, "synteny")
    t.synteny.select(
        "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), name.alias("name"), "category", "pident", "length", *COVS
    ).write.csv(path, sep=TAB, header=True)
    out = src.read_synteny(t.spark, path)
    return out.select("transcript", "subject", "chrom", "start", "end", "pident", "length", *COVS, "syntenic_species")


@query(
    "read_strand_table",
    f"""select fbgn, cast(sum(total_hits) as bigint) as total_hits, cast(sum(sense_hits) as bigint) as sense_hits, cast(sum(utr_len) as bigint) as total_utr_len from
    (select fbgn, tx_len as utr_len, count(*) as total_hits, count(*) filter (where sstart < send) as sense_hits from hits join transcripts on qseqid = fbtr group by fbtr, fbgn, tx_len) q group by fbgn""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "strand")
    sinks.write_tsv(by_query(t), path, digits=1)
    out = rollups.strand_bias_by_gene(src.read_strand_bias(t.spark, path))
    return out.select("fbgn", "total_hits", "sense_hits", "total_utr_len")


@query(
    "read_gene_density",
    f"select fbgn, hits, hit_bp, total_len as total_utr_len, transcripts as num_transcripts from ({DENSITY}) d",
)
def _(t: Tables):
    dens = rollups.gene_density(t.hits, t.transcripts)
    path = scratch_path(t.spark, "density")
    blank = F.lit("").alias("top")
    sinks.write_tsv(
        dens.select(F.lit(1).alias("rank"), "fbgn", "density_bp_kb", "hits", "hit_bp", "total_len", "transcripts", *[blank.alias(f"top_te_{i}") for i in (1, 2, 3)]),
        path, digits=1,
    )
    return src.read_gene_density(t.spark, path).select("fbgn", "hits", "hit_bp", "total_utr_len", "num_transcripts")


# sequences -----------------------------------------------------------------------------


@query("read_fasta", "select seq_id, md5(seq) as digest, cast(length(seq) as int) as length from sequences where seq <> ''")
def _(t: Tables):
    path = scratch_path(t.spark, "fasta")
    sinks.write_fasta(t.sequences.where("seq <> ''"), path)
    return fasta.read_fasta(t.spark, path).select("seq_id", F.md5("seq").alias("digest"), F.length("seq").alias("length"))


@query(
    "read_fasta_attributes",
    """select concat('FBtr', doc_id) as seq_id, cast(length(seq) as int) as length, concat('FBgn', doc_id % 50, case when doc_id % 2 = 0 then concat(',FBtr', doc_id) else '' end) as parent,
    concat('FBgn', doc_id % 50) as fbgn, concat('FBtr', doc_id) as fbtr, md5(seq) as digest from sequences where seq <> ''""",
)
def _(t: Tables):
    n = F.col("doc_id").cast("string")
    parent = F.concat(F.lit("FBgn"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(",FBtr"), n)).otherwise(""))
    head = F.concat(F.lit("FBtr"), n, F.lit(" type=x>y; length="), F.length("seq").cast("string"), F.lit("; parent="), parent, F.lit(";"))
    rows = t.sequences.where("seq <> ''").select(head.alias("seq_id"), "seq")
    path = scratch_path(t.spark, "fasta")
    sinks.write_fasta(rows, path)
    out = fasta.read_fasta_attrs(t.spark, path)
    return out.select("seq_id", "length", "parent", "fbgn", "fbtr", F.md5("seq").alias("digest"))


@query("read_subjects", "select te_id, family, te_class, te_length from subjects")
def _(t: Tables):
    rows = t.subjects.select(F.col("header").alias("seq_id"), F.repeat(F.lit("A"), F.col("te_length")).alias("seq"))
    path = scratch_path(t.spark, "subjects")
    sinks.write_fasta(rows, path)
    return fasta.read_subjects(t.spark, path)


# features ------------------------------------------------------------------------------


@query(
    "read_gff",
    """select 'chr' || p_partkey % 6 as chrom, cast(1 + p_partkey * 97 as int) as start, cast(p_partkey * 97 + 1000 as int) as "end", case when p_size % 2 = 0 then '+' else '-' end as strand,
    unnest(case when p_partkey % 3 = 0 then ['FBtr' || p_partkey, 'FBtr' || (p_partkey + 1)] else ['FBtr' || p_partkey] end) as parent from part where p_size % 3 <> 0""",
)
def _(t: Tables):
    n = F.col("p_partkey")
    parent = F.concat(F.lit("FBtr"), n.cast("string"), F.when(n % 3 == 0, F.concat(F.lit(",FBtr"), (n + 1).cast("string"))).otherwise(""))
    line = F.concat_ws(
        TAB,
        (n % 6).cast("string"),
        F.lit("src"),
        F.when(F.col("p_size") % 3 != 0, "three_prime_UTR").otherwise("CDS"),
        (1 + n * 97).cast("string"),
        (n * 97 + 1000).cast("string"),
        F.lit("."),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"),
        F.lit("."),
        F.concat(F.lit("ID=x;Parent="), parent),
    )
    path = save_lines(t.part, line, "gff", "##gff-version 3")
    return features.read_gff(t.spark, path, "three_prime_UTR", chr_prefix=True).drop("attributes")


@query(
    "read_subject_regions",
    """select concat('te', s_suppkey) as region_id, case s_suppkey % 4 when 0 then 'LTR' when 1 then 'CDS' else 'other' end as region, cast(s_suppkey * 3 as int) as reg_start,
    cast(s_suppkey * 3 + 200 as int) as reg_end, 2000 as length, concat('fam', s_suppkey) as family_key from supplier where s_suppkey % 4 <> 3""",
)
def _(t: Tables):
    n = F.col("s_suppkey")
    kind = F.when(n % 4 == 0, "five_prime_LTR").when(n % 4 == 1, "CDS").when(n % 4 == 2, "primer_binding_site").otherwise("transposon_unit")
    te = F.concat(F.lit("te"), n.cast("string"))
    attrs = F.concat(F.lit("ID=y;name=Dmel\\Fam"), n.cast("string"))
    feature = F.concat_ws(TAB, te, F.lit("src"), kind, (n * 3).cast("string"), (n * 3 + 200).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    lines = F.explode(F.array(F.concat_ws(" ", F.lit("##sequence-region"), te, F.lit("1"), F.lit("2000")), feature))
    path = scratch_path(t.spark, "regions")
    t.supplier.select(lines.alias("value")).write.text(path)
    return (
        features.read_subject_regions(t.spark, path)
        .join(features.read_region_lengths(t.spark, path), "region_id")
        .join(features.read_family_map(t.spark, path), "region_id")
    )


@query(
    "read_repeats",
    """select cast(o_orderkey as double) as score, round(o_totalprice / 20000, 1) as divergence, concat('X', o_orderkey % 6) as chrom, cast(1 + o_orderkey * 13 as int) as r_start, cast(21 + o_orderkey * 13 as int) as r_end,
    case when o_custkey % 2 = 0 then '+' else 'C' end as strand, concat('rep', o_custkey % 40) as repeat_name, split_part(o_orderpriority, ' ', 1) as repeat_class from orders where o_orderstatus <> 'P'""",
)
def _(t: Tables):
    bad = F.when(F.col("o_orderstatus") == "P", F.lit("n/a"))
    o = F.col("o_orderkey")
    line = F.concat_ws(
        "  ",
        F.lit(" "),
        F.coalesce(bad, o.cast("string")),
        F.format_string("%.1f", F.round(F.col("o_totalprice") / 20000, 1)),
        F.lit("0.0"),
        F.lit("0.0"),
        F.concat(F.lit("chrX"), (o % 6).cast("string")),
        (1 + o * 13).cast("string"),
        (21 + o * 13).cast("string"),
        F.lit("(500)"),
        F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("C"),
        F.concat(F.lit("rep"), (F.col("o_custkey") % 40).cast("string")),
        F.split_part("o_orderpriority", F.lit(" "), F.lit(1)),
        F.lit("1"), F.lit("20"), F.lit("(0)"), F.lit("7"),
    )
    path = save_lines(t.orders, line, "repeats", "   SW  perc perc perc  query")
    out = features.read_repeats(t.spark, path)
    return out.select("score", "divergence", "chrom", "r_start", "r_end", "strand", "repeat_name", "repeat_class")


@query(
    "read_alignment_blocks",
    """select concat('chr', o_orderkey % 6) as chrom, cast(o_orderkey * 13 as int) as b_start, cast(o_orderkey * 13 + 100 as int) as b_end,
    unnest(case when o_custkey % 3 = 0 then ['droSim1', 'droYak3'] else ['droSec1'] end) as species from orders where o_custkey % 7 <> 0""",
)
def _(t: Tables):
    o = F.col("o_orderkey")

    def row(source: Column) -> Column:
        return F.concat_ws(" ", F.lit("s"), source, (o * 13).cast("string"), F.lit("100"), F.lit("+"), F.lit("99999"), F.lit("ACGT"))

    ref = F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("dm6.chr"), (o % 6).cast("string"))).otherwise("droAna3.c")
    others = F.when(
        F.col("o_custkey") % 3 == 0,
        F.concat_ws("\n", row(F.lit("droSim1.c1")), row(F.lit("droYak3.c2")), row(F.lit("droSim1.c3"))),
    ).otherwise(row(F.lit("droSec1.c1")))
    block = F.concat_ws("\n", F.lit("a score=1"), row(ref), others, F.lit(""))
    path = save_lines(t.orders, block, "maf")
    return features.read_maf_blocks(t.spark, path)


# gene lists and annotation -------------------------------------------------------------


def fb(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


PART_GENE = "concat('FBgn', p_partkey)"


@query("read_gene_list", f"select {PART_GENE} as fbgn from part where p_partkey % 4 <> 3")
def _(t: Tables):
    n = F.col("p_partkey")
    line = (
        F.when(n % 4 == 0, fb("FBgn", n))
        .when(n % 4 == 1, F.concat_ws(TAB, "p_name", fb("FBgn", n), fb("FBgn9", n)))
        .when(n % 4 == 2, F.concat(F.lit("  "), fb("FBgn", n), F.lit("  ")))
        .otherwise(F.concat(F.lit("# "), fb("FBgn", n)))
    )
    return ann.read_gene_list(t.spark, save_lines(t.part, line, "genes"))


@query(
    "read_gene_list_symbols",
    f"select {PART_GENE} as fbgn, case when p_partkey % 2 = 0 then p_name else {PART_GENE} end as symbol from part",
)
def _(t: Tables):
    n = F.col("p_partkey")
    line = F.when(n % 2 == 0, F.concat_ws(TAB, fb("FBgn", n), fb("FBtr", n), "p_name")).otherwise(F.concat_ws(TAB, fb("FBgn", n), fb("FBtr", n)))
    return ann.read_gene_list_symbols(t.spark, save_lines(t.part, line, "symbols"))


@query("read_gene_sets", "select distinct lower(p_type) as set_name, concat('FBgn', p_partkey - p_partkey % 3) as fbgn from part")
def _(t: Tables):
    n = F.col("p_partkey")
    sets = t.part.select(F.lower("p_type").alias("set_name"), fb("FBgn", n - n % 3).alias("fbgn"))
    root = scratch_path(t.spark, "sets")
    sinks.write_gene_sets(sets, root, 1, 10**9)
    return ann.read_gene_sets(t.spark, root, one_file_per_set=False)


@query(
    "read_symbol_map",
    f"select {PART_GENE} as fbgn, arg_max(concat(p_name, k), k) as symbol from part, unnest(range(0, 2)) r(k) group by 1",
)
def _(t: Tables):
    n = F.col("p_partkey")
    # both versions of a gene go into one line group, the later one wins
    line = F.concat_ws("\n", F.concat_ws(TAB, fb("FBgn", n), F.concat("p_name", F.lit("0"))), F.concat_ws(TAB, fb("FBgn", n), F.concat("p_name", F.lit("1"))))
    return ann.read_symbol_map(t.spark, save_lines(t.part, line, "map", "## comment"))


@query("read_symbol_map_inverted", f"select concat(p_name, p_partkey) as symbol, {PART_GENE} as fbgn from part")
def _(t: Tables):
    n = F.col("p_partkey")
    line = F.concat_ws(TAB, fb("FBgn", n), F.concat("p_name", n.cast("string")))
    return ann.read_symbol_map(t.spark, save_lines(t.part, line, "map"), invert=True)


@query(
    "read_alias_map",
    f"""select distinct alias, {PART_GENE} as fbgn from (select p_partkey, unnest([concat('Sy', p_partkey), concat('sy', p_partkey), concat('SY', p_partkey), concat('CG', p_partkey),
    concat('X', p_partkey), concat('Y', p_partkey)]) as alias from part where p_size % 4 <> 0) a""",
)
def _(t: Tables):
    n = F.col("p_partkey")
    org = F.when(F.col("p_size") % 4 != 0, "Dmel").otherwise("Dsim")
    second = F.concat(fb("X", n), F.lit(", "), fb("Y", n))
    line = F.concat_ws(TAB, fb("Sy", n), org, fb("FBgn", n), F.lit("-"), fb("CG", n), second)
    return ann.read_alias_map(t.spark, save_lines(t.part, line, "alias", "## gene_symbol\torganism"))


EXPR = "select concat('FBgn', user_id) as fbgn, event_type as tissue, {agg} as rpkm from events group by 1, 2"


@query("read_expression_long", EXPR.format(agg="round(max(value), 6)"))
def _(t: Tables):
    per = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    rows = per.select(
        F.concat_ws(TAB, F.lit("r1"), fb("FBgn", F.col("user_id")), F.lit("s"), F.concat("event_type", F.lit("_(FBlc0000001)")), F.col("v").cast("string")).alias("value")
    )
    head = t.spark.range(1).select(F.lit("Release_ID\tFBgn#\tGeneSymbol\tRNASource_name\tRPKM_value").alias("value"))
    path = scratch_path(t.spark, "expr")
    rows.unionByName(head).write.text(path)
    return shown(ann.read_expression_long(t.spark, path))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "read_expression_matrix",
    f"""with m as (select user_id, event_type, max(value) as v from events group by 1, 2), g as (select distinct user_id from m), k as (select unnest([{', '.join(f"'{x}'" for x in TYPES)}]) as event_type)
    select concat('FBgn', g.user_id) as fbgn, k.event_type as tissue, round(coalesce(v, 0), 6) as rpkm from g cross join k left join m on m.user_id = g.user_id and m.event_type = k.event_type""",
)
def _(t: Tables):
    wide = t.events.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == x, F.col("value"))).alias(x) for x in TYPES])
    cells = [F.coalesce(F.col(x).cast("string"), F.lit("n/a")) for x in TYPES]
    gene = fb("FBgn", F.col("user_id"))
    rows = wide.select(F.concat_ws(TAB, gene, F.lit("s"), F.lit("f"), F.lit("t"), *cells).alias("value"))
    head = TAB.join(["#gene_primary_id", "gene_symbol", "gene_fullname", "gene_type", *TYPES])
    path = scratch_path(t.spark, "matrix")
    rows.unionByName(t.spark.range(1).select(F.lit(head).alias("value"))).write.text(path)
    return shown(ann.read_expression_matrix(t.spark, path))


@query(
    "read_go",
    f"""select {PART_GENE} as fbgn, p_name as symbol, case p_partkey % 5 when 1 then 'enables' else 'part_of' end as qualifier, concat('GO:', 1000 + p_size) as go_id, 'IDA' as evidence, 'F' as aspect
    from part where p_partkey % 5 not in (0, 4)""",
)
def _(t: Tables):
    n = F.col("p_partkey")
    qual = F.when(n % 5 == 0, "NOT|enables").when(n % 5 == 1, "enables").otherwise("part_of")
    full = F.concat_ws(TAB, F.lit("FB"), fb("FBgn", n), "p_name", qual, F.concat(F.lit("GO:"), (F.lit(1000) + F.col("p_size")).cast("string")), F.lit("r"), F.lit("IDA"), F.lit("w"), F.lit("F"))
    line = F.when(n % 5 == 4, F.concat_ws(TAB, F.lit("FB"), fb("FBgn", n), "p_name")).otherwise(full)
    return ann.read_go(t.spark, save_lines(t.part, line, "gaf", "!gaf-version: 2.2"))


@query(
    "read_gene_groups",
    f"select p_brand as group_name, {PART_GENE} as fbgn from part union all select concat('Group of ', p_brand), {PART_GENE} from part",
)
def _(t: Tables):
    n = F.col("p_partkey")
    line = F.concat_ws(TAB, fb("FBgg", n), "p_brand", F.concat(F.lit("Group of "), "p_brand"), F.lit(""), F.lit(""), fb("FBgn", n), "p_name")
    path = scratch_path(t.spark, "groups")
    t.part.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return ann.read_gene_groups(t.spark, path, by_name=True)


@query(
    "read_gene_group_details",
    f"""select concat('FBgg', p_partkey) as group_id, p_brand as group_symbol, concat('Group of ', p_brand) as group_name, case when p_size % 2 = 0 then concat('FBgg', p_size) end as parent_id,
    case when p_size % 2 = 0 then p_type end as parent_symbol, {PART_GENE} as fbgn, p_name as member_symbol from part""",
)
def _(t: Tables):
    n, child = F.col("p_partkey"), F.col("p_size") % 2 == 0
    parent = [F.when(child, c).otherwise("") for c in (fb("FBgg", F.col("p_size")), F.col("p_type"))]
    line = F.concat_ws(TAB, fb("FBgg", n), "p_brand", F.concat(F.lit("Group of "), "p_brand"), *parent, fb("FBgn", n), "p_name")
    return ann.read_gene_group_details(t.spark, save_lines(t.part, line, "groups", "## comment"))


LOC_ALIAS = "select concat('Sy', cast(p_partkey as string)) as alias, concat('FBgn', cast(p_partkey as string)) as fbgn from part where p_partkey % 2 = 0"


@query(
    "read_localization",
    f"select distinct case when p_partkey % 2 = 0 then {PART_GENE} else concat('Sy', p_partkey) end as fbgn, lower(p_name) as term from part where p_partkey % 5 not in (0, 1)",
)
def _(t: Tables):
    n = F.col("p_partkey")
    term = F.when(n % 5 == 0, "N/A").when(n % 5 == 1, "Annotated by X").otherwise(F.initcap("p_name"))
    symbol = F.concat(fb("Sy", n), F.when(n % 3 == 0, F.concat(F.lit(" (RE"), n.cast("string"), F.lit(")"))).otherwise(""))
    path = scratch_path(t.spark, "loc")
    t.part.select(F.lit("p").alias("Probe"), symbol.alias("gene"), F.lit("FBcl1").alias("FBgn ID"), F.lit("1-3").alias("stage/tissue"), term.alias("term")).write.csv(path, header=True)
    return ann.read_localization(t.spark, path, t.sql(LOC_ALIAS))


# sinks ---------------------------------------------------------------------------------


@query("written_table", f"select te_id, total_hits, sense_hits, anti_hits, total_bp, round(sense_pct, 3) as sense_pct, round(anti_pct, 3) as anti_pct from ({BYS}) x")
def _(t: Tables):
    path = scratch_path(t.spark, "tsv")
    sinks.write_tsv(rollups.strand_bias_by_subject(t.hits), path, digits=3)
    schema = "te_id string, total_hits long, sense_hits long, anti_hits long, total_bp long, sense_pct double, anti_pct double"
    return t.spark.read.csv(path, sep=TAB, header=True, schema=schema)


@query("written_json", f"select te_id, total_hits, total_bp from ({BYS}) x")
def _(t: Tables):
    path = scratch_path(t.spark, "json")
    sinks.write_json(rollups.strand_bias_by_subject(t.hits).withColumn("sequence", F.lit("ACGT")), path)
    return t.spark.read.json(path, schema="te_id string, total_hits long, total_bp long")


@query(
    "written_gene_sets",
    """select set_name, count(distinct fbgn) as n_genes, case when starts_with(set_name, 'expr_') then 'expression' when starts_with(set_name, 'go_') then 'go' else 'other' end as category
    from gene_sets group by 1 having count(distinct fbgn) between 60 and 200""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "sets")
    sinks.write_gene_sets(t.gene_sets, path, 60, 200)
    back = ann.read_set_folders(t.spark, path)
    return an.set_summary(back.select("set_name", F.col("value").alias("fbgn")), 1, 10**9)


# streaming -----------------------------------------------------------------------------


@query("streamed_strand_tallies", f"select te_id, total_hits, sense_hits, anti_hits, total_bp, round(sense_pct, 6) as sense_pct, round(anti_pct, 6) as anti_pct from ({BYS}) x")
def _(t: Tables):
    folder, out, state = (scratch_path(t.spark, x) for x in ("arrivals", "tallies", "state"))
    # two arrivals of many files each: no file or task holds a fixed share of the hits
    files = max(4, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    t.hits.select(*HIT14).repartition(files).write.csv(folder, sep=TAB)
    run = streaming.ingest(t.spark, folder, out, state, files_per_trigger=-(-files // 2))
    run.awaitTermination()
    return shown(streaming.tally_report(streaming.latest(t.spark, out)))
