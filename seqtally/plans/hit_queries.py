"""Hit filters, summaries, roll-ups and family comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, names
from ..operators import compare, hits, rollups
from .registry import query
from .shape import shown
from .views import Tables

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
STRAND = "case when sstart < send then 'plus' else 'minus' end"
PLUS = "count(*) filter (where sstart < send)"
MINUS = "count(*) filter (where not (sstart < send))"


# columns -------------------------------------------------------------------------------


@query("strand_column", f"select {K}, {STRAND} as strand from hits")
def _(t: Tables):
    return t.hits.select(*KEYS, coords.strand().alias("strand"))


@query(
    "normalized_coordinates",
    f"""select {K}, least(qstart, qend) as q_lo, greatest(qstart, qend) as q_hi,
    least(sstart, send) as s_lo, greatest(sstart, send) as s_hi from hits""",
)
def _(t: Tables):
    return coords.normalize_coords(t.hits).select(*KEYS, "q_lo", "q_hi", "s_lo", "s_hi")


@query(
    "coverage_percent",
    f"""select {K}, round((qend - qstart + 1) / qlen * 100, 6) as q_coverage,
    round((abs(send - sstart) + 1) / slen * 100, 6) as s_coverage from hits""",
)
def _(t: Tables):
    return shown(coords.coverage_pct(t.hits).select(*KEYS, "q_coverage", "s_coverage"))


@query(
    "family_names",
    r"""select te_id, trim(regexp_replace(regexp_extract(header, 'name=([^;]+)', 1), '[{][^}]*[}][0-9]*', '', 'g')) as instance,
    split_part(split_part(regexp_extract(header, 'name=([^;]+)', 1), ' ', 1), '{', 1) as cut,
    regexp_replace(regexp_extract(header, 'name=([^;]+)', 1), '[{][^}]*[}].*', '') as tail from subjects""",
)
def _(t: Tables):
    h = F.col("header")
    return t.subjects.select(
        "te_id", *[names.family_name(h, m).alias(m) for m in ("instance", "cut", "tail")]
    )


def _marks(words) -> str:
    return " or ".join(f"contains(lower(nm), '{w}')" for w in words)


@query(
    "family_classes",
    f"""select nm, case when {_marks(names.LTR_MARKS)} then 'LTR' when {_marks(names.LINE_MARKS)} then 'LINE'
    when {_marks(names.DNA_MARKS)} then 'DNA' when contains(lower(nm), 'sine') or starts_with(lower(nm), 'ine-') then 'SINE'
    when contains(lower(nm), 'ltr') then 'LTR' else 'Unknown' end as te_class
    from (select family as nm from subjects union select p_name as nm from part
      union select concat(p_name, '-element') as nm from part union select concat('ine-', p_name) as nm from part) n""",
)
def _(t: Tables):
    parts = t.part.select("p_name").distinct()
    nm = (
        t.subjects.select(F.col("family").alias("nm"))
        .union(parts.select("p_name"))
        .union(parts.select(F.concat("p_name", F.lit("-element"))))
        .union(parts.select(F.concat(F.lit("ine-"), "p_name")))
        .distinct()
    )
    return nm.select("nm", names.family_class(F.col("nm")).alias("te_class"))


@query(
    "class_from_header",
    """select te_id, split_part(h, '#', 1) as family,
    case when contains(h, '#') then split_part(split_part(h, '#', 2), '/', 1) else 'Unknown' end as te_class,
    case when contains(h, '#') then split_part(split_part(h, '#', 2), '/', 2) else '' end as subclass,
    split_part(name, '{}', 1) as consensus
    from (select te_id, name, case when te_class = 'Unknown' then family when te_class = 'DNA' then concat(family, '#DNA')
      else concat(family, '#', te_class, '/', lower(te_class)) end as h from subjects) x""",
)
def _(t: Tables):
    h = (
        F.when(F.col("te_class") == "Unknown", F.col("family"))
        .when(F.col("te_class") == "DNA", F.concat("family", F.lit("#DNA")))
        .otherwise(F.concat("family", F.lit("#"), "te_class", F.lit("/"), F.lower("te_class")))
    )
    cols = names.split_class(F.col("h"))
    return t.subjects.select("te_id", "name", h.alias("h")).select(
        "te_id",
        *[c.alias(n) for n, c in cols.items()],
        names.consensus_family(F.col("name")).alias("consensus"),
    )


@query(
    "name_tokens",
    """select distinct x, case when contains(x, ':') then split_part(x, ':', 1) else split_part(x, '_', 1) end as with_underscore,
    split_part(x, ':', 1) as colon_only, split_part(x, '_', 1) as gene,
    nullif(regexp_extract(x, '(gn[0-9]+)', 1), '') as gene_id, regexp_replace(x, '-R[A-Z]+$', '') as symbol
    from (select concat(fbgn, '_', fbtr, '-RA') as x from transcripts union all select concat(name, ':', te_id) from subjects) s""",
)
def _(t: Tables):
    x = t.transcripts.select(F.concat("fbgn", F.lit("_"), "fbtr", F.lit("-RA")).alias("x")).union(
        t.subjects.select(F.concat("name", F.lit(":"), "te_id"))
    )
    c = F.col("x")
    return x.distinct().select(
        "x",
        names.subject_token(c).alias("with_underscore"),
        names.subject_token(c, underscore=False).alias("colon_only"),
        names.gene_token(c).alias("gene"),
        names.gene_id_from_header(c, "gn").alias("gene_id"),
        names.symbol_from_transcript(c).alias("symbol"),
    )


@query(
    "packed_names",
    f"""select {K}, concat(category, '_', l_orderkey, '|', qseqid, '|', sseqid, '|', cast(pident as varchar), '|', length) as name,
    category, qseqid as transcript, sseqid as subject, pident, length,
    concat(qseqid, '|', chrom, '|', bed_start, '-', bed_end) as locus_id from genomic_hits""",
)
def _(t: Tables):
    g = t.genomic_hits.select(
        *KEYS,
        coords.pack_hit_name(
            F.col("category"), F.col("l_orderkey"), F.col("qseqid"), F.col("sseqid"), F.col("pident"), F.col("length")
        ).alias("name"),
        coords.locus_id("qseqid", "chrom", "bed_start", "bed_end").alias("locus_id"),
    )
    return coords.unpack_hit_name(g)


@query(
    "quality_columns",
    f"""select {K}, round(pident / 100 * length, 6) as identical_bp, round(pident * length, 6) as quality,
    round(log10(case when evalue = 0 then 1e-300 else evalue end), 6) as log_evalue from hits""",
)
def _(t: Tables):
    return shown(
        t.hits.select(
            *KEYS,
            coords.identical_bp().alias("identical_bp"),
            coords.quality().alias("quality"),
            coords.log_evalue().alias("log_evalue"),
        )
    )


# filters and joins ---------------------------------------------------------------------


@query("filtered_hits", f"select {K} from hits where length >= 60 and pident >= 75 and evalue <= 0.01")
def _(t: Tables):
    return hits.filter_hits(t.hits, min_length=60, min_pident=75, max_evalue=0.01).select(*KEYS)


@query("high_quality_hits", f"select {K} from hits where pident >= 80 and length >= 50")
def _(t: Tables):
    return hits.high_quality(t.hits).select(*KEYS)


@query(
    "selected_hits",
    f"""select {K} from hits where starts_with(qseqid, 'tr1') and sstart < send
    and sseqid in (select te_id from subjects where contains(lower(name), 'doc'))""",
)
def _(t: Tables):
    return hits.select_hits(t.hits, t.subjects, gene="tr1", family="DOC", strand="plus").select(*KEYS)


@query(
    "hits_with_subject",
    # one subject's hits name an id that the dimension does not have
    f"""select {K}, coalesce(family, sid) as family, coalesce(te_class, 'Unknown') as te_class
    from (select *, case when sseqid = 'te7' then 'unlisted' else sseqid end as sid from hits) h left join subjects on sid = te_id""",
)
def _(t: Tables):
    renamed = F.when(F.col("sseqid") == "te7", "unlisted").otherwise(F.col("sseqid"))
    return hits.with_subject(t.hits.withColumn("sseqid", renamed), t.subjects).select(*KEYS, "family", "te_class")


@query(
    "hits_with_gene",
    # a seventh line names a transcript that the dimension does not have
    f"""select {K}, fbgn, tx_len from (select *, case when l_linenumber = 7 then concat(qseqid, 'x') else qseqid end as qid from hits) h join transcripts on qid = fbtr""",
)
def _(t: Tables):
    renamed = F.when(F.col("l_linenumber") == 7, F.concat("qseqid", F.lit("x"))).otherwise(F.col("qseqid"))
    return hits.with_gene(t.hits.withColumn("qseqid", renamed), t.transcripts).select(*KEYS, "fbgn", "tx_len")


# summaries -----------------------------------------------------------------------------


@query(
    "hit_summary",
    f"""select count(*) as total_hits, count(distinct qseqid) as unique_queries, count(distinct sseqid) as unique_subjects,
    round(avg(pident), 6) as mean_pident, round(avg(length), 6) as mean_length, round(avg(evalue), 6) as mean_evalue,
    {PLUS} as strand_plus, {MINUS} as strand_minus from hits""",
)
def _(t: Tables):
    return shown(hits.summarize_hits(t.hits))


@query(
    "hit_description",
    """select measure, round(min(v), 6) as v_min, round(max(v), 6) as v_max, round(avg(v), 6) as v_mean, round(median(v), 6) as v_median
    from (select 'evalue' as measure, evalue as v from hits union all select 'pident', pident from hits
     union all select 'length', cast(length as double) from hits union all select 'bitscore', bitscore from hits
     union all select 'query_coverage', (qend - qstart + 1) / qlen * 100 from hits
     union all select 'subject_coverage', (abs(send - sstart) + 1) / slen * 100 from hits) m group by measure""",
)
def _(t: Tables):
    return shown(hits.describe_hits(t.hits))


@query(
    "replicate_statistics",
    """select dataset, count(*) as total_hits, count(distinct qseqid) as unique_queries, round(avg(pident), 6) as mean_pident,
    round(avg(length), 6) as mean_length, list_sort(list(pident))[cast(floor(count(*) / 2) as int) + 1] as median_pident,
    list_sort(list(length))[cast(floor(count(*) / 2) as int) + 1] as median_length,
    count(*) filter (where pident >= 80) as hits_80plus, count(*) filter (where length >= 100) as hits_100bp_plus,
    count(*) filter (where pident >= 80 and length >= 50) as hits_hq from hits group by dataset""",
)
def _(t: Tables):
    return shown(hits.hit_statistics(t.hits, ["dataset"]))


@query(
    "top_hits_by_bitscore",
    f"select {K}, round(bitscore, 6) as bitscore from hits order by bitscore desc, {K} limit 50",
)
def _(t: Tables):
    return shown(hits.top_hits(t.hits, 50, "bitscore", KEYS).select(*KEYS, "bitscore"))


@query("top_hits_by_evalue", f"select {K}, round(evalue, 9) as evalue from hits order by hits.evalue, {K} limit 50")
def _(t: Tables):
    return shown(hits.top_hits(t.hits, 50, "evalue", KEYS).select(*KEYS, "evalue"), 9)


@query("top_queries", "select qseqid, count(*) as hits from hits group by 1 order by 2 desc, 1 limit 10")
def _(t: Tables):
    return hits.top_counts(t.hits, "qseqid")


@query("top_subjects", "select sseqid, count(*) as hits from hits group by 1 order by 2 desc, 1 limit 10")
def _(t: Tables):
    return hits.top_counts(t.hits, "sseqid")


@query(
    "subjects_by_length_tier",
    """select m as min_length, count(*) as hits, count(distinct sseqid) as ids from hits
    join (values (50), (100), (150), (200)) v(m) on length >= m group by m""",
)
def _(t: Tables):
    return hits.length_tiers(t.hits, [50, 100, 150, 200])


@query(
    "novel_hits_by_identity",
    """select m as min_pident, count(*) as hits, count(distinct qseqid) as ids from hits
    join (values (60.0::double), (70.0::double), (80.0::double), (90.0::double)) v(m) on pident >= m where category = 'novel' group by m""",
)
def _(t: Tables):
    return hits.identity_tiers(t.hits.where("category = 'novel'"), [60, 70, 80, 90])


# genes and strands ---------------------------------------------------------------------

DENSITY = """select fbgn, count(*) as transcripts, cast(sum(tx_len) as bigint) as total_len, cast(sum(n) as bigint) as hits,
 cast(sum(bp) as bigint) as hit_bp, sum(bp) / sum(tx_len) * 1000 as density_bp_kb
 from (select qseqid, count(*) as n, sum(length) as bp from hits group by qseqid) h join transcripts on qseqid = fbtr group by fbgn"""


@query(
    "gene_density",
    f"select fbgn, transcripts, total_len, hits, hit_bp, round(density_bp_kb, 6) as density_bp_kb from ({DENSITY}) d",
)
def _(t: Tables):
    return shown(rollups.gene_density(t.hits, t.transcripts))


@query(
    "gene_density_report",
    f"""with dens as ({DENSITY}), ranked as (select *, row_number() over (order by density_bp_kb desc, fbgn) as rk, count(*) over () as n from dens),
    tops as (select fbgn, sseqid, c, row_number() over (partition by fbgn order by c desc, sseqid) as r from
      (select fbgn, sseqid, count(*) as c from hits join transcripts on qseqid = fbtr group by 1, 2) z),
    sides as (select 'top' as side, * from ranked where rk <= 100 union all select 'bottom', * from ranked where rk > n - 100)
    select side, rk as rank, s.fbgn, transcripts, total_len, hits, hit_bp, round(density_bp_kb, 6) as density_bp_kb,
    coalesce(max(case when r = 1 then concat(sseqid, ':', c) end), '') as top_te_1,
    coalesce(max(case when r = 2 then concat(sseqid, ':', c) end), '') as top_te_2,
    coalesce(max(case when r = 3 then concat(sseqid, ':', c) end), '') as top_te_3
    from sides s join tops o on s.fbgn = o.fbgn group by 1, 2, 3, 4, 5, 6, 7, 8""",
)
def _(t: Tables):
    ranked = rollups.top_bottom(rollups.gene_density(t.hits, t.transcripts), 100)
    wanted = ranked.select("fbgn").distinct()
    members = t.transcripts.join(F.broadcast(wanted), "fbgn", "left_semi")  # at most 200 genes
    return shown(ranked.join(rollups.top_subjects_per_gene(t.hits, members), "fbgn"))


BYQ = f"""select fbtr, fbgn, cast(tx_len as bigint) as utr_len, total_hits, sense_hits, anti_hits, 100 * sense_hits / total_hits as sense_pct,
 100 * anti_hits / total_hits as anti_pct from (select qseqid, count(*) as total_hits, {PLUS} as sense_hits, {MINUS} as anti_hits
 from hits group by qseqid) h join transcripts on qseqid = fbtr"""
BYS = f"""select sseqid as te_id, count(*) as total_hits, {PLUS} as sense_hits, {MINUS} as anti_hits, cast(sum(length) as bigint) as total_bp,
 100 * {PLUS} / count(*) as sense_pct, 100 * {MINUS} / count(*) as anti_pct from hits group by sseqid having count(*) >= 10"""
BYG = f"""select fbgn, cast(sum(total_hits) as bigint) as total_hits, cast(sum(sense_hits) as bigint) as sense_hits,
 cast(sum(anti_hits) as bigint) as anti_hits, cast(sum(utr_len) as bigint) as total_utr_len,
 case when sum(total_hits) > 0 then 100 * sum(sense_hits) / sum(total_hits) else 50 end as sense_pct,
 case when sum(total_hits) > 0 then 100 * sum(anti_hits) / sum(total_hits) else 50 end as anti_pct from ({BYQ}) q group by fbgn"""
PCT = "round(sense_pct, 6) as sense_pct, round(anti_pct, 6) as anti_pct"


def by_query(t: Tables):
    tx = t.transcripts.withColumn("tx_len", F.col("tx_len").cast("long"))
    return rollups.strand_bias_by_query(t.hits, tx)


def by_gene(t: Tables):
    return rollups.strand_bias_by_gene(by_query(t))


@query("strand_bias_by_transcript", f"select fbtr, fbgn, utr_len, total_hits, sense_hits, anti_hits, {PCT} from ({BYQ}) x")
def _(t: Tables):
    return shown(by_query(t))


@query("strand_bias_by_subject", f"select te_id, total_hits, sense_hits, anti_hits, total_bp, {PCT} from ({BYS}) x")
def _(t: Tables):
    return shown(rollups.strand_bias_by_subject(t.hits))


@query("strand_bias_by_gene", f"select fbgn, total_hits, sense_hits, anti_hits, total_utr_len, {PCT} from ({BYG}) x")
def _(t: Tables):
    return shown(by_gene(t))


@query(
    "strand_overview",
    f"""with q as ({BYQ}), s as ({BYS})
    select cast(sum(sense_hits) as bigint) as total_sense, cast(sum(anti_hits) as bigint) as total_anti, count(*) as queries_analyzed,
    count(*) filter (where total_hits >= 50 and sense_pct >= 70) as strong_sense_queries,
    count(*) filter (where total_hits >= 50 and anti_pct >= 70) as strong_anti_queries,
    (select count(*) from s) as subjects_analyzed, (select count(*) from s where sense_pct >= 60) as strong_sense_subjects,
    (select count(*) from s where anti_pct >= 60) as strong_anti_subjects,
    round(100 * sum(sense_hits) / sum(total_hits), 6) as sense_pct, round(100 * sum(anti_hits) / sum(total_hits), 6) as anti_pct from q""",
)
def _(t: Tables):
    return shown(rollups.strand_overview(by_query(t), rollups.strand_bias_by_subject(t.hits)))


# families ------------------------------------------------------------------------------

FAM = f"""select family, count(*) as hits, {PLUS} as plus, {MINUS} as minus, avg(evalue) as mean_evalue, avg(pident) as mean_pident,
 max(te_class) as te_class, case when {MINUS} > 0 then {PLUS} / {MINUS} else cast('inf' as double) end as strand_ratio
 from hits join subjects on sseqid = te_id"""


def fam(where: str = "") -> str:
    return f"{FAM} {where} group by family"


@query(
    "family_statistics",
    f"""select family, hits, plus, minus, round(mean_evalue, 6) as mean_evalue, round(mean_pident, 6) as mean_pident, te_class,
    round(strand_ratio, 6) as strand_ratio from ({fam()}) f""",
)
def _(t: Tables):
    return shown(rollups.family_stats(t.hits, t.subjects))


def _pivot_sql() -> str:
    cols = []
    for d in "ANR":
        p, m = (f"count(*) filter (where dataset = '{d}' and {c})" for c in ("sstart < send", "not (sstart < send)"))
        n = f"count(*) filter (where dataset = '{d}')"
        cols.append(
            f"{p} as {d}_plus, {m} as {d}_minus, {n} as {d}_total, "
            f"round(case when {n} = 0 then null when {m} > 0 then {p} / {m} else 999.0::double end, 6) as {d}_ratio"
        )
    return (
        f"select family, max(te_class) as te_class, {', '.join(cols)}, count(*) as total "
        "from hits join subjects on sseqid = te_id group by family"
    )


@query("family_by_dataset", _pivot_sql())
def _(t: Tables):
    stats = rollups.family_stats(t.hits, t.subjects, ["dataset"])
    return shown(rollups.family_dataset_pivot(stats, ["A", "N", "R"]))


@query(
    "family_set_enrichment",
    f"""with a as ({fam("where dataset = 'A'")}), b as ({fam("where dataset = 'N'")}),
    j as (select a.family, a.te_class, a.hits as a_count, b.hits as b_count, a.hits / (select sum(hits) from a) as a_freq,
     b.hits / (select sum(hits) from b) as b_freq from a join b on a.family = b.family)
    select family, te_class, a_count, b_count, round(a_freq, 6) as a_freq, round(b_freq, 6) as b_freq,
    round(a_freq / b_freq, 6) as enrichment, round(log2(a_freq / b_freq), 6) as log2_enrichment from j""",
)
def _(t: Tables):
    a = rollups.family_stats(t.hits.where("dataset = 'A'"), t.subjects)
    b = rollups.family_stats(t.hits.where("dataset = 'N'"), t.subjects)
    return shown(rollups.family_enrichment(a, b))


@query(
    "family_real_vs_null",
    f"""with a as ({fam("where dataset = 'A'")}), b as ({fam("where dataset <> 'A'")}),
    j as (select coalesce(a.family, b.family) as family, coalesce(a.hits, 0) as "real", coalesce(b.hits / 2, 0) as shuffled
     from a full join b on a.family = b.family),
    f as (select *, case when shuffled > 0 then "real" / shuffled else cast('inf' as double) end as fold from j where "real" >= 100 or shuffled >= 100)
    select family, "real", round(shuffled, 6) as shuffled, round(fold, 6) as fold, case when fold >= 0.8 and fold <= 1.2 then 'similar'
    when fold > 1.5 then 'enriched' when fold < 0.67 then 'depleted' else 'between' end as label from f""",
)
def _(t: Tables):
    a = rollups.family_stats(t.hits.where("dataset = 'A'"), t.subjects)
    b = rollups.family_stats(t.hits.where("dataset <> 'A'"), t.subjects)
    return shown(rollups.real_vs_null_family(a, b, 2))


@query(
    "biased_families",
    f"""select family, te_class, hits, plus, minus, round(strand_ratio, 6) as strand_ratio from ({fam()}) f
    where hits >= 5 and (strand_ratio > 2 or strand_ratio < 0.5)""",
)
def _(t: Tables):
    found = rollups.biased_families(rollups.family_stats(t.hits, t.subjects))
    return shown(found.select("family", "te_class", "hits", "plus", "minus", "strand_ratio"))


@query(
    "control_overview",
    f"""select dataset, count(*) as total, {PLUS} as plus, {MINUS} as minus,
    round(case when {MINUS} > 0 then {PLUS} / {MINUS} else cast('inf' as double) end, 6) as ratio from hits group by dataset""",
)
def _(t: Tables):
    return shown(rollups.control_overview(t.hits))


# sets of ids ---------------------------------------------------------------------------

PAIR = "concat(qseqid, '/', sseqid)"
PAIRS_A = f"select {PAIR} as pair from hits where dataset = 'A'"
PAIRS_B = f"select {PAIR} as pair from hits where dataset = 'N'"


@query(
    "subjects_in_either_set",
    # query and subject together: which pairs occur in one data set, the other, or both
    f"""with a as ({PAIRS_A}), b as ({PAIRS_B}) select pair, case when pair in (select pair from a) and pair in (select pair from b) then 'both'
    when pair in (select pair from a) then 'a_only' else 'b_only' end as side from (select pair from a union select pair from b) u""",
)
def _(t: Tables):
    pairs = t.hits.select("dataset", F.concat("qseqid", F.lit("/"), "sseqid").alias("pair"))
    return compare.set_partition(pairs.where("dataset = 'A'"), pairs.where("dataset = 'N'"), "pair")


@query(
    "subjects_never_hit",
    # the catalogue lists every subject under a second name that no hit uses
    """select te_id, family, te_class from (select te_id, family, te_class from subjects union all select concat(te_id, 'x'), family, te_class from subjects) s
    where te_id not in (select sseqid from hits)""",
)
def _(t: Tables):
    again = t.subjects.withColumn("te_id", F.concat("te_id", F.lit("x")))
    return compare.not_hit(t.subjects.unionByName(again), t.hits).select("te_id", "family", "te_class")


def _tb(cond: str) -> str:
    d = DENSITY.replace("from hits group", f"from hits where {cond} group")
    return (
        f"select fbgn, case when rk <= 100 then 'top' else 'bottom' end as side, rk from (select fbgn, row_number() over "
        f"(order by density_bp_kb desc, fbgn) as rk, count(*) over () as n from ({d}) d) r where rk <= 100 or rk > n - 100"
    )


@query(
    "top_list_overlap",
    f"""select a.fbgn, a.rk as a_rank, a.side as a_side, b.rk as b_rank, b.side as b_side, concat(a.side, '_', b.side) as pair
    from ({_tb("dataset = 'A'")}) a join ({_tb("dataset <> 'A'")}) b on a.fbgn = b.fbgn""",
)
def _(t: Tables):
    a = rollups.top_bottom(rollups.gene_density(t.hits.where("dataset = 'A'"), t.transcripts), 100)
    b = rollups.top_bottom(rollups.gene_density(t.hits.where("dataset <> 'A'"), t.transcripts), 100)
    return compare.list_overlap(a, b)


@query(
    "two_source_comparison",
    f"""with a as (select * from ({fam("where dataset = 'A'")}) x), b as (select * from ({fam("where dataset = 'R'")}) x)
    select coalesce(a.family, b.family) as family, coalesce(a.hits, 0) as a_hits, coalesce(a.plus, 0) as a_plus, coalesce(a.minus, 0) as a_minus,
    coalesce(b.hits, 0) as b_hits, coalesce(b.plus, 0) as b_plus, coalesce(b.minus, 0) as b_minus from a full join b on a.family = b.family""",
)
def _(t: Tables):
    a = rollups.family_stats(t.hits.where("dataset = 'A'"), t.subjects)
    b = rollups.family_stats(t.hits.where("dataset = 'R'"), t.subjects)
    return compare.compare_sources(a, b, ["family"], ["hits", "plus", "minus"])


# histograms and ladders ----------------------------------------------------------------

E_EDGES = [0, 1e-10, 1e-5, 1e-3, 0.01, 0.1, 1, 10]


def _bins_sql(value: str, edges, src: str) -> str:
    rows = ", ".join(
        f"({i}, {float(a)!r}::double, {float(b)!r}::double)" for i, (a, b) in enumerate(zip(edges, edges[1:]))
    )
    return (
        f"select b as bin, lo, hi, count({value}) as rows from (values {rows}) v(b, lo, hi) "
        f"left join {src} on {value} >= lo and {value} < hi group by 1, 2, 3"
    )


@query("evalue_bins", _bins_sql("evalue", E_EDGES, "hits"))
def _(t: Tables):
    return rollups.binned_counts(t.hits, "evalue", E_EDGES)


S_EDGES = [-5, -2, -1, 0, 0.5, 1, 1.5, 2, 3, 5, 10]


@query("score_bins", _bins_sql("score", S_EDGES, "hits"))
def _(t: Tables):
    return rollups.binned_counts(t.hits, "score", S_EDGES)


@query(
    "score_histogram",
    """with b as (select least(cast(floor((score - -1) / ((4.0::double - -1) / 50)) as int), 49) as bin from hits where score >= -1 and score <= 4)
    select bin, count(*) as rows, round(count(*) / (select count(*) from b) / (5.0::double / 50), 6) as density from b group by bin""",
)
def _(t: Tables):
    return shown(rollups.histogram(t.hits, "score", -1.0, 4.0, 50))


@query(
    "identity_length_grid",
    """select least(cast(floor((pident - 60) / (40.0::double / 20)) as int), 19) as x_bin,
    least(cast(floor((length - 0) / (200.0::double / 10)) as int), 9) as y_bin, count(*) as rows from hits
    where pident between 60 and 100 and length between 0 and 200 group by 1, 2""",
)
def _(t: Tables):
    return rollups.histogram2d(t.hits, "pident", "length", (60.0, 100.0, 20), (0.0, 200.0, 10))


# The quality tiers of the conservation report.
TIERS = [
    ("all", 0, 0), ("pid60", 60, 0), ("pid70", 70, 0), ("pid80", 80, 0), ("pid90", 90, 0),
    ("pid80_len30", 80, 30), ("pid80_len50", 80, 50), ("pid80_len100", 80, 100),
]


@query(
    "conservation_ladder",
    f"""select tier, count(*) as hits, round(avg(score), 6) as mean_score, round(100 * count(*) filter (where score >= 1) / count(*), 6) as pct_conserved,
    list_sort(list(score))[cast(floor(count(*) / 2) as int) + 1] as median_score
    from hits join (values {", ".join(f"('{a}', {b}, {c})" for a, b, c in TIERS)}) v(tier, p, n) on pident >= p and length >= n group by tier""",
)
def _(t: Tables):
    return shown(rollups.threshold_ladder(t.hits, TIERS), raw=("median_score",))


@query(
    "conservation_categories",
    """with c as (select category as origin, case when score >= 2 then 'highly_conserved' when score >= 1 then 'conserved' when score >= 0 then 'weakly_conserved'
    else 'fast_evolving' end as category from hits) select origin, category, count(*) as hits,
    round(100 * count(*) / sum(count(*)) over (partition by origin), 6) as pct from c group by 1, 2""",
)
def _(t: Tables):
    return shown(rollups.conservation_categories(t.hits.withColumnRenamed("category", "origin"), ["origin"]))


@query(
    "subject_mean_scores",
    """select sseqid as te_id, count(*) as hits, round(avg(score), 6) as mean_score from hits group by 1 having count(*) >= 100
    order by avg(score) desc, 1 limit 20""",
)
def _(t: Tables):
    return shown(rollups.subject_means(t.hits.withColumnRenamed("sseqid", "te_id")))


@query(
    "length_tier_enrichment",
    """with a as (select m, count(*) as n from hits join (values (150), (190)) v(m) on length >= m where dataset = 'A' group by m),
    b as (select m, count(*) / 2 as n from hits join (values (150), (190)) v(m) on length >= m where dataset <> 'A' group by m)
    select a.m as min_length, a.n as "real", round(b.n, 6) as shuffled, round(a.n / b.n, 6) as fold from a join b on a.m = b.m""",
)
def _(t: Tables):
    from ..operators.enrichment import fold_by_tier

    a = hits.length_tiers(t.hits.where("dataset = 'A'"), [150, 190])
    b = hits.length_tiers(t.hits.where("dataset <> 'A'"), [150, 190])
    return shown(fold_by_tier(a, b, "min_length", 2))
