"""Gene sets against hits: metrics, tests, corrections, rankings and null comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.names import set_category, set_label
from ..operators import enrichment as en
from ..operators import hits as ht
from ..operators import rollups
from ..scale import stage
from .hit_queries import BYG, BYS, DENSITY, K, KEYS, by_gene
from .registry import query
from .shape import shown, single, single_sql
from .views import Tables

# every gene has hits here, so a gene is positive in the 2x2 tables when they lie close together;
# short transcripts have more hits per length, so sets by size are enriched or depleted in fact
POSITIVE = "total_hits * 1000 > 24 * total_utr_len"
GENE_HITS = f"gh as (select fbgn, total_hits, sense_hits, anti_hits, total_utr_len from ({BYG}) b)"
SETS = "ss as (select distinct set_name, fbgn from gene_sets)"


def _gene_hits(t: Tables) -> DataFrame:
    return by_gene(t)


def _sets(t: Tables) -> DataFrame:
    return t.gene_sets.distinct()


METRICS = f"""{GENE_HITS}, {SETS}, sm as (select set_name, count(*) as n_genes, count(*) filter (where total_hits > 0) as n_with_hits,
 cast(coalesce(sum(total_hits), 0) as bigint) as total_hits, cast(coalesce(sum(total_utr_len), 0) as bigint) as total_utr_len,
 coalesce(avg(d), 0) as mean_density, coalesce(median(d), 0) as median_density, 100 * count(*) filter (where total_hits > 0) / count(*) as pct_with_hits,
 case when sum(total_hits) > 0 then 100 * sum(sense_hits) / sum(total_hits) else 50 end as sense_pct
 from (select s.set_name, g.*, case when total_hits > 0 and total_utr_len > 0 then total_hits / total_utr_len * 1000 end as d from ss s left join gh g on s.fbgn = g.fbgn) j group by set_name)"""
M_COLS = """set_name, n_genes, n_with_hits, total_hits, total_utr_len, round(mean_density, 6) as mean_density, round(median_density, 6) as median_density,
 round(pct_with_hits, 6) as pct_with_hits, round(sense_pct, 6) as sense_pct"""


@query("gene_set_metrics", f"with {METRICS} select {M_COLS} from sm")
def _(t: Tables):
    return shown(en.set_metrics(_sets(t), _gene_hits(t)))


TABLE = f"""{GENE_HITS}, {SETS}, uni as (select fbgn from gh union select fbgn from ss),
 fl as (select u.fbgn, g.fbgn is not null and g.total_hits * 1000 > 24 * g.total_utr_len as p from uni u left join gh g on u.fbgn = g.fbgn),
 ct as (select set_name, count(*) filter (where p) as a, count(*) filter (where not p) as b, (select count(*) from fl where p) - count(*) filter (where p) as c,
  (select count(*) from fl where not p) - count(*) filter (where not p) as d from ss join fl on ss.fbgn = fl.fbgn group by set_name),
 ora as (select *, case when a + b = 0 or c + d = 0 or a + c = 0 or b + d = 0 then cast('nan' as double) when b = 0 or c = 0 then cast('inf' as double)
  else a * d / (b * c) end as odds_ratio from ct)"""


def _universe(t: Tables) -> DataFrame:
    return _gene_hits(t).select("fbgn").union(_sets(t).select("fbgn")).distinct()


def _table(t: Tables) -> DataFrame:
    return en.contingency(_sets(t), _universe(t), _gene_hits(t).where(POSITIVE))


@query("contingency_tables", f"with {TABLE} select set_name, a, b, c, d, round(odds_ratio, 6) as odds_ratio from ora")
def _(t: Tables):
    table = _table(t)
    return shown(table.withColumn("odds_ratio", st.odds_ratio("a", "b", "c", "d")))



FISHER = f"""{TABLE}, cells as (select *, a + b as r, a + c as l, a + b + c + d as n from ora),
 logs as (select *, lgamma(l + 1) - lgamma(k + 1) - lgamma(l - k + 1) + lgamma(n - l + 1) - lgamma(r - k + 1) - lgamma(n - l - r + k + 1)
  - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) as lp from (select *, unnest(range(cast(greatest(0, r + l - n) as bigint), cast(least(r, l) as bigint) + 1)) as k from cells) x),
 fi as (select set_name, case when max(a + b) = 0 or max(c + d) = 0 or max(l) = 0 or max(b + d) = 0 then 1.0
  else least(1, sum(exp(lp)) filter (where lp <= seen + 1e-7)) end as fisher_p
  from (select *, max(lp) filter (where k = a) over (partition by set_name) as seen from logs) y group by set_name)"""


@query("fisher_tests", f"with {FISHER} select set_name, a, b, c, d, round(odds_ratio, 6) as odds_ratio, round(fisher_p, 6) as fisher_p from ora join fi using (set_name)")
def _(t: Tables):
    return shown(en.fisher_exact(_table(t)))


VALUES = f"""{GENE_HITS}, {SETS}, v as (select fbgn, total_hits / total_utr_len * 1000 as x from gh where total_hits > 0 and total_utr_len > 0),
 r as (select fbgn, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rk from v),
 tie as (select sum(n * n * n - n) as t from (select count(*) as n from v group by x) z),
 u as (select set_name, count(*) as n_in, (select count(*) from v) - count(*) as n_out, sum(rk) - count(*) * (count(*) + 1) / 2 as u, median(x) as median_in from ss join r on ss.fbgn = r.fbgn group by 1),
 mo as (select n.set_name, median(x) as median_out from (select distinct set_name from ss) n join v on not exists (select 1 from ss where ss.set_name = n.set_name and ss.fbgn = v.fbgn) group by 1)"""


@query(
    "rank_tests",
    f"""with {VALUES} select u.set_name, n_in, n_out, case when n_in >= 3 and n_out >= 3 then u else cast('nan' as double) end as u,
    cast((select t from tie) as double) as ties, round(median_in, 6) as median_in, round(coalesce(median_out, 0), 6) as median_out from u left join mo on u.set_name = mo.set_name""",
)
def _(t: Tables):
    out = en.mann_whitney(_sets(t), en.gene_hit_density(_gene_hits(t)))
    return shown(out.drop("mw_p"))


# the normal tail as 1 minus a series of positive terms; far out, where that series needs more
# terms and leaves less than its rounding, by the asymptotic one
RANK_P = f"""{VALUES}, z as (select u.set_name, n_in, n_out, case when n_in >= 3 and n_out >= 3 then u else cast('nan' as double) end as u, median_in, coalesce(median_out, 0) as median_out,
  (greatest(u, n_in * n_out - u) - n_in * n_out / 2 - 0.5) / sqrt(2 * n_in * n_out / 12 * (n_in + n_out + 1 - (select t from tie) / ((n_in + n_out) * (n_in + n_out - 1)))) as x
  from u left join mo on u.set_name = mo.set_name),
 pv as (select set_name, n_in, n_out, u, median_in, median_out, case when n_in < 3 or n_out < 3 then cast('nan' as double) when x <= 0 then 1.0
  when x > 6 then exp(-x * x) / (x * sqrt(pi())) * (1 - 1 / (2 * x * x) + 3 / (4 * x * x * x * x)) else
  1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda k: exp(k * ln(4.0) + lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(x) - x * x))) end as mw_p from z)"""


@query("rank_test_pvalues", f"with {RANK_P} select set_name, n_in, n_out, u, round(median_in, 6) as median_in, round(median_out, 6) as median_out, round(mw_p, 6) as mw_p from pv")
def _(t: Tables):
    return shown(en.mann_whitney(_sets(t), en.gene_hit_density(_gene_hits(t))).drop("ties"))


# any column in (0, 1] serves as p-values: here the evalue of each hit
PVAL = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber = 7 then cast('nan' as double) else evalue end as p from hits) h"


def _pvalues(t: Tables) -> DataFrame:
    p = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("evalue"))
    return t.hits.select(*KEYS, p.alias("p"))


@query(
    "false_discovery_rates",
    f"""with c as (select {K}, case when isnan(p) then 1 else p end as p from {PVAL}), n as (select *, count(*) over () as m, row_number() over (order by p) as i from c),
    q as (select *, least(1, min(p * m / i) over (order by i desc rows unbounded preceding)) as q from n)
    select {K}, round(min(q) over (partition by p), 9) as q from q""",
)
def _(t: Tables):
    return shown(en.bh_adjust(_pvalues(t), "p").drop("p"), 9)


@query("bonferroni_corrections", f"select {K}, round(least(evalue * (select count(*) from hits), 1), 6) as q from hits")
def _(t: Tables):
    return shown(en.bonferroni(t.hits.select(*KEYS, F.col("evalue").alias("p")), "p").drop("p"))


def _enriched(t: Tables) -> DataFrame:
    gene_hits = stage(_gene_hits(t), "gene-hits")
    return en.enrichment(t.gene_sets, gene_hits, positives=gene_hits.where(POSITIVE))


def _bh(source: str, p: str, q: str) -> str:
    """Step-up q-values of a column; equal p-values share theirs, a missing one counts as 1."""
    clean = f"case when {p} is null or isnan({p}) then 1 else {p} end"
    return f"""(select * exclude (_p, _raw), least(1, min(_raw) over (order by _p desc)) as {q} from
     (select *, _p * count(*) over () / count(*) over (order by _p) as _raw from (select *, {clean} as _p from {source}) x1) x2)"""


CATEGORY = "case when starts_with(set_name, 'expr_') then 'expression' when starts_with(set_name, 'go_') then 'go' else 'other' end"
# sets of at least five genes with both tests and their q-values
TESTED = f"""with {METRICS}, {FISHER.split(f'{SETS}, ', 1)[1]}, {RANK_P.split(f'{SETS}, ', 1)[1]},
 every as (select sm.*, a, b, c, d, odds_ratio, fisher_p, pv.u, median_in, median_out, mw_p, {CATEGORY.replace('set_name', 'sm.set_name')} as category
  from sm join ora using (set_name) join fi using (set_name) left join pv using (set_name) where n_genes >= 5),
 tested as (select * from {_bh(_bh('every', 'fisher_p', 'fisher_q'), 'mw_p', 'mw_q')} y)"""
BY_CATEGORY = """select category, count(*) as n_sets, round(avg(mean_density), 6) as mean_density, count(*) filter (where fisher_q < 0.05 and odds_ratio > 1) as sig_enriched,
    count(*) filter (where fisher_q < 0.05 and odds_ratio < 1) as sig_depleted from tested group by 1"""


@query(
    "gene_set_enrichment",
    TESTED
    + """ select set_name, n_genes, n_with_hits, total_hits, total_utr_len, round(mean_density, 6) as mean_density, round(median_density, 6) as median_density, round(pct_with_hits, 6) as pct_with_hits,
    round(sense_pct, 6) as sense_pct, a, b, c, d, round(odds_ratio, 6) as odds_ratio, round(fisher_p, 6) as fisher_p, u, round(median_in, 6) as median_in, round(median_out, 6) as median_out,
    round(mw_p, 6) as mw_p, category, round(fisher_q, 6) as fisher_q, round(mw_q, 6) as mw_q from tested""",
)
def _(t: Tables):
    return shown(_enriched(t))


@query("enrichment_categories", TESTED + BY_CATEGORY)
def _(t: Tables):
    """The 2x2 test alone, without the rank test."""
    sets = en.usable_sets(_sets(t), _universe(t))
    tested = en.bh_adjust(en.fisher_exact(_table(t)).join(sets.select("set_name").distinct(), "set_name", "left_semi"), "fisher_p", "fisher_q")
    both = en.set_metrics(sets, _gene_hits(t)).join(tested, "set_name")
    return shown(en.enrichment_by_category(both.withColumn("category", set_category(F.col("set_name")))))


@query("enrichment_categories_tested", TESTED + BY_CATEGORY)
def _(t: Tables):
    return shown(en.enrichment_by_category(_enriched(t)))


CAP = "case when odds_ratio = cast('inf' as double) then 100 when odds_ratio = 0 then 0.01 else odds_ratio end"


@query(
    "sets_by_odds_ratio",
    f"""with {TABLE}, l as (select set_name, log2({CAP}) as log2_or from ora where not isnan(odds_ratio)),
    r as (select *, row_number() over (order by log2_or desc, set_name) as hi, row_number() over (order by log2_or, set_name) as lo from l)
    select set_name, round(log2_or, 6) as log2_or, hi as rank, 'enriched' as side from r where hi <= 15 union all
    select set_name, round(log2_or, 6), lo, 'depleted' from r where lo <= 15""",
)
def _(t: Tables):
    scored = _table(t).withColumn("odds_ratio", st.odds_ratio("a", "b", "c", "d"))
    return shown(en.top_sets(scored, 15).select("set_name", "log2_or", "rank", "side"))


@query(
    "sets_by_density_per_category",
    f"""with {METRICS}, c as (select set_name, case when starts_with(set_name, 'expr_') then 'expression' when starts_with(set_name, 'go_') then 'go' else 'other' end as category, mean_density from sm)
    select category, set_name, round(mean_density, 6) as mean_density, row_number() over (partition by category order by mean_density desc, set_name) as rank from c qualify rank <= 10""",
)
def _(t: Tables):
    m = en.set_metrics(_sets(t), _gene_hits(t)).withColumn("category", set_category(F.col("set_name")))
    return shown(en.top_by_category(m, 10).select("category", "set_name", "mean_density", "rank"))


@query(
    "sets_by_importance",
    TESTED
    + """, i as (select set_name, round(fisher_q, 6) as fisher_q, -log10(greatest(fisher_q, 1e-200)) + abs(least(greatest(log2(case when odds_ratio = cast('inf' as double) then 100 else odds_ratio end), -10), 10)) as importance
     from tested where fisher_q < 0.05 and not isnan(odds_ratio) and odds_ratio > 0)
    select set_name, fisher_q, round(importance, 6) as importance, row_number() over (order by importance desc, set_name) as rank from i qualify rank <= 20""",
)
def _(t: Tables):
    top = en.top_by_importance(_enriched(t), 20)
    return shown(top.select("set_name", "fisher_q", "importance", "rank"))


@query(
    "effect_sizes",
    f"""with {TABLE} select set_name, round(case when not isnan(odds_ratio) then log2({CAP}) end, 6) as log2_capped,
    round(case when not isnan(odds_ratio) and odds_ratio > 0 then least(greatest(log2(case when odds_ratio = cast('inf' as double) then 100 else odds_ratio end), -10), 10) end, 6) as x,
    round(least(greatest(-log10(greatest(a / 1e6, 1e-200)), 0), 200), 6) as y,
    case when starts_with(set_name, 'expr_') then 'expression' when starts_with(set_name, 'go_') then 'go' else 'other' end as category from ora""",
)
def _(t: Tables):
    orat = st.odds_ratio("a", "b", "c", "d")
    return shown(
        _table(t).select(
            "set_name",
            st.log2_or_capped(orat).alias("log2_capped"),
            st.volcano_x(orat).alias("x"),
            st.volcano_y(F.col("a") / 1e6).alias("y"),
            set_category(F.col("set_name")).alias("category"),
        )
    )


@query(
    "set_labels",
    """select distinct set_name, case when starts_with(set_name, 'go_') then concat('Go: ', upper(substr(s, 4, 1)), substr(s, 5, position(' ' in substr(s, 5))), upper(split_part(s, ' ', 3)))
    when starts_with(set_name, 'size_') then concat('Size ', substr(s, 6)) else concat(upper(substr(s, 6, 1)), substr(s, 7)) end as label from (select set_name, replace(set_name, '_', ' ') as s from gene_sets) x""",
)
def _(t: Tables):
    return t.gene_sets.select("set_name").distinct().withColumn("label", set_label(F.col("set_name")))


# ranks and regions ---------------------------------------------------------------------


@query(
    "ranked_gene_sets",
    f"""with {SETS}, d as ({DENSITY}), r as (select fbgn, density_bp_kb, row_number() over (order by density_bp_kb desc, fbgn) as rk, count(*) over () as n from d), g as ({BYG}),
    x as (select set_name, count(*) as n_genes, count(rk) as n_ranked, avg(100 * (n - rk + 1) / n) as p, avg(rk) as mr, avg(density_bp_kb) as md, avg(sense_pct) as s
     from ss left join r on ss.fbgn = r.fbgn left join g on ss.fbgn = g.fbgn group by 1)
    select set_name, n_genes, n_ranked, round(p, 6) as mean_percentile, round(mr, 6) as mean_rank, round(md, 6) as mean_density, round(s, 6) as mean_sense_pct,
    case when s > 65 then 'strong_sense' when s > 55 then 'sense' when s < 35 then 'strong_antisense' when s < 45 then 'antisense' else 'balanced' end as bias from x""",
)
def _(t: Tables):
    dens = rollups.gene_density(t.hits, t.transcripts)
    return shown(en.rank_gene_sets(_sets(t), dens, by_gene(t)))


# a hit is of a side when it covers bases of that segment of its transcript
FIVE_PRIME = "qstart <= utr5_len and qend >= 1"
THREE_PRIME = "qend > utr5_len + cds_len and qstart <= utr5_len + cds_len + utr3_len"


def _side_sql(cond: str) -> str:
    touching = f"(select h.* from hits h join transcripts x on h.qseqid = x.fbtr where {cond}) h"
    return BYG.replace("from hits group by qseqid", f"from {touching} group by qseqid")


def _side(t: Tables, cond: str) -> DataFrame:
    touching = rollups.segment_annotation(t.hits, t.transcripts).where(cond).select(t.hits.columns)
    return rollups.strand_bias_by_gene(rollups.strand_bias_by_query(touching, t.transcripts))


REG = f"""{SETS}, f as ({_side_sql(FIVE_PRIME)}), h as ({_side_sql(THREE_PRIME)}),
 rg as (select set_name, count(*) as n_genes, count(*) filter (where coalesce(f.total_hits, 0) > 0 or coalesce(h.total_hits, 0) > 0) as genes_with_hits,
 cast(coalesce(sum(f.total_hits), 0) as bigint) as utr5_hits, case when sum(f.total_hits) > 0 then 100 * sum(f.sense_hits) / sum(f.total_hits) else 0 end as s5,
 cast(coalesce(sum(h.total_hits), 0) as bigint) as utr3_hits, case when sum(h.total_hits) > 0 then 100 * sum(h.sense_hits) / sum(h.total_hits) else 0 end as s3,
 case when sum(h.total_hits) > 0 then coalesce(sum(f.total_hits), 0) / sum(h.total_hits) else 0 end as ratio from ss left join f on ss.fbgn = f.fbgn left join h on ss.fbgn = h.fbgn group by 1)"""


def _region_summary(t: Tables) -> DataFrame:
    return en.gene_set_region_summary(_sets(t), _side(t, "bp_utr5 > 0"), _side(t, "bp_utr3 > 0"))


@query(
    "gene_set_regions",
    f"""with {REG} select set_name, n_genes, genes_with_hits, utr5_hits, round(s5, 6) as utr5_sense_pct, utr3_hits, round(s3, 6) as utr3_sense_pct, round(ratio, 6) as ratio_5_3 from rg""",
)
def _(t: Tables):
    return shown(_region_summary(t))


@query(
    "gene_set_region_extremes",
    f"""with {REG} select (select set_name from rg order by s5 desc, set_name limit 1) as utr5_highest, (select set_name from rg order by s5, set_name limit 1) as utr5_lowest,
    (select set_name from rg order by s3 desc, set_name limit 1) as utr3_highest, (select set_name from rg order by s3, set_name limit 1) as utr3_lowest""",
)
def _(t: Tables):
    return en.region_extremes(_region_summary(t))


GF = "gf as (select fbgn, family, count(*) as hits from hits join transcripts on qseqid = fbtr join subjects on sseqid = te_id group by 1, 2)"


def _gene_family(t: Tables) -> DataFrame:
    per = t.hits.groupBy(F.col("qseqid").alias("fbtr"), F.col("sseqid").alias("te_id")).agg(F.count("*").alias("n"))
    return (
        per.join(t.transcripts.select("fbtr", "fbgn"), "fbtr")
        .join(t.subjects.select("te_id", "family"), "te_id")
        .groupBy("fbgn", "family")
        .agg(F.sum("n").alias("hits"))
    )


@query(
    "family_fold_by_set",
    f"""with {SETS}, {GF}, w as (select family, sum(hits) / (select sum(hits) from gf) as s from gf group by 1),
    i as (select set_name, family, cast(sum(hits) as bigint) as hits from ss join gf on ss.fbgn = gf.fbgn group by 1, 2), j as (select *, hits / sum(hits) over (partition by set_name) as share from i)
    select set_name, j.family, hits, round(share, 6) as share, round(share / s, 6) as fold from j join w on j.family = w.family""",
)
def _(t: Tables):
    return shown(en.family_fold_by_set(_sets(t), _gene_family(t)))


@query(
    "strand_share_by_set",
    f"""with {SETS}, g as ({BYG}) select set_name, cast(sum(total_hits) as bigint) as hits, round(100 * sum(sense_hits) / sum(total_hits), 6) as sense_pct,
    round(100 * sum(sense_hits) / sum(total_hits) - (select 100 * sum(sense_hits) / sum(total_hits) from g), 6) as delta from ss join g on ss.fbgn = g.fbgn group by 1""",
)
def _(t: Tables):
    return shown(en.strand_share_by_set(_sets(t), by_gene(t)))


@query(
    "cohort_family_contrast",
    f"""with {SETS}, {GF}, a as (select fbgn from ss where set_name = 'expr_medium' except select fbgn from ss where set_name = 'expr_small'),
    b as (select fbgn from ss where set_name = 'expr_small' except select fbgn from ss where set_name = 'expr_medium'),
    p as (select family, cast(coalesce(sum(hits) filter (where fbgn in (select fbgn from a)), 0) as bigint) as f, cast(coalesce(sum(hits) filter (where fbgn in (select fbgn from b)), 0) as bigint) as s
     from gf where fbgn in (select fbgn from a union select fbgn from b) group by family), q as (select *, 100 * f / sum(f) over () as fp, 100 * s / sum(s) over () as sp from p)
    select family, f as first_hits, s as second_hits, round(fp, 6) as first_pct, round(sp, 6) as second_pct, round(case when sp > 0 then fp / sp else cast('inf' as double) end, 6) as ratio from q""",
)
def _(t: Tables):
    # hits meet the genes of the cohorts first: the others are dropped and no gene is a group
    pair = "expr_medium", "expr_small"
    cohorts = t.transcripts.select(F.col("fbtr").alias("qseqid"), "fbgn").join(en.cohort_genes(t.gene_sets, *pair), "fbgn")
    hits = t.hits.select("qseqid", F.col("sseqid").alias("te_id")).join(cohorts.select("qseqid", "cohort"), "qseqid")
    per = hits.groupBy("cohort", "te_id").agg(F.count(F.lit(1)).alias("hits"))
    return shown(en.family_contrast(per.join(t.subjects.select("te_id", "family"), "te_id"), *pair))


# correlation and bias ------------------------------------------------------------------


@query(
    "identity_score_correlation",
    """select category, count(*) as n, round(corr(pident * length, score), 6) as r, case when corr(pident * length, score) > 0.1 then 'positive'
    when corr(pident * length, score) < -0.1 then 'negative' else 'none' end as verdict from synteny group by category""",
)
def _(t: Tables):
    rows = t.synteny.withColumn("quality", F.col("pident") * F.col("length"))
    return shown(en.pearson(rows, "quality", "score", ["category"]))


BIAS = """b as (select qseqid as k, count(*) as n, 100 * count(*) filter (where sstart < send) / count(*) as sp from hits group by 1 having count(*) >= 10),
 u as (select transcript as k, avg(score) as ms, 100 * count(*) filter (where any_coverage >= 0.5) / count(*) as ps from synteny group by 1)"""


@query(
    "score_by_bias_class",
    f"""with {BIAS}, c as (select case when sp >= 70 then 'sense' when sp <= 30 then 'antisense' else 'balanced' end as bias_class, ms, ps from b join u on b.k = u.k),
    m as (select bias_class, count(*) as units, avg(ms) as ms, avg(ps) as ps from c group by 1)
    select bias_class, units, round(ms, 6) as mean_score, round(ps, 6) as pct_syntenic, round(100 * (ms - (select ms from m where bias_class = 'antisense')) / (select ms from m where bias_class = 'antisense'), 6) as relative_diff_pct from m""",
)
def _(t: Tables):
    bias = rollups.hits_per_transcript(t.hits).select(
        F.col("fbtr").alias("transcript"), "total_hits", (100 * F.col("sense_hits") / F.col("total_hits")).alias("sense_pct")
    )
    return shown(rollups.bias_class_means(bias, t.synteny, "transcript"))


@query(
    "family_bias_and_score",
    f"""with s as ({BYS}), u as (select te_id, avg(score) as ms from synteny group by 1)
    select family, round(avg(sense_pct), 6) as mean_sense_pct, round(avg(ms), 6) as mean_score, count(*) as members, cast(sum(total_hits) as bigint) as hits
    from s join u on s.te_id = u.te_id join subjects j on j.te_id = s.te_id where total_hits >= 100 group by family having count(*) >= 3""",
)
def _(t: Tables):
    by_subject = rollups.strand_bias_by_subject(t.hits)
    return shown(rollups.family_bias_vs_score(by_subject, t.synteny, t.subjects))


# sweeps, quartiles, nulls --------------------------------------------------------------

COMBO = "concat(l_linenumber % 3 * 2 + 7, '_', l_suppkey % 4)"


def _combos(t: Tables) -> DataFrame:
    w, r = (F.col("l_linenumber") % 3 * 2 + 7), F.col("l_suppkey") % 4
    return t.hits.withColumns({"word_size": w, "scheme": r, "combo_id": F.concat_ws("_", w.cast("string"), r.cast("string"))})


SWEEP = f"""select {COMBO} as combo_id, count(*) as total_hits, count(*) filter (where sstart < send) as plus_hits, count(*) filter (where not (sstart < send)) as minus_hits,
 count(distinct qseqid) as unique_queries, count(distinct sseqid) as unique_subjects, round(avg(evalue), 9) as mean_evalue, round(min(evalue), 9) as min_evalue, round(avg(pident), 6) as mean_pident,
 round(avg(length), 6) as mean_length, count(*) filter (where evalue < 1) as hits_lt_1, count(*) filter (where evalue < 0.1) as hits_lt_0_1, count(*) filter (where evalue < 0.01) as hits_lt_0_01,
 round(count(*) filter (where sstart < send) / count(*) filter (where not (sstart < send)), 6) as strand_ratio, round(median(evalue), 9) as median_evalue from hits group by 1"""


@query("sweep_statistics", SWEEP.replace("pident), 6", "pident), 9").replace("length), 6", "length), 9").replace("send)), 6", "send)), 9"))
def _(t: Tables):
    return shown(rollups.sweep_stats(_combos(t)), 9)


@query(
    "sweep_pivot",
    f"""with c as (select l_linenumber % 3 * 2 + 7 as word_size, l_suppkey % 4 as scheme, count(*) as n from hits group by 1, 2)
    select word_size, {', '.join(f'round(avg(n) filter (where scheme = {i}), 6) as scheme_{i}' for i in range(4))} from c group by 1""",
)
def _(t: Tables):
    per = _combos(t).groupBy("word_size", "scheme").agg(F.count("*").alias("total_hits"))
    return shown(rollups.sweep_pivot(per, "word_size", "scheme", [0, 1, 2, 3]))


@query(
    "sweep_top_combos",
    f"""select {COMBO} as combo_id, count(*) as total_hits, row_number() over (order by count(*) desc, {COMBO}) as rank from hits group by 1 qualify rank <= 10""",
)
def _(t: Tables):
    per = _combos(t).groupBy("combo_id").agg(F.count("*").alias("total_hits"))
    return rollups.top_combos(per, 10)


@query(
    "score_quartiles_by_length",
    single_sql(
        """select cast(floor(length / 50) as bigint) as length_bin, round(min(score), 4) as q0, round(quantile_cont(score, 0.25), 4) as q1, round(median(score), 4) as q2,
    round(quantile_cont(score, 0.75), 4) as q3, round(max(score), 4) as q4 from hits group by 1"""
    ),
)
def _(t: Tables):
    from ..scale import quantiles

    binned = t.hits.select(F.floor(F.col("length") / 50).alias("length_bin"), "score")
    out = quantiles(binned, ["length_bin"], "score", {"q0": 0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1})
    return single(out)


NULLS = ["total_hits", "hits_hq", "mean_pident"]


@query(
    "null_comparison",
    """with r as (select l_suppkey % 10 as rep, count(*) as total_hits, count(*) filter (where pident >= 80 and length >= 50) as hits_hq, avg(pident) as mean_pident from hits where dataset <> 'A' group by 1),
    o as (select count(*) as total_hits, count(*) filter (where pident >= 80 and length >= 50) as hits_hq, avg(pident) as mean_pident from hits where dataset = 'A'),
    x as (select 'total_hits' as metric, (select total_hits from o) as "real", avg(total_hits) as m, stddev_samp(total_hits) as s from r union all
     select 'hits_hq', (select hits_hq from o), avg(hits_hq), stddev_samp(hits_hq) from r union all select 'mean_pident', (select mean_pident from o), avg(mean_pident), stddev_samp(mean_pident) from r)
    select metric, round("real", 6) as "real", round(m, 6) as null_mean, round(s, 6) as null_sd, round("real" / m, 6) as fold, round(("real" - m) / s, 6) as z, round(100 * m / "real", 6) as pct_composition from x""",
)
def _(t: Tables):
    reps = t.hits.where("dataset <> 'A'").withColumn("rep", F.col("l_suppkey") % 10)
    real = ht.hit_statistics(t.hits.where("dataset = 'A'"))
    return shown(en.null_comparison(real, ht.hit_statistics(reps, ["rep"]), NULLS))
