"""Annotation tables, gene sets built from them, and group catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import annotation as an
from ..operators import compare
from .registry import query
from .shape import shown
from .views import Tables


@query(
    "selected_tissues",
    # the five samples here match one key tissue each
    """with n as (select tissue, count(*) as genes from expression group by 1)
    select case tissue when 'adult_ovary' then 'ovary_rpkm' when 'testis_4d' then 'testis_rpkm' when 'embryo_0_2hr' then 'embryo_0_2h_rpkm' when 'adult_head' then 'head_rpkm'
     when 'larva3_fat_body' then 'fat_body_rpkm' end as column_name, tissue, genes from n""",
)
def _(t: Tables):
    return an.tissue_columns(t.expression)


@query(
    "annotation_table",
    """with u as (select fbgn from expression union select fbgn from go union select fbgn from localization union select fbgn from gene_groups),
    e as (select fbgn, max(rpkm) filter (where tissue = 'adult_ovary') as o, max(rpkm) filter (where tissue = 'adult_head') as h from expression group by 1),
    g as (select fbgn, string_agg(distinct go_id, ',' order by go_id) filter (where upper(aspect) = 'F') as mf, string_agg(distinct go_id, ',' order by go_id) filter (where upper(aspect) = 'P') as bp,
     string_agg(distinct go_id, ',' order by go_id) filter (where upper(aspect) = 'C') as cc from go group by 1),
    l as (select fbgn, string_agg(distinct lower(term), ',' order by lower(term)) as p from localization group by 1),
    r as (select fbgn, string_agg(distinct group_name, ',' order by group_name) as gg from gene_groups group by 1)
    select u.fbgn, coalesce(o, 0) as ovary_rpkm, coalesce(h, 0) as head_rpkm, coalesce(mf, '') as go_mf, coalesce(bp, '') as go_bp, coalesce(cc, '') as go_cc, coalesce(p, '') as patterns, coalesce(gg, '') as gene_groups
    from u left join e on u.fbgn = e.fbgn left join g on u.fbgn = g.fbgn left join l on u.fbgn = l.fbgn left join r on u.fbgn = r.fbgn""",
)
def _(t: Tables):
    tissues = [("adult_ovary", "ovary_rpkm"), ("adult_head", "head_rpkm")]
    out = an.annotation_table(t.expression, t.go, t.localization, t.gene_groups, tissues)
    return shown(out.drop("categories"))


def _category_sql() -> str:
    parts = []
    for name, words in sorted(names.LOCALIZATION_KEYWORDS.items()):
        test = " or ".join(f"contains(p, '{w}')" for w in words)
        parts.append(f"case when bool_or({test}) then '{name}' end")
    return f"select fbgn, concat_ws(',', {', '.join(parts)}) as categories from (select fbgn, lower(term) as p from localization) l group by fbgn"


@query("localization_categories", _category_sql())
def _(t: Tables):
    terms = t.localization.groupBy("fbgn").agg(F.collect_set("term").alias("terms"))
    return shown(terms.select("fbgn", names.localization_categories(F.col("terms")).alias("categories")))


@query(
    "go_process_ids",
    "select fbgn, string_agg(distinct go_id, ',' order by go_id) as go_ids from go where upper(aspect) = 'P' group by fbgn",
)
def _(t: Tables):
    return shown(an.go_by_aspect(t.go, "p"))


@query(
    "go_aspect_names",
    """select case upper(aspect) when 'F' then 'molecular_function' when 'P' then 'biological_process' when 'C' then 'cellular_component' else 'unknown' end as aspect,
    count(*) as annotations, count(distinct fbgn) as genes from go group by 1""",
)
def _(t: Tables):
    named = t.go.withColumn("aspect", names.aspect_name(F.col("aspect")))
    return named.groupBy("aspect").agg(F.count("*").alias("annotations"), F.count_distinct("fbgn").alias("genes"))


@query(
    "annotation_summary",
    """select (select count(*) from (select fbgn from expression union select fbgn from go union select fbgn from localization union select fbgn from gene_groups) u) as total_genes,
    (select count(distinct fbgn) from expression) as genes_with_expression, (select count(distinct fbgn) from go) as genes_with_go, (select count(distinct fbgn) from localization) as genes_with_localization,
    (select count(*) from go where upper(aspect) = 'F') as go_molecular_function, (select count(*) from go where upper(aspect) = 'P') as go_biological_process,
    (select count(*) from go where upper(aspect) = 'C') as go_cellular_component, (select count(distinct group_name) from gene_groups) as gene_groups, (select count(distinct tissue) from expression) as unique_tissues""",
)
def _(t: Tables):
    return an.annotation_summary(t.expression, t.go, t.localization, t.gene_groups)


def _like(marks) -> str:
    return "(" + " or ".join(f"contains(lower(tissue), '{m}')" for m in marks) + ")"


def _expr_sql() -> str:
    cols, rules = [], []
    for name, marks in an.TISSUE_PATTERNS.items():
        cols.append(f"avg(rpkm) filter (where {_like(marks)}) as t_{name}")
        rules.append(f"case when t_{name} >= 10 then 'expr_{name}_high' end")
        rules.append(f"case when t_{name} >= 1 and t_{name} >= 2 * m then 'expr_{name}_enriched' end")
    rules += [
        "case when wide >= 5 then 'expr_ubiquitous' end",
        "case when mx < 1 then 'expr_low' end",
        "case when o >= 10 and o >= 5 * (s + 0.1) then 'expr_ovary_specific' end",
        "case when te >= 10 and te >= 5 * (s + 0.1) then 'expr_testis_specific' end",
        "case when ea >= 10 and ea >= 3 * (la + 0.1) then 'expr_maternal' end",
    ]
    return f"""with u as (select fbgn from expression union select fbgn from go union select fbgn from localization union select fbgn from gene_groups),
    ts as (select distinct tissue from expression), full_table as (select u.fbgn, ts.tissue, coalesce(e.rpkm, 0) as rpkm from u cross join ts left join expression e on e.fbgn = u.fbgn and e.tissue = ts.tissue),
    l as (select fbgn, avg(rpkm) as m, max(rpkm) as mx, count(*) filter (where rpkm >= 5) as wide, {', '.join(cols)},
    avg(rpkm) filter (where {_like(['ovary'])}) as o, avg(rpkm) filter (where {_like(['testis'])}) as te, avg(rpkm) filter (where {_like(['head', 'carcass'])}) as s,
    avg(rpkm) filter (where {_like(['embryo_0', 'embryo_2', 'em0_2', 'em2_4'])}) as ea, avg(rpkm) filter (where {_like(['larva', 'l3_', 'adult'])}) as la from full_table group by fbgn)
    select set_name, fbgn from (select fbgn, unnest([{', '.join(rules)}]) as set_name from l) x where set_name is not null"""


@query("expression_gene_sets", _expr_sql())
def _(t: Tables):
    genes = compare.gene_universe(t.expression, t.go, t.localization, t.gene_groups)
    return an.expression_sets(t.expression, universe=genes)


def _go_sql() -> str:
    rows = ", ".join(f"('go_{k}', '{i}')" for k, ids in an.GO_CATEGORIES.items() for i in ids)
    return f"select distinct set_name, fbgn from go join (values {rows}) v(set_name, id) on go_id = id"


@query("go_gene_sets", _go_sql())
def _(t: Tables):
    return an.go_sets(t.go)


def _loc_sql() -> str:
    rows = ", ".join(f"('flyfish_{k}', '{m}')" for k, marks in an.LOCALIZATION_SETS.items() for m in marks)
    return f"""select distinct set_name, fbgn from localization join (values {rows}, ('flyfish_any', '')) v(set_name, mark) on contains(lower(term), mark) where term <> ''"""


@query("localization_gene_sets", _loc_sql())
def _(t: Tables):
    return an.localization_sets(t.localization)


@query(
    "group_gene_sets",
    """select concat('group_', regexp_replace(translate(lower(group_name), ' -', '__'), '[^a-z0-9_]', '', 'g')) as set_name, fbgn from gene_groups
    where group_name in (select group_name from gene_groups group by 1 having count(distinct fbgn) between 10 and 2000)""",
)
def _(t: Tables):
    return an.group_sets(t.gene_groups)


@query(
    "gene_set_summary",
    """select set_name, count(distinct fbgn) as n_genes, case when starts_with(set_name, 'expr_') then 'expression' when starts_with(set_name, 'go_') then 'go' else 'other' end as category
    from gene_sets group by 1 having count(distinct fbgn) between 10 and 5000""",
)
def _(t: Tables):
    return an.set_summary(t.gene_sets)


@query(
    "group_catalogue",
    "select group_name, count(distinct fbgn) as genes from gene_groups where contains(lower(group_name), 'brand#1') group by 1 having count(distinct fbgn) >= 10",
)
def _(t: Tables):
    return compare.list_groups(t.gene_groups, "BRAND#1", 10)


@query(
    "group_catalogue_by_size",
    """with g as (select group_name, count(distinct fbgn) as genes from gene_groups group by 1) select group_name, genes, row_number() over (order by genes desc, lower(group_name), group_name) as rank,
    round(avg(genes) over (), 6) as mean_genes from g""",
)
def _(t: Tables):
    return shown(compare.list_groups(t.gene_groups, sort_by="size"))


@query(
    "group_catalogue_by_name",
    """with g as (select group_name, count(distinct fbgn) as genes from gene_groups group by 1) select group_name, genes, row_number() over (order by lower(group_name), group_name) as rank,
    round(avg(genes) over (), 6) as mean_genes from g""",
)
def _(t: Tables):
    return shown(compare.list_groups(t.gene_groups, sort_by="name"))


@query(
    "group_catalogue_overview",
    "with g as (select group_name, count(distinct fbgn) as n from gene_groups group by 1) select count(*) as groups, round(avg(n), 6) as mean_genes, max(n) as largest from g",
)
def _(t: Tables):
    g = compare.list_groups(t.gene_groups)
    return shown(g.agg(F.count("*").alias("groups"), F.avg("genes").alias("mean_genes"), F.max("genes").alias("largest")))


CURATED = """select p_name as symbol, concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn, concat(p_name, ' gene') as full_name, p_size % 3 + 1 as tier,
 p_type as description, p_brand as source from part"""


@query("curated_tier", f"select distinct * from ({CURATED}) c where tier = 1")
def _(t: Tables):
    return an.curated_list(t.sql(CURATED), tier=1)


@query("gene_universe", "select fbgn from expression union select fbgn from go union select fbgn from gene_sets")
def _(t: Tables):
    return compare.gene_universe(t.expression, t.go, t.gene_sets)


@query("genes_without_expression", "select distinct fbgn from gene_sets where fbgn not in (select fbgn from expression)")
def _(t: Tables):
    return compare.missing_keys(t.gene_sets.select("fbgn").distinct(), t.expression, "fbgn")


ALIASES = """select alias, max(fbgn) as fbgn from (select p_name as alias, concat('gn', cast(p_partkey as string)) as fbgn from part where p_partkey % 5 = 1
 union all select upper(p_name), concat('gn', cast(p_partkey as string)) from part where p_partkey % 5 = 2) a group by alias"""
SYMBOLS = """select p_partkey, case p_partkey % 3 when 0 then p_name when 1 then concat(p_name, ' (RE', cast(p_partkey as string), ')') else upper(p_name) end as symbol from part"""


@query(
    "resolved_aliases",
    f"""with a as ({ALIASES}), s as (select *, trim(regexp_replace(symbol, '[ ]*[(][^)]+[)]', '', 'g')) as clean from ({SYMBOLS}) y)
    select p_partkey, symbol, coalesce(a1.fbgn, a2.fbgn, a3.fbgn, clean) as fbgn from s left join a a1 on a1.alias = symbol left join a a2 on a2.alias = clean left join a a3 on a3.alias = upper(clean)""",
)
def _(t: Tables):
    return an.resolve_alias(t.sql(SYMBOLS), t.sql(ALIASES))


def _clean_sql(name: str) -> str:
    def rep(text: str, pairs) -> str:
        for a, b in pairs:
            text = f"replace({text}, '{a}', '{b}')"
        return text

    mod = f"case when starts_with(b, 'mE_mRNA_') then {rep('b', names.MODENCODE_WORDS)} else b end"
    bcm = f"case when starts_with(m, 'BCM_') then {rep('m', names.BCM_WORDS)} else m end"
    cut = "c"
    for p in names.DROPPED_PREFIXES:
        cut = f"regexp_replace({cut}, '^{p}', '')"
    return f"""select distinct raw, case when contains(b, 'FlyAtlas2') then regexp_replace(lower(replace(replace(b, 'RNA-Seq_Profile_FlyAtlas2_', ''), '_', ' ')), '[ ]+', '_', 'g')
    else trim(regexp_replace(regexp_replace(regexp_replace(lower({cut}), '[,;: ]+', '_', 'g'), '-+', '_', 'g'), '_+', '_', 'g'), '_') end as clean
    from (select *, {bcm} as c from (select *, {mod} as m from (select raw, trim(regexp_replace(raw, '[(]FBlc[0-9]+[)]', '', 'g'), '_') as b from ({name}) r) x) y) z"""


RAW_TISSUES = """select concat(case p_partkey % 6 when 0 then 'mE_mRNA_A_MateF_4d_ovary_' when 1 then 'RNA-Seq_Profile_FlyAtlas2_Adult_Female_Ovary_' when 2 then 'BCM_1_E2-4hr_'
 when 3 then 'mE_mRNA_L3_CNS_' when 4 then 'modENCODE_mRNA-Seq_tissues: A,B_' else concat('Knoblich_mRNA_', p_name, '_') end, '(FBlc', cast(1000000 + p_partkey as string), ')') as raw from part"""


@query("clean_tissue_names", _clean_sql(RAW_TISSUES))
def _(t: Tables):
    return t.sql(RAW_TISSUES).distinct().withColumn("clean", names.clean_tissue(F.col("raw")))
