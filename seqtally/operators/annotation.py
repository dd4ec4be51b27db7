"""Gene annotation assembly and gene sets built from it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ASPECT_NAMES, localization_categories, set_category
from ..scale import skew_join
from .compare import gene_universe


# Thresholds of the expression sets.
HIGH, MEDIUM, RATIO = 10.0, 1.0, 2.0
UBIQUITOUS_TISSUES, UBIQUITOUS_RPKM = 5, 5.0
# Tissue -> substrings of sample names.
TISSUE_PATTERNS = {
    "ovary": ["ovary", "ovar"],
    "testis": ["testis", "teste"],
    "embryo_early": ["embryo_0", "embryo_2", "em0_2", "em2_4"],
    "embryo_mid": ["embryo_4", "embryo_6", "embryo_8", "em4_6", "em6_8", "em8_10"],
    "embryo_late": [
        "embryo_10", "embryo_12", "embryo_14", "embryo_16", "embryo_18", "embryo_20",
    ],
    "head": ["head"],
    "carcass": ["carcass"],
    "larva": ["larva", "l3_", "_l3", "l1_", "l2_"],
    "fat_body": ["fat", "fatbody"],
    "digestive": ["digestive", "dig_", "midgut", "hindgut", "crop"],
    "cns": ["cns", "brain", "neuron", "neuroblast"],
    "salivary": ["saliv", "salivary"],
    "accessory_gland": ["accessory", "acc_gland"],
}
# Set name -> ontology ids.
GO_CATEGORIES = {
    "rna_binding": ["GO:0003723", "GO:0000166"],
    "dna_binding": ["GO:0003677", "GO:0003700", "GO:0043565"],
    "kinase": ["GO:0016301", "GO:0004672", "GO:0004674"],
    "phosphatase": ["GO:0016791", "GO:0004721"],
    "helicase": ["GO:0004386", "GO:0008026"],
    "protease": ["GO:0008233", "GO:0004175"],
    "transcription": ["GO:0006355", "GO:0006351", "GO:0045944"],
    "translation": ["GO:0006412", "GO:0006414"],
    "rna_processing": ["GO:0006396", "GO:0006397", "GO:0008380"],
    "cell_cycle": ["GO:0007049", "GO:0000278", "GO:0051301"],
    "dna_repair": ["GO:0006281", "GO:0006974"],
    "transport": ["GO:0006810", "GO:0015031"],
    "signaling": ["GO:0007165", "GO:0023052"],
    "development": ["GO:0007275", "GO:0009790"],
    "apoptosis": ["GO:0006915", "GO:0008219"],
    "chromatin": ["GO:0006325", "GO:0016568"],
    "nucleus": ["GO:0005634", "GO:0005654"],
    "cytoplasm": ["GO:0005737", "GO:0005829"],
    "mitochondria": ["GO:0005739", "GO:0005743"],
    "er": ["GO:0005783", "GO:0005789"],
    "golgi": ["GO:0005794"],
    "membrane": ["GO:0016020", "GO:0005886"],
    "ribosome": ["GO:0005840", "GO:0022626"],
    "centrosome": ["GO:0005813", "GO:0000793"],
}
# Set name -> substrings of localization terms.
LOCALIZATION_SETS = {
    "maternal": ["maternal"],
    "zygotic": ["zygotic"],
    "ubiquitous": ["ubiquitous"],
    "localized": ["localized"],
    "cytoplasmic_foci": ["cytoplasmic foci", "foci"],
    "perinuclear": ["perinuclear"],
    "apical": ["apical enrichment", "apical localization", "apical exclusion"],
    "basal": ["basal enrichment", "basal localization"],
    "membrane": ["membrane associated"],
    "pole_cell": ["pole cell localization", "pole cell enrichment", "pole plasm"],
    "yolk_plasm": ["yolk plasm localization", "yolk plasm enrichment", "yolk cortex"],
    "posterior": ["posterior localization"],
    "blastoderm_nuclei": ["blastoderm nuclei"],
    "ectoderm": ["ectoderm"],
    "mesoderm": ["mesoderm"],
    "nervous_system": ["nervous system", "cns", "brain", "ventral nerve cord"],
}
# Annotation-table columns and the sample-name substrings that fill them.
KEY_TISSUES = [
    ("ovary_rpkm", ["ovary"]),
    ("testis_rpkm", ["testis"]),
    ("embryo_0_2h_rpkm", ["embryo_0_2", "em0_2"]),
    ("embryo_2_4h_rpkm", ["embryo_2_4", "em2_4"]),
    ("embryo_4_6h_rpkm", ["embryo_4_6", "em4_6"]),
    ("embryo_6_8h_rpkm", ["embryo_6_8", "em6_8"]),
    ("embryo_8_10h_rpkm", ["embryo_8_10", "em8_10"]),
    ("embryo_10_12h_rpkm", ["embryo_10_12", "em10_12"]),
    ("embryo_12_14h_rpkm", ["embryo_12_14", "em12_14"]),
    ("embryo_14_16h_rpkm", ["embryo_14_16", "em14_16"]),
    ("embryo_16_18h_rpkm", ["embryo_16_18", "em16_18"]),
    ("embryo_18_20h_rpkm", ["embryo_18_20", "em18_20"]),
    ("embryo_20_22h_rpkm", ["embryo_20_22", "em20_22"]),
    ("embryo_22_24h_rpkm", ["embryo_22_24", "em22_24"]),
    ("head_rpkm", ["_head", "adult_head", "female_head", "male_head"]),
    ("carcass_rpkm", ["carcass"]),
    ("digestive_rpkm", ["digestive", "dig_sys", "midgut"]),
    ("salivary_rpkm", ["salivary", "saliv"]),
    ("accessory_gland_rpkm", ["accessory_gland", "acc_gland"]),
    ("fat_body_rpkm", ["fat_body", "fatbody", "_fat"]),
    ("l1_rpkm", ["l1_", "_l1"]),
    ("l2_rpkm", ["l2_", "_l2"]),
    ("l3_rpkm", ["l3_", "_l3", "larva3"]),
    ("wandering_l3_rpkm", ["wandering", "wand"]),
    ("cns_rpkm", ["cns", "brain"]),
    ("neuron_rpkm", ["neuron"]),
    ("pupae_rpkm", ["pupae", "pupa"]),
    ("prepupae_rpkm", ["prepupae", "wpp"]),
]


def select_tissues(names: Sequence[str], few: int = 10, fill_to: int = 25) -> list[tuple[str, str]]:
    """(sample, column) pairs: for each key tissue the first unused sample that matches.

    With fewer than `few` matches the remaining samples are added in name order. Works on
    column names only, so it runs on the driver.
    """
    chosen: dict[str, str] = {}
    for column, marks in KEY_TISSUES:
        free = (n for n in names if n not in chosen and any(m in n.lower() for m in marks))
        hit = next(free, None)
        if hit is not None:
            chosen[hit] = column
    if len(chosen) < few:
        for n in sorted(names):
            if len(chosen) >= fill_to:
                break
            if n not in chosen and f"{n}_rpkm" not in chosen.values():
                chosen[n] = f"{n}_rpkm"
    return list(chosen.items())


def candidate_samples(expression: DataFrame, fill_to: int = 25) -> DataFrame:
    """Sample names (tissue) that `select_tissues` can choose: for each key tissue as many of the
    first matching names as there are key tissues, and the first names of all. At most
    len(KEY_TISSUES) ** 2 + len(KEY_TISSUES) + fill_to rows, however many samples there are."""
    names = expression.select("tissue").where("tissue is not null").distinct()
    keys = F.array(*[F.when(_matches(F.col("tissue"), marks), F.lit(i)) for i, (_, marks) in enumerate(KEY_TISSUES)])
    hits = names.select("tissue", F.explode(F.array_compact(keys)).alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("tissue"))
    first = hits.withColumn("_r", rank).where(F.col("_r") <= len(KEY_TISSUES)).select("tissue")
    return first.unionByName(names.orderBy("tissue").limit(fill_to + len(KEY_TISSUES))).distinct()


def tissue_columns(expression: DataFrame) -> DataFrame:
    """(column_name, tissue, genes) of the selected samples."""
    names = sorted(r[0] for r in candidate_samples(expression).collect())  # bounded, see there
    pairs = [F.struct(F.lit(t).alias("tissue"), F.lit(c).alias("column_name")) for t, c in select_tissues(names)]
    if not pairs:
        return expression.where("false").select(F.lit("").alias("column_name"), "tissue", F.lit(0).cast("long").alias("genes"))
    chosen = expression.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    counts = expression.groupBy("tissue").agg(F.count("*").alias("genes"))
    return counts.join(chosen, "tissue").select("column_name", "tissue", "genes")


def go_by_aspect(go: DataFrame, aspect: str) -> DataFrame:
    """Sorted distinct ontology ids per gene for one aspect code."""
    return (
        go.where(F.upper("aspect") == aspect.upper())
        .groupBy("fbgn")
        .agg(F.array_sort(F.collect_set("go_id")).alias("go_ids"))
    )


def annotation_table(
    expression: DataFrame,
    go: DataFrame,
    localization: DataFrame,
    groups: DataFrame,
    tissues: Sequence[tuple[str, str]],
) -> DataFrame:
    """One row per gene seen anywhere: expression columns (0.0 default), ontology ids per
    aspect, localization terms and categories, groups."""
    exp = expression.groupBy("fbgn").agg(
        *[F.max(F.when(F.col("tissue") == t, F.col("rpkm"))).alias(c) for t, c in tissues]
    )

    def ids(code: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.upper("aspect") == code, F.col("go_id"))))

    terms = go.groupBy("fbgn").agg(ids("F").alias("go_mf"), ids("P").alias("go_bp"), ids("C").alias("go_cc"))
    loc = localization.groupBy("fbgn").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("patterns"))
    grp = groups.groupBy("fbgn").agg(F.array_sort(F.collect_set("group_name")).alias("gene_groups"))
    out = gene_universe(expression, go, localization, groups)
    for side in (exp, terms, loc, grp):
        out = out.join(side, "fbgn", "left")
    empty = F.array().cast("array<string>")
    lists = ["go_mf", "go_bp", "go_cc", "patterns", "gene_groups"]
    return (
        out.withColumns({c: F.coalesce(c, F.lit(0.0)) for _, c in tissues})
        .withColumns({c: F.coalesce(c, empty) for c in lists})
        .withColumn("categories", localization_categories(F.col("patterns")))
    )


def annotation_summary(
    expression: DataFrame, go: DataFrame, localization: DataFrame, groups: DataFrame
) -> DataFrame:
    """One row: genes overall and per source, annotations per aspect, groups, tissues."""
    sources = {"expression": expression, "go": go, "localization": localization, "groups": groups}
    tagged = reduce(
        DataFrame.unionByName,
        [df.select("fbgn", F.lit(name).alias("source")).distinct() for name, df in sources.items()],
    )
    per_gene = tagged.groupBy("fbgn").agg(F.collect_set("source").alias("s"))
    genes = per_gene.agg(
        F.count("*").alias("total_genes"),
        *[
            F.count_if(F.array_contains("s", name)).alias(f"genes_with_{name}")
            for name in ("expression", "go", "localization")
        ],
    )
    aspects = go.agg(
        F.struct(*[F.count_if(F.upper("aspect") == a).alias(n) for a, n in ASPECT_NAMES.items()])
    ).scalar()
    return genes.withColumn("_a", aspects).select(
        *genes.columns,
        *[F.col(f"_a.{n}").alias(f"go_{n}") for n in ASPECT_NAMES.values()],
        groups.agg(F.count_distinct("group_name")).scalar().alias("gene_groups"),
        expression.agg(F.count_distinct("tissue")).scalar().alias("unique_tissues"),
    )


def _matches(column: Column, marks: Sequence[str]) -> Column:
    """True when the column contains one of the texts, any case; they are no patterns."""
    return reduce(lambda a, b: a | b, [F.lower(column).contains(m) for m in marks], F.lit(False))


def expression_sets(
    expression: DataFrame, patterns: dict[str, list[str]] | None = None, universe: DataFrame | None = None
) -> DataFrame:
    """All expression-based sets in long form (set_name, fbgn), from one pass per gene.

    expression: fbgn, tissue, rpkm with one row per pair. universe: all genes (fbgn); those
    with expression by default. A gene without a row for a tissue has level 0 there, so means
    run over all tissues that match. Per tissue: high (>= 10) and enriched (>= 1 and >= twice
    the gene's mean); plus ubiquitous, low, ovary/testis specific and maternal.
    """
    patterns = patterns or TISSUE_PATTERNS
    t, v = F.col("tissue"), F.col("rpkm")
    # a sample name can count as head and as carcass; both lists are averaged together
    lists = {
        **{name: [m] for name, m in patterns.items()},
        "_mean": None,
        "_ovary": [["ovary"]],
        "_testis": [["testis"]],
        "_somatic": [["head"], ["carcass"]],
        "_early": [["embryo_0", "embryo_2", "em0_2", "em2_4"]],
        "_late": [["larva", "l3_", "adult"]],
    }

    def times(marks) -> Column:
        """How often a tissue counts in a list."""
        return F.lit(1) if marks is None else sum((_matches(t, m).cast("int") for m in marks), F.lit(0))

    tissues = expression.select("tissue").where("tissue is not null").distinct()
    counts = tissues.agg(*[F.sum(times(m)).alias(name) for name, m in lists.items()]).first().asDict()
    sums = expression.groupBy("fbgn").agg(
        F.max(v).alias("_max"),
        F.count_if(v >= UBIQUITOUS_RPKM).alias("_wide"),
        *[F.sum(v * times(m)).alias(name) for name, m in lists.items()],
    )
    if universe is not None:
        sums = universe.select("fbgn").distinct().join(sums, "fbgn", "left").fillna(0)
    means = {name: F.col(name) / F.lit(float(n)) if (n := counts[name]) else F.lit(None).cast("double") for name in lists}
    levels = sums.withColumns(means)
    c = F.col
    rules: dict[str, Column] = {}
    for name in patterns:
        rules[f"expr_{name}_high"] = c(name) >= HIGH
        rules[f"expr_{name}_enriched"] = (c(name) >= MEDIUM) & (c(name) >= RATIO * c("_mean"))
    rules["expr_ubiquitous"] = c("_wide") >= UBIQUITOUS_TISSUES
    rules["expr_low"] = c("_max") < MEDIUM
    rules["expr_ovary_specific"] = (c("_ovary") >= HIGH) & (c("_ovary") >= 5 * (c("_somatic") + 0.1))
    rules["expr_testis_specific"] = (c("_testis") >= HIGH) & (c("_testis") >= 5 * (c("_somatic") + 0.1))
    rules["expr_maternal"] = (c("_early") >= HIGH) & (c("_early") >= 3 * (c("_late") + 0.1))
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return levels.select(F.explode(named).alias("set_name"), "fbgn")


def go_sets(go: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Genes with any listed id, per category, in long form."""
    categories = categories or GO_CATEGORIES
    named = F.array_compact(
        F.array(*[F.when(F.col("go_id").isin(ids), F.lit(f"go_{k}")) for k, ids in categories.items()])
    )
    return go.select(F.explode(named).alias("set_name"), "fbgn").distinct()


def localization_sets(localization: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Genes with any matching term, per category, plus the set of all annotated genes."""
    categories = categories or LOCALIZATION_SETS
    names = [F.when(_matches(F.col("term"), m), F.lit(f"flyfish_{k}")) for k, m in categories.items()]
    names.append(F.when(F.col("term") != "", F.lit("flyfish_any")))
    return localization.select(F.explode(F.array_compact(F.array(*names))).alias("set_name"), "fbgn").distinct()


def group_set_name(group: Column) -> Column:
    """group_ plus the lower-cased name with blanks and hyphens as underscores, rest dropped."""
    return F.concat(F.lit("group_"), F.regexp_replace(F.translate(F.lower(group), " -", "__"), "[^a-z0-9_]", ""))


def group_sets(groups: DataFrame, min_genes: int = 10, max_genes: int = 2000) -> DataFrame:
    """Gene groups of moderate size as sets."""
    members = groups.select("group_name", "fbgn").distinct()
    sized = members.groupBy("group_name").agg(F.count("*").alias("_n"))
    kept = sized.where(F.col("_n").between(min_genes, max_genes)).select("group_name")
    return members.join(kept, "group_name", "left_semi").select(
        group_set_name(F.col("group_name")).alias("set_name"), "fbgn"
    )


def set_summary(sets: DataFrame, min_genes: int = 10, max_genes: int = 5000) -> DataFrame:
    """Sets inside the size limits with their size and category."""
    return (
        sets.select("set_name", "fbgn")
        .distinct()
        .groupBy("set_name")
        .agg(F.count("*").alias("n_genes"))
        .where(F.col("n_genes").between(min_genes, max_genes))
        .withColumn("category", set_category(F.col("set_name")))
    )


def curated_list(rows: DataFrame, tier: int | None = None) -> DataFrame:
    """Distinct curated genes (symbol, fbgn, full_name, tier, description, source)."""
    cols = ["symbol", "fbgn", "full_name", "tier", "description", "source"]
    out = rows.select(*cols).distinct()
    return out if tier is None else out.where(F.col("tier") == tier)


def resolve_alias(df: DataFrame, alias_map: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Add fbgn: exact match, else without parentheses, else that in capitals, else the
    cleaned symbol itself. alias_map: alias (unique), fbgn."""
    clean = F.trim(F.regexp_replace(F.col(symbol), "[ \t]*[(][^)]+[)]", ""))
    steps = {"_a1": F.col(symbol), "_a2": clean, "_a3": F.upper(clean)}
    out = df.withColumns(steps)
    for i in (1, 2, 3):
        out = skew_join(out, alias_map.select(F.col("alias").alias(f"_a{i}"), F.col("fbgn").alias(f"_f{i}")), [f"_a{i}"], "left")
    return out.withColumn("fbgn", F.coalesce("_f1", "_f2", "_f3", "_a2")).drop(*[f"_{k}{i}" for k in "af" for i in (1, 2, 3)])
