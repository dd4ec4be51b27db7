"""Names, classes, categories and labels parsed out of free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that decide the class of a family name, tried in this order.
LTR_MARKS = (
    "gypsy", "copia", "bel", "pao", "mdg", "roo", "412", "297", "blood", "accord", "tirant",
    "springer", "opus", "diver", "quasimodo", "idefix", "invader", "gtwin", "tabor", "stalker",
)
LINE_MARKS = (
    "jockey", "doc", "i-element", "f-element", "g-element", "x-element", "het-a", "tart",
    "tahre", "r1", "r2", "cr1", "rt1", "baggins", "juan", "ivk",
)
DNA_MARKS = (
    "p-element", "hobo", "pogo", "bari", "s-element", "transib", "tc1", "mariner", "piggybac",
    "helitron", "mite", "protop", "dnarep",
)
# Localization category -> keywords.
LOCALIZATION_KEYWORDS = {
    "apical": ["apical", "apico-lateral", "apical enrichment"],
    "basal": ["basal", "basal enrichment"],
    "posterior": ["posterior", "posterior pole", "pole plasm"],
    "anterior": ["anterior", "anterior pole"],
    "nuclear": ["nuclear", "nucleus", "perinuclear"],
    "cytoplasmic": ["cytoplasmic", "cytoplasm", "uniform cytoplasmic"],
    "membrane": ["membrane", "cortical", "plasma membrane"],
    "granular": ["granular", "punctate", "foci"],
}
# Ontology aspect codes.
ASPECT_NAMES = {
    "F": "molecular_function",
    "P": "biological_process",
    "C": "cellular_component",
}
# Gene-set name prefix -> category.
SET_PREFIXES = {
    "expr_": "expression",
    "go_": "go",
    "flyfish_": "flyfish",
    "group_": "gene_group",
}
# Literal replacements per sample naming scheme, in this order.
MODENCODE_WORDS = [
    ("mE_mRNA_", ""), ("_A_", "_adult_"), ("_L3_", "_larva3_"), ("_L1_", "_larva1_"),
    ("_L2_", "_larva2_"), ("MateF", "mated_female"), ("MateM", "mated_male"),
    ("VirF", "virgin_female"), ("AdF", "adult_female"), ("AdM", "adult_male"),
    ("_em", "_embryo_"), ("_dig_sys", "_digestive"), ("_acc_gland", "_accessory_gland"),
    ("_saliv", "_salivary"), ("_imag_disc", "_imaginal_disc"), ("_Wand_", "_wandering_"),
    ("_CNS", "_cns"), ("_WPP", "_white_prepupae"),
]
BCM_WORDS = [
    ("BCM_1_", ""), ("E2-4hr", "embryo_2_4hr"), ("E14-16hr", "embryo_14_16hr"),
    ("E2-16hr", "embryo_2_16hr"), ("L3i", "larva3"), ("P3d", "pupae_3d"),
    ("FA3d", "female_adult_3d"), ("MA3d", "male_adult_3d"),
]
DROPPED_PREFIXES = ["BCM_HGSC_", "modENCODE_", "Knoblich_mRNA_"]


def _any_of(words) -> str:
    return "|".join(words)


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def family_name(header: Column, mode: str = "instance") -> Column:
    """Family out of `name=...`; null when the header has none.

    instance: drop {...} and the digits after it; cut: keep what precedes the first brace;
    tail: drop everything from the first closed brace pair on.
    """
    raw = empty_to_null(F.regexp_extract(header, "name=([^;]+)", 1))
    if mode == "instance":
        return F.trim(F.regexp_replace(raw, "[{][^}]*[}][0-9]*", ""))
    if mode == "cut":
        return F.substring_index(F.split_part(raw, F.lit(" "), F.lit(1)), "{", 1)
    if mode == "tail":
        return F.regexp_replace(raw, "[{][^}]*[}].*", "")
    raise ValueError(f"unknown mode {mode}")


def family_class(name: Column) -> Column:
    """Ordered substring rules: LTR, LINE, DNA, SINE, then a bare ltr, else Unknown."""
    low = F.lower(name)
    return (
        F.when(low.rlike(_any_of(LTR_MARKS)), "LTR")
        .when(low.rlike(_any_of(LINE_MARKS)), "LINE")
        .when(low.rlike(_any_of(DNA_MARKS)), "DNA")
        .when(low.contains("sine") | low.startswith("ine-"), "SINE")
        .when(low.contains("ltr"), "LTR")
        .otherwise("Unknown")
    )


def split_class(header: Column) -> dict[str, Column]:
    """family#CLASS/Subclass in three columns; no # means Unknown and an empty subclass."""
    has = header.contains("#")
    rest = F.when(has, F.substring(header, F.instr(header, "#") + 1, F.length(header)))
    return {
        "family": F.substring_index(header, "#", 1),
        "te_class": F.when(has, F.substring_index(rest, "/", 1)).otherwise("Unknown"),
        "subclass": F.when(
            has & rest.contains("/"), F.substring(rest, F.instr(rest, "/") + 1, F.length(rest))
        ).otherwise(""),
    }


def consensus_family(name: Column) -> Column:
    """Instance name up to its {} mark."""
    return F.substring_index(name, "{}", 1)


def subject_token(sseqid: Column, underscore: bool = True) -> Column:
    """Text before `:`; with `underscore`, names without `:` are cut at `_` instead."""
    if not underscore:
        return F.substring_index(sseqid, ":", 1)
    return F.when(sseqid.contains(":"), F.substring_index(sseqid, ":", 1)).otherwise(
        F.substring_index(sseqid, "_", 1)
    )


def gene_token(qseqid: Column) -> Column:
    return F.substring_index(qseqid, "_", 1)


def gene_id_from_header(header: Column, prefix: str = "FBgn") -> Column:
    """First gene id anywhere in a header; null when there is none."""
    return empty_to_null(F.regexp_extract(header, f"({prefix}[0-9]+)", 1))


def symbol_from_transcript(name: Column) -> Column:
    return F.regexp_replace(name, "-R[A-Z]+$", "")


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_tissue(name: Column) -> Column:
    """One key per sample name, whatever naming scheme the sample came from."""
    base = F.btrim(F.regexp_replace(name, "[(]FBlc[0-9]+[)]", ""), F.lit("_"))
    atlas = F.lower(
        F.replace(
            F.replace(base, F.lit("RNA-Seq_Profile_FlyAtlas2_"), F.lit("")), F.lit("_"), F.lit(" ")
        )
    )
    atlas = F.regexp_replace(atlas, "[ \t\n]+", "_")
    other = F.when(base.startswith("mE_mRNA_"), _replace_all(base, MODENCODE_WORDS)).otherwise(base)
    other = F.when(other.startswith("BCM_"), _replace_all(other, BCM_WORDS)).otherwise(other)
    for prefix in DROPPED_PREFIXES:
        other = F.regexp_replace(other, f"^{prefix}", "")
    other = F.regexp_replace(F.lower(other), "[,;: \t\n]+", "_")
    other = F.btrim(F.regexp_replace(F.regexp_replace(other, "-+", "_"), "_+", "_"), F.lit("_"))
    return F.when(base.contains("FlyAtlas2"), atlas).otherwise(other)


def localization_categories(terms: Column) -> Column:
    """Sorted distinct categories whose keywords occur in any of the array's terms."""

    def any_term(words) -> Column:
        return F.exists(terms, lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in words]))

    found = [F.when(any_term(w), F.lit(c)) for c, w in LOCALIZATION_KEYWORDS.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def aspect_name(code: Column) -> Column:
    up = F.upper(code)
    out = F.lit("unknown")
    for key, name in ASPECT_NAMES.items():
        out = F.when(up == key, F.lit(name)).otherwise(out)
    return out


def set_category(set_name: Column) -> Column:
    out = F.lit("other")
    for prefix, category in SET_PREFIXES.items():
        out = F.when(set_name.startswith(prefix), F.lit(category)).otherwise(out)
    return out


def set_label(set_name: Column) -> Column:
    """Readable label: prefixes spelled out, underscores to blanks, words capitalised."""
    # Pieces of set names and how labels show them.
    pieces = [("expr_", ""), ("go_", "go: "), ("flyfish_", "flyfish: "), ("_", " ")]
    endings = [
        (" High", " (High Expr)"),
        (" Enriched", " (Tissue-Enriched)"),
        (" Specific", " (Tissue-Specific)"),
    ]
    return _replace_all(F.initcap(_replace_all(set_name, pieces)), endings)
