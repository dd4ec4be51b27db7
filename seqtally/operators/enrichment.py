"""Gene-set metrics, contingency and rank tests, multiple-testing correction, null models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.names import set_category
from ..scale import UNB, _range_parts, cumulative_counts, join_per_value, quantiles, stage, with_row_number
from .rollups import INF, pct, ratio_or_inf


def gene_hit_density(gene_hits: DataFrame) -> DataFrame:
    """Genes with hits and a length: fbgn, density_hits_kb."""
    return gene_hits.where((F.col("total_hits") > 0) & (F.col("total_utr_len") > 0)).select(
        "fbgn", (F.col("total_hits") / F.col("total_utr_len") * 1000).alias("density_hits_kb")
    )


def set_metrics(sets: DataFrame, gene_hits: DataFrame) -> DataFrame:
    """Per set: genes, with hits, share, hits, length, mean and median density, sense share.

    sets: set_name, fbgn (distinct). gene_hits: fbgn, total_hits, sense_hits, anti_hits,
    total_utr_len. Genes without data count as members without hits.
    """
    joined = sets.join(gene_hits, "fbgn", "left").withColumn(
        "_d",
        F.when(
            (F.col("total_hits") > 0) & (F.col("total_utr_len") > 0),
            F.col("total_hits") / F.col("total_utr_len") * 1000,
        ),
    )
    hits = F.coalesce(F.sum("total_hits"), F.lit(0))
    base = joined.groupBy("set_name").agg(
        F.count("*").alias("n_genes"),
        F.count_if(F.col("total_hits") > 0).alias("n_with_hits"),
        hits.alias("total_hits"),
        F.coalesce(F.sum("total_utr_len"), F.lit(0)).alias("total_utr_len"),
        F.coalesce(F.avg("_d"), F.lit(0.0)).alias("mean_density"),
        pct(F.sum("sense_hits"), hits, 50.0).alias("sense_pct"),
    )
    medians = quantiles(joined, ["set_name"], "_d", {"median_density": 0.5})
    return (
        base.join(medians, "set_name", "left")
        .withColumn("median_density", F.coalesce("median_density", F.lit(0.0)))
        .withColumn("pct_with_hits", pct(F.col("n_with_hits"), F.col("n_genes")))
    )


def contingency(sets: DataFrame, universe: DataFrame, positives: DataFrame) -> DataFrame:
    """2x2 counts per set: a in set and positive, b in set, c outside and positive, d outside.

    c and d come from the universe totals, so the complement is never built.
    """
    u = universe.select("fbgn").distinct()
    pos = positives.select("fbgn").distinct().withColumn("_p", F.lit(1))
    flagged = u.join(pos, "fbgn", "left")
    n = u.agg(F.count("*")).scalar()
    p = flagged.agg(F.count("_p")).scalar()
    return (
        sets.join(flagged, "fbgn")
        .groupBy("set_name")
        .agg(F.count("_p").alias("a"), F.count_if(F.col("_p").isNull()).alias("b"))
        .withColumn("c", p - F.col("a"))
        .withColumn("d", n - p - F.col("b"))
    )


def fisher_exact(table: DataFrame) -> DataFrame:
    """Add odds_ratio and fisher_p to a, b, c, d."""
    return table.withColumns(
        {"odds_ratio": st.odds_ratio("a", "b", "c", "d"), "fisher_p": st.fisher_pvalue("a", "b", "c", "d")}
    )


def mann_whitney(sets: DataFrame, values: DataFrame, value: str = "density_hits_kb") -> DataFrame:
    """Rank test of each set's values against the rest: u, p, medians inside and outside.

    One global midrank serves every set, because set and complement together are always
    the whole table. The complement's median is found by position: member j (from 0) of a
    set, at global position r, precedes complement element k exactly when r - j <= k.
    """
    vals = values.select("fbgn", F.col(value).alias("_v"))
    dist = cumulative_counts(vals, [], "_v")
    ties = dist.agg(F.sum(F.col("n").cast("double") * (F.col("n") * F.col("n") - 1))).scalar()
    total = vals.agg(F.count("*")).scalar()
    placed = with_row_number(vals, F.asc("_v"), F.asc("fbgn"), name="_r").withColumn("_r", F.col("_r") - 1)
    ranks = dist.select("_v", (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
    # tied values may hold most rows
    members = sets.join(join_per_value(placed, ranks, "_v"), "fbgn").select("set_name", "_v", "_r", "_rank")
    sums = members.groupBy("set_name").agg(F.count("*").alias("n_in"), F.sum("_rank").alias("_R"))
    n_in, n_out = F.col("n_in"), F.col("n_out")
    base = (
        sums.withColumn("n_out", total - n_in)
        .withColumn("u", F.col("_R") - n_in * (n_in + 1) / 2)
        .withColumn("ties", ties)
    )
    order = cumulative_counts(members, ["set_name"], "_r").select("set_name", "_r", "before")
    k_lo, k_hi = F.floor((n_out - 1) / 2), F.floor(n_out / 2)
    shift = F.col("_r") - F.col("before")
    spots = (
        order.join(base.select("set_name", "n_out"), "set_name")
        .groupBy("set_name")
        .agg(
            F.max(k_lo).alias("_klo"),
            F.max(k_hi).alias("_khi"),
            F.count_if(shift <= k_lo).alias("_slo"),
            F.count_if(shift <= k_hi).alias("_shi"),
        )
        .select(
            "set_name",
            F.explode(F.array(F.col("_klo") + F.col("_slo"), F.col("_khi") + F.col("_shi"))).alias("_r"),
        )
    )
    out_med = (
        spots.join(placed.select("_r", "_v"), "_r").groupBy("set_name").agg(F.avg("_v").alias("median_out"))
    )
    in_med = quantiles(members, ["set_name"], "_v", {"median_in": 0.5})
    tested = (n_in >= 3) & (n_out >= 3)
    return (
        base.join(in_med, "set_name", "left")
        .join(out_med, "set_name", "left")
        .select(
            "set_name",
            "n_in",
            "n_out",
            F.when(tested, F.col("u")).otherwise(F.lit(float("nan"))).alias("u"),
            "ties",
            "median_in",
            F.coalesce("median_out", F.lit(0.0)).alias("median_out"),
            F.coalesce(
                st.mann_whitney_pvalue("u", "n_in", "n_out", "ties"), F.lit(float("nan"))
            ).alias("mw_p"),
        )
    )


def bh_adjust(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values; missing or NaN p counts as 1.

    Equal p-values share a q, so the step-up runs over distinct p-values in range slabs.
    """
    clean = df.withColumn("_p", F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0)))
    m = df.agg(F.count("*")).scalar()
    counts = clean.groupBy("_p").agg(F.count("*").alias("_n"))
    parts = _range_parts(counts, F.col("_p"))
    slabs = parts.groupBy("_part").agg(F.sum("_n").alias("_slab"))
    along = Window.orderBy("_part")  # one row per slab
    offset = slabs.select("_part", (F.sum("_slab").over(along) - F.col("_slab")).alias("_off"))
    local = Window.partitionBy("_part").orderBy("_p")
    raw = (
        parts.join(F.broadcast(offset), "_part")
        .withColumn("_raw", F.col("_p") * m / (F.col("_off") + F.sum("_n").over(local)))
        .select("_part", "_p", "_raw")
    )
    back = Window.orderBy(F.desc("_part")).rowsBetween(UNB, -1)
    later = raw.groupBy("_part").agg(F.min("_raw").alias("_m")).select("_part", F.min("_m").over(back).alias("_later"))
    step_up = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(UNB, 0))
    q = (
        raw.withColumn("_q", step_up)
        .join(F.broadcast(later), "_part")
        .select("_p", F.least(F.col("_q"), F.coalesce("_later", F.col("_q")), F.lit(1.0)).alias(name))
    )
    # p = 1 stands for every missing value, so rows are not joined on p alone
    return join_per_value(clean, q, "_p").drop("_p")


def bonferroni(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    m = df.agg(F.count("*")).scalar()
    return df.withColumn(name, F.least(F.col(p) * m, F.lit(1.0)))


def usable_sets(sets: DataFrame, universe: DataFrame, min_genes: int = 5) -> DataFrame:
    """Distinct memberships inside the universe, of sets that keep enough genes."""
    kept = sets.select("set_name", "fbgn").distinct().join(universe.select("fbgn").distinct(), "fbgn", "left_semi")
    big = kept.groupBy("set_name").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_genes)
    return kept.join(big.select("set_name"), "set_name", "left_semi").select("set_name", "fbgn")


def enrichment(sets: DataFrame, gene_hits: DataFrame, min_genes: int = 5, positives: DataFrame | None = None) -> DataFrame:
    """Metrics, both tests with q-values and the category of every usable set.

    positives: genes (fbgn) of the first column of the 2x2 tables; those with hits by default.

    The gene table feeds every step and the per-set results feed both corrections, so each
    is written once instead of being recomputed by every consumer.
    """
    gene_hits = stage(gene_hits, "gene-hits")
    universe = gene_hits.select("fbgn").unionByName(sets.select("fbgn")).distinct()
    used = stage(usable_sets(sets, universe, min_genes), "sets")
    positives = gene_hits.where(F.col("total_hits") > 0) if positives is None else positives
    table = fisher_exact(contingency(used, universe, positives))
    ranks = mann_whitney(used, gene_hit_density(gene_hits))
    out = (
        set_metrics(used, gene_hits)
        .join(table, "set_name")
        .join(ranks.select("set_name", "u", "median_in", "median_out", "mw_p"), "set_name", "left")
        .withColumn("category", set_category(F.col("set_name")))
    )
    out = stage(out, "set-tests")
    return bh_adjust(bh_adjust(out, "fisher_p", "fisher_q"), "mw_p", "mw_q")


def enrichment_by_category(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    sig = F.col("fisher_q") < alpha
    return df.groupBy("category").agg(
        F.count("*").alias("n_sets"),
        F.avg("mean_density").alias("mean_density"),
        F.count_if(sig & (F.col("odds_ratio") > 1)).alias("sig_enriched"),
        F.count_if(sig & (F.col("odds_ratio") < 1)).alias("sig_depleted"),
    )


def top_sets(df: DataFrame, n: int = 15) -> DataFrame:
    """The n sets with highest and the n with lowest capped log2 odds ratio."""
    from .hits import number_rows

    scored = df.withColumn("log2_or", st.log2_or_capped(F.col("odds_ratio"))).where(F.col("log2_or").isNotNull())
    sides = []
    for side, key in (("enriched", F.desc("log2_or")), ("depleted", F.asc("log2_or"))):
        order = [key, F.asc("set_name")]
        sides.append(number_rows(scored.orderBy(*order).limit(n), *order).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def top_by_importance(df: DataFrame, n: int = 20, alpha: float = 0.05) -> DataFrame:
    """Significant sets with the greatest -log10 q plus |log2 odds ratio|."""
    from .hits import number_rows

    x, y = st.volcano_x(F.col("odds_ratio")), st.volcano_y(F.col("fisher_q"))
    scored = (
        df.where(F.col("fisher_q") < alpha)
        .withColumn("importance", y + F.abs(x))
        .where(F.col("importance").isNotNull())
    )
    order = [F.desc("importance"), F.asc("set_name")]
    return number_rows(scored.orderBy(*order).limit(n), *order)


def top_by_category(df: DataFrame, n: int = 10, measure: str = "mean_density") -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.desc(measure), "set_name")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation with a verdict: positive above 0.1, negative below -0.1, else none."""
    r = F.col("r")
    verdict = F.when(r > 0.1, "positive").when(r < -0.1, "negative").otherwise("none")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).withColumn("verdict", verdict)


def null_comparison(real: DataFrame, replicates: DataFrame, metrics: Sequence[str], ddof: int = 1) -> DataFrame:
    """Observed value against replicate mean and deviation, fold, z and composition share.

    `real` has one row, `replicates` one per replicate. ddof=1 is the sample deviation (0
    for a single replicate), ddof=0 the population one.
    """

    def long(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]
        return df.select(F.inline(F.array(*pairs)))

    sd = F.coalesce(F.stddev_samp("v"), F.lit(0.0)) if ddof else F.stddev_pop("v")
    null = long(replicates).groupBy("metric").agg(F.avg("v").alias("null_mean"), sd.alias("null_sd"))
    mean, dev, obs = F.col("null_mean"), F.col("null_sd"), F.col("real")
    return (
        long(real)
        .select("metric", F.col("v").alias("real"))
        .join(null, "metric")
        .withColumns(
            {
                "fold": ratio_or_inf(obs, mean),
                "z": F.when(dev > 0, (obs - mean) / dev),
                "pct_composition": F.when(obs != 0, 100 * mean / obs),
            }
        )
    )


def fold_by_tier(real: DataFrame, null: DataFrame, on: str, replicates: int, measure: str = "hits") -> DataFrame:
    """Tier counts of real hits over those of the null, per replicate."""
    return (
        real.select(on, F.col(measure).alias("real"))
        .join(null.select(on, (F.col(measure) / replicates).alias("shuffled")), on, "full")
        .fillna({"real": 0, "shuffled": 0.0})
        .withColumn("fold", ratio_or_inf(F.col("real"), F.col("shuffled")))
    )


def rank_gene_sets(sets: DataFrame, density: DataFrame, bias: DataFrame) -> DataFrame:
    """Per set: genes ranked, mean percentile, rank, density and sense share, bias label.

    Genes are numbered from the densest; percentile = 100 * (N - rank + 1) / N.
    """
    total = density.agg(F.count("*")).scalar()
    ranked = with_row_number(
        density.select("fbgn", "density_bp_kb"), F.desc("density_bp_kb"), F.asc("fbgn"), name="rank"
    ).withColumn("percentile", 100 * (total - F.col("rank") + 1) / total)
    s = F.col("mean_sense_pct")
    label = (
        F.when(s > 65, "strong_sense")
        .when(s > 55, "sense")
        .when(s < 35, "strong_antisense")
        .when(s < 45, "antisense")
        .when(s.isNotNull(), "balanced")
    )
    return (
        sets.join(ranked, "fbgn", "left")
        .join(bias.select("fbgn", "sense_pct"), "fbgn", "left")
        .groupBy("set_name")
        .agg(
            F.count("*").alias("n_genes"),
            F.count("rank").alias("n_ranked"),
            F.avg("percentile").alias("mean_percentile"),
            F.avg("rank").alias("mean_rank"),
            F.avg("density_bp_kb").alias("mean_density"),
            F.avg("sense_pct").alias("mean_sense_pct"),
        )
        .withColumn("bias", label)
    )


def gene_set_region_summary(sets: DataFrame, five: DataFrame, three: DataFrame) -> DataFrame:
    """Per set: 5' and 3' hits, sense shares and the 5'/3' ratio."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("fbgn", F.col("total_hits").alias(f"{name}_h"), F.col("sense_hits").alias(f"{name}_s"))

    zero = F.lit(0)
    h5, s5 = F.coalesce(F.sum("u5_h"), zero), F.coalesce(F.sum("u5_s"), zero)
    h3, s3 = F.coalesce(F.sum("u3_h"), zero), F.coalesce(F.sum("u3_s"), zero)
    any_hit = (F.coalesce("u5_h", zero) > 0) | (F.coalesce("u3_h", zero) > 0)
    return (
        sets.join(side(five, "u5"), "fbgn", "left")
        .join(side(three, "u3"), "fbgn", "left")
        .groupBy("set_name")
        .agg(
            F.count("*").alias("n_genes"),
            F.count_if(any_hit).alias("genes_with_hits"),
            h5.alias("utr5_hits"),
            pct(s5, h5).alias("utr5_sense_pct"),
            h3.alias("utr3_hits"),
            pct(s3, h3).alias("utr3_sense_pct"),
            F.when(h3 > 0, h5 / h3).otherwise(0.0).alias("ratio_5_3"),
        )
    )


def region_extremes(summary: DataFrame) -> DataFrame:
    """Sets with highest and lowest sense share on either side (lowest name on ties)."""

    def pick(measure: str, sign: int) -> Column:
        return F.min(F.struct((sign * F.col(measure)).alias("k"), "set_name"))["set_name"]

    return summary.agg(
        pick("utr5_sense_pct", -1).alias("utr5_highest"),
        pick("utr5_sense_pct", 1).alias("utr5_lowest"),
        pick("utr3_sense_pct", -1).alias("utr3_highest"),
        pick("utr3_sense_pct", 1).alias("utr3_lowest"),
    )


def family_fold_by_set(sets: DataFrame, gene_family: DataFrame) -> DataFrame:
    """Share of each family among a set's hits against its share over all genes.

    gene_family: fbgn, family, hits.
    """
    whole = gene_family.groupBy("family").agg(F.sum("hits").alias("_f"))
    total = gene_family.agg(F.sum("hits")).scalar()
    inside = sets.join(gene_family, "fbgn").groupBy("set_name", "family").agg(F.sum("hits").alias("hits"))
    share = F.col("hits") / F.sum("hits").over(Window.partitionBy("set_name"))
    return inside.withColumn("share", share).join(whole, "family").select(
        "set_name", "family", "hits", "share", (F.col("share") / (F.col("_f") / total)).alias("fold")
    )


def strand_share_by_set(sets: DataFrame, gene_hits: DataFrame) -> DataFrame:
    """Sense share of a set's hits and its distance from the share over all genes."""
    base = gene_hits.agg(100 * F.sum("sense_hits") / F.sum("total_hits")).scalar()
    hits = F.sum("total_hits")
    return (
        sets.join(gene_hits, "fbgn")
        .groupBy("set_name")
        .agg(hits.alias("hits"), (100 * F.sum("sense_hits") / hits).alias("sense_pct"))
        .withColumn("delta", F.col("sense_pct") - base)
    )


def cohort_genes(sets: DataFrame, first: str, second: str) -> DataFrame:
    """Genes in exactly one of two sets: fbgn, cohort."""
    pair = sets.where(F.col("set_name").isin(first, second))
    only = pair.groupBy("fbgn").agg(F.min("set_name").alias("cohort"), F.max("set_name").alias("_m"))
    return only.where(F.col("cohort") == F.col("_m")).drop("_m")


def cohort_contrast(sets: DataFrame, gene_family: DataFrame, first: str, second: str) -> DataFrame:
    """Family shares in genes only in one set against genes only in the other."""
    return family_contrast(cohort_genes(sets, first, second).join(gene_family, "fbgn"), first, second)


def family_contrast(counts: DataFrame, first: str, second: str) -> DataFrame:
    """Family shares in the hits of two cohorts. counts: cohort, family, hits; any number of rows each.

    One row per family is written, so that totals and shares read it and hits are counted once.
    """
    per = counts.groupBy("family").agg(
        F.sum(F.when(F.col("cohort") == first, F.col("hits")).otherwise(0)).alias("first_hits"),
        F.sum(F.when(F.col("cohort") == second, F.col("hits")).otherwise(0)).alias("second_hits"),
    )
    per = stage(per, "families")
    tot = per.agg(F.struct(F.sum("first_hits").alias("a"), F.sum("second_hits").alias("b"))).scalar()
    a = pct(F.col("first_hits"), tot["a"])
    b = pct(F.col("second_hits"), tot["b"])
    return per.withColumns({"first_pct": a, "second_pct": b}).withColumn(
        "ratio", F.when(F.col("second_pct") > 0, F.col("first_pct") / F.col("second_pct")).otherwise(F.lit(INF))
    )
