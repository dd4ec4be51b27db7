"""Roll-ups of hits to transcripts, genes, subjects, families and data sets.

Every roll-up first counts on the hit's own id and joins the dimension afterwards, so the
shuffle after the scan is already reduced and a crowded id costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import is_plus
from ..functions.names import gene_token, subject_token
from .hits import number_rows

INF = float("inf")


def pct(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, 100 * part / whole).otherwise(F.lit(default))


def ratio_or_inf(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(INF))


# genes and strands ---------------------------------------------------------------------


def hits_per_transcript(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.col("qseqid").alias("fbtr")).agg(
        F.count("*").alias("total_hits"),
        F.count_if(is_plus()).alias("sense_hits"),
        F.count_if(~is_plus()).alias("anti_hits"),
        F.sum("length").alias("hit_bp"),
    )


def gene_density(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per gene: transcripts with hits, their summed length, hits, bases, bases per kb.

    Only transcripts that have hits count towards the length, each of them once.
    """
    per_tx = hits_per_transcript(hits).join(transcripts.select("fbtr", "fbgn", "tx_len"), "fbtr")
    total = F.sum("tx_len")
    return per_tx.groupBy("fbgn").agg(
        F.count("*").alias("transcripts"),
        total.alias("total_len"),
        F.sum("total_hits").alias("hits"),
        F.sum("hit_bp").alias("hit_bp"),
        F.when(total > 0, F.sum("hit_bp") / total * 1000).otherwise(0.0).alias("density_bp_kb"),
    )


def top_subjects_per_gene(hits: DataFrame, transcripts: DataFrame, n: int = 3) -> DataFrame:
    """fbgn -> top_te_1..n as `id:count`, blank where a gene has fewer subjects."""
    counts = (
        hits.groupBy(F.col("qseqid").alias("fbtr"), "sseqid")
        .agg(F.count("*").alias("c"))
        .join(transcripts.select("fbtr", "fbgn"), "fbtr")
        .groupBy("fbgn", "sseqid")
        .agg(F.sum("c").alias("c"))
    )
    ranked = counts.withColumn(
        "_r", F.row_number().over(Window.partitionBy("fbgn").orderBy(F.desc("c"), "sseqid"))
    ).where(F.col("_r") <= n)
    label = F.concat_ws(":", "sseqid", F.col("c").cast("string"))
    return ranked.groupBy("fbgn").agg(
        *[
            F.coalesce(F.max(F.when(F.col("_r") == i, label)), F.lit("")).alias(f"top_te_{i}")
            for i in range(1, n + 1)
        ]
    )


def top_bottom(density: DataFrame, n: int = 100) -> DataFrame:
    """The n densest and the n sparsest genes with their rank from the top.

    Two top-n sorts and a count; the full ranking is never materialised.
    """
    order = [F.desc("density_bp_kb"), F.asc("fbgn")]
    back = [F.asc("density_bp_kb"), F.desc("fbgn")]
    total = density.agg(F.count("*")).scalar()
    top = number_rows(density.orderBy(*order).limit(n), *order).withColumn("side", F.lit("top"))
    low = (
        number_rows(density.orderBy(*back).limit(n), *back, name="_back")
        .withColumn("rank", (total - F.col("_back") + 1).cast("int"))
        .drop("_back")
        .withColumn("side", F.lit("bottom"))
    )
    return top.unionByName(low)


def strand_bias_by_query(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    return (
        hits_per_transcript(hits)
        .join(transcripts.select("fbtr", "fbgn", F.col("tx_len").alias("utr_len")), "fbtr")
        .select(
            "fbtr",
            "fbgn",
            "utr_len",
            "total_hits",
            "sense_hits",
            "anti_hits",
            pct(F.col("sense_hits"), F.col("total_hits")).alias("sense_pct"),
            pct(F.col("anti_hits"), F.col("total_hits")).alias("anti_pct"),
        )
    )


def strand_bias_by_subject(hits: DataFrame, min_hits: int = 10) -> DataFrame:
    total = F.col("total_hits")
    return (
        hits.groupBy(F.col("sseqid").alias("te_id"))
        .agg(
            F.count("*").alias("total_hits"),
            F.count_if(is_plus()).alias("sense_hits"),
            F.count_if(~is_plus()).alias("anti_hits"),
            F.sum("length").alias("total_bp"),
        )
        .where(total >= min_hits)
        .withColumns(
            {
                "sense_pct": pct(F.col("sense_hits"), total),
                "anti_pct": pct(F.col("anti_hits"), total),
            }
        )
    )


def strand_overview(by_query: DataFrame, by_subject: DataFrame) -> DataFrame:
    """One row: totals, shares and counts of strongly biased transcripts and subjects."""
    many = F.col("total_hits") >= 50
    q = by_query.agg(
        F.coalesce(F.sum("sense_hits"), F.lit(0)).alias("total_sense"),
        F.coalesce(F.sum("anti_hits"), F.lit(0)).alias("total_anti"),
        F.count("*").alias("queries_analyzed"),
        F.count_if(many & (F.col("sense_pct") >= 70)).alias("strong_sense_queries"),
        F.count_if(many & (F.col("anti_pct") >= 70)).alias("strong_anti_queries"),
    )
    s = by_subject.agg(
        F.struct(
            F.count("*").alias("subjects_analyzed"),
            F.count_if(F.col("sense_pct") >= 60).alias("strong_sense_subjects"),
            F.count_if(F.col("anti_pct") >= 60).alias("strong_anti_subjects"),
        )
    ).scalar()
    whole = F.col("total_sense") + F.col("total_anti")
    return q.withColumn("_s", s).select(*q.columns, "_s.*").withColumns(
        {
            "sense_pct": pct(F.col("total_sense"), whole),
            "anti_pct": pct(F.col("total_anti"), whole),
        }
    )


def strand_bias_by_gene(by_query: DataFrame) -> DataFrame:
    """Gene sums of the transcript table; 50/50 when a gene has no hits."""
    total = F.col("total_hits")
    return (
        by_query.groupBy("fbgn")
        .agg(
            F.sum("total_hits").alias("total_hits"),
            F.sum("sense_hits").alias("sense_hits"),
            F.sum("anti_hits").alias("anti_hits"),
            F.sum("utr_len").alias("total_utr_len"),
        )
        .withColumns(
            {
                "sense_pct": pct(F.col("sense_hits"), total, 50.0),
                "anti_pct": pct(F.col("anti_hits"), total, 50.0),
            }
        )
    )


# families ------------------------------------------------------------------------------


def _with_family(per_subject: DataFrame, subjects: DataFrame) -> DataFrame:
    dim = subjects.select(F.col("te_id").alias("sseqid"), "family", "te_class")
    return (
        per_subject.join(dim, "sseqid", "left")
        .withColumn("family", F.coalesce("family", "sseqid"))
        .withColumn("te_class", F.coalesce("te_class", F.lit("Unknown")))
    )


def family_stats(hits: DataFrame, subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per family: count, plus, minus, mean evalue and identity, plus/minus ratio, class."""
    by = list(by)
    per_subject = hits.groupBy(*by, "sseqid").agg(
        F.count("*").alias("n"),
        F.count_if(is_plus()).alias("p"),
        F.sum("evalue").alias("e"),
        F.sum("pident").alias("i"),
    )
    return (
        _with_family(per_subject, subjects)
        .groupBy(*by, "family")
        .agg(
            F.sum("n").alias("hits"),
            F.sum("p").alias("plus"),
            (F.sum("n") - F.sum("p")).alias("minus"),
            (F.sum("e") / F.sum("n")).alias("mean_evalue"),
            (F.sum("i") / F.sum("n")).alias("mean_pident"),
            F.max("te_class").alias("te_class"),
        )
        .withColumn("strand_ratio", ratio_or_inf(F.col("plus"), F.col("minus")))
    )


def family_dataset_pivot(stats: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Family rows with plus/minus/total/ratio per data set; 999 stands for infinite."""
    cols = []
    for d in datasets:
        here = F.col("dataset") == d
        capped = F.when(F.col("strand_ratio") == INF, 999.0).otherwise(F.col("strand_ratio"))
        for src, name in (("plus", "plus"), ("minus", "minus"), ("hits", "total")):
            v = F.sum(F.when(here, F.col(src)))
            cols.append(F.coalesce(v, F.lit(0)).alias(f"{d}_{name}"))
        cols.append(F.max(F.when(here, capped)).alias(f"{d}_ratio"))
    return stats.groupBy("family").agg(
        F.max("te_class").alias("te_class"), *cols, F.sum("hits").alias("total")
    )


def family_enrichment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Relative frequency of shared families in two hit sets, ratio and log2."""

    def freq(df: DataFrame, side: str) -> DataFrame:
        total = df.agg(F.sum("hits")).scalar()
        return df.select(
            "family",
            *([F.col("te_class")] if side == "a" else []),
            F.col("hits").alias(f"{side}_count"),
            (F.col("hits") / total).alias(f"{side}_freq"),
        )

    e = F.col("enrichment")
    return (
        freq(a, "a")
        .join(freq(b, "b"), "family")
        .withColumn("enrichment", ratio_or_inf(F.col("a_freq"), F.col("b_freq")))
        .withColumn("log2_enrichment", F.when((e > 0) & (e != INF), F.log2(e)).otherwise(0.0))
    )


def real_vs_null_family(
    real: DataFrame, null: DataFrame, replicates: int, min_count: int = 100
) -> DataFrame:
    """Family counts against the per-replicate null, with fold and label."""
    fold = F.col("fold")
    label = (
        F.when((fold >= 0.8) & (fold <= 1.2), "similar")
        .when(fold > 1.5, "enriched")
        .when(fold < 0.67, "depleted")
        .otherwise("between")
    )
    return (
        real.select("family", F.col("hits").alias("real"))
        .join(null.select("family", (F.col("hits") / replicates).alias("shuffled")), "family", "full")
        .fillna({"real": 0, "shuffled": 0.0})
        .where((F.col("real") >= min_count) | (F.col("shuffled") >= min_count))
        .withColumn("fold", ratio_or_inf(F.col("real"), F.col("shuffled")))
        .withColumn("label", label)
    )


def biased_families(stats: DataFrame, min_total: int = 5) -> DataFrame:
    """Families with plus/minus above 2 or below 0.5 and enough hits."""
    r = F.col("strand_ratio")
    return stats.where((F.col("hits") >= min_total) & ((r > 2) | (r < 0.5)))


def control_overview(hits: DataFrame) -> DataFrame:
    """Per data set: total, plus, minus, ratio."""
    return (
        hits.groupBy("dataset")
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_plus()).alias("plus"),
            F.count_if(~is_plus()).alias("minus"),
        )
        .withColumn("ratio", ratio_or_inf(F.col("plus"), F.col("minus")))
    )


def region_stats(regions: DataFrame, min_length: int = 50) -> DataFrame:
    """Hits and bases per region over all families (family null) and per family.

    Hits of unmapped families (`unannotated`) count in the overall rows only. Takes the rows of
    `region_overlap`, or its summed rows with `n`, the number of equal hits.
    """
    kept = regions.where(F.col("length") >= min_length)
    if "pieces" in regions.columns:
        n = F.sum(F.col("n") * F.col("pieces")), F.sum(F.col("n") * F.col("region_bp"))
    else:
        n = F.count("*"), F.sum("region_bp")
    per = kept.groupBy("family", "region").agg(n[0].alias("hits"), n[1].alias("bp"))
    total = per.groupBy("region").agg(F.sum("hits").alias("hits"), F.sum("bp").alias("bp"))
    return per.where(F.col("region") != "unannotated").unionByName(
        total.select(F.lit(None).cast("string").alias("family"), "region", "hits", "bp")
    )


def region_overlap(
    hits: DataFrame, regions: DataFrame, family_map: DataFrame, key: Sequence[str], summed: bool = False
) -> DataFrame:
    """Structural regions each hit spans on its subject, one row per overlapped region.

    hits carry family, s_lo, s_hi, length and `key`; family_map: family_key (lower case),
    region_id; regions: region_id, region, reg_start, reg_end. A mapped hit that meets no
    region is `intergenic`, a hit of an unmapped family `unannotated`.

    The rows grow with hits times regions, so they are made last, where the hits lie, and are
    not moved; only distinct spans are looked up for those that meet nothing. `summed` gives one
    row per hit and name of a region instead: `pieces`, the regions of that name it meets, and
    their region_bp together.
    """
    from .intervals import listed_overlaps, overlap_join, overlapping

    known = regions.select("region_id").distinct()
    mapped = family_map.join(known, "region_id", "left_semi")
    bp = F.least("s_hi", "reg_end") - F.greatest("s_lo", "reg_start")
    own, at = ["region_id"], ["region_id", "s_lo", "s_hi"]
    span = ["family_key", "s_lo", "s_hi"]
    spans = hits.select(F.lower("family").alias("family_key"), "s_lo", "s_hi").distinct().join(mapped, "family_key", "left")
    if summed:
        # regions are looked up once per distinct span of a family, then hits fetch the answer by span:
        # a family's name alone, of which there are few, is never the key of raw hits
        regions = regions.groupBy("region_id", "region", "reg_start", "reg_end").agg(F.count("*").alias("copies"))
        copies = F.col("copies")
        pairs = overlap_join(
            spans.where(F.col("region_id").isNotNull()).select(*at).distinct(),
            regions, own, ("s_lo", "s_hi"), ("reg_start", "reg_end"), closed=False,
        )
        found = pairs.groupBy(*at, "region").agg(F.sum(copies).alias("pieces"), F.sum(bp * copies).alias("region_bp"))
        met = spans.join(found, at)
    else:
        met = overlapping(spans, regions, own, ("s_lo", "s_hi"), ("reg_start", "reg_end"), span)
    none = spans.join(met.select(*span).distinct(), span, "left_anti")
    answers = met.unionByName(none, allowMissingColumns=True) if summed else none
    answers = answers.withColumnsRenamed({"family_key": "_family", "s_lo": "_lo", "s_hi": "_hi"})
    same = F.lower("family").eqNullSafe(F.col("_family")) & F.col("s_lo").eqNullSafe(F.col("_lo")) & F.col("s_hi").eqNullSafe(F.col("_hi"))
    rows = hits.join(answers, same).drop("_family", "_lo", "_hi")
    missing = F.when(F.col("region_id").isNull(), "unannotated").otherwise("intergenic")
    spare = F.when(F.col("region_id").isNull(), F.col("length")).otherwise(F.col("s_hi") - F.col("s_lo"))
    if summed:
        rows = rows.withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        return rows.withColumn("region_bp", F.coalesce("region_bp", spare)).withColumn("region", F.coalesce("region", missing))
    # dealt by key: a task makes the rows of its hits, which may be hundreds for each
    named = hits.withColumn("_family", F.lower("family"))
    named = named.join(mapped.withColumnRenamed("family_key", "_family"), "_family").drop("_family")
    pairs = listed_overlaps(named, regions, own, ("s_lo", "s_hi"), ("reg_start", "reg_end"), ["region"], key, "region_bp")
    return pairs.unionByName(rows.withColumn("region", missing).withColumn("region_bp", spare))


def repeat_class_summary(overlaps: DataFrame) -> DataFrame:
    """Overlaps, bases, distinct transcripts and their share, per repeat class."""
    total = overlaps.agg(F.count_distinct("fbtr")).scalar()
    per = overlaps.groupBy("repeat_class").agg(
        F.count("*").alias("overlaps"),
        F.sum("overlap_len").alias("bp"),
        F.count_distinct("fbtr").alias("transcripts"),
    )
    return per.withColumn("transcript_pct", pct(F.col("transcripts"), total))


# histograms and ladders ----------------------------------------------------------------


def binned_counts(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Rows per half-open bin; values on the last edge are left out and empty bins kept.

    One conditional count per bin in a single aggregate.
    """
    v = F.col(value)
    spans = list(zip(edges, edges[1:]))
    one = df.agg(*[F.count_if((v >= lo) & (v < hi)).alias(f"_b{i}") for i, (lo, hi) in enumerate(spans)])
    rows = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(float(lo)).alias("lo"),
            F.lit(float(hi)).alias("hi"),
            F.col(f"_b{i}").alias("rows"),
        )
        for i, (lo, hi) in enumerate(spans)
    ]
    return one.select(F.inline(F.array(*rows)))


def _bucket(v: Column, lo: float, hi: float, n: int) -> Column:
    raw = F.floor((v - lo) / ((hi - lo) / n))
    return F.when((v >= lo) & (v <= hi), F.least(raw, F.lit(n - 1))).cast("int")


def histogram(df: DataFrame, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Equal-width bins with the last one closed: bin, rows, density. Empty bins absent."""
    counts = (
        df.withColumn("bin", _bucket(F.col(value), lo, hi, n))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count("*").alias("rows"))
    )
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # at most n rows
    return counts.withColumn("density", F.col("rows") / total / ((hi - lo) / n))


def histogram2d(df: DataFrame, x: str, y: str, x_spec: tuple, y_spec: tuple) -> DataFrame:
    """Counts on an equal-width grid; spec = (lo, hi, bins)."""
    return (
        df.select(_bucket(F.col(x), *x_spec).alias("x_bin"), _bucket(F.col(y), *y_spec).alias("y_bin"))
        .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x_bin", "y_bin")
        .agg(F.count("*").alias("rows"))
    )


def threshold_ladder(
    df: DataFrame, tiers: Sequence[tuple[str, float, int]], score: str = "score", min_rows: int = 1
) -> DataFrame:
    """Per (label, min pident, min length): count, mean, upper median, share >= 1.

    A row enters every tier it meets. The median works on counts per distinct value.
    """
    from ..scale import conditional_upper_medians

    v = F.col(score)
    meets = {t: (F.col("pident") >= p) & (F.col("length") >= n) for t, p, n in tiers}
    one = df.agg(
        *[
            F.struct(
                F.lit(t).alias("tier"),
                F.count_if(ok).alias("hits"),
                F.avg(F.when(ok, v)).alias("mean_score"),
                (100 * F.count_if(ok & (v >= 1)) / F.nullif(F.count_if(ok), F.lit(0))).alias("pct_conserved"),
            ).alias(f"_t{i}")
            for i, (t, ok) in enumerate(meets.items())
        ]
    )
    stats = one.select(F.inline(F.array(*[F.col(f"_t{i}") for i in range(len(meets))])))
    medians = conditional_upper_medians(df, score, meets, "median_score").withColumnRenamed("label", "tier")
    return stats.where((F.col("hits") >= min_rows) & (F.col("hits") > 0)).join(medians, "tier")


def conservation_categories(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Shares of highly conserved, conserved, weakly conserved and fast-evolving rows."""
    by = list(by)
    s = F.col(score)
    cat = (
        F.when(s >= 2, "highly_conserved")
        .when(s >= 1, "conserved")
        .when(s >= 0, "weakly_conserved")
        .otherwise("fast_evolving")
    )
    per = df.groupBy(*by, cat.alias("category")).agg(F.count("*").alias("hits"))
    return per.withColumn(
        "pct", 100 * F.col("hits") / F.sum("hits").over(Window.partitionBy(*(by or [F.lit(0)])))
    )


def subject_means(df: DataFrame, n: int = 20, min_hits: int = 100, score: str = "score") -> DataFrame:
    """Subjects with enough hits, highest mean score first."""
    return (
        df.groupBy("te_id")
        .agg(F.count("*").alias("hits"), F.avg(score).alias("mean_score"))
        .where(F.col("hits") >= min_hits)
        .orderBy(F.desc("mean_score"), "te_id")
        .limit(n)
    )


def synteny_thresholds(df: DataFrame, thresholds: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Hits per threshold for each species and for any: (threshold, track, hits, pct)."""
    tracks = ["sim_coverage", "yak_coverage", "ere_coverage", "any_coverage"]
    one = df.agg(
        F.count("*").alias("_n"),
        *[
            F.count_if(F.col(t) >= th).alias(f"_{i}_{t}")
            for i, th in enumerate(thresholds)
            for t in tracks
        ],
    )
    rows = [
        F.struct(
            F.lit(float(th)).alias("threshold"),
            F.lit(t).alias("track"),
            F.col(f"_{i}_{t}").alias("hits"),
            pct(F.col(f"_{i}_{t}"), F.col("_n")).alias("pct"),
        )
        for i, th in enumerate(thresholds)
        for t in tracks
    ]
    return one.select(F.inline(F.array(*rows)))


def synteny_classes(df: DataFrame) -> DataFrame:
    """One row: syntenic in any species, in all three, in none."""
    any_ = F.col("any_coverage") >= 0.5
    all3 = F.least("sim_coverage", "yak_coverage", "ere_coverage") >= 0.5
    return df.agg(
        F.count("*").alias("hits"),
        F.count_if(any_).alias("syntenic_any"),
        F.count_if(all3).alias("syntenic_all"),
        F.count_if(~any_).alias("syntenic_none"),
    )


def synteny_by_band(df: DataFrame, value: str, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Hits and syntenic hits per half-open band of `value`; empty bands are left out."""
    v = F.col(value)
    index = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bands):
        index = F.when((v >= lo) & (v < hi), i).otherwise(index)
    return (
        df.withColumn("band", index)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.count("*").alias("hits"), F.count_if(F.col("any_coverage") >= 0.5).alias("syntenic"))
        .withColumn("syntenic_pct", pct(F.col("syntenic"), F.col("hits")))
    )


# transcripts in segments ---------------------------------------------------------------


def segment_annotation(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Bases of each hit in 5', coding and 3' segments, the segment list, the primary one.

    transcripts: fbtr, utr5_len, cds_len, utr3_len. On a tie the earlier segment is primary.
    """
    from ..scale import skew_join

    dim = transcripts.select(F.col("fbtr").alias("qseqid"), "utr5_len", "cds_len", "utr3_len")
    e5 = F.col("utr5_len")
    ec = e5 + F.col("cds_len")
    e3 = ec + F.col("utr3_len")

    def bases(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("qend"), hi) - F.greatest(F.col("qstart"), lo) + 1)

    segs = {"5UTR": "bp_utr5", "CDS": "bp_cds", "3UTR": "bp_utr3"}
    present = [F.when(F.col(c) > 0, F.lit(name)) for name, c in segs.items()]
    best = F.greatest(*segs.values())
    primary = F.when(F.col("bp_utr5") == best, "5UTR").when(F.col("bp_cds") == best, "CDS").otherwise("3UTR")
    return (
        skew_join(hits, dim, ["qseqid"])
        .withColumns(
            {"bp_utr5": bases(F.lit(1), e5), "bp_cds": bases(e5 + 1, ec), "bp_utr3": bases(ec + 1, e3)}
        )
        .withColumns({"segments": F.array_compact(F.array(*present)), "primary_segment": primary})
        .withColumn("spanning", F.size("segments") > 1)
    )


def spanning_share(segmented: DataFrame, by: str = "qseqid") -> DataFrame:
    """Per query: hits, hits crossing a segment border, their share."""
    return (
        segmented.groupBy(by)
        .agg(F.count("*").alias("hits"), F.count_if("spanning").alias("spanning_hits"))
        .withColumn("spanning_pct", pct(F.col("spanning_hits"), F.col("hits")))
    )


def assemble_transcripts(utr5: DataFrame, cds: DataFrame, utr3: DataFrame) -> DataFrame:
    """One transcript per gene: the longest with coding and 3' parts, else a 3'-only one.

    Inputs: fbgn, fbtr, seq, length. The 5' part is optional. Among equals the lowest
    transcript id wins.
    """

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("fbgn", "fbtr", F.col("seq").alias(f"{name}_seq"), F.col("length").alias(f"{name}_n"))

    keys = ["fbgn", "fbtr"]
    joined = part(utr3, "utr3").join(part(cds, "cds"), keys, "left").join(part(utr5, "utr5"), keys, "left")
    complete = F.col("cds_n").isNotNull()
    total = F.coalesce("utr5_n", F.lit(0)) + F.coalesce("cds_n", F.lit(0)) + F.col("utr3_n")
    # complete ones first, then the longest; incomplete ones by id alone
    best = (
        joined.select(
            *keys, complete.alias("complete"), F.when(complete, total).otherwise(0).alias("total")
        )
        .groupBy("fbgn")
        .agg(F.min(F.struct((~F.col("complete")).alias("a"), (-F.col("total")).alias("b"), "fbtr")).alias("w"))
        .select("fbgn", "w.fbtr")
    )
    chosen = joined.join(best, keys, "left_semi")
    s5 = F.when(complete, F.coalesce("utr5_seq", F.lit(""))).otherwise("")
    sc = F.coalesce("cds_seq", F.lit(""))
    return chosen.select(
        *keys,
        F.length(s5).alias("utr5_len"),
        F.length(sc).alias("cds_len"),
        F.when(complete, F.length("utr3_seq")).otherwise(F.col("utr3_n")).cast("int").alias("utr3_len"),
        F.concat(s5, sc, F.col("utr3_seq")).alias("full_seq"),
    )


# bias against score --------------------------------------------------------------------


def bias_class_means(
    bias: DataFrame, scores: DataFrame, key: str, hi: float = 70, lo: float = 30, min_hits: int = 10
) -> DataFrame:
    """Units grouped by sense share; mean of unit means and mean syntenic share.

    bias: key, total_hits, sense_pct. scores: key, score, any_coverage (one row per hit).
    relative_diff_pct compares each class with the antisense class.
    """
    unit = scores.groupBy(key).agg(
        F.avg("score").alias("mean_score"),
        (100 * F.count_if(F.col("any_coverage") >= 0.5) / F.count("*")).alias("pct_syntenic"),
    )
    cls = F.when(F.col("sense_pct") >= hi, "sense").when(F.col("sense_pct") <= lo, "antisense").otherwise("balanced")
    means = (
        bias.where(F.col("total_hits") >= min_hits)
        .join(unit, key)
        .groupBy(cls.alias("bias_class"))
        .agg(
            F.count("*").alias("units"),
            F.avg("mean_score").alias("mean_score"),
            F.avg("pct_syntenic").alias("pct_syntenic"),
        )
    )
    # three rows at most
    base = F.max(F.when(F.col("bias_class") == "antisense", F.col("mean_score"))).over(
        Window.partitionBy(F.lit(0))
    )
    return means.withColumn("_b", base).select(
        "bias_class",
        "units",
        "mean_score",
        "pct_syntenic",
        F.when(F.col("_b") != 0, 100 * (F.col("mean_score") - F.col("_b")) / F.col("_b")).alias(
            "relative_diff_pct"
        ),
    )


def family_bias_vs_score(
    by_subject: DataFrame,
    scores: DataFrame,
    subjects: DataFrame,
    min_hits: int = 100,
    min_members: int = 3,
) -> DataFrame:
    """Subject means, then family means over families with enough members."""
    unit = scores.groupBy("te_id").agg(F.avg("score").alias("mean_score"))
    return (
        by_subject.where(F.col("total_hits") >= min_hits)
        .join(unit, "te_id")
        .join(subjects.select("te_id", "family"), "te_id", "left")
        .withColumn("family", F.coalesce("family", "te_id"))
        .groupBy("family")
        .agg(
            F.avg("sense_pct").alias("mean_sense_pct"),
            F.avg("mean_score").alias("mean_score"),
            F.count("*").alias("members"),
            F.sum("total_hits").alias("hits"),
        )
        .where(F.col("members") >= min_members)
    )


# gene signal tables --------------------------------------------------------------------


def gene_signal_table(per_query: DataFrame, hits: DataFrame) -> DataFrame:
    """Gene rows from per-query signal (qseqid, length, total_hits, max_signal, total_signal)."""
    gene = gene_token(F.col("qseqid")).alias("gene")
    base = per_query.groupBy(gene).agg(
        F.count("*").alias("isoforms"),
        F.sum("length").alias("total_length"),
        F.sum("total_hits").alias("total_hits"),
        F.max("max_signal").alias("max_signal"),
        F.sum("total_signal").alias("total_signal"),
    )
    fams = (
        hits.groupBy(gene, subject_token(F.col("sseqid")).alias("family"))
        .agg(F.count("*").alias("n"))
        .groupBy("gene")
        .agg(
            F.count("*").alias("families"),
            F.min(F.struct((-F.col("n")).alias("neg"), F.col("family"))).alias("_top"),
        )
        .select("gene", "families", F.col("_top.family").alias("top_family"))
    )
    kb = F.col("total_length") / 1000
    return base.join(fams, "gene", "left").withColumns(
        {
            "signal_per_kb": F.when(F.col("total_length") > 0, F.col("total_signal") / kb).otherwise(0.0),
            "hits_per_kb": F.when(F.col("total_length") > 0, F.col("total_hits") / kb).otherwise(0.0),
            "families": F.coalesce("families", F.lit(0)),
        }
    )


def family_breakdown(hits: DataFrame, n: int = 8) -> DataFrame:
    """Hits per gene for the n families with most hits overall, the rest as Other."""
    counts = hits.groupBy(
        gene_token(F.col("qseqid")).alias("gene"), subject_token(F.col("sseqid")).alias("family")
    ).agg(F.count("*").alias("n"))
    top = (
        counts.groupBy("family")
        .agg(F.sum("n").alias("_all"))
        .orderBy(F.desc("_all"), "family")
        .limit(n)
        .select("family", F.lit(True).alias("_top"))
    )
    # n rows
    return (
        counts.join(F.broadcast(top), "family", "left")
        .groupBy("gene", F.when(F.col("_top"), F.col("family")).otherwise("Other").alias("family"))
        .agg(F.sum("n").alias("hits"))
    )


def signal_ranking(table: DataFrame) -> DataFrame:
    """Absolute and per-kb order of every gene, numbered without a one-task sort.

    Both orders sample and sort the table, so it is written first and made once.
    """
    from ..scale import stage, with_row_number

    slim = stage(table.select("gene", "total_length", "max_signal", "signal_per_kb"), "genes")
    a = with_row_number(slim, F.desc("max_signal"), F.asc("gene"), name="rank_signal")
    b = with_row_number(
        slim.select("gene", "signal_per_kb"), F.desc("signal_per_kb"), F.asc("gene"), name="rank_per_kb"
    )
    return a.join(b.select("gene", "rank_per_kb"), "gene")


# parameter sweeps ----------------------------------------------------------------------


def sweep_stats(hits: DataFrame, by: str = "combo_id") -> DataFrame:
    from ..scale import quantiles

    e = F.col("evalue")
    base = (
        hits.groupBy(by)
        .agg(
            F.count("*").alias("total_hits"),
            F.count_if(is_plus()).alias("plus_hits"),
            F.count_if(~is_plus()).alias("minus_hits"),
            F.count_distinct("qseqid").alias("unique_queries"),
            F.count_distinct("sseqid").alias("unique_subjects"),
            F.avg(e).alias("mean_evalue"),
            F.min(e).alias("min_evalue"),
            F.avg("pident").alias("mean_pident"),
            F.avg("length").alias("mean_length"),
            F.count_if(e < 1).alias("hits_lt_1"),
            F.count_if(e < 0.1).alias("hits_lt_0_1"),
            F.count_if(e < 0.01).alias("hits_lt_0_01"),
        )
        .withColumn("strand_ratio", ratio_or_inf(F.col("plus_hits"), F.col("minus_hits")))
    )
    return base.join(quantiles(hits, [by], "evalue", {"median_evalue": 0.5}), by, "left")


def sweep_pivot(stats: DataFrame, rows: str, cols: str, values: Sequence, measure: str = "total_hits") -> DataFrame:
    """Mean of a measure by two parameters; column values are given, not looked up."""
    return stats.groupBy(rows).agg(
        *[F.avg(F.when(F.col(cols) == v, F.col(measure))).alias(f"{cols}_{v}") for v in values]
    )


def top_combos(stats: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("total_hits"), F.asc("combo_id")]
    return number_rows(stats.orderBy(*order).limit(n), *order)


# subject coverage and position ---------------------------------------------------------


def subject_coverage(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Bases of each subject covered by the union of its hit spans, and the share."""
    from .intervals import merge_intervals

    spans = hits.select(
        F.col("sseqid").alias("te_id"), F.least("sstart", "send").alias("lo"), F.greatest("sstart", "send").alias("hi")
    )
    # closed spans: neighbours lo = hi + 1 touch
    cover = (
        merge_intervals(spans, ["te_id"], "lo", "hi", gap=1)
        .groupBy("te_id")
        .agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered_bp"))
    )
    return (
        subjects.select("te_id", "family", "te_length")
        .join(cover, "te_id", "left")
        .withColumn("covered_bp", F.coalesce("covered_bp", F.lit(0)))
        .withColumn("covered_pct", pct(F.col("covered_bp"), F.col("te_length")))
    )


def coverage_tiers(coverage: DataFrame) -> DataFrame:
    """One row: subjects, subjects hit, covered share of all bases, counts per tier."""
    c = F.col("covered_pct")
    return coverage.agg(
        F.count("*").alias("subjects"),
        F.count_if(F.col("covered_bp") > 0).alias("subjects_hit"),
        (100 * F.sum("covered_bp") / F.sum("te_length")).alias("base_pct"),
        *[F.count_if(c >= t).alias(f"ge_{t}") for t in (25, 50, 75, 100)],
    )


def positional_thirds(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Share of a family's hits by hit midpoint: first 20 %, middle, last 20 % of the subject."""
    mid = (F.col("sstart") + F.col("send")) / 2 / F.col("slen")
    per = hits.groupBy("sseqid").agg(
        F.count("*").alias("n"),
        F.count_if(mid < 0.2).alias("a"),
        F.count_if((mid >= 0.2) & (mid < 0.8)).alias("b"),
        F.count_if(mid >= 0.8).alias("c"),
    )
    n = F.sum("n")
    return (
        _with_family(per, subjects)
        .groupBy("family")
        .agg(
            n.alias("hits"),
            (100 * F.sum("a") / n).alias("pct_first"),
            (100 * F.sum("b") / n).alias("pct_middle"),
            (100 * F.sum("c") / n).alias("pct_last"),
        )
    )
