"""Candidate hits: matching, filtering, collapsing to loci and reporting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions.coords import locus_id
from ..scale import quantiles, skew_join, stage, with_row_number
from . import intervals as iv

#: finest grid of a match search: cells as wide as a loss of 0.5 / 2 ** 12
MAX_LEVEL = 12


def classify_known(
    hits: DataFrame,
    repeats_on_query: DataFrame,
    key: Sequence[str],
    order: str = "repeat_id",
    bin_width: int = 512,
) -> DataFrame:
    """Label hits known or novel by overlap with annotated repeats on their query.

    repeats_on_query: qseqid, rep_start, rep_end (1-based closed), repeat_name,
    repeat_class, divergence and the `order` column that decides which repeat is first.
    """
    payload = [order, "repeat_name", "repeat_class", "divergence"]
    first = (
        iv.overlap_join(
            hits.select("qseqid", "qstart", "qend", *key),
            repeats_on_query.select("qseqid", "rep_start", "rep_end", *payload),
            ["qseqid"],
            ("qstart", "qend"),
            ("rep_start", "rep_end"),
            bin_width=bin_width,
        )
        .groupBy(*key)
        .agg(F.min(F.struct(*payload)).alias("_r"))
        .select(*key, *[F.col(f"_r.{c}").alias(c) for c in payload if c != order])
    )
    return hits.join(first, list(key), "left").withColumn(
        "status", F.when(F.col("repeat_name").isNull(), "novel").otherwise("known")
    )


def repeats_on_transcripts(
    repeats: DataFrame,
    transcripts: DataFrame,
    min_overlap: int = 20,
    compat: bool = False,
    bin_width: int = 2048,
) -> DataFrame:
    """Genome repeats mapped to transcript positions.

    Positions are 1-based and follow the transcript strand. compat=True instead reproduces
    the older convention: 0-based from the genome-side start whatever the strand.
    """
    pairs = iv.overlap_columns(
        iv.overlap_join(
            repeats,
            transcripts,
            ["chrom"],
            ("r_start", "r_end"),
            ("g_start", "g_end"),
            min_overlap=min_overlap,
            bin_width=bin_width,
        ),
        ("r_start", "r_end"),
        ("g_start", "g_end"),
    )
    forward = F.col("overlap_start") - F.col("g_start")
    if compat:
        start = forward
    else:
        start = F.when(
            F.col("t_strand") == "-", F.col("g_end") - F.col("overlap_end") + 1
        ).otherwise(forward + 1)
    return pairs.withColumn("rep_start", start).withColumn(
        "rep_end", F.col("rep_start") + F.col("overlap_len") - 1
    )


def match_score(p1: str, p2: str, l1: str, l2: str) -> Column:
    """2 - |identity difference| / 100 - |length difference| / longer length."""
    longest = F.greatest(F.col(l1), F.col(l2), F.lit(1))
    return (1 - F.abs(F.col(p1) - F.col(p2)) / 100) + (
        1 - F.abs(F.col(l1) - F.col(l2)) / longest
    )


def best_match_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_key: Sequence[str],
    right_order: str,
    payload: Sequence[str],
    min_score: float = 1.5,
    few: int = 64,
) -> DataFrame:
    """For each left row the right row of the same keys with the best match score.

    Both sides carry pident and length; the right side's are named r_pident, r_length. Ties
    go to the lowest `right_order`. Rows whose best score is not above `min_score` drop out.

    Only identity and length of the right row enter the score, so right rows are reduced
    to the first per (keys, identity, length) before they meet the left side, and left rows
    to their distinct (keys, identity, length): a pile of equal rows on either side is one
    row in the join. The winner is kept by a running max, not by collecting a group.

    Keys with more than `few` right shapes are searched on grids. A cell is as wide in
    identity and in log length as a loss of `reach`; who finds a match that loses no more than
    that in its own cell and those around it has the best one, and only the others look again
    on the next grid, twice as coarse, up to the loss that `min_score` allows. A crowded key
    starts where its cells hold some `few` shapes, so its pairs grow with its rows.
    """
    on = list(on)
    shape = [*on, "pident", "length"]
    reps = (
        right.groupBy(*on, "r_pident", "r_length")
        .agg(F.min(F.struct(right_order, *[c for c in payload if c != right_order])).alias("_p"))
    )
    wanted = left.select(*shape).distinct()
    score = match_score("pident", "r_pident", "length", "r_length")
    rank = F.struct(score.alias("score"), (-F.col(f"_p.{right_order}")).alias("neg"), F.col("_p"))

    def best_of(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_rank", rank).groupBy(*shape).agg(F.max("_rank").alias("_best"))

    reps = stage(reps, "shapes")
    level = F.floor(F.log2(F.count(F.lit(1)) / few) / 2).cast("int")
    crowded = stage(reps.groupBy(*on).agg(F.greatest(F.lit(0), F.least(level, F.lit(MAX_LEVEL))).alias("_level")).where("_level > 0"), "crowded")
    deepest = crowded.select(F.max("_level")).first()[0] or 0
    found = []
    if deepest:
        wanted = wanted.join(crowded, on, "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
        open_ = stage(wanted, "wanted")
        near = reps.join(crowded.select(*on), on, "left_semi")
        for step in range(deepest, 0, -1):
            reach = (2 - min_score) / 2**step
            cells = _cells("r_pident", "r_length", reach)
            around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
            x, y = _cells("pident", "length", reach)
            looking = open_.where(F.col("_level") >= step).withColumn("_a", around)
            looking = looking.select(*shape, (x + F.col("_a.i")).alias("_x"), (y + F.col("_a.j")).alias("_y"))
            best = best_of(skew_join(looking, near.select("*", cells[0].alias("_x"), cells[1].alias("_y")), [*on, "_x", "_y"]))
            # what lies outside the cells around loses more than `reach`; a hair less for rounding
            settled = stage(best.where(F.col("_best.score") >= 2 - reach * (1 - 1e-9)), "settled")
            found.append(settled)
            open_ = stage(open_.join(settled.select(*shape), shape, "left_anti"), "open")
        wanted = open_.select(*shape)
    found.append(best_of(skew_join(wanted, reps, on)))
    best = (
        reduce(DataFrame.unionByName, found)
        .where(F.col("_best.score") > min_score)
        .select(
            *shape,
            F.col("_best.score").alias("match_score"),
            *[F.col(f"_best._p.{c}").alias(c) for c in payload],
        )
    )
    return skew_join(left, best, shape)


def _cells(pident: str, length: str, reach: float) -> tuple[Column, Column]:
    """Cell of an identity and a length; cells two apart in either lose at least `reach`."""
    loss = F.log(F.greatest(F.col(length), F.lit(1)).cast("double"))
    return F.floor(F.col(pident) / (100 * reach)), F.floor(loss / -math.log1p(-reach))


def first_match_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], order: str, payload: Sequence[str]
) -> DataFrame:
    """Left rows with the right row of lowest `order` for the same keys."""
    first = (
        right.groupBy(*on)
        .agg(F.min(F.struct(order, *payload)).alias("_f"))
        .select(*on, *[F.col(f"_f.{c}").alias(c) for c in payload])
    )
    return skew_join(left, first, on)


def merge_conservation(synteny: DataFrame, conservation: DataFrame) -> DataFrame:
    """Exact-name join; syntenic when at least 2 of the 3 closest species reach 0.5."""
    three = ["sim_coverage", "yak_coverage", "ere_coverage"]
    return (
        skew_join(synteny, conservation.select("name", "score"), ["name"])
        .withColumn("syntenic_species", iv.syntenic_count(three))
        .withColumn("is_syntenic", F.col("syntenic_species") >= 2)
    )


def ancient_candidates(df: DataFrame, min_species: int = 2, min_score: float = 1) -> DataFrame:
    return df.where((F.col("syntenic_species") >= min_species) & (F.col("score") > min_score))


def complexity_columns(df: DataFrame, seq: str = "qseq") -> DataFrame:
    """Add entropy, at_content and homopolymers of the gap-free sequence.

    The three go through a one-element inline_outer(), so that a later filter on them reads
    the finished columns instead of having the whole expressions copied into its predicate.
    """
    bare = sq.ungap(F.col(seq))
    measures = F.struct(
        sq.shannon_entropy(bare).alias("entropy"),
        sq.at_content(bare).alias("at_content"),
        sq.homopolymer_runs(bare).alias("homopolymers"),
    )
    return df.withColumn("_m", F.array(measures)).select(*df.columns, F.inline_outer("_m"))


def complexity_reason(
    min_entropy: float = 1.5, max_at: float = 0.75, max_runs: int = 3
) -> Column:
    """First failing rule, `passed`, or `no_sequence` (such rows are kept)."""
    return (
        F.when(F.col("entropy").isNull(), "no_sequence")
        .when(F.col("entropy") < min_entropy, "low_entropy")
        .when(F.col("at_content") > max_at, "high_at")
        .when(F.col("homopolymers") > max_runs, "homopolymer")
        .otherwise("passed")
    )


def complexity_filter(df: DataFrame, seq: str = "qseq", **limits) -> DataFrame:
    """Keep rows that pass all rules or have no sequence; columns of the rules included."""
    tagged = complexity_columns(df, seq).withColumn("reason", complexity_reason(**limits))
    return tagged.where(F.col("reason").isin("passed", "no_sequence"))


def complexity_counts(df: DataFrame, seq: str = "qseq", **limits) -> DataFrame:
    tagged = complexity_columns(df, seq).withColumn("reason", complexity_reason(**limits))
    return tagged.groupBy("reason").agg(F.count(F.lit(1)).alias("hits"))


def collapse_loci(
    df: DataFrame,
    by: Sequence[str] = ("transcript", "chrom"),
    gap: int = 10,
    ties: Sequence[str] = (),
    details: bool = True,
) -> DataFrame:
    """Hits of a transcript to loci: joined while start <= running end + gap.

    The best score keeps its identity and length; among equal scores the hit that starts
    first wins, then the lowest `ties` (numeric columns). details=False leaves out the
    subjects, the maxima and all of the best hit but its score, which the shuffles need not carry then.
    """
    if not details:
        kept = [iv.count_rows("n_hits"), iv.set_of("te_families", F.col("te_family")), iv.max_of("best_score", F.col("score"))]
        out = iv.collapse(df, by, gap=gap, measures=kept)
        return out.select(
            *by, "start", "end", "n_hits", "te_families", F.size("te_families").alias("n_families"), "best_score"
        )
    ranking = [F.col("score"), -F.col("start"), *[-F.col(t) for t in ties]]
    payload = {"score": F.col("score"), "pident": F.col("pident"), "length": F.col("length")}
    out = iv.collapse(
        df,
        by,
        gap=gap,
        measures=[
            iv.count_rows("n_hits"),
            iv.set_of("te_ids", F.col("te_id")),
            iv.set_of("te_families", F.col("te_family")),
            iv.max_of("max_length", F.col("length")),
            iv.max_of("max_species", F.col("syntenic_species")),
            iv.best_of("_best", ranking, payload),
        ],
    )
    return out.select(
        *by,
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("locus_length"),
        "n_hits",
        "te_ids",
        "te_families",
        F.size("te_families").alias("n_families"),
        F.col("_best.score").alias("best_score"),
        F.col("_best.pident").alias("best_pident"),
        F.col("_best.length").alias("best_length"),
        "max_length",
        "max_species",
    )


def split_loci(loci: DataFrame) -> DataFrame:
    """clean (one family) or suspicious (several), ranked by score inside each class.

    The classes are numbered with slab offsets rather than one window per class.
    """
    tagged = loci.withColumn(
        "verdict", F.when(F.col("n_families") == 1, "clean").otherwise("suspicious")
    )
    order = [F.col("verdict"), F.desc("best_score"), F.col("transcript"), F.col("chrom"), F.col("start")]
    numbered = with_row_number(tagged, *order, name="_pos")
    first = numbered.groupBy("verdict").agg((F.min("_pos") - 1).alias("_before"))
    # two rows at most
    return (
        numbered.join(F.broadcast(first), "verdict")
        .withColumn("rank", F.col("_pos") - F.col("_before"))
        .drop("_pos", "_before")
    )


def annotate_loci(loci: DataFrame, cds: DataFrame, bin_width: int = 2048) -> DataFrame:
    """Loci with id, coding overlap flag and the list of overlapped owners.

    cds: chrom, c_start, c_end, owner.
    """
    keyed = loci.withColumn("locus_id", locus_id("transcript", "chrom", "start", "end"))
    return iv.overlap_owners(
        keyed, cds, ["chrom"], ("start", "end"), ("c_start", "c_end"), ["locus_id"], "owner",
        bin_width=bin_width,
    )


def filter_funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows that survive each stage in turn and rows it removes: (step, stage, kept, removed)."""
    flags, passed = [], F.lit(True)
    names = list(stages)
    for name in names:
        passed = passed & F.coalesce(stages[name], F.lit(False))
        flags.append(F.count_if(passed).alias(name))
    return funnel_rows(df.agg(F.count(F.lit(1)).alias("_all"), *flags), names)


def funnel_rows(one: DataFrame, names: Sequence[str]) -> DataFrame:
    """The funnel of one row of counts: all rows (`_all`) and those kept by each stage, by its name."""
    rows, before = [], F.col("_all")
    for i, name in enumerate(names, 1):
        rows.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("stage"),
                F.col(name).alias("kept"),
                (before - F.col(name)).alias("removed"),
            )
        )
        before = F.col(name)
    return one.select(F.inline(F.array(*rows)))


def rank_candidates(df: DataFrame, n: int = 100, ties: Sequence[str] = ()) -> DataFrame:
    """Highest scores first, with their rank."""
    from .hits import number_rows

    order = [F.desc("score"), *[F.col(t) for t in ties]]
    return number_rows(df.orderBy(*order).limit(n), *order)


def candidate_details(
    candidates: DataFrame,
    hits: DataFrame,
    sequences: DataFrame,
    symbols: DataFrame,
    subjects: DataFrame,
    hit_order: str,
    flank: int = 10,
) -> DataFrame:
    """Candidates with gene symbol, subject name, their first hit and its sequence context."""
    first = (
        hits.groupBy(F.col("qseqid").alias("transcript"), F.col("sseqid").alias("te_id"))
        .agg(F.min(F.struct(hit_order, "qstart", "qend", "evalue")).alias("_h"))
        .select("transcript", "te_id", "_h.qstart", "_h.qend", "_h.evalue")
    )
    out = candidates.join(first, ["transcript", "te_id"], "left")
    out = skew_join(out, symbols.select("transcript", "symbol"), ["transcript"], "left")
    out = skew_join(out, subjects.select("te_id", F.col("name").alias("te_name")), ["te_id"], "left")
    seqs = sequences.select(F.col("seq_id").alias("transcript"), "seq")
    out = skew_join(out, seqs, ["transcript"], "left")
    qs, qe, seq = F.col("qstart"), F.col("qend"), F.col("seq")
    blank = F.lit("")
    return out.withColumns(
        {
            "symbol": F.coalesce("symbol", F.lit("Unknown")),
            "te_name": F.coalesce("te_name", "te_id"),
            "hit_seq": F.coalesce(sq.hit_subseq(seq, qs, qe), blank),
            "seq_context": F.coalesce(sq.hit_context(seq, qs, qe, flank), blank),
        }
    ).drop("seq")


def candidates_by_gene(df: DataFrame, shown: int = 3) -> DataFrame:
    """Per gene: candidates, best score, the first families by name and how many more."""
    fams = F.array_sort(F.collect_set("te_name"))
    more = F.size("_f") - shown
    return (
        df.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.max("score").alias("best_score"),
            fams.alias("_f"),
        )
        .withColumn(
            "families",
            F.concat(
                F.array_join(F.slice("_f", 1, shown), ", "),
                F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""),
            ),
        )
        .drop("_f")
    )


def candidate_overview(df: DataFrame) -> DataFrame:
    """count, mean, median, min and max of score, length and pident (long form)."""
    names = ["score", "length", "pident"]
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in names]
            )
        ).alias("m")
    ).select("m.measure", "m.v")
    basic = long.groupBy("measure").agg(
        F.count("v").alias("n"), F.avg("v").alias("v_mean"), F.min("v").alias("v_min"),
        F.max("v").alias("v_max"),
    )
    return basic.join(quantiles(long, ["measure"], "v", {"v_median": 0.5}), "measure")


def four_way(df: DataFrame, score: str = "score", syntenic: str = "is_syntenic") -> DataFrame:
    """Counts in the conserved x syntenic grid: high above 0.5, low below 0."""
    level = (
        F.when(F.col(score) > 0.5, "high").when(F.col(score) < 0, "low").otherwise("between")
    )
    place = F.when(F.col(syntenic), "syntenic").otherwise("not_syntenic")
    return df.groupBy(level.alias("conservation"), place.alias("synteny")).agg(
        F.count(F.lit(1)).alias("hits"), F.avg(score).alias("mean_score")
    )
