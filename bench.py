"""Headline timings: one JSON line with seconds per query.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

from seqtally.plans.registry import spark_queries
from seqtally.session import build_session

HEADLINE = [
    "hit_summary",
    "gene_density_report",
    "strand_bias_by_transcript",
    "strand_bias_by_gene",
    "family_statistics",
    "family_by_dataset",
    "conservation_ladder",
    "repeat_transcript_overlaps",
    "known_and_novel_hits",
    "hits_outside_coding_regions",
    "hit_species_coverage",
    "best_conservation_match",
    "candidate_loci",
    "annotated_loci",
    "position_density",
    "smoothed_signal",
    "raw_peaks",
    "signal_clusters",
    "gene_set_enrichment",
    "false_discovery_rates",
    "expression_gene_sets",
    "dinucleotide_counts",
    "shuffled_sequences",
    "similarity_hits",
    "read_hits_14_columns",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = spark_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # session warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    out = {"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
