"""Longer compositions: candidate pipelines from matched hits to annotated loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import loci as lc
from ..scale import stage
from .hit_queries import KEYS
from .interval_queries import ANCIENT, CPLX, LOCI, MATCH, _judged, _matched, _repeated
from .registry import query
from .shape import shown
from .views import Tables

SAME = " and ".join(f"s.{k} = {{0}}.{k}" for k in KEYS)
_LOCI = LOCI.replace("), b as (", "), lb as (").replace("from b group", "from lb group")[5:]
MATCHED = (
    f"select s.* exclude (score), phylo as score from synteny s join b on {SAME.format('b')} "
    "where rn = 1 and ms > 1.5 and syntenic_species >= 2 and phylo > 1"
)

#: what loci without details are made of
LOCUS = ["transcript", "te_id", "chrom", "start_pos", "end_pos", "score"]


def _to_loci(t: Tables, hits: DataFrame) -> DataFrame:
    fam = t.subjects.select("te_id", F.col("family").alias("te_family"))
    named = hits.select(*LOCUS).join(fam, "te_id").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    # islands read their hits twice; what finds the hits runs once
    return lc.collapse_loci(stage(named.drop("te_id"), "named"), details=False)


@query(
    "matched_annotated_loci",
    MATCH.rstrip()
    + ", "
    + _LOCI.replace(ANCIENT, MATCHED)
    + """, o as (select distinct transcript, l.chrom, start, owner from loci l join cds c on c.chrom = l.chrom and greatest(l.start, c_start) < least(l."end", c_end))
    select concat(l.transcript, '|', l.chrom, '|', l.start, '-', l."end") as locus_id, l.n_hits, l.te_families, l.best_score, count(owner) > 0 as has_overlap,
    coalesce(string_agg(owner, ',' order by owner), '') as owners from loci l left join o on l.transcript = o.transcript and l.chrom = o.chrom and l.start = o.start
    group by 1, 2, 3, 4""",
)
def _(t: Tables):
    loci = _to_loci(t, lc.ancient_candidates(_matched(t, F.col("syntenic_species") >= 2)))
    out = lc.annotate_loci(stage(loci), t.cds)
    return shown(out.select("locus_id", "n_hits", "te_families", "best_score", "has_overlap", "owners"), raw=("best_score",))


FILTERED = f"""select s.* from synteny s join r on {SAME.format('r')} where syntenic_species >= 2 and s.score > 1 and reason in ('passed', 'no_sequence')
 and not exists (select 1 from cds c where c.chrom = s.chrom and greatest(s.start_pos, c.c_start) < least(s.end_pos, c.c_end))"""


@query(
    "filtered_ranked_loci",
    CPLX.rstrip()
    + ", "
    + _LOCI.replace(ANCIENT, FILTERED)
    + """select transcript, chrom, start, "end", te_families, n_hits, best_score, case when n_families = 1 then 'clean' else 'suspicious' end as verdict,
    row_number() over (partition by n_families = 1 order by best_score desc, transcript, chrom, start) as rank from loci""",
)
def _(t: Tables):
    simple = _judged(t, _repeated(t), *LOCUS).where("simple_ok")
    outside = iv.overlaps_any(
        simple, t.cds, ["chrom"], ("start_pos", "end_pos"), ("c_start", "c_end"), ["row_id"], keep=False
    )
    out = lc.split_loci(_to_loci(t, outside))
    cols = ["transcript", "chrom", "start", "end", "te_families", "n_hits", "best_score", "verdict", "rank"]
    return shown(out.select(*cols), raw=("best_score",))
