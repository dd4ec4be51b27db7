"""Tables of the domain derived from the driver's tables, one SQL text for both engines.

Every view reads whole tables. Genome positions grow with the keys they come from, so the
number of overlaps grows linearly with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "hits": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat('tr', cast(l_partkey as string)) as qseqid,
  concat('te', cast(l_suppkey as string)) as sseqid,
  round(60 + l_discount * 400, 1) as pident,
  cast(l_quantity * 4 as int) as length,
  cast(cast(l_quantity as int) % 7 as int) as mismatch,
  cast(l_linenumber % 3 as int) as gapopen,
  cast(1 + (l_orderkey * 7 + l_linenumber * 131) % 800 as int) as qstart,
  cast((l_orderkey * 7 + l_linenumber * 131) % 800 + l_quantity * 4 as int) as qend,
  cast(case when l_returnflag = 'R' then (l_orderkey * 13 + l_partkey * 17) % 1800 + l_quantity * 4
       else 1 + (l_orderkey * 13 + l_partkey * 17) % 1800 end as int) as sstart,
  cast(case when l_returnflag = 'R' then 1 + (l_orderkey * 13 + l_partkey * 17) % 1800
       else (l_orderkey * 13 + l_partkey * 17) % 1800 + l_quantity * 4 end as int) as send,
  (1 + l_tax * 1000) / l_extendedprice as evalue,
  l_extendedprice / 1000 as bitscore,
  cast(1000 + p_size * 10 as int) as qlen,
  cast(2000 as int) as slen,
  l_extendedprice / 20000 - 1 as score,
  case when l_linestatus = 'O' then 'novel' else 'known' end as category,
  l_returnflag as dataset
from lineitem join part on l_partkey = p_partkey""",
    "subjects": """
select te_id, header, family_raw as name, family, te_length,
  case when family like 'gypsy%' or family like 'roo%' then 'LTR'
       when family like 'Doc%' then 'LINE' when family like 'hobo%' then 'DNA'
       when family like 'INE-%' then 'SINE' else 'Unknown' end as te_class
from (select concat('te', cast(s_suppkey as string)) as te_id,
  concat('te', cast(s_suppkey as string), ' type=x; name=', base, cast(s_nationkey as string),
     '{}', cast(s_suppkey as string), '; class=x;') as header,
  concat(base, cast(s_nationkey as string), '{}', cast(s_suppkey as string)) as family_raw,
  concat(base, cast(s_nationkey as string)) as family,
  cast(2000 as int) as te_length
  from (select s_suppkey, s_nationkey, case s_nationkey % 6 when 0 then 'gypsy' when 1 then 'Doc'
     when 2 then 'hobo' when 3 then 'INE-1' when 4 then 'roo' else '1360' end as base
     from supplier) a) b""",
    "transcripts": """
select p_partkey, concat('tr', cast(p_partkey as string)) as fbtr,
  concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn,
  cast(1000 + p_size * 10 as int) as tx_len,
  concat('chr', cast(p_partkey % 6 as string)) as chrom,
  1 + p_partkey * 97 as g_start,
  p_partkey * 97 + 1000 + p_size * 10 as g_end,
  case when p_size % 2 = 0 then '+' else '-' end as t_strand,
  cast(100 + p_size as int) as utr5_len, cast(500 + p_size * 5 as int) as cds_len,
  cast(400 + p_size * 4 as int) as utr3_len
from part""",
    "repeats": """
select o_orderkey as repeat_id, concat('chr', cast(o_orderkey % 6 as string)) as chrom,
  1 + o_orderkey * 13 as r_start, 21 + o_orderkey * 13 + o_custkey % 180 as r_end,
  concat('rep', cast(o_custkey % 40 as string)) as repeat_name,
  o_orderpriority as repeat_class, o_totalprice / 20000 as divergence
from orders where o_orderstatus <> 'F'""",
    "cds": """
select o_orderkey as cds_id, concat('chr', cast(o_orderkey % 6 as string)) as chrom,
  1 + o_orderkey * 13 as c_start, 21 + o_orderkey * 13 + o_custkey % 60 as c_end,
  concat('tr', cast(o_custkey as string)) as owner
from orders where o_orderstatus = 'F'""",
    "species_blocks": """
select concat('chr', cast(o_orderkey % 6 as string)) as chrom,
  o_orderkey * 13 as b_start, o_orderkey * 13 + 100 + o_custkey % 400 as b_end,
  case o_orderpriority when '1-URGENT' then 'droSim1' when '2-HIGH' then 'droYak2'
    when '3-MEDIUM' then 'droYak3' when '4-NOT SPECIFIED' then 'droEre2' else 'droSec1' end as species
from orders""",
    "score_segments": """
select chrom, seg_start, seg_end, seg_score from (
select concat('chr', cast(o_orderkey % 6 as string)) as chrom, o_orderkey * 13 as seg_start,
  o_orderkey * 13 + 40 as seg_end, o_totalprice / 100000 - 1 as seg_score
from orders) s""",
    "genomic_hits": """
select h.*, t.chrom, t.t_strand,
  case when t_strand = '+' then g_start + qstart - 2 else g_end - qend end as bed_start,
  case when t_strand = '+' then g_start + qend - 1 else g_end - qstart + 1 end as bed_end
from hits h join transcripts t on h.qseqid = t.fbtr""",
    "expression": """
select concat('gn', cast(user_id * 3 as string)) as fbgn,
  case event_type when 'click' then 'adult_ovary' when 'view' then 'adult_head'
    when 'purchase' then 'testis_4d' when 'error' then 'embryo_0_2hr' when 'signup' then 'larva3_fat_body'
    else concat('cns_', event_type) end as tissue,
  round(avg(value) / 3, 6) as rpkm
from events group by user_id, event_type""",
    "gene_sets": """
select distinct concat('go_', lower(replace(p_brand, '#', '_'))) as set_name,
  concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn from part
union all
select distinct concat('expr_', lower(p_type)) as set_name,
  concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn from part
union all
select distinct concat('size_', cast(cast(floor(p_size / 10) as int) as string)) as set_name,
  concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn from part""",
    "gene_groups": """
select distinct p_brand as group_name,
  concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn from part""",
    "localization": """
select concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn,
  case p_size % 8 when 0 then 'Apical enrichment' when 1 then 'basal localization'
    when 2 then 'posterior pole plasm' when 3 then 'perinuclear' when 4 then 'cytoplasmic foci'
    when 5 then 'plasma membrane' when 6 then 'maternal' else lower(p_name) end as term
from part""",
    "go": """
select concat('gn', cast(p_partkey - p_partkey % 3 as string)) as fbgn,
  case p_size % 7 when 0 then 'GO:0003723' when 1 then 'GO:0016301' when 2 then 'GO:0006355'
    when 3 then 'GO:0007049' when 4 then 'GO:0005634' when 5 then 'GO:0016020'
    else 'GO:0009999' end as go_id,
  case p_size % 7 when 0 then 'F' when 1 then 'F' when 2 then 'P' when 3 then 'P' when 4 then 'C'
    when 5 then 'c' else 'P' end as aspect
from part""",
    "synteny": """
select h.l_orderkey, h.l_linenumber, h.l_partkey, h.l_suppkey, h.qseqid as transcript,
  h.sseqid as te_id, h.chrom, h.bed_start as start_pos, h.bed_end as end_pos, h.pident, h.length,
  h.category, h.score,
  (h.l_orderkey * 31 + h.l_partkey * 7) % 101 / 1e2 as sim_coverage,
  (h.l_orderkey * 17 + h.l_partkey * 11) % 101 / 1e2 as yak_coverage,
  (h.l_orderkey * 13 + h.l_partkey * 3) % 101 / 1e2 as ere_coverage,
  (h.l_orderkey * 7 + h.l_partkey * 19) % 101 / 1e2 as sec_coverage,
  greatest((h.l_orderkey * 31 + h.l_partkey * 7) % 101, (h.l_orderkey * 17 + h.l_partkey * 11) % 101,
    (h.l_orderkey * 13 + h.l_partkey * 3) % 101, (h.l_orderkey * 7 + h.l_partkey * 19) % 101) / 1e2
    as any_coverage,
  cast((h.l_orderkey * 31 + h.l_partkey * 7) % 101 >= 50 as int)
   + cast((h.l_orderkey * 17 + h.l_partkey * 11) % 101 >= 50 as int)
   + cast((h.l_orderkey * 13 + h.l_partkey * 3) % 101 >= 50 as int)
   + cast((h.l_orderkey * 7 + h.l_partkey * 19) % 101 >= 50 as int) as syntenic_species
from genomic_hits h""",
    "sequences": """
select doc_id, concat('sq', cast(doc_id as string)) as seq_id, regexp_replace(translate(lower(text),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', ''{g}) as seq
from documents""",
    "subject_seqs": """
select item_id, concat('bm', cast(item_id as string)) as seq_id, regexp_replace(translate(lower(text),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', ''{g}) as seq
from benchmark""",
}
_WORD = re.compile(r"\b([a-z_]+)\b")


def needs(sql: str) -> list[str]:
    """Views a text uses, inner ones first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(from|join)\s+{name}\b", sql):
            for n in [*needs(VIEWS[name]), name]:
                if n not in out:
                    out.append(n)
    return out


def oracle(sql: str) -> str:
    """Stand-alone text for the check engine: the used views become common table expressions."""
    views = [f"{n} as ({VIEWS[n].replace('{g}', ', ' + chr(39) + 'g' + chr(39))})" for n in needs(sql)]
    if not views:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(views) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(views) + ",\n" + body[5:]
    return "with " + ",\n".join(views) + "\n" + body


class Tables:
    """Lazy access to the base tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                self._seen[name] = self.sql(VIEWS[name].replace("{g}", ""))
            else:
                raise AttributeError(name)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        """Run a text whose table names are base tables or views of this folder."""
        used = {}

        def mark(m: re.Match) -> str:
            name = m.group(2)
            if name in BASE or name in VIEWS:
                used[name] = getattr(self, name)
                return f"{m.group(1)}{{{name}}}"
            return m.group(0)

        # braces are placeholders to the formatter, so those of the text itself are doubled
        plain = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(r"((?:from|join)\s+)([a-z_]+)\b", mark, plain), **used)
