import pytest

import oracle
from seqtally.plans import registry
from seqtally.plans.views import BASE

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "gene_density_report", "strand_overview", "family_by_dataset", "conservation_ladder", "known_and_novel_hits",
    "hit_species_coverage", "candidate_loci", "annotated_loci", "first_conservation_match", "raw_peaks",
    "annotated_clusters", "rank_tests", "false_discovery_rates", "annotation_table", "similarity_hits",
    "read_gff", "streamed_strand_tallies",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_check_text_has_a_query():
    texts = registry.check_texts()
    assert set(texts) <= set(registry.spark_queries())
    assert len(texts) >= 150


def test_every_query_reads_the_given_tables():
    for name, text in registry.check_texts().items():
        assert any(f" {b}" in text for b in BASE), name


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_check_text(spark, con, name):
    verdict, detail = oracle.compare(registry.spark_queries()[name](spark, FOLDER), con, registry.check_texts()[name])
    assert verdict == "OK", detail
