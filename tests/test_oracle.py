"""Spark result == DuckDB oracle SQL for registered queries (sf0.001)."""

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["e03_research_score", "e10_failure_analysis", "m02_knowledge_state", "m04_lru_cache_replay",
        "m06_discovery_ttl_lookup", "m10_pronoun_resolution", "i01_incremental_counts", "i02_index_state",
        "r07_caller_search", "s12_corpus_profile", "x_html_references", "i05_hourly_counters",
        "r01_symbol_search", "r13_fulltext_search"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    from tessera.plans.catalog import CATALOG
    fn, sql = CATALOG[name]
    r = compare(spark, con, name, fn, sql(), SF, verbose=True)
    assert r["ok"], r
