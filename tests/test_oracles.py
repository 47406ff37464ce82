"""Every registered query against its DuckDB oracle on the driver tables."""

import pytest

from tesserae.plans.check import compare
from tesserae.plans.queries import ORACLES, QUERIES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, verbose=False)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(results, name):
    r = results[name]
    assert "error" not in r, r
    if name in ORACLES:
        assert r["ok"], r


def test_tables_as_folders_of_part_files(spark, tmp_path):
    from tesserae.sources.tables import TABLES, table_path
    for t in TABLES:
        spark.read.parquet(table_path(SF_SMALL, t)).repartition(3).write.parquet(table_path(str(tmp_path), t))
    r = compare(spark, str(tmp_path), verbose=False)
    assert not [n for n, v in r.items() if "error" in v or v["ok"] is not True], r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and df.columns == ["job_title", "stats_average", "stats_total_users"]
    assert set(e.oracle_sql()) <= set(e.queries())
