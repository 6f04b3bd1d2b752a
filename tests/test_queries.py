import pytest

import __spark_entry__ as driver
from linkcurate.plans.queries import QUERIES, SQL
from tests.check_queries import connect, difference

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "links_by_source", "message_scan_newest", "links_oldest", "spoken_cleaned", "integrity_checked", "pages_captured",
    "notes_parsed", "notes_classified", "registry_upserted", "resolved_paths", "compendium_lines", "model_triaged", "tile_manifest",
]


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) == set(SQL)
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(driver.oracle_sql()[name]).df()) is None
