"""Named queries against their reference SQL on the smallest tables.

Every query by default; FRAMELAKE_QUICK=1 runs a cross-section.
"""

import os

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from framelake.plans.fixtures import BASE_TABLES

CROSS_SECTION = (
    "p1_explode_pixels a1_palette_histogram j2_palette_drift a10_inspect_frames j8_sheet_match w1_cumulative_timestamps w2_duplicate_of "
    "w7_neighbour_frames j12_frame_at_elapsed w6_verify_revision_chain j10_verify_artifacts j14_verify_ancestry v2_validate_contract_v2 "
    "v8_flat_frame_rules v21_repair_plan s10_engine_index s3_scan_animation_headers x1_stream_frames"
).split()
NAMES = [n for n in entry.oracle_sql() if not os.environ.get("FRAMELAKE_QUICK") or n in CROSS_SECTION]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def normal(values):
    return tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_reference_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((normal(r) for r in cursor.fetchall()), key=repr)
    assert sorted((normal(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


def test_contract_of_the_entry_module(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
