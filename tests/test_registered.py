"""Registered queries against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pegtrail.plans import registry


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].values.tolist()), key=repr)


#: One or two of each module: the driver compares all of them.
SOME = ["parent_rollup", "representative", "nearest_canonical", "publication_category", "filter_unknown", "attribute_parent", "navigate_branches", "parent_gaps", "repair_candidates", "competitions", "delta_histogram", "build_proofs", "source_health", "height_at_time", "match_tags", "islands", "reduce_nodes", "nearest_strip", "stale_branches", "place_components", "cascade", "infer_stale", "classify_parents", "effective", "merge_events", "orphan_verdict", "decode_headers", "verify_slots", "resolve_windows", "verify_commitments", "capture_rsk", "rsk_contradictions"]


@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(spark, con, small, name):
    assert rows(registry.queries()[name](spark, small).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())
