"""Registered queries against DuckDB over tables whose keys are those of large ones: heights beyond 2**23 and 2**24, times beyond 2**32."""

import glob
import os

import duckdb
import pytest
from test_registered import rows

from pegtrail.plans import registry


@pytest.fixture(scope="module", params=[8_388_000, 16_776_500])
def shifted(request, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shifted"))
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(f)[:-8]
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        con.execute(f"copy (select * {f'replace ({key} + {request.param} as {key})' if key else ''} from '{f}') to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["competitions_of_years", "decode_headers", "attach_child_coinbase", "verify_commitments"])
def test_equals_duckdb_at_large_keys(spark, shifted, name):
    folder, con = shifted
    assert rows(registry.queries()[name](spark, folder).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())
