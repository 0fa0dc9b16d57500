"""The contract: names, and every query with SQL agrees with DuckDB on a small table set."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spark_entry

SF = "/root/testdata/sf0.001"
SOME = ("find_node", "limit_search", "edge_visibility", "g_csr_build", "g_neighbors", "g_path", "g_context_pack", "snk_nodes_tsv", "src_sidecar", "i_imp_python", "i_markdown", "l_morton")


def test_names():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_agrees(spark, name):
    got = spark_entry.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem pages documents".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(spark_entry.oracle_sql()[name]).df()[list(got.columns)]
    want = want.astype(got.dtypes.to_dict(), errors="ignore")

    def rows(df):
        return sorted(str([None if pd.isna(x) else x for x in r]) for r in df.itertuples(index=False, name=None))

    assert rows(got) == rows(want)
