"""Registered queries against their oracles, on generated code as in production."""

import math

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One for each way a plan is built: joins, windows, levels, Python, sets, streams.
SAMPLE = ["A10_merge_files", "A13_workspace_nodes", "A23_size_cap", "B20_resolve_node", "D4_include_join", "D16_method_similarity", "E4_receiver_types", "E5_scored_sites", "F12_arity_files", "G4_dir_list", "G9_symbol_source", "G19_impact_levels", "G20_detect_changes", "G22_subgraph_edges", "G23_shortest_path", "G28_common_word", "R3_quarantine_upsert", "R11_resolve_calls", "R12_cross_root", "K4_debounce", "Y2_canonical_paths"]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def test_every_query_has_a_name_and_oracles_have_queries():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries) and len(catalog.ORACLES) >= 145


@pytest.mark.parametrize("name", SAMPLE)
def test_query_against_its_oracle(spark, sf_dir, oracle, name):
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        df = __spark_entry__.queries()[name](spark, sf_dir)
        got = rows(df.columns, df.collect())
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)
    want = oracle.sql(__spark_entry__.oracle_sql()[name])
    assert got == rows(want.columns, want.fetchall())
