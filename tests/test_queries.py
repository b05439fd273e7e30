"""Every query with an oracle, against DuckDB on the smallest tables; plans without cartesian products."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from reckon.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(plain(v) for v in x)
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, decimal.Decimal, np.floating)):
        return round(float(x), 9)
    return int(x) if isinstance(x, (int, np.integer)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    found = (tuple(None if (p := plain(x)) is None else round(float(p), 9) if isinstance(p, (int, float)) and not isinstance(p, bool) else p for x in r) for r in frame.itertuples(index=False, name=None))
    return sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["j2_exact_business_key", "j3_index_position", "j4_object_subobject_position", "j5_name_unit", "j6_name_context", "r3_best_strategy_by_keys", "j8_fuzzy_names", "j14_inherited_codes", "j23_near_variants", "j24_ancestors", "r6_lexical_top_k", "r7_dense_top_k", "r10_active_learning_queue", "r13_assist_pairs", "a12_review_groups", "a13_review_clusters", "a22_retrieval_evaluation", "a29_rule_conflicts", "f13_eligible_evidence"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["flagship_match_calculate_gate", "c5_hierarchy_frontier", "a4_card_totals", "d3_line_id_collisions", "r2_ranked_sources", "w2_chain_validation"])
def test_row_order_does_not_matter(spark, name, tmp_path):
    for f in os.listdir(SF):
        spark.read.parquet(f"{SF}/{f}").repartition(3).sortWithinPartitions(spark.read.parquet(f"{SF}/{f}").columns[-1]).write.parquet(f"{tmp_path}/{f}")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(QUERIES[name](spark, SF).toPandas())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
