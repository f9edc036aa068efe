"""Queries against their SQL twins on the smallest tables, and the driver's contract."""

import glob
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
NAMES = ["io_pool_union", "n_base", "n_name", "n_addr", "n_variant_g1", "t_word12", "tfidf_weights", "block_topk_name_word", "block_fallback", "block_inverted", "f_jaccard", "f_flags", "f_ratio", "f_context", "one_to_one", "decide_ef", "macro_f05", "micro_scores", "prune_sweep", "hard_negatives", "group_fold", "validate_report", "cascade_blend", "id_list_sink"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"] and df.count() > 0


def test_p5_against_brute_force(spark, duck):
    from samewise.operators.packed import split_packed

    labels = duck.sql("select source1_entity_id, matched_entity_ids from train_labels").fetchall()
    want = {(s, k, v) for s, t in labels for k, v in enumerate(split_packed(t), 1)}
    assert {tuple(r) for r in entry.queries()["p5_found"](spark, DIR).collect()} == want
