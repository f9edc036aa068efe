import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from samewise.operators import decide as D
from samewise.operators import evaluate as E
from samewise.operators import features as X
from samewise.operators import model as M
from samewise.operators import rerank as R
from samewise.operators import sampling as P

SCORED = "s1 string, cand string, score double, p double"
quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def brute_ef(rows, pmin, ceil):
    best = {}
    for r in rows:
        if r[1] not in best or (-r[3], -r[2], r[0]) < (-best[r[1]][3], -best[r[1]][2], best[r[1]][0]):
            best[r[1]] = r
    by = {}
    for r in best.values():
        if r[3] >= pmin:
            by.setdefault(r[0], []).append((r[3], r[1]))
    out = {}
    for s, v in by.items():
        v.sort(key=lambda x: (-x[0], x[1]))
        whole, run, top = sum(p for p, _ in v), 0.0, (-1.0, 0)
        for k, (p, _) in enumerate(v, 1):
            run += p
            ef = round(1.25 * run / (0.25 * whole / ceil + k), 12)
            if ef > top[0]:
                top = (ef, k)
        if top[0] > math.exp(sum(math.log1p(-min(p, D.CERTAIN)) for p, _ in v)):
            out[s] = [c for _, c in v[: top[1]]]
    return out


@quick
@given(st.integers(0, 10**6))
def test_expected_f05_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"S1-{rng.randint(1, 6)}", f"S2-{i}", round(rng.random(), 3), round(rng.choice([rng.random(), 0.9, 0.01]), 3)) for i in range(30)] + [("S1-1", "S2-3", 0.5, 0.9)]
    df = spark.createDataFrame(rows, SCORED)
    lists = {r.s1: r.ids for r in D.id_lists(D.expected_f05(df), df.select("s1").distinct()).collect()}
    want = brute_ef(rows, 0.05, 0.99)
    assert lists == {s: want.get(s, []) for s in {r[0] for r in rows}}
    flat = [c for v in lists.values() for c in v]
    assert len(flat) == len(set(flat))


def test_ties_thresholds_and_completion(spark):
    df = spark.createDataFrame([("S1-2", "c", 0.5, 0.8), ("S1-1", "c", 0.5, 0.8), ("S1-3", "c", 0.4, 0.8), ("S1-1", "b", 0.1, 0.5), ("S1-1", "a", 0.9, 0.49)], SCORED)
    assert [(r.s1, r.cand) for r in D.one_to_one(df).where("cand = 'c'").collect()] == [("S1-1", "c")]
    ids = spark.createDataFrame([("S1-1",), ("S1-9",)], "s1 string")
    assert {r.s1: r.ids for r in D.id_lists(D.decide(df, "thr"), ids).collect()} == {"S1-1": ["b", "c"], "S1-9": []}
    assert D.expected_f05(df, pmin=0.99).count() == 0


def test_metrics(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "s1 string, cand string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    pred = pairs([("a", "1"), ("a", "2"), ("a", "3"), ("c", "9"), ("a", "1")])
    truth = pairs([("a", "1"), ("a", "2"), ("d", "7")])
    per = {r.s1: r.f for r in E.per_entity(pred, truth, ids).select("s1", E.f05().alias("f")).collect()}
    assert per["a"] == pytest.approx(0.714, abs=5e-4) and per["b"] == 1.0 and per["c"] == 0.0 and per["d"] == 0.0
    m = E.micro(pred, truth, ids).first()
    assert (m.tp, m.fp, m.fn, m.singletons, m.singletons_right) == (2, 2, 1, 2, 1)
    assert E.macro_f05(pred.limit(0), truth.limit(0), ids).first().macro_f05 == 1.0
    report = E.blocking_report(pred, truth, ids).first()
    assert report.recall == pytest.approx(2 / 3, abs=1e-6) and report.avg_cands == 1.0


def test_truth_pairs_drop_empty_places(spark):
    df = spark.createDataFrame([("a", "x,,y"), ("b", ""), ("c", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, E.truth_pairs(df).collect())) == [("a", "x"), ("a", "y")]


def test_folds_and_samples(spark):
    df = spark.createDataFrame([(f"S1-{i % 40}", i) for i in range(200)], "id string, x int")
    assert P.folds(df, "id").groupBy("id").agg({"fold": "max"}).count() == 40
    assert P.folds(df, "id").groupBy("id", "fold").count().count() == 40
    assert {r.fold for r in P.folds(df, "id").select("fold").distinct().collect()} == {0, 1, 2, 3}
    some = P.sample(df.select("id").distinct(), "id", 10)
    assert some.count() == 10 and sorted(some.collect()) == sorted(P.sample(df.select("id").distinct().repartition(3), "id", 10).collect())


def test_hard_negatives_and_labels(spark):
    cands = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.8), ("a", "3", 0.8), ("a", "4", 0.7)], "s1 string, cand string, score double")
    pairs = spark.createDataFrame([("a", "1"), ("a", "1")], "s1 string, cand string")
    assert sorted(map(tuple, P.hard_negatives(cands, pairs).collect())) == [("a", "1", 1), ("a", "2", 0), ("a", "3", 0)]
    assert P.labelled(cands, pairs).count() == 4


def test_cascade_bounds_are_strict(spark):
    df = spark.createDataFrame([("a", "1", 0.0, 0.4), ("a", "2", 0.0, 0.85), ("a", "3", 0.0, 0.5), ("a", "4", 0.0, None)], SCORED)
    texts = spark.createDataFrame([("a", "x", "y", "z")], "entity_id string, business_name string, business_address string, country string")
    found = {r.cand: r.p for r in R.cascade(df, texts, texts, 0.4, 0.85, 0.5, lambda: lambda a, b: [1.0] * len(a)).collect()}
    assert found == {"1": 0.4, "2": 0.85, "3": 0.75, "4": None}


def test_logits(spark):
    df = spark.createDataFrame([([0.0],), ([2.0],)], "x array<double>")
    assert df.select(R.from_logits(df.x)).first()[0] == 0.5
    two = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    assert two.select(R.from_logits(two.x, 2)).first()[0] == 0.5


def test_trees_and_network_learn(spark):
    rng = random.Random(3)
    rows = [(f"S1-{i % 50}", f"S2-{i}", float(x), float(rng.random()), int(x > 0.5), "us" if i % 2 else "fr") for i in range(400) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "s1 string, cand string, f1 double, f2 double, y int, country string").cache()
    oof = M.out_of_fold(df, 2, ("f1", "f2"), rounds=5, depth=2)
    assert oof.count() == 400 and oof.where("(p > 0.5) <> (y = 1)").count() < 40
    model = M.fit_gbt(df, ("f1", "f2"), rounds=5, depth=2)
    assert M.importances(model, ("f1", "f2"))[0][0] == "f1"
    assert M.leave_country_out(df, ("f1", "f2"), rounds=3, depth=2).count() == 400
    net = M.probability(M.fit_mlp(df, ("f1", "f2"), hidden=4, rounds=40), df)
    assert net.where("(p > 0.5) <> (y = 1)").count() < 60
    assert M.final_rounds([10, 20]) == 16


def test_feature_table(spark):
    from samewise.functions.normalize import prepare

    schema = "entity_id string, business_name string, business_address string, country string"
    left = prepare(spark.createDataFrame([("S1-1", "Acme Tools", "45 Road 02110", "us")], schema))
    right = prepare(spark.createDataFrame([("S3-1", "Ácme Tools", "", "us"), ("S2-1", "Other", "46 Road 02110", "us")], schema))
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1"), ("S1-1", "S2-404")], "s1 string, cand string")
    rows = {r.cand: r for r in X.features(pairs, left, right).collect()}
    a, b = rows["S3-1"], rows["S2-1"]
    assert a.n_jw == 1.0 and a.r_addr_missing == 1 and a.name_only_match == 1 and a.r_nonascii == 1 and a.is_s3 == 1 and a.n_cands == 3
    assert b.num_conflict == 0 and b.zip_jac == 1.0 and b.exact_zip_match == 1 and b.is_s3 == 0
    assert len(X.FEATURES) == 35 and [r.cand for r in X.missing_ids(pairs, left, right).collect()] == ["S2-404"]
