import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from samewise.functions.normalize import prepare
from samewise.operators import blocking as B
from samewise.operators import inverted as I
from samewise.operators.hot import hot_keys, salted_join, salted_pairs
from samewise.operators.tfidf import fit_transform

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def records(n, prefix, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeglnorst") for _ in range(rng.randint(3, 6)))
    names = [f"{word()} {word()}" for _ in range(12)]
    return [(f"{prefix}-{i:03}", rng.choice(names) + " " + word(), f"{rng.randint(1, 99)} {word()} road", rng.choice(["us", "us", "france"])) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    left = prepare(spark.createDataFrame(records(60, "S1", 1), SCHEMA)).cache()
    right = prepare(spark.createDataFrame([*records(80, "S2", 2), ("S2-900", "abel", "", "spain")], SCHEMA)).cache()
    return left, right


def brute(left, right, k, threshold, max_df):
    out = {}
    grams = lambda s: Counter(s[i : i + 3] for i in range(len(s) - 2))
    for q in right:
        index = [r for r in left if r.country == q.country] or left
        n = len(index)
        df = Counter(t for r in index for t in grams(r.nosp))
        idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d <= max_df * n}

        def vec(s, idf=idf):
            v = {t: (1 + math.log(c)) * idf[t] for t, c in grams(s).items() if t in idf}
            length = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / length for t, x in v.items()}

        a = vec(q.nosp)
        sims = [(-round(sum(x * b.get(t, 0) for t, x in a.items()), 6), r.entity_id) for r in index if (b := vec(r.nosp)) is not None]
        for s, i in sorted(x for x in sims if -x[0] > threshold)[:k]:
            out[q.entity_id, i] = -s
    return out


@pytest.mark.parametrize("strategy", ["relational", "block", "auto"])
def test_topk_against_brute_force(tables, strategy):
    left, right = tables
    parts = B.with_parts(left, right)
    found = {(r.q, r.s): r.sim for r in B.channel_topk(*parts, "nosp", k=4, max_df=0.5, strategy=strategy).collect()}
    want = brute(left.collect(), right.collect(), 4, 0.1, 0.5)
    assert found.keys() == want.keys()
    assert all(found[p] == pytest.approx(want[p], abs=2e-6) for p in want)


def test_lsh_recall(tables):
    left, right = B.with_parts(*tables)
    exact = {(r.q, r.s) for r in B.channel_topk(left, right, "nosp", k=3, threshold=0.3, strategy="relational").collect()}
    near = {(r.q, r.s) for r in B.channel_topk(left, right, "nosp", k=3, threshold=0.3, strategy="lsh").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_fused_scores_ranks_and_gaps(tables):
    rows = B.block(*tables, k=3, max_df=0.5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.cand, []).append(r)
        assert r.score == max(r.sim_name, r.sim_addr) + 0.5 * min(r.sim_name, r.sim_addr)
    for group in by.values():
        group.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in group] == list(range(len(group)))
        assert group == sorted(group, key=lambda r: (-r.score, r.s1))
        assert all(r.best == group[0].score for r in group)
        assert group[0].gap == pytest.approx(group[0].best - (group[1].score if len(group) > 1 else 0))
    kept = B.prune(B.block(*tables, k=3, max_df=0.5), 0.2, 0.1, 2).collect()
    assert all(r["rank"] < 2 and r.score >= r.best - 0.2 for r in kept) and len(kept) < len(rows)


def test_unseen_country_searches_everything(tables):
    left, right = tables
    parts = B.with_parts(left.where("country <> 'france'"), right)
    assert {r.part for r in parts[1].where("country = 'france'").collect()} == {"*"}
    assert parts[0].where("part = '*'").count() == left.where("country <> 'france'").count()


def test_empty_tables(spark, tables):
    left, right = tables
    none = left.limit(0)
    for a, b in ((none, right), (left, none), (none, none)):
        assert B.block(a, b).count() == 0 and I.block_inverted(a, b).count() == 0 and I.block_combined(a, b).count() == 0


def test_no_term_left_gives_no_rows(spark):
    df = prepare(spark.createDataFrame([("S1-1", "same name", "", "us"), ("S1-2", "same name", "", "us")], SCHEMA))
    a, _ = fit_transform(df.withColumn("part", F.col("country")), df.withColumn("part", F.col("country")), "nosp")
    assert a.count() == 0


def test_inverted_index(spark):
    left = prepare(spark.createDataFrame([("S1-1", "Acme Tools Corp", "45 x", "us"), ("S1-2", "Acme Foods", "7 y", "us")], SCHEMA))
    right = prepare(spark.createDataFrame([("S2-1", "Acme Tools", "45 z", "us"), ("S2-2", "Zulu", "", "us")], SCHEMA))
    keys = set(left.where("entity_id = 'S1-1'").select(F.explode(I.block_keys(F.col("nosp"), F.col("core"), F.col("nums")))).toPandas().iloc[:, 0])
    assert {"nosp:acmetuls", "bg:acme tuls", "pfx:acm tul", "num:45", "c4:acme"} <= keys
    rows = {(r.s1, r.cand): r.block_hits for r in I.block_inverted(left, right).collect()}
    assert rows["S1-1", "S2-1"] > rows["S1-2", "S2-1"] and not any(c == "S2-2" for _, c in rows)
    assert I.block_inverted(left, right, hot=1).count() == 0


def test_hot_keys_have_a_bound(spark):
    counts = spark.createDataFrame([(str(i), 1) for i in range(100)] + [("hot", 900)], "k string, n long")
    assert [r.k for r in hot_keys(counts, "k", "n", 1000, parts=10).collect()] == ["hot"]


def test_salted_pairs_are_all_pairs_of_a_bucket(spark):
    rows = [("x", i) for i in range(50)] + [("y", 1), ("z", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "bucket string, i long")
    pairs = salted_pairs(df, ["bucket"], "i", block=7).collect()
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2
    assert all(p.a < p.b for p in pairs)


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(40)] + [("k", 1), (None, 2)], "key string, a long")
    right = spark.createDataFrame([("h", i) for i in range(30)] + [("k", 5), ("k", 6), (None, 2)], "key string, b long")
    rows = salted_join(left, right, "key", block=8).collect()
    assert len(rows) == len(set(rows)) == 40 * 30 + 2


def test_no_key_is_too_common(spark):
    index = spark.createDataFrame([(f"S1-{i:05}", "commonname", "commonname", "", "us") for i in range(300)], "entity_id string, nosp string, core string, nums string, country string")
    pool = spark.createDataFrame([("S2-1", "commonname", "commonname", "", "us")], "entity_id string, nosp string, core string, nums string, country string")
    assert I.block_inverted(index, pool, most=400).count() == 300 and I.block_inverted(index, pool, most=400, hot=300).count() == 0


def test_block_product_keeps_the_best_and_their_equals():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    side = lambda n: pd.DataFrame([(f"{i:02}", t, float(rng.integers(1, 4))) for i in range(n) for t in rng.choice(12, 4, replace=False)], columns=["id", "term", "w"])
    a, b = side(30), side(20)
    x, y = (d.pivot(index="id", columns="term", values="w").reindex(columns=range(12)).fillna(0.0) for d in (a, b))
    want = y.to_numpy() @ x.to_numpy().T
    for k, at_once in ((None, 1 << 20), (3, 7)):
        found = {(q, s): v for q, s, v in zip(*B.block_product(a, b, 0.5, k, at_once))}
        keep = (want > 0.5) & (want >= (np.sort(want, axis=1)[:, -k, None] if k else 0))
        assert found == {(y.index[i], x.index[j]): want[i, j] for i, j in zip(*np.nonzero(keep))}


def test_search_finds_the_best_of_brute_force():
    import numpy as np

    from samewise.operators import retrieve as R

    rng = np.random.default_rng(3)

    def vectors(n, unit):
        x = np.where(rng.random((n, 40)) < np.linspace(0.05, 0.6, 40), rng.integers(1, 4, (n, 40)), 0).astype(float)
        x[0] = 0
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) if unit else x

    for unit, n, k, threshold in ((True, 900, 5, 0.1), (True, 70, 5, 0.5), (False, 900, 30, 0.0), (True, 3, 5, 0.1)):
        a, b = vectors(n, unit), vectors(60, unit)
        post = lambda x: (*np.nonzero(x), x[np.nonzero(x)])
        q, s, v = R.search(R.Block(*post(a), n, 40), *post(b), k, threshold, np.full(60, threshold), unit)
        found = sorted(zip(q.tolist(), s.tolist(), v.tolist()))
        sims = np.round(b @ a.T, R.DIGITS)
        want = sorted((i, j, sims[i, j]) for i in range(60) for j in sorted(np.flatnonzero(sims[i] > threshold), key=lambda j: (-sims[i, j], j))[:k])
        assert [x[:2] for x in found] == [x[:2] for x in want] and [x[2] for x in found] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_many_queries_are_added_up_at_once(monkeypatch):
    import numpy as np

    from samewise.operators import retrieve as R

    rng = np.random.default_rng(5)
    a, b = (np.where(rng.random((n, 30)) < 0.3, rng.random((n, 30)), 0) for n in (200, 50))
    post = lambda x: (*np.nonzero(x), x[np.nonzero(x)])
    passes, bincount = [], np.bincount

    def search():
        block, floor = R.Block(*post(a), 200, 30), np.full(50, 0.1)
        monkeypatch.setattr(np, "bincount", lambda *x: passes.append(1) or bincount(*x))
        found = sorted(zip(*(x.tolist() for x in R.search(block, *post(b), 5, 0.1, floor, True))))
        monkeypatch.setattr(np, "bincount", bincount)
        return found

    sims = np.round(b @ a.T, R.DIGITS)
    want = sorted((i, int(j), sims[i, j]) for i in range(50) for j in np.argsort(-sims[i], kind="stable")[:5])
    whole = search()
    assert len(passes) == 1 and [x[:2] for x in whole] == [x[:2] for x in want]
    for scores, items in ((1, 1 << 18), (1, 1), (1 << 18, 1)):  # a query at a time; a few lists at a time
        monkeypatch.setattr(R, "SCORES", scores)
        monkeypatch.setattr(R, "ITEMS", items)
        passes.clear()
        assert search() == whole and len(passes) >= 50


def test_stored_blocks_equal_the_join_of_postings(spark, tables, monkeypatch):
    from samewise.operators import retrieve

    monkeypatch.setattr(retrieve, "BLOCK", 7)
    left, right = B.with_parts(*tables)
    twice = right.unionByName(right.where("entity_id = 'S2-003'").withColumn("nosp", F.lit("abelground")))  # one id, two texts
    key = lambda d: sorted((r.part, r.q, r.s, round(r.sim, 5)) for r in d.collect())
    new, old = (B.channel_topk(left, twice, "nosp", k=3, max_df=0.5, strategy=s) for s in ("auto", "relational"))
    assert key(new) == key(old)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan  # no block is sent to all the others, no pairs are shuffled


def test_inverted_hits_are_not_joined(tables, monkeypatch):
    from samewise.operators import retrieve

    monkeypatch.setattr(retrieve, "BLOCK", 9)
    left, right = tables
    key = lambda d: sorted((r.s1, r.cand, r.block_hits) for r in d.collect())
    both = right.unionByName(right.where("entity_id = 'S2-005'").withColumn("country", F.lit("spain")))  # one id in two parts
    for pool in (right, both):
        assert key(I.block_inverted(left, pool, most=4)) == key(I.block_inverted(left, pool, most=4, hot=10**9))
    plan = I.block_inverted(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_fused_channels_are_shuffled_once(spark, tables, monkeypatch):
    found = spark.createDataFrame([("us", "q", "s2", 0.4), ("us", "q", "s1", 0.5)], "part string, q string, s string, sim double")
    monkeypatch.setattr(B, "channel_topk", lambda *a, **k: found)
    out = B.block(*tables)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["rank"], r.s1, r.best) for r in out.collect()) == [(0, "s1", 0.75), (1, "s2", 0.75)]


def test_fallback_searches_its_own_part_only(tables, monkeypatch):
    from samewise.plans import er_queries as E

    seen = []
    monkeypatch.setattr(E, "_index", lambda *a: tables[0])
    monkeypatch.setattr(E, "_pool", lambda *a: tables[1])
    monkeypatch.setattr(E.B, "channel_topk", lambda left, right, channel: seen.extend(d.select("part").distinct().collect() for d in (left, right)) or right)
    E.block_fallback(None, "")
    assert [[r.part for r in rows] for rows in seen] == [["*"], ["*"]]


def test_long_lists_are_looked_up_only(monkeypatch):
    import numpy as np

    from samewise.operators import retrieve as R

    rng = np.random.default_rng(11)
    post = lambda x: (*np.nonzero(x), x[np.nonzero(x)])
    share = np.concatenate([np.full(200, 0.006), np.full(6, 0.25)])
    vectors = lambda n: np.where(rng.random((n, 206)) < share, np.where(np.arange(206) < 200, 3.0, 0.6), 0)
    a, b = vectors(3000), vectors(300)
    a[5:40, :200], b[7:20, :200] = 0, 0  # of common terms only
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (a, b))
    sims = np.round(b @ a.T, R.DIGITS)
    want = sorted((i, j) for i in range(300) for j in sorted(np.flatnonzero(sims[i] > 0.1), key=lambda j: (-sims[i, j], j))[:5])
    items, add = [], R.Sums.add
    monkeypatch.setattr(R.Sums, "add", lambda self, code, w: items.append(int((self.block.lists[code + 1] - self.block.lists[code]).sum())) or add(self, code, w))
    whole = (np.count_nonzero(a, axis=0) * np.count_nonzero(b, axis=0)).sum()
    for few in (16, 10**9, 1):  # as it is; with a place for each record; sorted by record
        monkeypatch.setattr(R, "FEW", few)
        items.clear()
        found = R.search_graded(R.Graded(*post(a), 3000, 206), *post(b), 5, 0.1, np.full(300, 0.1))
        assert sorted(zip(*(x.tolist() for x in found[:2]))) == want
        assert sum(items) < 0.7 * whole


def test_tokens_of_a_row_are_made_once(spark):
    from samewise.functions.normalize import base
    from samewise.functions.tokens import char_ngrams, word_ngrams

    df = spark.createDataFrame([("ab cd ef",)], "x string")
    calls = lambda c, name: df.select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString().count(name)
    assert calls(word_ngrams(F.col("x")), "regexp_extract_all") == 1 and calls(char_ngrams(F.col("x")), "regexp_replace") == 1
    assert calls(base(F.col("x")), "translate") == 1


def test_equal_queries_are_searched_once(spark, monkeypatch):
    import numpy as np

    from samewise.operators import retrieve as R

    one = R.Equals(np.array([0, 0, 2, 3, 3, 4]), np.array([1, 5, 5, 1, 5, 5]), np.array([1, 1, 1, 1, 1, 2]), 6)
    assert one.count == 4 and (one.owner.tolist(), one.code.tolist(), one.tf.tolist()) == ([0, 0, 2, 3], [1, 5, 5, 5], [1, 1, 1, 2])
    at, same = one.members(np.array([3, 0]))
    assert (at.tolist(), same.tolist()) == ([0, 1, 1], [4, 0, 3])
    assert one.members(np.array([0, 1]), 1)[1].tolist() == [0, 1]

    # equal records, also across blocks, of which the smallest ids are kept; unknown words make no difference
    monkeypatch.setattr(R, "BLOCK", 7)
    index = spark.createDataFrame([(f"S1-{i:02}", f"word{i % 3} tools", "us") for i in range(30)], "entity_id string, core string, part string")
    pool = spark.createDataFrame([(f"S2-{i:02}", f"word{i % 3} tools other{i}", "us") for i in range(60)], "entity_id string, core string, part string")
    found, want = (B.channel_topk(index, pool, "name_word", k=4, max_df=0.5, strategy=s) for s in ("auto", "relational"))
    rows = found.select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.q, r.s, round(r.sim, 5)) for r in rows) == sorted((r.q, r.s, round(r.sim, 5)) for r in want.collect()) and len(rows) == 240
    tasks = {}
    for r in rows:
        tasks.setdefault(int(r.q[3:]) % 3, set()).add(r.task)
    assert all(len(t) == 1 for t in tasks.values())
