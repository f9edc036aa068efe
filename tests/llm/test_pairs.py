"""Addresses, names, matching, leakage, top-n, components and splits."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.functions.ids import standard_s1
from samewise.llm import leakage as L
from samewise.llm.addresses import alignment_cost, read_address, same_place
from samewise.llm.components import hash_to_min
from samewise.llm import matching as K
from samewise.llm.matching import match
from samewise.llm.names import edits, read_name, same_name
from samewise.llm.places import same_places
from samewise.llm.splits import assign_splits, entity_components, rendezvous
from samewise.llm.topn import top_n
from samewise.llm import variants as V
from samewise.llm.variants import average_linkage, same_organisations

some = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize(
    ("text", "country", "number", "street", "town", "postcode"),
    [
        ("132 Mebomidal Highway, Apt 14, Kibener Springs, Maine, 11610", "US", "132", "mebomidal", "kibenersprings", "11610"),
        ("Mebomidal Hwy No. 132 / Kibener Springs / ME / 11610-1032", "", "132", "mebomidal", "kibenersprings", "11610"),
        ("H.No. 559, Rasi Vaben Main Rd, Opp. Post Office, Flat 3, Mipisinkot, PIN 414 416", "India", "559", "rasivaben", "mipisinkot", "414416"),
        ("216, avenue Titititis, 45154 Fanaboville", "France", "216", "titititis", "fanabovile", "45154"),
        ("Behind Clock Tower 185 Doverimo Ln Mamalfield 23321", "US", "185", "doverimo", "mamalfield", "23321"),
        ("1107 KISEFOMI STREET\n10568", "US", "1107", "kisefomi", "", "10568"),
        ("n/a", "US", "", "", "", ""), (None, None, "", "", "", ""), ("  ", "", "", "", "", ""),
    ],
)
def test_reading_addresses(text, country, number, street, town, postcode):
    a = read_address(text, country)
    assert (a.number, a.street, a.town, a.postcode) == (number, street, town, postcode)


def test_alignment_costs():
    a, b = "n1 smain kroad ttown rny p10001", "n1 smain kroad p10001"
    assert alignment_cost(a, a) == 0 < alignment_cost(a, b) < 0.5  # a run of missing parts is one gap
    assert alignment_cost(a, a.replace("kroad", "krd")) == 0  # by the dictionary
    assert alignment_cost(a, a, 0.0) == 0 and alignment_cost(a, "n2 smain", 1.0) > 1


@pytest.mark.parametrize(
    ("other", "want"),
    [
        ("12 Main Stret, Springfield 62701", True), ("12 Main Streeet, Springfield 62701", True), ("12 Mian Str, Springfield", True), ("12 Main Street, Sprngfield 62701", True),
        ("12 Main Street, Springfield 62710", True), ("12 Ma in Street, Springfield 62701", True), ("Springfield 62701, Main St 12, Apt 4", True), ("12 Main", True),
        ("13 Main Street, Springfield 62701", False), ("12 Oak Street, Springfield 62701", False), ("12 Main Street, Shelbyville 90210", False), ("Main Street, Springfield", False),
        ("12 Main Street, Other Town, CA", False), ("", None),
    ],
)
def test_same_place(other, want):
    a, b = read_address("12 Main Street, Springfield, IL, 62701", "US"), read_address(other, "US")
    assert same_place(a, b) is want and same_place(b, a) is want


WORDS = ["Kofovapas", "Mebomidal", "Tisosare", "Felesefan", "Jilonerud", "Ribosolen"]


def address_rows():
    rows = []
    for i, w in enumerate(WORDS):
        town, code = f"{w[::-1].title()} Falls", 10000 + i * 111
        for k, text in enumerate([f"{i + 7} {w} Street, {town}, NY, {code}", f"{w} St., No. {i + 7}\n{code}", f"{i + 7} {w[:3]}{w[4]}{w[3]}{w[5:]} Str / Suite 4 / {town}", f"{i + 70} {w} Street, {town}, NY, {code}"]):
            rows.append((f"S1-{i}{k}", text, "US", i, k))
    return rows


def test_same_places(spark):
    rows = address_rows()
    data = [(a, b, c, "clash") for a, b, c, _, _ in rows] + [("S1-00", rows[0][1], "US", None), ("S1-99", None, None, None), (None, rows[0][1], "US", None), ("S1-98", "", "", None)]
    df = spark.createDataFrame(data, "entity_id string, business_address string, country string, form string")
    found = {tuple(r) for r in same_places(df, "entity_id", "business_address", "country").collect()}
    want = {(f"S1-{i}{a}", f"S1-{i}{b}") for i in range(len(WORDS)) for a in range(3) for b in range(a + 1, 3)}
    assert found == want
    assert same_places(df.limit(0), "entity_id", "business_address", "country").count() == 0


def test_hot_place_is_one_representative(spark):
    df = spark.createDataFrame([(f"S1-{i:03}", "7 Kofovapas Street, Town, 10000", "US") for i in range(40)], "entity_id string, business_address string, country string")
    assert same_places(df, "entity_id", "business_address", "country").count() == 40 * 39 // 2


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Vilito Vejetis Textiles LLC", "VILITO VEJETIS TEXT. L.L.C.", True), ("Lakshmi Penire Rejehe & Daughters", "Luxmi Penirerejhe n Daughters Company", True),
        ("Agencies and Hardware, Zuseba Pevasor Private Limited", "Zuseba Pevasor Agencies", True), ("Palava Lalolir Logistics", "Lalolir Palava Logistics Inc", True),
        ("Palava Lalolir Logistics", "https://palavalalolir.example", True), ("K. Pegeka Manufacturing", "Kevani Pegeka Mfg Co", True), ("Mekita Lodehar Distributors, Tefolirpur LLP", "Mekita Lodehar (Taripas)", True),
        ("Palava Kijofi International", "Palava Lalolir Logistics", False), ("Mohammed Kimohil Mokare & Sons", "Mohammed Kimilir Defonol & Sons", False), ("Jameja Foods", "Jameja Holoton Foods", False), ("", "Jameja Foods", None), (None, None, None),
        ("The Lijabir Mesapon Publishing d/b/a Japaros Works", "Lijabir Mesapon", True), ("N. Fihofrol Distributors LLP", "Nihahil Fihofol Distributors L.L.P.", True),
    ],
)
def test_same_name(a, b, want):
    assert same_name(read_name(a), read_name(b)) is want
    assert same_name(read_name(b), read_name(a)) is want


def test_edits():
    assert edits("abcd", "abdc", 2) == 1 and edits("", "abc", 3) == 3 and edits("abc", "xyz", 1) == 2


def test_same_organisations(spark):
    orgs = ["Kofovapas Mebomir Foods", "Tisosare Jelaben Dental", "Felesefan Nogavir Motors"]
    rows = []
    for i, o in enumerate(orgs):
        w = o.split()
        for k, n in enumerate([o + " LLC", f"{w[0].upper()} {w[1]} {w[2]} - Town Branch", f"{w[0]}{w[1]} Inc", f"{w[1]} {w[0]} {w[2]}", f"{w[0][:4]}{w[0][5:]} {w[1]}"]):
            rows.append((f"S1-{i}{k}", n, 1))
    rows += [("S1-90", "Kofovapas Hidonel Bakery", 1), ("S1-91", None, 1), ("S1-92", "", 1), (None, orgs[0], 1), ("S1-00", rows[0][1], 1)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, words int")
    found = {tuple(r) for r in same_organisations(df, "entity_id", "business_name").collect()}
    assert found == {(f"S1-{i}{a}", f"S1-{i}{b}") for i in range(3) for a in range(5) for b in range(a + 1, 5)}
    assert same_organisations(df.limit(0), "entity_id", "business_name").count() == 0


def test_slips_in_the_first_letters_are_found(spark):
    names = ["Richard Gafohil Nadova", "R. Gafohilnadova", "Patel", "Padel", "Mebomidal Tisosare", "embomidaltisosare.example"]
    df = spark.createDataFrame([(f"S1-{i}", n) for i, n in enumerate(names)], "entity_id string, business_name string")
    found = {tuple(r) for r in same_organisations(df, "entity_id", "business_name").collect()}
    assert found == {("S1-0", "S1-1"), ("S1-2", "S1-3"), ("S1-4", "S1-5")}


def test_all_forms_of_a_name_are_compared(spark):
    # the same words with and without a given name, which explains the initial, and with other trades
    names = [*[f"{g}Gafohil Nadova{t}" for g in ("", "Richard ", "Mary ", "Peter ") for t in ("", " Foods", " Dental", " Motors")], "R. Gafohilnadova"]
    df = spark.createDataFrame([(f"S1-{i:02}", n) for i, n in enumerate(names)], "entity_id string, business_name string")
    found = {tuple(r) for r in same_organisations(df, "entity_id", "business_name").collect()}
    assert {("S1-00", "S1-16"), ("S1-04", "S1-16")} <= found and len(found) == 17 * 16 // 2


def test_cosines_against_brute_force(spark):
    import math

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bdklmn") + rng.choice("aeo") for _ in range(rng.randint(1, 4))) if rng.random() < 0.9 else rng.choice("bdk")
    docs = sorted({tuple(word() for _ in range(rng.randint(1, 3))) for _ in range(150)})
    n, terms = len(docs), [V.views(list(w), [], [])[0] for w in docs]
    df = defaultdict(int)
    for t in terms:
        for x in t:
            df[x] += 1

    def vector(terms):
        w = {x: math.log((1 + n) / (1 + df[x])) + 1 for x in terms}
        length = math.sqrt(sum(y * y for y in w.values()))
        return {x: y / length for x, y in w.items()}

    dot = lambda x, y: sum(v * y.get(t, 0) for t, v in x.items())
    vec = [vector(t) for t in terms]
    cos = {(a, b): dot(vec[a], vec[b]) for a in range(n) for b in range(a + 1, n)}
    for a, w in enumerate(docs):
        for b, v in enumerate(docs):
            if any(len(x) == 1 for x in w) and a != b:
                k = (min(a, b), max(a, b))
                cos[k] = max([cos[k], *(dot(vec[a], vector(t)) for t in V.views(list(v), [], [])[1])])
    made = V.vectors(spark.createDataFrame([(k, list(w), [], [], [], False) for k, w in enumerate(docs)], f"doc long, {V.NAME}"))
    weighted = V.cut(V.weigh(made, n))
    found = {(r.a, r.b): r.cosine for r in V.cosine_join(weighted).collect()}
    want = {k for k, c in cos.items() if c >= V.COSINE + 1e-6}
    assert want <= set(found) and all(cos[k] == pytest.approx(c, abs=1e-5) for k, c in found.items()) and len(want) > 100
    top = {(r.a, r.b) for r in V.cosine_join(weighted, top=1).collect()}
    assert top <= set(found) and {x for p in found for x in p} == {x for p in top for x in p}


def brute_linkage(edges, least):
    clusters = [frozenset([n]) for n in sorted({x for e in edges for x in e[:2]})]
    s = {frozenset(e[:2]): e[2] for e in edges}
    while True:
        mean = lambda x, y: sum(s.get(frozenset((a, b)), 0) for a in x for b in y) / (len(x) * len(y))
        best = max(((mean(x, y), -min(min(x), min(y)), -max(min(x), min(y)), x, y) for i, x in enumerate(clusters) for y in clusters[i + 1 :]), key=lambda z: z[:3], default=None)
        if best is None or best[0] < least:
            return {frozenset(c) for c in clusters}
        clusters = [c for c in clusters if c not in best[3:]] + [best[3] | best[4]]


@some
@given(st.integers(0, 10**6))
def test_average_linkage_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, round(rng.uniform(0.3, 1), 4)) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.45] or [(1, 2, 0.5)]
    found = defaultdict(set)
    for r in average_linkage(spark.createDataFrame(edges, "a long, b long, s double"), 0.35).collect():
        found[r.cluster].add(r.node)
    assert {frozenset(v) for v in found.values()} == brute_linkage(edges, 0.35)


def test_equal_similarities_merge_to_the_end(spark):
    clique = [(a, b, 0.8) for a in range(120) for b in range(a + 1, 120)]
    star = [(1000, 1000 + i, 0.8) for i in range(1, 301)]
    found = defaultdict(set)
    for r in average_linkage(spark.createDataFrame(clique + star, "a long, b long, s double"), 0.3).collect():
        found[r.cluster].add(r.node)
    assert found[0] == set(range(120))
    assert sorted(len(v) for v in found.values()) == [1] * 298 + [3, 120]  # a third leaf would have a mean of 0.8 / 3


@some
@given(st.integers(0, 10**6))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(20)] + [(None, "n1"), ("n5", "n5")] + [(f"p{i}", f"p{i + 1}") for i in range(12)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("text", ["S1-00000165", "s1_165", "S1-165", '"S1-00000165"', "S1:00000165", "S1–00000165", "S100000165", "#S1-00000165", "S1-​00000165", "Ｓ1-00000165", "S1 - 00000165", " S1-00000165\t", "s1 0000000165"])
def test_standard_ids(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(standard_s1("x")).first()[0] == "S1-00000165"


def test_entities_and_splits(spark):
    ids = spark.createDataFrame([("S1-1",), ("s1_1",), ("S1-00000002",), ("S1-3",), (None,), ("odd",)], "s1 string")
    labels = spark.createDataFrame([("S1-00000001", "S2-1,S2-2"), ("S1-00000002", '["S2-2", "S3-1"]'), ("S1-00000004", "none"), (None, "S2-1")], "source1_entity_id string, matched_entity_ids string")
    found = {r.s1: r.component for r in entity_components(ids, labels).collect()}
    assert found["S1-1"] == found["s1_1"] == found["S1-00000002"] == "S1-00000001" and found["S1-3"] == "S1-00000003" and found["odd"] == "odd" and len(found) == 5
    rows = spark.createDataFrame([(f"c{i % 300}",) for i in range(3000)] + [("hot",)] * 1500 + [(None,)], "component string")
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    split = {r.component: r.split for r in assign_splits(rows, "component", plan).collect()}
    assert len(split) == 301
    share = defaultdict(int)
    for r in rows.where("component is not null").collect():
        share[split[r.component]] += 1 / 4500
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.05
    assert assign_splits(rows.limit(0), "component", plan).count() == 0


def test_rendezvous_moves_little():
    before = {f"k{i}": rendezvous(f"k{i}", {"a": 0.5, "b": 0.5}) for i in range(500)}
    after = {k: rendezvous(k, {"a": 0.5, "b": 0.5, "c": 0.1}) for k in before}
    assert all(after[k] in (before[k], "c") for k in before)


@some
@given(st.integers(0, 10**6))
def test_top_n_against_brute_force(spark, seed):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -1.5, 1e-300, round(rng.random(), 2), round(rng.random(), 2)])
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), f"c{rng.randint(0, 60)}", score(), "x") for _ in range(400)]
    best = defaultdict(dict)
    for g, i, s, _ in rows:
        if g is not None and s is not None and s == s:
            best[g][i] = max(s, best[g].get(i, -float("inf")))
    want = {(g, i) for g, v in best.items() for i, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:5]}
    df = spark.createDataFrame(rows, "s1 string, cand string, score double, __s string")
    for parts in (2, 20_000):  # groups above and below the bound on hot ones
        assert {(r.s1, r.cand) for r in top_n(df, "s1", "cand", "score", 5, hot_parts=parts).collect()} == want
    assert top_n(df.limit(0), "s1", "cand", "score", 5).count() == 0


ITEM = "Keep the lantern away from the quarry! Gefafi told me about the foggy parcel under the stairs. Where is my pocket, Beril? My father used to guard one telescope a day."


def test_leaks(spark):
    words = ITEM.split()
    cue = lambda i, t: f"{i}\n00:00:{i:02},100 --> 00:00:{i:02},900\n{t}\n\n"
    split = lambda w: "".join(cue(i, " ".join(w[k : k + 5])) for i, k in enumerate(range(0, len(w), 5)))
    half = words[: len(words) // 2 + 1]
    noisy = "".join(cue(i, t) for i, t in enumerate(["<i>Keep the lantern away</i>", "[door creaks]", "from thc quarry! Gefafi", "TOLD ME ABOUT thefoggy", "parcel under the sta1rs. Where is", "my pocket, Beril?"]))
    docs = [(1, "Before. " + split(words)), (2, split(half)), (3, noisy), (4, split(words[:9])), (5, " ".join(sorted(words))), (6, None), (7, ""), (8, "   "), (9, split(words).replace("\n", "\r\n")), (1, "again " + ITEM)]
    items = [(10, ITEM), (11, "Another passage about nothing at all that nobody would ever say in any of these texts, not even once or twice."), (12, None), (13, ""), (14, "♪")]
    found = L.find_leaks(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert {tuple(r) for r in found.collect()} == {(1, 10), (2, 10), (3, 10), (9, 10)}
    none = spark.createDataFrame([], "item_id long, passage string")
    assert L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_block_max_search_against_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("red blue green sand tree wind".split()) for _ in range(n))
    index = L.ItemIndex([(i, say(rng.randint(4, 12))) for i in range(40)])
    terms = rng.sample(range(len(index.codes)), min(len(index.codes), 12))
    want = set()
    for k in range(40):
        score = sum(index.impacts[r] for t in terms for r in range(index.first[t], index.first[t + 1]) if index.docs[r] == k)
        if score >= 0.2 - 1e-9:
            want.add(k)
    p, k = index.search(np.zeros(len(terms), np.int64), np.array(sorted(terms), np.int64), 0.2)
    assert set(k.tolist()) == want


SOURCE = "entity_id string, business_name string, business_address string, country string"


def test_matching(spark):
    left = [("S1-1", "Kofovapas Mebomir Foods LLC", "7 Tisosare Street, Riban Falls, NY, 10001", "US"), ("S1-2", "Kofovapas Mebomir Foods LLC", "99 Other Road, Elsewhere, CA, 90001", "US"), ("S1-3", "Jelaben Nogavir Dental", "", None), (None, "x", "y", "z"), ("S1-4", None, None, None)]
    right = [("S2-1", "KOFOVAPAS MEBOMIR FDS", "Tisosare St. No. 7, 10001", ""), ("S2-2", "Kofovapas Mebomri Foods", "Riban Falls, NY", "US"), ("S3-3", "jelabennogavir.example", "12 Nowhere Lane, Town, 20002", "US"), ("S3-4", "", "99 Other Rd, Elsewhere 90001", "US"), ("S3-5", "Unrelated Something Motors", "7 Tisosare Street, 10001", "US"), ("S3-6", "", "", ""), ("S2-1", "KOFOVAPAS MEBOMIR FDS", "Tisosare St. No. 7, 10001", "")]
    labels = spark.createDataFrame([("S1-9", None)], "s1 string, cand string")
    pairs = match(spark.createDataFrame([(*r, "clash") for r in left], f"{SOURCE}, form string"), spark.createDataFrame(right, SOURCE), labels)
    found = {(r.s1, r.cand) for r in pairs.where("confidence >= 0.5").collect()}
    assert found == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-3", "S3-3"), ("S1-2", "S3-4")}
    empty = spark.createDataFrame([], SOURCE)
    assert match(empty, spark.createDataFrame(right, SOURCE), labels).count() == 0


def test_names_that_share_no_trigram_are_found(spark):
    left = [("S1-1", "Patel", "7 Tisosare Street, Riban Falls, NY, 10001", "US"), ("S1-2", "Other Name", "7 Tisosare Street, Riban Falls, NY, 10001", "US")]
    right = [("S2-1", "Padel", "7 Tisosare Street, Riban Falls, NY, 10001", "US")]
    pairs = match(spark.createDataFrame(left, SOURCE), spark.createDataFrame(right, SOURCE), spark.createDataFrame([("S1-9", None)], "s1 string, cand string"))
    assert {(r.s1, r.cand) for r in pairs.where("confidence >= 0.5").collect()} == {("S1-1", "S2-1")}


def test_all_pairs_within_the_radius_are_found(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeio") for _ in range(8)) for _ in range(12)]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + rng.choice("xyz") + w[i + 1 :], w[:i] + w[i + 1 :], w])

    rows = [(f"{side}-{k:03}", f"{w[:8].title()} {w[8:].title()}", place, "US") for side in ("S1", "S2") for k in range(60) for w in [slip(slip(rng.choice(base)))] for place in [rng.choice(["7 Tisosare Street, Riban Falls, 10001", "Riban Falls", "10001", ""])]]
    forms = [K.read_records(spark.createDataFrame([r for r in rows if r[0].startswith(s)], SOURCE), *SOURCE.replace(" string", "").split(", ")).withColumnRenamed("id", "form") for s in ("S1", "S2")]
    found = {(r.a, r.b) for r in K.candidates(*forms).collect()}

    def wide(name):
        tri, out = K.grams(K.read_name(name).words, 3), {}
        for x in tri:
            h = K._hash(x)
            k = (h & 0xFFFFFF) % K.CHUNKS
            out[k] = out.get(k, 0) | 1 << ((h >> 24) & 63)
        return out, tri

    seen = 0
    for i, n, p, _ in rows[:60]:
        for j, m, q, _ in rows[60:]:
            (x, tx), (y, ty) = wide(n), wide(m)
            apart = sum((x.get(k, 0) ^ y.get(k, 0)).bit_count() for k in {*x, *y})
            size = 2 if not p or not q or {p, q} & {"10001", ""} and p != q and "10001" not in (p[-5:], q[-5:]) else 1
            shared = p and q and (p == q or {p, q} == {"Riban Falls", rows[0][2]}) or "" in (p, q)
            if shared and apart <= max(len(x), len(y)) - (2 if "" in (p, q) else size) and 2 * len(tx & ty) >= (K.LEAST + 0.05) * (len(tx) + len(ty)):
                seen += 1
                assert (i, j) in found, (n, p, m, q)
    assert seen > 50


def test_calibration():
    import numpy as np

    start = K.prior("full")
    none = np.zeros((0, len(K.FIELDS)))
    assert np.allclose(K.calibrate(none, np.array([]), np.array([]), start), start)
    rng = np.random.default_rng(0)
    x = np.full((5000, len(K.FIELDS)), np.nan)
    x[:, 0] = rng.random(5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(6 * x[:, 0] - 3)))).astype(float)
    p = 1 / (1 + np.exp(-(K.design(x) @ K.calibrate(x, y, np.ones(5000), np.zeros(len(start))))))
    for lo in (0.1, 0.4, 0.7):
        some = (p >= lo) & (p < lo + 0.2)
        assert abs(p[some].mean() - y[some].mean()) < 0.05


def test_linked_names_are_those_of_the_cosine_join(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)
    texts = ["Richard Gafohil Nadova", "R. Gafohil Nadova", "Gafohil Nadova Ltd", "Gafohl Nadova", "Nadova Gafohil Textiles", "Gafohil Nadova Foods", "Gafohilnadova", "Kumar Bisoneta", "Kumar Bisonata Inc", "K. Bisoneta", "Tolaver"]
    docs = V.cut(V.read_names(spark.createDataFrame(list(enumerate(texts)), "k long, n string"), "k", "n").withColumnRenamed("id", "doc"))
    made, n = V.cut(V.vectors(docs)), docs.count()
    names = {r.doc: V._name(r.asDict()) for r in docs.collect()}
    pairs = V.cosine_join(V.cut(V.weigh(made, n))).collect()
    want = {(r.a, r.b): r.cosine**0.5 for r in pairs if same_name(names[r.a], names[r.b])}
    stored = V.store_vectors(made, docs, n)
    linked = V.linked(stored)
    found = {}
    for r in linked.collect():
        found[r.a, r.b] = max(r.s, found.get((r.a, r.b), 0))
    assert len(want) > 5 and len(pairs) > len(want)
    assert found.keys() == want.keys() and all(found[p] == pytest.approx(want[p], abs=1e-6) for p in want)
    assert stored.select("block").distinct().count() > 1
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan  # no pair is shuffled
    side = V._Side(stored.toArrow())
    whole = V.near(side, side, V.COSINE)
    monkeypatch.setattr(V, "ITEMS", 1)  # a vector at a time
    assert all((x == y).all() for x, y in zip(whole, V.near(side, side, V.COSINE)))


def test_scores_of_pairs_are_compiled(spark):
    """The JVM leaves methods of more than 8 000 bytes to its interpreter."""
    from samewise.llm import matching as M

    rows = [("a", "Bihova Nefagon Foundry", "12 High Street, Leeds", "us"), ("b", "Bihova Nefagoon Foundri", "12 High St", "us"), ("c", None, "7 Mill Road", "us")]
    df = spark.createDataFrame(rows, "id string, n string, a string, c string")
    forms = M.read_records(df, "id", "n", "a", "c").withColumn("form", F.xxhash64("id")).cache()
    pairs = forms.select(F.col("form").alias("a")).crossJoin(forms.select(F.col("form").alias("b")))
    scored = M.score_pairs(pairs, forms, forms)
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = debug.codegenStringSeq(M.score_pairs(pairs, forms, forms)._jdf.queryExecution().executedPlan())
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000
    at = {r.id: r.form for r in forms.select("id", "form").collect()}
    by = {(r.a, r.b): r for r in scored.collect()}
    same, near, bare = (by[at["a"], at[x]] for x in "abc")
    assert same.name2 == same.name3 == same.within == same.street == 1.0 and same.pattern == 0
    assert 0 < near.name3 < near.name2 < 1 and near.number == 1.0 and near.town is None and near.score < same.score
    assert bare.name2 is None and bare.within is None and bare.number == 0.0
