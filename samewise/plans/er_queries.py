"""Queries of the resolution operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import normalize as N
from samewise.functions import similarity as S
from samewise.functions import tokens as T
from samewise.functions.ids import standard_s1
from samewise.operators import blocking as B
from samewise.operators import decide as D
from samewise.operators import evaluate as E
from samewise.operators import features as X
from samewise.operators import inverted as I
from samewise.operators import model as M
from samewise.operators import rerank as R
from samewise.operators import sampling as P
from samewise.operators import validate as V
from samewise.operators.packed import explode_packed
from samewise.operators.tfidf import CHANNELS, fit_transform
from samewise.plans import duck as Q
from samewise.plans.resolve import baseline_probability, resolve
from samewise.session import cut, table
from samewise.sources.sinks import list_lines
from samewise.sources.tables import pool as union_pool
from samewise.sources.tables import source_table

#: The texts of the four channels.
TEXTS = ("core", "nosp", "addr")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL twin."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _index(spark: SparkSession, d: str, *texts: str) -> DataFrame:
    """Source 1 prepared and stored, as every later stage reads it several times; with ``texts`` only these, the id and the country are made."""
    return cut(_only(N.prepare(source_table(spark, f"{d}/train_source1.parquet")), texts), "index")


def _pool(spark: SparkSession, d: str, *texts: str) -> DataFrame:
    return cut(_only(N.prepare(union_pool(*(source_table(spark, f"{d}/train_source{k}.parquet") for k in (2, 3)))), texts), "pool")


def _only(prepared: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    return prepared.select("entity_id", "country", *texts) if texts else prepared


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """The true pairs: every id of the packed lists, of records in standard form."""
    labels = table(spark, d, "train_labels").where("source1_entity_id is not null")
    return explode_packed(labels, "source1_entity_id", "matched_entity_ids", "cand").select(standard_s1("source1_entity_id").alias("s1"), "cand").distinct()


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_labels").where("source1_entity_id is not null").select(standard_s1("source1_entity_id").alias("s1")).distinct()


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored candidates, one row a pair of records in standard form: the first scoring, in the order of its time."""
    c = table(spark, d, "candidate_pairs").where("s1 is not null and cand is not null and score is not null and not isnan(score)").withColumn("s1", standard_s1("s1"))
    rest = ["score", "sim_name", "sim_addr", "sim_name_word", "sim_addr_word", "best", "gap", "rank"]
    first = c.groupBy("s1", "cand").agg(F.min(F.struct("scored_at", *rest)).alias("r"))
    return first.select("s1", "cand", *[f"r.{x}" for x in rest])


_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("scored_at", "score", "sim_name", "sim_addr", "sim_name_word", "sim_addr_word", "best", "gap", "rank"))
STORED = f"""stored AS (SELECT s1, cand, score, sim_name, sim_addr, sim_name_word, sim_addr_word, best, gap, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY s1, cand ORDER BY {_ORDER}) AS r
        FROM (SELECT * REPLACE ({Q.standard_s1('s1')} AS s1) FROM candidate_pairs
        WHERE s1 IS NOT NULL AND cand IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))) WHERE r = 1)"""
PROBABLE = f"{STORED}, probable AS (SELECT s1, cand, score, round(1.0 / (1.0 + exp(-(8.0 * score - 8.0))), 6) AS p FROM stored)"
SINGLE = "single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, score DESC, s1) AS r FROM probable) WHERE r = 1)"
THRESHOLD = "decided AS (SELECT s1, cand, p FROM single WHERE p >= 0.5)"
EXPECTED = """k1 AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS run, sum(p) OVER (PARTITION BY s1) AS whole, exp(sum(ln(1 - least(p, 1 - 1e-6))) OVER (PARTITION BY s1)) AS p0
        FROM single WHERE p >= 0.05 WINDOW o AS (PARTITION BY s1 ORDER BY p DESC, cand)),
    k2 AS (SELECT *, round(1.25 * run / (0.25 * whole / 0.99 + k), 12) AS ef FROM k1),
    k3 AS (SELECT *, first_value(k) OVER (PARTITION BY s1 ORDER BY ef DESC, k) AS bk, max(ef) OVER (PARTITION BY s1) AS be FROM k2),
    decided AS (SELECT s1, cand, p FROM k3 WHERE be > p0 AND k <= bk)"""


def _probable(spark: SparkSession, d: str) -> DataFrame:
    return baseline_probability(_stored(spark, d)).select("s1", "cand", "score", "p")


# Scans and projections

@query(f"WITH {Q.POOL} SELECT substr(entity_id, 1, 2) AS source, country, count(*) AS n, count(DISTINCT entity_id) AS ids FROM pl GROUP BY ALL")
def io_pool_union(spark, d):
    """Source 2 and 3 as one pool: records by source and country."""
    return _pool(spark, d).groupBy(F.substring("entity_id", 1, 2).alias("source"), "country").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("ids"))


@query(f"WITH {Q.INDEX} SELECT entity_id, nosp, addr FROM ix WHERE country = 'france'")
def io_country_scan(spark, d):
    """Three columns of one country's prepared records."""
    return _index(spark, d).where("country = 'france'").select("entity_id", "nosp", "addr")


@query(f"SELECT entity_id, {Q.base('business_name')} AS name_base, {Q.base('business_address')} AS address_base FROM train_source2")
def n_base(spark, d):
    return table(spark, d, "train_source2").select("entity_id", N.base(F.col("business_name")).alias("name_base"), N.base(F.col("business_address")).alias("address_base"))


@query(f"SELECT entity_id, {Q.phonetic('lower(coalesce(business_name, chr(32)))')} AS folded FROM train_source1")
def n_phonetic(spark, d):
    return table(spark, d, "train_source1").select("entity_id", N.phonetic(F.lower(F.coalesce("business_name", F.lit(" ")))).alias("folded"))


@query(f"SELECT entity_id, {Q.country('country')} AS country FROM train_source3")
def n_country(spark, d):
    return table(spark, d, "train_source3").select("entity_id", N.country(F.col("country")).alias("country"))


@query(f"WITH {Q.INDEX} SELECT entity_id, name_full, core, nosp FROM ix")
def n_name(spark, d):
    return _index(spark, d).select("entity_id", "name_full", "core", "nosp")


@query(f"WITH {Q.POOL} SELECT entity_id, country, addr, nums, zips FROM pl")
def n_addr(spark, d):
    return _pool(spark, d).select("entity_id", "country", "addr", "nums", "zips")


@query(f"WITH {Q.prepared('g1', ['train_source2'], 'g1')} SELECT entity_id, name_full, core, addr, nums FROM g1")
def n_variant_g1(spark, d):
    """The other normaliser: no folding, regions of two countries for all."""
    return N.prepare(source_table(spark, f"{d}/train_source2.parquet"), "g1").select("entity_id", "name_full", "core", "addr", "nums")


def _terms(df, tokens):
    return df.select("entity_id", F.explode(tokens).alias("term")).groupBy("entity_id", "term").agg(F.count("*").alias("tf"))


def _terms_sql(col, kind):
    return f"SELECT entity_id, term, count(*) AS tf FROM (SELECT entity_id, unnest({Q.TOKENS[kind](col)}) AS term FROM train_s1) GROUP BY ALL"


@query(_terms_sql("nosp", "char3"))
def t_char3(spark, d):
    return _terms(table(spark, d, "train_s1"), T.char_ngrams(F.col("nosp")))


@query(_terms_sql("addr", "char_wb3"))
def t_charwb3(spark, d):
    return _terms(table(spark, d, "train_s1"), T.char_wb_ngrams(F.col("addr")))


@query(_terms_sql("core", "word12"))
def t_word12(spark, d):
    return _terms(table(spark, d, "train_s1"), T.word_ngrams(F.col("core")))


@query("""SELECT entity_id, term, count(*) AS tf FROM (SELECT entity_id, unnest(CASE WHEN trim(nosp) = '' THEN [] WHEN length(trim(nosp)) < 4 THEN [trim(nosp)]
    ELSE list_transform(range(1, least(8, length(trim(nosp)) - 3) + 1), lambda i: substr(trim(nosp), i, 4)) END) AS term FROM train_s1) GROUP BY ALL""")
def t_char4_first8(spark, d):
    return _terms(table(spark, d, "train_s1"), T.first_ngrams(F.col("nosp")))


# Retrieval

@query(f"WITH {Q.INDEX},{Q.POOL},{Q.PARTS},{Q.weighted('nosp')} SELECT part, id, term, round(w, 6) AS w FROM wi_nosp")
def tfidf_weights(spark, d):
    """Weights of the index in the channel of names without spaces."""
    left, right = B.with_parts(_index(spark, d), _pool(spark, d))
    return fit_transform(left, right, "nosp")[0].select("part", "id", "term", F.round("w", 6).alias("w"))


def _channel(spark, d, channel):
    text = CHANNELS[channel][0]
    left, right = B.with_parts(_index(spark, d, text), _pool(spark, d, text))
    return B.channel_topk(left, right, channel)


for _c in Q.CHANNELS:
    QUERIES[f"block_topk_{_c}"] = lambda spark, d, c=_c: _channel(spark, d, c)
    ORACLE[f"block_topk_{_c}"] = f"WITH {Q.INDEX},{Q.POOL},{Q.PARTS},{Q.topk(_c)} SELECT * FROM k_{_c}"


@query(f"WITH {Q.BLOCK} SELECT * FROM raw")
def block_fused(spark, d):
    """All four channels, fused, scored and ranked."""
    return B.block(_index(spark, d), _pool(spark, d))


@query(f"WITH {Q.BLOCK} SELECT * FROM pruned")
def block_pruned(spark, d):
    return B.prune(B.block(_index(spark, d, *TEXTS), _pool(spark, d, *TEXTS)), 0.7, 0.0, 8)


_NO_FRANCE = Q.INDEX.replace("    ix AS (SELECT", "    ix AS (SELECT * FROM (SELECT").rstrip(")") + ") WHERE country <> 'france')"


@query(f"WITH {_NO_FRANCE},{Q.POOL},{Q.PARTS},{Q.topk('nosp')} SELECT * FROM k_nosp WHERE part = '*'")
def block_fallback(spark, d):
    """An index without France: its pool records are searched in the whole index."""
    left, right = (x.where("part = '*'") for x in B.with_parts(_index(spark, d).where("country <> 'france'"), _pool(spark, d)))
    return B.channel_topk(left, right, "nosp")


def _strategy(spark, d, name):
    left, right = B.with_parts(_index(spark, d), _pool(spark, d))
    return B.channel_topk(left, right, "name_word", strategy=name)


@query(f"WITH {Q.INDEX},{Q.POOL},{Q.PARTS},{Q.topk('name_word')} SELECT * FROM k_name_word")
def block_dense_kernel(spark, d):
    """The same retrieval by the strategy ``block``, which is now that of ``auto``."""
    return _strategy(spark, d, "block")


@query()
def block_lsh(spark, d):
    """The same retrieval approximately, by signs of random projections."""
    return _strategy(spark, d, "lsh")


_KEYS = """list_distinct(list_concat(
    CASE WHEN length(nosp) >= 4 THEN ['nosp:' || nosp] ELSE [] END,
    CASE WHEN len(w) >= 2 THEN list_transform(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: length(x) >= 5), lambda x: 'bg:' || x) WHEN len(w) = 1 AND length(w[1]) >= 4 THEN ['bg:' || w[1]] ELSE [] END,
    CASE WHEN len(w) >= 2 AND len(list_filter(w, lambda x: length(x) >= 3)) >= 2 THEN ['pfx:' || array_to_string(list_sort(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substr(x, 1, 3))), ' ')] ELSE [] END,
    CASE WHEN length(nosp) >= 6 THEN list_transform(range(1, least(8, length(nosp) - 3) + 1), lambda i: 'c4:' || substr(nosp, i, 4)) ELSE [] END,
    list_transform(list_filter(string_split(nums, ' '), lambda x: x <> '' AND length(x) <= 5)[1:3], lambda x: 'num:' || x)))"""
_KEYED = f"ik AS (SELECT part, entity_id AS s1, unnest(keys) AS key FROM (SELECT *, {_KEYS} AS keys FROM (SELECT *, {Q.words('core')} AS w FROM ixp))), qk AS (SELECT part, entity_id AS cand, unnest(keys) AS key FROM (SELECT *, {_KEYS} AS keys FROM (SELECT *, {Q.words('core')} AS w FROM plp)))"


@query(f"WITH {Q.INDEX} SELECT entity_id, unnest(keys) AS key FROM (SELECT *, {_KEYS} AS keys FROM (SELECT *, {Q.words('core')} AS w FROM ix))")
def block_keys(spark, d):
    """Blocking keys of the five families."""
    return _index(spark, d).select("entity_id", F.explode(I.block_keys(F.col("nosp"), F.col("core"), F.col("nums"))).alias("key"))


def _inverted_sql(most):
    return f"{_KEYED}, hits AS (SELECT s1, cand, CAST(count(*) AS INTEGER) AS block_hits FROM qk JOIN ik USING (part, key) GROUP BY ALL), inverted AS (SELECT s1, cand, block_hits FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY block_hits DESC, s1) AS r FROM hits) WHERE r <= {most})"


@query(f"WITH {Q.INDEX},{Q.POOL},{Q.PARTS},{_inverted_sql(30)} SELECT * FROM inverted")
def block_inverted(spark, d):
    return I.block_inverted(_index(spark, d), _pool(spark, d))


@query(f"""WITH {Q.INDEX},{Q.POOL},{Q.PARTS},{_inverted_sql(20)},{Q.topk('nosp', 5)},{Q.topk('addr', 5)},
    parts AS (SELECT s1, cand, block_hits, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM inverted UNION ALL SELECT s, q, 0, sim, 0.0 FROM k_nosp UNION ALL SELECT s, q, 0, 0.0, sim FROM k_addr)
    SELECT s1, cand, CAST(max(block_hits) AS INTEGER) AS block_hits, max(a) AS sim_name, max(b) AS sim_addr, max(a) + 0.5 * max(b) + CAST(0.1 AS DOUBLE) * max(block_hits) AS score FROM parts GROUP BY ALL""")
def block_combined(spark, d):
    """Inverted index and TF-IDF together."""
    return I.block_combined(_index(spark, d, "nosp", "core", "nums", "addr"), _pool(spark, d, "nosp", "core", "nums", "addr"))


# Features

_PAIRED = f"""{Q.INDEX},{Q.POOL},{STORED}, paired AS (SELECT s.*, i.core AS lc, p.core AS rc, i.name_full AS lf, p.name_full AS rf, i.nosp AS ln, p.nosp AS rn, i.addr AS la, p.addr AS ra, i.nums AS lu, p.nums AS ru, i.zips AS lz, p.zips AS rz, p.business_name AS rb
    FROM stored s JOIN ix i ON i.entity_id = s.s1 JOIN pl p ON p.entity_id = s.cand)"""


def _jac(a, b):
    x, y = f"list_distinct({Q.words(a)})", f"list_distinct({Q.words(b)})"
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN -1.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def _paired(spark, d):
    return X.with_texts(_stored(spark, d), _index(spark, d), _pool(spark, d))


@query(f"WITH {_PAIRED} SELECT s1, cand, round({_jac('lc', 'rc')}, 6) AS n_jac, round({_jac('la', 'ra')}, 6) AS a_jac, round({_jac('lu', 'ru')}, 6) AS num_jac, round({_jac('lz', 'rz')}, 6) AS zip_jac FROM paired")
def f_jaccard(spark, d):
    f = X.sql_features()
    return _paired(spark, d).select("s1", "cand", *[F.round(f[c], 6).alias(c) for c in ("n_jac", "a_jac", "num_jac", "zip_jac")])


@query(f"""WITH {_PAIRED} SELECT s1, cand, CASE WHEN len({Q.words('lc')}) > 0 AND len({Q.words('rc')}) > 0 AND ({Q.words('lc')})[1] = ({Q.words('rc')})[1] THEN 1.0 ELSE 0.0 END AS n_first,
    CASE WHEN ln = '' OR rn = '' THEN 0.0 ELSE round(least(length(ln), length(rn)) / greatest(length(ln), length(rn)), 6) END AS n_lenr,
    CAST(lu <> '' AND ru <> '' AND {_jac('lu', 'ru')} = 0 AS INTEGER) AS num_conflict, CAST(lz <> '' AND rz <> '' AND {_jac('lz', 'rz')} = 0 AS INTEGER) AS zip_conflict,
    CAST(la = '' AS INTEGER) AS l_addr_missing, CAST(ra = '' AS INTEGER) AS r_addr_missing, CAST(ru = '' AS INTEGER) AS r_nums_missing, CAST(regexp_matches(rb, '[^\\x00-\\x7F]') AS INTEGER) AS r_nonascii FROM paired""")
def f_flags(spark, d):
    f = X.sql_features()
    names = ("num_conflict", "zip_conflict", "l_addr_missing", "r_addr_missing", "r_nums_missing", "r_nonascii")
    return _paired(spark, d).select("s1", "cand", f["n_first"].alias("n_first"), F.round(f["n_lenr"], 6).alias("n_lenr"), *[f[c].alias(c) for c in names])


@query(f"WITH {_PAIRED} SELECT s1, cand, round(CASE WHEN ln = rn THEN 1.0 WHEN ln = '' OR rn = '' THEN 0.0 ELSE jaro_winkler_similarity(ln, rn) END, 4) AS n_jw FROM paired")
def f_jaro_winkler(spark, d):
    return _paired(spark, d).select("s1", "cand", F.round(S.jaro_winkler_udf("l_nosp", "r_nosp"), 4).alias("n_jw"))


def _ratio_sql(a, b):
    # the row of the LCS table for each character of a, as a fold; the last entry of the last row is the length
    row = f"list_transform(range(0, length({b}) + 1), lambda z: 0)"
    fold = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda r, i: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CASE WHEN substr({a}, i[1], 1) = substr({b}, j, 1) THEN r[j] + 1 ELSE r[j + 1] END]), lambda n, v: list_append(n, greatest(n[-1], v[1])), [0]), {row})"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * ({fold})[-1] / (length({a}) + length({b})) END"


@query(f"WITH {_PAIRED} SELECT s1, cand, round({_ratio_sql('lf', 'rf')}, 4) AS n_ratio FROM paired")
def f_ratio(spark, d):
    """Indel similarity of the full names, by the longest common subsequence."""
    return _paired(spark, d).select("s1", "cand", F.round(S.ratio_udf("l_name_full", "r_name_full"), 4).alias("n_ratio"))


@query(f"WITH {_PAIRED}, turned AS (SELECT s1, cand, array_to_string(list_sort({Q.words('lc')}), ' ') AS x, array_to_string(list_sort({Q.words('rc')}), ' ') AS y FROM paired) SELECT s1, cand, round({_ratio_sql('x', 'y')}, 4) AS n_tsort FROM turned")
def f_token_sort(spark, d):
    return _paired(spark, d).select("s1", "cand", F.round(S.token_sort_udf("l_core", "r_core"), 4).alias("n_tsort"))


@query()
def f_token_set_partial(spark, d):
    """The similarities SQL has no words for."""
    pair = lambda fn, t: F.round(fn(F.col(f"l_{t}"), F.col(f"r_{t}")), 4)
    return _paired(spark, d).select("s1", "cand", pair(S.token_set_udf, "core").alias("n_tsr"), pair(S.partial_udf, "nosp").alias("n_part"), pair(S.token_set_udf, "addr").alias("a_tsr"), pair(S.partial_udf, "addr").alias("a_part"))


@query(f"WITH {STORED} SELECT s1, cand, CAST(count(*) OVER (PARTITION BY s1) AS INTEGER) AS n_cands, round(score - max(score) OVER (PARTITION BY s1), 6) AS score_vs_best_s1, CAST(starts_with(cand, 'S3-') AS INTEGER) AS is_s3 FROM stored")
def f_context(spark, d):
    return X.context(_stored(spark, d)).select("s1", "cand", "n_cands", "score_vs_best_s1", "is_s3")


@query()
def f_all(spark, d):
    """The 35 features of the stored candidates."""
    return X.features(_stored(spark, d), _index(spark, d), _pool(spark, d))


@query(f"WITH {Q.INDEX},{Q.POOL},{STORED} SELECT s1, cand FROM stored WHERE s1 NOT IN (SELECT entity_id FROM ix) UNION SELECT s1, cand FROM stored WHERE cand NOT IN (SELECT entity_id FROM pl)")
def f_missing_ids(spark, d):
    return X.missing_ids(_stored(spark, d), _index(spark, d), _pool(spark, d))


# Decisions and metrics

@query(f"WITH {PROBABLE}, {SINGLE} SELECT s1, cand, p FROM single")
def one_to_one(spark, d):
    return D.one_to_one(_probable(spark, d)).select("s1", "cand", "p")


@query(f"WITH {PROBABLE}, {SINGLE}, {THRESHOLD} SELECT * FROM decided")
def decide_thr(spark, d):
    return D.by_threshold(_probable(spark, d)).select("s1", "cand", "p")


@query(f"WITH {PROBABLE}, {SINGLE}, {EXPECTED} SELECT * FROM decided")
def decide_ef(spark, d):
    return D.expected_f05(_probable(spark, d)).select("s1", "cand", "p")


@query(f"""WITH {Q.INDEX}, {PROBABLE}, {SINGLE}, {EXPECTED}, lists AS (SELECT s1, string_agg(cand, ',' ORDER BY p DESC, cand) AS ids FROM decided GROUP BY s1)
    SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM ix LEFT JOIN lists ON s1 = entity_id""")
def id_list_sink(spark, d):
    """The lines of the result file: every Source 1 record and its matches."""
    return list_lines(D.id_lists(D.expected_f05(_probable(spark, d)), _index(spark, d).select("entity_id"), "entity_id"))


@query("SELECT source1_entity_id AS s1, cand FROM (SELECT source1_entity_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS cand FROM train_labels) WHERE cand <> ''")
def gt_explode_commas(spark, d):
    """The reference's reading of a truth file: split at commas alone."""
    return E.truth_pairs(table(spark, d, "train_labels"))


@query(f"WITH {Q.TRUTH} SELECT s1, cand FROM truth")
def gt_explode(spark, d):
    """The true pairs, whatever way their lists are packed."""
    return _truth(spark, d)


@query(f"WITH {Q.TRUTH}, {PROBABLE}, {SINGLE}, {THRESHOLD}, {Q.per_entity('decided')} SELECT round(avg({Q.F05}), 6) AS macro_f05, count(*) AS n FROM per")
def macro_f05(spark, d):
    return E.macro_f05(D.by_threshold(_probable(spark, d)), _truth(spark, d), _labelled(spark, d))


@query(f"""WITH {Q.TRUTH}, {PROBABLE}, {SINGLE}, {THRESHOLD}, {Q.per_entity('decided')},
    s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(nt - tp) AS BIGINT) AS fn, CAST(sum(CAST(nt = 0 AS INT)) AS BIGINT) AS singletons, CAST(sum(CAST(nt = 0 AND np = 0 AS INT)) AS BIGINT) AS singletons_right FROM per)
    SELECT *, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(singletons_right / (singletons + 1e-9), 6) AS singleton_accuracy FROM s""")
def micro_scores(spark, d):
    return E.micro(D.by_threshold(_probable(spark, d)), _truth(spark, d), _labelled(spark, d))


_REPORT = "round(sum(tp) / sum(nt), 6) AS recall, round(avg(np), 6) AS avg_cands, round(avg(CASE WHEN nt = 0 THEN 1.0 WHEN tp > 0 THEN 1.25 * (tp / nt) / (0.25 + tp / nt) ELSE 0.0 END), 6) AS oracle_f05"


@query(f"WITH {Q.BLOCK}, {Q.TRUTH}, {Q.per_entity('pruned')} SELECT {_REPORT} FROM per")
def block_recall(spark, d):
    return E.blocking_report(B.prune(B.block(_index(spark, d, *TEXTS), _pool(spark, d, *TEXTS)), 0.7, 0.0, 8), _truth(spark, d), _labelled(spark, d))


@query(f"""WITH {Q.TRUTH}, {STORED}, grid AS (SELECT margin, floor FROM (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS margin) m, (SELECT unnest([0.0, 0.15, 0.25]) AS floor) f),
    kept AS (SELECT margin, floor, s1, cand FROM stored, grid WHERE rank < 10 AND best >= floor AND score >= best - CAST(margin AS DOUBLE)),
    per AS (SELECT g.margin, g.floor, e.s1, count(k.cand) AS np, count(t.cand) AS tp, (SELECT count(*) FROM truth t0 WHERE t0.s1 = e.s1) AS nt
        FROM labelled e CROSS JOIN grid g LEFT JOIN kept k ON k.s1 = e.s1 AND k.margin = g.margin AND k.floor = g.floor LEFT JOIN truth t ON t.s1 = k.s1 AND t.cand = k.cand GROUP BY g.margin, g.floor, e.s1)
    SELECT CAST(margin AS DOUBLE) AS margin, CAST(floor AS DOUBLE) AS floor, {_REPORT} FROM per GROUP BY margin, floor""")
def prune_sweep(spark, d):
    return E.prune_sweep(_stored(spark, d), _truth(spark, d), _labelled(spark, d))


_MISSES = f"""{Q.POOL}, {Q.TRUTH}, {STORED}, kept AS (SELECT s1, cand FROM stored WHERE rank < 3),
    miss AS (SELECT t.s1, t.cand, CAST(EXISTS (SELECT 1 FROM stored r WHERE r.s1 = t.s1 AND r.cand = t.cand) AS INTEGER) AS pruned, p.country, CAST(p.addr = '' AS INTEGER) AS no_address, CAST(starts_with(t.cand, 'S3-') AS INTEGER) AS is_s3
        FROM truth t LEFT JOIN pl p ON p.entity_id = t.cand WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.s1 = t.s1 AND k.cand = t.cand))"""


def _misses(spark, d):
    stored = _stored(spark, d)
    return E.misses(stored.where("rank < 3"), stored, _truth(spark, d), _pool(spark, d))


@query(f"WITH {_MISSES} SELECT s1, cand, pruned, coalesce(country, '') AS country, coalesce(no_address, -1) AS no_address, is_s3 FROM miss")
def miss_anti_join(spark, d):
    return _misses(spark, d).fillna({"country": "", "no_address": -1})


@query(f"WITH {_MISSES} SELECT country, count(*) AS misses, CAST(sum(pruned) AS BIGINT) AS pruned, round(avg(no_address), 6) AS no_address_share, round(avg(is_s3), 6) AS s3_share FROM miss GROUP BY country")
def miss_report(spark, d):
    return E.miss_report(_misses(spark, d))


@query(f"""WITH {Q.INDEX}, {PROBABLE}, {SINGLE}, {THRESHOLD}, lists AS (SELECT entity_id AS s1, country, count(cand) AS n FROM ix LEFT JOIN decided ON s1 = entity_id GROUP BY ALL)
    SELECT country, count(*) AS n, round(avg(n), 6) AS avg_matches, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share FROM lists GROUP BY country""")
def prediction_stats(spark, d):
    ids = _index(spark, d).select(F.col("entity_id").alias("s1"), "country")
    return E.prediction_stats(D.id_lists(D.by_threshold(_probable(spark, d)), ids), ids)


# Sampling and training

_MD5 = "md5(concat(entity_id, '|0'))"


@query(f"SELECT entity_id FROM (SELECT DISTINCT entity_id FROM train_source1) ORDER BY {_MD5}, entity_id LIMIT 200")
def sample_hash(spark, d):
    return P.sample(table(spark, d, "train_source1").select("entity_id").distinct(), "entity_id", 200)


@query("SELECT entity_id, CAST(floor(CAST(('0x' || substr(md5(concat(entity_id, '|0')), 1, 7)) AS BIGINT) / 268435456.0 * 4) AS INTEGER) AS fold FROM (SELECT DISTINCT entity_id FROM train_source1)")
def group_fold(spark, d):
    return P.folds(table(spark, d, "train_source1").select("entity_id").distinct(), "entity_id")


@query("SELECT entity_id, CAST(CAST(('0x' || substr(md5(concat(entity_id, '|0')), 1, 7)) AS BIGINT) / 268435456.0 < 0.85 AS INTEGER) AS is_train FROM (SELECT DISTINCT entity_id FROM train_source1)")
def group_split(spark, d):
    return P.group_split(table(spark, d, "train_source1").select("entity_id").distinct(), "entity_id")


@query("SELECT s1 FROM (SELECT DISTINCT source1_entity_id AS s1 FROM train_labels) ORDER BY md5(concat(s1, '|0')), s1 LIMIT 100")
def holdout(spark, d):
    return M.holdout(table(spark, d, "train_labels"), 100)


@query(f"""WITH {Q.TRUTH}, ids AS (SELECT DISTINCT entity_id FROM (SELECT entity_id FROM train_source2 UNION ALL SELECT entity_id FROM train_source3)),
    chosen AS (SELECT s1 FROM labelled ORDER BY md5(concat(s1, '|0')), s1 LIMIT 100), mine AS (SELECT DISTINCT cand FROM truth WHERE s1 IN (SELECT s1 FROM chosen)),
    yes AS (SELECT entity_id FROM ids WHERE entity_id IN (SELECT cand FROM mine)), k AS (SELECT CAST(floor(1.5 * count(*)) AS BIGINT) AS n FROM yes),
    h AS (SELECT entity_id, row_number() OVER (ORDER BY {_MD5}, entity_id) AS r FROM ids WHERE entity_id IN (SELECT cand FROM truth) AND entity_id NOT IN (SELECT cand FROM mine)),
    e AS (SELECT entity_id, row_number() OVER (ORDER BY {_MD5}, entity_id) AS r FROM ids WHERE entity_id NOT IN (SELECT cand FROM truth))
    SELECT entity_id, 'true' AS kind FROM yes UNION ALL SELECT entity_id, 'hard' FROM h, k WHERE r <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) UNION ALL SELECT entity_id, 'easy' FROM e, k WHERE r <= n - CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)""")
def negative_plan(spark, d):
    pool_ids = table(spark, d, "train_source2").select("entity_id").unionByName(table(spark, d, "train_source3").select("entity_id"))
    return P.negative_plan(pool_ids, _truth(spark, d), P.sample(_labelled(spark, d), "s1", 100))


@query(f"""WITH {Q.TRUTH}, {STORED} SELECT s1, cand, 1 AS y FROM truth UNION ALL SELECT s1, cand, 0 FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS r FROM stored s
    WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = s.s1 AND t.cand = s.cand)) WHERE r <= 2""")
def hard_negatives(spark, d):
    return P.hard_negatives(_stored(spark, d), _truth(spark, d))


@query(f"WITH {Q.TRUTH}, {STORED} SELECT s.s1, s.cand, CAST(t.cand IS NOT NULL AS INTEGER) AS y FROM stored s LEFT JOIN truth t ON t.s1 = s.s1 AND t.cand = s.cand")
def label_join(spark, d):
    return P.labelled(_stored(spark, d), _truth(spark, d)).select("s1", "cand", "y")


def _training_rows(spark, d):
    known = _labelled(spark, d)
    return P.labelled(X.features(_stored(spark, d).join(known, "s1", "left_semi"), _index(spark, d), _pool(spark, d)), _truth(spark, d))


@query()
def gbt_out_of_fold(spark, d):
    """Probabilities of the labelled candidates by boosted trees that did not see their record."""
    return M.out_of_fold(cut(_training_rows(spark, d), "training")).select("s1", "cand", "y", F.round("p", 6).alias("p"))


@query(f"""WITH {Q.TRUTH}, {PROBABLE}, {SINGLE}, grid AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS thr),
    per AS (SELECT g.thr, e.s1, count(s.cand) AS np, count(t.cand) AS tp, (SELECT count(*) FROM truth t0 WHERE t0.s1 = e.s1) AS nt FROM labelled e CROSS JOIN grid g
        LEFT JOIN single s ON s.s1 = e.s1 AND s.p >= g.thr LEFT JOIN truth t ON t.s1 = s.s1 AND t.cand = s.cand GROUP BY g.thr, e.s1)
    SELECT CAST(rank() OVER (ORDER BY thr) - 1 AS INTEGER) AS rule, 'mode=thr thr=' || thr AS setting, round(avg({Q.F05}), 6) AS macro_f05 FROM per GROUP BY thr""")
def grid_search(spark, d):
    return M.grid_search(cut(_probable(spark, d), "probable"), _truth(spark, d), _labelled(spark, d), M.decision_grid((0.3, 0.4, 0.5, 0.6, 0.7), (), ()))


# Rescoring, validation, the whole

_SECOND = """other AS (SELECT *, CAST(0.35 AS DOUBLE) * p + CAST(0.65 AS DOUBLE) * CASE WHEN cand < 'S3' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS q FROM probable)"""


def _by_source():
    """A scorer for tests: the second text begins with a letter that says its source."""
    return lambda a, b: [0.25 if y.startswith("2") else 0.75 for y in b]


def _coded(spark, d):
    p = _probable(spark, d)
    pool = p.select(F.col("cand").alias("entity_id")).distinct().select("entity_id", F.when(F.col("entity_id") < "S3", "2").otherwise("3").alias("business_name"), F.lit("").alias("business_address"), F.lit("").alias("country"))
    index = p.select(F.col("s1").alias("entity_id")).distinct().select("entity_id", F.lit("").alias("business_name"), F.lit("").alias("business_address"), F.lit("").alias("country"))
    return p, index, pool


@query(f"WITH {PROBABLE}, {_SECOND} SELECT s1, cand, CASE WHEN p > 0.4 AND p < 0.85 THEN q ELSE p END AS p FROM other")
def cascade_blend(spark, d):
    """Uncertain pairs are mixed with a second scorer, the others never reach it."""
    p, index, pool = _coded(spark, d)
    return R.cascade(p, index, pool, 0.40, 0.85, 0.65, _by_source).select("s1", "cand", "p")


@query(f"WITH {PROBABLE} SELECT s1, cand, CAST(0.4 AS DOUBLE) * p + CAST(0.6 AS DOUBLE) * CASE WHEN cand < 'S3' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS p FROM probable")
def full_blend(spark, d):
    p, index, pool = _coded(spark, d)
    return R.full_rescore(p, index, pool, 0.60, _by_source).select("s1", "cand", "p")


@query()
def cascade_similarity(spark, d):
    """The cascade with the scorer that is always at hand."""
    return R.cascade(_probable(spark, d), _index(spark, d), _pool(spark, d), 0.40, 0.85, 0.65).select("s1", "cand", F.round("p", 6).alias("p"))


@query("""WITH rows AS (SELECT source1_entity_id AS s1, CASE WHEN trim(matched_entity_ids) = '' OR matched_entity_ids IS NULL OR regexp_full_match(matched_entity_ids, '\\s*') THEN [] ELSE string_split(matched_entity_ids, ',') END AS ids FROM train_labels WHERE source1_entity_id IS NOT NULL),
    items AS (SELECT s1, unnest(ids) AS id FROM rows), required AS (SELECT DISTINCT entity_id AS id FROM train_source1),
    bad AS (SELECT DISTINCT 'duplicate_row' AS issue, s1 AS x FROM rows GROUP BY s1 HAVING count(*) > 1
        UNION SELECT 'repeated_id', s1 FROM rows WHERE len(ids) > len(list_distinct(ids))
        UNION SELECT 'self_match', id FROM items WHERE starts_with(id, 'S1-')
        UNION SELECT 'wrong_prefix', id FROM items WHERE NOT starts_with(id, 'S1-') AND NOT starts_with(id, 'S2-') AND NOT starts_with(id, 'S3-')
        UNION SELECT 'missing_row', id FROM required WHERE id NOT IN (SELECT s1 FROM rows)
        UNION SELECT 'extra_row', s1 FROM rows WHERE s1 NOT IN (SELECT id FROM required)
        UNION SELECT 'unknown_id', id FROM items WHERE (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) AND id NOT IN (SELECT entity_id FROM train_source2 UNION ALL SELECT entity_id FROM train_source3))
    SELECT issue, count(*) AS n, array_to_string(list_sort(list(x))[1:5], ', ') AS examples FROM bad GROUP BY issue""")
def validate_report(spark, d):
    """The list checks, with the raw labels as if they were a result file."""
    lines = table(spark, d, "train_labels").where("source1_entity_id is not null").select(F.concat("source1_entity_id", F.lit("\t"), F.coalesce("matched_entity_ids", F.lit(""))).alias("value"))
    required = table(spark, d, "train_source1").select(F.col("entity_id").alias("id")).distinct()
    valid = table(spark, d, "train_source2").select(F.col("entity_id").alias("id")).unionByName(table(spark, d, "train_source3").select(F.col("entity_id").alias("id"))).distinct()
    return V.list_issues(V.parse_lines(lines), required, valid)


@query(f"""WITH {Q.BLOCK}, probable AS (SELECT s1, cand, score, round(1.0 / (1.0 + exp(-(8.0 * score - 8.0))), 6) AS p FROM pruned), {SINGLE}, {THRESHOLD},
    lists AS (SELECT s1, string_agg(cand, ',' ORDER BY cand) AS ids FROM decided GROUP BY s1)
    SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM ix LEFT JOIN lists ON s1 = entity_id""")
def resolve_end_to_end(spark, d):
    """From the three sources to each record's matches, by the retrieval score."""
    return list_lines(resolve(_index(spark, d, *TEXTS), _pool(spark, d, *TEXTS)))
