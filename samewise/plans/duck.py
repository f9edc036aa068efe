"""DuckDB SQL with the meaning of the normaliser, the tokenisers and the retrieval, to check them against."""

from __future__ import annotations

import re

from samewise.functions import dictionaries as D
from samewise.functions.normalize import LIGATURES


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(table.items())) + f" ELSE {x} END"


def phonetic(e: str) -> str:
    for a, b in D.PHONETIC:
        e = f"replace({e}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        e = f"replace({e}, '{c}{c}', '{c}')"
    return e


def base(e: str, variant: str = "g2") -> str:
    s = f"coalesce({e}, '')"
    for a, b in LIGATURES.items():
        s = f"replace({s}, '{a}', '{b}')"
    s = f"replace(trim(lower(strip_accents({s}))), '&', ' and ')"
    s = f"regexp_replace({s}, '{D.DOMAIN}', '\\1')"
    s = f"regexp_replace({s}, '{D.ORDINAL}', '\\1', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9 ]+', ' ', 'g')"
    return s if variant == "g1" else phonetic(s)


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def country(e: str) -> str:
    return f"CASE WHEN trim(coalesce({e}, '')) = '' THEN 'unk' ELSE lower(trim({e})) END"


def states(e: str, land: str, variant: str = "g2") -> str:
    def one(x: str, table: dict[str, str]) -> str:
        table = table if variant == "g1" else D.folded(table)
        for name in sorted(table, key=lambda n: (-len(n), n)):
            x = f"regexp_replace({x}, '\\b{re.escape(name).replace(chr(92) + ' ', ' ')}\\b', '{table[name]}', 'g')"
        return x

    if variant == "g1":
        return one(e, {**D.STATES["us"], **D.STATES["india"]})
    return f"CASE {land} " + " ".join(f"WHEN '{n}' THEN {one(e, t)}" for n, t in D.STATES.items()) + f" ELSE {e} END"


def prepared(name: str, tables: list[str], variant: str = "g2") -> str:
    """CTEs that end in ``name``: the prepared form of one or several source tables."""
    legal = D.LEGAL_G1 if variant == "g1" else D.folded(D.LEGAL)
    forms = ", ".join(f"'{w}'" for w in sorted(set((D.LEGAL_G1 if variant == "g1" else D.LEGAL).values())))
    addr = D.ADDRESS_G1 if variant == "g1" else D.folded(D.ADDRESS)
    none = D.MISSING_G1 if variant == "g1" else (*D.MISSING, *map(D.fold_word, D.MISSING))
    missing = ", ".join(f"'{w}'" for w in sorted(set(none)))
    union = " UNION ALL ".join(f"SELECT *, '{t}' AS t FROM {t} WHERE entity_id IS NOT NULL" for t in tables)
    return f"""
    {name}_0 AS (SELECT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS land,
        row_number() OVER (PARTITION BY t, entity_id ORDER BY loaded_at DESC, coalesce(business_name, ''), coalesce(business_address, ''), coalesce(country, '')) AS r FROM ({union})),
    {name}_1 AS (SELECT entity_id, business_name, business_address, {country('land')} AS country, {base('business_name', variant)} AS bn, {base('business_address', variant)} AS ba FROM {name}_0 WHERE r = 1),
    {name}_2 AS (SELECT *, list_transform({words('bn')}, lambda w: {_case('w', legal)}) AS n, {states('ba', 'country', variant)} AS st FROM {name}_1),
    {name}_3 AS (SELECT *, list_filter(n, lambda w: w NOT IN ({forms})) AS c0,
        list_sort(list_transform(list_filter({words('st')}, lambda w: w NOT IN ({missing})), lambda w: {_case('w', addr)})) AS a FROM {name}_2),
    {name}_4 AS (SELECT *, CASE WHEN len(c0) = 0 THEN n ELSE c0 END AS c, list_sort(list_distinct(list_filter(a, lambda w: regexp_full_match(w, '[0-9]+')))) AS d FROM {name}_3),
    {name} AS (SELECT entity_id, business_name, business_address, country, array_to_string(n, ' ') AS name_full, array_to_string(c, ' ') AS core, array_to_string(c, '') AS nosp,
        array_to_string(a, ' ') AS addr, array_to_string(d, ' ') AS nums, array_to_string(list_filter(d, lambda w: length(w) IN (5, 6)), ' ') AS zips FROM {name}_4)"""


INDEX, POOL = prepared("ix", ["train_source1"]), prepared("pl", ["train_source2", "train_source3"])


def standard_s1(e: str) -> str:
    """The standard form of a Source 1 id."""
    d = f"regexp_extract(upper(translate({e}, '０１２３４５６７８９ＳｓＩｌＯ', '0123456789SsIlO')), '^[^\\p{{L}}\\p{{N}}]*S[^\\p{{L}}\\p{{N}}]*1(?:[^\\p{{L}}\\p{{N}}]+0*|0*)([0-9]+)[^\\p{{L}}\\p{{N}}]*$', 1)"
    return f"CASE WHEN {d} = '' THEN trim({e}) WHEN length({d}) < 8 THEN 'S1-' || lpad({d}, 8, '0') ELSE 'S1-' || {d} END"


def packed(e: str) -> str:
    """The values of a packed field: quoted ones, and runs of what is no delimiter, quote or bracket; no words for none."""
    found = f"regexp_extract_all(coalesce({e}, ''), concat('\"[^\"]*\"|', chr(39), '[^', chr(39), ']*', chr(39), '|[^\\s,;|/\"', chr(39), '\\[\\](){{}}]+'))"
    words = "'', 'none', 'null', 'nil', 'nan', 'na', 'n', 'a', 'no', 'match', 'nothing', 'empty', '-', '--'"
    return f"list_filter(list_transform({found}, lambda t: trim(trim(t, concat('\"', chr(39))))), lambda t: lower(t) NOT IN ({words}))"


TRUTH = f"""labelled AS (SELECT DISTINCT {standard_s1('source1_entity_id')} AS s1 FROM train_labels WHERE source1_entity_id IS NOT NULL),
    truth AS (SELECT DISTINCT {standard_s1('source1_entity_id')} AS s1, cand FROM (SELECT source1_entity_id, unnest({packed('matched_entity_ids')}) AS cand FROM train_labels) WHERE source1_entity_id IS NOT NULL)"""

TOKENS = {
    "char3": lambda x: f"list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))",
    "char_wb3": lambda x: f"flatten(list_transform({words(x)}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))",
    "word12": lambda x: f"list_concat(regexp_extract_all({x}, '\\b\\w\\w+\\b'), list_transform(range(1, len(regexp_extract_all({x}, '\\b\\w\\w+\\b'))), lambda i: regexp_extract_all({x}, '\\b\\w\\w+\\b')[i] || ' ' || regexp_extract_all({x}, '\\b\\w\\w+\\b')[i + 1]))",
}
CHANNELS = {"nosp": ("nosp", "char3", 1), "name_word": ("core", "word12", 2), "addr": ("addr", "char_wb3", 1), "addr_word": ("addr", "word12", 2)}

PARTS = """
    plp AS (SELECT pl.*, CASE WHEN country IN (SELECT country FROM ix) THEN country ELSE '*' END AS part FROM pl),
    ixp AS (SELECT ix.*, part FROM ix, (SELECT DISTINCT part FROM plp) WHERE part = country OR part = '*')"""


def weighted(channel: str, max_df: float = 0.3) -> str:
    """CTEs ``wi_<channel>`` and ``wq_<channel>``: part, id, term, w."""
    col, kind, least = CHANNELS[channel]
    c = channel
    count = lambda t: f"SELECT part, id, term, count(*) AS tf FROM (SELECT part, entity_id AS id, unnest({TOKENS[kind](col)}) AS term FROM {t}) GROUP BY ALL"
    weigh = lambda t: f"SELECT part, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS w FROM (SELECT part, id, term, (1 + ln(tf)) * idf AS w FROM {t}_{c} JOIN v_{c} USING (part, term))"
    return f"""
    ci_{c} AS ({count('ixp')}), cq_{c} AS ({count('plp')}),
    v_{c} AS (SELECT part, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT part, term, count(*) AS df FROM ci_{c} GROUP BY ALL) JOIN (SELECT part, count(*) AS n FROM ixp GROUP BY ALL) USING (part) WHERE df >= {least} AND df <= {max_df} * n),
    wi_{c} AS ({weigh('ci')}), wq_{c} AS ({weigh('cq')})"""


def topk(channel: str, k: int = 7, threshold: float = 0.1) -> str:
    """CTE ``k_<channel>``: part, q, s, sim."""
    c = channel
    return f"""{weighted(c)},
    d_{c} AS (SELECT q.part, q.id AS q, i.id AS s, round(sum(q.w * i.w), 6) AS sim FROM wq_{c} q JOIN wi_{c} i ON q.part = i.part AND q.term = i.term GROUP BY 1, 2, 3),
    k_{c} AS (SELECT part, q, s, sim FROM (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY sim DESC, s) AS r FROM d_{c} WHERE sim > {threshold}) WHERE r <= {k})"""


FUSED = (
    ",".join(topk(c) for c in CHANNELS)
    + """,
    every AS (SELECT q AS cand, s AS s1, 'nosp' AS ch, sim FROM k_nosp UNION ALL SELECT q, s, 'name_word', sim FROM k_name_word UNION ALL SELECT q, s, 'addr', sim FROM k_addr UNION ALL SELECT q, s, 'addr_word', sim FROM k_addr_word),
    fused AS (SELECT cand, s1, coalesce(max(sim) FILTER (ch = 'nosp'), 0.0) AS nosp, coalesce(max(sim) FILTER (ch = 'name_word'), 0.0) AS name_word, coalesce(max(sim) FILTER (ch = 'addr'), 0.0) AS addr, coalesce(max(sim) FILTER (ch = 'addr_word'), 0.0) AS addr_word FROM every GROUP BY ALL),
    rolled AS (SELECT *, greatest(nosp, name_word) AS sim_name, greatest(addr, addr_word) AS sim_addr FROM fused),
    scored AS (SELECT *, greatest(sim_name, sim_addr) + 0.5 * least(sim_name, sim_addr) AS score FROM rolled),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) - 1 AS INTEGER) AS rank, max(score) OVER (PARTITION BY cand) AS best FROM scored),
    raw AS (SELECT s1, cand, sim_name, sim_addr, name_word AS sim_name_word, addr_word AS sim_addr_word, score, best, rank, best - coalesce(max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY cand), 0.0) AS gap FROM ranked),
    pruned AS (SELECT * FROM raw WHERE best >= 0.0 AND score >= best - CAST(0.7 AS DOUBLE) AND rank < 8)"""
)

BLOCK = f"{INDEX},{POOL},{PARTS},{FUSED}"


def per_entity(pred: str) -> str:
    return f"""per AS (SELECT e.s1, count(DISTINCT p.cand) AS np, (SELECT count(*) FROM truth t WHERE t.s1 = e.s1) AS nt, count(DISTINCT t2.cand) AS tp
        FROM labelled e LEFT JOIN {pred} p ON p.s1 = e.s1 LEFT JOIN truth t2 ON t2.s1 = p.s1 AND t2.cand = p.cand GROUP BY e.s1)"""


F05 = "CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END"
