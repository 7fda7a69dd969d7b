"""The queries of plans.queries in DuckDB's SQL, put together from common table expressions."""

from __future__ import annotations

import re

from linkloom.functions.normalize import ADDRESS_WORDS, COUNTRY_ALIASES, LEGAL_SUFFIXES
from linkloom.operators.diagnose import MISS_PREDICATES
from linkloom.plans.fixtures import AWKWARD, BY_HAND
from linkloom.plans.params import CAPS, F2, MAX_DF, PILOT, SCORE_AT, THRESHOLDS


def _ascii(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"


def _basic(x: str) -> str:
    return rf"replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '&', 'and')"


def _list(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _case(table: dict, x: str, other: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_spaced = lambda x, keep="": rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s{keep}]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAME = _spaced("replace(lower(business_name), '&', ' and ')")
_ADDRESS = f"array_to_string(list_transform(string_split({_spaced('lower(business_address)', '#')}, ' '), lambda w: {_case(ADDRESS_WORDS, 'w', 'w')}), ' ')"
_LABEL = r"trim(regexp_replace(lower(country), '\s+', ' ', 'g'))"
_COUNTRY = _case(COUNTRY_ALIASES, "l", r"CASE WHEN regexp_matches(l, '^\p{L}{2}$') THEN upper(l) ELSE l END")
_SUFFIX = f"regexp_extract(name, '(?:^| )({'|'.join(sorted(LEGAL_SUFFIXES, key=lambda s: -len(s.split())))})$', 1)"


def _top(rows: str, k: int, order: str, by: str = "entity_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {rows}) WHERE rn <= {k}"


def _anchors(k: int, tokens: str = "ntok") -> str:
    top = _top(f"(SELECT t.*, df FROM {tokens} t JOIN ndf USING (token) WHERE src = 1 AND df <= {MAX_DF})", k, "df, token")
    return f"SELECT DISTINCT entity_id, country, token FROM ({top})"


def _pairs(left: str, right: str, keys: str) -> str:
    return f"SELECT DISTINCT l.entity_id AS s1_id, r.entity_id AS cand_id FROM {left} l JOIN {right} r USING ({keys})"


def _number(anchors: str, names: str) -> str:
    both = lambda t: f"(SELECT t.entity_id, t.country, t.token, n.number FROM {t} t JOIN nrm n USING (entity_id) WHERE n.number <> '')"
    return _pairs(both(anchors), both(names), "country, token, number")


def _address(best: str, anchors: str, names: str, postings: str) -> str:
    left = f"(SELECT a.entity_id, a.country, a.token, b.token AS addr_token FROM {anchors} a JOIN {best} b USING (entity_id))"
    right = f"(SELECT n.entity_id, n.country, n.token, p.token AS addr_token FROM {names} n JOIN {postings} p USING (entity_id))"
    return _pairs(left, right, "country, token, addr_token")


def _layered(k: int, tokens: str, ties: str) -> dict[str, str]:
    return {
        "anch": _anchors(k, tokens),
        "best": _top(f"(SELECT a.*, z.posting_size FROM atokp a JOIN asize z USING (country, token) WHERE a.src = 1)", 1, f"posting_size, {ties}"),
        "edges": f"{EXACT} UNION {_number('anch', 'npost')} UNION {_address('best', 'anch', 'npost', 'apost')}",
    }


EXACT = "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM nrm a JOIN nrm b ON a.name = b.name AND a.name <> '' WHERE a.src = 1 AND b.src <> 1"


def _tokens(x: str, least: int, distinct: bool = True, country: str = "country", of: str = "nrm") -> str:
    inner = f"SELECT entity_id, src, {country} AS country, unnest(string_split({x}, ' ')) AS token FROM {of}"
    return f"SELECT {'DISTINCT ' if distinct else ''}* FROM ({inner}) WHERE length(token) >= {least}"


#: Tables by name, in an order in which each needs only those before it.
TABLES = {
    "d": "SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(n_chars, 0) AS n_chars, doc_id % 3 + 1 AS src FROM documents",
    "rec": f"SELECT 'S' || src || '-' || doc_id AS entity_id, src, substring(text, 1, 32) AS business_name, (n_chars % 97) || ' ' || substring(text, 33, 64) AS business_address, lang AS country, {_ascii('substring(text, 97, 100)')} AS truth_key FROM d",
    "nrm": rf"SELECT *, regexp_extract(addr, '\b\d+[a-z]?\b', 0) AS number FROM (SELECT entity_id, src, {_ascii('business_name')} AS name, {_ascii('business_address')} AS addr, {_ascii('country')} AS country, country AS raw, {_basic('business_name')} AS basic FROM rec)",
    "spine": "SELECT entity_id AS s1_id FROM rec WHERE src = 1",
    "gt": "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM rec a JOIN rec b USING (truth_key) WHERE a.src = 1 AND b.src <> 1 AND length(truth_key) >= 60",
    "btok": r"SELECT DISTINCT * FROM (SELECT entity_id, src, raw AS country, unnest(regexp_split_to_array(basic, '\s+')) AS token FROM nrm) WHERE length(token) >= 4",
    "bdf": "SELECT token, count(*) AS df FROM btok WHERE src <> 1 GROUP BY token",
    "ntok": _tokens("name", 4),
    "ntokd": _tokens("name", 4, False),
    "ndf": "SELECT token, count(*) AS df FROM ntok WHERE src <> 1 GROUP BY token",
    "npost": f"SELECT n.* FROM ntok n JOIN ndf USING (token) WHERE src <> 1 AND df <= {MAX_DF}",
    "atok": _tokens("addr", 4),
    "atokp": "SELECT entity_id, src, country, token, min(place) AS place FROM (SELECT entity_id, src, country, unnest(string_split(addr, ' ')) AS token, generate_subscripts(string_split(addr, ' '), 1) AS place FROM nrm) WHERE length(token) >= 4 GROUP BY ALL",
    "apost": _top("(SELECT * FROM atok WHERE src <> 1)", CAPS["posting_cap"], "src, entity_id", "country, token"),
    "asize": "SELECT country, token, count(*) AS posting_size FROM apost GROUP BY ALL",
    "can": f"SELECT entity_id, src, {_ADDRESS} AS address, {_COUNTRY} AS country FROM (SELECT *, {_LABEL} AS l FROM (SELECT * FROM rec))",
    "ftok": _tokens("lower(address)", 1, of="(SELECT * FROM can WHERE address <> '')"),
    "fdf": f"SELECT token, count(*) AS df FROM ftok WHERE src <> 1 GROUP BY token HAVING count(*) <= (SELECT greatest(1, floor(count(*) * CAST({F2['df_fraction']} AS DOUBLE))) FROM can WHERE src <> 1 AND address <> '')",
    "fkept": _top("(SELECT f.*, df FROM ftok f JOIN fdf USING (token) WHERE src <> 1)", F2["bucket_cap"], "entity_id", "token"),
    "fref": _top("(SELECT * EXCLUDE rn FROM fkept)", F2["ref_k"], "df, token"),
    "fs1": _top("(SELECT f.*, df FROM ftok f JOIN fdf USING (token) WHERE src = 1)", F2["s1_k"], "df, token"),
    "f2": f"SELECT l.entity_id AS s1_id, r.entity_id AS cand_id FROM fs1 l JOIN fref r USING (country, token) GROUP BY ALL HAVING count(*) >= {F2['min_shared']}",
    "ptok": "SELECT DISTINCT * FROM (SELECT entity_id, src, country, unnest(regexp_split_to_array(lower(address), '[^0-9A-Za-z]+')) AS token FROM can) WHERE length(token) >= 2",
    "pdf": f"SELECT token, count(*) AS df FROM ptok WHERE src <> 1 GROUP BY token HAVING count(*) <= (SELECT greatest(0, floor(count(*) * CAST({PILOT['df_fraction']} AS DOUBLE))) FROM can WHERE src <> 1) AND count(*) <= {PILOT['bucket_cap']}",
    "pref": _top("(SELECT p.*, df FROM ptok p JOIN pdf USING (token) WHERE src <> 1)", PILOT["ref_k"], "df, token"),
    "ps1": _top("(SELECT p.*, df FROM ptok p JOIN pdf USING (token) WHERE src = 1)", PILOT["ref_k"], "df, token"),
}

_P = "CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_pred END"
_R = "CASE WHEN n_true = 0 THEN 1 ELSE tp::DOUBLE / n_true END"
_FS = "CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE CAST(1.25 AS DOUBLE) * p * r / (CAST(0.25 AS DOUBLE) * p + r) END"
_V1 = _layered(1, "ntok", "token")
_CATEGORY = "CASE WHEN is_singleton THEN CASE WHEN n_pred = 0 THEN 'singleton_correct' ELSE 'singleton_false_positive' END WHEN n_pred = 0 THEN 'nonsingleton_total_miss' WHEN precision = 1 AND recall = 1 THEN 'nonsingleton_correct' WHEN recall = 1 THEN 'nonsingleton_over_matched' WHEN precision = 1 THEN 'nonsingleton_under_matched' ELSE 'nonsingleton_mixed_errors' END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_eq = lambda c: f"(a.{c} <> '' AND a.{c} = b.{c})::INT::DOUBLE"
#: Longest common subsequences of all pairs of texts in `texts` (x, y), a row of the table for each step.
_LCS = {
    "texts": None,
    "work": "SELECT row_number() OVER (ORDER BY x, y) AS k, x, y FROM (SELECT DISTINCT x, y FROM texts) WHERE x <> y AND x <> '' AND y <> ''",
    "cols": "SELECT k, x, unnest(range(1, length(y) + 1)) AS j, y FROM work",
    "lcs": "SELECT k, j, 0 AS i, 0::BIGINT AS v, x, substring(y, j, 1) AS c, length(x) AS n FROM cols"
           " UNION ALL SELECT k, j, i + 1, max(t) OVER (PARTITION BY k ORDER BY j), x, c, n FROM (SELECT *, greatest(v, coalesce(lag(v) OVER (PARTITION BY k ORDER BY j), 0) + (c = substring(x, i + 1, 1))::INT) AS t FROM lcs WHERE i < n)",
    "sim": "SELECT x, y, 2.0::DOUBLE * m / (length(x) + length(y)) AS ratio FROM (SELECT k, max(v) AS m FROM lcs WHERE i = n GROUP BY k) JOIN work USING (k)",
}
_ratio = lambda c, s: f"CASE WHEN a.{c} = b.{c} THEN 1.0::DOUBLE WHEN a.{c} = '' OR b.{c} = '' THEN 0.0::DOUBLE ELSE {s}.ratio END"

_EXTRA = {
    "counts": "SELECT s1_id, coalesce(n_true, 0)::BIGINT AS n_true, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(tp, 0)::BIGINT AS tp FROM spine LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM (SELECT DISTINCT * FROM gt) GROUP BY s1_id) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM pred GROUP BY s1_id) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS tp FROM (SELECT DISTINCT * FROM gt) JOIN pred USING (s1_id, cand_id) GROUP BY s1_id) USING (s1_id)",
    "scores": f"SELECT s1_id, n_true = 0 AS is_singleton, n_true, n_pred, p AS precision, r AS recall, {_FS} AS f0_5 FROM (SELECT *, {_P} AS p, {_R} AS r FROM counts)",
    "buckets": f"SELECT *, {_CATEGORY} AS category FROM scores",
    "toks": f"SELECT entity_id, list_distinct({_list('name')}) AS nt, list_distinct({_list('addr')}) AS at FROM nrm",
    "scored": f"SELECT s1_id, cand_id, ({_jaccard('a.nt', 'b.nt')} + {_overlap('a.at', 'b.at')}) / 2 AS score FROM edges JOIN toks a ON a.entity_id = s1_id JOIN toks b ON b.entity_id = cand_id",
    "canon": rf"SELECT *, substring(name, 1, length(name) - length(suffix)) AS core_, regexp_extract(' ' || address || ' ', '[^\p{{L}}\p{{N}}_](\p{{Nd}}+[a-z]?)[^\p{{L}}\p{{N}}_]', 1) AS number FROM (SELECT *, {_SUFFIX} AS suffix FROM (SELECT rec.entity_id, {_NAME} AS name, can.address, can.country FROM rec JOIN can USING (entity_id)))",
}


_EXTRA["canonn"] = f"SELECT *, list_distinct({_list('name')}) AS nt FROM canon"


def _with(tables: dict[str, str], last: str, recursive: bool = False) -> str:
    """The tables that `last` needs, each after those that it needs itself, then `last`."""
    every = TABLES | _EXTRA | tables
    needed: dict[str, str] = {}

    def visit(sql: str, above: tuple = ()) -> None:
        for name in sorted(set(re.findall(r"\w+", sql)) & set(every) - set(above)):
            if name not in needed:
                visit(every[name], (*above, name))
                needed[name] = every[name]

    visit(last)
    body = ",\n".join(f"{k} AS ({v})" for k, v in needed.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{last}" if body else last


def _pred(sql: str) -> dict[str, str]:
    return {"pred": sql}


_BASIC_PRED = _pred("SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM nrm a JOIN nrm b USING (basic) WHERE a.src = 1 AND b.src <> 1")
_V1_PRED = _V1 | _pred("SELECT * FROM edges")
_SCORED_PRED = _V1 | _pred(f"SELECT s1_id, cand_id FROM scored WHERE score >= {SCORE_AT}")
_STEPS = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold)"
_SWEEP = f"""SELECT threshold, round(avg(f), 6) AS macro_f0_5, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM (SELECT *, {_FS} AS f FROM (SELECT *, {_P} AS p, {_R} AS r FROM (
    SELECT s1_id, threshold, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM spine CROSS JOIN {_STEPS}
    LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM (SELECT DISTINCT * FROM gt) GROUP BY s1_id) USING (s1_id)
    LEFT JOIN (SELECT s.s1_id, threshold, count(*) AS n_pred, count(g.s1_id) AS tp FROM scored s JOIN {_STEPS} ON threshold <= score LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (s1_id, cand_id) GROUP BY ALL) USING (s1_id, threshold)))) GROUP BY threshold"""
_MISS = f"""SELECT s1_id, cand_id, {_eq('name')} AS name_exact, {_jaccard('a.nt', 'b.nt')} AS name_jaccard, {_overlap('a.nt', 'b.nt')} AS name_overlap, len(list_intersect(a.nt, b.nt)) AS shared_name_tokens,
    {_eq('addr')} AS address_exact, {_jaccard('a.at', 'b.at')} AS address_jaccard, {_overlap('a.at', 'b.at')} AS address_overlap, len(list_intersect(a.at, b.at)) AS shared_address_tokens, {_eq('number')} AS address_number_equal, {_eq('country')} AS country_equal,
    a.name AS s1_name, b.name AS true_name, a.addr AS s1_address, b.addr AS true_address
    FROM missed JOIN (SELECT * FROM nrm JOIN toks USING (entity_id)) a ON a.entity_id = s1_id JOIN (SELECT * FROM nrm JOIN toks USING (entity_id)) b ON b.entity_id = cand_id"""
_MISSED = _V1 | {"missed": "SELECT DISTINCT s1_id, cand_id FROM edges ANTI JOIN f2 USING (s1_id, cand_id)"}
#: Lengths of the matching blocks of all pairs of texts in `texts` (x, y): the longest block first (the first in x, then in
#: y, of equals), then on both of its sides, a row of `part` for each stretch.
_BLOCKS = {
    "texts": None,
    "work": "SELECT row_number() OVER (ORDER BY x, y) AS k, x, y FROM (SELECT DISTINCT x, y FROM texts) WHERE x <> y AND x <> '' AND y <> ''",
    "xs": "SELECT k, unnest(range(1, length(x) + 1)) AS i, x FROM work",
    "ys": "SELECT k, unnest(range(1, length(y) + 1)) AS j, y FROM work",
    "hits": "SELECT a.k, i, j FROM xs a JOIN ys b ON a.k = b.k AND substring(x, i, 1) = substring(y, j, 1)",
    "part": """SELECT k, 1::BIGINT AS alo, length(x) + 1 AS ahi, 1::BIGINT AS blo, length(y) + 1 AS bhi, 0::BIGINT AS m FROM work
        UNION ALL SELECT k, unnest([alo, i0 + n]), unnest([i0, ahi]), unnest([blo, j0 + n]), unnest([j0, bhi]), unnest([n, 0]) FROM (
            SELECT *, row_number() OVER (PARTITION BY k, alo, blo ORDER BY n DESC, i0, j0) AS nth FROM (
                SELECT k, alo, ahi, blo, bhi, count(*) AS n, min(i) AS i0, min(j) AS j0 FROM (
                    SELECT s.k, alo, ahi, blo, bhi, i, j, i - row_number() OVER (PARTITION BY s.k, alo, blo, i - j ORDER BY i) AS run
                    FROM part s JOIN hits h ON h.k = s.k AND i >= alo AND i < ahi AND j >= blo AND j < bhi)
                GROUP BY k, alo, ahi, blo, bhi, i - j, run))
        WHERE nth = 1""",
    "sim": "SELECT x, y, 2.0::DOUBLE * m / (length(x) + length(y)) AS ratio FROM (SELECT k, sum(m) AS m FROM part GROUP BY k) JOIN work USING (k)",
}
_MISS_SIM = _MISSED | {"miss0": _MISS} | _BLOCKS | {
    "texts": "SELECT s1_name AS x, true_name AS y FROM miss0 UNION SELECT s1_address, true_address FROM miss0",
    "miss": "SELECT m.*, CASE WHEN s1_name = true_name THEN 1.0::DOUBLE WHEN s1_name = '' OR true_name = '' THEN 0.0::DOUBLE ELSE s.ratio END AS name_ratio, CASE WHEN s1_address = true_address THEN 1.0::DOUBLE WHEN s1_address = '' OR true_address = '' THEN 0.0::DOUBLE ELSE t.ratio END AS address_ratio FROM miss0 m LEFT JOIN sim s ON s.x = s1_name AND s.y = true_name LEFT JOIN sim t ON t.x = s1_address AND t.y = true_address",
}
_PILOT_ANCH = {
    "rtok": _tokens("name", 4, country="raw"),
    "ratok": _tokens("addr", 4, country="raw"),
    "rbest": _top("(SELECT t.*, z.n FROM rtok t JOIN (SELECT country, token, count(*) AS n FROM rtok WHERE src <> 1 GROUP BY ALL) z USING (country, token) WHERE src = 1)", 1, "n, token"),
    "rabest": _top("(SELECT t.*, z.n FROM ratok t JOIN (SELECT country, token, count(*) AS n FROM ratok WHERE src <> 1 GROUP BY ALL) z USING (country, token) WHERE src = 1)", 1, "n, token"),
    "rref": "SELECT * FROM rtok WHERE src <> 1",
    "raref": "SELECT * FROM ratok WHERE src <> 1",
}
_B6 = _number("rbest", "rref")
_C6 = _address("rabest", "rbest", "rref", "raref")
_BOUNDED = {
    "b_n": _top("npost", CAPS["name_cap"], "src, entity_id", "country, token"),
    "b_num": _top("(SELECT entity_id, src, country, number AS token FROM nrm WHERE src <> 1 AND number <> '')", CAPS["number_cap"], "src, entity_id", "country, token"),
    "b_a": _top("(SELECT * FROM atok WHERE src <> 1)", CAPS["address_cap"], "src, entity_id", "country, token"),
    "anch": _anchors(2),
}
_UNION = _V1 | {"v1_f2": "SELECT s1_id, cand_id FROM edges UNION SELECT s1_id, cand_id FROM f2"}


def _rare(k: int, country: bool) -> str:
    top = _top(f"(SELECT t.*, df FROM btok t JOIN bdf USING (token) WHERE src = 1 AND df <= {MAX_DF})", k, "df, token")
    return _with({}, _pairs(f"({top})", "(SELECT * FROM btok WHERE src <> 1)", "country, token" if country else "token"))


def _quantiles(sql: str) -> str:
    points = [0.5, 0.9, 0.95, 0.99, 0.999, 1.0]
    return " UNION ALL ".join(f"SELECT {p}::DOUBLE AS point, quantile_cont(n, {p})::DOUBLE AS value FROM ({sql})" for p in points)


def _describe(c: str, of: str) -> str:
    points = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    return f"SELECT '{c}' AS column, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, {points} FROM {of}"


def _values(rows, names: str) -> str:
    text = lambda x: "''" if x is None else " || ".join(f"'{p}'" for p in str(x).replace("'", "''").split("\n")).replace("' || '", "' || chr(10) || '")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


#: fixtures.broken_lists, and what is wrong with them.
_BROKEN = _SCORED_PRED | {
    "lists": "SELECT s1_id AS own, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS ids, CAST(regexp_extract(s1_id, '-(\\d+)$', 1) AS BIGINT) AS n FROM spine LEFT JOIN pred USING (s1_id) GROUP BY s1_id",
    "spoilt": "SELECT own, CASE WHEN n % 13 = 0 THEN ids || ',S2-none' WHEN n % 17 = 0 THEN ids || ',S2-1, S2-1' ELSE ids END AS ids, n FROM lists",
    "broken": "SELECT own, list_filter(list_transform(string_split(ids, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM (SELECT * FROM spoilt WHERE n % 7 <> 0 UNION ALL SELECT * FROM spoilt WHERE n % 11 = 0 UNION ALL SELECT own || '-x', ids, n FROM spoilt WHERE n % 19 = 0)",
    "named": "SELECT own AS s1_id, unnest(ids) AS cand_id FROM broken",
}
_INVARIANTS = """SELECT 'row_per_s1' AS invariant, (SELECT count(*) FROM spine LEFT JOIN (SELECT own, count(*) AS n FROM broken GROUP BY own) ON own = s1_id WHERE coalesce(n, 0) <> 1) AS violations
    UNION ALL SELECT 'unknown_s1', (SELECT count(*) FROM broken WHERE own NOT IN (SELECT s1_id FROM spine))
    UNION ALL SELECT 'repeated_ids', (SELECT count(*) FROM broken WHERE len(ids) <> len(list_distinct(ids)))
    UNION ALL SELECT 'unknown_ids', (SELECT count(*) FROM named WHERE cand_id NOT IN (SELECT entity_id FROM rec WHERE src <> 1))
    UNION ALL SELECT 'not_candidates', (SELECT count(*) FROM named ANTI JOIN f2 USING (s1_id, cand_id))"""
_ALL_EDGES = _UNION | {"rows": "SELECT s1_id, cand_id FROM v1_f2"}

ORACLE = {
    "norm_basic": _with({}, "SELECT entity_id, basic FROM nrm"),
    "norm_ascii": _with({}, "SELECT entity_id, name, addr, country FROM nrm"),
    "norm_name": _with({}, "SELECT entity_id, name, trim(core_) AS core, suffix FROM canon"),
    "norm_address": _with({}, "SELECT entity_id, address FROM can"),
    "norm_country": _with({}, "SELECT entity_id, country FROM can"),
    "addr_number": _with({}, "SELECT entity_id, number FROM nrm"),
    "tokens_basic": _with({}, "SELECT entity_id, token FROM btok"),
    "tokens_ascii": _with({}, "SELECT entity_id, token FROM ntok"),
    "tokens_repeated": _with({}, "SELECT entity_id, token FROM ntokd"),
    "tokens_address": _with({}, "SELECT entity_id, country, token FROM ftok"),
    "tokens_alnum": _with({}, "SELECT entity_id, country, token FROM ptok"),
    "token_df": _with({}, "SELECT token, df FROM ndf"),
    "posting_sizes": _with({}, "SELECT country, token, count(*) AS posting_size FROM npost GROUP BY ALL"),
    "rarest_token": _with({"anch": _anchors(1)}, "SELECT entity_id, country, token FROM anch"),
    "top2_tokens": _with({}, f"SELECT entity_id, token, df, rn AS rank FROM ({_top(f'(SELECT t.*, df FROM ntokd t JOIN ndf USING (token) WHERE src = 1 AND df <= {MAX_DF})', 2, 'df, token')})"),
    "posting_cap": _with({}, "SELECT entity_id, country, token FROM apost"),
    "smallest_posting": _with({}, f"SELECT entity_id, country, token, posting_size FROM ({_V1['best']})"),
    "bucket_cap": _with({}, "SELECT entity_id, country, token FROM fkept"),
    "ref_topk": _with({}, "SELECT entity_id, token, df FROM fref"),
    "s1_topk": _with({}, "SELECT entity_id, token, df FROM fs1"),
    "block_exact_basic": _with(_BASIC_PRED, "SELECT s1_id, cand_id FROM pred"),
    "block_exact_name": _with({}, EXACT),
    "block_token2": _rare(2, False),
    "block_country_token1": _rare(1, True),
    "block_country_token2": _rare(2, True),
    "block_exact_address": _with({}, "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM nrm a JOIN nrm b ON a.addr = b.addr AND a.addr <> '' WHERE a.src = 1 AND b.src <> 1"),
    "block_number_name": _with(_PILOT_ANCH, _B6),
    "block_address_name": _with(_PILOT_ANCH, _C6),
    "block_name_plus_number": _with(_PILOT_ANCH, f"{EXACT} UNION {_B6}"),
    "block_name_plus_address": _with(_PILOT_ANCH, f"{EXACT} UNION {_C6}"),
    "block_v1": _with(_V1, "SELECT s1_id, cand_id FROM edges"),
    "block_v2": _with(_layered(2, "ntokd", "place"), "SELECT s1_id, cand_id FROM edges"),
    "block_v3": _with(_layered(3, "ntok", "token"), "SELECT s1_id, cand_id FROM edges"),
    "block_bounded": _with(_BOUNDED, f"{EXACT} UNION {_pairs('anch', 'b_n', 'country, token')} UNION {_pairs('(SELECT entity_id, country, number AS token FROM nrm WHERE src = 1)', 'b_num', 'country, token')} UNION {_pairs('(SELECT * FROM atok WHERE src = 1)', 'b_a', 'country, token')}"),
    "block_f2": _with({}, "SELECT s1_id, cand_id FROM f2"),
    "block_f2_pilot": _with({}, f"SELECT l.entity_id AS s1_id, r.entity_id AS cand_id FROM ps1 l JOIN pref r USING (country, token) GROUP BY ALL HAVING count(DISTINCT token) >= {PILOT['min_shared']}"),
    "block_union": _with(_UNION, "SELECT s1_id, cand_id FROM v1_f2"),
    "s1_budget": _with({}, "SELECT s1_id FROM spine ORDER BY s1_id LIMIT 25"),
    "union_checked": _with(_UNION, "SELECT s1_id, cand_id FROM v1_f2"),
    "report_sweep": _with(_V1, f"{_SWEEP} ORDER BY macro_f0_5 DESC, threshold LIMIT 1"),
    "candidates_added": _with(_UNION, "SELECT s1_id, cand_id FROM f2 ANTI JOIN edges USING (s1_id, cand_id)"),
    "candidate_lists": _with(_UNION, "SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS candidate_entity_ids FROM spine LEFT JOIN v1_f2 USING (s1_id) GROUP BY s1_id"),
    "id_lists": _with(_UNION, "SELECT s1_id, cand_id FROM v1_f2"),
    "truth_pairs": _with({}, "SELECT s1_id, cand_id FROM gt"),
    "scored_pairs": _with(_V1, "SELECT s1_id, cand_id, score FROM scored"),
    "labelled_pairs": _with(_V1, "SELECT s1_id, cand_id, score, (g.s1_id IS NOT NULL)::INT AS label FROM scored LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (s1_id, cand_id)"),
    "predictions": _with(_SCORED_PRED, "SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM spine LEFT JOIN pred USING (s1_id) GROUP BY s1_id"),
    "entity_scores": _with(_BASIC_PRED, "SELECT * FROM scores"),
    "macro_f05": _with(_BASIC_PRED, "SELECT part, count(*) AS entities, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f0_5), 6) AS macro_f0_5 FROM (SELECT unnest(['all', CASE WHEN is_singleton THEN 'singleton' ELSE 'matched' END]) AS part, * FROM scores) GROUP BY part"),
    "error_buckets": _with(_BASIC_PRED, "SELECT category, count(*) AS entities, round(avg(f0_5), 6) AS mean_f0_5 FROM buckets GROUP BY category"),
    "bucket_by_country": _with(_BASIC_PRED, "SELECT category, " + ", ".join(f"count(*) FILTER (country = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM buckets JOIN rec ON entity_id = s1_id GROUP BY category"),
    "blocking_recall": _with(_V1_PRED, "SELECT *, s1_with_candidates / total_s1 AS coverage, candidate_pairs / total_s1 AS per_s1, recovered / true_pairs AS recall FROM (SELECT count(*) AS total_s1, sum((n_pred > 0)::BIGINT)::BIGINT AS s1_with_candidates, sum(n_pred)::BIGINT AS candidate_pairs, sum(n_true)::BIGINT AS true_pairs, sum(tp)::BIGINT AS recovered FROM counts)"),
    "recall_union": _with(_V1 | {"hit": "SELECT g.s1_id, e.s1_id AS f, x.s1_id AS s FROM (SELECT DISTINCT * FROM gt) g LEFT JOIN edges e USING (s1_id, cand_id) LEFT JOIN f2 x USING (s1_id, cand_id)"}, "SELECT *, first_hits + second_only AS union_hits, (first_hits + second_only) / true_pairs AS union_recall, 100.0::DOUBLE * second_only / true_pairs AS gain_points FROM (SELECT count(*) AS true_pairs, count(f) AS first_hits, count(s) AS second_hits, count(*) FILTER (f IS NULL AND s IS NOT NULL) AS second_only FROM hit)"),
    "candidate_quantiles": _with(_V1, _quantiles("SELECT count(*) AS n FROM edges GROUP BY s1_id")),
    "candidate_quantiles_all": _with(_V1, _quantiles("SELECT count(cand_id) AS n FROM spine LEFT JOIN edges USING (s1_id) GROUP BY s1_id")),
    "threshold_sweep": _with(_V1, _SWEEP),
    "threshold_best": _with(_V1, f"{_SWEEP} ORDER BY macro_f0_5 DESC, threshold LIMIT 1"),
    "split": _with({}, "SELECT s1_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || s1_id), s1_id) <= floor(count(*) OVER () * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM spine"),
    "sample_negatives": _with(_V1 | {"lab": "SELECT s1_id, cand_id, (g.s1_id IS NOT NULL)::INT AS label FROM edges LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (s1_id, cand_id)"}, "SELECT * FROM lab WHERE label = 1 UNION ALL SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || s1_id || ':' || cand_id), s1_id, cand_id) AS rn FROM lab WHERE label = 0) WHERE rn <= (SELECT greatest(1, 3 * sum(label)) FROM lab)"),
    "invariants": _with(_BROKEN, _INVARIANTS),
    "overmatch_report": _with(_V1_PRED, f"SELECT p.s1_id, p.cand_id, score, {_eq('name')} AS name_exact, {_jaccard('a.nt', 'b.nt')} AS name_jaccard, {_eq('country')} AS country_equal, CASE WHEN g.s1_id IS NULL THEN 'FALSE_MATCH' ELSE 'TRUE_MATCH' END AS match_type FROM pred p JOIN counts c USING (s1_id) LEFT JOIN (SELECT DISTINCT * FROM gt) g USING (s1_id, cand_id) LEFT JOIN scored USING (s1_id, cand_id) JOIN canonn a ON a.entity_id = p.s1_id JOIN canonn b ON b.entity_id = p.cand_id WHERE n_true > 0 AND c.n_pred > n_true AND tp > 0"),
    "missed_pairs": _with(_MISSED, "SELECT s1_id, cand_id FROM missed"),
    "miss_features": _with(_MISS_SIM, "SELECT * FROM miss", True),
    "miss_profile": _with(_MISS_SIM, " UNION ALL ".join(f"SELECT '{name}' AS predicate, count(*) FILTER ({p}) AS pairs, coalesce(count(*) FILTER ({p}) / nullif(count(*), 0), 0)::DOUBLE AS share FROM miss" for name, p in MISS_PREDICATES.items()), True),
    "miss_describe": _with(_MISS_SIM, " UNION ALL ".join(_describe(c, "miss") for c in ("name_ratio", "name_jaccard", "name_overlap", "address_ratio", "address_jaccard", "address_overlap")), True),
    "describe_scores": _with(_V1, _describe("score", "scored")),
    "column_profile": _with({}, " UNION ALL ".join(f"SELECT src, '{c}' AS column, count(*) AS rows, count(*) FILTER (n = 0) AS blanks, min(n) AS min_len, max(n) AS max_len, avg(n) AS mean_len FROM (SELECT src, length(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) AS n FROM rec) GROUP BY src" for c in ("business_name", "business_address", "country"))),
    "value_histogram": _with({}, "SELECT country, count(*) AS n FROM rec GROUP BY country"),
    "match_histogram": _with(_BASIC_PRED, "SELECT n_true, count(*) AS entities, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM spine) AS percent FROM counts GROUP BY n_true"),
    "singleton_rate": _with(_BASIC_PRED, "SELECT avg((n_true = 0)::INT::DOUBLE) AS singleton_rate FROM counts"),
    "lookup_upsert": _with({}, "SELECT key, entity_id FROM (SELECT truth_key AS key, entity_id, row_number() OVER (PARTITION BY truth_key ORDER BY src DESC, entity_id DESC) AS rn FROM rec) WHERE rn = 1"),
    "missing_records": _with(_V1, "SELECT count(*) AS missing_pairs FROM edges WHERE CAST(regexp_extract(s1_id, '-(\\d+)$', 1) AS BIGINT) % 5 = 0 OR CAST(regexp_extract(cand_id, '-(\\d+)$', 1) AS BIGINT) % 5 = 0"),
    "report_all": _with(_SCORED_PRED, f"""SELECT 'blocking_recall' AS part, '' AS item, round((SELECT count(*) FROM (SELECT DISTINCT * FROM gt) JOIN edges USING (s1_id, cand_id)) / (SELECT count(*) FROM (SELECT DISTINCT * FROM gt)), 6)::DOUBLE AS value
        UNION ALL SELECT 'scores', s1_id, round(f0_5, 6) FROM scores
        UNION ALL SELECT 'macro', part, round(avg(f0_5), 6) FROM (SELECT unnest(['all', CASE WHEN is_singleton THEN 'singleton' ELSE 'matched' END]) AS part, f0_5 FROM scores) GROUP BY part
        UNION ALL SELECT 'buckets', category, round(avg(f0_5), 6) FROM buckets GROUP BY category
        UNION ALL SELECT 'sweep', format('{{:.2f}}', threshold), macro_f0_5 FROM ({_SWEEP})
        UNION ALL (SELECT 'best', '', threshold FROM ({_SWEEP}) ORDER BY macro_f0_5 DESC, threshold LIMIT 1)"""),
    "norm_by_hand": _values([(f"S1-{k}", *r[3:]) for k, r in enumerate(BY_HAND)], "entity_id, name, core, suffix, address, country"),
    "tsv_round_trip": _with({}, f"SELECT entity_id, business_name, business_address, country, CAST(regexp_extract(entity_id, '^S(\\d+)-', 1) AS BIGINT) AS src FROM (SELECT entity_id, business_name, business_address, country FROM rec UNION ALL {_values(AWKWARD, 'entity_id, business_name, business_address, country')})"),
    "tsv_tolerant": "SELECT * FROM (VALUES ('S1-1', 'S2-1', 0.5::DOUBLE), ('S1-3', 'S3-1', 1.0::DOUBLE)) AS v(source1_entity_id, candidate_entity_id, score)",
    "tsv_scores": _with(_V1, "SELECT s1_id AS source1_entity_id, cand_id AS candidate_entity_id, score FROM scored"),
    "parquet_round_trip": _with({}, f"SELECT s1_id, cand_id FROM f2 UNION ALL {EXACT}"),
    "lists_round_trip": _with({}, "SELECT s1_id, coalesce(cand_id, '') AS cand_id FROM spine LEFT JOIN f2 USING (s1_id)"),
    "catalog": "SELECT * FROM (VALUES ('columns', 'source1_entity_id,matched_entity_ids'), ('list', 'matched_entity_ids'), ('list of candidates', 'candidate_entity_ids'), ('no list', 'refused'), ('no spine', 'refused'), ('written table exists', 'true'), ('other path exists', 'false'), ('other table exists', 'false')) AS v(item, value)",
    "error_report": _with(_BASIC_PRED, "SELECT * FROM buckets"),
    "sweep_tsv": _with(_V1, _SWEEP),
    "pilot_edges": _with(_V1, "SELECT s1_id, cand_id FROM edges WHERE s1_id IN (SELECT s1_id FROM spine ORDER BY s1_id LIMIT 100)"),
    "gbt_expression": _with(_ALL_EDGES, "SELECT s1_id, cand_id, true AS same, true AS same_after_load, true AS probability FROM rows"),
    "pair_features": _with(
        _V1 | _LCS | {
            "texts": "SELECT a.name AS x, b.name AS y FROM edges JOIN canon a ON a.entity_id = s1_id JOIN canon b ON b.entity_id = cand_id UNION SELECT a.address, b.address FROM edges JOIN canon a ON a.entity_id = s1_id JOIN canon b ON b.entity_id = cand_id",
            "canonl": f"SELECT *, trim(core_) AS core, list_distinct({_list('name')}) AS nt, list_distinct({_list('address')}) AS at FROM canon",
            "ratios": f"SELECT s1_id, cand_id, {_ratio('name', 's')} AS name_ratio, {_ratio('address', 't')} AS address_ratio FROM edges JOIN canon a ON a.entity_id = s1_id JOIN canon b ON b.entity_id = cand_id LEFT JOIN sim s ON s.x = a.name AND s.y = b.name LEFT JOIN sim t ON t.x = a.address AND t.y = b.address",
        },
        f"SELECT s1_id, cand_id, {_eq('name')} AS name_exact, {_eq('core')} AS name_core_exact, {_jaccard('a.nt', 'b.nt')} AS name_jaccard, {_overlap('a.nt', 'b.nt')} AS name_overlap, name_ratio, {_eq('address')} AS address_exact, {_jaccard('a.at', 'b.at')} AS address_jaccard, {_overlap('a.at', 'b.at')} AS address_overlap, address_ratio, {_eq('number')} AS address_number_equal, {_eq('country')} AS country_equal, (name_ratio + address_ratio) / 2 AS name_address_mean, least(name_ratio, address_ratio) AS name_address_min FROM ratios JOIN canonl a ON a.entity_id = s1_id JOIN canonl b ON b.entity_id = cand_id",
        True,
    ),
}
