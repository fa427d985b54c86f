"""SQL statements of the lenses and small helpers for stating expected results in SQL."""

from __future__ import annotations

from twinsift import fixed_values as fv

SPACE = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def quoted(value) -> str:
    if value is None or value == "":
        return "NULL"
    if isinstance(value, (int, float)):
        return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def strip_tail(x: str) -> str:
    return strip(rf"regexp_replace(coalesce({x}, ''), '[. ]+\z', '')")


def lower_first(x: str) -> str:
    return f"(lower(substr({x}, 1, 1)) || substr({x}, 2))"


def upper_first(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def slug(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '-', 'g'), '\A-+|-+\z', '', 'g')"


def pair_id(crop: str, a: str, b: str) -> str:
    return f"{slug(crop)} || '__' || {slug(f'least({a}, {b})')} || '__' || {slug(f'greatest({a}, {b})')}"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def half(x: str, side: str) -> str:
    """First or second half of a text."""
    middle = f"(length({x}) + 1) // 2"
    return f"substr({x}, 1, {middle})" if side == "a" else f"substr({x}, {middle} + 1)"


def first_rule(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN contains(lower(coalesce({x}, '')), {quoted(h)}) THEN {quoted(v)}"
                     for h, v in rules)
    return f"CASE {whens} ELSE {quoted(default)} END"


def head_sign(x: str, source: str) -> str:
    """Query giving `src.*` and `sign` from column expression `x` of relation `source`."""
    whole = strip(f"coalesce({x}, '')")
    clause = rf"regexp_extract({whole}, '(?s)\A[^;.]*')"
    return rf"""
    SELECT *, {lower_first('s5')} AS sign FROM (SELECT *, CASE WHEN contains(s4, ',')
      AND length(split_part(s4, ',', 1)) >= 20 THEN split_part(s4, ',', 1) ELSE s4 END AS s5
    FROM (SELECT *, regexp_replace({strip('s3')}, '\A,+|,+\z', '', 'g') AS s4
    FROM (SELECT *, regexp_replace(s2,
      '(?i)\A(?:look|check|examine|inspect|search)\b[^\n]*?\bfor\b\s+([^\n]*)\z', '\1') AS s3
    FROM (SELECT *, regexp_replace(s1, '(?i)\Aflip\s+the\s+lea\w+\s+over[, ]*(and\s+)?', '') AS s2
    FROM (SELECT *, CASE WHEN contains(s0, ':') THEN {strip(r"regexp_replace(s0, '(?s)\A[^:]*:', '')")}
      ELSE s0 END AS s1
    FROM (SELECT *, {strip(clause)} AS s0
    FROM {source}))))))"""


def array_of(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


CROPS = array_of(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
PARTS = array_of(("leaf", "stem", "root", "fruit", "flower", "pod", "seed", "whole_plant"))
AXES = array_of(fv.FORK_AXES)

US_STATES = values(
    "us_states", "name, state_key, fips, usps, state_lat, state_lon, division, region",
    [(r[0], r[0].lower(), *r[1:], fv.CENSUS_REGIONS.get(r[5])) for r in fv.US_STATES])

V_ROWS = """v_rows AS (
  SELECT p_partkey AS row_id, CAST(p_partkey AS VARCHAR) AS img,
    'images/' || p_type || '/' || replace(p_brand, '#', '_') || '/s' || (p_partkey % 17) || '_'
      || p_partkey || '.jpg' AS url,
    'source ' || (p_partkey % 17) AS cite, coalesce(s.name, '') AS state, p_type AS crop,
    p_brand AS disease, p_type AS host_common,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || CASE p_size % 7 WHEN 0 THEN ' virus'
      WHEN 1 THEN ' phytoplasma' WHEN 2 THEN ' xanthomonas' WHEN 3 THEN ' cyst'
      WHEN 4 THEN ' bacterial' ELSE '' END END AS path_sci,
    p_name AS path_common, split_part(p_name, ' ', 2) AS descriptor,
    CAST(p_partkey % 17 AS VARCHAR) AS contributor
  FROM part LEFT JOIN us_states s ON s.fips = p_size)"""

V_EMB = """v_emb AS (
  SELECT CASE WHEN label < 5 THEN 'ECONOMY' ELSE 'LARGE' END AS crop,
    'Brand#' || (label + 1) AS disease, 'organ' || (vec_id % 3) AS bucket,
    CAST(vec_id AS VARCHAR) AS img, CAST(embedding AS DOUBLE[]) AS embedding, vec_id
  FROM embeddings)"""

V_EVID = f"""v_evid AS (
  SELECT {pair_id('crop', 'a', 'b')} AS pair_id, crop, least(a, b) AS member_a,
    greatest(a, b) AS member_b, ts, event_id, event_type, event_id % 3 <> 0 AS documented,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS quote, host || event_id AS source_url,
    ['extension','university','peer_reviewed','gov','other'][event_id % 5 + 1] AS source_type
  FROM (SELECT *, {CROPS}[user_id % 6 + 1] AS crop, 'Brand#' || (1 + event_id % 25) AS a,
      'Brand#' || (1 + (event_id // 25 + user_id) % 25) AS b,
      ['https://extension.example.edu/','https://www.example.edu/','https://doi.org/',
       'https://www.example.gov/','https://blog.example.com/'][event_id % 5 + 1] AS host
    FROM events) WHERE a <> b)"""

V_STORE = """v_store AS (
  SELECT *, documented AND quote <> '' AND source_type <> 'other' AS verified
  FROM v_evid QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, event_id DESC) = 1)"""

V_GRAPH = f"""v_graph AS (
  SELECT {pair_id('crop', 'a', 'b')} AS pair_id, crop, least(a, b) AS member_a,
    greatest(a, b) AS member_b, conv_id, turn,
    CASE WHEN role = 'system' THEN 'gold' ELSE 'generated' END AS source,
    conv_id * 100 + turn AS seq, conv_id % 13 <> 0 AS confusable,
    CASE WHEN conv_id % 19 = 3 THEN ' ' ELSE role END AS confusable_reason,
    string_split(text, chr(10)) AS lines,
    least(a, b) || ': ' || text AS management_a,
    CASE WHEN conv_id % 17 <> 5 THEN text END AS management_b,
    turn % 5 <> 4 AS has_lay,
    'Look closely for ' || text AS farmer_lay_report,
    'Look at the leaf: ' || text AS decisive_lay_a,
    'Check the stem for ' || text AS decisive_lay_b
  FROM (SELECT *, {CROPS}[conv_id % 6 + 1] AS crop, 'Brand#' || (1 + (conv_id * 7 + turn) % 25) AS a,
      'Brand#' || (1 + (conv_id + turn * 3) % 25) AS b FROM conversations) WHERE a <> b)"""

V_GSTORE = """v_gstore AS (
  SELECT * FROM v_graph QUALIFY row_number() OVER (PARTITION BY pair_id
    ORDER BY CASE source WHEN 'generated' THEN 0 ELSE 1 END, seq DESC) = 1)"""

# Problems of each stored graph, in checking order, and its decisive signs.
V_GERR = rf"""v_gerr AS (
  SELECT *, CASE WHEN management_b IS NULL THEN ['missing key: management_b'] ELSE
    list_filter(list_concat(
      [CASE WHEN confusable_reason = ' ' THEN 'confusable_reason empty' END,
       CASE WHEN len(lines) NOT BETWEEN 3 AND 7 THEN 'forks must be a list of 3..7 items' END],
      CASE WHEN len(lines) BETWEEN 3 AND 7 THEN flatten(list_transform(range(len(lines)), lambda i: [
        CASE WHEN conv_id % 11 = 0 AND i = 0 THEN 'fork[0].axis invalid: ''colour''' END,
        CASE WHEN {strip('lines[i + 1]')} = '' THEN 'fork[' || i || '].question empty' END,
        CASE WHEN {strip(half('lines[i + 1]', 'a'))} = '' THEN 'fork[' || i || '].a_signal empty' END,
        CASE WHEN {strip(half('lines[i + 1]', 'b'))} = '' THEN 'fork[' || i || '].b_signal empty' END]))
        ELSE [] END,
      [CASE WHEN confusable AND len(lines) NOT BETWEEN 3 AND 7
        THEN 'need exactly 1 decisive fork, found 0' END]), lambda e: e IS NOT NULL) END AS errors,
    {half('lines[2]', 'a')} AS sign_a, {half('lines[2]', 'b')} AS sign_b
  FROM v_gstore)"""

V_LABEL = f"""v_label AS (
  SELECT CAST(doc_id AS VARCHAR) AS img, {PARTS}[doc_id % 8 + 1] AS anatomical_part,
    quality = 1 AS is_closeup, toxic = 0 AS decisive_sign_visible, text AS lay_observation
  FROM documents JOIN labels USING (doc_id))"""

V_REPORT = f"""v_report AS (
  SELECT *, CASE crop WHEN 'STANDARD' THEN 'INVALID' WHEN 'SMALL'
    THEN 'MISSPELLED_OR_UNSTANDARDISED' ELSE 'VALID' END AS crop_verdict
  FROM (SELECT {CROPS}[(doc_id // 25) % 6 + 1] AS crop, 'Brand#' || (1 + doc_id % 25) AS disease,
    CASE WHEN toxic = 1 AND quality = 0 THEN 'INCORRECT' WHEN toxic = 1 OR quality = 0 THEN 'QUESTIONABLE'
      ELSE 'CORRECT' END
      AS verdict FROM documents JOIN labels USING (doc_id)))"""

# Gate status per image row; renamed rows carry the canonical crop name.
V_GATED = """v_bad AS (SELECT DISTINCT crop FROM v_report WHERE crop_verdict = 'INVALID'),
v_ren AS (SELECT DISTINCT crop FROM v_report WHERE crop_verdict LIKE 'MISS%'),
v_wrong AS (SELECT crop, disease, bool_or(verdict = 'INCORRECT') AS incorrect,
    bool_or(verdict = 'QUESTIONABLE') AS questionable
  FROM v_report WHERE crop_verdict <> 'INVALID' GROUP BY ALL),
v_gated AS (
  SELECT r.* REPLACE (CASE WHEN v_ren.crop IS NOT NULL AND NOT coalesce(incorrect, false)
      THEN 'Small grain' ELSE r.crop END AS crop),
    CASE WHEN v_bad.crop IS NOT NULL THEN 'bad_crop' WHEN incorrect THEN 'incorrect_disease'
      WHEN v_ren.crop IS NOT NULL THEN 'renamed' ELSE 'kept' END AS gate_status,
    coalesce(questionable, false) AS questionable
  FROM v_rows r LEFT JOIN v_bad ON v_bad.crop = r.crop LEFT JOIN v_ren ON v_ren.crop = r.crop
  LEFT JOIN v_wrong w ON w.crop = r.crop AND w.disease = r.disease)"""

V_GEO = """v_geo AS (
  SELECT o_orderkey AS row_id, o_orderdate, n_name, r_name, o_orderkey % 100 = 0 AS has_point,
    (o_orderkey * 37 % 1800) / 10 - 90 AS plat, (o_orderkey * 91 % 3600) / 10 - 180 AS plon,
    n_nationkey, s.name AS state_name, s.usps, s.state_lat, s.state_lon,
    CASE WHEN o_orderkey % 7 = 0 THEN r_name || ', ' || n_name
      WHEN o_orderkey % 3 = 0 THEN 'United States, ' || coalesce(s.name, 'Elsewhere')
      ELSE 'United States, ' || coalesce(s.name, 'Elsewhere') || ', ' || n_name || ' County' END AS location
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN us_states s ON s.fips = n_nationkey + 1)"""

V_POINTS = """v_points AS (
  SELECT c_custkey AS row_id, (c_custkey * 37 % 1800) / 10 - 90 AS lat,
    (c_custkey * 91 % 3600) / 10 - 180 AS lon FROM customer)"""

V_CELLS = """v_cells AS (
  SELECT 'bio' || (1 + p_partkey // 648 % 3) AS layer, p_partkey % 18 AS row,
    p_partkey // 18 % 36 AS col,
    CASE p_size WHEN 1 THEN -9999.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE p_retailprice END AS value
  FROM part QUALIFY row_number() OVER (PARTITION BY 1 + p_partkey // 648 % 3, p_partkey % 18,
    p_partkey // 18 % 36 ORDER BY p_partkey DESC) = 1)"""

_bands = fv.ZONE_BANDS


def zone(lat: str, lon: str, attribute: int) -> str:
    whens = " ".join(f"WHEN {lat} >= {b[0]} AND {lat} < {b[1]} AND {lon} >= -180 AND {lon} < 180 "
                     f"THEN '{b[attribute]}'" for b in _bands)
    return f"CASE {whens} END"


PATHOGEN = first_rule(
    "first_name", [(h, c) for c, hs in fv.PATHOGEN_RULES for h in hs], fv.PATHOGEN_DEFAULT)

V_CLASS = f"""v_class AS (
  SELECT crop, disease, count(*) AS n_imgs, list(DISTINCT descriptor) AS descriptors,
    list(DISTINCT state) AS states, {PATHOGEN.replace('first_name', "arg_min(CASE WHEN path_sci <> '' THEN path_sci ELSE path_common END, row_id)")} AS pathogen_class
  FROM v_rows GROUP BY crop, disease HAVING count(*) >= 12)"""

V_PAIRS = f"""v_pairs AS (
  SELECT {pair_id('a.crop', 'a.disease', 'b.disease')} AS pair_id, a.crop, a.disease AS member_a,
    b.disease AS member_b, a.n_imgs AS n_imgs_a, b.n_imgs AS n_imgs_b,
    a.pathogen_class AS class_a, b.pathogen_class AS class_b,
    list_sort(list_intersect(a.descriptors, b.descriptors)) AS shared_descriptors,
    a.pathogen_class = b.pathogen_class AS same_pathogen_class,
    list_sort(list_intersect(a.states, b.states)) AS shared_states,
    CAST(round(len(list_intersect(a.descriptors, b.descriptors))
      + CASE WHEN a.pathogen_class = b.pathogen_class THEN 2 ELSE 0 END
      + len(list_intersect(a.states, b.states)) / 10, 3) AS DOUBLE) AS lookalike_prior
  FROM v_class a JOIN v_class b ON a.crop = b.crop AND a.disease < b.disease)"""

# Similarity of images within a (crop, bucket), and best per class.
V_NN = """v_nn AS (
  SELECT i.crop, i.bucket, i.img, i.disease, j.disease AS other,
    max(CASE WHEN i.img = j.img THEN -1.0::DOUBLE
      ELSE round(list_dot_product(i.embedding, j.embedding), 9) END) AS best
  FROM v_emb i JOIN v_emb j ON i.crop = j.crop AND i.bucket = j.bucket GROUP BY ALL),
v_dir AS (
  SELECT x.crop, x.bucket, least(x.disease, x.other) AS member_a,
    greatest(x.disease, x.other) AS member_b,
    count(*) FILTER (x.disease < x.other) AS n_a, count(*) FILTER (x.disease > x.other) AS n_b,
    count(*) FILTER (x.disease < x.other AND x.best > o.best) AS hits_ab,
    count(*) FILTER (x.disease > x.other AND x.best >= o.best) AS hits_ba
  FROM v_nn x JOIN v_nn o ON o.crop = x.crop AND o.bucket = x.bucket AND o.img = x.img
    AND o.other = o.disease WHERE x.disease <> x.other GROUP BY ALL),
v_epairs AS (
  SELECT DISTINCT a.crop, a.disease AS member_a, b.disease AS member_b FROM v_emb a
  JOIN v_emb b ON a.crop = b.crop AND a.disease < b.disease),
v_match AS (
  SELECT crop, member_a, member_b,
    sum(least(n_a, n_b) * (hits_ab / n_a)) / sum(least(n_a, n_b)) AS ab,
    sum(least(n_a, n_b) * (hits_ba / n_b)) / sum(least(n_a, n_b)) AS ba,
    sum(least(n_a, n_b) * ((hits_ab + hits_ba) / (n_a + n_b))) / sum(least(n_a, n_b)) AS pooled,
    CAST(sum(least(n_a, n_b)) AS BIGINT) AS support, list_sort(list(DISTINCT bucket)) AS buckets
  FROM v_dir WHERE n_a >= 4 AND n_b >= 4 GROUP BY ALL)"""

V_SCORES = f"""v_scores AS (
  SELECT {pair_id('p.crop', 'p.member_a', 'p.member_b')} AS pair_id, p.crop, p.member_a,
    p.member_b, coalesce(support >= 5, false) AS ok, round(least(ab, ba), 4) AS matched_cross_knn,
    support AS matched_support
  FROM v_epairs p LEFT JOIN v_match m USING (crop, member_a, member_b))"""

PERSONAS = """personas AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, personality FROM (
  SELECT DISTINCT personality || '.' || v AS id, personality
  FROM unnest(['plain','overanxious','distrustful','talkative','reticent','impatient']) p(personality),
    unnest(['C1.high.none','B1.high.none','A2.high.none','C1.medium.none','C1.low.none',
            'C1.high.mild','C1.high.high']) q(v)) QUALIFY position < 37)"""

_LENSES = {
    "us_states": (US_STATES, ()), "v_rows": (V_ROWS, ("us_states",)), "v_emb": (V_EMB, ()),
    "v_evid": (V_EVID, ()), "v_store": (V_STORE, ("v_evid",)), "v_graph": (V_GRAPH, ()),
    "v_gstore": (V_GSTORE, ("v_graph",)), "v_gerr": (V_GERR, ("v_gstore",)),
    "v_label": (V_LABEL, ()), "v_report": (V_REPORT, ()),
    "v_gated": (V_GATED, ("v_rows", "v_report")), "v_geo": (V_GEO, ("us_states",)),
    "v_points": (V_POINTS, ()), "v_cells": (V_CELLS, ()), "v_class": (V_CLASS, ("v_rows",)),
    "v_pairs": (V_PAIRS, ("v_class",)), "v_nn": (V_NN, ("v_emb",)),
    "v_scores": (V_SCORES, ("v_nn",)), "personas": (PERSONAS, ()),
}


def add_lens(name: str, text: str, needs: tuple[str, ...]) -> None:
    _LENSES[name] = (text, needs)


def with_lenses(names: str, body: str) -> str:
    """`body` after the named lenses and everything they build on."""
    done: list[str] = []

    def visit(name: str) -> None:
        text, needs = _LENSES[name]
        for n in needs:
            visit(n)
        if text not in done:
            done.append(text)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(done) + "\n" + body
