"""Clauses and rule detectors over bills: the documents, four phrases put before each, dealt to bills by id; claims from the lines,
committee reports from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import clauses as C
from ledgerline.plans.registry import query, table

PHRASES = [
    "Vaikutuksia ei voida arvioida luotettavasti", "Kustannuksia ei ole arvioitu", "Arvioon liittyy suuria epävarmuuksia", "Mittaluokkaa ei ole mahdollista arvioida", "Asiasta säädetään erikseen",
    "Tarkempia säännöksiä annetaan", "Jatkovalmistelussa selvitetään erikseen", "Arvio on suuntaa-antava", "Arviolta noin 300 henkilöä", "Uudistuksella pyritään kasvuun", "Tavoitteena on mahdollisuuksien mukaan",
    "Laskelma on staattinen", "Riskinä on, että tavoite ei toteudu", "Köyhyysriski ei muutu", "Ei aiheuta lisäkustannuksia", "Tietojärjestelmä ja rekisteri muuttuvat", "SISU-mallilla laskettu mikrosimulointi",
    "Vuoden 2005 aineisto on riittävä", "Laskelma perustuu vuoden 2010", "Määrää ei ole muutettu vuoden 1998 jälkeen", "Raja on pysynyt vuoden 2001 tasolla", "Päästö on pysynyt vuoden 1990 tasolla",
    "Henkilöstön vähimmäismäärä on vähintään 3 hoitajaa", "Kuntien säästöpaine kasvaa", "Mitoituksen katto", "Komissio on todennut esteen", "Sopimuksen mukaisesti ja direktiivin edellyttämä", "Oikeudellinen arvio puuttuu",
    "Asumistuki pienenee", "Makeisvero nousee", "Työllisyys muuttuu vaihteluväli -700–+3 200 henkilöä", "Menot -50–20 euroa", "Katso https://x.fi/-700–+3 200", "Terveys paranee", "RIIPPUU OLENNAISESTI", "Ei tarvetta", "Potilas maksaa",
]
COMMITTEES = ["Sosiaali- ja terveysvaliokunta", "Valtiovarainvaliokunta"]
#: Documents of a bill.
PER = 16


def _texts(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    phrases = F.array(*map(F.lit, PHRASES))
    some = [F.get(phrases, ((F.col("doc_id") * 5 + 11 * j) % len(PHRASES)).cast("int")) for j in range(4)]
    part = F.when(F.col("doc_id") % 5 == 4, "PROPOSED").otherwise("IMPACT")
    return docs.select("doc_id", F.floor(F.col("doc_id") / PER).alias("bill"), part.alias("part"), F.concat_ws(". ", *some, "text").alias("text"))


def _rx(pattern: str, flags: str = "(?i)") -> str:
    return "'" + flags + pattern.replace(r"\w", r"[\pL\pN_]").replace("'", "''") + "'"


_PHRASES = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_TEXTS = f"""t AS (SELECT doc_id, doc_id // {PER} AS bill, CASE WHEN doc_id % 5 = 4 THEN 'PROPOSED' ELSE 'IMPACT' END AS part,
 {" || '. ' || ".join(f"{_PHRASES}[(doc_id * 5 + {11 * j}) % {len(PHRASES)} + 1]" for j in range(4))} || '. ' || text AS text FROM documents WHERE text IS NOT NULL)"""


def _spots(pattern: str) -> str:
    gaps, hits = f"regexp_split_to_array(text, {pattern})", f"regexp_extract_all(text, {pattern})"
    before = f"list_sum(list_transform({gaps}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[1:i], lambda x: length(x))), 0)"
    return f"list_transform(range(len({hits})), lambda i: {{'place': {before}, 'hit': {hits}[i + 1]}})"


_ANY = "'(?i)" + "|".join(f"(?:{p})" for *_, p in C.CLAUSES).replace(r"\w", r"[\pL\pN_]") + "'"
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(x.hit, {_rx(p)}) THEN ['{c}', '{s}']" for (c, s), p in C.RUNS) + " END"


@query(f"""WITH {_TEXTS}, h AS (SELECT doc_id, text, unnest({_spots(_ANY)}) AS x FROM t WHERE regexp_matches(text, {_ANY})), k AS (SELECT *, {_KIND} AS kind, greatest(x.place - 60, 0) AS first FROM h)
SELECT doc_id, CAST(x.place AS BIGINT) AS place, kind[1] AS category, kind[2] AS subtype, x.hit AS said, trim(replace(substr(text, CAST(first + 1 AS BIGINT), CAST(x.place + length(x.hit) + 60 - first AS BIGINT)), chr(10), ' '), ' ') AS context FROM k""")
def clause_scan(spark, d):
    """Every clause that admits, defers or hedges, with its place, kind and surroundings."""
    return C.clauses(_texts(spark, d), id_col="doc_id", text_col="text").withColumnRenamed("at", "place")


def _count(*patterns: str, flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(text, {_rx(p, flags)}))" for p in patterns) + ")"


def _terms(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"((length(low) - length(replace(low, '{t}', ''))) // {len(t)})" for t in terms) + ")"


def _named(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in terms) + ")"


def _near(reach: int) -> str:
    return f"substr(text, CAST(greatest(x.place - {reach}, 0) + 1 AS BIGINT), CAST(x.place + length(x.hit) + {reach} - greatest(x.place - {reach}, 0) AS BIGINT))"


def _numbered(said: str) -> str:
    return f"TRY_CAST(replace(ltrim(regexp_replace({said}, '[\\s\\x{{A0}}]', '', 'g'), '+'), ',', '.') AS DOUBLE)"


_PICK = lambda a, b: f"coalesce(nullif(regexp_extract(x.hit, {_rx(C.RANGE)}, {a}), ''), regexp_extract(x.hit, {_rx(C.RANGE)}, {b}))"
_YEARS = lambda ys: f"list_transform(list_filter(list_concat({ys}), lambda y: y <> ''), lambda y: CAST(y AS INT))"
_STALE = _YEARS(", ".join(f"regexp_extract_all(text, {_rx(p)}, 1)" for p in C.STALE))
_FROZEN = _YEARS(", ".join(f"list_transform(list_filter({_spots(_rx(p))}, lambda x: NOT regexp_matches({_near(100)}, {_rx(C.CLIMATE)})), lambda x: regexp_extract(x.hit, {_rx(p)}, 1))" for p in C.FROZEN))
_CROSS = f"len(list_filter({_spots(_rx(C.RANGE))}, lambda x: coalesce({_numbered(_PICK(1, 3))} < 0 AND {_numbered(_PICK(2, 4))} > 0, false) AND NOT regexp_matches({_near(150)}, {_rx(C.ADDRESS)}) AND regexp_matches({_near(150)}, {_rx(C.ESTIMATE)})))"
_OF = lambda kind: f"len(list_filter(hits, lambda h: {'NOT ' + _FULL(0) + ' AND ' if kind else ''}{'NOT ' + _FULL(1) + ' AND ' if kind == 2 else ''}{_FULL(kind)}))"
_FULL = lambda kind: f"regexp_full_match(h, {_rx('|'.join(p for k, _, p in C.CLAUSES if k == ('confession', 'deferral', 'escape')[kind]))})"
_PROFILE = f"""{_TEXTS}, u AS (SELECT *, lower(text) AS low, part = 'IMPACT' AS i, 2008 + bill % 17 AS year, CASE WHEN part = 'IMPACT' THEN regexp_extract_all(text, {_ANY}) ELSE [] END AS hits FROM t),
a AS (SELECT bill, i, year, {_OF(0)} AS confession, {_OF(1)} AS deferral, {_OF(2)} AS escape, CASE WHEN i THEN length(text) END AS chars, CASE WHEN i THEN {_terms(C.FAILURE)} + greatest({_terms(("riski",))} - {_terms(C.BASELINE)}, 0) END AS failure,
 CASE WHEN i THEN {_named(C.STATIC)} END AS static, CASE WHEN i THEN {_named(C.NO_COST)} END AS no_cost, {_terms(C.SYSTEMS)} AS systems, CASE WHEN i THEN {_count(*C.MODELS, flags="")} + {_count(*C.METHODS)} END AS models, {_count(*C.FLOOR)} AS floor,
 CASE WHEN i THEN {_count(*C.PRESSURE)} END AS pressure, i AND regexp_matches(text, {_rx(C.CEILING)}) AS ceiling, CASE WHEN i THEN {_count(*C.MANDATORY)} END AS mandatory, i AND regexp_matches(text, {_rx(C.DOUBT)}) AS doubt, i AND regexp_matches(text, {_rx(C.HEALTH)}) AS health,
 i AND regexp_matches(text, {_rx(C.LOAD_BEARING)}) AS bearing, CASE WHEN i THEN list_filter({_STALE}, lambda y: year - y >= 2) END AS stale, CASE WHEN i THEN list_filter({_FROZEN}, lambda y: year - y >= 5) END AS frozen, CASE WHEN i THEN {_CROSS} END AS crossing,
 {", ".join(f"i AND regexp_matches(text, {_rx(p)}) AS domain{k}" for k, (p, _) in enumerate(C.DOMAINS))} FROM u),
b AS (SELECT bill, count(*) FILTER (i) AS n_impact, {", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in "confession deferral escape chars failure static no_cost systems models floor pressure mandatory crossing".split())},
 {", ".join(f"bool_or({c}) AS {c}" for c in ("ceiling", "doubt", "health", "domain0", "domain1", "domain2", "domain3"))}, bool_or(coalesce(bearing AND len(stale) > 0, false)) AS bearing,
 coalesce(sum(len(stale)), 0) AS stale, coalesce(max(year - list_min(stale)), 0) AS stale_gap, coalesce(sum(len(frozen)), 0) AS frozen, coalesce(max(year - list_min(frozen)), 0) AS frozen_gap FROM a GROUP BY 1),
m AS (SELECT l_orderkey % 2000 AS bill, count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 3) AS fiscal, count(*) FILTER (l_returnflag = 'A') AS behavioral, coalesce(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber <> 3 THEN l_extendedprice * (l_orderkey % 7) * 100 END), 0) AS total FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS bill, CASE WHEN o_orderkey % 2 = 0 THEN '{COMMITTEES[0]}' ELSE '{COMMITTEES[1]}' END AS committee, o_orderkey % 10 / 10.0 AS ignored, o_orderkey % 7 AS delegations FROM orders WHERE o_orderkey % 3 <> 0),
x AS (SELECT b.*, coalesce(fiscal, 0) AS fiscal, coalesce(behavioral, 0) AS behavioral, coalesce(total, 0) AS total, committee, ignored, coalesce(delegations, 0) AS delegations FROM b LEFT JOIN m USING (bill) LEFT JOIN r USING (bill) WHERE n_impact > 0)"""
_RULES = {
    "sign_cross": ("crossing > 0", "crossing >= 2", "true"),
    "confession_proceed": ("confession >= 3 AND fiscal >= 2", "confession >= 8 AND fiscal >= 5", "confession >= 5"),
    "zero_failure": ("chars >= 30000 AND failure / (chars / 10000) <= 1.5", "chars >= 80000 AND failure <= 2", "chars >= 50000 AND failure / (chars / 10000) <= 0.5"),
    "static_fiscal": ("static > 0 AND fiscal >= 1", "fiscal >= 5 AND behavioral >= 5", "fiscal >= 3"),
    "impl_zero": ("no_cost > 0 AND delegations + systems >= 3", "delegations >= 5 AND systems >= 3", "delegations + systems >= 5"),
    "epistemic_buffer": ("confession >= 2 AND deferral + escape >= 2 AND fiscal >= 2 AND total >= 1e6", "confession + deferral + escape >= 15 AND total >= 1e9", "confession + deferral + escape >= 8 AND total >= 1e8"),
    "stale_data": ("stale > 0", "bearing OR stale_gap >= 4 OR stale >= 3", "stale_gap >= 3 OR stale >= 2"),
    "frozen_parameter": ("frozen > 0", "frozen_gap >= 15 OR frozen >= 3", "frozen_gap >= 10 OR frozen >= 2"),
    "minimum_becomes_maximum": ("chars >= 15000 AND NOT ceiling AND floor > 0 AND pressure > 0", "floor >= 3 AND pressure >= 3", "floor >= 2 OR pressure >= 2"),
    "juridical_shield": ("mandatory >= 2 AND (total >= 1e7 OR health)", "mandatory >= 4 AND total >= 1e8 AND NOT doubt", "mandatory >= 3 AND NOT doubt"),
    "domain_committee_mismatch": (" OR ".join(f"(domain{k} AND committee <> '{c}')" for k, (_, c) in enumerate(C.DOMAINS)), "ignored >= 0.7", "true"),
    "model_void": ("total >= 1e7 AND fiscal >= 2 AND models = 0", "total >= 1e9", "total >= 1e8"),
}


@query(f"WITH {_PROFILE} " + " UNION ALL ".join(f"SELECT bill, '{name}' AS detector, CASE WHEN {high} THEN 3 WHEN {medium} THEN 2 ELSE 1 END AS severity FROM x WHERE {holds}" for name, (holds, high, medium) in _RULES.items()))
def bill_detectors(spark, d):
    """The twelve rule detectors on all bills."""
    texts = _texts(spark, d)
    lines = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "FISCAL").when(F.col("l_returnflag") == "A", "BEHAVIORAL").otherwise("OTHER")
    euros = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * (F.col("l_orderkey") % 7) * 100)
    claims = lines.select((F.col("l_orderkey") % 2000).alias("bill"), kind.alias("kind"), euros.alias("euros"))
    k = F.col("o_orderkey")
    reports = table(spark, d, "orders").filter(k % 3 != 0).select(k.alias("bill"), F.when(k % 2 == 0, COMMITTEES[0]).otherwise(COMMITTEES[1]).alias("committee"), (k % 10 / 10).alias("ignored"), (k % 7).alias("delegations"))
    years = texts.select("bill").distinct().withColumn("year", 2008 + F.col("bill") % 17)
    return C.detected(C.profile(texts, years), claims, reports)
