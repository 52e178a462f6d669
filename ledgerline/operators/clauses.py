"""Clauses of impact assessments that admit, defer or hedge, and rule detectors over bills.

All patterns go over a text in the JVM. The clause patterns are one alternation, so at a place the first that matches wins and
matches don't overlap; at a place only those are tried that can begin with the two letters that stand there. Which pattern a hit
belongs to is told from the hit alone: an earlier one that could match it would have won. The detectors share one profile:
each text is counted once for all vocabularies, counts are summed by bill, joined with the bill's claims, and every detector is an
expression over that row."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T

# The clause patterns with category and subtype, in the order in which they are tried.
CLAUSES = [
    ("confession", "impossibility", r"ei\s+voida\s+arvioida"),
    ("confession", "impossibility", r"ei\s+ole\s+mahdollista\s+arvioida"),
    ("confession", "impossibility", r"ei\s+pystytä\s+arvioimaan"),
    ("confession", "impossibility", r"mahdoton\s+arvioida"),
    ("confession", "impossibility", r"(?:on\s+)?(?:hyvin\s+)?vaikea\s+arvioida"),
    ("confession", "impossibility", r"(?:on\s+)?haastavaa?\s+erott(?:aa|ella)"),
    ("confession", "impossibility", r"ei\s+voida\s+pitää\s+luotettavana"),
    ("confession", "impossibility", r"ei\s+voida\s+luotettavasti"),
    ("confession", "impossibility", r"ei\s+ole\s+kaikilta\s+osin\s+ennakoida"),
    ("confession", "impossibility", r"mittaluokkaa\s+ei\s+ole\s+mahdollista"),
    ("confession", "uncertainty", r"sisältyy\s+(?:merkittävää\s+)?epävarmuutta"),
    ("confession", "uncertainty", r"liittyy\s+(?:merkittäviä|suuria|huomattavia)\s+epävarmuuksia"),
    ("confession", "uncertainty", r"liittyy\s+merkittävää\s+epävarmuutta"),
    ("confession", "uncertainty", r"arvio\s+on\s+epävarma"),
    ("confession", "uncertainty", r"arvion\s+luotettavuus"),
    ("confession", "uncertainty", r"arviointi\s+on\s+puutteellinen"),
    ("confession", "dependency", r"riippuvaisi?a?\s+.{0,30}päätöksist"),
    ("confession", "dependency", r"riippuu\s+.{0,20}tekemättömistä"),
    ("confession", "dependency", r"riippuu\s+olennaisesti"),
    ("confession", "unassessed", r"ei\s+ole\s+arvioitu(?:\s+aineistoperusteisesti)?"),
    ("confession", "unassessed", r"ei\s+ole\s+pystytty\s+arvioimaan"),
    ("confession", "unassessed", r"ei\s+ole\s+pystytty\s+(?:välttämättä\s+)?(?:vielä\s+)?tunnistamaan"),
    ("confession", "unassessed", r"ei\s+ole\s+huomioitu"),
    ("confession", "unassessed", r"eivät\s+tule\s+täysin\s+huomioiduksi"),
    ("confession", "unassessed", r"ei\s+ole\s+käytettävissä\s+rekisteri"),
    ("confession", "unassessed", r"ei\s+ole\s+riittävästi\s+tietoa"),
    ("confession", "unassessed", r"tarkkaa\s+lukumäärää\s+ei"),
    ("deferral", "separate_regulation", r"säädetään\s+erikseen"),
    ("deferral", "decree", r"tarkemmin\s+.{0,15}asetuksella"),
    ("deferral", "decree", r"tarkennetaan\s+.{0,30}asetuksella"),
    ("deferral", "decree", r"tarkempia\s+(?:säännöksiä|määräyksiä)"),
    ("deferral", "future_assessment", r"arvioidaan\s+erikseen"),
    ("deferral", "future_assessment", r"arvioidaan\s+myöhemmin"),
    ("deferral", "future_assessment", r"selvitetään\s+myöhemmin"),
    ("deferral", "future_assessment", r"selvitetään\s+erikseen"),
    ("deferral", "continued_prep", r"jatkovalmistel\w+"),
    ("deferral", "separate_proposal", r"erillisellä\s+(?:hallituksen\s+)?esityksellä"),
    ("deferral", "update_promise", r"laskelmat\s+päivitetään"),
    ("deferral", "update_promise", r"päivitetään\s+.{0,30}(?:aikana|ennen|vuoden)"),
    ("escape", "disclaimer", r"arvio\s+on\s+suuntaa-antava"),
    ("escape", "disclaimer", r"karkeasti\s+(?:arvioiden|todeten|noin)"),
    ("escape", "disclaimer", r"suuntaa[\s-]antav\w+\s+arvi"),
    ("escape", "approximation", r"(?:arviolta|suuruusluokaltaan)\s+(?:noin\s+)?\d"),
    ("escape", "aspiration", r"(?:esityksellä|uudistuksella|muutoksella)\s+pyritään"),
    ("escape", "aspiration", r"tavoitteena\s+on\b"),
    ("escape", "conditional", r"mahdollisuuksien\s+mukaan"),
    ("escape", "conditional", r"voisi\s+mahdollistaa"),
    ("escape", "conditional", r"vielä\s+tekemättömistä\s+päätöksistä"),
]
# Words and patterns of the detectors.
FAILURE = (
    "epäonnistu", "ei toimi", "epävarmuus", "epävarmuuksia", "epävarmuutta", "herkkyys", "herkkyystarkas", "herkkyysanalyysi", "pessimisti", "worst case", "pahimmillaan", "huonoin",
    "negatiivinen skenaario", "jos uudistus ei", "jos tavoite ei", "jos oletus ei", "ei toteudu", "riskinä on", "riskinä voidaan", "riskinä pidetään",
)
BASELINE = ("köyhyysriski", "syrjäytymisriski", "irtisanomisriski", "terveysriski", "riskitekijä", "riskiarvio", "riskiperustei", "riskiprofiili")
STATIC = (
    "staattisia", "staattinen", "eivät sisällä käyttäytymisvaikutuksia", "ei sisällä käyttäytymisvaikutuksia", "ei huomioitu käyttäytymisvaikutu", "ei ole huomioitu käyttäytymisvaikutu",
    "olettaen ettei käyttäytyminen muutu", "ei ota huomioon käyttäytymisvaikutu",
)
NO_COST = (
    "ei merkittäviä hallinnollis", "ei merkittäviä toimeenpano", "ei merkittäviä tietojärjestelmä", "katetaan nykyisistä", "nykyisten määrärahojen puitteissa", "ei edellytä lisämäärärahoja",
    "voidaan toteuttaa nykyis", "ei aiheuta merkittäviä kustannuksia", "ei aiheuta lisäkustannuksia",
)
SYSTEMS = ("tietojärjestelmä", "rajapinta", "rekisteri", "automaatio", "digitaali", "tietokanta", "integraatio", "sähköinen asiointi", "verkkopalvelu", "tulorekisteri", "kanta-palvelu")
MODELS = (r"\bSISU\b", r"\bJUTTA\b", r"\bHVSR\b", r"\bTUJA\b", r"\bFLEED\b")
METHODS = ("mikrosimuloint", "simulointimall", "herkkyysanalyysi", "herkkyystarkas")
FLOOR = (r"vähimmäismitoitu", r"vähimmäismäärä", r"minimimitoitu", r"vähintään\s+\d+(?:[,\.]\d+)?\s*(?:hoitaja|henkilö|henkilöstö|työntekijä|asiakasta)", r"(?:on|oltava|tulee\s+olla)\s+vähintään\s+\d")
PRESSURE = (
    r"säästöpaine", r"budjettipaine", r"menosopeutus", r"hyvinvointialue.{0,40}säästö|säästö.{0,40}hyvinvointialue", r"kuntien?\s+(?:säästö|leikkau|talousarv)",
    r"rahoituksen\s+(?:väheneminen|leikkaus|supistuminen|tiukentumine)", r"(?:resurssit|voimavarat)\s+(?:niukat|riittämättöm|vähenem)",
)
CEILING = r"(?:vähimmäis|minoitu).{0,60}(?:käytännössä|tosiasiassa).{0,60}(?:enimmäis|katto|maksimi)|katto.{0,30}(?:vähimmäis|minimimitoitu)|mitoituksen\s+katto"
MANDATORY = (
    r"EU(?::n|n)?\s+valtiontukisäännösten?\s+(?:vuoksi|nojalla|perusteella|mukaan)", r"komissio\s+on\s+(?:epävirallisesti\s+)?(?:esittänyt|todennut|ilmoittanut)",
    r"kansainvälisten?\s+velvoitteiden?\s+(?:nojalla|vuoksi|perusteella|mukaan)", r"perustuslakivaliokunta\s+edellytti", r"sopimuksen\s+(?:mukaisesti|nojalla|perusteella)",
    r"direktiivin?\s+(?:edellyttämä|vaatima|mukainen|pakottava)", r"(?:EU|yhteisö)oikeus\w*\s+(?:edellyttää|vaatii|velvoittaa|estää)",
    r"(?:ei\s+ole\s+mahdollista|mahdoton|este)\s+.{0,30}(?:EU|yhteisö|direktiivi|komissio)",
)
DOUBT = r"oikeudellinen\s+arvio|tulkinta\s+on\s+epäselvä|tulkintakysymys|oikeustila\s+on\s+epäselvä"
HEALTH = r"terveys|hyvinvointi|sosiaali|lapsi|vanhus|potilas"
LOAD_BEARING = r"riittävä|riittää|osoittaa|osoittaa\s+että|tukee\s+(?:päätöstä|esitystä|muutosta)|perustuu\s+(?:siihen|tähän)|perusteena\s+on"
STALE = (
    r"vuoden\s+(20\d{2})\s+.{0,30}(?:aineisto|tieto|tilasto|luku|rekisteri|otokse|tutkimu|selvityks|tietokant|kulutustutkimu)", r"perustu\w+\s+(?:vuoden\s+)?(20\d{2})",
    r"\b(20\d{2})\s+(?:aineisto\w*|tieto\w+|tilasto\w+|luku\w+)", r"vuoden\s+(20\d{2})\s+(?:tasossa|hinnoin|hinnoissa|rahassa|arvossa)",
)
FROZEN = (
    r"ei\s+ole\s+(?:muutettu|korotettu|päivitetty|tarkistettu)\s+(?:sen\s+jälkeen\s+kun|vuoden\s+|vuodesta\s+)(\d{4})",
    r"vuoden\s+(\d{4})\s+tasoss?a?\b.{0,60}(?:euroa|€|tuloraja|enimmäismäärä|raja|verota)",
    r"(?:verot|valmistevero|tuloraja|enimmäismäärä)\w*\s+ei\s+ole\s+(?:muutettu|korotettu|tarkistettu)\s+vuode\w*\s+(\d{4})",
    r"(\d{4})\s+jälkeen\s+(?:ei\s+ole\s+)?(?:muutettu|korotettu|päivitetty|tarkistettu)", r"(?:on\s+)?(?:pysynyt|säilynyt)\s+vuoden\s+(\d{4})\s+tasolla",
)
CLIMATE = r"päästö|ilmasto|kasvihuone|hiilidioksidi|CO2|Kioton|Pariisin"
RANGE = r"(-\s*\d[\d\s,.]*)\s*[–\-—]\s*(\+?\s*\d[\d\s,.]*)|vaihteluväli\s+(-\s*\d[\d\s,.]*)\s*[–\-—]\s*(\+?\s*\d[\d\s,.]*)"
ADDRESS = r"https?://|urn:|doi:|ISBN|URN_ISBN|\.pdf|\.html|/pmc/|/til/|/documents/"
ESTIMATE = r"vaihteluväli|vaikutu|työllisy|miljoon|euroa|milj\.|henkeä|henkilö|työllis|säästö|kustannu|meno|kasv|vähene|lisään|arvioi"
DOMAINS = [
    (r"asumistuki|yleinen asumistuki|asumismenojen|asumiskustannusten", "Sosiaali- ja terveysvaliokunta"),
    (r"toimeentulotuki|perustoimeentulotuki|täydentävä toimeentulotuki", "Sosiaali- ja terveysvaliokunta"),
    (r"vanhuspalvelu|vanhusten hoito|ikääntyneiden hoito|hoivahenkilöstö", "Sosiaali- ja terveysvaliokunta"),
    (r"makeisvero|virvoitusjuomavero|valmistevero.*elintarvike", "Valtiovarainvaliokunta"),
]

RUNS = [(kind, "|".join(p for *_, p in run)) for kind, run in groupby(CLAUSES, key=lambda c: c[:2])]


def starts(pattern: str) -> list[str]:
    """The two letters with which matches of a pattern begin: it starts with letters or plain groups of them."""
    out = []
    for part in re.split(r"\|(?![^(]*\))", pattern):
        while m := re.match(r"\(\?:([^()]*)\)(\??)", part):
            out += [x[:2] for x in m[1].split("|")]
            if not m[2]:
                break
            part = part[m.end() :]
        else:
            out.append(part[:2])
    return [x.lower() for x in out]


def _letters(some: set[str]) -> str:
    """A class of letters in either case, with those beyond Latin-1 that a pattern takes for them."""
    return "[" + "".join(sorted({x for c in some for x in (c, c.upper(), *{"i": "ıİ", "k": "\u212a", "s": "ſ", "å": "\u212b"}.get(c, ""))})) + "]"


def _where(two: set[str]) -> str:
    """A look at the next two letters, each one of those that stand there in ``two``."""
    return "(?=(?-i:" + "".join(_letters({x[k] for x in two}) for k in (0, 1)) + "))"


def quick(patterns: list[str]) -> str:
    """The alternation of some patterns, in their order, of which a place tries those that its two letters allow."""
    begins = [set(starts(p)) for p in patterns]
    every = sorted(set().union(*begins))
    parts = (_where({two}) + "(?:" + "|".join(f"(?:{p})" for p, b in zip(patterns, begins, strict=True) if two in b) + ")" for two in every)
    return "(?iU)" + _where(set(every)) + "(?:" + "|".join(parts) + ")"


ANY = quick([p for *_, p in CLAUSES])


def spots(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern as an array of (at, hit); places count characters from 0."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("after"), F.array().cast("array<struct<at:int,hit:string>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        at = state["after"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("after"), F.concat(state["found"], F.array(F.struct(at.alias("at"), x["hit"].alias("hit")))).alias("found"))

    pieces = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.aggregate(pieces, start, step, lambda s: s["found"])


def clauses(texts: DataFrame, *, id_col: str, text_col: str, reach: int = 60) -> DataFrame:
    """``id, at, category, subtype, said, context`` of every clause; the context has ``reach`` characters on either side."""
    text = F.col(text_col)
    found = texts.filter(text.isNotNull()).select(F.col(id_col), text.alias("_text"), F.explode(spots(text, ANY)).alias("x"))
    kind = F.coalesce(*(F.when(F.col("x.hit").rlike(f"(?iU)^(?:{p})$"), F.struct(F.lit(c).alias("category"), F.lit(s).alias("subtype"))) for (c, s), p in RUNS))
    first = F.greatest(F.col("x.at") - reach, F.lit(0))
    context = F.trim(F.replace(F.substring("_text", first + 1, F.col("x.at") + F.length("x.hit") + reach - first), F.lit("\n"), F.lit(" ")))
    return found.select(id_col, F.col("x.at").cast("long").alias("at"), kind["category"].alias("category"), kind["subtype"].alias("subtype"), F.col("x.hit").alias("said"), context.alias("context"))


def _hits(text: Column, *patterns: str) -> Column:
    """How many matches the patterns have; they are only counted where one look finds any."""
    counts = sum((F.regexp_count(text, F.lit("(?iU)" + p)) for p in patterns), F.lit(0))
    return F.when(text.rlike(quick(list(patterns))), counts).otherwise(F.lit(0)).cast("long")


def _words(text: Column, words: tuple[str, ...]) -> Column:
    """How often words stand in a text, in that case and alone."""
    return sum((F.when(F.contains(text, F.lit(w)), F.regexp_count(text, F.lit(rf"\b{w}\b"))).otherwise(F.lit(0)) for w in words), F.lit(0)).cast("long")


def _terms(low: Column, terms: tuple[str, ...]) -> Column:
    return sum((T.occurrences(low, F.lit(t)) for t in terms), F.lit(0)).cast("long")


def _named(low: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text has."""
    return sum((F.contains(low, F.lit(t)).cast("long") for t in terms), F.lit(0).cast("long"))


def _around(text: Column, x: Column, reach: int) -> Column:
    first = F.greatest(x["at"] - reach, F.lit(0))
    return F.substring(text, first + 1, x["at"] + F.length(x["hit"]) + reach - first)


def _years(text: Column, patterns: tuple[str, ...], near: str | None = None) -> Column:
    """The years that the patterns' matches name; with ``near``, only of matches without it within 100 characters."""

    def named(full: str) -> Column:
        if near is None:
            return F.regexp_extract_all(text, F.lit(full), F.lit(1))
        kept = F.filter(spots(text, full), lambda x: ~_around(text, x, 100).rlike("(?iU)" + near))
        return F.when(text.rlike(full), F.transform(kept, lambda x: F.regexp_extract(x["hit"], full, 1))).otherwise(F.array().cast("array<string>"))

    parts = [named("(?iU)" + p) for p in patterns]
    return F.transform(F.filter(F.concat(*parts), lambda y: y != ""), lambda y: y.cast("int"))


def _crossing(text: Column) -> Column:
    """How many ranges of estimates have ends on both sides of nothing."""
    full = "(?iU)" + RANGE

    def number(x: Column, *groups: int) -> Column:
        said = F.coalesce(*(F.nullif(F.regexp_extract(x["hit"], full, g), F.lit("")) for g in groups))
        return F.replace(F.regexp_replace(F.regexp_replace(said, r"[ \xA0\s]", ""), r"^\+", ""), F.lit(","), F.lit(".")).try_cast("double")

    def crosses(x: Column) -> Column:
        near = _around(text, x, 150)
        return (number(x, 1, 3) < 0) & (number(x, 2, 4) > 0) & ~near.rlike("(?iU)" + ADDRESS) & near.rlike("(?iU)" + ESTIMATE)

    return F.when(text.rlike(full), F.size(F.filter(spots(text, full), crosses))).otherwise(F.lit(0)).cast("long")


def profile(atoms: DataFrame, years: DataFrame) -> DataFrame:
    """One row a bill of all that the detectors count in its texts: ``atoms`` (bill, part: IMPACT or PROPOSED, text), ``years`` (bill, year)."""
    text, low = F.col("text"), F.lower("text")
    impact = F.col("part") == "IMPACT"
    only = lambda c: F.when(impact, c)
    hits = F.when(impact, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = {c: "|".join(p for k, _, p in CLAUSES if k == c) for c in ("confession", "deferral", "escape")}
    kind = F.transform(hits, lambda h: F.coalesce(*(F.when(h.rlike(f"(?iU)^(?:{p})$"), c) for c, p in kinds.items())))
    row = atoms.filter("text IS NOT NULL").join(years, "bill").select(
        "bill", "year", impact.alias("impact"), only(F.length(text)).alias("chars"), kind.alias("kinds"),
        only(_terms(low, FAILURE) + F.greatest(_terms(low, ("riski",)) - _terms(low, BASELINE), F.lit(0))).alias("failure"),
        only(_named(low, STATIC)).alias("static"), only(_named(low, NO_COST)).alias("no_cost"), _terms(low, SYSTEMS).alias("systems"),
        only(_words(text, tuple(m.strip("\\b") for m in MODELS)) + _hits(text, *METHODS)).alias("models"), _hits(text, *FLOOR).alias("floor"), only(_hits(text, *PRESSURE)).alias("pressure"), only(text.rlike("(?iU)" + CEILING)).alias("ceiling"),
        only(_hits(text, *MANDATORY)).alias("mandatory"), only(text.rlike("(?iU)" + DOUBT)).alias("doubt"), only(text.rlike("(?iU)" + HEALTH)).alias("health"), only(text.rlike("(?iU)" + LOAD_BEARING)).alias("bearing"),
        F.filter(only(_years(text, STALE)), lambda y: F.col("year") - y >= 2).alias("stale"), F.filter(only(_years(text, FROZEN, CLIMATE)), lambda y: F.col("year") - y >= 5).alias("frozen"),
        only(_crossing(text)).alias("crossing"), *(only(text.rlike("(?iU)" + p)).alias(f"domain{k}") for k, (p, _) in enumerate(DOMAINS)),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    of_kind = lambda c: F.sum(F.size(F.filter("kinds", lambda k: k == c))).cast("long").alias(c)
    gap = lambda c: F.coalesce(F.max(F.col("year") - F.array_min(c)), F.lit(0)).alias(f"{c}_gap")
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c)
    sums = [total(c) for c in ("chars", "failure", "static", "no_cost", "systems", "models", "floor", "pressure", "mandatory", "crossing")]
    flags = [some(F.col(c), c) for c in ("ceiling", "doubt", "health", *(f"domain{k}" for k in range(len(DOMAINS))))]
    return row.groupBy("bill").agg(F.count(F.when(F.col("impact"), 1)).alias("n_impact"), *map(of_kind, kinds), *sums, *flags, gap("stale"), count("stale"), gap("frozen"), count("frozen"), some(F.col("bearing") & (F.size("stale") > 0), "bearing"))


def detected(found: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """``bill, detector, severity`` for a ``profile``, ``claims`` (bill, kind, euros) and ``reports`` (bill, committee of the first report,
    share of comments ignored, delegations)."""
    fiscal = F.col("kind").eqNullSafe("FISCAL") & F.col("euros").isNotNull()
    money = claims.groupBy("bill").agg(F.count(F.when(fiscal, 1)).alias("fiscal"), F.count(F.when(F.col("kind") == "BEHAVIORAL", 1)).alias("behavioral"), F.sum(F.when(fiscal, F.abs("euros"))).alias("total"))
    rows = found.join(money, "bill", "left").join(reports, "bill", "left").fillna(0, ["fiscal", "behavioral", "total", "delegations"])
    c = F.col
    level = lambda high, medium: F.when(high, 3).when(medium, 2).otherwise(1)
    said = c("confession") + c("deferral") + c("escape")
    rate = c("failure") / (c("chars") / 10000)
    complexity = c("delegations") + c("systems")
    heavy = (c("total") >= 10e6) | c("health")
    wrong = F.lit(False)
    for k, (_, expected) in enumerate(DOMAINS):
        wrong = wrong | F.coalesce(c(f"domain{k}") & (c("committee") != expected), F.lit(False))
    rules = {
        "sign_cross": (c("crossing") > 0, level(c("crossing") >= 2, F.lit(True))),
        "confession_proceed": ((c("confession") >= 3) & (c("fiscal") >= 2), level((c("confession") >= 8) & (c("fiscal") >= 5), c("confession") >= 5)),
        "zero_failure": ((c("chars") >= 30000) & (rate <= 1.5), level((c("chars") >= 80000) & (c("failure") <= 2), (c("chars") >= 50000) & (rate <= 0.5))),
        "static_fiscal": ((c("static") > 0) & (c("fiscal") >= 1), level((c("fiscal") >= 5) & (c("behavioral") >= 5), c("fiscal") >= 3)),
        "impl_zero": ((c("no_cost") > 0) & (complexity >= 3), level((c("delegations") >= 5) & (c("systems") >= 3), complexity >= 5)),
        "epistemic_buffer": ((c("confession") >= 2) & (c("deferral") + c("escape") >= 2) & (c("fiscal") >= 2) & (c("total") >= 1e6), level((said >= 15) & (c("total") >= 1e9), (said >= 8) & (c("total") >= 1e8))),
        "stale_data": (c("stale") > 0, level(c("bearing") | (c("stale_gap") >= 4) | (c("stale") >= 3), (c("stale_gap") >= 3) | (c("stale") >= 2))),
        "frozen_parameter": (c("frozen") > 0, level((c("frozen_gap") >= 15) | (c("frozen") >= 3), (c("frozen_gap") >= 10) | (c("frozen") >= 2))),
        "minimum_becomes_maximum": ((c("chars") >= 15000) & ~c("ceiling") & (c("floor") > 0) & (c("pressure") > 0), level((c("floor") >= 3) & (c("pressure") >= 3), (c("floor") >= 2) | (c("pressure") >= 2))),
        "juridical_shield": ((c("mandatory") >= 2) & heavy, level((c("mandatory") >= 4) & (c("total") >= 100e6) & ~c("doubt"), (c("mandatory") >= 3) & ~c("doubt"))),
        "domain_committee_mismatch": (wrong, F.when(c("ignored") >= 0.7, 3).otherwise(2)),
        "model_void": ((c("total") >= 1e7) & (c("fiscal") >= 2) & (c("models") == 0), level(c("total") >= 1e9, c("total") >= 1e8)),
    }
    flags = F.array(*(F.when(holds, F.struct(F.lit(name).alias("detector"), severity.alias("severity"))) for name, (holds, severity) in rules.items()))
    return rows.filter("n_impact > 0").select("bill", F.inline(F.array_compact(flags)))
