"""Personal data: base patterns, and further spans that weakly supervised labelers teach a classifier to find.

Base spans come from four patterns. Their forms here are possessive and anchored to the start of a run where that gives
the same matches, so that long runs cost linear time and no stack. Candidates for further spans (keys, identity and bank
numbers, telephone numbers without a plus) are put before five labelers, each voting yes, no or nothing: does the number
hold by its kind's own rules (known prefixes and hexadecimal keys, areas and groups that are given out, the check digits of bank
numbers, exchange codes); is there a cue word of its kind before it, or one that announces another thing (versions, orders, parts);
does an assignment or a path stand before it; does its make-up fit (digits and letters in turn, a country that has such bank
numbers and their length, one kind of separator); is it set apart from its surroundings. Votes are counted by
pattern over all documents (at most 3**5 patterns). Expectation maximisation over these counts estimates how reliable
each labeler is and how likely each pattern means personal data. These likelihoods are soft labels for the final
classifier, a naive Bayes model over span features in hashed buckets, summed over all candidates of the corpus. What it
accepts is added where it overlaps no base span.

All of it is DataFrame operations; EM is one SQL expression over the table of patterns. Positions are code points, ends
exclusive. Null texts are empty (redaction leaves them null); repeated rows are treated alike; columns other than the id
and the text are ignored. Without candidates nothing is added.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import saved

LOCAL = "[A-Za-z0-9._%+-]"
#: The base kinds in order, with the character that every match has.
BASE = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+"),
}
#: Kinds that the method adds, and what may be one.
MORE = {
    "key": (r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+", "[0-9]"),
    "idnum": (r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]"),
    "tel": (r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]"),
}
KINDS = [*BASE, *MORE]
#: Gazetteers: words that announce a kind, in the languages of the corpus, and words that announce something else.
CUES = {
    "key": "password|passwd|pwd|passphrase|token|secret|api|key|apikey|credential|credentials|auth|authorization|bearer|passwort|kennwort|motdepasse|passe|contraseña|clave|session|signature|access",
    "idnum": "ssn|social security|social|security|tax id|tin|itin|identity|national id|id number|identification|ausweis|steuer|sécurité sociale|nir|dni|seguridad social",
    "iban": "iban|account|acct|bank|bic|konto|kontonummer|bankverbindung|compte|bancaire|virement|cuenta|transferencia|überweisung|wire|payment|beneficiary",
    "tel": "tel|telephone|phone|call|mobile|cell|fax|contact|dial|sms|telefon|handy|anruf|rufnummer|téléphone|portable|appelez|teléfono|móvil|llame|whatsapp|hotline",
}
OTHER = "version|release|build|order|invoice|part|model|serial|sku|isbn|issn|page|pages|section|chapter|figure|table|room|article|commit|revision|bestellung|rechnung|facture|commande|pedido|factura|seite|página"
#: Countries with international bank numbers, and how long these are.
BANKS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
LABELERS, BUCKETS, FEATURES, ROUNDS = 5, 256, 7, 25
#: Votes that each labeler is credited with in advance, and how often they are right.
PRIOR_VOTES, HONEST = 16, 0.75
CONTEXT, CHUNK, ACCEPT = 24, 2048, 0.9


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """(start, kind's number, end, match) of all matches of a kind, in order.

    Starts are sums over the pieces between the matches; they are gathered in chunks, so many matches cost linear time.
    """
    pattern, needs = (BASE | MORE)[kind]
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    item = "struct<s:int,k:int,e:int,m:string>"
    nothing = F.array().cast(f"array<{item}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["m"])
        new = F.array(F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e"), x["m"].alias("m")))
        full = F.size(state["some"]) >= 256
        return F.struct(F.when(full, F.concat(state["chunks"], F.array(state["some"]))).otherwise(state["chunks"]).alias("chunks"), F.when(full, new).otherwise(F.concat(state["some"], new)).alias("some"), end.alias("at"))

    start = F.struct(F.array().cast(f"array<array<{item}>>").alias("chunks"), nothing.alias("some"), F.lit(0).alias("at"))
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, p: F.struct(m.alias("m"), p.alias("piece")))
    all_of = F.aggregate(pairs, start, step, lambda s: F.concat(F.flatten(s["chunks"]), s["some"]))
    return F.when(text.rlike(needs), all_of).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """(s, k, e, m) of the base spans, by start and then kind."""

    def of(kind: str) -> Column:
        return F.filter(_found(text, kind), lambda x: _valid(kind, x["m"]))

    return F.array_sort(F.concat(*map(of, BASE)))


def _vote(yes: Column, no: Column) -> Column:
    """2 for yes, 0 for no, 1 for neither."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _checked(iban: Column) -> Column:
    """Whether a bank number's remainder by 97 is 1, letters counting from 10 and the first four characters last."""
    code = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(code, F.lit(5), F.length(code)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 65, (rest * 10 + n - 48) % 97).otherwise((rest * 100 + n - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _by_kind(kind: Column, votes: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(kind == KINDS.index(k), v) for k, v in votes.items()))


def _votes(kind: Column, match: Column, before: Column, after: Column) -> list[Column]:
    digits = F.length(_digits(match)) / F.length(match)
    changes = F.size(F.regexp_extract_all(match, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    code, low = F.regexp_replace(match, " ", ""), F.lower(before)
    length = F.coalesce(*(F.when(F.substr(code, F.lit(1), F.lit(2)) == c, n) for c, n in BANKS.items()))
    given = ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    one_separator = match.rlike(r"^(?:[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4})$")
    all_of = "|".join(CUES.values())
    cue = _by_kind(kind, {k: low.rlike(rf"(?:^|[^\p{{L}}])(?:{ws})[^\p{{L}}0-9]{{0,4}}(?:(?:no|nr|number|num|is|at|us|me|n°|est|ist|es)[^\p{{L}}0-9]{{0,4}}){{0,2}}$") for k, ws in CUES.items()})
    return [
        _by_kind(kind, {
            "key": _vote(match.rlike("^(?:AKIA|ASIA|ghp_|sk_|xox)[A-Za-z0-9_]{12,}$|^(?=.{0,63}[a-f])(?=.{0,63}[0-9])[0-9a-f]{16,64}$"), match.rlike("[a-z]{12}")),
            "idnum": _vote(given, ~given),
            "iban": F.when(_checked(match), 2).otherwise(0),
            "tel": _vote(match.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"), match.rlike(r"^\(?[01]|^\(?[0-9]{3}\)?[ .-][01]")),
        }),
        _vote(cue, low.rlike(rf"(?:^|[^\p{{L}}])(?:{OTHER})[^\p{{L}}0-9]{{0,4}}$")),
        _vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[/.\\]$")),
        _by_kind(kind, {
            "key": _vote(digits.between(0.1, 0.9) & (changes >= 3), changes < 2),
            "idnum": _vote(low.rlike(f"(?:{all_of})"), F.size(F.array_distinct(F.split(_digits(match), ""))) < 4),
            "iban": _vote(F.coalesce(length == F.length(code), F.lit(False)), length.isNull() | (length != F.length(code))),
            "tel": _vote(one_separator, ~one_separator),
        }),
        _vote(after.rlike(r"^[\s\"'.,;)]|^$") & before.rlike(r"[\s=:\"'(]$|^$"), after.rlike("^[A-Za-z0-9]") | after.rlike(r"^[/\\@]")),
    ]


def _features(kind: Column, match: Column, before: Column, after: Column, held: Column, made: Column) -> list[Column]:
    """What the classifier sees; ``held`` and ``made`` are the votes on the number's own rules and make-up."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substr(match, F.lit(1), F.lit(12)), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    return [
        kind.cast("string"),
        F.concat_ws(":", kind, F.least(F.length(match), F.lit(64))),
        F.concat_ws(":", kind, F.floor(10 * F.length(_digits(match)) / F.length(match))),
        F.concat_ws(":", kind, shape),
        F.concat_ws(":", kind, F.substr(before, F.greatest(F.length(before), F.lit(1)), F.lit(1)), F.substr(after, F.lit(1), F.lit(1))),
        F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1)),
        F.concat_ws(":", kind, held, made),
    ]


def candidates(text: Column, base: Column) -> Column:
    """(s, k, e, votes, features) of what may be further personal data, where no base span is; features are numbers of
    hashed buckets."""

    def judged(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
        after = F.substr(text, x["e"] + 1, F.lit(2))
        votes = _votes(x["k"], x["m"], before, after)
        codes = [(F.pmod(F.xxhash64(f), F.lit(BUCKETS)) + i * BUCKETS).cast("int") for i, f in enumerate(_features(x["k"], x["m"], before, after, votes[0], votes[3]))]
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*votes).alias("votes"), F.array(*codes).alias("features"))

    free = F.filter(F.concat(*(_found(text, kind) for kind in MORE)), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.transform(free, judged)


def _em() -> Column:
    """Posteriors of the patterns in the array column ``patterns`` (votes, n), by expectation maximisation.

    A labeler is described by how often it says yes where it votes at all, for spans that are personal data and for
    others; abstentions say nothing. PRIOR_VOTES votes of an honest labeler are added to each count.
    """
    says = lambda side: f"if(x.votes[j] = 1, 1D, if(x.votes[j] = 2, m.{side}[j], 1D - m.{side}[j]))"
    product = lambda side: f"aggregate(sequence(0, {LABELERS - 1}), 1D, (a, j) -> a * {says(side)})"
    odds = f"m.prior * {product('yes')} / (m.prior * {product('yes')} + (1D - m.prior) * {product('no')})"
    posts = f"transform(patterns, x -> named_struct('votes', x.votes, 'n', x.n, 'p', {odds}))"
    share = lambda weight, honest: (
        f"transform(sequence(0, {LABELERS - 1}), j -> ({PRIOR_VOTES}D * {honest}D + aggregate(post, 0D, (a, x) -> a + if(x.votes[j] = 2, x.n * {weight}, 0D)))"
        f" / ({PRIOR_VOTES}D + aggregate(post, 0D, (a, x) -> a + if(x.votes[j] = 1, 0D, x.n * {weight}))))"
    )
    update = (
        f"aggregate(array({posts}), m, (old, post) -> named_struct("
        f"'prior', ({PRIOR_VOTES}D / 2 + aggregate(post, 0D, (a, x) -> a + x.n * x.p)) / ({PRIOR_VOTES}D + aggregate(post, 0D, (a, x) -> a + x.n)), "
        f"'yes', {share('x.p', HONEST)}, 'no', {share('(1D - x.p)', 1 - HONEST)}))"
    )
    start = f"named_struct('prior', 0.5D, 'yes', array_repeat({HONEST}D, {LABELERS}), 'no', array_repeat({1 - HONEST}D, {LABELERS}))"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {update}, m -> {posts})")


def train(marked: DataFrame) -> list[float]:
    """Weights of the classifier from the array column ``cands`` of all documents: the prior log odds, then one for each
    feature bucket. What comes to the driver is one row for each vote pattern and each bucket at most."""
    spans = marked.select(F.explode("cands").alias("c"))
    patterns = spans.groupBy("c.votes").agg(F.count("*").cast("double").alias("n"))
    em = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("patterns")).select(F.explode(_em()).alias("x"))
    likely = {tuple(r["x"]["votes"]): r["x"]["p"] for r in em.collect()}
    if not likely:
        return [-99.0] + [0.0] * (BUCKETS * FEATURES)
    key = lambda votes: reduce(lambda a, j: a * 3 + votes[j], range(LABELERS), F.lit(0))
    table = [0.0] * 3**LABELERS
    for votes, p in likely.items():
        table[reduce(lambda a, v: a * 3 + v, votes, 0)] = p
    soft = spans.select(F.explode(F.concat("c.features", F.array(F.lit(-1)))).alias("f"), F.get(F.lit(table), key(F.col("c.votes"))).alias("p"))
    sums = {r["f"]: (r["yes"], r["no"]) for r in soft.groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    yes, no = sums[-1]
    out = [math.log((yes + 1) / (no + 1))] + [0.0] * (BUCKETS * FEATURES)
    for f, (a, b) in sums.items():
        if f >= 0:
            out[f + 1] = math.log((a + 1) / (yes + 2) / ((b + 1) / (no + 2)))
    return out


def added(cands: Column, weights: list[float]) -> Column:
    """(s, k, e) of the candidates that the classifier accepts."""
    table = F.lit(weights[1:])
    score = lambda c: F.aggregate(c["features"], F.lit(weights[0]), lambda a, f: a + F.get(table, f))
    good = F.filter(cands, lambda c: 1 / (1 + F.exp(-score(c))) >= ACCEPT)
    return F.transform(good, lambda c: F.struct(c["s"], c["k"], c["e"]))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def marks(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` as column ``doc``, with its base spans and candidates as ``base`` and ``cands``."""
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")).select("doc", _bare(base_spans(text)).alias("base")).select("doc", "base", candidates(text, F.col("base")).alias("cands"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` of every row: arrays of (s, k, e), k being the number of the kind in KINDS."""
    table = saved(marks(docs.select(id_col, text_col), text_col=text_col).select(F.col("doc")[id_col].alias("id"), "base", "cands"), "pii-marks")
    spans = F.array_sort(F.concat("base", added(F.col("cands"), train(table))))
    return table.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by its first span's kind; done in chunks, so that many spans
    in a long text cost linear time."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def piece(chunk: Column, i: Column) -> Column:
        low = i * CHUNK
        own = F.filter(spans, lambda x: (x["s"] < low + F.length(chunk)) & (x["e"] > low))

        def step(state: Column, x: Column) -> Column:
            gap = F.substr(chunk, state["at"] + 1, F.greatest(x["s"] - low - state["at"], F.lit(0)))
            fresh = x["s"] >= low + state["at"]  # it starts here and no span before reaches it
            named = F.when(fresh & (x["s"] >= low), F.get(names, x["k"])).otherwise(F.lit(""))
            return F.struct(F.concat(state["out"], gap, named).alias("out"), F.greatest(state["at"], F.least(x["e"] - low, F.lit(CHUNK))).alias("at"))

        done = lambda s: F.concat(s["out"], F.substr(chunk, s["at"] + 1, F.length(chunk)))
        return F.when(F.size(own) == 0, chunk).otherwise(F.aggregate(own, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, done))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(chunks, piece), ""))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of its texts replaced; columns and rows stay. Spans and candidates are found once and saved
    with their rows, so the classifier reads only the candidates and no text is shuffled."""
    table = saved(marks(docs, text_col=text_col), "pii-marks")
    found = table.select("doc", F.array_sort(F.concat("base", added(F.col("cands"), train(table)))).alias("spans"))
    return found.select(*(redacted(F.col("doc")[c], F.col("spans")).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *(count(kind).alias(f"n_{kind}") for kind in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
