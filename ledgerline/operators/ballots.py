"""Ballots and their groups: leave-one-out majorities, agreement, reconciliation of published with observed totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import saved, spread


def one_ballot(rows: DataFrame, keys: list[str], response: str) -> DataFrame:
    """One ballot for each key: the smallest response."""
    return rows.groupBy(*keys).agg(F.min(response).alias(response))


def leave_one_out(ballots: DataFrame, *, vote: str, group: str, response: str, yes: str, no: str, min_peers: int = 2) -> DataFrame:
    """Each ballot against the majority of the others in its group: peers_for, peers_against and state.

    A group's totals are aggregated and joined back, so no group is gathered in one place; the own ballot is subtracted.
    """
    said = lambda v: F.when(F.col(response) == v, 1).otherwise(0).cast("long")
    totals = ballots.groupBy(vote, group).agg(F.sum(said(yes)).alias("_for"), F.sum(said(no)).alias("_against"))
    out = ballots.join(totals, [vote, group]).withColumn("peers_for", F.col("_for") - said(yes)).withColumn("peers_against", F.col("_against") - said(no)).drop("_for", "_against")
    ahead = F.when(F.col("peers_for") > F.col("peers_against"), yes).otherwise(no)
    return out.withColumn(
        "state",
        F.when(~F.col(response).isin(yes, no), "NON_SUBSTANTIVE")
        .when(F.col("peers_for") + F.col("peers_against") < min_peers, "TOO_FEW_PEERS")
        .when(F.col("peers_for") == F.col("peers_against"), "TIE")
        .when(F.col(response) == ahead, "MATCH")
        .otherwise("DIFFER"),
    )


def agreement(judged: DataFrame, person: str) -> DataFrame:
    """Per person: how often each state, and the share of matches among decided ballots (null if none)."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    out = judged.groupBy(person).agg(n("MATCH").alias("n_match"), n("DIFFER").alias("n_differ"), n("TIE").alias("n_tie"), F.count("*").alias("n_ballots"))
    return out.withColumn("agreement", F.round(F.try_divide(F.col("n_match"), F.col("n_match") + F.col("n_differ")), 6))


def reconciled(observed: DataFrame, published: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Published against observed totals; a side that is not there stays null and has a state of its own."""
    both = observed.join(published, keys, "full_outer")
    a, b = F.col(f"observed_{value}"), F.col(f"published_{value}")
    return both.withColumn("state", F.when(a.isNull(), "NOT_OBSERVED").when(b.isNull(), "NOT_PUBLISHED").when(a == b, "RECONCILED").otherwise("MISMATCH"))


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole), digits)


RESPONSES = ("JAA", "EI", "TYHJAA", "POISSA")


def response(raw: Column) -> Column:
    """The response a ballot states (JAA, EI, TYHJAA, POISSA, accents off); blank stays blank, all else is UNKNOWN."""
    clean = F.translate(F.upper(F.trim(F.coalesce(raw, F.lit("")))), "Ä", "A")
    return F.when(clean.isin(*RESPONSES), clean).when(clean == "", "").otherwise("UNKNOWN")


def observed(ballots: DataFrame, vote: str, person: str, said: str) -> DataFrame:
    """Per vote: rows, each response, unknown and blank ones, and whether a person is blank or comes twice. Persons are
    counted by (vote, person) first, so a hot vote is no single group of rows."""
    n = lambda ok: F.count(F.when(ok, 1))
    per = ballots.groupBy(vote, person).agg(F.count("*").alias("rows"), *(n(F.col(said) == r).alias(r) for r in RESPONSES), n(F.col(said) == "UNKNOWN").alias("UNKNOWN"), n(F.col(said) == "").alias("BLANK"))
    twice = n((F.col("rows") > 1) | F.col(person).isNull() | (F.col(person).cast("string") == "")) > 0
    return per.groupBy(vote).agg(*(F.sum(c).alias(c) for c in ("rows", *RESPONSES, "UNKNOWN", "BLANK")), twice.alias("DUPLICATES"))


def diagnosed(votes: DataFrame, seen: DataFrame, vote: str, cutoff: str) -> DataFrame:
    """``vote, state, reasons, contested`` of every published vote (published_JAA ..., published_TOTAL, void, day).

    Reasons are kept together and sorted; state is EXCLUDED_VOID before EXCLUDED_FUTURE before EXCLUDED_SOURCE_MISMATCH before VALID.
    Nulls among the published totals stay unknown: they are a reason of their own and nothing is compared with them."""
    both = votes.join(seen, vote, "left").na.fill(0, ["rows", *RESPONSES, "UNKNOWN", "BLANK"]).na.fill(False, ["DUPLICATES"])
    p = {r: F.col(f"published_{r}") for r in (*RESPONSES, "TOTAL")}
    missing = reduce(Column.__or__, (c.isNull() for c in p.values()))
    reason = lambda ok, name: F.when(ok, name)
    reasons = [
        reason(F.coalesce("void", F.lit(False)), "VOID_VOTE"),
        reason(F.col("day") > F.lit(cutoff).cast("date"), "FUTURE_CUTOFF"),
        reason(F.col("day").isNull(), "MISSING_SESSION_DATE"),
        reason(missing, "MISSING_PUBLISHED_TOTAL"),
        reason(~missing & (p["TOTAL"] != sum((p[r] for r in RESPONSES), F.lit(0))), "PUBLISHED_TOTAL_BUCKET_SUM_MISMATCH"),
        reason(~missing & (p["TOTAL"] != F.col("rows")), "ROW_COUNT_MISMATCH"),
        *(reason(~missing & (p[r] != F.col(r)), f"{r}_BUCKET_MISMATCH") for r in RESPONSES),
        reason(F.col("UNKNOWN") + F.col("BLANK") > 0, "UNRECOGNISED_OR_BLANK_RESPONSE"),
        reason(F.col("DUPLICATES"), "DUPLICATE_OR_BLANK_PERSON_ID"),
    ]
    found = F.array_sort(F.array_compact(F.array(*reasons)))
    has = lambda name: F.array_contains("reasons", name)
    state = F.when(has("VOID_VOTE"), "EXCLUDED_VOID").when(has("FUTURE_CUTOFF"), "EXCLUDED_FUTURE").when(F.size("reasons") > 0, "EXCLUDED_SOURCE_MISMATCH").otherwise("VALID")
    contested = F.coalesce((p["JAA"] > 0) & (p["EI"] > 0), F.lit(False))
    return both.withColumn("reasons", found).select(vote, state.alias("state"), F.array_join("reasons", ",").alias("reasons"), contested.alias("contested"))


def completeness(votes: DataFrame, seen: DataFrame, vote: str) -> DataFrame:
    """``vote, state`` of the retained ballots against the declared buckets; a null bucket or total makes it unknown, no zero."""
    both = votes.join(seen, vote, "left")
    p = {r: F.col(f"published_{r}") for r in (*RESPONSES, "TOTAL")}
    unknown = reduce(Column.__or__, (c.isNull() for c in p.values()))
    bad = (p["TOTAL"] != F.col("rows")) | reduce(Column.__or__, (p[r] != F.col(r) for r in RESPONSES)) | (p["TOTAL"] != sum((p[r] for r in RESPONSES), F.lit(0)))
    state = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, "NO_LOCAL_BALLOT_ROWS")
        .when(F.col("UNKNOWN") + F.col("BLANK") > 0, "INVALID_BALLOT_RESPONSES")
        .when(unknown, "DECLARED_TOTAL_OR_BUCKET_UNKNOWN")
        .when(bad, "INCOMPLETE_OR_UNRECONCILED")
        .otherwise("COMPLETE_FOR_DECLARED_VOTE")
    )
    return both.select(vote, state.alias("state"))


def label_sensitivity(judged: DataFrame, person: str, label: str) -> DataFrame:
    """Per person, over MATCH and DIFFER rows with a label: the mean of the labels' rates, the label with most rows (the smallest
    among equals) and its rate, and the rate without it."""
    rows = judged.filter(F.col("state").isin("MATCH", "DIFFER") & F.col(label).isNotNull() & (F.trim(F.col(label)) != ""))
    per = rows.groupBy(person, F.trim(F.col(label)).alias("label")).agg(F.count("*").alias("n"), F.count(F.when(F.col("state") == "MATCH", 1)).alias("m"))
    top = F.min(F.struct((-F.col("n")).alias("order"), "label", "n", "m"))
    out = per.groupBy(person).agg(F.count("*").alias("n_labels"), F.avg(F.col("m") / F.col("n")).alias("mean"), top.alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return out.select(
        person, "n_labels", F.round("mean", 6).alias("mean_within_label"), F.col("top.label").alias("largest_label"), F.col("top.n").alias("largest_count"),
        share(F.col("top.m"), F.col("top.n")).alias("largest_rate"), share(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("rate_without_largest"),
    )


def person_summary(ballots: DataFrame, sources: DataFrame, *, vote: str, person: str, group: str, response: str) -> DataFrame:
    """Per person over all votes: how many of its votes' sources are VALID, of these the states of its own ballots against the others of
    its group, the same among contested votes, and a status.

    ``sources`` is the result of ``diagnosed``: votes in another state than VALID (with a duplicate or blank person among other
    reasons) are counted and judge nobody. Ballots without a group are NO_GROUP."""
    known = ballots.select(vote, person, group, response).join(sources.select(vote, F.col("state").alias("_source"), "contested"), vote, "left")
    both = saved(known.withColumn("_valid", F.coalesce(F.col("_source") == "VALID", F.lit(False))), "ballots")
    usable = both.filter("_valid")
    dealt = spread(usable.filter(F.col(group).isNotNull()), both.count(), vote, group)
    grouped = leave_one_out(dealt, vote=vote, group=group, response=response, yes="JAA", no="EI")
    judged = grouped.select(person, "state", "contested").union(usable.filter(F.col(group).isNull()).select(person, F.lit("NO_GROUP"), "contested"))
    judged = judged.union(both.filter("NOT _valid").select(person, F.lit("EXCLUDED"), F.lit(False)))
    n = lambda s, more=F.lit(True): F.count(F.when((F.col("state") == s) & more, 1))
    states = ("MATCH", "DIFFER", "TIE", "TOO_FEW_PEERS", "NON_SUBSTANTIVE", "NO_GROUP", "EXCLUDED")
    out = judged.groupBy(person).agg(*(n(s).alias(f"n_{s.lower()}") for s in states), n("MATCH", F.col("contested")).alias("contested_match"), n("DIFFER", F.col("contested")).alias("contested_differ"))
    decided, contested = F.col("n_match") + F.col("n_differ"), F.col("contested_match") + F.col("contested_differ")
    status = F.when(decided > 0, "COMPARABLE").when(F.col("n_excluded") == sum(F.col(f"n_{s.lower()}") for s in states), "NO_VALID_SOURCE").otherwise("NOT_COMPARABLE")
    return out.withColumns({"agreement": share(F.col("n_match"), decided), "contested_agreement": share(F.col("contested_match"), contested), "status": status})
