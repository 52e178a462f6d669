"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

Counts of each whole text are taken once, in blocks of bounded bytes. Labelled documents give the examples: rules that
reject are grown one threshold at a time by information gain on two thirds of the examples, pruned on the other third,
and kept while they are precise there; what a rule covers is taken away before the next is grown. The result is a list
of conjunctions over named ratios, which becomes one ``CASE WHEN`` in rule order.

Null and empty texts have no words and fail the base rule. Without usable labels the list is empty and only the base rule
decides. Repeated rows are judged alike; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANK_WORD, _table, blocks, gram_hash, mix, owner, prefix_hash, runs, saved, slice_hash, utf8

#: At most so many labelled rows are learned from (those with the smallest hash of their id).
SAMPLE_ROWS = 60_000
WINDOW = 5
SYMBOL = _table(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes")
#: What conditions are about, as SQL over the counts.
FEATURES = {
    "words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def _in_pairs(keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are there more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a block."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    inside = BLANK_WORD[data]
    starts, ends = runs(inside, offsets)
    doc = owner(offsets, starts)
    prefix = prefix_hash(data)
    breaks = np.flatnonzero(data == 10)
    line_starts, line_doc = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([np.arange(n), owner(offsets, breaks)])
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.append(line_starts[1:] - 1, len(data)) if n else line_starts
    last = np.append(line_doc[1:] != line_doc[:-1], True) if n else np.zeros(0, bool)
    line_ends[last] = offsets[line_doc[last] + 1]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_doc = line_doc[worded]
    lines = mix(slice_hash(prefix, line_starts[worded], line_ends[worded]) + line_doc.astype(np.uint64))
    first = np.unique(lines, return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=n)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        grams = gram_hash(slice_hash(prefix, starts, ends), WINDOW)
        whole = doc[WINDOW - 1 :] == doc[: len(grams)]
        at = np.flatnonzero(whole)
        at = at[_in_pairs(mix(grams[at] + doc[at].astype(np.uint64)))]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + WINDOW, -1)
    covered = doc[np.cumsum(repeated)[:-1] > 0]
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(SYMBOL[data], offsets),
        "n_dup_lines": n_lines - np.bincount(line_doc[first], minlength=n),
        "n_repeat_words": np.bincount(covered, minlength=n),
        "n_lines": n_lines,
        "n_bytes": np.diff(offsets),
    }


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            got = counts(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("id"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, sign, threshold) holds; precision and support are those of the examples."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    support: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (x[f] > t if s == ">" else x[f] <= t for f, s, t in self.conditions))

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {s} {t!r}D" for f, s, t in self.conditions)


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    return np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, depth: int, cuts: int) -> list[tuple[str, str, float]]:
    """Add the condition of the greatest gain until only bad examples are covered."""
    covered, out = np.ones(len(bad), bool), []
    while len(out) < depth and (p0 := int(bad[covered].sum())) and (n0 := int(covered.sum()) - p0):
        best = (1e-9, None)
        for f, values in x.items():
            v, b = values[covered], bad[covered]
            points = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1]))
            order = np.argsort(v, kind="stable")
            upto = np.concatenate([[0], np.cumsum(b[order])])
            below = np.searchsorted(v[order], points, "right")
            p = upto[below]
            for sign, pp, nn in (("<=", p, below - p), (">", p0 - p, (len(v) - below) - (p0 - p))):
                g = _gain(pp, nn, p0, n0)
                if len(g) and g.max() > best[0]:
                    best = (float(g.max()), (f, sign, float(points[int(g.argmax())])))
        if best[1] is None:
            break
        out.append(best[1])
        f, s, t = best[1]
        covered &= x[f] > t if s == ">" else x[f] <= t
    return out


def _tightest(conditions: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """One condition for each feature and sign, in the order in which they were last tightened."""
    last = {(f, s): t for f, s, t in conditions}
    return [(f, s, t) for k, (f, s, t) in enumerate(conditions) if last[f, s] == t and (f, s) not in {c[:2] for c in conditions[k + 1 :]}]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, *, max_rules: int = 12, depth: int = 4, cuts: int = 64, precision: float = 0.97, support: int = 5) -> list[Rule]:
    """Ordered rules that reject ``bad`` examples; ``fold`` is true where an example is for pruning."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        grow, prune = left & ~fold, left & fold
        if bad[grow].sum() < support or not prune.any():
            break
        conditions = _grow({f: v[grow] for f, v in x.items()}, bad[grow], depth, cuts)
        if not conditions:
            break

        def judged(conditions: list, rows: np.ndarray) -> tuple[int, int]:
            hit = Rule(tuple(conditions), 0, 0).holds(x) & rows
            return int((hit & bad).sum()), int((hit & ~bad).sum())

        def worth(conditions: list) -> float:
            p, n = judged(conditions, prune)
            return (p - n) / (p + n) if p + n else -1.0

        conditions = _tightest(conditions)
        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        p, n = judged(conditions, left)
        pp, pn = judged(conditions, prune)
        if p < support or p < precision * (p + n) or pp < precision * (pp + pn):
            break
        rules.append(Rule(tuple(conditions), p / (p + n), p))
        left &= ~rules[-1].holds(x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), or null."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = (out if out is not None else F).when(F.expr(rule.sql()), F.lit(k))
    return out if out is not None else F.lit(None).cast("int")


def examples(counted: DataFrame, labels: DataFrame, sample_rows: int, label_col: str = "quality") -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The features, classes and folds of at most ``sample_rows`` labelled documents."""
    some = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("label")).dropna().orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    rows = counted.join(F.broadcast(some), "id").select("label", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)).alias("fold"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    got = rows.orderBy(*rows.columns).limit(2 * sample_rows).toPandas()  # repeated ids: bounded as well
    return {f: got[f].to_numpy(float) for f in FEATURES}, got["label"].to_numpy() == 0, got["fold"].to_numpy() == 0


def quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, precision: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``id``, COUNTS, ``base_failed``, ``rule`` (the first learned rule that rejects) and ``kept`` per row; and the rules."""
    counted = saved(document_counts(docs, id_col, text_col), "quality-counts")
    rules = learn(*examples(counted, labels, sample_rows), precision=precision)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("id", id_col), rules


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
