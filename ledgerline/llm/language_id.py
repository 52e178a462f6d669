"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram of letters (lower case; all else is
one gap) binds the vectors of its letters, permuted by place, into their product; a text bundles its trigram vectors into
a sum, and a language the sums of its texts. A text has the language whose prototype is nearest by cosine.

Texts are taken in blocks of bounded bytes: the trigrams of a block are counted per text and bundled by one matrix
product, so vectors of trigrams are made once per block and worker. Prototypes are summed per task before the shuffle:
what reaches the driver is one vector a language.

``und`` (score 0) is the result for null text, text without a letter, or when nothing could be learned. Ties go to the
language that sorts first. Repeated rows are judged alike; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import blocks

DIMENSIONS, SEED, UNKNOWN = 1024, 20240229, "und"
#: Distinct trigrams whose vectors are held at once, and entries of a count matrix.
SLICE, CELLS = 4096, 1 << 21
#: Bytes of text that are taken together; a count matrix and its trigrams take some hundred times as much.
BLOCK = 1 << 20
#: Standard deviations (1 / sqrt(dimensions)) that the best of some languages' cosines with an unrelated text stays below;
#: trigrams (_kinds) from which on a cosine is judged.
NOISE, JUDGED = 4.1, 16
_letters: list[np.ndarray] = []
_vectors: dict[tuple[int, int], np.ndarray] = {}


def letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for all that is none."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    key = code, dimensions
    if key not in _vectors:
        _vectors[key] = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return _vectors[key]


def trigram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each trigram: its letters' vectors, permuted by place and multiplied."""
    codes, at = np.unique(np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]).astype(np.int64), return_inverse=True)
    table = np.stack([letter_vector(int(c), dimensions) for c in codes])
    a, b, c = at.reshape(3, -1)
    return (np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a text as 63-bit numbers, gaps at both ends included; none without a letter."""
    codes = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    return codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of each text's trigram vectors."""
    grams = [trigrams(t) for t in texts]
    out = np.zeros((len(texts), dimensions), np.float32)
    kinds, at = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(kinds):
        return out
    doc = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    for low in range(0, len(kinds), SLICE):
        vectors = trigram_vectors(kinds[low : low + SLICE], dimensions)
        width = len(vectors)
        rows = max(1, CELLS // width)
        mine = (at >= low) & (at < low + width)
        d, k = doc[mine], at[mine] - low
        for first in range(0, len(texts), rows):
            lo, hi = np.searchsorted(d, [first, first + rows])
            height = min(rows, len(texts) - first)
            table = np.bincount((d[lo:hi] - first) * width + k[lo:hi], minlength=height * width).reshape(height, width)
            out[first : first + height] += table.astype(np.float32) @ vectors
    return out


def prototypes(docs: DataFrame, *, dimensions: int = DIMENSIONS, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` in order, and the bundled vector of each, scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches, limit=BLOCK):
            langs, at = np.unique(np.array(block.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            got = bundles(block.column("text").to_pylist(), dimensions)
            for k, lang in enumerate(langs):
                sums[lang] = sums.get(lang, 0) + got[at == k].sum(axis=0, dtype=np.float64)
        if sums:
            size = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(sums), dimensions)), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), size)), pa.array(np.concatenate(list(sums.values())).astype(np.int64))], names=["lang", "d", "v"]
            )

    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).filter("lang is not null and text is not null")
    got = rows.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        return [], np.zeros((0, dimensions))
    table = got.pivot(index="lang", columns="d", values="v").sort_index()
    vectors = table.to_numpy(np.float64)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    some = length[:, 0] > 0
    return [str(x) for x in table.index[some]], vectors[some] / length[some]


def identify(docs: DataFrame, langs: list[str], vectors: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` (the cosine, 0 at least) of every row of ``docs``."""
    near = vectors.T.astype(np.float32)
    dimensions = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            own = bundles(block.column("text").to_pylist(), dimensions)
            length = np.linalg.norm(own, axis=1)
            pred, score = np.full(len(own), UNKNOWN, object), np.zeros(len(own))
            if langs:
                dots = own @ near
                best = dots.argmax(axis=1)
                some = length > 0
                pred[some] = np.array(langs, object)[best[some]]
                score[some] = np.clip(dots[np.arange(len(own)), best][some] / length[some], 0, 1)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "lang_pred", "score"]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _kinds(texts: list[str | None]) -> np.ndarray:
    """The number of equally frequent trigrams that would spread each text as wide as its own (repeated words add none)."""
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        n = np.unique(trigrams(text), return_counts=True)[1].astype(np.float64)
        out[k] = round(n.sum() ** 2 / (n @ n)) if len(n) else 0
    return out


def _scale(kinds: np.ndarray) -> np.ndarray:
    """The power of two at or below each number of trigrams; -1 for none."""
    return np.frexp(kinds)[1] - 1


def alphabet(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """The letters of ``docs`` in ascending order, without those rarer than one in a million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for block in blocks(batches, limit=BLOCK):
            text = "".join(x or "" for x in block.column("text").to_pylist())
            total += np.bincount(letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(total))
        some = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["letter", "n"])

    rows = docs.select(docs[text_col].alias("text")).filter("text is not null")
    got = rows.mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).toPandas()
    return np.sort(got["letter"][got["n"] * 1_000_000 >= got["n"].sum()].to_numpy(np.int64))


def limits(docs: DataFrame, langs: list[str], vectors: np.ndarray, *, text_col: str = "text") -> np.ndarray:
    """The least cosine of a text by the scale of its number of trigrams (_kinds), from labelled ``docs`` the prototypes
    don't know: half of their lowest hundredth (of 100 rows or more), and NOISE standard deviations of an unrelated
    text's cosine at least; longer texts need no less than shorter ones.
    Below JUDGED trigrams a language's own texts lie within the noise, so there is no limit."""
    dimensions = vectors.shape[1]
    out = np.full(64, NOISE / np.sqrt(max(dimensions, 1)))
    out[: int(np.log2(JUDGED))] = -1.0
    if not langs:
        return out
    near = vectors.T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            texts = block.column("text").to_pylist()
            own, kinds = bundles(texts, dimensions), _kinds(texts)
            length = np.linalg.norm(own, axis=1)
            some = (kinds >= JUDGED) & (length > 0)
            yield pa.RecordBatch.from_arrays([pa.array(_scale(kinds[some]).astype(np.int32)), pa.array(((own @ near).max(axis=1)[some] / length[some]).astype(np.float64))], names=["scale", "score"])

    rows = docs.select(docs[text_col].alias("text")).filter("text is not null")
    low = F.percentile_approx("score", F.lit(0.01), F.lit(10000)).alias("low")
    for scale, low_score in rows.mapInArrow(run, "scale int, score double").groupBy("scale").agg(low, F.count("*").alias("n")).filter("n >= 100").drop("n").collect():
        out[scale] = max(out[scale], low_score / 2)
    return np.maximum.accumulate(out)


def accepted(docs: DataFrame, langs: list[str], vectors: np.ndarray, least: np.ndarray, known: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language: at least half of its letters are ``known`` ones and its cosine
    reaches the limit ``least`` of its scale."""
    near, dimensions = vectors.T.astype(np.float32), vectors.shape[1]
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        familiar = np.zeros(0x110000, bool)
        familiar[known] = True
        for block in blocks(batches, text, BLOCK):
            texts = block.column(text).to_pylist()
            own, kinds = bundles(texts, dimensions), _kinds(texts)
            length = np.linalg.norm(own, axis=1)
            best = (own @ near).max(axis=1) if langs else np.zeros(len(own))
            share = np.zeros(len(own))
            for k, x in enumerate(texts):
                codes = letters()[np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
                share[k] = familiar[codes].sum() / max(np.count_nonzero(codes), 1)
            yield block.filter(pa.array((kinds > 0) & (share >= 0.5) & (best >= least[_scale(kinds)] * length) & bool(langs)))

    rows = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from the rows that are not held out."""
    return prototypes(docs.filter(F.coalesce(fold() != 1, F.lit(True))))


def in_a_learned_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` accepted by prototypes and letters of the labelled rows, with limits from those held out."""
    labelled = docs.filter("lang is not null")
    langs, vectors = learned(docs)
    known = alphabet(labelled.filter(F.coalesce(fold() != 1, F.lit(True))))
    return accepted(docs, langs, vectors, limits(labelled.filter(fold() == 1), langs, vectors), known)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, *learned(docs)).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
