"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are taken in blocks of bounded bytes and cut before each run of spaces. No piece of the vocabulary has a space
after another character (checked when the model is loaded), so no merge reaches over such a cut and the length of a text
is the sum of the lengths of its parts. Equal parts are encoded once per worker, in one batch per block.

Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import blocks

SPACE = "▁"
#: Entries that a worker's table of part lengths may have before it is emptied.
CACHE_ENTRIES = 150_000
_models: dict[str, tuple] = {}
_PART = re.compile(" [ ]*[^ ]*")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> tuple:
    """The model and the worker's table of part lengths."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.vocab_size())):
            raise ValueError("a piece of this vocabulary reaches over a space; parts can't be encoded alone")
        if model.is_unknown(model.piece_to_id(SPACE)):
            raise ValueError("a lone space is no piece of this vocabulary")
        _models[path] = model, {"": 1}
    return _models[path]


def parts(text: str) -> list[str]:
    """``text`` cut before each run of spaces; each part lacks the one space that the encoder puts before it."""
    text = text.replace(SPACE, " ")
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [x[1:] for x in _PART.findall(f" {text}")]


def lengths(texts: list[str], path: str) -> list[int]:
    model, known = load(path)
    if len(known) > CACHE_ENTRIES:
        known.clear()
        known[""] = 1  # a lone space
    cut = [parts(x) if x else [] for x in texts]
    new = list({p for ps in cut for p in ps if p not in known})
    known.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
    return [sum(map(known.__getitem__, ps)) for ps in cut]


def token_counts(docs: DataFrame, *, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; ``model`` is a file name or a path."""
    path = model if "/" in model else model_path(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column("text").fill_null("")
            n = lengths(texts.to_pylist(), path)
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
