"""Token counts and packing against the libraries run on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm.packing import END_ID, pack, windows
from ledgerline.llm.token_counts import model_path, parts, token_counts

ODD = [None, "", " ", "  ", "a", " lead", "trail ", "a  b", "x▁ y", "▁", "tab\tand\nline", "<s> </s> <|endoftext|>", "naïve Éa ﬁ ½　a b", "a" * 3000, "word. " * 3000, "it's 12345 !!! don't", "dup", "dup"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1)], "doc_id long, text string, n_tokens string, start int")


def test_counts_equal_whole_text_encoding(spark, odd, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        got = {r["doc_id"]: r for r in token_counts(df).collect()}
        assert got.keys() == texts.keys()
        for k, text in texts.items():
            assert got[k]["n_tokens"] == len(model.encode(text)) and got[k]["n_bytes"] == len(text.encode()), (k, text[:50])
            assert got[k]["over_limit"] == (got[k]["n_tokens"] > 4096)
    assert token_counts(odd.limit(0)).count() == 0


def test_parts_keep_every_space():
    assert parts("a  b ") == ["a", " b", ""]


def test_pieces_cover_every_id_once(spark, odd, sf_dir):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(2)
    for df, pad in ((odd, 1.0), (docs, 0.01)):
        texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in pack(df).collect():
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
        assert by_doc.keys() == texts.keys()
        for k, rows in by_doc.items():
            ids = [*model.encode(texts[k], add_special_tokens=False).ids, END_ID]
            at = 0
            for r in sorted(rows, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        total = 0
        for rows in by_seq.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048
            total += at
        assert 1 - total / (2048 * len(by_seq)) <= pad
    assert pack(odd.limit(0)).count() == 0


def test_windows_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = 10
        points = [0, *np.cumsum(rng.integers(1, 8, rng.integers(1, 12))).tolist()]
        costs = [0, *rng.choice([0, 3], len(points) - 1).tolist()]
        best = [0] + [10**9] * (len(points) - 1)
        for i in range(1, len(points)):
            best[i] = min(best[j] + size - points[i] + points[j] + costs[i] for j in range(i) if points[i] - points[j] <= size)
        got, before = 0, 0
        for i in windows(points, costs, size):
            assert points[i] - points[before] <= size
            got += size - points[i] + points[before] + costs[i]
            before = i
        assert before == len(points) - 1 and got == best[-1]
