import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from depotlens.llm.op01_token_counts import op1_token_counts, token_counts
from depotlens.llm.op06_sentencepiece import decode, encode, op6_sentencepiece
from depotlens.llm.unigram import MARK, default_model, vocabulary

SCHEMA = "doc_id long, text string, pieces int, score string"
D = "/root/testdata/sf0.001"
EDGE = ["", " ", "a", "  two  spaces ", "tab\there\nnew\r\n\n line ", "naïve Straße Œuvre", "日本語 テキスト", "x" * 3000, "▁mark▁", "a▁", "\U0001f600 end", "the " * 500]


@pytest.fixture(scope="module")
def library():
    """The same vocabulary and scores in another library's unigram model."""
    v = vocabulary(default_model())
    return Tokenizer(models.Unigram(list(zip(v.pieces, v.scores)), unk_id=0, byte_fallback=True))


def test_equals_library(spark, library):
    words = sorted({w for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect() for w in r.text.split()})
    words = [w for w in words if MARK not in w]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    want = [e.ids for e in library.encode_batch([MARK + w for w in words])]
    got = {r.doc_id: r.pieces for r in encode(df).collect()}
    assert [got[i] for i in range(len(words))] == want
    counts = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert [counts[i] for i in range(len(words))] == [len(x) for x in want]


def test_whole_documents(spark):
    rows = {r.doc_id: r for r in op6_sentencepiece(spark, D).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    counts = {r.doc_id: r for r in op1_token_counts(spark, D).collect()}
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        assert rows[r.doc_id].round_trip and rows[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert counts[r.doc_id].n_tokens == rows[r.doc_id].n_pieces == len(rows[r.doc_id].pieces)
        assert sp.decode(rows[r.doc_id].pieces) == r.text or MARK in r.text


def test_edges(spark):
    data = [(i, t, None, None) for i, t in enumerate(EDGE)] + [(None, None, 1, "x"), (0, "", 1, "x"), (0, "", 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    got = encode(df, check=True).collect()
    assert len(got) == len(data) and all(r.round_trip for r in got)
    assert sorted((r.text for r in decode(encode(df)).collect())) == sorted([*EDGE, "", "", ""])
    assert sorted(r.n_pieces for r in got) == sorted(r.n_tokens for r in token_counts(df).collect())
    none = spark.createDataFrame([], SCHEMA)
    assert encode(none, check=True).count() == token_counts(none).count() == 0
