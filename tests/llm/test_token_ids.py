"""Token counts, pieces and token files against the libraries."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemaloom.llm import pieces, token_counts, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk_docs", [2, 65_536])
def test_counts_equal_the_library(docs, sample, monkeypatch, chunk_docs):
    monkeypatch.setattr(token_counts, "CHUNK_DOCS", chunk_docs)
    tokenizer = Tokenizer.from_file(BYTES)
    for df in (docs, sample):
        expected = Counter()
        for r in df.collect():
            text = r.text or ""
            expected[(r.doc_id, len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))] += 1
        assert rows_of(token_counts.token_counts(df, BYTES)) == expected


def test_a_frequent_pretoken_meets_in_many_tasks(spark, sample, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_ROW", 12)
    monkeypatch.setattr(token_counts, "NEAR", 1)
    monkeypatch.setattr(token_counts, "FAR", 2)
    spread = spark.createDataFrame(sample.collect(), sample.schema).repartition(6, "doc_id")
    got = token_counts.token_counts(spread, BYTES)
    plain = token_counts.token_counts(sample, BYTES)
    assert Counter(got.collect()) == Counter(plain.collect())
    # The exchange is by pre-token and neighbourhood of chunks.
    assert "CASE WHEN (octet_length(postings" in got._jdf.queryExecution().executedPlan().toString()


def test_counts_of_nothing(no_docs):
    assert token_counts.token_counts(no_docs, BYTES).count() == 0


def test_pretokens_of_known_characters_are_the_librarys():
    find, pre = regex.compile(token_counts.BYTE_LEVEL), Tokenizer.from_file(BYTES).pre_tokenizer
    for c in (*range(0x370), *range(0x2010, 0x2028)):
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} z {chr(c)}{chr(c)}"
        assert token_counts.KNOWN.fullmatch(text)
        assert [m.span() for m in find.finditer(text)] == [o for _, o in pre.pre_tokenize_str(text)], hex(c)


def test_a_pretoken_by_itself_stays_whole():
    split, find = token_counts.splitter(BYTES), regex.compile(token_counts.BYTE_LEVEL).findall
    text = "it's  we''ll \n\n x\ty 12 ab12 --- 'stop ''s  "
    for piece in find(text):
        assert list(split(piece)) == [piece]


def test_pieces_equal_the_library(docs, sample):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (docs, sample):
        rows = pieces.decoded(pieces.encoded(df, MODEL), MODEL).withColumn("crc", pieces.ids_crc32(F.col("ids"))).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert r.ids == library.encode(r.text), r.text[:80]
            assert r.decoded == library.decode(r.ids)
            assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_pieces_of_nothing(no_docs, spark):
    assert pieces.decoded(pieces.encoded(no_docs, MODEL), MODEL).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert [r.decoded for r in pieces.decoded(odd, MODEL).collect()] == ["", ""]


def test_sorted_words_share_work():
    model = pieces.Pieces(MODEL)
    words = sorted(["▁the", "▁there", "▁therefore", "▁them", "▁", "▁▁x", "▁é\n", "▁" + "a" * 300])
    together = list(model.encode_sorted(words))
    assert together == [next(iter(model.encode_sorted([w]))) for w in words] == [model.merged(w) for w in words]


def test_words_of_known_characters_are_the_librarys():
    tokenizer, words = Tokenizer.from_file(WORDS), token_files._words(WORDS)
    chars = [chr(c) for c in range(0x21, 0x300)]
    texts = [t for c in chars for t in (c, f"a{c}1{c}!{c}Z", f"{c}{c}B.", f"é{c}Ü")] + ["it's", "<|endoftext|>x", "Σίσυφος"]
    flat, starts = words(texts)
    for i, t in enumerate(texts):
        assert flat[starts[i] : starts[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def token_rows(spark, df, path):
    token_files.write_tokens(df, path, WORDS, end_id=2)
    return token_files.digests(spark, path, pieces.ids_crc32)


def test_token_files_equal_the_library(spark, sample, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.start, r.n_tokens, r.digest) for r in token_rows(spark, sample, f"file://{tmp_path}/a").collect()}
    start, expected = 0, {}
    for r in sorted(sample.collect(), key=lambda r: r.doc_id):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == expected


def test_token_files_of_odd_rows(spark, docs, no_docs, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = token_rows(spark, docs, f"file://{tmp_path}/b").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, *range(4, 11), 12, 13]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.digest) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
    assert token_rows(spark, no_docs, f"file://{tmp_path}/c").count() == 0


def test_token_files_are_pruned_by_id(spark, sample, tmp_path):
    path = f"file://{tmp_path}/d"
    token_files.write_tokens(sample, path, WORDS, end_id=2)
    one = token_files.read_tokens(spark, path, F.col("doc_id") == 17)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
