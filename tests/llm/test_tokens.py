"""Token counts and files against the libraries on whole texts."""

import random
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from facetledger.llm import token_counts, token_orc
from facetledger.llm.memo import PieceCounts, PieceIds
from facetledger.llm.queries import QUERIES, tokenizer_file
from facetledger.llm.text import buffer_of

ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb\n\nc", "\ta\t b", "▁x▁▁y", "x ▁ y", "</s><s> <0x0A>", "é É ́a", "ΑΣ ΣΑΣ", "İstanbul",
    "don't we'll I'M", "<|endoftext|> <|ENDOFTEXT|>x", "a　b c​d\x1ce\x85f", "日本語 テキスト", "word,. word!? (word) word's", "1234 5a6 a.b,c", "ﬁ ß ẞ Ǆ", "\x00\x01 q",
    "Ａ ｂ", "é́ 가", "🙂🙃 ok🙂", "x" * 3000, "a " * 2000, "é" * 500 + ".", "...", "a...", "...a", "A.B", "ªº ²³ ½",
]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    bits = ["a", "the", "Haus", "été", " ", "  ", "\n", "\t", "▁", ".", ",", "'s", "'LL", "é", "é", "Σ", "<|endoftext|>", "1", "42", "　", "日本", "İ", "!", "\r\n", "()"]
    return ODD + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_pieces_give_what_whole_texts_give(model, tokenizer):
    counts, ids = PieceCounts(tokenizer_file("piece_bpe_32k.model")), PieceIds(tokenizer_file("word_bpe_49k.json"))
    assert ids.lowers and ids.splits
    texts = odd_texts(1500)
    for some in (texts, texts[::-1], *[[t] for t in ODD]):
        tokens, _, first = counts.count(*buffer_of(pa.array(some)))
        got = [tokens[a:b].sum() for a, b in pairwise(first)]
        assert got == [len(model.encode(t)) for t in some]
        found, sizes = ids.encode(*buffer_of(pa.array(some)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for t, a, b in zip(some, ends[:-1], ends[1:], strict=True):
            assert found[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_full_table_begins_anew(tokenizer):
    ids = PieceIds(tokenizer_file("word_bpe_49k.json"))
    ids.table.entries = 5
    for k in range(12):
        text = " ".join(f"word{k}x{j}" for j in range(k))
        assert ids.encode(*buffer_of(pa.array([text])))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(ids.table.keys) < 60


def test_counts_of_whole_tables(spark, small, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op7_token_counts"](spark, small).collect()}
    assert got == {k: (len(t.encode()), n := len(model.encode(t)), n > 4096) for k, t in texts.items()}


def test_query_stores_the_prefixes(spark, small, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op7_token_counts"](spark, small).limit(20).collect():
        text = texts[r.doc_id].encode()
        assert r.prefix_bytes[-1] == r.n_bytes and r.prefix_tokens[-1] == r.n_tokens
        assert len(r.prefix_bytes) >= len(text.split()) > 1
        assert r.prefix_tokens[:40] == [len(model.encode(text[:b].decode())) for b in r.prefix_bytes[:40]]


def test_every_prefix(spark, model):
    texts = [t for t in odd_texts(60) if len(t) < 400] + [None]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_tokens="clash", more=[1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, more array<int>")
    path = tokenizer_file("piece_bpe_32k.model")
    for grain in ("character", "word"):
        for r in token_counts.prefix_counts(docs, path, grain).collect():
            text = (r.text or "").encode()
            assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len(text) and r.more == [1]
            want = [len(model.encode(text[:b].decode())) for b in r.prefix_bytes]
            assert r.prefix_tokens == want
            if grain == "character":
                assert r.prefix_bytes == list(np.cumsum([len(c.encode()) for c in r.text or ""]))
            elif text:
                assert r.prefix_bytes[-1] == len(text)


def test_budget_questions(spark, model):
    text = "one two three\nfour five six seven"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    counted = token_counts.prefix_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    rows = counted.select("doc_id", "text", token_counts.bytes_within(5).alias("b"), token_counts.tokens_within(13).alias("n")).orderBy("doc_id").collect()
    assert len(model.encode(text[: rows[0].b])) <= 5 < len(model.encode(text[: rows[0].b + 6]))
    assert rows[0].n == len(model.encode("one two three")) and (rows[1].b, rows[1].n) == (0, 0)


def expected(docs, tokenizer):
    out, start = {}, 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_files_of_whole_tables(spark, small, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_orc"](spark, small).collect()}
    assert got == expected(docs, tokenizer)


def test_files_of_odd_texts(spark, tokenizer):
    docs = list(enumerate([*odd_texts(100), None]))
    frame = spark.createDataFrame([Row(doc_id=i, text=t, block="clash") for i, t in docs], "doc_id long, text string, block string").repartition(5)
    folder = token_orc.new_folder(spark)
    token_orc.write_tokens(frame, folder, tokenizer_file("word_bpe_49k.json"), 2)
    rows = token_orc.read_tokens(spark, folder)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.describe_tokens(rows).collect()} == expected(docs, tokenizer)
    one = token_orc.read_tokens(spark, folder, [17])
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,17)" in one._jdf.queryExecution().toString()
    assert [r.ids for r in one.collect()] == [[*tokenizer.encode(docs[17][1], add_special_tokens=False).ids, 2]]


def test_repeats_and_empty_tables(spark):
    path = tokenizer_file("word_bpe_49k.json")
    frame = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "x"), (1, "")], "doc_id long, text string")
    folder = token_orc.new_folder(spark)
    token_orc.write_tokens(frame, folder, path, 2)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_orc.describe_tokens(token_orc.read_tokens(spark, folder)).collect())
    assert rows == [(0, None, 2), (2, 1, 1), (3, 3, 3), (6, 3, 3)]
    folder = token_orc.new_folder(spark)
    token_orc.write_tokens(frame.limit(0), folder, path, 2)
    assert token_orc.describe_tokens(token_orc.read_tokens(spark, folder)).count() == 0
    assert token_counts.prefix_counts(frame.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0
