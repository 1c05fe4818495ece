"""The corpus pipeline, stage by stage, against the brute-force versions of the operators."""

import zlib

import numpy as np
import pytest
from test_decontaminate import brute as search_items
from test_mixing import simulate
from test_near_dup import brute as near_components

import corpus_pipeline
from facetledger.llm import language_id, mixing
from facetledger.llm.queries import MIXTURE
from facetledger.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, in the order of their files."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "token_files" or rows.columns == COLUMNS
        rows.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        order = ["_metadata.file_name", "_metadata.row_index"]
        out[name] = docs.orderBy(*order).collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language(spark, stages):
    docs = spark.createDataFrame(stages["documents"])
    told = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert ids(stages["language"]) == sorted(d for d, r in told.items() if r.lang_pred != "und" and r.score >= 0.5)
    assert len(stages["language"]) >= 0.99 * len(stages["documents"])


def test_near_duplicates(stages):
    found = near_components([(r.doc_id, r.text) for r in stages["language"]], 5, 80)
    assert ids(stages["near_duplicates"]) == sorted(d for d, (_, c) in found.items() if c == d)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    found = search_items([(r.doc_id, r.text) for r in stages["near_duplicates"]], items)
    assert ids(stages["decontamination"]) == sorted(d for d, x in found.items() if not x[1])
    assert len(stages["decontamination"]) < len(stages["near_duplicates"])


def test_mixing(stages):
    before = stages["decontamination"]
    assert ids(stages["mixing"]) == ids(before)
    counts = {}
    for r in before:
        counts[r.source] = counts.get(r.source, 0) + 1
    blocks = {s: -(-n // mixing.BLOCK_DOCS) for s, n in counts.items()}
    order, _ = simulate(blocks, mixing.exact_shares({s: MIXTURE.get(s, min(MIXTURE.values())) for s in counts}))
    want = [s for s, b in order for _ in range(min(mixing.BLOCK_DOCS, counts[s] - b * mixing.BLOCK_DOCS))]
    assert [r.source for r in stages["mixing"]] == want


def test_token_files(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    start, want = 0, {}
    for r in stages["mixing"]:
        found = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += len(found)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stages["token_files"]} == want


def test_odd_documents(spark, tmp_path):
    """Null and empty texts, null sources and ids, repeated rows, an empty table."""
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "the cat and the dog were in the house", "en", None, 9), (3, "the cat and the dog were in the house", "en", None, 9)]
    rows += [(None, "of the people by the people for the people", "en", "a", 1), (5, "der die das und ist nicht ein haus von der stadt", "de", "b", 2), (6, "! 1 2", "de", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, want in ((docs, {3, 5, None}), (docs.limit(0), set())):
        folder = f"{tmp_path}/{len(want)}"
        frame.write.parquet(f"{folder}/start")
        now = spark.read.parquet(f"{folder}/start")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, "/root/testdata/sf0.001").write.parquet(f"{folder}/{name}")
            now = spark.read.schema(now.schema if name != "token_files" else "doc_id long, start long, n_tokens long, ids_crc32 long").parquet(f"{folder}/{name}")
        assert {r.doc_id for r in now.collect()} == want and now.count() == len(want)


def test_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert len([n for n, _ in corpus_pipeline.STAGES]) == 5
