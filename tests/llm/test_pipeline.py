"""Each stage against its own input, by brute force."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from quillon.llm import toxicity
from quillon.llm.queries import CATEGORIES, WORD_TOKENIZER
from tests.llm.test_minhash import brute
from tests.llm.test_operators import key

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
        seen.append((docs.collect(), out.collect()))
        docs = out
    (first, clean), (_, lines), (before, unique), (last, pieces) = seen
    chain = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), CATEGORIES)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in first if chain.score(r["text"])[-1] < chain.threshold}
    assert all(r["n_chars"] == len(r["text"]) for r in lines) and {r["doc_id"] for r in lines} == {r["doc_id"] for r in clean}
    owner = {}
    for r in clean:
        for k in {key(x) for x in r["text"].split("\n")}:
            owner.setdefault(k, set()).add(r["doc_id"])
    kept = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or len(owner[key(x)]) < 2 or min(owner[key(x)]) == r["doc_id"]) for r in clean}
    assert {r["doc_id"]: r["text"] for r in lines} == kept
    keep = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in before], 5, 80) if kept}
    assert {r["doc_id"] for r in unique} == keep
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in last}
    words, of = Tokenizer.from_file(WORD_TOKENIZER), {}
    for r in pieces:
        of.setdefault(r["doc_id"], []).append(r)
    for r in last:
        ids, at = np.array([*words.encode(r["text"], add_special_tokens=False).ids, 2], "<u4"), 0
        for piece in sorted(of[r["doc_id"]], key=lambda p: p["start"]):
            assert (piece["start"], piece["doc_tokens"]) == (at, len(ids))
            at += piece["length"]
            assert zlib.crc32(ids[piece["start"] : at].tobytes()) == piece["ids_crc32"]
        assert at == len(ids)
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in queries} and "pipeline" in queries
    assert set(sql) <= set(queries) and "pipeline" not in sql


def test_nulls_empty_tables_and_columns_of_other_names(spark, tmp_path):
    rows = [(1, "one two three four five six seven eight", "en", "a"), (2, None, None, None), (None, "one two three four five six seven eight nine", "en", "a"), (3, "", "en", "b"), (1, "one two three four five six seven eight", "en", "a"), (4, "a line of its own that is long\none two three four five six seven eight", "en", "b")]
    schema = "doc_id bigint, text string, lang string, source string"
    for k, own in enumerate((rows, [])):
        docs = spark.createDataFrame(own, schema).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS doc", "'x' AS gone", "2 AS row", "'k' AS keep", "0 AS component")
        docs.write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / f"{k}/labels.parquet"))
        pieces = corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()
        # Rows of one identifier are one document, and null identifiers match nothing: all stay, 4 without its repeated line.
        assert sorted(str(r["doc_id"]) for r in pieces) == sorted(str(r[0]) for r in own)
        assert not own or len({r["doc_tokens"] for r in pieces if r["doc_id"] == 1}) == 1
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path / str(k))).columns == docs.columns
