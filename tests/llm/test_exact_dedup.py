import hashlib
import re

from pyspark.sql import functions as F

from quillon.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, ids string"
ROWS = [
    (5, "a  b\tc", None, "x"), (3, "a b c", "d", None), (9, "a b c ", None, None), (1, None, None, None), (2, "", None, None),
    (7, " ", None, None), (8, "ab" * 50_000, None, None), (4, "ab" * 50_000, None, None), (None, "a b c", None, None), (None, "lone", None, None),
    (3, "a b c", None, None), (10, "a b c", None, None), (11, "A b c", None, None),
]


def brute(rows):
    groups, out = {}, []
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    for text, ids in groups.items():
        keep = min((x for x in ids if x is not None), default=None)
        out += [(x, keep, len(ids), x == keep, hashlib.sha256(text.encode()).hexdigest()) for x in ids]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def table(spark, tmp_path, rows, parts):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(path)
    return path


def test_large_identifiers_beside_nulls(spark, tmp_path):
    big = [2**53 + 1, 2**53 + 3, 2**63 - 1, 2**63 - 2, -(2**63), None, None]
    rows = [(i, "one text", None, None) for i in big] + [(None, "x", None, None), (2**62 + 1, "x", None, None)]
    for parts in (1, 4):
        path = table(spark, tmp_path / str(parts), rows, parts)
        assert result(exact_dedup(spark, path, files_per_trigger=1)) == brute(rows)


def test_hits_over_many_micro_batches(spark, tmp_path):
    path = table(spark, tmp_path, ROWS, 6)
    assert result(exact_dedup(spark, path, files_per_trigger=1)) == brute(ROWS)


def test_texts_under_one_digest_stay_apart(spark, tmp_path):
    path = table(spark, tmp_path, ROWS, 5)
    got = exact_dedup(spark, path, files_per_trigger=2, digest=lambda c: F.lit("same"))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted((r[:4] for r in brute(ROWS)), key=str)


def test_empty_table(spark, tmp_path):
    assert result(exact_dedup(spark, table(spark, tmp_path, [], 1))) == []


def test_one_file_and_state_of_an_earlier_run(spark, tmp_path):
    path, to = table(spark, tmp_path, ROWS[:4], 1), f"file://{tmp_path}/to"
    exact_dedup(spark, path, to=to)
    spark.createDataFrame(ROWS[4:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert result(exact_dedup(spark, path, to=to)) == brute(ROWS)
