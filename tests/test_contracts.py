"""Responses, contracts, claims and imports against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import contracts, quality, responses
from quillon.sources import io

V = {"policy": {"allowed": 1, "disallowed": 0, "unknown": 0}, "lifecycle": {"compatible": 0.5, "incompatible": 0.25, "unknown": 0.25}, "admissibility": {"admissible": 0.1, "inadmissible": 0.9, "unknown": 0.0}}


def answer(**changes):
    return {"query_intent": {"current_state": 0.7, "history": 0.2, "unknown": 0.1}, "candidates": [{"candidate_key": k, **V} for k in ("c01", "c02")], **changes}


def item(**changes):
    return [{"candidate_key": "c01", **V}, {"candidate_key": "c02", **V, **changes}]


def vector(**p):
    return {"admissible": 0.1, "inadmissible": 0.9, "unknown": 0.0, **p}


GOOD = json.dumps(answer())
CASES = {
    "good": (GOOD, None), "order of keys": (json.dumps(dict(reversed(answer().items()))), None), "blank": (f"  {GOOD}\n", None), "near 1": (json.dumps(answer(candidates=item(admissibility=vector(unknown=0.00009)))), None),
    "drift of a sum": (json.dumps(answer(query_intent={"current_state": 0.8, "history": 0.1, "unknown": 0.2})), "sum"), "sum in an item": (json.dumps(answer(candidates=item(admissibility=vector(unknown=0.001)))), "sum"),
    "drift of the order": (json.dumps(answer(candidates=answer()["candidates"][::-1])), "order"), "key as a number": (json.dumps(answer(candidates=item(candidate_key=2))), "order"), "too few": (json.dumps(answer(candidates=item()[:1])), "count"), "too many": (json.dumps(answer(candidates=item() + item())), "count"),
    "more fields": (json.dumps(answer(note=None)), "fields"), "fewer fields": (json.dumps({"candidates": item()}), "fields"), "more fields in an item": (json.dumps(answer(candidates=item(x=1))), "fields"), "item is text": (json.dumps(answer(candidates=["c01", "c02"])), "fields"), "no array": (json.dumps(answer(candidates={})), "array"),
    "labels": (json.dumps(answer(candidates=item(policy={"allowed": 1}))), "labels"), "vector is null": (json.dumps(answer(candidates=item(policy=None))), "labels"), "text as a number": (json.dumps(answer(candidates=item(admissibility=vector(admissible="0.1")))), "probability"), "true as a number": (json.dumps(answer(candidates=item(policy={"allowed": True, "disallowed": 0, "unknown": 0}))), "probability"),
    "above 1": (json.dumps(answer(candidates=item(admissibility=vector(admissible=-0.5, inadmissible=1.5)))), "probability"), "null in it": (json.dumps(answer(candidates=item(admissibility=vector(unknown=None)))), "probability"), "an array": ("[]", "fields"), "cut off": (GOOD[:-2], "json"), "goes on": (GOOD + "}", "json"), "goes on with another": (GOOD + "," + GOOD, "json"), "closes": (GOOD + "],[", "json"), "empty": ("", "json"), "null": (None, "json"), "NaN": (GOOD.replace("0.7", "NaN"), "json"),
}


def test_strict_responses(spark):
    requests = spark.createDataFrame([(k, ["c01", "c02"]) for k in (*CASES, "twice", "silent")], "request_id string, keys array<string>")
    rows = [(k, text) for k, (text, _) in CASES.items()] + [("twice", GOOD), ("twice", GOOD), ("unasked", GOOD)]
    checked = responses.bound(spark.createDataFrame(rows, "request_id string, response string").repartition(3), requests, responses.VERIFIER)
    want = {k: r for k, (_, r) in CASES.items()} | {"twice": "duplicate", "silent": "missing", "unasked": "unknown"}
    assert {r["request_id"]: r["reason"] for r in checked.collect()} == want
    good = [tuple(r) for r in responses.verdicts(checked).where("request_id = 'good'").orderBy("position").collect()]
    assert good == [("good", 1, "c01", 0.9, 0.0), ("good", 2, "c02", 0.9, 0.0)]
    assert responses.verdicts(checked).select("request_id").distinct().count() == sum(r is None for r in want.values())
    assert {r["request_id"] for r in responses.rejected(checked).collect()} == {k for k, r in want.items() if r}


def test_schema_binds_the_count():
    schema = json.loads(responses.json_schema(responses.VERIFIER, 20))
    candidates = schema["properties"]["candidates"]
    assert (candidates["minItems"], candidates["maxItems"], schema["additionalProperties"], schema["required"]) == (20, 20, False, ["query_intent", "candidates"])
    assert candidates["items"]["properties"]["policy"]["properties"]["allowed"] == {"type": "number", "minimum": 0, "maximum": 1}


def test_folder_of_records(spark, tmp_path):
    for name, record in (("a", {"request_id": "a", "response": answer()}), ("b", {"request_id": "other", "response": {}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "c.json").write_text("{")
    got = {r["file"]: r for r in responses.scan_folder(spark, str(tmp_path)).collect()}
    assert {k: r["request_id"] for k, r in got.items()} == {"a.json": "a", "b.json": None, "c.json": None}
    assert json.loads(got["a.json"]["response"]) == answer()


def test_claims_follow_paths(spark):
    body = json.dumps({"a": {"b c": 1.5, "n": "x", "inf": 1e308, "t": True}, "d": 2})
    sha = __import__("hashlib").sha256(body.encode()).hexdigest()
    claims = [("ok", "f", ["a", "b c"], 1.5), ("close", "f", ["a", "b c"], 1.5 + 4e-16), ("differs", "f", ["a", "b c"], 1.5 + 1e-14), ("path", "f", ["a", "zz"], 1.0), ("beyond", "f", ["d", "x"], 1.0), ("text", "f", ["a", "n"], 1.0), ("flag", "f", ["a", "t"], 1.0), ("object", "f", ["a"], 1.0), ("unlisted", "g", ["a"], 1.0), ("absent", "h", ["a"], 1.0), ("digest", "i", ["d"], 2.0), ("json", "j", ["d"], 2.0)]
    rows = spark.createDataFrame(claims, "claim_id string, artifact string, path array<string>, estimate double")
    artifacts = spark.createDataFrame([("f", body), ("g", body), ("i", body), ("j", body + "]")], "artifact string, body string")
    manifest = spark.createDataFrame([("f", sha), ("h", sha), ("i", "0" * 64), ("j", __import__("hashlib").sha256((body + "]").encode()).hexdigest())], "artifact string, sha256 string")
    got = {r["claim_id"]: r["status"] for r in contracts.claim_values(rows, artifacts, manifest).collect()}
    assert got == {"ok": "ok", "close": "ok", "differs": "differs", "path": "path", "beyond": "path", "text": "number", "flag": "number", "object": "number", "unlisted": "unlisted", "absent": "absent", "digest": "digest", "json": "json"}


def test_contracts(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "a"), ("s3", "b"), ("s3", None)], "scenario string, cell string")
    checks = {"rows": (F.count("*"), F.lit(6)), "scenarios": (F.countDistinct("scenario"), F.lit(3)), "cells": (F.count("cell"), F.count("*"))}
    assert [tuple(r) for r in contracts.verdict(rows, checks).collect()] == [("rows", 6.0, 6.0, True), ("scenarios", 3.0, 3.0, True), ("cells", 5.0, 6.0, False)]
    assert sorted(r["scenario"] for r in contracts.unbalanced(rows, ["scenario"], "cell", ["a", "b"], 1).collect()) == ["s2", "s3"]
    shares = {r["scenario"]: r["passed"] for r in contracts.drift(rows, "scenario", F.col("cell") == "a", 0.5, 0.1).collect()}
    assert shares == {"s1": True, "s2": False, "s3": False}
    path = str(tmp_path / "out")
    assert contracts.guarded_write(rows, path, {"n": (F.count("*"), 6.0)}) == {"n": 6.0}
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(contracts.Refused, match="observed"):
        contracts.guarded_write(rows, str(tmp_path / "bad"), {"n": (F.count("*"), 7.0)})
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(contracts.Refused, match="already"):
        contracts.guarded_write(rows, path, {"n": (F.count("*"), 6.0)})


def test_imports_can_be_repeated(spark, tmp_path):
    table = contracts.Checkpoints(spark, str(tmp_path / "t"))
    source = spark.createDataFrame([("1", "x", "v1"), ("2", "y", "v2"), ("2", "y", "v2"), ("3", "z", "v0"), ("4", "p", "v2"), ("4", "q", "v2"), ("5", None, "v2")], "request_id string, payload string, protocol string")
    first = {r["status"]: r["records"] for r in table.import_from(source, "v3", ["v1", "v2"], "one").collect()}
    assert first == {"new": 4, "incompatible": 1, "ambiguous": 2}
    assert sorted(r["request_id"] for r in table.records().collect()) == ["1", "2", "5"]
    second = {r["status"]: r["records"] for r in table.import_from(source, "v3", ["v1", "v2"], "one").collect()}
    assert second["incompatible"] == 1 and second["present"] == 3 and table.records().count() == 3
    other = table.import_from(source.withColumn("payload", F.lit("changed")), "v3", ["v1", "v2"], "two")
    assert {r["status"]: r["records"] for r in other.collect()}["conflict"] >= 3 and table.records().where("request_id IN ('1', '2')").count() == 2


def test_reader_evidence_is_never_pooled(spark):
    table = spark.createDataFrame([("r1", "a", 4, 0.5, 0.2), ("r1", "b", 1, 0.1, None), ("r2", "a", 9, 0.3, 0.3), ("r2", "b", 4, 0.4, 0.0)], "reader string, source string, n bigint, m double, m_sd double")
    got = {(r["population"], r["source"]): (r["estimate"], r["ci95_lower"], r["n"]) for r in quality.reader_effects(table, "c", "reader", "source", ["m"]).collect()}
    assert set(got) == {(r, s) for r in ("r1", "r2") for s in ("a", "b", "equal_source_macro")}
    assert got["r1", "a"] == pytest.approx((0.5, 0.5 - 1.96 * 0.1, 4)) and got["r1", "b"] == (0.1, None, 1)
    assert got["r1", "equal_source_macro"][0] == pytest.approx(0.3) and got["r2", "equal_source_macro"][0] == pytest.approx(0.35)
    rows = quality.reader_effects(table, "c", "reader", "source", ["m"])
    assert quality.contrasts(rows, "r1", "r2", "a").first()["estimate"] == pytest.approx(0.2)
    with pytest.raises(Exception, match="exactly one row"):
        quality.contrasts(rows.unionByName(rows.where("population = 'r1'")), "r1", "r2", "a").collect()
    with pytest.raises(Exception, match="two sources"):
        quality.reader_effects(table.where("source = 'a'"), "c", "reader", "source", ["m"]).collect()


def test_overlays_are_bound_to_bytes(spark, tmp_path):
    base, path = spark.createDataFrame([(1,), (2,)], "id bigint"), str(tmp_path / "base")
    base.write.parquet(path)
    digest = io.dataset_digest(spark, path)
    sha = digest.first()["sha256"]
    overlay = spark.createDataFrame([(1, sha), (2, "0" * 64), (3, sha), (None, None)], "id bigint, base_sha256 string")
    assert {r["id"]: r["binding"] for r in io.bound_overlay(overlay, base, digest, "id").collect()} == {1: "bound", 2: "stale", 3: "unknown", None: "stale"}


def test_finite_mean(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "a double, b double")
    assert rows.agg(quality.finite_mean(F.col("a"))).first()[0] == 1.5
    for c in ("b", "a / 0", "double('nan')"):
        with pytest.raises(Exception):
            rows.agg(quality.finite_mean(F.expr(c))).collect()


def test_responses_are_read_once_and_strictly(spark):
    """Before, a text was taken apart by some fifty VARIANT expressions, and requests were made of the responses' items."""
    shape, keys = responses.VERIFIER, ["c01", "c02"]
    assert responses.refused(GOOD, keys, shape) is None
    vector = '{"current_state":0.7,"history":0.2,"unknown":0.1}'
    odd = {vector[:-1] + ',"unknown":0.1}': "json", '{"current_state":0.7,"history":0.2,"unknown":true}': "probability", '{"current_state":0.7,"history":0.2,"unknown":1e999}': "probability", '{"current_state":0.7,"history":0.2,"unknown":NaN}': "json", '{"current_state":0.7,"history":0.2,":":0.1}': "labels", "null": "labels", '{"current_state":1,"history":0,"unknown":-0}': None}
    for text, reason in odd.items():
        whole = json.dumps({"query_intent": 0, "candidates": json.loads(GOOD)["candidates"]}).replace('"query_intent": 0', f'"query_intent": {text}')
        assert (text, responses.refused(whole, keys, shape)) == (text, reason)
    from quillon.plans import contracts as plans

    requests, _ = plans._asked(spark, "/root/testdata/sf0.001")
    assert "admissibility" not in requests._jdf.queryExecution().optimizedPlan().toString()
