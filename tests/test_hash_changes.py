"""Hashes made again from stored payloads: rows that share a hash, and how often a payload is read."""

import json

from tallyhouse.operators import normalise


def _stored(spark, copies):
    payload = {"transactionId": "1", "bookingDate": "2026-01-02", "amount": {"value": "-1.50"}, "creditor": {"name": "Rewe"}}
    return spark.createDataFrame([("bank", json.dumps({"source_payload": payload}), "old", None)] * copies, "source string, raw string, content_hash string, superseded_by string")


def test_rows_of_one_hash_are_one_change(spark):
    found = normalise.hash_changes(_stored(spark, 3)).collect()
    assert len(found) == 1 and found[0]["old"] == "old" and len(found[0]["new"]) == 64


def test_a_payload_is_read_once(spark):
    plan = normalise.hash_changes(_stored(spark, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1 and plan.count("get_json_object") < 50
