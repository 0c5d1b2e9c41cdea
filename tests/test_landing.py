"""Landed records keep their own text; envelope files have one order; numbers in digits of any script."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import quality
from provenant.sources import adapters, snapshots

ODD = ['{"id":"n1","amount":1.10,"big":1e3,"z":12345678901234567890,"t":"a\\u00e9\\n\\"q\\""}', '{ "id" : "n2" , "amount" : 2 }', '{"id":"é\u2028","x":[1.50,{"y":null}]}']


def test_landed_records_keep_their_text(spark):
    raw = spark.createDataFrame(list(enumerate(ODD)), "ingest_seq long, raw_json string")
    path = tempfile.mkdtemp(prefix="provenant-land-", dir="/tmp") + "/run"
    snapshots.land_records(raw, path)
    got = {r["ingest_seq"]: r for r in snapshots.read_landed(spark, path, ["id", "amount", "big", "z"]).collect()}
    assert {k: r["raw_json"] for k, r in got.items()} == dict(enumerate(ODD))
    assert (got[0]["amount"], got[0]["big"], got[0]["z"]) == ("1.10", "1e3", "12345678901234567890")


def test_numbers_inside_strings_stay(spark):
    odd = '{"a":":1.5,","b":"x\\":2.5","c":1.50, "d":{"e":-2.0E-3},"f":[1.50]}'
    row = spark.createDataFrame([(odd,)], "raw string").select(snapshots.numbers_as_text(F.col("raw")).alias("x")).first()
    assert json.loads(row["x"]) == {"a": ":1.5,", "b": 'x":2.5', "c": "1.50", "d": {"e": "-2.0E-3"}, "f": [1.5]}


def _envelopes(records):
    folder = tempfile.mkdtemp(prefix="provenant-envelope-", dir="/tmp")
    for name, rows in records.items():
        with open(os.path.join(folder, name), "w") as f:
            json.dump({"data": rows}, f, indent=1)
    return folder


def test_the_same_content_in_two_files_is_one_duplicate(spark):
    notice = {c: None for c in adapters.NOTICE_COLUMNS} | {
        "project_id": "P123456", "bid_description": "Two files, one tender", "publication_date": "2026-01-05", "deadline_date": "2026-02-05"}
    folder = _envelopes({"a.json": [notice | {"id": "n1"}], "b.json": [notice | {"id": "n2"}, notice | {"id": "n3", "bid_description": "Another"}]})
    rows = snapshots.read_envelope(spark, folder, "data", adapters.NOTICE_COLUMNS)
    assert sorted(r["ingest_seq"] for r in rows.collect()) == ["a.json#000000000000", "b.json#000000000000", "b.json#000000000001"]
    issues = quality.duplicate_content_issues(quality.classify_notices(rows, "run-1")).collect()
    assert [(i["control_id"], i["record_id"]) for i in issues] == [("DQ-008", "n2")]


def test_numbers_in_digits_of_any_script(spark):
    rows = spark.createDataFrame([("١٢٣.٥",), ("１２３",), ("१_०",), ("12",), ("१x",), ("", ), (None,)], "v string")
    got = rows.select(T.to_number("v").alias("n"), T.to_number_error("v").alias("e")).collect()
    assert [r["n"] for r in got] == [123.5, 123.0, 10.0, 12.0, None, None, None]
    assert [bool(r["e"]) for r in got] == [False, False, False, False, True, False, False]
