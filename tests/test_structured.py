"""Answers of a declared form: valid, fenced, partial, wrong and empty ones, and their repair."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weft.operators import structured

FORM = StructType([StructField("k", IntegerType(), False), StructField("name", StringType(), True)])


def test_checks(spark):
    cases = {
        1: ('{"k": 5, "name": "a", "more": [1]}', None, (5, "a"), []),
        2: ('So:\n```json\n{"k": 6}\n```', None, (6, None), []),
        3: ("{'k': 7, 'name': 'b',}", None, (7, "b"), []),
        4: ('{"name": "c"}', "schema_failed", (None, "c"), [("k", "missing")]),
        5: ('{"k": null}', "schema_failed", (None, None), [("k", "missing")]),
        6: ('{"k": "many", "name": "d"}', "schema_failed", (None, "d"), [("k", "not int")]),
        7: ("[1, 2]", "schema_failed", None, [("", "not an object")]),
        8: ("no json", "parse_failed", None, []),
        9: ("", "parse_failed", None, []),
        10: (None, "parse_failed", None, []),
    }
    rows = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "id int, answer string")
    for r in structured.structured(rows, "answer", FORM).collect():
        _, kind, data, errors = cases[r["id"]]
        x = r["checked"]
        got = tuple(x["data"]) if x["data"] is not None else None
        assert (x["success"], x["error_type"], got, [tuple(e) for e in x["errors"]]) == (kind is None, kind, data, errors), r
        assert not r["repaired"] and r["attempts"] == 0
    assert structured.structured(rows.limit(0), "answer", FORM).count() == 0


def test_repair_is_bounded_and_sees_failures_only(spark):
    def write(prompts):
        assert all("Correct this JSON" in p for p in prompts)
        return prompts.map(lambda p: json.dumps({"k": 1}) if re.search("k: missing", p) else "still no json")

    rows = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"name": "x"}'), (3, "nothing")], "id int, answer string").withColumn("checked", F.lit("clash"))
    got = {r["id"]: (r["checked"]["success"], r["repaired"], r["attempts"], r["checked"]["error_type"]) for r in structured.structured(rows, "answer", FORM, write, 2).collect()}
    assert got == {1: (True, False, 0, None), 2: (True, True, 1, None), 3: (False, False, 2, "parse_failed")}
