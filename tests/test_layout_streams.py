from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions import layout
from weft.operators import graphs, hooks, measures
from weft.plans.more import select_context
from weft.streaming import tasks

SF = "/root/testdata/sf0.001"


def one(spark, c, x):
    return spark.createDataFrame([(x,)], "x string" if not isinstance(x, list) else "x array<string>").select(c.alias("o")).first()["o"]


@pytest.mark.parametrize("line,want", [("Abstract", "abstract"), ("2. Related work and more", "related_work"), ("3) results", "result"), ("abstract", None), ("We use a method", None), ("方法", "method"), ("", None), ("1. " + "x" * 80, None), ("Conclusions", "conclusion")])
def test_heading(spark, line, want):
    assert one(spark, layout.heading(F.col("x")), line) == want


@pytest.mark.parametrize("line,want", [("a = b + c", True), ("∑x ≤ ∫y", True), ("plain words only here", False), ("= ", False), ("one long sentence with a = sign in the middle of words", False)])
def test_formula(spark, line, want):
    assert one(spark, layout.is_formula(F.col("x")), line) is want


def test_axis_labels(spark):
    block = ["0.1", "0.2", "x", "", "0.4", "0.5", "A long line that is plainly running text here", "z"]
    assert one(spark, layout.axis_labels_end(F.col("x"), F.lit(0)), block) == 6
    assert one(spark, layout.axis_labels_end(F.col("x"), F.lit(0)), ["0.1", "Figure 1 shows"]) == 0


def test_references(spark):
    named = "Smith, J. (2001). First title here. Journal A.\nDoe, B. (2002). Second title here. Journal B.\nLee, C. (2003). Third title. Journal C."
    assert len(one(spark, layout.references(F.col("x")), named)) == 3
    assert one(spark, layout.references(F.col("x")), "[1] a\n[2] b\n[3] c") == ["a", "b", "c"]
    assert one(spark, layout.references(F.col("x")), "one\n\ntwo") == ["one", "two"]
    assert one(spark, layout.references(F.col("x")), "") == []
    f = layout.reference_fields(F.col("x"))
    raw = "[1] Smith, J. and Doe, B. (2001). A fine title. Journal. 10.1234/abc."
    assert one(spark, f["title"], raw) == "A fine title" and one(spark, f["year"], raw) == 2001 and one(spark, f["doi"], raw) == "10.1234/abc"
    assert one(spark, f["year"], "no year") is None


def test_title_and_authors(spark):
    page = "123 x\nDepartment of Things\nA Title of Some Length\nAnn Lee1,2, Bob Doe*, Eva Noe3\nAbstract"
    assert one(spark, layout.guessed_title(F.col("x")), page) == "A Title of Some Length"
    assert one(spark, layout.guessed_authors(F.col("x")), page) == ["Ann Lee", "Bob Doe", "Eva Noe"]
    assert one(spark, layout.guessed_title(F.col("x")), None) == ""


def test_page_flags(spark):
    assert one(spark, layout.page_flags(F.col("x")), ["", "", "abc"]) == ["empty_pdf", "scanned_pdf_suspected"]
    assert one(spark, layout.page_flags(F.col("x")), ["word " * 200]) == []


def test_select_context(spark):
    rows = [("p", "a", 1, 5), ("p", "a", 2, 5), ("p", "a", 3, 5), ("p", "b", 4, 8), ("p", "b", 5, 1), ("q", "b", 1, 3)]
    d = spark.createDataFrame(rows, "g string, s string, i int, c int")
    got = select_context(d, ["g"], "s", "c", "i", {"a": 12, "b": 9}, 18)
    assert sorted((r["g"], r["i"]) for r in got.collect()) == [("p", 1), ("p", 2), ("p", 4), ("q", 1)]


def test_gates(spark):
    e = spark.createDataFrame([("scope_guard", 1.0), ("citation_coverage", 0.7)], "name string, score double")
    got = {r["name"]: r["passed"] for r in measures.quality_gates(e).collect()}
    assert got == {"scope_guard": True, "citation_coverage": False, "report_traceability": False, "innovation_specificity": True, "generic_text": True, "redaction": False}


def test_hooks(spark):
    d = spark.createDataFrame([("short one",), ("a much longer question here",)], "q string")
    shout = lambda s: s.str.upper()
    assert [r[0] for r in d.select(hooks.refined(F.col("q"), shout)).collect()] == ["short one", "A MUCH LONGER QUESTION HERE"]
    assert [r[0] for r in d.select(hooks.refined(F.col("q"))).collect()] == ["short one", "a much longer question here"]
    v = d.select(hooks.embedded(F.col("q"), lambda s: pd.Series([[float(len(x))] for x in s])).alias("v")).collect()
    assert [r["v"] for r in v] == [[9.0], [27.0]]

    def broken():
        raise OSError("down")

    found, errors = hooks.searched({"a": lambda: d, "b": broken, "c": lambda: d})
    assert found.count() == 4 and errors == {"b": "down"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        part = next((tmp_path / f"p{k}").glob("*.parquet"))
        part.rename(folder / f"events{k}.parquet")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = tasks.event_stream(spark, str(folder), "*.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    again = lambda: tasks.event_stream(spark, str(folder), "*.parquet")
    whole = lambda df, name: tasks.settled(df, str(tmp_path / name))
    assert key(whole(tasks.tumbling(stream, "1 day").withColumn("total", F.round("total", 3)), "tumbling")) == key(tasks.tumbling(batch, "1 day").withColumn("total", F.round("total", 3)))
    assert key(whole(tasks.last_states(again()), "last")) == key(tasks.last_states(batch))
    assert key(whole(tasks.sessions(again(), "4 hours"), "sessions")) == key(tasks.sessions(batch, "4 hours"))
    n = tasks.settled(tasks.numbered_states(again()), str(tmp_path / "states"), ["user_id"])
    assert key(n.select("user_id", "n")) == key(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    build = lambda d: graphs.mentions(d, "state", F.col("event_type"), F.col("user_id"), F.col("event_id"))
    kept = tasks.maintained(again(), build, str(tmp_path / "graph"))
    assert key(kept.select(*sorted(kept.columns))) == key(build(batch).select(*sorted(kept.columns)))
    # A stream that is started again goes on after what it has seen, and gives the same.
    assert key(tasks.maintained(again(), build, str(tmp_path / "graph"))) == key(kept)
