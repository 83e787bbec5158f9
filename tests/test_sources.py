from __future__ import annotations

import json

from pyspark.sql import functions as F

from weft.sources import connector, readers, sinks


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_openalex(spark, tmp_path):
    p = lines(tmp_path / "a.json", [{"id": "https://openalex.org/W1", "display_name": "T", "publication_year": 2001, "cited_by_count": 3, "doi": "https://doi.org/10.1/x", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "primary_location": {"source": {"display_name": "V"}, "pdf_url": "p", "landing_page_url": "l"}, "authorships": [{"author": {"display_name": "A B"}}]}, {"id": "https://openalex.org/W2"}])
    a, b = readers.openalex(spark, p).orderBy("source_id").collect()
    assert (a["source_id"], a["abstract"], a["doi"], a["venue"], a["authors"], a["citations"]) == ("W1", "a b a", "10.1/x", "V", ["A B"], 3)
    assert b["title"] is None and b.asDict().keys() == a.asDict().keys()


def test_europepmc_and_years(spark, tmp_path):
    p = lines(tmp_path / "e.json", [{"id": "1", "title": "T", "authorString": "A B, C D.", "pubYear": "1999", "abstractText": "<h4>x</h4> y"}, {"id": "2", "pubYear": "n"}])
    df = readers.europepmc(spark, p)
    a = df.where("source_id = '1'").first()
    assert (a["authors"], a["year"], a["abstract"]) == (["A B", "C D"], 1999, "x y")
    assert {r["source_id"] for r in readers.in_years(df, 2000, None).collect()} == {"2"}
    assert readers.in_years(df, None, 1999).count() == 2


def test_semantic_scholar(spark, tmp_path):
    p = lines(tmp_path / "s.json", [{"paperId": "s", "externalIds": {"DOI": "d", "ArXiv": "x"}, "authors": [{"name": "N"}], "openAccessPdf": {"url": "u"}}])
    a = readers.semantic_scholar(spark, p).first()
    assert (a["doi"], a["arxiv_id"], a["authors"], a["pdf_url"]) == ("d", "x", ["N"], "u")


def test_arxiv(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  b</title><summary> s </summary><published>2021-01-01T00:00:00Z</published><author><name>N</name></author><author><name>M</name></author><link href='h'/><link href='p' title='pdf'/></entry></feed>")
    a = readers.arxiv(spark, str(tmp_path / "f.xml")).first()
    assert (a["arxiv_id"], a["title"], a["year"], a["authors"], a["pdf_url"]) == ("2101.00001", "A b", 2021, ["N", "M"], "p")


def test_bibtex(spark):
    text = '@comment{x}\n@article{k1, title = {A {Nested} title}, author = "A B and C D", year = 2001, journal={J}}\n@string{s="x"}@inproceedings{k2,\n title={T},\n booktitle={Proc},\n}\n@book{broken, title={'
    got = readers.bibtex(spark.createDataFrame([(text,), (None,)], "value string")).collect()
    assert [(r["key"], r["title"], r["authors"], r["year"], r["venue"]) for r in got] == [("k1", "A Nested title", ["A B", "C D"], 2001, "J"), ("k2", "T", [], None, "Proc")]


def test_connector_and_golden(spark, tmp_path):
    connector.register(spark)
    p = lines(tmp_path / "r.json", [{"id": "1", "title": "t", "year": 3}])
    r = spark.read.format("weft_records").option("path", p).option("source", "mine").load().first()
    assert (r["source"], r["source_id"], r["year"], r["authors"]) == ("mine", "1", 3, [])
    (tmp_path / "g.json").write_text(json.dumps([{"case_id": "a", "target": "qa", "input": {"q": "x"}, "tags": ["t"]}, {"case_id": "b", "target": "review"}]))
    assert [r["case_id"] for r in readers.golden_cases(spark, str(tmp_path / "g.json"), "qa").collect()] == ["a"]
    assert readers.supported("arxiv", "title") == "title" and readers.supported("semantic_scholar", "title") == "all"


def test_reading_order(spark):
    blocks = [(0.0, 45.0, 10.0, "l1"), (55.0, 100.0, 10.0, "r1"), (0.0, 100.0, 0.0, "head"), (0.0, 45.0, 20.0, "l2"), (55.0, 100.0, 20.0, "r2")]
    d = spark.createDataFrame([(blocks,)], "b array<struct<x0:double,x1:double,top:double,text:string>>")
    assert d.select(readers.in_reading_order(F.col("b"), F.lit(100.0))).first()[0] == ["head", "l1", "l2", "r1", "r2"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("T", "c", ["s1", "s2"], "f")], "t string, c string, s array<string>, f string")
    made = d.select(sinks.markdown(F.col("t"), F.col("c"), F.col("s"), F.col("f")).alias("m"))
    assert made.first()["m"] == "# T\n\nc\n\n## Sources\n\n- s1\n- s2\n\n---\nf\n"
    sinks.write_text(made, "m", str(tmp_path / "out"))
    sinks.write_json_lines(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert json.loads(sinks.as_json(d).first()["value"])["s"] == ["s1", "s2"]
